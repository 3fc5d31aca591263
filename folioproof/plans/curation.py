"""Curation queries: duplicates, leakage, components, splits, reviews, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import LABELS
from ..operators import components as C, coverage as V2, pairs as P, reviews as R, splits as S, upsert as U
from ..operators.export import validation_report
from ..sources import manifests as M, views as V
from .ordered import running
from .registry import Tables, query, view
from .session import keep

view("src", """SELECT id, n, CASE WHEN n % 10 < 6 THEN 'train' WHEN n % 10 < 8 THEN 'dev' WHEN n % 10 = 8
  THEN 'qualification' ELSE 'regression' END AS split, sha256(id) AS sha256
  FROM (SELECT DISTINCT source AS id, CAST(substr(source, 4) AS INT) AS n FROM documents)""")
view("token", """SELECT id, split, 'document' AS kind, id AS value FROM {src}
  UNION SELECT id, split, 'edition', 'ed' || n FROM {src}
  UNION SELECT id, split, 'artwork', 'art' || (n // 4) FROM {src}
  UNION SELECT id, split, 'parent', 'par' || n FROM {src}""")
view("excl", """SELECT source, 'toxic' AS reason FROM documents LEFT JOIN labels USING (doc_id)
  GROUP BY source HAVING count(*) FILTER (WHERE toxic = 1) * 100 >= count(*) * 7""")
view("worst", """SELECT source FROM documents LEFT JOIN labels USING (doc_id)
  GROUP BY source HAVING count(*) FILTER (WHERE toxic = 1) * 100 >= count(*) * 10""")
view("smp", """SELECT d.doc_id AS id, source, d.doc_id AS page, sha256(text) AS sha,
  CASE lang WHEN 'en' THEN 'boards' WHEN 'fr' THEN 'negative' WHEN 'de' THEN 'partial' ELSE 'unsupported' END AS kind,
  n_chars AS width, n_chars // 2 + 1 AS height, d.doc_id % 3 AS revision, lang AS content,
  coalesce(quality = 1, false) AS accepted, CASE WHEN lang = 'en' THEN d.doc_id % 3 + 1 ELSE 0 END AS boards
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
view("star", """SELECT a, id AS b, 'exact' AS reason FROM (SELECT id, min(id) OVER (PARTITION BY sha) AS a FROM {smp}) WHERE a <> id""")
view("said", """SELECT a, b, CASE b % 5 WHEN 0 THEN 'duplicate' ELSE 'distinct' END AS decision FROM {star} WHERE b % 5 < 2""")
view("act", """SELECT s.id, s.source, o.split FROM {smp} s JOIN {src} o ON o.id = s.source
  WHERE s.source NOT IN (SELECT source FROM {excl})""")
view("headed", """SELECT a.id, a.source, a.split, s.sha, a.id = min(a.id) OVER (PARTITION BY s.sha, a.split) AS head
  FROM {act} a JOIN {smp} s ON s.id = a.id""")
view("every", """SELECT p.id AS a, q.id AS b, 'exact' AS reason, d.decision, p.source AS source_a, q.source AS source_b, p.split AS split_a, q.split AS split_b,
  p.head AND (q.head OR p.split = q.split) AS link
  FROM {headed} p JOIN {headed} q ON p.sha = q.sha AND p.id < q.id LEFT JOIN {said} d ON d.a = p.id AND d.b = q.id AND d.decision = 'duplicate'""")
view("sided", "SELECT * FROM {every} WHERE link OR decision IS NOT NULL")
view("log", """SELECT event_id AS id, user_id AS sample, ts AS tm, event_type AS content, CAST(event_id % 7 AS VARCHAR) AS reviewer,
  event_type <> 'error' AS human, value AS seconds FROM events""")
view("rev", """SELECT *, sum(changed) OVER (PARTITION BY sample ORDER BY tm, id) AS revision FROM (
  SELECT *, CASE WHEN content IS DISTINCT FROM lag(content) OVER (PARTITION BY sample ORDER BY tm, id) THEN 1 ELSE 0 END AS changed
  FROM {log})""")


def decisions(t: Tables) -> DataFrame:
    """Decisions of the time before any source was excluded."""
    links = P.exact_links(t.samples(), "id", "sha").where("b % 5 < 2")
    return links.select("a", "b", F.when(F.col("b") % 5 == 0, "duplicate").otherwise("distinct").alias("decision"))


def active(t: Tables) -> DataFrame:
    return P.active_pages(t.samples(), t.sources(), t.exclusions(), "sha")


def sided(t: Tables) -> DataFrame:
    return P.split_links(active(t), "sha", decisions(t))


# --- duplicates and leakage -------------------------------------------------

@query("""SELECT split_a, split_b, reason, CAST(sum(n) AS BIGINT) AS pairs FROM (
  SELECT x.split AS split_a, y.split AS split_b, 'exact' AS reason, count(*) AS n FROM smp p JOIN act x ON x.id = p.id
    JOIN smp q ON q.sha = p.sha JOIN act y ON y.id = q.id WHERE x.split < y.split GROUP BY 1, 2
  UNION ALL SELECT a.split, b.split, a.kind, count(*) FROM token a JOIN token b ON a.kind = b.kind AND a.value = b.value
    WHERE a.split < b.split AND a.id NOT IN (SELECT source FROM excl) AND b.id NOT IN (SELECT source FROM excl) GROUP BY 1, 2, 3)
  GROUP BY 1, 2, 3""", "smp", "act", "token", "excl")
def leak_by_split(t: Tables) -> DataFrame:
    return P.leaks(t.samples(), t.sources(), t.exclusions())


@query("SELECT * FROM star", "star")
def exact_pairs(t: Tables) -> DataFrame:
    return P.exact_links(t.samples(), "id", "sha")


@query("""SELECT (SELECT count(*) FROM (SELECT sha FROM smp GROUP BY sha HAVING count(*) > 1)) AS groups,
  CAST(sum(CASE WHEN x.split = y.split THEN 1 ELSE 0 END) AS BIGINT) AS same_split_pairs,
  CAST(sum(CASE WHEN x.split <> y.split THEN 1 ELSE 0 END) AS BIGINT) AS cross_split_pairs
  FROM smp p JOIN smp q ON p.sha = q.sha AND p.id < q.id JOIN src x ON x.id = p.source JOIN src y ON y.id = q.source""", "smp", "src")
def exact_pair_counts(t: Tables) -> DataFrame:
    rows = t.samples().join(t.sources().select(F.col("id").alias("source"), "split"), "source")
    return P.exact_pair_counts(rows, "sha", "split")


@query("SELECT id, source, split FROM act", "act")
def active_samples(t: Tables) -> DataFrame:
    return P.active_pages(t.samples(), t.sources(), t.exclusions())


_code = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(60))
view("own", f"SELECT vec_id AS id, CAST({_code} AS BIGINT) AS phash FROM embeddings")
view("code", "SELECT * FROM {own} UNION ALL SELECT id + 1000000, xor(phash, (1 << CAST(id % 7 AS INT)) - 1) FROM {own}")


@query("""SELECT p.id AS a, q.id AS b, CAST(bit_count(xor(p.phash, q.phash)) AS INT) AS distance, 'perceptual' AS reason
  FROM code p JOIN code q ON p.id < q.id WHERE bit_count(xor(p.phash, q.phash)) <= 4""", "code")
def hamming_pairs(t: Tables) -> DataFrame:
    return P.near_links(V.codes(t.embeddings), "id", "phash")


view("found", """SELECT a, b, reason, 0 AS tm FROM {star}
  UNION ALL SELECT a, b, 'board-exact', b % 4 FROM {star} WHERE a % 2 = 0
  UNION ALL SELECT a + 1, b + 1, 'perceptual', 0 FROM {star}
  UNION ALL SELECT a + 1, b + 1, 'board-perceptual', b % 3 FROM {star} WHERE b % 2 = 0
  UNION ALL SELECT a + 1, b + 1, 'board-exact', b % 5 FROM {star} WHERE b % 2 = 0""")


@query("""SELECT a, b, arg_max(reason, CASE WHEN reason = 'exact' THEN 2000 WHEN reason LIKE 'board-%' THEN 1000 + 2 * tm +
  CASE WHEN reason = 'board-exact' THEN 1 ELSE 0 END ELSE 0 END) AS reason FROM found GROUP BY a, b""", "found")
def pair_precedence(t: Tables) -> DataFrame:
    star = P.exact_links(t.samples(), "id", "sha")
    next_page = star.select((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"))
    rows = (star.select("a", "b", "reason", F.lit(0).cast("long").alias("at"))
            .unionByName(star.where("a % 2 = 0").select("a", "b", F.lit("board-exact").alias("reason"), (F.col("b") % 4).alias("at")))
            .unionByName(next_page.select("a", "b", F.lit("perceptual").alias("reason"), F.lit(0).cast("long").alias("at")))
            .unionByName(next_page.where("b % 2 = 1").select("a", "b", F.lit("board-perceptual").alias("reason"), ((F.col("b") - 1) % 3).alias("at")))
            .unionByName(next_page.where("b % 2 = 1").select("a", "b", F.lit("board-exact").alias("reason"), ((F.col("b") - 1) % 5).alias("at"))))
    return P.settle(rows)


view("sig", f"""SELECT vec_id // 4 AS sample, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 2000) AS BIGINT) AS sha, CAST({_code} AS BIGINT) AS phash
  FROM embeddings
  UNION ALL SELECT vec_id // 4 + 500000, -1 - vec_id, xor(CAST({_code} AS BIGINT), (1 << CAST(vec_id % 7 AS INT)) - 1) FROM embeddings""")


@query("""SELECT DISTINCT a, sample AS b, 'board-exact' AS reason FROM (SELECT sample, min(sample) OVER (PARTITION BY sha) AS a FROM sig) WHERE a <> sample
  UNION ALL SELECT DISTINCT least(p.sample, q.sample), greatest(p.sample, q.sample), 'board-perceptual' FROM sig p JOIN sig q
  ON p.sample < q.sample AND bit_count(xor(p.phash, q.phash)) <= 4""", "sig")
def board_duplicates(t: Tables) -> DataFrame:
    codes = V.codes(t.embeddings)
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.floor(F.abs(V.dim(0)) * 2000).alias("sha"))
    own = codes.join(e, "id").select(F.expr("id div 4").alias("sample"), "sha", "phash")
    copies = codes.where("id >= 1000000").select(
        (F.expr("(id - 1000000) div 4") + 500000).alias("sample"), (F.lit(-1) - (F.col("id") - 1000000)).alias("sha"), "phash")
    return P.board_links(own.unionByName(copies)).distinct()


@query("""SELECT count(*) FILTER (WHERE decision IS NULL AND split_a = split_b) AS same_split_candidates,
  count(*) FILTER (WHERE decision IS NULL AND split_a <> split_b) AS cross_split_blockers FROM every""", "every")
def pair_status(t: Tables) -> DataFrame:
    return P.pair_status(active(t), "sha", decisions(t))


@query("SELECT a, b, reason, split_a AS split FROM sided WHERE decision IS NULL AND split_a = split_b AND split_a IN ('train', 'dev')", "sided")
def same_split_audit(t: Tables) -> DataFrame:
    return P.same_split_audit(sided(t), ["train", "dev"])


@query("""SELECT a, b, reason, split_a, split_b, CASE WHEN decision IS NULL THEN 'unresolved-duplicate' ELSE 'cross-split-duplicate' END AS code
  FROM sided WHERE split_a <> split_b AND (decision IS NULL OR decision = 'duplicate')""", "sided")
def duplicate_blockers(t: Tables) -> DataFrame:
    return P.blockers(sided(t))


@query("SELECT DISTINCT b AS id FROM sided WHERE decision = 'duplicate'", "sided")
def dropped_duplicates(t: Tables) -> DataFrame:
    return P.dropped_duplicates(sided(t))


@query("""SELECT d.a, d.b, d.asked, s.reason, CASE WHEN d.asked NOT IN ('distinct', 'duplicate') THEN 'invalid-decision'
  WHEN s.reason IS NULL THEN 'unknown-or-inactive' WHEN s.decision IS NOT NULL THEN 'already-resolved'
  WHEN s.split_a = s.split_b THEN 'same-split' WHEN d.asked = 'distinct' THEN 'exact-not-distinct' ELSE 'recorded' END AS outcome
  FROM (SELECT a, b, CASE b % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN 'distinct' ELSE 'duplicate' END AS asked FROM star) d
  LEFT JOIN every s ON s.a = d.a AND s.b = d.b""", "star", "every")
def duplicate_decisions(t: Tables) -> DataFrame:
    asked = P.exact_links(t.samples(), "id", "sha").select(
        F.col("b").alias("a"), F.col("a").alias("b"),
        F.when(F.col("b") % 7 == 0, "maybe").when(F.col("b") % 7 == 1, "distinct").otherwise("duplicate").alias("decision"))
    return P.decide(active(t), "sha", decisions(t), asked)


@query("""SELECT s.a, s.b, CASE s.b % 2 WHEN 0 THEN 'exact' ELSE 'board-exact' END AS reason,
  CASE WHEN s.b % 2 = 0 OR (x.revision = 0 AND y.revision = 0) THEN d.decision END AS decision
  FROM star s JOIN smp x ON x.id = s.a JOIN smp y ON y.id = s.b LEFT JOIN said d ON d.a = s.a AND d.b = s.b""", "star", "smp", "said")
def carried_decisions(t: Tables) -> DataFrame:
    """Pages with a revision above 0 had an earlier one when the decisions were made."""
    now = t.samples()
    before = now.withColumn("revision", F.lit(0).cast("long"))
    pairs = P.exact_links(now, "id", "sha").withColumn("reason", F.when(F.col("b") % 2 == 0, "exact").otherwise("board-exact"))
    old = pairs.join(decisions(t), ["a", "b"])
    return P.carry_decisions(pairs, old, P.changed_pages(now, before, "sha", "revision"))


view("shot", """SELECT id, phash, CASE id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'train' WHEN 2 THEN 'dev' ELSE 'regression' END AS split FROM (
  SELECT * FROM {code} UNION ALL SELECT id + 2000001, phash FROM {code} WHERE id % 3 = 0 UNION ALL SELECT id + 4000003, phash FROM {code} WHERE id % 9 = 0)""")
view("shothead", "SELECT *, id = min(id) OVER (PARTITION BY phash, split) AS head FROM {shot}")


@query("""SELECT p.id AS a, q.id AS b, CAST(bit_count(xor(p.phash, q.phash)) AS INT) AS distance, p.split AS split_a, q.split AS split_b
  FROM shothead p JOIN shothead q ON p.id < q.id WHERE bit_count(xor(p.phash, q.phash)) <= 4
  AND p.head AND (q.head OR (p.phash = q.phash AND p.split = q.split))""", "shothead")
def perceptual_links(t: Tables) -> DataFrame:
    """Codes held several times, by pages of three splits."""
    codes = V.codes(t.embeddings)
    shots = (codes.unionByName(codes.where("id % 3 = 0").withColumn("id", F.col("id") + 2000001))
             .unionByName(codes.where("id % 9 = 0").withColumn("id", F.col("id") + 4000003)))
    place = F.col("id") % 5
    shots = shots.select("id", "phash", F.lit("s").alias("source"), F.when(place < 2, "train").when(place == 2, "dev").otherwise("regression").alias("split"))
    return P.near_split_links(shots, "phash").select("a", "b", "distance", "split_a", "split_b")


@query("""SELECT t.id, t.split, t.kind, t.value, k.splits FROM token t JOIN (SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits
  FROM token GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) k USING (kind, value)""", "token")
def cross_split_lineage(t: Tables) -> DataFrame:
    return P.cross_split_lineage(t.sources())


# --- components and splits --------------------------------------------------

view("item", "SELECT doc_id AS item, sha256(text) AS key FROM documents UNION SELECT doc_id, 'b' || (doc_id // 5) FROM documents")
view("edge", "SELECT DISTINCT x.item AS u, y.item AS v FROM {item} x JOIN {item} y USING (key)")


@query("""RECURSIVE reach(u, v) AS (SELECT u, u FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v)
  SELECT u AS item, min(v) AS component FROM reach GROUP BY u""", "item", "edge")
def components(t: Tables) -> DataFrame:
    return C.components(V.items(t.documents))


view("left_item", "SELECT * FROM {item} WHERE item % 29 <> 5")
view("left_edge", "SELECT DISTINCT x.item AS u, y.item AS v FROM {left_item} x JOIN {left_item} y USING (key)")


@query("""RECURSIVE reach(u, v) AS (SELECT u, u FROM left_edge UNION SELECT r.u, e.v FROM reach r JOIN left_edge e ON e.u = r.v)
  SELECT u AS item, min(v) AS component FROM reach GROUP BY u""", "left_item", "left_edge")
def maintained_components(t: Tables) -> DataFrame:
    """Components after items were added to a labelled table, and others taken out."""
    items = keep(V.items(t.documents))
    old, added = items.where("item % 4 <> 3"), items.where("item % 4 = 3")
    labels = keep(C.grown(keep(C.components(old)), old, added))
    return C.shrunk(labels, items, items.where("item % 29 = 5"))


view("tie", "SELECT DISTINCT x.id AS u, y.id AS v FROM {token} x JOIN {token} y USING (kind, value)")


@query("""RECURSIVE reach(u, v) AS (SELECT source, source FROM excl UNION SELECT r.u, e.v FROM reach r JOIN tie e ON e.u = r.v)
  SELECT v AS source, 'toxic' AS reason FROM reach GROUP BY v""", "excl", "token", "tie")
def exclusion_closure(t: Tables) -> DataFrame:
    return C.exclusion_closure(t.sources(), t.exclusions().withColumnRenamed("source", "id"))


@query("""RECURSIVE reach(split, u, v) AS (SELECT split, id, id FROM src UNION SELECT r.split, r.u, e.v FROM reach r JOIN tie e ON e.u = r.v
  JOIN src o ON o.id = e.v AND o.split = r.split)
  SELECT split, count(DISTINCT c) AS components FROM (SELECT split, u, min(v) AS c FROM reach GROUP BY 1, 2) GROUP BY split""", "src", "token", "tie")
def components_per_split(t: Tables) -> DataFrame:
    return C.components_per_split(t.sources())


FREEZE = """RECURSIVE reach(u, v) AS (SELECT u, u FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v),
  comp AS (SELECT u AS item, min(v) AS component FROM reach GROUP BY u),
  size AS (SELECT component, count(*) AS size FROM comp GROUP BY 1),
  turn AS (SELECT *, row_number() OVER (ORDER BY size DESC, sha256('7:' || component), component) AS rn,
    sum(size) OVER () * 0.6::DOUBLE AS ta, sum(size) OVER () * 0.2::DOUBLE AS tb FROM size),
  fill(rn, component, size, split, a, b, c) AS (
    SELECT 0::BIGINT, -1::BIGINT, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT
    UNION ALL SELECT n.rn, n.component, n.size, n.pick, f.a + CASE WHEN n.pick = 'train' THEN n.size ELSE 0 END,
      f.b + CASE WHEN n.pick = 'development' THEN n.size ELSE 0 END, f.c + CASE WHEN n.pick = 'calibration' THEN n.size ELSE 0 END
    FROM fill f JOIN LATERAL (SELECT t.rn, t.component, t.size, CASE WHEN f.a / t.ta <= f.b / t.tb AND f.a / t.ta <= f.c / t.tb THEN 'train'
      WHEN f.b / t.tb <= f.c / t.tb THEN 'development' ELSE 'calibration' END AS pick FROM turn t WHERE t.rn = f.rn + 1) n ON true)"""


def frozen(t: Tables) -> DataFrame:
    return S.freeze(S.component_sizes(C.components(V.items(t.documents))), 7)


@query(FREEZE + " SELECT component, size, split FROM fill WHERE rn > 0", "item", "edge")
def frozen_split(t: Tables) -> DataFrame:
    return frozen(t)


@query(FREEZE + """, page AS (SELECT d.doc_id, f.split, CASE lang WHEN 'en' THEN 'boards' WHEN 'fr' THEN 'negative' ELSE 'partial' END AS kind,
    'e' || (doc_id % 4) AS effect, 'l' || (doc_id % 3) AS layout, CASE WHEN lang = 'en' THEN doc_id % 3 + 1 ELSE 0 END AS nb
    FROM documents d JOIN comp k ON k.item = d.doc_id JOIN fill f ON f.component = k.component AND f.rn > 0),
  board AS (SELECT split, 's' || (doc_id % 3) AS set, 'p' || ((doc_id + n) % 5) AS position_kind, (doc_id + n) % 2 AS side
    FROM page, generate_series(1, 3) g(n) WHERE n <= nb)
  SELECT p.*, coalesce(b.boards, 0) AS boards, b.sets, b.position_kinds, b.white_bottom, b.black_bottom, '' AS failed_gates FROM (
    SELECT split, count(*) AS pages, count(*) FILTER (WHERE kind = 'boards') AS positive_pages, count(*) FILTER (WHERE kind = 'negative') AS negative_pages,
      count(*) FILTER (WHERE kind = 'partial') AS partial_pages, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects,
      string_agg(DISTINCT layout, ',' ORDER BY layout) AS layouts FROM page GROUP BY split) p
  LEFT JOIN (SELECT split, count(*) AS boards, string_agg(DISTINCT set, ',' ORDER BY set) AS sets, string_agg(DISTINCT position_kind, ',' ORDER BY position_kind) AS position_kinds,
      count(*) FILTER (WHERE side = 0) AS white_bottom, count(*) FILTER (WHERE side = 1) AS black_bottom FROM board GROUP BY split) b USING (split)""", "item", "edge")
def split_summary(t: Tables) -> DataFrame:
    members = keep(C.components(V.items(t.documents)))
    split = S.freeze(S.component_sizes(members), 7)
    d = F.col("doc_id")
    pages = (t.documents.select("doc_id", "lang").join(members.withColumnRenamed("item", "doc_id"), "doc_id")
             .join(split.select("component", "split"), "component")
             .select("doc_id", "split", F.when(F.col("lang") == "en", "boards").when(F.col("lang") == "fr", "negative").otherwise("partial").alias("kind"),
                     F.concat(F.lit("e"), (d % 4).cast("string")).alias("effect"), F.concat(F.lit("l"), (d % 3).cast("string")).alias("layout"),
                     F.when(F.col("lang") == "en", d % 3 + 1).otherwise(0).alias("nb")))
    pages = keep(pages)
    boards = pages.where("nb > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("nb")))).select(
        "split", F.concat(F.lit("s"), (d % 3).cast("string")).alias("set"), F.concat(F.lit("p"), ((d + F.col("k")) % 5).cast("string")).alias("position_kind"),
        F.when((d + F.col("k")) % 2 == 0, "white-bottom").otherwise("black-bottom").alias("orientation"))
    return S.summary(pages, boards)


# --- review log and queue ---------------------------------------------------

@query("""SELECT id, sample, CAST(revision AS BIGINT) AS revision, CASE changed WHEN 1 THEN 'correction' ELSE 'confirmation' END AS decision FROM rev""", "log", "rev")
def review_revisions(t: Tables) -> DataFrame:
    return R.revisions(V.review_log(t.events)).select("id", "sample", F.col("revision").cast("long").alias("revision"), "decision")


@query("""SELECT sample, CAST(max(revision) AS BIGINT) AS revision, arg_max(content, revision) AS content, arg_max(accepted, revision) AS accepted,
  CAST(sum(n) AS BIGINT) AS reviews, round(sum(seconds), 4) AS seconds FROM (SELECT sample, revision, any_value(content) AS content, bool_or(human) AS accepted,
  count(*) AS n, sum(seconds) AS seconds FROM rev GROUP BY 1, 2) GROUP BY sample""", "rev")
def review_state(t: Tables) -> DataFrame:
    return R.page_state(V.review_log(t.events)).select(
        "sample", F.col("revision").cast("long").alias("revision"), "content", "accepted", "reviews", F.round("seconds", 4).alias("seconds"))


view("page", """SELECT user_id AS id, 'u' || (user_id % 20) AS source, user_id AS page, user_id % 4 AS revision, 'h' || (user_id % 5) AS sha,
  user_id % 3 = 0 AS accepted, CASE user_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'unsupported' ELSE 'boards' END AS kind
  FROM (SELECT DISTINCT user_id FROM events)""")
view("gone", "SELECT DISTINCT source FROM {page} WHERE id % 20 = 3")
view("held", """SELECT event_id AS deferral, user_id AS sample, event_id % 4 AS revision, event_type AS reason FROM events WHERE event_type IN ('error', 'view')""")
view("res", """SELECT event_id AS result, user_id AS sample, event_id % 4 AS revision, 'h' || (event_id % 5) AS image_sha, event_id % 11 AS run, ts AS tm
  FROM events WHERE event_type = 'purchase'""")
view("drf", "SELECT DISTINCT user_id AS sample, event_id % 4 AS revision, 'boards' AS kind FROM events WHERE event_type = 'signup'")


def queue_pages(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events.select("user_id").distinct().select(
        u.alias("id"), F.concat(F.lit("u"), (u % 20).cast("string")).alias("source"), u.alias("page"), (u % 4).alias("revision"),
        F.concat(F.lit("h"), (u % 5).cast("string")).alias("sha"), (u % 3 == 0).alias("accepted"),
        F.when(u % 5 == 0, "partial").when(u % 5 == 1, "unsupported").otherwise("boards").alias("kind"))


def queue_excluded(t: Tables) -> DataFrame:
    return queue_pages(t).where("id % 20 = 3").select("source").distinct()


def deferrals(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("error", "view")).select(
        F.col("event_id").alias("deferral"), F.col("user_id").alias("sample"), (F.col("event_id") % 4).alias("revision"), F.col("event_type").alias("reason"))


def results(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("result"), F.col("user_id").alias("sample"), (F.col("event_id") % 4).alias("revision"),
        F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("image_sha"), (F.col("event_id") % 11).alias("run"), F.col("ts").alias("at"))


def drafts(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup'").select(
        F.col("user_id").alias("sample"), (F.col("event_id") % 4).alias("revision"), F.lit("boards").alias("kind")).distinct()


@query("""SELECT sample, h.revision, arg_max(reason, deferral) AS reason FROM held h JOIN page p ON p.id = h.sample AND p.revision = h.revision GROUP BY 1, 2""", "held", "page")
def latest_deferral(t: Tables) -> DataFrame:
    return R.latest_deferral(deferrals(t), queue_pages(t))


@query("""SELECT sample, reviewer, max(id) AS id, arg_max(content, id) AS content FROM log GROUP BY 1, 2""", "log")
def latest_review(t: Tables) -> DataFrame:
    return R.latest(V.review_log(t.events), ["sample", "reviewer"], ["id"], "id", "content")


_queue = """SELECT p.id, p.source, p.page, p.revision, p.accepted, d.sample IS NOT NULL AS draft,
  (SELECT arg_max(reason, deferral) FROM held h WHERE h.sample = p.id AND h.revision = p.revision) AS deferred_reason,
  (SELECT count(*) FROM res r WHERE r.sample = p.id AND r.revision = p.revision AND r.image_sha = p.sha) AS proposal_count,
  coalesce(d.kind, p.kind) AS review_state FROM page p LEFT JOIN drf d ON d.sample = p.id AND d.revision = p.revision
  WHERE p.source NOT IN (SELECT source FROM gone)"""
view("queue", _queue.replace("held h", "{held} h").replace("res r", "{res} r").replace("page p LEFT JOIN drf d", "{page} p LEFT JOIN {drf} d").replace("FROM gone", "FROM {gone}"))


def queue(t: Tables) -> DataFrame:
    return R.page_queue(queue_pages(t), queue_excluded(t), drafts(t), deferrals(t), results(t))


@query("SELECT * FROM queue", "queue")
def review_queue(t: Tables) -> DataFrame:
    return queue(t)


@query("""SELECT count(*) FILTER (WHERE NOT accepted) AS pending, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE proposal_count > 0) AS proposal,
  count(*) FILTER (WHERE deferred_reason IS NOT NULL) AS deferred, count(*) FILTER (WHERE review_state IN ('partial', 'unsupported')) AS ambiguous FROM queue""", "queue")
def queue_views(t: Tables) -> DataFrame:
    return queue(t).agg(*[F.count_if(R.queue_filter(n)).alias(n) for n in ("pending", "accepted", "proposal", "deferred", "ambiguous")])


@query("""SELECT r.result, r.sample, r.revision, r.image_sha, CASE WHEN p.revision = r.revision AND p.sha = r.image_sha THEN 'current' ELSE 'stale' END AS state
  FROM res r LEFT JOIN page p ON p.id = r.sample""", "res", "page")
def current_results(t: Tables) -> DataFrame:
    return R.current_results(results(t), queue_pages(t)).select("result", "sample", "revision", "image_sha", "state")


@query("""SELECT event_id, event_id % 5 AS run, user_id AS sample, row_number() OVER (PARTITION BY event_id % 5, user_id ORDER BY ts, event_id) - 1 AS ordinal FROM events""")
def attempt_ordinals(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", (F.col("event_id") % 5).alias("run"), F.col("user_id").alias("sample"))
    return R.attempt_ordinals(rows, ["ts", "event_id"]).select("event_id", "run", "sample", F.col("ordinal").cast("long").alias("ordinal"))


_rollup = """SELECT event_id % 40 AS run, count(*) FILTER (WHERE event_type = 'error') AS attempts_failed, count(*) FILTER (WHERE event_type = 'view') AS attempts_stale,
  count(*) FILTER (WHERE event_type = 'click') AS attempts_done, count(*) FILTER (WHERE event_type = 'purchase') AS completed,
  CASE WHEN (event_id % 40) % 3 < 2 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) > 7200 THEN 'heartbeat-stale-resume-required'
    ELSE list_value('starting', 'running', 'complete')[CAST((event_id % 40) % 3 + 1 AS INT)] END AS state FROM events GROUP BY event_id % 40"""
view("runs", _rollup)


def rollup(t: Tables) -> DataFrame:
    run = F.col("event_id") % 40
    runs = t.events.groupBy(run.alias("run")).agg(F.max("ts").alias("heartbeat"), F.min("ts").alias("created")).withColumn(
        "state", F.element_at(F.array(F.lit("starting"), F.lit("running"), F.lit("complete")), (F.col("run") % 3 + 1).cast("int")))
    attempts = t.events.where(F.col("event_type").isin("error", "view", "click")).select(
        run.alias("run"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "stale").otherwise("done").alias("state"))
    done = t.events.where("event_type = 'purchase'").select(run.alias("run"))
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return R.run_rollup(runs, attempts, done, now, ["failed", "stale", "done"], 7200)


@query("SELECT * FROM runs", "runs")
def run_rollup(t: Tables) -> DataFrame:
    return rollup(t).select("run", "attempts_failed", "attempts_stale", "attempts_done", "completed", "state")


@query("""SELECT event_id % 40 AS run, epoch_us(min(ts)) AS created_us FROM events GROUP BY 1 ORDER BY min(ts) DESC LIMIT 20""")
def recent_runs(t: Tables) -> DataFrame:
    return rollup(t).orderBy(F.desc("created")).limit(20).select("run", F.unix_micros(F.col("created").cast("timestamp")).alias("created_us"))


@query("""SELECT s.id, s.source, s.page, s.revision, s.sha FROM smp s JOIN src o ON o.id = s.source WHERE s.source NOT IN (SELECT source FROM excl)
  AND o.split = 'train' AND NOT s.accepted ORDER BY s.source, s.page LIMIT 100""", "smp", "src", "excl")
def proposal_scope(t: Tables) -> DataFrame:
    return R.proposal_scope(t.samples(), t.sources(), t.exclusions(), "train-pending", 100)


view("hum", "SELECT doc_id AS sample, doc_id % 3 AS revision, lang AS content, toxic = 0 AS human FROM documents JOIN labels USING (doc_id)")


def document_reviews(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.join(t.labels, "doc_id").select(
        d.alias("sample"), (d % 3).cast("long").alias("revision"), F.col("lang").alias("content"), (F.col("toxic") == 0).alias("human"))


@query("""SELECT id FROM smp s WHERE accepted AND NOT EXISTS (SELECT 1 FROM hum h WHERE h.human AND h.sample = s.id AND h.revision = s.revision AND h.content = s.content)""", "smp", "hum")
def unconfirmed_pages(t: Tables) -> DataFrame:
    return R.unconfirmed(t.samples(), document_reviews(t)).select("id")


@query("""SELECT id FROM smp s WHERE NOT accepted AND EXISTS (SELECT 1 FROM hum h WHERE h.human AND h.sample = s.id AND h.revision = s.revision AND h.content = s.content)""", "smp", "hum")
def promotable_pages(t: Tables) -> DataFrame:
    return R.promotable(t.samples(), document_reviews(t)).select("id")


@query("""SELECT session, idx, dense_rank() OVER (PARTITION BY session ORDER BY idx) - 1 AS position FROM (SELECT DISTINCT user_id AS session, event_id % 977 AS idx FROM events)""")
def normalised_index(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("session"), (F.col("event_id") % 977).alias("idx")).distinct()
    return running(rows, ["session"], [F.col("idx")], number="_n").select("session", "idx", (F.col("_n") - 1).cast("long").alias("position"))


# --- keyed writes and agreement ---------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, arg_min(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS quantity FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""")
def insert_absent(t: Tables) -> DataFrame:
    key = ["l_orderkey", "l_linenumber"]
    new = t.lineitem.select(*key, F.col("l_quantity").alias("quantity"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    old = new.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return U.insert_absent(old, new, key, ["l_shipdate", "l_partkey", "l_suppkey", "quantity", "l_extendedprice"]).select(*key, "quantity")


@query("""SELECT l_orderkey AS id, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'conflict' WHEN min(o_orderstatus) IS NULL THEN 'insert'
  WHEN min(o_orderstatus) = min(l_linestatus) THEN 'same' ELSE 'conflict' END AS outcome FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def immutable_insert(t: Tables) -> DataFrame:
    new = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("digest"))
    return U.immutable_insert(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("digest")), new, "id", "digest")


@query("""SELECT user_id AS sample, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY 1""")
def latest_wins(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("sample"), "value", F.col("event_id").alias("version"), "event_type")
    arrived = F.col("event_type").isin("click", "view")
    return U.upsert(rows.where(~arrived).drop("event_type"), rows.where(arrived).drop("event_type"), ["sample"], "version")


@query("""SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' ELSE 'different' END AS reason
  FROM (SELECT doc_id, lang = 'en' AS good FROM documents) e FULL JOIN (SELECT doc_id, quality = 1 AS good FROM labels) a ON a.doc_id = e.doc_id
  WHERE a.doc_id IS NULL OR e.doc_id IS NULL OR a.good <> e.good""")
def record_agreement(t: Tables) -> DataFrame:
    return U.agreement(t.documents.select("doc_id", (F.col("lang") == "en").alias("good")),
                       t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), ["doc_id"], ["good"])


view("lab", "SELECT lang, source FROM documents JOIN labels USING (doc_id)")


@query("""SELECT *, 'left' AS side FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT * FROM lab)
  UNION ALL SELECT *, 'right' FROM (SELECT * FROM lab EXCEPT ALL SELECT lang, source FROM documents)""", "lab")
def set_differences(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels.select("doc_id"), "doc_id").select("lang", "source")
    return U.set_differences(t.documents.select("lang", "source"), labelled)


@query("""SELECT o_orderkey AS id, 'missing' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT l_orderkey, 'repeated' FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def control_completeness(t: Tables) -> DataFrame:
    return U.control_completeness(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.select(F.col("l_orderkey").alias("id")), ["id"])


@query("""SELECT board, square, CASE WHEN moved THEN NULL ELSE coalesce(edit, label) END AS shown, label AS model_label,
  CASE WHEN moved THEN 'refused' WHEN edit IS NOT NULL THEN 'corrected' ELSE 'model' END AS state FROM (
  SELECT vec_id // 8 AS board, CAST(vec_id % 8 AS INT) AS square, 'm' || label AS label, CASE WHEN label < 3 THEN 'h' || (vec_id % 10) END AS edit,
  (vec_id // 8) % 6 = 5 AND bool_or(label < 3) OVER (PARTITION BY vec_id // 8) AS moved FROM embeddings)""")
def corrected_squares(t: Tables) -> DataFrame:
    board = F.expr("vec_id div 8")
    rows = t.embeddings.select("vec_id", board.alias("board"), (F.col("vec_id") % 8).cast("int").alias("square"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("label"),
                               F.concat(F.lit("g"), board.cast("string")).alias("geometry"))
    # Humans corrected the squares of three classes.
    edits = rows.where(F.col("label").isin("m0", "m1", "m2")).select("board", "square", F.concat(F.lit("h"), (F.col("vec_id") % 10).cast("string")).alias("label"),
                                                F.when(F.col("board") % 6 == 5, "old").otherwise(F.col("geometry")).alias("geometry"))
    return U.overlay(rows.drop("vec_id"), edits, ["board"])


# --- coverage ---------------------------------------------------------------

@query("""SELECT o.split, count(*) AS pages, CAST(sum(boards) AS BIGINT) AS boards, count(DISTINCT source) AS sources, count(DISTINCT n // 4) AS artwork_groups
  FROM smp s JOIN src o ON o.id = s.source WHERE accepted GROUP BY o.split""", "smp", "src")
def coverage_by_split(t: Tables) -> DataFrame:
    return V2.by_split(t.samples().where("accepted"), t.sources())


@query("""SELECT split, what, name, count(*) AS n FROM (SELECT split, 'kind' AS what, kind AS name FROM smp s JOIN src o ON o.id = s.source WHERE accepted
  UNION ALL SELECT split, 'condition', 'c' || (n % 3) FROM smp s JOIN src o ON o.id = s.source WHERE accepted
  UNION ALL SELECT split, 'condition', 'print' FROM smp s JOIN src o ON o.id = s.source WHERE accepted) GROUP BY 1, 2, 3""", "smp", "src")
def coverage_kinds(t: Tables) -> DataFrame:
    return V2.kinds(t.samples().where("accepted"), t.sources())


_names = "['.', 'P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k']"
view("cell", f"""SELECT vec_id, label AS tag, i - 1 AS square, {_names}[CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 60) AS INT) % 13 + 1] AS label,
  ((i - 1) // 8 + (i - 1) % 8) % 2 AS parity FROM embeddings, generate_series(1, 64) g(i)""")


@query("SELECT label, CAST(parity AS INT) AS parity, count(*) AS n FROM cell GROUP BY 1, 2", "cell")
def class_parity(t: Tables) -> DataFrame:
    return V2.class_parity(V.boards(t.embeddings))


_domain = """SELECT d.label, d.parity FROM (SELECT unnest(['.', 'P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k']) AS label) l,
  LATERAL (SELECT l.label, CAST(unnest([0, 1]) AS INT) AS parity) d"""


@query(_domain + " WHERE NOT EXISTS (SELECT 1 FROM cell c WHERE c.label = d.label AND c.parity = d.parity)", "cell")
def class_parity_missing(t: Tables) -> DataFrame:
    return V2.missing_class_parity(V.boards(t.embeddings))


@query(f"""SELECT g.tag, e.label, e.parity FROM (SELECT CAST(unnest(range(10)) AS INT) AS tag) g, ({_domain}) e
  WHERE NOT EXISTS (SELECT 1 FROM cell c WHERE c.label = e.label AND c.parity = e.parity AND c.tag = g.tag)""", "cell")
def class_parity_gaps(t: Tables) -> DataFrame:
    boards = V.boards(t.embeddings).join(t.embeddings.select("vec_id", F.col("label").alias("tag")), "vec_id")
    return V2.missing_cells(V2.class_parity(boards, "tag"), {"tag": list(range(10)), "label": LABELS, "parity": [0, 1]})


@query(f"""SELECT g.split, g.page, e.label, e.parity FROM (SELECT DISTINCT vec_id // 4 AS page, ['train', 'dev', 'regression'][CAST((vec_id // 4) % 3 + 1 AS INT)] AS split FROM embeddings) g, ({_domain}) e
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT vec_id // 4 AS page, ['.', 'P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k'][CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 60) AS INT) % 13 + 1] AS label,
    ((i - 1) // 8 + (i - 1) % 8) % 2 AS parity FROM embeddings, range(1, 65) r(i)) c WHERE c.page = g.page AND c.label = e.label AND c.parity = e.parity)""")
def page_parity_missing(t: Tables) -> DataFrame:
    """What the boards of a page, named with its split, do not show."""
    split = F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("regression")), (F.col("page") % 3 + 1).cast("int"))
    return V2.missing_class_parity(V.boards(t.embeddings).withColumn("split", split), "split", "page")


@query("""SELECT count(*) AS positions, CAST(max(n) AS BIGINT) AS max_repetition, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_boards
  FROM (SELECT sha, count(*) AS n FROM smp GROUP BY sha)""", "smp")
def repetition(t: Tables) -> DataFrame:
    return V2.repetition(t.samples().select(F.array("sha").alias("labels")))


@query("""SELECT event_type AS state, count(*) AS jobs, count(*) FILTER (WHERE user_id % 20 <> 3) AS active_jobs FROM events GROUP BY 1""")
def job_states(t: Tables) -> DataFrame:
    jobs = t.events.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("source"), F.col("event_type").alias("state"))
    return V2.job_states(jobs, queue_excluded(t))


@query("""SELECT count(*) AS pages, count(*) FILTER (WHERE accepted) AS accepted_pages, count(*) FILTER (WHERE NOT accepted) AS review_queue
  FROM smp WHERE source NOT IN (SELECT source FROM excl)""", "smp", "excl")
def page_counts(t: Tables) -> DataFrame:
    return V2.page_counts(t.samples(), t.exclusions())


@query("""SELECT count(*) AS pages, count(*) FILTER (WHERE accepted) AS accepted_pages, count(*) FILTER (WHERE NOT accepted) AS review_queue, (SELECT count(*) FROM src) AS sources,
  (SELECT count(*) FROM excl) AS excluded_sources, (SELECT count(*) FROM every WHERE decision IS NULL AND split_a <> split_b) AS cross_split_blockers,
  (SELECT count(*) FROM every WHERE decision IS NULL AND split_a = split_b) AS same_split_candidates,
  CASE WHEN (SELECT count(*) FROM every WHERE decision IS NULL AND split_a <> split_b) > 0 THEN 'resolve-cross-split-duplicates' ELSE 'review-and-validate' END AS next_action
  FROM smp WHERE source NOT IN (SELECT source FROM excl)""", "smp", "src", "excl", "every")
def store_status(t: Tables) -> DataFrame:
    states = V2.job_states(t.samples().select("source", F.when(F.col("accepted"), "done").otherwise("queued").alias("state")), t.exclusions())
    return V2.status(t.samples(), t.sources(), t.exclusions(), P.pair_status(active(t), "sha", decisions(t)), states)


@query("""SELECT CAST(interval AS BIGINT) AS interval, dimension, name, count(*) AS n FROM (
  SELECT doc_id // 100 AS interval, 'lang' AS dimension, lang AS name FROM documents
  UNION ALL SELECT doc_id // 100, 'source', source FROM documents) GROUP BY 1, 2, 3""")
def exposure(t: Tables) -> DataFrame:
    return V2.exposure(t.documents.select(F.expr("doc_id div 100").alias("interval"), "lang", "source"), "interval", ["lang", "source"])


@query("""SELECT code, count(*) AS rows FROM (
  SELECT 'cross-split-lineage' AS code FROM token t JOIN (SELECT kind, value FROM token WHERE id NOT IN (SELECT source FROM excl) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) k USING (kind, value)
    WHERE t.id NOT IN (SELECT source FROM excl)
  UNION ALL SELECT CASE WHEN decision IS NULL THEN 'unresolved-duplicate' ELSE 'cross-split-duplicate' END FROM sided WHERE split_a <> split_b AND (decision IS NULL OR decision = 'duplicate')
  UNION ALL SELECT 'review-integrity' FROM smp s WHERE accepted AND source NOT IN (SELECT source FROM excl) AND id NOT IN (SELECT b FROM sided WHERE decision = 'duplicate')
    AND NOT EXISTS (SELECT 1 FROM hum h WHERE h.human AND h.sample = s.id AND h.revision = s.revision AND h.content = s.content)
  UNION ALL SELECT 'acquisition-incomplete' FROM smp WHERE NOT accepted AND source NOT IN (SELECT source FROM excl)
  UNION ALL SELECT 'page-size' FROM smp WHERE width > 8192) GROUP BY code""", "token", "excl", "sided", "smp", "hum")
def validation(t: Tables) -> DataFrame:
    pages = t.samples()
    jobs = pages.select("source", F.when(F.col("accepted"), "done").otherwise("queued").alias("state"))
    broken = pages.where("width > 8192").select(F.lit("page-size").alias("code"))
    return validation_report(t.sources(), pages, t.exclusions(), sided(t), document_reviews(t), jobs, broken)


# --- provenance registry ----------------------------------------------------

def registry(t: Tables) -> DataFrame:
    p = F.col("page_id")
    return t.pages.select(
        F.concat(F.lit("r"), F.when(p % 50 == 49, p - 1).otherwise(p).cast("string")).alias("id"),
        F.when(p % 5 == 0, "license-evidence").when(p % 5 == 1, "piece-svg").otherwise("pdf").alias("kind"), "url",
        F.lit("1").alias("revision"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"),
        (F.octet_length("html") - F.when(p % 31 == 0, 1).otherwise(0)).cast("long").alias("max_bytes"),
        F.lit("who").alias("attribution"), F.when(p % 37 == 0, "").otherwise("cc0").alias("license"),
        F.when((p % 5 == 0) | (p % 41 == 0), F.array().cast("array<string>")).otherwise(F.array(
            F.concat(F.lit("r"), (p - p % 5).cast("string")), F.concat(F.lit("r"), (p - p % 3 + 200).cast("string")))).alias("evidence_ids"),
        F.lit(None).cast("array<int>").alias("pages"), F.lit(None).cast("string").alias("split"))


view("reg", """SELECT 'r' || (CASE WHEN page_id % 50 = 49 THEN page_id - 1 ELSE page_id END) AS id, page_id AS p, url,
  CASE page_id % 5 WHEN 0 THEN 'license-evidence' WHEN 1 THEN 'piece-svg' ELSE 'pdf' END AS kind,
  CASE WHEN page_id % 5 = 0 OR page_id % 41 = 0 THEN [] ELSE ['r' || (page_id - page_id % 5), 'r' || (page_id - page_id % 3 + 200)] END AS ev FROM pages""")


@query("""SELECT DISTINCT id, code FROM (
  SELECT id, 'url' AS code FROM reg WHERE NOT regexp_full_match(url, 'https://[^/?#@:]+(/[^?#]*)?')
  UNION ALL SELECT id, 'bytes' FROM reg WHERE p % 31 = 0 UNION ALL SELECT id, 'license' FROM reg WHERE p % 37 = 0
  UNION ALL SELECT id, 'evidence' FROM reg WHERE kind <> 'license-evidence' AND len(ev) = 0
  UNION ALL SELECT id, 'repeated-id' FROM reg GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT id, 'dangling-evidence' FROM (SELECT id, unnest(ev) AS e FROM reg) WHERE e NOT IN (SELECT id FROM reg))""", "reg")
def registry_violations(t: Tables) -> DataFrame:
    from ..functions.rules import registry_violations as violations
    return violations(registry(t))


@query("""SELECT DISTINCT l.id, l.e AS evidence, k.kind AS evidence_kind FROM (SELECT DISTINCT id, unnest(ev) AS e FROM reg) l
  LEFT JOIN (SELECT id, min(kind) AS kind FROM reg GROUP BY id) k ON k.id = l.e""", "reg")
def evidence_links(t: Tables) -> DataFrame:
    records = registry(t).groupBy("id").agg(F.min("kind").alias("kind"), F.min("sha256").alias("sha256"),
                                            F.array_distinct(F.flatten(F.collect_set("evidence_ids"))).alias("evidence_ids"))
    return M.with_evidence(records).select("id", "evidence", "evidence_kind")
