"""Near duplicates: kept by generations, counted, decided and blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import near_gate as N
from ..operators.near_index import NearIndex
from ..operators.open_pairs import open_near_pages, open_equal_pages
from .curation import active, decisions
from .registry import Tables, query, view
from .session import shared_path

_code = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i if i < 63 else "(-9223372036854775807 - 1)"}::BIGINT ELSE 0::BIGINT END)" for i in range(64))
view("sign64", f"SELECT vec_id, {_code} AS code FROM embeddings")
view("shot64", """SELECT vec_id, vec_id * 6 + j AS id, xor(code, CASE WHEN j = 1 THEN (1 << CAST(vec_id % 7 AS INT)) - 1 ELSE 0 END) AS code
  FROM {sign64}, (SELECT unnest(range(5)) AS j) WHERE j < 2 OR (j = 2 AND vec_id % 3 = 0) OR (j > 2 AND vec_id % 9 = 0)""")
view("near64", """SELECT id, code, CASE id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'train' WHEN 2 THEN 'dev' ELSE 'regression' END AS split
  FROM {shot64} WHERE vec_id % 20 <> 3""")
view("ruled", """SELECT vec_id * 6 AS a, vec_id * 6 + 1 AS b, CASE WHEN vec_id % 8 = 0 THEN 'duplicate' ELSE 'distinct' END AS decision FROM {sign64} WHERE vec_id % 4 = 0
  UNION ALL SELECT vec_id * 6 + 2, vec_id * 6, 'distinct' FROM {sign64} WHERE vec_id % 6 = 0""")
view("pair64", """SELECT p.id AS a, q.id AS b, least(p.code, q.code) AS l, greatest(p.code, q.code) AS r, CAST(bit_count(xor(p.code, q.code)) AS INT) AS distance,
    CASE WHEN p.code > q.code OR (p.code = q.code AND p.split > q.split) THEN q.split ELSE p.split END AS split_left,
    CASE WHEN p.code > q.code OR (p.code = q.code AND p.split > q.split) THEN p.split ELSE q.split END AS split_right, d.decision
  FROM {near64} p JOIN {near64} q ON p.id < q.id AND bit_count(xor(p.code, q.code)) <= 4
  LEFT JOIN {ruled} d ON least(d.a, d.b) = p.id AND greatest(d.a, d.b) = q.id""")
view("head64", "SELECT code, split, min(id) AS head FROM {near64} GROUP BY 1, 2")
view("gate64", """SELECT p.l AS "left", p.r AS "right", any_value(distance) AS distance, split_left, split_right, any_value(x.head) AS a, any_value(y.head) AS b, count(*) AS pairs,
    count(*) FILTER (WHERE decision = 'duplicate') AS duplicates, count(*) FILTER (WHERE decision = 'distinct') AS distincts,
    count(*) FILTER (WHERE decision IS NULL) AS unresolved
  FROM {pair64} p JOIN {head64} x ON x.code = p.l AND x.split = p.split_left JOIN {head64} y ON y.code = p.r AND y.split = p.split_right GROUP BY p.l, p.r, split_left, split_right""")


def signs(t: Tables) -> DataFrame:
    """(vec_id, code): the signs of all 64 dimensions."""
    bits = [F.when(F.col("embedding")[i] > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return t.embeddings.select("vec_id", code.alias("code"))


def shots(t: Tables) -> DataFrame:
    """(id, vec_id, code): each code held by two to five pages, one of them with up to six bits changed."""
    j, v = F.col("j"), F.col("vec_id")
    flips = F.when(j == 1, F.element_at(F.array(*[F.lit((1 << i) - 1).cast("long") for i in range(7)]), (v % 7 + 1).cast("int"))).otherwise(F.lit(0).cast("long"))
    rows = signs(t).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((j < 2) | ((j == 2) & (v % 3 == 0)) | ((j > 2) & (v % 9 == 0)))
    return rows.select((v * 6 + j).alias("id"), "vec_id", F.col("code").bitwiseXOR(flips).alias("code"))


def split_of(number: Column) -> Column:
    return F.when(number % 5 < 2, "train").when(number % 5 == 2, "dev").otherwise("regression")


def near_pages(t: Tables) -> DataFrame:
    return shots(t).where("vec_id % 20 <> 3").select("id", F.lit("s").alias("source"), split_of(F.col("id")).alias("split"), F.array("code").alias("codes"))


def near_rulings(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    rows = t.embeddings.select("vec_id")
    return rows.where(v % 4 == 0).select((v * 6).alias("a"), (v * 6 + 1).alias("b"), F.when(v % 8 == 0, "duplicate").otherwise("distinct").alias("decision")).unionByName(
        rows.where(v % 6 == 0).select((v * 6 + 2).alias("a"), (v * 6).alias("b"), F.lit("distinct").alias("decision")))


def near_gated(t: Tables) -> DataFrame:
    return N.gate(near_pages(t), near_rulings(t))


@query("SELECT * FROM gate64", "gate64")
def near_gate(t: Tables) -> DataFrame:
    """Pairs between the holders of near codes, by split, with what was decided."""
    return near_gated(t)


@query("""SELECT count(*) FILTER (WHERE decision IS NULL AND split_left = split_right) AS same_split_candidates,
  count(*) FILTER (WHERE decision IS NULL AND split_left <> split_right) AS cross_split_blockers FROM pair64""", "pair64")
def near_status(t: Tables) -> DataFrame:
    return N.status(near_gated(t))


@query("""SELECT "left", "right", split_left, split_right, a, b, unresolved, duplicates, CASE WHEN unresolved > 0 THEN 'unresolved-duplicate' ELSE 'cross-split-duplicate' END AS code
  FROM gate64 WHERE split_left <> split_right AND (unresolved > 0 OR duplicates > 0)""", "gate64")
def near_blockers(t: Tables) -> DataFrame:
    return N.near_blockers(near_gated(t))


@query("""SELECT "left", "right", split_left AS split, unresolved FROM gate64 WHERE split_left = split_right AND unresolved > 0""", "gate64")
def near_audit(t: Tables) -> DataFrame:
    return N.near_audit(near_gated(t))


@query("SELECT DISTINCT b AS id FROM pair64 WHERE decision = 'duplicate'", "pair64")
def near_dropped(t: Tables) -> DataFrame:
    """Pages that leave an export as confirmed near duplicates."""
    return N.near_dropped(near_pages(t), near_rulings(t))


_PROPOSED = """SELECT vec_id * 6 AS a, vec_id * 6 + n AS b, CASE vec_id % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN 'duplicate' ELSE 'distinct' END AS asked
  FROM sign64, (SELECT unnest([1, 2, 4, 6]) AS n)"""


@query(f"""SELECT p.a, p.b, p.asked, CASE WHEN p.asked NOT IN ('distinct', 'duplicate') THEN 'invalid-decision' WHEN x.a IS NULL THEN 'unknown-or-inactive'
  WHEN x.decision IS NOT NULL THEN 'already-resolved' WHEN x.split_left = x.split_right THEN 'same-split' ELSE 'recorded' END AS outcome
  FROM ({_PROPOSED}) p LEFT JOIN pair64 x ON x.a = p.a AND x.b = p.b""", "sign64", "pair64")
def near_decisions(t: Tables) -> DataFrame:
    """Proposed decisions on near pairs, and on pairs that are none."""
    v = F.col("vec_id")
    asked = t.embeddings.select("vec_id", F.explode(F.array(*[F.lit(n) for n in (1, 2, 4, 6)])).alias("n")).select(
        (v * 6 + F.col("n")).alias("a"), (v * 6).alias("b"), F.when(v % 5 == 0, "maybe").when(v % 5 == 1, "duplicate").otherwise("distinct").alias("decision"))
    return N.near_decide(near_pages(t), near_rulings(t), asked)


# --- boards -----------------------------------------------------------------

view("board64", """SELECT (vec_id // 4) * 6 + id % 6 AS page, id AS board, code FROM {shot64}
  UNION ALL SELECT (vec_id // 4) * 6, -id - 1, code FROM {shot64} WHERE id % 6 = 0 AND vec_id % 10 = 0""")
view("placed64", "SELECT *, CASE page % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'train' WHEN 2 THEN 'dev' ELSE 'regression' END AS split FROM {board64} WHERE page % 7 <> 5")
view("ruled64", """SELECT DISTINCT (vec_id // 4) * 6 AS a, (vec_id // 4) * 6 + 1 AS b, CASE WHEN (vec_id // 4) % 4 = 0 THEN 'duplicate' ELSE 'distinct' END AS decision FROM {sign64} WHERE (vec_id // 4) % 2 = 0""")
view("boards64", """SELECT p.page AS a, q.page AS b, least(p.code, q.code) AS l, greatest(p.code, q.code) AS r, CAST(bit_count(xor(p.code, q.code)) AS INT) AS distance,
    CASE WHEN p.code > q.code OR (p.code = q.code AND p.split > q.split) THEN q.split ELSE p.split END AS split_left,
    CASE WHEN p.code > q.code OR (p.code = q.code AND p.split > q.split) THEN p.split ELSE q.split END AS split_right, d.decision
  FROM {placed64} p JOIN {placed64} q ON p.page < q.page AND bit_count(xor(p.code, q.code)) <= 4
  LEFT JOIN {ruled64} d ON d.a = p.page AND d.b = q.page""")


def board_pages(t: Tables) -> DataFrame:
    """Pages with the codes of their boards; some hold one board twice."""
    s = shots(t)
    page = F.expr("(vec_id div 4) * 6")
    rows = s.select((page + F.col("id") % 6).alias("id"), "code").unionByName(s.where("id % 6 = 0 AND vec_id % 10 = 0").select(page.alias("id"), "code"))
    held = rows.where("id % 7 <> 5").groupBy("id").agg(F.collect_list("code").alias("codes"))
    return held.select("id", F.lit("s").alias("source"), split_of(F.col("id")).alias("split"), "codes")


def board_rulings(t: Tables) -> DataFrame:
    p = t.embeddings.select(F.expr("vec_id div 4").alias("p")).distinct().where("p % 2 = 0")
    return p.select((F.col("p") * 6).alias("a"), (F.col("p") * 6 + 1).alias("b"), F.when(F.col("p") % 4 == 0, "duplicate").otherwise("distinct").alias("decision"))


@query("""SELECT l AS "left", r AS "right", any_value(distance) AS distance, split_left, split_right, count(*) AS pairs, count(*) FILTER (WHERE decision = 'duplicate') AS duplicates,
  count(*) FILTER (WHERE decision = 'distinct') AS distincts, count(*) FILTER (WHERE decision IS NULL) AS unresolved FROM boards64 GROUP BY l, r, split_left, split_right""", "boards64")
def board_gate(t: Tables) -> DataFrame:
    """Pairs of near boards of different pages, by split, with what was decided about their pages."""
    return N.gate(board_pages(t), board_rulings(t)).drop("a", "b")


@query("""SELECT count(*) FILTER (WHERE decision IS NULL AND split_left = split_right) AS same_split_candidates,
  count(*) FILTER (WHERE decision IS NULL AND split_left <> split_right) AS cross_split_blockers FROM boards64""", "boards64")
def board_status(t: Tables) -> DataFrame:
    return N.status(N.gate(board_pages(t), board_rulings(t)))


@query("SELECT DISTINCT b AS id FROM boards64 WHERE decision = 'duplicate'", "boards64")
def board_dropped(t: Tables) -> DataFrame:
    return N.near_dropped(board_pages(t), board_rulings(t))


# --- generations ------------------------------------------------------------

view("second64", """SELECT id, CASE WHEN id % 10 = 0 THEN xor(code, 3) ELSE code END AS code FROM {shot64} WHERE id % 17 <> 0 AND id % 6 < 3
  UNION ALL SELECT id, code FROM {shot64} WHERE id % 17 <> 0 AND id % 6 >= 3""")


@query("""SELECT p.code AS "left", q.code AS "right", CAST(bit_count(xor(p.code, q.code)) AS INT) AS distance, p.n AS pages_left, q.n AS pages_right
  FROM (SELECT code, count(*) AS n FROM second64 GROUP BY 1) p JOIN (SELECT code, count(*) AS n FROM second64 GROUP BY 1) q
  ON p.code < q.code AND bit_count(xor(p.code, q.code)) <= 4""", "second64")
def near_generations(t: Tables) -> DataFrame:
    """Near codes after two generations: a first load, then changed, removed and new pages."""
    rows = shots(t).select(F.col("id").alias("page"), "code")
    index = NearIndex(t.spark, shared_path(t.spark, "near-index"), t.embeddings.count() * 2, parts=16)
    index.update(rows.where("page % 6 < 3").withColumn("revision", F.lit(0).cast("long")), 1)
    changed = rows.where("page % 6 < 3 AND (page % 10 = 0 OR page % 17 = 0)").select(
        "page", F.lit(1).cast("long").alias("revision"), F.when(F.col("page") % 17 != 0, F.col("code").bitwiseXOR(F.lit(3).cast("long"))).alias("code"))
    added = rows.where("page % 6 >= 3 AND page % 17 <> 0").select("page", F.lit(0).cast("long").alias("revision"), "code")
    index.update(changed.unionByName(added), 2)
    return index.pairs()


@query("""SELECT p.id, p.split, count(*) AS open_pairs FROM act p JOIN smp s ON s.id = p.id JOIN smp z ON z.sha = s.sha JOIN act q ON q.id = z.id AND q.split <> p.split
  WHERE NOT EXISTS (SELECT 1 FROM said d WHERE d.decision = 'duplicate' AND ((d.a = p.id AND d.b = q.id) OR (d.a = q.id AND d.b = p.id))) GROUP BY 1, 2""", "act", "smp", "said")
def open_pair_pages(t: Tables) -> DataFrame:
    """Pages that may be shown for a decision: equal to an active page of another split, and nobody decided."""
    return open_equal_pages(active(t), "sha", decisions(t))


@query("""SELECT id, split, count(*) AS open_pairs FROM (SELECT unnest([a, b]) AS id FROM pair64 WHERE decision IS NULL AND split_left <> split_right) JOIN near64 USING (id) GROUP BY 1, 2""",
       "pair64", "near64")
def near_open_pages(t: Tables) -> DataFrame:
    return open_near_pages(near_pages(t), near_rulings(t))
