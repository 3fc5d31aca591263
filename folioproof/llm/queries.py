"""The numbered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Tables
from . import decontaminate, jaccard, licenses, negatives, packing, passages, periods, quality, simhash, spots, toxicity, url_rules, warc_zip
from .labelled import fold

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(t: Tables) -> DataFrame:
    return passages.repeats(t.documents)


@query
def op2_warc(t: Tables) -> DataFrame:
    return warc_zip.round_trip(t.pages)


@query
def op3_quality(t: Tables) -> DataFrame:
    model = quality.train(t.documents, t.labels, fold("doc_id", 5) != 0)
    return quality.score(t.documents, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "difference")


#: The rules of op4.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op4_url_rules(t: Tables) -> DataFrame:
    return url_rules.judge(t.pages, URL_RULES)


SQL["op4_url_rules"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, host_rule, path_rule) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, verdict, host_rule || path_rule AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(host_rule) DESC, length(path_rule) DESC) AS k
  FROM urls, rules
  WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1
"""


@query
def op5_jaccard_join(t: Tables) -> DataFrame:
    return jaccard.linked(t.documents)


SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + least(4, len(w)) - 1], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes z USING (doc_id) GROUP BY r.doc_id
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_packing(t: Tables) -> DataFrame:
    return packing.pack(t.documents, vocabulary())


@query
def op9_decontamination(t: Tables) -> DataFrame:
    return decontaminate.mark(t.documents, t.benchmark).drop("items")


SQL["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM k),
hits AS (
  SELECT x.doc_id, x.i, x.size, k.item
  FROM (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size) x
  JOIN k ON k.size = x.size AND k.words = array_to_string(x.w[x.i:x.i + x.size - 1], ' ')),
placed AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(placed.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(placed.n, 0) > 0 AS contaminated
FROM d LEFT JOIN placed USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_toxicity(t: Tables) -> DataFrame:
    model = toxicity.train(t.documents, t.labels, fold("doc_id", 4) != 2)
    return toxicity.score(t.documents, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


@query
def op7_licenses(t: Tables) -> DataFrame:
    return licenses.scan(t.documents)


@query
def op8_spot_signatures(t: Tables) -> DataFrame:
    return spots.fingerprints(t.documents)


@query
def op11_simhash(t: Tables) -> DataFrame:
    return simhash.linked(t.documents)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id hash ends in 0 repeat a part of themselves up to their end, word by word."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    a = F.pmod("g", F.size("w"))
    p = 1 + F.floor((F.size("w") - a) / (3 + F.col("g") % 8))
    placed = chosen.withColumn("a", F.when(F.size("w") > 0, a)).withColumn("p", F.when(F.size("w") > 0, p))
    repeated = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", repeated)).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(t: Tables) -> DataFrame:
    found = periods.detect(with_periods(t.documents))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_hard_negatives(t: Tables) -> DataFrame:
    return negatives.mine(t.embeddings)


SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM a JOIN v o ON a.vec_id <> o.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
