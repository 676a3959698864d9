"""The registered queries of the training-data operators: thin applications to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm import bpe, html_extract, language, lattice, neardup, packing, pii, secret_scan, simhash, url_filter
from crosstide.llm._common import table

#: The url rules of the contract (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def vocabulary(name: str) -> str:
    """A public tokenizer's file; where the files lie is that package's matter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("literal"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_and_edit(table(spark, sf_dir, "documents"), query_every=50)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=(85, 100))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.anonymise(table(spark, sf_dir, "documents"), pii.DEMONSTRATION_KEY)
    spans = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string")))
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(spans, ",").alias("spans"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), with_decoded=True)
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    learned = language.learn(documents, ~held_out)
    return language.identify(documents, learned).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


OP8_SQL = """
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
raw AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM raw),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, v, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC) AS k
  FROM parts p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""

OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.y, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS k FROM link GROUP BY x)
SELECT v.vec_id, coalesce(g.k, 0) AS n_links, least(v.vec_id, coalesce(r.y, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(r.y, v.vec_id)) AS kept
FROM v LEFT JOIN least_id r ON r.x = v.vec_id LEFT JOIN degree g ON g.x = v.vec_id
"""

QUERIES = {
    "op1_packing": op1_packing, "op2_secret_scan": op2_secret_scan, "op3_simhash": op3_simhash,
    "op4_near_duplicates": op4_near_duplicates, "op5_html": op5_html, "op6_pii": op6_pii, "op7_bpe": op7_bpe,
    "op8_url_filter": op8_url_filter, "op9_language": op9_language, "op10_lattice": op10_lattice,
}
ORACLES = {"op4_near_duplicates": OP4_SQL, "op8_url_filter": OP8_SQL, "op10_lattice": OP10_SQL}
