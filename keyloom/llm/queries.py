"""The queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, minhash, quality, rules, secrets, sharding, sp_dropout, token_counts, token_files
from .common import small_batches, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents (2-word shingles, similarity 0.8)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document, by a model fitted on its labels."""
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to Simple-8b files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op5_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document by merge-dropout, with a digest and whether they decode to the text."""
    return sp_dropout.digests(table(spark, sf_dir, "documents"))


def op7_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in the documents, with the forest's score."""
    return secrets.findings(table(spark, sf_dir, "documents"))


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances from the language's usual text, and the verdict on every document."""
    return rules.judged(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that benchmark windows hit, and their items."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("starts", "ends")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def _with_small_batches(f):
    @functools.wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {f.__name__: _with_small_batches(f) for f in (op1_minhash_dedup, op2_html_text, op3_ordinal_quality, op4_simple8b_tokens, op5_uniform_shards, op6_merge_dropout, op7_secret_findings, op8_divergence_rules, op9_winnowing, op10_token_counts)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY doc_id),
r AS (SELECT m, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY m),
rs AS (SELECT s.doc_id AS rep, s.g, r.n FROM s JOIN r ON s.doc_id = r.rep),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM rs a JOIN rs b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
c AS (SELECT rep AS v, rep AS c FROM r UNION SELECT e.y, c.c FROM c JOIN e ON e.x = c.v),
best AS (SELECT v, min(c) AS c FROM c GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(best.c, w.doc_id) AS component_id, w.doc_id = coalesce(best.c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.m = n.m LEFT JOIN best ON best.v = r.rep
""",
    "op9_winnowing": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(8, len(ws)) AS n, array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
