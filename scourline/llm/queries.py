"""The registered query of each operator, over its whole table, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scourline.llm import bpe, decontam, density, langid, licenses, merkle, orderminhash, secrets, simhash, toxicity
from scourline.plans.scratch import folder, keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    found = simhash.components(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexed(found.fp).alias("fingerprint"), "component_id")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontam.covered()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE_SQL["op10_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS n FROM g),
p AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT p.r, p.n, p.i, g.item FROM p JOIN g ON p.gram = g.gram),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans for every document.

    Two runs over one ledger: the first knows the history's first source only, the second all documents, of which it scans
    what the first has not seen.
    """
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{folder(spark)}/scourline-ledger-{uuid4().hex}")
    ledger.update(docs.where(docs.source == docs.agg(F.min("source")).first()[0]))
    found = keep(secrets.findings(ledger.update(docs)), "findings")
    kinds = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    found = found.select("blob", "spans", F.expr(f"filter(spans, s -> s.kind in ({kinds}))").alias("base"))
    every = secrets.paths_with_findings(docs, ["doc_id"], found)
    counts = [F.expr(f"size(filter(coalesce(base, array()), s -> s.kind = '{r.kind}'))").cast("bigint").alias(f"n_{r.kind}") for r in secrets.BASE]
    return every.select("doc_id", *counts, F.sha2(secrets.joined_spans("base"), 256).alias("base_sha256"), secrets.joined_spans("spans").alias("spans"))


def _spans_sql(nth: int, rule: secrets.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT r, {nth} AS nth, '{rule.kind}' AS kind, starts AS s, starts + len(m[i]) AS e
  FROM (SELECT r, m, g, i, list_sum(list_transform(list_slice(p, 1, i), lambda x: len(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: len(x))), 0) AS starts
        FROM (SELECT r, m, g, p, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d)))
  WHERE len(g[i]) >= {rule.least}"""


ORACLE_SQL["op5_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))}),
o AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ',' ORDER BY s, nth) FILTER (nth < {len(secrets.BASE)}) AS base,
         string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ',' ORDER BY s, nth) AS spans
  FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
"""


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    learn = toxicity.bucket(F.col("id"), 3) != 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=learn)
    held_out = F.coalesce(toxicity.bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs.where(fold != 2))
    held_out = F.coalesce(fold == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses."""
    return orderminhash.with_following(table(spark, sf_dir, "documents"))


@query
def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return density.main_text(table(spark, sf_dir, "pages"))


def _warc(pages: DataFrame, rotten: bool) -> DataFrame:
    """The pages as records of WARC files of a thousand page ids each; in the rotten replica some have a wrong byte."""
    block = merkle.record_block(F.col("url"), F.col("html"))
    if rotten:
        n = F.length(block)
        wrong = F.concat(F.substring(block, 1, n - 5), F.lit("#"), F.substring(block, n - 3, F.lit(4)))
        block = F.when(F.col("page_id") % 97 == 13, wrong).otherwise(block)
    file = F.concat(F.lit("warc-"), F.floor(F.col("page_id") / 1000).cast("string"))
    return merkle.records(pages, file, F.col("page_id"), block)


@query
def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in which a replica of the pages' archive, with a wrong byte in every page of 97, differs."""
    pages = table(spark, sf_dir, "pages")
    return merkle.audit(_warc(pages, False), _warc(pages, True)).withColumnRenamed("file", "warc_file")


ORACLE_SQL["op4_merkle_audit"] = r"""
WITH p AS (
  SELECT page_id, 'warc-' || CAST(page_id // 1000 AS VARCHAR) AS f, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages),
r AS (
  SELECT page_id, f, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
         || 'WARC-Payload-Digest: sha256:' || sha256(h) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(h) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS block
  FROM p),
s AS (
  SELECT page_id, f, block AS x,
         CASE WHEN page_id % 97 = 13 THEN substr(block, 1, length(block) - 5) || '#' || substr(block, length(block) - 3, 4) ELSE block END AS y
  FROM r),
a AS (SELECT f, page_id, row_number() OVER w - 1 AS nth, sum(strlen(x)) OVER w AS stop, strlen(x) AS size, sha256(x) AS d FROM s WINDOW w AS (PARTITION BY f ORDER BY page_id, sha256(x) ROWS UNBOUNDED PRECEDING)),
b AS (SELECT f, page_id, row_number() OVER w - 1 AS nth, sum(strlen(y)) OVER w AS stop, strlen(y) AS size, sha256(y) AS d FROM s WINDOW w AS (PARTITION BY f ORDER BY page_id, sha256(y) ROWS UNBOUNDED PRECEDING))
SELECT a.f AS warc_file, CAST(a.nth AS BIGINT) AS nth, a.page_id AS key_a, b.page_id AS key_b, CAST(a.stop - a.size AS BIGINT) AS start_a, CAST(a.stop AS BIGINT) AS end_a,
       CAST(b.stop - b.size AS BIGINT) AS start_b, CAST(b.stop AS BIGINT) AS end_b, 'changed' AS fault
FROM a JOIN b ON a.f = b.f AND a.nth = b.nth
WHERE a.d <> b.d OR a.stop <> b.stop OR a.size <> b.size
"""


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_paragraphs, n_licence, families, score, unknown, matches for every document."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))
