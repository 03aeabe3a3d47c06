"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, exact_dedup, html_extract, jaccard_join, langid, packing, pii, token_shards, url_filter, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    parts = token_shards.write_token_shards(common.table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_shards.with_crc32(token_shards.read_token_shards(spark, path, parts)).drop("ids")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""


#: Fixed values of the query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages"), URL_RULES)


OP3_SQL = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(v, h, p)),
p AS (SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query FROM pages),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM p),
tags AS (SELECT node, host, path, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM n WHERE node IS NOT NULL),
hrefs AS (SELECT node, host, path, url, replace(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?is)url\s*=\s*["'']?\s*([^"''\s>]+)', 1) END, '&amp;', '&') AS href
    FROM tags WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b|http-equiv\s*=\s*["'']?\s*refresh')),
joined AS (SELECT *, 'http://' || host AS base, CASE WHEN starts_with(href, '/') THEN '' WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || regexp_extract(href, '(?s)^([^?#]*)', 1) AS whole FROM hrefs WHERE href <> ''),
dots AS (SELECT *, CASE WHEN contains(whole, '/.') THEN list_reduce(list_prepend([''], list_transform(string_split(whole, '/')[2:], lambda x: [x])), lambda done, x: CASE WHEN x[1] = '..' THEN done[:greatest(len(done) - 1, 1)] WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END) END AS kept FROM joined),
t AS (SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '#') THEN url WHEN starts_with(href, '?') THEN base || CASE WHEN path = '' THEN '/' ELSE path END || href
    ELSE base || CASE WHEN kept IS NULL THEN whole ELSE CASE WHEN len(kept) = 1 THEN '/' ELSE array_to_string(kept, '/') || CASE WHEN regexp_matches(whole, '/\.\.?$') THEN '/' ELSE '' END END END || regexp_extract(href, '(?s)^[^?#]*(.*)$', 1) END AS target FROM dots),
e0 AS (SELECT node AS u, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS vh,
    regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS vp, regexp_extract(target, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS vq FROM t WHERE target LIKE '%://%'),
e1 AS (SELECT DISTINCT u, vh || CASE WHEN vp = '' THEN '/' ELSE vp END || vq AS v, vh, vp FROM e0 WHERE vh <> ''),
names AS (SELECT node, host AS h, path AS q FROM n WHERE node IS NOT NULL UNION SELECT v, vh, vp FROM e1),
own AS (SELECT node, arg_max(v, length(rules.h || p)) AS verdict FROM names JOIN rules ON (names.h = rules.h OR ends_with(names.h, '.' || rules.h)) AND starts_with(q, p) GROUP BY node),
pairs AS (SELECT u, v FROM e1 WHERE u <> v UNION SELECT v, u FROM e1 WHERE u <> v),
bad(node) AS (SELECT node FROM own WHERE verdict = 'block' UNION SELECT pairs.v FROM bad JOIN pairs ON pairs.u = bad.node),
reach(node, root) AS (SELECT u, u FROM pairs UNION SELECT pairs.v, root FROM reach JOIN pairs ON pairs.u = reach.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
mine AS (SELECT page_id, arg_max(rules.h || p, length(rules.h || p)) AS rule, arg_max(v, length(rules.h || p)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM n) x JOIN rules ON (x.host = rules.h OR ends_with(x.host, '.' || rules.h)) AND starts_with(x.path, p) GROUP BY page_id)
SELECT n.page_id, n.host, n.path, mine.rule, coalesce(mine.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, comp.component
FROM n LEFT JOIN mine USING (page_id) LEFT JOIN bad ON bad.node = n.node LEFT JOIN comp ON comp.node = n.node
"""


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"), html_extract.fit())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(common.table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write_archives(common.table(spark, sf_dir, "pages"), path)
    rows = warc.assemble(warc.read_records(spark, path, with_payload=False))
    return rows.select("page_id", F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in pii.BASE]
    base = F.filter(found, lambda s: s["kind"].isin(*pii.BASE))
    return pii.detect(common.table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join(found).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_html_text": op4_html_text,
    "op5_language": op5_language,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
}
