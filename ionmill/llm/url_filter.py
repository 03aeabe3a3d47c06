"""Operator 3: URL rules with redirect equivalence, DataFrame functions only.

A URL's own rule is the longest that fits. URLs that redirect or canonical-link to each other, in any number of steps, are
aliases: connected components over these links carry a block to every member that has no rule of its own. An explicit
rule on the URL itself, allow above all, outranks what its aliases say; without either, a URL is allowed. Links' targets are judged by
the rules too, whether or not they are pages.

Links come from `<link rel=canonical href>` and `<meta http-equiv=refresh content="..url=">` in the html, and from an edge
table (source, target) of observed redirects if given. URLs are the same node when host, path (empty is /) and query agree;
scheme and fragment do not count.

Rows: one per input row. Null url, or none with `://`: host and path are empty, rule null, verdict allow. Null html has no links.
Repeated rows repeat their verdict. An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components

#: Rules up to this number become one expression; longer lists are joined on host suffixes.
INLINE_RULES = 200
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The alias key of an absolute URL, null for others."""
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://") & (host_of(url) != ""), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def inline_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (size, allow, rule, verdict) of the longest fitting rule, or null. Equal length: allow first."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,verdict:string>")


def with_rule(df: DataFrame, rules: Sequence[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``own``, the struct of inline_rule, for any number of rules."""
    if len(rules) <= INLINE_RULES:
        return df.withColumn("own", inline_rule(F.col(host), F.col(path), rules))
    spark = df.sparkSession
    listed = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    parts = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = df.select(host, path).distinct()
    fits = urls.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").where(F.col(path).startswith(F.col("rule_path")))
    best = fits.groupBy(host, path).agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), (F.col("verdict") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))).alias("own"))
    return df.join(best, [host, path], "left")


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments carried out; a path that ends in one names a folder."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.contains("/."), F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))).otherwise(path)


def html_links(pages: DataFrame) -> DataFrame:
    """(source, target) URLs of canonical and refresh links."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: F.lower(t).rlike(r"(?s)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b|http-equiv\s*=\s*[\"']?\s*refresh"))
    hinted = F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv")
    tag = pages.where("url is not null").where(hinted).select(F.col("url").alias("source"), F.explode(tags).alias("tag"))
    href = F.when(
        F.lower("tag").startswith("<link"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    ).otherwise(F.regexp_extract("tag", r"(?is)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    to = tag.select("source", F.regexp_replace(href, "&amp;", "&").alias("to")).where("to <> ''")
    base, source = F.concat(F.lit("http://"), host_of(F.col("source"))), path_of(F.col("source"))
    folder = F.when(source == "", "/").otherwise(F.regexp_replace(source, "[^/]*$", ""))
    tail = F.regexp_extract("to", r"(?s)^[^?#]*(.*)$", 1)
    target = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to")))
        .when(F.col("to").startswith("#"), F.col("source"))
        .when(F.col("to").startswith("?"), F.concat(base, F.when(source == "", "/").otherwise(source), F.col("to")))
        .otherwise(F.concat(base, without_dots(F.concat(F.when(F.col("to").startswith("/"), "").otherwise(folder), F.regexp_extract("to", r"(?s)^([^?#]*)", 1))), tail))
    )
    return to.select("source", target.alias("target"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component (the alias group's least URL; null for a URL without links)."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = with_rule(rows, rules)
    links = html_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = common.materialize(links.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")).where("u <> v").distinct(), "links")
    own = [F.col("page_id"), F.col("host"), F.col("path"), F.col("own.rule").alias("rule")]
    if edges.isEmpty():
        return rows.select(*own, F.coalesce("own.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    found = components.connected_components(edges)
    judged = with_rule(found.withColumn("host", host_of(F.concat(F.lit("x://"), "node"))).withColumn("path", path_of(F.concat(F.lit("x://"), "node"))), rules)
    blocked = judged.groupBy("component").agg(F.max((F.col("own.verdict") == "block").cast("int")).alias("blocked"))
    alias = found.join(blocked, "component")
    carried = F.when(F.col("blocked") == 1, "block").otherwise("allow")
    return rows.join(alias, "node", "left").select(*own, F.coalesce("own.verdict", carried).alias("verdict"), "component")
