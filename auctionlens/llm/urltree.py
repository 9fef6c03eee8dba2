"""Operator 7: URL filters by a path-template tree.

A url's rule is the longest rule whose host is the url's or a parent domain
of it and whose path starts the url's path. Urls with a rule are labelled by
it; the rest is judged by a tree of path templates per host:

* segments that are numbers, numbered files, dates or hexadecimal ids become
  wildcards of their kind at once; urls are then counted by host and
  template, so all later steps work on templates, not on urls;
* level by level a branch stays on its own only if its share of blocked urls
  differs significantly from its siblings' (two-proportion test, ``Z``);
  statistically similar branches, and branches without labels, merge into
  one wildcard branch;
* a node's purity is its blocked share, smoothed towards its parent's with
  the weight of ``SMOOTH`` urls, the host's towards that of all labelled
  urls; a template is rejected where the purity is at least ``BLOCK_AT``.

Levels go down to the deepest labelled path; below it no branch holds a label,
so all merge and purities stay. Siblings are summed by partial aggregation and joined back, with no
window over a hot host; verdicts meet the urls by a salted join.

Defined cases: a null url, or one without ``://``, has empty host and path
and the verdict of its template; every input row gives one output row;
without labelled urls nothing is rejected; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
Z = 1.96
SMOOTH = 5.0
BLOCK_AT = 0.8
SALTS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. Of
    rules of one length the longer host goes first, then block."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    rule = F.coalesce(*[F.when(c, F.lit(h + p)) for c, (_, h, p) in zip(fits, order, strict=True)]) if order else F.lit(None).cast("string")
    verdict = F.coalesce(*[F.when(c, F.lit(v)) for c, (v, _, _) in zip(fits, order, strict=True)]) if order else F.lit(None).cast("string")
    return rule, verdict


def template(path: Column) -> Column:
    """The path's segments with variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: (
        F.when(s.rlike(r"^\d+$"), F.lit("{n}"))
        .when(s.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.lit("{date}"))
        .when(s.rlike(r"^\d+\.[A-Za-z]+$"), F.regexp_replace(s, r"^\d+", "{n}"))
        .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{id}"))
        .otherwise(s)
    )
    return F.transform(parts, kind)


def _differs(block, labelled, all_block, all_labelled) -> Column:
    """Whether a branch's blocked share differs from its siblings'."""
    rest_n, rest_b = all_labelled - labelled, all_block - block
    pooled = all_block / all_labelled
    se = F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / rest_n))
    gap = F.abs(block / labelled - rest_b / rest_n)
    return F.when((labelled > 0) & (rest_n > 0) & (se > 0), gap > Z * se).otherwise(F.lit(False))


def purities(templates: DataFrame) -> DataFrame:
    """(host, segs, n, labelled, block) to (host, segs, node, purity)."""
    templates = stored(templates, "urltree-templates")
    top = templates.agg(F.sum("block").alias("b"), F.sum("labelled").alias("l"), F.max(F.when(F.col("labelled") > 0, F.size("segs"))).alias("d")).first()
    prior = (top["b"] + 1.0) / (top["l"] + 2.0) if top["l"] else 0.0
    host = templates.groupBy("host").agg(((F.sum("block") + SMOOTH * prior) / (F.sum("labelled") + SMOOTH)).alias("purity"))
    t = templates.join(host, "host").withColumn("node", F.lit(""))
    deepest = top["d"] or 0
    for level in range(1, deepest + 1):
        own = F.element_at("segs", level) if level == 1 else F.try_element_at("segs", F.lit(level))
        t = t.withColumn("seg", F.when(F.size("segs") >= level, own))
        sums = [F.sum("block").alias("cb"), F.sum("labelled").alias("cl")]
        child = t.filter("seg is not null").groupBy("host", "node", "seg").agg(*sums)
        parent = child.groupBy("host", "node").agg(F.sum("cb").alias("pb"), F.sum("cl").alias("pl"))
        alone = child.join(parent, ["host", "node"]).filter(_differs(F.col("cb"), F.col("cl"), F.col("pb"), F.col("pl"))).select("host", "node", "seg", F.lit(True).alias("own"))
        t = t.join(alone, ["host", "node", "seg"], "left")
        step = F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(F.lit("{*}"))))
        t = t.withColumn("next", step)
        inner = t.filter("seg is not null").groupBy("host", "next").agg(((F.sum("block") + SMOOTH * F.first("purity")) / (F.sum("labelled") + SMOOTH)).alias("deeper"))
        t = t.join(inner, ["host", "next"], "left").withColumn("purity", F.when(F.col("seg").isNotNull(), F.col("deeper")).otherwise(F.col("purity")))
        t = stored(t.select("host", "segs", "n", "labelled", "block", "purity", F.col("next").alias("node")), "urltree-level")
    below = F.greatest(F.size("segs") - F.lit(deepest), F.lit(0))
    t = t.withColumn("node", F.concat("node", F.repeat(F.lit("/{*}"), below)))
    return t.select("host", "segs", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("node"), "purity")


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template and its purity."""
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), template(F.col("path")).alias("segs"))
    counts = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("block"))
    judged = purities(counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    method = F.when(F.col("purity") >= BLOCK_AT, "block").otherwise("allow")
    return rows.join(judged, ["host", "segs", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("node").alias("template"), "purity")


def op7(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
