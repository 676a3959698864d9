"""URL rules by hashed host-suffix and path-prefix expressions (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the equi-join uses, as an integer: 4 bytes.
PREFIX_DIGITS = 8


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    cut = lambda c, marks: cut(F.substring_index(c, marks[0], 1), marks[1:]) if marks else c
    host = cut(rest, "/?#")
    path = cut(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")
    return ascii_lower(host), path


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_DIGITS), 16, 10).cast("long")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> one row per rule with its digest, digest prefix and precedence.

    Precedence: the longer host + path, then the longer path, then block before
    allow. Rules with a null part are ignored; repeated rules count once.
    """
    r = rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).dropna()
    r = r.groupBy("h", "p").agg(F.max((F.col("v") == "block").cast("long")).alias("block"))
    digest = _digest(F.concat("h", "p"))
    size = (F.length("h") + F.length("p")).cast("long")
    return r.select(
        "h", "p", digest.alias("rule_digest"), _prefix(digest).alias("rule_prefix"),
        (F.shiftleft(size, 32) + F.length("p").cast("long") * 2 + F.col("block")).alias("precedence"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    Each url is expanded into the host suffixes and path prefixes of the shapes
    (labels, path length) that occur among the rules, at most one expression per
    shape; these meet the rules by a short prefix of their digest, and the full
    digest confirms. The number of shapes is bounded by what a url can look
    like, not by the number of rules. Whether the rules are broadcast is left to
    Catalyst's size check; beyond it the join shuffles on the digest prefix and
    adaptive execution splits prefixes that many urls share.

    Null urls have empty host and path and get the default verdict with a null
    rule; repeated rows stay repeated; other columns of pages are not returned.
    """
    prepared = prepare_rules(rules)
    shapes = prepared.select(_labels(F.col("h")).alias("k"), F.length("p").alias("n")).groupBy("k").agg(F.sort_array(F.collect_set("n")).alias("n")).orderBy("k").collect()
    host, path = split_url(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path")).withColumn("_row", F.monotonically_increasing_id())
    if not shapes:
        return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    def expressions(k: int, sizes: list[int]) -> Column:
        suffix = F.substring_index("_host", ".", -k)
        fitting = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: (F.length("_path") >= n) & (_labels(F.col("_host")) >= k))
        return F.transform(fitting, lambda n: F.concat(suffix, F.col("_path").substr(F.lit(1), n)))

    per_host = [expressions(s["k"], s["n"]) for s in shapes]
    expanded = rows.withColumn("_e", F.explode_outer(F.concat(*per_host))).withColumn("_d", _digest(F.col("_e")))
    keys = prepared.select("rule_digest", "rule_prefix", "precedence")
    # The digests are compared after the join, which has the prefix as its only key: rules that share a prefix all meet the url.
    met = expanded.withColumn("_p", _prefix(F.col("_d"))).join(keys, F.col("_p") == F.col("rule_prefix"), "left")
    confirmed = F.when(F.col("_d") == F.col("rule_digest"), F.col("precedence"))
    best = met.groupBy("_row", "_id", "_host", "_path").agg(F.max(confirmed).alias("_best"))
    size, path_size = F.shiftright("_best", 32), F.shiftright(F.col("_best").bitwiseAND((1 << 32) - 1), 1)
    rule = F.concat(F.col("_host").substr(F.length("_host") - (size - path_size) + 1, F.length("_host")), F.col("_path").substr(F.lit(1), path_size.cast("int")))
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best").bitwiseAND(1) == 1, F.lit("block")).otherwise(F.lit("allow"))
    return best.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.when(F.col("_best").isNotNull(), rule).alias("rule"), verdict.alias("verdict"))
