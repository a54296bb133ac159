"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into the (host suffix, path prefix) expressions that a
rule could name, the expressions meet the rules in an equi-join on a short
prefix of their SHA-256 digest, and a hit counts only if the full digest is
the same. The longest rule that fits decides.

Only lengths that occur among the rules are expanded: a rule with three host
labels can only equal a host suffix of three labels, a rule path of four
characters only a prefix of four. The expansion is therefore bounded by the
shapes of the rules, not by the length of a hostile URL, and misses nothing.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path and no rule; so has any URL when the rule table is empty. Repeated
page rows are kept. Rules with the same text and opposite verdicts: block
wins. Rules of the same length that both fit: the one with the longer host
wins. Columns of the input other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX = 8  # hex digits of the digest that the equi-join uses


def ascii_lower(c: Column) -> Column:
    """A-Z only; ``lower`` would also fold letters outside ASCII."""
    return F.translate(c, UPPER, UPPER.lower())


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as a frame verdict, host, path."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("verdict", "host", "path")))
    rows = F.array(
        *(
            F.struct(F.lit(v).alias("verdict"), F.lit(host.lower()).alias("host"), F.lit(slash + path).alias("path"))
            for v, (host, slash, path) in ((v, text.partition("/")) for v, text in rules)
        )
    )
    return spark.range(1).select(F.inline(rows))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))


def _prepared(rules: DataFrame) -> DataFrame:
    """One row for each rule text, with its digest and its prefix."""
    one = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).where("rule_host <> '' and rule_verdict is not null")
    one = one.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block > allow
    return one.withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)).withColumn(
        "prefix", F.substring("rule_digest", 1, PREFIX_HEX)
    )


def apply_rules(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """``key``, host, path, rule and verdict of every row of ``pages``.

    Distinct (host, path) pairs are expanded, not rows, so a URL that fills a
    third of the table is expanded once; the verdicts return to the rows in
    one join, whose row side adaptive execution may split.
    """
    rules = _prepared(rules)
    shapes = rules.groupBy().agg(
        F.collect_set(_labels(F.col("rule_host"))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    )
    rows = pages.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    spread = (
        urls.withColumn("dots", F.explode(shapes.select("labels").scalar()))
        .where(F.col("dots") <= _labels(F.col("host")))
        .withColumn("cut", F.explode(shapes.select("lengths").scalar()))
        .where(F.col("cut") <= F.length("path"))
        .select(
            "host",
            "path",
            F.expr("substring_index(host, '.', -(dots + 1))").alias("suffix"),
            F.expr("substring(path, 1, cut)").alias("start"),
        )
        .withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "start"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    hits = spread.join(rules, "prefix").where("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("n"),
                F.length("rule_host").alias("h"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        key,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
