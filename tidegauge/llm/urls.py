"""URL filter: block and allow rules on hosts with their subdomains and on path prefixes.

Method: every url is expanded into (host suffix, path prefix) expressions; these meet the rules in an equi-join on a
short prefix of their SHA-256, a number, and nothing else. Where short prefixes meet, the full digests are compared
afterwards; of the rules confirmed the longest wins. Suffixes and prefixes are
made only in the label counts and lengths that occur among the rules, so very long urls expand no further than the
longest rule.

Defined cases: a null url, or one without "://", has an empty host and path; rules with a null host, path or action fit
nothing; of several actions for one rule block wins; of two fitting rules of equal length the longer host wins; repeated
rows give one row each; null ids are kept; columns other than the id and the url are not read; empty tables, of pages or
of rules, are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hexadecimal digits of the digest in the join key, 15 at most


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return (F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def digested(text: Column, short: int) -> Column:
    """short: the first digits of the SHA-256 as a number; digest: all of it as bytes."""
    made = F.transform(F.array(F.sha2(text, 256)), lambda d: F.struct(
        F.conv(F.substring(d, 1, short), 16, 10).cast("long").alias("short"), F.unhex(d).alias("digest")))
    return made[0]


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", short: int = SHORT) -> DataFrame:
    """key, host, path, rule, verdict of every row of pages.

    rules: host, path, action ("block" or "allow"). A rule fits its host and all subdomains if the path starts with the
    rule's path. verdict is `default` where no rule fits.
    """
    rules = (rules.filter("host is not null and path is not null and action is not null")
             .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "action")
             .groupBy("r_host", "r_path").agg(F.max(F.when(F.col("action") == "block", "block").otherwise("allow")).alias("action"))
             .select(F.concat("r_host", "r_path").alias("rule"), F.char_length("r_host").alias("host_len"), "action",
                     F.size(F.split("r_host", r"\.", -1)).alias("labels"), F.char_length("r_path").alias("path_len"),
                     digested(F.concat_ws("\n", "r_host", "r_path"), short).alias("r")))
    # Shapes are small integers, as many as the longest rule has labels and characters at most.
    shapes = rules.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_len")).alias("lens")).first()
    host, path = url_parts(F.col("_url"))
    base = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url")).select("_id", host.alias("_host"), path.alias("_path"))
    labels = F.split("_host", r"\.", -1)
    suffixes = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in shapes["labels"]]))
    prefixes = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(F.char_length("_path") >= n, F.substring("_path", 1, n)) for n in shapes["lens"]]))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digested(F.concat_ws("\n", h, p), short))))
    # The first element, whose number no digest has, keeps rows without an expression and counts repeated rows.
    nothing = F.array(F.struct(F.lit(-1).cast("long").alias("short"), F.lit(None).cast("binary").alias("digest")))
    tries = base.select("*", F.posexplode(F.concat(nothing, digests)).alias("_nr", "_try")).select("_id", "_host", "_path", "_nr", "_try.*")
    met = tries.join(rules.select("*", F.col("r.short").alias("r_short"), F.col("r.digest").alias("r_digest")), F.col("short") == F.col("r_short"), "left")
    # One short prefix may stand for several rules: a row then comes once for each.
    met = met.select("*", (F.col("digest") == F.col("r_digest")).alias("confirmed"))
    best = F.max(F.when(F.col("confirmed"), F.struct(
        (F.col("host_len") + F.col("path_len")).alias("len"), "host_len", "rule", "action"))).alias("best")
    one = met.groupBy("_id", "_host", "_path").agg(best, F.count_if(F.col("_nr") == 0).alias("copies"))
    return one.select(F.col("_id").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.rule").alias("rule"),
                      F.coalesce("best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
