"""URL filters: rules on hosts and paths, sifted by a blocked Bloom filter.

A rule lists a host and the beginning of a path; it fits its host, all
subdomains and every path that starts so. A url is cut into the canonical forms
that rules can have, one per shape (number of host labels, length of path) among
the rules. A blocked Bloom filter of the listed forms passes possible hits: each
form belongs to one block of eight 64-bit words and sets one bit in each. What
passes goes to an exact join with the rules, so false positives cost time only.
Of the rules that fit, the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

WORDS = 8
BITS_PER_RULE = 16
MOST_BLOCKS = 1 << 19  # 32 MB of bits; a longer list makes the filter pass more, never less
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("rule_host", "rule_path"), F.lit(blocks)).cast("int")


def _places() -> list[Column]:
    """The bit that a form sets in each word of its block."""
    bits = F.xxhash64(F.lit("bits"), "rule_path", "rule_host")
    return [F.shiftrightunsigned(bits, 6 * w).bitwiseAND(F.lit(63)).cast("int") for w in range(WORDS)]


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w7 of the listed rule_host, rule_path; at most `blocks` rows."""
    one = F.lit(1).cast("long")
    marked = rules.select(
        _block(blocks).alias("block"), *[F.call_function("shiftleft", one, p).alias(f"w{w}") for w, p in enumerate(_places())]
    )
    return marked.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def possible(forms: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """The forms (rule_host, rule_path) that the filter of the rules passes."""
    all_set = F.lit(True)
    for w, place in enumerate(_places()):
        all_set = all_set & (F.getbit(f"w{w}", place) == 1)
    columns = forms.columns
    sifted = forms.withColumn("block", _block(blocks)).join(F.broadcast(bloom_blocks(rules, blocks)), "block")
    return sifted.where(all_set).select(*columns)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """rule_host, rule_path, rule_verdict, each host and path once; block wins where both are listed."""
    return (
        rules.select(
            lower_ascii(F.coalesce(F.col("host"), F.lit(""))).alias("rule_host"),
            F.coalesce(F.col("path"), F.lit("")).alias("rule_path"),
            F.when(F.col("verdict") == "allow", "allow").otherwise("block").alias("rule_verdict"),
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
    )


def forms_of(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path with every rule_host, rule_path that a rule fitting them could have."""
    shape = F.struct(labels_of(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("length"))
    shapes = rules.agg(F.collect_set(shape).alias("shapes")).scalar()
    labels, length = labels_of(F.col("host")), F.length("path")
    open_ = F.filter("shapes", lambda s: (s["labels"] <= labels) & (s["length"] <= length))
    shaped = places.withColumn("shapes", shapes)
    return shaped.select("host", "path", F.explode(open_).alias("shape")).select(
        "host",
        "path",
        F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("shape.labels")).alias("rule_host"),
        F.substring(F.col("path"), F.lit(1), F.col("shape.length")).alias("rule_path"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict of every row; action (counts the rules).

    rules: host, path, verdict (allow or block; anything else counts as block).
    The rule with most characters in host and path wins, of equal ones the one
    with the longer host. Urls that no rule fits get `default`: a url that is
    not listed passes. Null urls and urls without :// have an empty host and
    path, which only a rule without host and path fits. Repeated rows are all
    returned, rows with null id too. Other columns are not read.
    """
    listed = Scratch(pages.sparkSession, "url-rules").keep(canonical_rules(rules), "rules")
    blocks = max(1, min(MOST_BLOCKS, -(-listed.count() * BITS_PER_RULE // (64 * WORDS))))
    url = F.col(url_col).cast("string")
    places = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hits = possible(forms_of(places, listed), listed, blocks).join(listed, ["rule_host", "rule_path"])
    weight = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
    )
    best = hits.groupBy("host", "path").agg(F.max(weight).alias("best"))
    return places.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
