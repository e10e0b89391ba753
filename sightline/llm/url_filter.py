"""URL filters: rules on hosts and paths, and a list of canonical URLs, behind a blocked Bloom filter.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower
case; its path goes on from there to ``?``, ``#`` or the end. A rule (host, path, verdict) fits its host and all
subdomains where the url's path starts with the rule's; of several the longest wins (host and path
together; of equally long ones the one that blocks). A url that no rule fits is blocked where
its canonical form is listed, and allowed elsewhere. The canonical form has neither scheme, query nor fragment, no leading
``www.`` and no slashes at the end.

Rules and listed urls are the entries of one blocked Bloom filter: an entry's hash names a block of
eight words and sets a bit in each. A url is looked up by its canonical form and by the parts of its host and path that are as
long as some rule's (``shapes``). What the filter passes is only possible, so it goes on to an exact hash join with
the entries, which removes false positives. The filter has at most ``BLOCKS`` blocks (16 MB); for longer lists
more false positives reach the join, and the result is the same.

A list that is small by rows and bytes is broadcast. Beyond, the join shuffles, but for keys with over a thousandth of all
hits: there are less than a thousand of them, so their entries are broadcast at any size (``common.joined``).

All of this is built-in DataFrame functions.

Defined results: a null url and one without ``://`` have an empty host and path (which a rule of an empty host
and path would fit); rules with nulls and listed nulls are ignored, repeated ones count once; an empty list or no rules
at all leave the other one to decide; repeated rows are judged each on their own; null page_ids are passed on; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined

#: Blocks of a filter, 64 bytes each, and bits in it for each entry.
BLOCKS, BITS = 1 << 18, 12
LANES = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    return F.regexp_replace(host, r"^www\.", ""), F.rtrim(path, F.lit("/"))


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """kind (rule or url), host, path, verdict: each once."""
    host, path = canonical(*parts(F.col("url")))
    exact = listed.filter("url is not null").select(F.lit("url").alias("kind"), host.alias("host"), path.alias("path"), F.lit("block").alias("verdict")).filter("host != ''")
    own = rules.select(F.lit("rule").alias("kind"), F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host is not null and path is not null and verdict is not null")
    return own.union(exact).groupBy("kind", "host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow


def _bit(hash: Column, lane: int) -> Column:
    return F.shiftrightunsigned(hash, 6 * lane).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: ``words``, an array of eight longs for each block. ``keys`` has hash and bits (two hashes of an entry)."""
    masks = [F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("bits"), k)).alias(f"w{k}") for k in range(LANES)]
    words = [f"w{k}" for k in range(LANES)]
    filled = keys.select(F.pmod("hash", F.lit(blocks)).alias("block"), *masks).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words))
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("block")).join(filled, "block", "left")
    sorted_blocks = F.sort_array(F.collect_list(F.struct("block", F.array(*(F.coalesce(w, F.lit(0).cast("bigint")) for w in words)).alias("w"))))
    return every.agg(F.flatten(F.transform(sorted_blocks, lambda b: b["w"])).alias("words"))


def possible(words: Column, blocks: int, hash: Column, bits: Column) -> Column:
    """Whether the filter passes an entry of these two hashes."""
    first = F.pmod(hash, F.lit(blocks)) * LANES
    hit = lambda k: F.call_function("shiftright", F.get(words, (first + k).cast("int")), _bit(bits, k)).bitwiseAND(F.lit(1)) == 1
    out = hit(0)
    for k in range(1, LANES):
        out = out & hit(k)
    return out


def hashes(kind: Column, host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(kind, host, path), F.xxhash64(path, host, kind)


def _candidates(shapes: Column) -> Column:
    """array<struct<kind, host_key, path_key>> of what a page could be listed as: its canonical form, and what rules of each shape would be."""
    fits = F.filter(shapes, lambda s: (s["labels"] <= labels_of(F.col("host"))) & (s["length"] <= F.length("path")))
    own = lambda kind, host, path: F.struct(F.lit(kind).alias("kind"), host.alias("host_key"), path.alias("path_key"))
    rules = F.transform(fits, lambda s: own("rule", F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), 1, s["length"])))
    return F.concat(F.array(own("url", *canonical(F.col("host"), F.col("path")))), rules)


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule (host and path of the one that decides, else null), verdict, is_listed.

    ``rules`` has host, path, verdict (allow or block); ``listed`` has url.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    known = scratch.keep(entries(rules, listed))
    blocks = 1
    while blocks < BLOCKS and blocks * 64 * LANES < known.count() * BITS:
        blocks *= 2
    hash, bits = hashes(F.col("kind"), F.col("host"), F.col("path"))
    words = scratch.keep(bloom_filter(known.select(hash.alias("hash"), bits.alias("bits")), blocks)).scalar()
    shapes = known.filter("kind = 'rule'").agg(F.collect_set(F.struct(labels_of(F.col("host")).alias("labels"), F.length("path").alias("length"))).alias("shapes")).scalar()
    host, path = parts(F.col("url"))
    # Rows are numbered once, in a table, since numbers that are made again might differ.
    rows = scratch.keep(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")))
    each = rows.withColumn("shapes", shapes).select("row", F.inline(_candidates(F.col("shapes"))))
    hits = each.filter(possible(words, blocks, *hashes(F.col("kind"), F.col("host_key"), F.col("path_key"))))
    rule = F.concat("host_key", "path_key")
    best = F.max(F.when(F.col("kind") == "rule", F.struct(F.length(rule).alias("length"), F.col("verdict").alias("verdict"), rule.alias("rule"))))
    known = known.withColumnsRenamed({"host": "host_key", "path": "path_key"})
    best = joined(hits, known, ["kind", "host_key", "path_key"], scratch).groupBy("row").agg(best.alias("best"), F.max(F.col("kind") == "url").alias("listed"))
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(is_listed, "block").otherwise("allow"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), is_listed.alias("is_listed"))
