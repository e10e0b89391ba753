"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut into sections at blank lines, into paragraphs at line breaks, and
those into sentences and pieces of 48 characters at most from the sentence's start, so
that an edit leaves the pieces before it as they were. A piece's digest is the SHA-256 of
its text, a paragraph's that of its pieces' digests, a section's that of its
paragraphs' digests, and the root's that of its sections' digests. Equal roots
mean equal texts; where roots differ, ``differences`` walks down the differing
branches to the paragraphs that were edited.

The likeness of two trees is 1 where their roots are equal. Else both are walked from
both ends: leaves before the first and after the last difference are shared; where
more distinct leaves than that are shared anywhere (several edits, moved parts), these count. The likeness is
their number over that of the leaves of the larger tree plus one.

All of this is built-in DataFrame functions.

``with_next`` finds each document's successor in descending order of doc_id
without a global sort into one task: documents go to ranges of doc_id (sampled
quantiles, cut further by width), each range is ordered on its own, and a copy
of the first document of the next range is added at its end.

Defined results: a null text counts as empty (one section, one empty
paragraph without pieces); null doc_ids come after all others, cut into ranges by a hash of their texts and in
its order within each; documents of the same doc_id follow in the order of that hash; a single
document follows itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PIECE = r"[^.!?\n]{1,48}+[.!?\n]*|[.!?\n]+"
#: Documents in a range, most quantiles, and most copies of first documents that are broadcast.
RANGE_ROWS, QUANTILES, BROADCAST_ROWS = 512, 256, 200_000


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, leaves: array<digest>>>>> of a text."""

    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))

    cut = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.transform(F.split(s, "\n", -1), paragraph), lambda ls: F.struct(F.sha2(F.array_join(ls, ""), 256).alias("digest"), ls.alias("leaves"))))
    return F.transform(cut, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["digest"]), ""), 256).alias("digest"), ps.alias("paragraphs")))


def root(tree: Column) -> Column:
    """Hexadecimal digest of a whole tree."""
    return F.sha2(F.array_join(F.transform(tree, lambda s: s["digest"]), ""), 256)


def leaves(tree: Column) -> Column:
    """64-bit hashes of the digests of a tree's leaves, in order."""
    return F.flatten(F.transform(tree, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: F.transform(p["leaves"], lambda x: F.xxhash64(x))))))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    n, m = F.size(leaves_a), F.size(leaves_b)
    same = lambda a, b: F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1, F.lit(0))
    before = F.when(leaves_a == leaves_b, n).otherwise(same(leaves_a, leaves_b))
    edges = F.least(n, m, before + same(F.reverse(leaves_a), F.reverse(leaves_b)))
    shared = F.greatest(edges, F.size(F.array_intersect(leaves_a, leaves_b)))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(shared / (F.greatest(n, m) + 1.0))


def trees(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections (the tree) of every row."""
    return docs.select("doc_id", tree(F.coalesce("text", F.lit(""))).alias("sections")).select("doc_id", root(F.col("sections")).alias("root"), "sections")


def differences(a: Column, b: Column) -> Column:
    """Places (section, paragraph) at which two trees differ, compared branch by branch."""
    n = F.greatest(F.size(a), F.size(b))
    none = F.array().cast("array<string>")

    def within(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        xs, ys = (F.coalesce(F.transform(z["paragraphs"], lambda p: p["digest"]), none) for z in (x, y))
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs), F.size(ys)) - 1), lambda j: ~F.get(xs, j).eqNullSafe(F.get(ys, j)))
        found = F.transform(at, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        return F.when(x["digest"].eqNullSafe(y["digest"]), F.slice(found, 1, 0)).otherwise(found)

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), within))


def with_next(docs: DataFrame, columns: dict[str, Column], passed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the ``columns`` (of text and of each other, in order), and ``next``: struct of the next document's text and the columns ``passed``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    n = docs.count()
    ranges = max(1, n // RANGE_ROWS)
    cuts = sorted({int(x) for x in docs.select("doc_id").filter("doc_id is not null").approxQuantile("doc_id", [k / min(ranges, QUANTILES) for k in range(min(ranges, QUANTILES) + 1)], 0.002)}) if n else []
    width = max(1, -(-ranges // max(1, len(cuts))))
    bounds = F.array(*(F.lit(c).cast("bigint") for c in cuts)) if cuts else F.array(F.lit(0).cast("bigint"))
    k = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    lo, hi = F.get(bounds, k - 1), F.get(bounds, k)
    part = F.floor((F.col("doc_id") - lo) / (hi - lo + 1.0) * width)
    part = F.when(F.col("doc_id").isNull(), F.pmod("h", F.lit(width))).otherwise(F.coalesce(part, F.lit(0)))
    keyed = base.withColumns({"b": F.when(F.col("doc_id").isNull(), -1).otherwise(k), "s": part.cast("int")})
    # The first document of each range, needed at the end of the range before (of the last one by the first).
    first = scratch.keep(keyed.groupBy("b", "s").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), "h")).alias("m")))
    # Of the last range of a b, that is the first document of the next b: there are QUANTILES + 2 of these at most.
    by_b = Window.partitionBy("b").orderBy(F.desc("s"))
    tops = first.groupBy("b").agg(F.max_by("m", "s").alias("top"))
    order = Window.orderBy(F.desc("b"))
    tops = tops.select("b", F.coalesce(F.lead("top").over(order), F.first("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("top"))
    need = first.withColumn("after", F.lead("m").over(by_b)).join(F.broadcast(tops), "b").select("b", "s", F.coalesce("after", "top").alias("m"))
    need = scratch.keep(need.select("b", "s", F.col("m.i").alias("i"), F.col("m.h").alias("mh")))
    few = need.count() <= BROADCAST_ROWS
    low = F.coalesce(base.doc_id, F.lit(-(1 << 63)))
    extra = base.join(F.broadcast(need) if few else need, (F.col("h") == F.col("mh")) & (low == F.col("i")))
    extra = extra.select("doc_id", "text", "h", "b", "s").dropDuplicates(["b", "s"])
    both = keyed.select("doc_id", "text", "h", "b", "s", F.lit(0).alias("extra")).unionByName(extra.withColumn("extra", F.lit(1)))
    both = both.repartition("b", "s")
    for name, column in columns.items():
        both = both.withColumn(name, column)
    w = Window.partitionBy("b", "s").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("h"))
    out = both.withColumn("next", F.lead(F.struct("text", *passed)).over(w))
    return out.filter("extra = 0").drop("extra", "b", "s", "h")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last third of its
    code points replaced by the start of the next document's text), their likeness, and
    where the first edited paragraph is (null without an edit)."""
    text = F.col("text")
    columns = {"tree": tree(text), "fingerprint": root(F.col("tree")), "leaves": leaves(F.col("tree"))}
    both = with_next(docs, columns, ("fingerprint", "leaves"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("n_chars", F.char_length("text"))
    both = both.withColumn("edited", F.concat(F.substring(text, F.lit(1), F.col("n_chars") - third), F.substring(F.col("next.text"), F.lit(1), third))).drop("text")
    both = both.withColumn("edited_tree", tree(F.col("edited")))
    both = both.withColumns({"edited_fingerprint": root(F.col("edited_tree")), "edited_leaves": leaves(F.col("edited_tree")), "edits": differences(F.col("tree"), F.col("edited_tree"))})
    return both.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("leaves"), F.col("edited_fingerprint"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("leaves"), F.col("next.fingerprint"), F.col("next.leaves")).alias("near_next"),
        F.get("edits", F.lit(0)).getField("section").alias("edit_section"), F.get("edits", F.lit(0)).getField("paragraph").alias("edit_paragraph"), F.size("edits").alias("edited_paragraphs"),
    )
