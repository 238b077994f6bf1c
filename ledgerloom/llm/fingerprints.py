"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into units (up to eight non-space characters with the white space before them), k units make a k-mer, and
each k-mer carries the number of its earlier occurrences. The hashes of (k-mer, occurrence) fall into ``BINS`` bins by
their top bits; every bin keeps its ``PICK`` lowest, puts their k-mers back into text order and hashes that tuple. A bin
thus plays the part of one hash function of Order MinHash over a share of the k-mers. Two fingerprints are alike by the
share of equal bins among the bins that either of them fills; moved or edited passages change members or their order.

Edge cases: null text is empty; an empty text fills no bin, and two empty texts are alike by 1; a text of fewer than k
units is one k-mer; repeated ids are rows of their own, and as a neighbour such an id stands with its greatest prefix;
a null id comes after all others in descending order; one document alone is its own neighbour; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._spark import cut

K, BINS_LOG2, PICK = 3, 6, 2
_POS = (1 << 31) - 1
_UNIT = r"\s*\S{1,8}|\s+"


def _sure(x: Column) -> Column:
    """Not null, so that arrays of it sort as primitives."""
    return F.coalesce(x, F.lit(0).cast("long"))


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _run_starts(sorted_: Column, shift: int) -> Column:
    """Where a new value of the upper bits begins in a sorted array."""
    def new(i):
        return (i == 0) | (F.shiftright(F.get(sorted_, i), shift) != F.shiftright(F.get(sorted_, i - 1), shift))

    return F.when(F.size(sorted_) > 0, F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), new)).otherwise(
        F.array().cast("array<int>")
    )


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array<int> column out: a code of bin (upper 6 bits) and tuple hash for every filled bin of text."""
    c = {x: f"_{out}_{x}" for x in ("units", "kmers", "first", "runs", "second", "bins")}
    col = {k: F.col(v) for k, v in c.items()}
    df = df.withColumn(c["units"], F.regexp_extract_all(F.col(text), F.lit(_UNIT), F.lit(0)))
    at = F.sequence(F.lit(0), F.greatest(F.size(col["units"]) - K, F.lit(0)))
    df = df.withColumn(
        c["kmers"],
        F.when(
            F.size(col["units"]) > 0,
            F.transform(at, lambda i: F.xxhash64(*(F.get(col["units"], i + j) for j in range(K)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        c["first"],
        F.sort_array(F.transform(col["kmers"], lambda h, i: F.shiftleft(_low32(h), 31).bitwiseOR(i.cast("long")))),
    )
    df = df.withColumn(c["runs"], _run_starts(col["first"], 31))

    def occurrences(s, j):
        end = F.coalesce(F.get(col["runs"], j + 1), F.size(col["first"])) - 1

        def one(i):
            x = F.get(col["first"], i)
            return _sure(
                F.shiftleft(_low32(F.xxhash64(F.shiftright(x, 31), i - s)), 31).bitwiseOR(x.bitwiseAND(F.lit(_POS)))
            )

        return F.transform(F.sequence(s, end), one)

    df = df.withColumn(c["second"], F.sort_array(F.flatten(F.transform(col["runs"], occurrences))))
    shift = 63 - BINS_LOG2
    df = df.withColumn(c["bins"], _run_starts(col["second"], shift))

    def code(s, j):
        end = F.coalesce(F.get(col["bins"], j + 1), F.size(col["second"]))
        picked = F.slice(col["second"], s + 1, F.least(F.lit(PICK), end - s))
        in_order = F.sort_array(F.transform(picked, lambda x: x.bitwiseAND(F.lit(_POS)).cast("int")))
        of_tuple = F.xxhash64(F.transform(in_order, lambda p: F.get(col["kmers"], p)))
        bin_ = F.shiftright(F.get(col["second"], s), shift)
        width = 32 - BINS_LOG2
        signed = F.shiftleft(bin_, width).bitwiseOR(of_tuple.bitwiseAND(F.lit((1 << width) - 1))) - F.lit(1 << 31)
        return signed.cast("int")

    return df.withColumn(out, F.transform(col["bins"], code)).drop(*c.values())


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that a or b fills; 1 if both are empty."""
    width = 32 - BINS_LOG2

    def bins(x):
        return F.transform(x, lambda v: F.shiftright(v, width))

    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def to_string(codes: Column) -> Column:
    return F.array_join(
        F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long") + F.lit(1 << 31)), 8, "0")), ""
    )


def neighbours(ids: DataFrame) -> DataFrame:
    """ids: k (long, no null), h. For every distinct k: the next higher k (after the highest: the lowest) as consumer,
    with its greatest h as consumer_h. Ids are range-partitioned; only each partition's first row meets the others'."""
    ranged = cut(ids.groupBy("k").agg(F.max("h").alias("h")).repartitionByRange("k").withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part").orderBy("k")
    firsts = ranged.groupBy("_part").agg(F.min(F.struct("k", "h")).alias("_first"))
    parts = Window.orderBy("_part")  # one row a partition
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_part", F.coalesce(F.lead("_first").over(parts), F.min("_first").over(whole)).alias("_after"))
    return (
        ranged.withColumn("_next", F.lead(F.struct("k", "h")).over(here))
        .join(firsts, "_part")
        .withColumn("_next", F.coalesce("_next", "_after"))
        .select("k", F.col("_next.k").alias("consumer"), F.col("_next.h").alias("consumer_h"))
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half the next document (descending doc_id) gives."""
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    half = F.expr("char_length(text) div 2")
    near = neighbours(base.select("k", half.alias("h")))
    coded = with_codes(base, "text", "codes")
    # Both sides read the same columns of coded, so that its one exchange serves both.
    sent = (
        coded.join(near, "k")
        .select("consumer", F.struct(F.expr("left(text, cast(consumer_h as int))").alias("prefix"), "codes", "doc_id").alias("sent"))
        .groupBy(F.col("consumer").alias("k"))
        .agg(F.max("sent").alias("sent"))
    )
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(sent.prefix, cast(n_chars div 2 as int)))")
    both = (
        coded.join(sent, "k")
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .select("doc_id", "n_chars", "codes", F.col("sent.codes").alias("next_codes"), edited.alias("edited"))
    )
    out = with_codes(both, "edited", "edited_codes")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        to_string(F.col("codes")).alias("fingerprint"),
        to_string(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
