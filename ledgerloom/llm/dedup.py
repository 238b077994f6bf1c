"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set holds the hashes of its distinct k-word shingles. Equal sets form a class, and everything below works on
classes, numbered by one long. The hash range is cut into ``BANDS * ROWS`` bins, every bin keeps its least hash, an empty bin
copies the bin that a fixed sequence of probes for it first finds filled. ROWS bins make a band, classes with an equal band
share a bucket, and in a bucket only the edges from one member, its centre, to the others are candidates. Candidates are
confirmed on the full sets.

A star can miss links between two members that are both too far from its centre. Of the buckets whose members still lie in
several components, first those members are settled that can have no partner: the shingles that no other such set has bound
what a set can share, and so how large a partner may be. Then another star is drawn around the member with the fewest
shingles of its own, and at last every pair of different components is confirmed that can be a link by its sizes and by
bit maps of its shingles. So every pair that shares a
bucket is compared, is connected already, or is proven to be no link.

Edge cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; a text of fewer
words than k has its whole word sequence as one shingle; repeated rows and ties are equal sets; a null id counts as the
least id; an empty table gives no rows; columns other than doc_id and text are ignored (near_duplicates) or kept
(keep_one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import Scratch, cut, short_lived_shuffles, small
from ledgerloom.llm._text import U64, grams, mix, slices, words

BANDS, ROWS = 32, 5
#: Words of 64 bits in a class's bit map of common shingles; a power of two.
WORDS = 16
NULL_ID = -(1 << 63)
_BINS = BANDS * ROWS
_EDGES = np.array([-(-(b << 64) // _BINS) for b in range(1, _BINS)], U64)
_PROBES = np.random.Generator(np.random.PCG64(7)).integers(0, _BINS, (2048, _BINS))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text of the column, the sorted distinct hashes of its k-word shingles."""
    for _, _, raw, offs in slices(column):
        _, _, hashes, at = words(raw, offs)
        runs = grams(hashes, k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            else:
                yield np.unique(grams(hashes[a:b], int(b - a))) if b > a else runs[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified bins of a set that isn't empty; shingles are sorted."""
    bounds = np.concatenate(([0], np.searchsorted(shingles, _EDGES), [len(shingles)]))
    filled = bounds[1:] > bounds[:-1]
    out = shingles[np.minimum(bounds[:-1], len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    source = np.arange(_BINS)
    for t in range(0, len(_PROBES), 32):
        if not len(empty):
            break
        probes = _PROBES[t : t + 32, empty]
        hit = filled[probes]
        found = hit.any(axis=0)
        source[empty[found]] = probes[hit.argmax(axis=0), np.arange(len(empty))][found]
        empty = empty[~found]
    if len(empty):  # a few in a million, of sets of one shingle
        source[empty] = np.flatnonzero(filled)[0]
    return out[source]


def band_keys(signature_: np.ndarray) -> np.ndarray:
    x = signature_.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for i in range(ROWS):
        key = mix(key * U64(0xC2B2AE3D27D4EB4F) + x[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, n, key, bands of every row of docs; key and bands are null for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sketch, "id long, n long, key binary, bands array<long>"
    )


def classes_of(sketched: DataFrame) -> DataFrame:
    """node, key, id, n, bands: the classes of equal sets, numbered (the numbers hold once this is written), with their
    least id. Groups of copies are put together before the shuffle."""
    one = sketched.filter("n > 0").groupBy("key").agg(
        F.min(F.coalesce("id", F.lit(NULL_ID))).alias("id"), F.max("n").alias("n"), F.first("bands").alias("bands")
    )
    return one.select(F.monotonically_increasing_id().alias("node"), "key", "id", "n", "bands")


def sharing(classes: DataFrame) -> DataFrame:
    """node, n, order, buckets of the classes that share a bucket with another, with those buckets; order is less the more
    places they share."""
    places = classes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return places.join(sizes, "bucket").groupBy("node").agg(
        F.max("n").alias("n"), (-F.sum("size")).cast("double").alias("order"), F.collect_list("bucket").alias("buckets")
    )


def in_doubt(nodes: DataFrame, least: int) -> DataFrame:
    """nodes (node, n, root, buckets and others) of buckets that hold several components and least members, with those
    buckets alone."""
    rest = [c for c in nodes.columns if c not in ("node", "buckets")]
    members = nodes.select("node", *rest, F.explode("buckets").alias("bucket"))
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
        .filter((F.col("lo") != F.col("hi")) & (F.col("size") >= least))
        .select("bucket")
    )
    return members.join(mixed, "bucket").groupBy("node").agg(*(F.max(c).alias(c) for c in rest), F.collect_list("bucket").alias("buckets"))


def stars(nodes: DataFrame, fits: Column) -> DataFrame:
    """a, b: in every bucket of nodes (node, order, buckets and others) the edges from its centre, the member of least
    (order, node), to the members that fit; the centre's columns are named c_."""
    rest = [c for c in nodes.columns if c not in ("order", "node", "buckets")]
    members = nodes.select("order", "node", *rest, F.explode("buckets").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min(F.struct("order", "node", *rest)).alias("c"))
    centres = centres.select("bucket", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", *rest)))
    return members.join(centres, "bucket").filter((F.col("node") != F.col("c_node")) & fits).select(
        F.col("c_node").alias("a"), F.col("node").alias("b")
    ).distinct()


def shared_at_most() -> Column:
    """What a node and one named c_ can share at most: of each, the common shingles but one for every bit that only it has."""
    alone = lambda x, y: reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}b{i}").bitwiseAND(F.bitwise_not(f"{y}b{i}"))) for i in range(WORDS)))
    return F.least(F.col("common") - alone("", "c_"), F.col("c_common") - alone("c_", ""))


def pairs_in_doubt(nodes: DataFrame, fits: Column) -> DataFrame:
    """a, b: all pairs of a bucket that are of different components and fit. nodes: node, n, root, least, most (sizes that a
    partner can have), buckets and others.

    One of such a pair isn't of the bucket's largest component; so those that aren't meet all others, by bucket and size
    class (about 8%), and the largest component's members never meet each other."""
    rest = [c for c in nodes.columns if c not in ("order", "buckets")]
    size_class = lambda x: F.floor(F.log(F.greatest(x, F.lit(1))) * 12)
    members = nodes.select("root", F.explode("buckets").alias("bucket")).groupBy("bucket", "root").agg(F.count("*").alias("size"))
    main = members.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("main")).select("bucket", F.col("main.root").alias("main"))
    point = nodes.select(*rest, F.explode("buckets").alias("bucket"), size_class(F.col("n")).alias("size"))
    sizes = F.sequence(size_class(F.col("least")), size_class(F.least("most", F.floor(F.col("n") * F.col("n") / F.col("least")) + 1)))
    apart = nodes.select(*(F.col(c).alias(f"c_{c}") for c in rest), F.explode("buckets").alias("bucket"), sizes.alias("sizes"))
    apart = apart.join(main, "bucket").filter("c_root != main").drop("main")
    return (
        apart.select("*", F.explode("sizes").alias("size")).drop("sizes").join(point, ["bucket", "size"]).filter(fits)
        .select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct()
    )


def _sets(docs: DataFrame, nodes: DataFrame, rows: int, k: int) -> DataFrame:
    """node, hashes (the sorted hashes of the whole set) of nodes (node, id, key; so many rows), made again from one
    document of each class."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "hashes"]
            )

    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("string"))
    made = chosen.join(small(nodes.select("id").distinct(), rows), "id", "left_semi").select("id", "text")
    made = made.mapInArrow(make, "key binary, hashes array<long>").join(small(nodes.select("key", "node"), rows), "key")
    # Repeated rows make their set again.
    return made.dropDuplicates(["key"]).select("node", "hashes")


def confirm(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """edges (a, b) with the sizes of both sets and of their intersection, counted on the full sets."""
    # Members first: nearly every member occurs once, while a centre may occur in very many edges.
    both = edges.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a"
    )
    sizes = (F.size("ha").cast("long").alias("na"), F.size("hb").cast("long").alias("nb"))
    return both.select("a", "b", *sizes, F.size(F.array_intersect("ha", "hb")).cast("long").alias("shared"))


def common_shingles(sets: DataFrame) -> DataFrame:
    """node, common (how many shingles of a set another of these sets has too), b0 to b15 (a bit map of those)."""
    each = sets.select("node", F.explode("hashes").alias("h"))
    once = each.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    own = once.groupBy("node").agg(F.collect_list("h").alias("own"))
    common = sets.join(own, "node", "left").withColumn("common", F.coalesce(F.array_except("hashes", "own"), "hashes"))

    def word(i: int) -> Column:
        mine = F.filter("common", lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(WORDS - 1)) == i)
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(bit(h))).alias(f"b{i}")

    return common.select("node", F.size("common").cast("long").alias("common"), *(word(i) for i in range(WORDS)))


def components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """node, root (the least node that it reaches) for the nodes of edges (a, b), by alternating large and small stars."""
    e = tables.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        # Done when all are stars: every node has one root, and no root has another.
        loose = e.select("u", F.lit(1).alias("edges"), F.lit(0).alias("is_root")).union(e.select("v", F.lit(0), F.lit(1)))
        loose = loose.groupBy("u").agg(F.sum("edges").alias("edges"), F.max("is_root").alias("is_root"))
        if loose.filter(F.col("edges") + F.col("is_root") > 1).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        rows = 2 * e.count()
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(small(least, rows), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        after = large.join(small(least, rows), "u").select(F.explode(to_least).alias("x")).select("x.*").filter("u != v").distinct()
        before, e = e, tables.keep(after)
        tables.drop(before)


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _with_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with root, their own number where no link is known."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _connected(classes: DataFrame, docs: DataFrame, k: int, percent: int, tables: Scratch) -> DataFrame:
    """node, root: the components that the links make, for classes with a link."""
    nodes = tables.keep(sharing(classes))
    chosen = tables.keep(classes.join(small(nodes.select("node"), rows := nodes.count()), "node", "left_semi").select("node", "id", "key"))
    sets = tables.keep(_sets(docs, chosen, rows, k))
    tables.drop(chosen)
    # One star a bucket, around the member that shares the most places in buckets with others: of a group of copies that
    # is the original, if it is there, to which all are nearer than to each other. Sizes that differ too much can't be linked.
    by_size = F.lit(100) * F.least("n", "c_n") >= F.lit(percent) * F.greatest("n", "c_n")
    edges = tables.keep(stars(nodes, by_size))
    found = tables.keep(confirm(edges, sets).filter(_linked(percent)).select("a", "b"))
    roots = components(found, tables)
    tables.drop(edges, found)
    doubt = tables.keep(in_doubt(_with_root(nodes.drop("order"), roots), 3))
    tables.drop(nodes)
    # Shingles that only one of these sets has bound what it can share, and so the size of a partner. Sets that no partner
    # can fit are settled.
    of_doubt = sets.join(small(doubt.select("node"), doubt.count()), "node", "left_semi")
    bounded = doubt.join(common_shingles(of_doubt), "node").withColumns(
        {
            "least": F.ceil(F.lit(percent) * F.col("n") / 100).cast("long"),
            "most": (F.floor(F.col("common") * (100 + percent) / percent + 1e-9) - F.col("n")).cast("long"),
        }
    )
    open_ = tables.keep(in_doubt(bounded.filter("most >= least"), 2))
    tables.drop(doubt)
    # A star around the member with the fewest shingles of its own, the nearest to all others; then the pairs that are left.
    by_bits = 100 * shared_at_most() >= percent * (F.col("n") + F.col("c_n") - shared_at_most())
    fits = (F.col("root") != F.col("c_root")) & (F.col("n") <= F.col("c_most")) & (F.col("c_n") <= F.col("most")) & by_size & by_bits
    for find in (lambda x: stars(x.withColumn("order", -F.col("most") / F.col("n")), fits), lambda x: pairs_in_doubt(x, fits)):
        now = in_doubt(_with_root(open_.drop("root"), roots), 2)
        edges = tables.keep(find(now))
        found = tables.keep(confirm(edges, sets).filter(_linked(percent)).select("a", "b"))
        tables.drop(edges)
        if not found.isEmpty():
            roots = components(roots.toDF("a", "b").union(found), tables)
    return roots


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; a link is 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    with short_lived_shuffles(spark):
        tables = Scratch(spark)
        sketched = tables.keep(sketches(docs, k))
        classes = tables.keep(classes_of(sketched))
        roots = _connected(classes, docs, k, percent, tables)
        ids = classes.select("node", "key", "id")
        least = ids.join(roots, "node").groupBy("root").agg(F.min("id").alias("least"))
        rows = roots.count()
        label = ids.join(roots, "node", "left").join(small(least, rows), "root", "left").select("key", F.coalesce("least", "id").alias("component_id"))
        component = F.coalesce("component_id", "id")
        out = cut(
            sketched.select("id", "n", "key")
            .join(label, "key", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != NULL_ID, component).alias("component_id"))
        )
        tables.drop_all()
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that a near-duplicate of smaller id stands for. Rows that are equal in id and text
    are one; an id with several texts stays if any of them does. All columns are kept, whatever their names."""
    known = near_duplicates(docs, k, percent).groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"))
    by_id = cut(known.agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    kept = by_id.filter("kept")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.struct("*").alias("row"))
    own = own.join(small(kept.select("id"), kept.count()), "id", "left_semi")
    if not by_id.filter("n > 1").isEmpty():
        # Only rows of ids that repeat can be equal; the others aren't compared by their texts.
        own = own.join(by_id.filter("n > 1").select("id", F.lit(True).alias("repeats")), "id", "left")
        own = own.withColumn("text", F.when(F.col("repeats"), F.col("row.text"))).dropDuplicates(["id", "text"])
    return own.select("row.*")
