"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, regions have racks, racks have shards with weights; a node weighs what its shards weigh. A row
descends level by level: at each node every child draws ``-ln(u) / weight`` from a hash of the row's id and the child's
name, and the lowest draw wins. A child's draw depends on nothing but its own name and weight, so changing weights below
one child moves rows only into or out of that child's subtree.

The law is `key`: the id and the tree decide. Equal texts of several ids may so lie in several shards; whoever wants them
together places by a column that they share (place's key).

Edge cases: a null id is an id of its own (all such rows share a shard); equal ids share a shard, repeated rows get slots
of their own; null text has size 1 and crc32 0; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Rows that one window group numbers, about.
CHUNK_ROWS = 4096


def even_tree(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> Tree:
    """A tree of equal shards 0 to shards-1, filled region by region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // shards_per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: the other regions' draws stay, so rows move into the new shard only."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, f"region-of-{new}": {f"rack-of-{new}": {new: weight}}}


def _weigh(node) -> float:
    return sum(map(_weigh, node.values())) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def _choose(key: Column, children: Mapping, level: str) -> Column:
    """Index of the child that the row falls to."""
    live = [(i, name, w) for i, (name, node) in enumerate(children.items()) if (w := _weigh(node)) > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(
        F.array(*(F.struct(_draw(key, f"{level}/{name}", w).alias("d"), F.lit(i).alias("i")) for i, name, w in live))
    )["i"]


def _case(index: Column, options: list[Column]) -> Column:
    out = F.when(index == 0, options[0])
    for i, x in enumerate(options[1:], 1):
        out = out.when(index == i, x)
    return out


def place(rows: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """rows with the columns region, rack and shard (those of the same names are replaced)."""
    k = F.col(key).cast("long")
    regions = list(tree.values())
    racks = [list(r.values()) for r in regions]
    out = rows.withColumn("region", _choose(k, tree, "region"))
    out = out.withColumn("rack", _case(F.col("region"), [_choose(k, r, "rack") for r in regions]))
    shard = _case(
        F.col("region"),
        [
            _case(
                F.col("rack"),
                [_case(_choose(k, shards, "shard"), [F.lit(s) for s in shards]) for shards in region],
            )
            for region in racks
        ],
    )
    return out.withColumn("shard", shard)


def number(placed: DataFrame, rows: int, order: list[str], shards: int) -> DataFrame:
    """placed with slot: numbers from 0 without gaps in each shard. Chunks of a shard are numbered apart and then offset
    by the counts of the chunks before, so that no task sees a whole shard."""
    chunks = rows // (CHUNK_ROWS * shards) + 1
    chunked = placed.withColumn("_chunk", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy("shard", "_chunk")
        .count()
        .select("shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_chunk"])
        .withColumn("slot", (F.col("_before") + F.col("_row")).cast("long"))
        .drop("_chunk", "_row", "_before")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard for every row of docs."""
    tree = even_tree(shards)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")
    )
    placed = place(base, tree)
    grown = place(placed.select("*", F.col("region").alias("_r"), F.col("rack").alias("_k"), F.col("shard").alias("_s")), grow(tree))
    both = grown.select(
        "doc_id",
        (F.octet_length("_text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_r").alias("region"),
        F.col("_k").alias("rack"),
        F.col("_s").cast("int").alias("shard"),
        F.col("shard").cast("int").alias("grown_shard"),
    )
    return number(both, docs.count(), ["doc_id", "size", "text_crc32"], shards).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack"
    )
