"""The trie of conversations' turn sequences, with what shared prefixes save.

A conversation is a path: a digest of 32 hexadecimal digits for each turn. Paths are range-partitioned, so Spark's splitters cut
their sorted order into shards. Only a node whose conversations lie on both sides of a cut is unfinished in its shards: it is a
common prefix of the two paths at the cut. These prefixes, the skeleton, are known from one path on either side of each cut and
go to all tasks. A task walks through its sorted shard once with a stack of open nodes; every node off the skeleton is finished
there, and skeleton nodes (the root is always one) leave partial aggregates, which are added up by node and then folded from
the longest prefixes to the root.

Copies of one conversation are cut apart like any others, since conv_id is part of the order. The ids that end in a skeleton
node go in pieces of ENDS ids to one task, which hashes them as they pass. The skeleton has at most as many nodes as the
cuts' common prefixes have turns.

Edge cases: rows without a conv_id belong to no conversation; null roles and texts are empty; a conversation's turns are
ordered by turn (null first), those of one turn by digest, and repeated rows are turns of their own; a conversation without
turns ends in the root; an empty table gives no nodes; other columns are ignored. A path takes about 100 bytes a turn in a
task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import cut, short_lived_shuffles

#: Conversations of one family share the first turns of its first member.
FAMILY, MOST_SHARED = 20, 3
DIGITS = 32
ENDS = 4096
WORD = r"[^\x20\x09-\x0D]+"

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ROW = f"kind string, key string, parent_key string, {NODE}, tokens long, shard long, piece long, ids string"
_SHA = "key string, ends_sha256 string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (turn, digest, tokens: its words) of every conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens")).alias("t")
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path, tokens: each conversation with its first h turns exchanged for those of the first member of its family;
    h is crc32 of its id modulo MOST_SHARED + 1."""
    own = turns_of(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int"))
    own = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    whole = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.col("h")), rest)
    joined = own.join(heads, "family", "left").select("conv_id", whole.alias("turns"))
    return joined.select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.tokens").alias("tokens"))


def _common(a: str, b: str) -> int:
    """The number of turns that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGITS] == b[: middle * DIGITS]:
            low = middle
        else:
            high = middle - 1
    return low


def _key(path: str, depth: int) -> str:
    return hashlib.sha256(path[: depth * DIGITS].encode()).hexdigest()


class _Node:
    __slots__ = ("depth", "key", "parent_key", "conv", "n", "children", "leaves", "saved", "tokens", "ends", "sha", "pieces", "waiting")

    def __init__(self, depth: int, tokens: int, key: str | None, parent_key: str | None):
        self.depth, self.tokens, self.key, self.parent_key = depth, tokens, key, parent_key
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.sha, self.pieces, self.waiting = [], None, 0, []

    def meets(self, conv: int, n: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None or conv < self.conv else self.conv


class _Shard:
    """Nodes of one shard, from its conversations in order; rows() are those that can be told by now."""

    def __init__(self, shard: int, cuts: tuple[str, str]):
        self.shard, self.cuts, self.last, self.told = shard, cuts, "", []
        self.open = [_Node(0, 0, _key("", 0), None)]

    def add(self, conv: int, path: str, tokens: list[int]) -> None:
        self._close(_common(self.last, path))
        depth = len(path) // DIGITS
        on = max(_common(path, c) for c in self.cuts) if depth > len(self.open) - 1 else 0
        for d in range(len(self.open), depth + 1):
            self.open.append(_Node(d, tokens[d - 1], _key(path, d) if d <= on else None, self.open[-1].key))
        self.last = path
        node = self.open[-1]
        node.meets(conv, 1)
        node.ends.append(str(conv))
        if len(node.ends) == ENDS:
            self._flush(node)

    def _flush(self, node: _Node) -> None:
        ids = ",".join(node.ends)
        if node.key is not None:
            self.told.append({"kind": "ends", "key": node.key, "shard": self.shard, "piece": node.pieces, "ids": ids})
        else:
            node.sha = node.sha or hashlib.sha256()
            node.sha.update((("," if node.pieces else "") + ids).encode())
        node.pieces, node.ends = node.pieces + 1, []

    def _close(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            node, parent = self.open.pop(), self.open[-1]
            self._tell(node)
            parent.meets(node.conv, node.n)
            if node.key is None:
                parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
                if parent.key is None:
                    parent.waiting.append(self._row(node))
                else:
                    self.told.append(self._row(node))

    def _tell(self, node: _Node) -> None:
        if node.ends:
            self._flush(node)
        if node.key is not None:
            self.told.append(self._row(node) | {"kind": "part"})
            return
        node.leaves = node.leaves if node.children else 1
        node.saved += (node.n - 1) * node.tokens
        for row in node.waiting:
            self.told.append(row | {"parent_conv_id": node.conv})
        node.waiting = []

    def _row(self, node: _Node) -> dict:
        return {
            "kind": "node", "key": node.key, "parent_key": node.parent_key, "conv_id": node.conv, "depth": node.depth, "n_convs": node.n,
            "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "tokens": node.tokens,
            "ends_sha256": (node.sha or hashlib.sha256()).hexdigest(),
        }

    def rows(self, end: bool = False) -> list[dict]:
        if end:
            self._close(0)
            self._tell(self.open[0])
        told, self.told = self.told, []
        return told


def _walk(cuts: dict[int, tuple[str, str]]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, schema = None, _arrow(_ROW)
        for batch in batches:
            for row in batch.to_pylist():
                shard = shard or _Shard(row["shard"], cuts[row["shard"]])
                shard.add(row["conv_id"], row["path"], row["tokens"])
            if shard:
                yield pa.RecordBatch.from_pylist(shard.rows(), schema)
        if shard:
            yield pa.RecordBatch.from_pylist(shard.rows(end=True), schema)

    return walk


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append({"key": key, "ends_sha256": sha.hexdigest()})
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield pa.RecordBatch.from_pylist(out, _arrow(_SHA))
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": sha.hexdigest()}], _arrow(_SHA))


def _fold(parts: list[dict], ends: dict[str, str]) -> list[tuple]:
    """The skeleton's nodes, finished from their sums: longest prefixes first, each adds itself to its parent."""
    by_key = {p["key"]: p for p in parts}
    for p in sorted(parts, key=lambda p: -p["depth"]):
        p["n_leaves"] = p["n_leaves"] if p["n_children"] else 1
        p["saved_tokens"] += (p["n_convs"] - 1) * p["tokens"]
        if p["depth"]:
            up = by_key[p["parent_key"]]
            up["n_children"] += 1
            up["n_leaves"] += p["n_leaves"]
            up["saved_tokens"] += p["saved_tokens"]
            p["parent_conv_id"] = up["conv_id"]
    empty = hashlib.sha256().hexdigest()
    for p in parts:
        p["ends_sha256"] = ends.get(p["key"], empty)
    return [(p["key"], *(p.get(c.split()[0]) for c in NODE.split(", "))) for p in parts]


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path, tokens), one row each: conv_id (smallest member), depth, parent_conv_id (the
    parent's; null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    with short_lived_shuffles(spark):
        ordered = rows.select("conv_id", "path", "tokens").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        shards = cut(ordered).withColumn("shard", F.spark_partition_id().cast("long"))
        # Two paths of every shard.
        ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("shard").collect()
        between = ["", *(a.last[: _common(a.last, b.first) * DIGITS] for a, b in zip(ends, ends[1:], strict=False)), ""]
        told = cut(shards.mapInArrow(_walk({x.shard: (between[i], between[i + 1]) for i, x in enumerate(ends)}), _ROW))
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        parts = told.filter("kind = 'part'").groupBy("key", "parent_key", "depth", "tokens").agg(F.min("conv_id").alias("conv_id"), *sums)
        pieces = told.filter("kind = 'ends'").select("key", "shard", "piece", "ids")
        ends_of = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").mapInArrow(_hash_ends, _SHA)
        skeleton = _fold([r.asDict() for r in parts.collect()], {r.key: r.ends_sha256 for r in ends_of.collect()})
        nodes = [c.split()[0] for c in NODE.split(", ")]
        stem = spark.createDataFrame(skeleton, f"key string, {NODE}")
        # The skeleton is bounded by the cuts, see above.
        above = F.broadcast(stem.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
        finished = told.filter("kind = 'node'").join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
        return finished.select(*nodes).unionByName(stem.select(*nodes))
