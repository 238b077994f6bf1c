"""Benchmark decontamination: rare word pairs as seeds that join passages to items, then Smith-Waterman alignment.

Benchmark items and documents become word sequences (A-Z as a-z). The best local score of a document and an item, as a
share of the item's score with itself, says how much of the item the document repeats, whatever words were changed, added
or dropped. No pair at the threshold t is lost before it is aligned: of M matches with E errors between them, 2 M - E is at
least 2 t L for an item of L words, so at least need = t L - 1 of the M - 1 neighbouring matches have one error between them
at most. Their two words stand one or two places apart in the item and in the document. Such a document thus hits at least
need of the item's P places that begin a pair, misses P - need at most, and hits at least s of any P - need + s places.

So only an item's rarest P - need + s places are seeds, by the number of documents that have their pairs: all documents
are counted first, and places with frequent pairs fall out as far as the bound allows. Documents then tell which seeds they
hold, these join the items' places, and pairs (document, item) with s places (s: a quarter of need) are aligned where
the places of the item lie dense enough. The documents are read for counts, for seeds and for the pairs found, however
many words the benchmark has.

Edge cases: null and empty texts and items, and such without words, match nothing; items with equal words are one item,
reported under the least item_id; an item of at most 1 / t words is sought by its single words; repeated rows of an id
count as one document with the best score; a null doc_id is kept as such; an empty table gives no rows; columns other
than doc_id, item_id and text are ignored (leaks) or kept (without_leaks).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._spark import bounded_batches, cut, short_lived_shuffles, small
from ledgerloom.llm._text import U64, mix, slices, words

THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
NULL_ID = -(1 << 63)
#: Words of candidate items that a task of the alignment holds at a time (8 bytes each); more take a further pass over candidates.
HELD_WORDS = 8_000_000
#: Bits of the greatest bit map of seeds, 128 MB; beyond 2^26 seeds it lets more through, which the join drops.
MOST_BITS = 30
#: s as a share of need.
STRENGTH = 0.25


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id, words (array<long>) of the distinct word sequences."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, found = [], [], []
            for a, b, raw, offs in slices(batch.column(1)):
                _, _, hashes, at = words(raw, offs)
                for i in range(b - a):
                    w = hashes[at[i] : at[i + 1]]
                    ids.append(batch.column(0)[a + i].as_py())
                    keys.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                    found.append(w.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["item_id", "key", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        split, "item_id long, key binary, words array<long>"
    )
    distinct = rows.filter("size(words) > 0").groupBy("key").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"))
    return distinct.select(F.xxhash64("key").alias("item"), "item_id", "words")


def _pairs(w: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the words and those that stand so many places behind; 0: of single words."""
    return mix(w) if apart == 0 else mix(mix(w[:-apart]) * U64(0xC2B2AE3D27D4EB4F) + w[apart:])


def _bounds(n: int, threshold: float) -> tuple[tuple[int, ...], int, int, int]:
    """For an item of n words: how far apart the words of its pairs stand (0: single words), the places that begin a pair,
    those of them that a document has to hit, and the words of a document that an alignment spans at most."""
    apart = (0,) if threshold * n <= 1 + 1e-9 else (1, 2)
    need = max(1, math.ceil(threshold * n - 1 - 1e-9))
    return apart, n - apart[0], need, math.ceil(n + 2 * n * max(0.0, 1 - threshold)) + 1


def _seeds(items: DataFrame, threshold: float) -> DataFrame:
    """item, place, seed for all places of items, with chosen (places to choose) and strength (places to be hit of these)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for item, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = np.array(w.as_py(), np.int64).view(U64)
                aparts, n, need, _ = _bounds(len(w), threshold)
                strength = max(1, math.ceil(need * STRENGTH))
                for apart in aparts:
                    if apart < len(w):
                        h = _pairs(w, apart).view(np.int64)
                        parts.append([np.full(len(h), item), np.arange(len(h)), h, np.full(len(h), n - need + strength), np.full(len(h), strength)])
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["item", "place", "seed", "chosen", "strength"])

    return items.select("item", "words").mapInArrow(places, "item long, place long, seed long, chosen long, strength long")


class _Maybe:
    """A bit map of the first bits of seeds, gathered by Spark in blocks of 32,768 bits."""

    def __init__(self, seeds: DataFrame, n: int):
        bits = min(MOST_BITS, max(15, 4 + n.bit_length()))
        self.shift = U64(64 - bits)
        slot = F.shiftrightunsigned("seed", 64 - bits) + 1
        blocks = seeds.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        for r in blocks.collect():  # at most 128 MB of blocks
            self.bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _held(maybe: _Maybe, single: bool, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, seed) for the distinct seeds of documents that may be items', in order of the seeds."""
    docs, found = [], []
    for apart in (0, 1, 2) if single else (1, 2):
        if len(hashes) > apart:
            h = _pairs(hashes, apart)
            ok = maybe.holds(h) & (doc[: len(h)] == doc[apart:])
            docs.append(doc[: len(h)][ok])
            found.append(h[ok])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    docs, found = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((docs, found))
    docs, found = docs[order], found[order]
    new = np.append(True, (found[1:] != found[:-1]) | (docs[1:] != docs[:-1]))[: len(found)]
    return docs[new], found[new]


def _rare(docs: DataFrame, seeds: DataFrame, single: bool) -> DataFrame:
    """The seeds that are looked up: item, place, seed, strength of each item's rarest places."""
    maybe = _Maybe(seeds, seeds.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in slices(batch.column(1)):
                _, _, hashes, at = words(raw, offs)
                _, found = _held(maybe, single, hashes, np.repeat(np.arange(len(at) - 1), np.diff(at)))
                keys, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["seed", "n"])

    counts = docs.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    told = seeds.join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    places = told.groupBy("item", "place").agg(F.sum("n").alias("n"), F.first("chosen").alias("chosen"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "place"))
    rarest = places.withColumn("_rank", rank).filter("_rank <= chosen and n > 0").select("item", "place")
    return told.filter("n > 0").join(rarest, ["item", "place"], "left_semi").select("item", "place", "seed", "strength")


def _candidates(docs: DataFrame, rare: DataFrame, n: int, single: bool) -> DataFrame:
    """key (of a document), item for the pairs that have as many seeds in common as a pair at the threshold must have."""
    maybe = _Maybe(rare, n)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, _, raw, offs in slices(batch.column(1)):
                _, _, hashes, at = words(raw, offs)
                doc, found = _held(maybe, single, hashes, np.repeat(np.arange(len(at) - 1), np.diff(at)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a + doc]), pa.array(found.view(np.int64))], names=["key", "seed"])

    hits = docs.select("key", "text").mapInArrow(find, "key long, seed long").join(small(rare, n), "seed")
    pairs = hits.groupBy("key", "item").agg(F.count_distinct("place").alias("_n"), F.first("strength").alias("strength"))
    return pairs.filter("_n >= strength").select("key", "item")


def _stretches(at: np.ndarray, need: int, span: int) -> list[tuple[int, int]]:
    """(first, last) words of a document around the places that are dense enough."""
    if len(at) < need:
        return []
    start = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
    low, high = at[start] - span, at[start + need - 1] + span
    if not len(low):
        return []
    new = np.flatnonzero(low[1:] > high[:-1]) + 1
    return list(zip(low[np.append(0, new)].tolist(), high[np.append(new - 1, len(low) - 1)].tolist(), strict=True))


class _Text:
    """The words of a document, with the places of its pairs by hash."""

    def __init__(self, hashes: np.ndarray):
        self.words, self.pairs = hashes.view(np.int64), {}
        self.hashes = hashes

    def _sorted(self, apart: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if apart not in self.pairs:
            found = [_pairs(self.hashes, a) for a in apart if a < len(self.hashes)] or [np.zeros(0, U64)]
            h, at = np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])
            order = np.argsort(h, kind="stable")
            self.pairs[apart] = h[order], at[order]
        return self.pairs[apart]

    def best(self, item: np.ndarray, threshold: float) -> tuple[int, int]:
        """The best score of an item, and the place behind its end, if the item can reach the threshold."""
        apart, _, need, span = _bounds(len(item), threshold)
        keys, places = self._sorted(apart)
        own = [_pairs(item.view(U64), a) for a in apart if a < len(item)]
        wanted = np.unique(np.concatenate(own))
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        held = wanted[high > low]
        hit = np.zeros(len(item), bool)
        for h in own:
            hit[: len(h)] |= np.isin(h, held)
        if np.count_nonzero(hit) < need:
            return 0, 0
        n = high - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best, end = 0, 0
        for first, last in _stretches(np.unique(places[entry]), need, span):
            first = max(0, first)
            s, e = align(item, self.words[first : last + 1])
            if s > best:
                best, end = s, first + e
        return best, end


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of two word sequences, and the place in text behind its end."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - GAP * steps) + GAP * steps
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (share of the item's own score, above the threshold), end_word for contaminated documents."""
    with short_lived_shuffles(docs.sparkSession):
        bounded_batches(docs.sparkSession)
        base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string"))
        # Rows of one key have one id and text, so they have the same candidates; others that share it are only aligned in vain.
        base = base.select(F.xxhash64("doc_id", "text").alias("key"), "text", "doc_id")
        items = cut(_items(benchmark))
        single = not items.filter(F.size("words") * threshold <= 1 + 1e-9).isEmpty()
        rare = cut(_rare(base, cut(_seeds(items, threshold)), single))
        pairs = cut(_candidates(base, rare, rare.count(), single))
        asked = cut(items.join(pairs.select("item").distinct(), "item", "left_semi"))
        words_asked = asked.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).head()["n"]
        parts = max(1, -(-words_asked // HELD_WORDS))
        scored = None
        for part in range(parts):
            mine = F.pmod("item", F.lit(parts)) == part
            held = asked.filter(mine).collect()  # HELD_WORDS or about as many
            found = _score(base, cut(pairs.filter(mine)), {r["item"]: (r["item_id"], np.array(r["words"], np.int64)) for r in held}, threshold)
            scored = found if scored is None else scored.union(found)
        return (
            scored.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("score", "end_word")).alias("best"))
            .select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "item_id", "best.score", "best.end_word")
        )


def _score(docs: DataFrame, pairs: DataFrame, items: dict[int, tuple[int, np.ndarray]], threshold: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for a, b, raw, offs in slices(batch.column(1)):
                _, _, hashes, at = words(raw, offs)
                for i in range(b - a):
                    text = _Text(hashes[at[i] : at[i + 1]])
                    for key in batch.column(2)[a + i].as_py():
                        item_id, item = items[key]
                        best, end = text.best(item, threshold)
                        share = best / (MATCH * len(item))
                        if share >= threshold:
                            rows.append((batch.column(0)[a + i].as_py(), item_id, share, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                names=["doc_id", "item_id", "score", "end_word"],
            )

    lists = small(pairs.groupBy("key").agg(F.collect_list("item").alias("items")), pairs.count())
    return docs.join(lists, "key").select("doc_id", "text", "items").mapInArrow(score, "doc_id long, item_id long, score double, end_word long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs whose id isn't contaminated."""
    found = cut(leaks(docs, benchmark, **how).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(small(found, found.count()), docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti")
