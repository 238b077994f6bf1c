"""Groups of spellings one edit apart, by dense tiles of padded code-point matrices.

Two words are one inserted, deleted or replaced code point apart if what they share at their beginnings and at their ends adds
up to the longer one's length less one. One edit leaves the first or the last half of the shorter word alone, so words are
tiled by these halves: a tile has the words of length m and m + 1 with equal first (or last) m // 2 code points. Large tiles are
cut into blocks by a hash, and every two blocks of a tile meet in one place, wherever Spark puts it. There all words are rows of
two matrices of width m + 1, padded at their ends and at their beginnings, and the pairs of the blocks are compared at once.
A pair that shares both halves counts where it shares the first one only.

No pair leaves a tile: for each word it tells how many near words it found and which of them is the most frequent.
Frequencies at least double from a word to its form, so chains of forms have at most as many steps as the greatest
frequency has binary digits; roots come by doubling the steps.

Edge cases: null texts have no words; without a doc_id the hash is of ":word"; equal rows count as often as they occur; a text
is one row, so a text of any length is handled whole within a task's memory; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import bounded_batches, cut, short_lived_shuffles

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a code point.
ALTERED = 97
SHORTEST, RAREST = 5, 3
#: Words of a block at most, and bytes of one of its matrices.
BLOCK_WORDS, BLOCK_BYTES = 512, 1 << 20
#: Pairs that are compared at a time, in bytes of a matrix.
CHUNK_BYTES = 8 << 20

_TILE = ("m", "side", "half", "i", "j")
_FOUND = "word string, n_near long, best_n long, best string"


def altered_words(docs: DataFrame) -> DataFrame:
    """word, n: the letter runs of all texts, A-Z in lower case, some with one code point left out; those of at least
    SHORTEST code points that occur RAREST times or more."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("raw"))
    ascii_only = F.octet_length("raw") == F.char_length("raw")
    run = runs.select("id", F.when(ascii_only, F.lower("raw")).otherwise(F.translate("raw", upper, lower)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = run.select(F.when(h % ALTERED == 0, without).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= RAREST)


def _tiles(words: DataFrame) -> DataFrame:
    """A row for each word, tile and pair of the tile's blocks that the word is in: the tile, word, n, long (it has m + 1 code
    points) and block."""
    length = F.char_length("word")

    def entry(m: Column, side: str) -> Column:
        half = F.floor(m / 2).cast("int")
        part = F.substring(F.col("word"), F.lit(1), half) if side == "first" else F.right("word", half)
        return F.struct(m.cast("int").alias("m"), F.lit(side).alias("side"), part.alias("half"), (length > m).alias("long"))

    entries = F.array(*(entry(m, side) for m in (length, length - 1) for side in ("first", "last")))
    placed = words.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.*")
    tile = ["m", "side", "half"]
    most = F.greatest(F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_BYTES) / (F.col("m") + 1))), F.lit(1))
    sizes = placed.groupBy(*tile).agg(F.count("*").alias("_n"), F.count_if(~F.col("long")).alias("_short")).filter("_n > 1 and _short > 0")
    sizes = sizes.select(*tile, F.ceil(F.col("_n") / most).cast("int").alias("blocks"))
    blocked = placed.join(sizes, tile).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(*tile, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n", "long")


def _matrices(words: list[str], long: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as bytes (their code points are below 256), and as rows padded at the end and at the beginning."""
    told = np.array([w.encode("latin-1") for w in words], f"S{m + 1}")
    left = told.view(np.uint8).reshape(-1, m + 1)
    right = left.copy()
    right[~long, 1:], right[~long, 0] = left[~long, :m], 0
    return told, left, right


def one_edit(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, long: np.ndarray, m: int, half: np.ndarray) -> np.ndarray:
    """Which pairs of rows (a of length m, b of length m or m + 1) are one edit apart; half: those that must not share the first
    m // 2 code points."""
    same, size = left[a] == left[b], np.where(long[b], m + 1, m)
    same[:, m] = False
    first = np.argmin(same, axis=1)
    same = right[a] == right[b]
    same[:, 0] = False
    last = np.argmin(same[:, ::-1], axis=1)
    return (np.minimum(first, m) + np.minimum(last, m) >= size - 1) & ~(half & (first >= m // 2))


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places a < b within runs of the given sizes."""
    n = int(sizes.sum())
    end = np.repeat(np.cumsum(sizes), sizes)
    after = end - np.arange(n) - 1
    a = np.repeat(np.arange(n), after)
    b = np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after) + a + 1
    return a, b


def _compare(tile: np.ndarray, words: list[str], n: np.ndarray, long: np.ndarray, block: np.ndarray, across: np.ndarray, last_half: np.ndarray, m: int) -> list[dict]:
    """What whole tiles of one m, one after another, find."""
    told, left, right = _matrices(words, long, m)
    begins = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    sizes = np.diff(np.append(begins, len(tile)))
    near_a, near_b = [], []
    most, k = max(1, CHUNK_BYTES // (m + 1)), 0
    upto = np.cumsum(sizes * (sizes - 1) // 2)
    while k < len(sizes):
        done = upto[k - 1] if k else 0
        e = max(k + 1, int(np.searchsorted(upto, done + most, "right")))
        a, b = _pairs(sizes[k:e])
        a, b = a + begins[k], b + begins[k]
        # One of a pair has length m; blocks that are not the same one are compared across.
        wanted = ~(long[a] & long[b]) & (~across[a] | (block[a] != block[b]))
        a, b = a[wanted], b[wanted]
        a, b = np.where(long[a], b, a), np.where(long[a], a, b)
        for at in range(0, len(a), most):
            x, y = a[at : at + most], b[at : at + most]
            found = one_edit(left, right, x, y, long, m, last_half[x])
            near_a.append(x[found])
            near_b.append(y[found])
        k = e
    a, b = np.concatenate(near_a + near_b or [[]]).astype(int), np.concatenate(near_b + near_a or [[]]).astype(int)
    order = np.lexsort((told[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
    counts = np.diff(np.append(first, len(a)))
    return [{"word": words[a[f]], "n_near": int(c), "best_n": int(n[b[f]]), "best": words[b[f]]} for f, c in zip(first, counts, strict=True)]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles come in order, those of one m together; a tile that goes on in the next batch waits for it."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def tell(rows: pa.Table) -> pa.RecordBatch:
        m = rows.column("m").to_numpy()
        out = []
        names = [rows.column(c) for c in _TILE]
        ids = np.unique(np.array([f"{s}|{h}|{i}|{j}" for s, h, i, j in zip(*(c.to_pylist() for c in names[1:]), strict=True)], object), return_inverse=True)[1] if len(rows) else m
        words, n, block = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("block").to_numpy()
        long = rows.column("long").to_numpy(zero_copy_only=False)
        across = rows.column("i").to_numpy() != rows.column("j").to_numpy()
        last_half = np.array([s == "last" for s in rows.column("side").to_pylist()], bool)
        for k in np.unique(m).tolist():
            a, b = np.searchsorted(m, k), np.searchsorted(m, k, "right")
            out += _compare(ids[a:b], words[a:b], n[a:b], long[a:b], block[a:b], across[a:b], last_half[a:b], k)
        return pa.RecordBatch.from_pylist(out, schema)

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        last = [rows.column(c)[-1].as_py() for c in _TILE]
        at = len(rows) - 1
        while at and [rows.column(c)[at - 1].as_py() for c in _TILE] == last:
            at -= 1
        held = rows.slice(at)
        if at:
            yield tell(rows.slice(0, at).combine_chunks())
    if held is not None:
        yield tell(held.combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n of every word (word, n) that has near words: their number and the most frequent of them, of
    equal ones the first in code-point order."""
    bounded_batches(words.sparkSession)
    tiles = _tiles(words).repartition(*_TILE).sortWithinPartitions(*_TILE)
    found = tiles.mapInArrow(_near, _FOUND)
    best = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", "b.best_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to their ends."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        further = cut(now.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        now = further.drop("_moved")
        if not further.filter("_moved").head(1):
            return now


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n): its form is the most frequent near word, if that occurs
    twice as often as the word or more; its root is the last of its forms."""
    with short_lived_shuffles(words.sparkSession):
        all_words = cut(words.select("word", "n"))
        told = cut(all_words.join(near_words(all_words), "word", "left"))
        is_form = F.col("best_n") >= 2 * F.col("n")
        told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
        roots = _roots(told.filter("form is not null"))
        out = told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return out.select("word", "form", "root", "n", "n_near", "form_n")
