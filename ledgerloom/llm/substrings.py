"""Long word sequences that repeat across documents, by recompression.

Every text is compressed in LEVELS rounds, each of two steps: a run of equal symbols becomes one symbol, then a left symbol
and the right symbol behind it become one (a hash of its name and the round makes a symbol left or right). A new symbol's
name is a hash of what it stands for, so all documents, wherever they are, give the same runs and pairs the same names
without asking each other. With each symbol goes its context: the words that decided that it is there. So wherever the
words of a window of 50 stand, they hold the same symbols whose contexts lie in the window.

Three Spark rounds then settle what repeats:

1. names: which symbols stand in documents of different ids. A window of which one symbol doesn't can't repeat.
2. windows: the others, by a 128-bit hash of their 50 words (windows without any symbol of their own are among them): the
   least doc_id that holds each.
3. texts: the words of windows whose least doc_id is smaller than the document's own go.

Documents are hashed into blocks of about BLOCK_BYTES. A block sends each of its distinct names and windows once, with the
least and greatest doc_id that hold it there, packed by ranges of the hash; a passage in a third of all documents is one
entry a block. Answers are a bit for each name and one number for each window that goes. No pairs of documents are made.

Edge cases: null and empty texts have no words (n_words 0, the hash of the empty text); documents under 50 words lose
nothing; a null doc_id is compared with nothing and loses nothing; rows of one doc_id don't remove each other's words; equal
rows have equal results and share a block; a text of any length is processed whole, within one task's memory (about 200 bytes
a word); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import cut, short_lived_shuffles
from ledgerloom.llm._text import AS_IS, U64, mix, slices, words

WINDOW = 50
#: Rounds of compression: symbols then stand for 4 to 5 words, with contexts of about 20.
LEVELS = 5
BLOCK_BYTES = 8 << 20
#: Bytes of text whose entries make a bucket.
BUCKET_BYTES = 64 << 20
_A, _B = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
#: What makes a symbol's side another one in each round.
_ROUNDS = mix(np.arange(1, LEVELS + 1, dtype=U64) * _A)

_NAMES = "bucket long, block long, names binary, low binary, span binary"
_WINDOWS = "bucket long, block long, first binary, second binary, low binary, span binary"
_ANSWER = "block long, kind int, bucket long, bits binary, least binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def symbols(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, low, high) of the symbols after all rounds: low and high bound the words that decided on a symbol. row: the
    text of each word; nothing joins words of two texts, and a text's first and last symbol depend on words outside it."""
    name, first, last = hashes, np.arange(len(hashes)), np.arange(1, len(hashes) + 1)
    low, high = first, last
    for level in range(LEVELS):
        # Runs: that a run ends depends on its neighbours.
        begins = np.ones(len(name), bool)
        begins[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        i = np.flatnonzero(begins)
        j = np.append(i[1:], len(name)) - 1
        opens, closes = _edges(row[i])
        run_low, run_high = low[np.maximum(i - 1, 0)], high[np.minimum(j + 1, len(name) - 1)]
        low, high = np.where(opens, first[i] - 1, run_low), np.where(closes, last[j] + 1, run_high)
        size = (j - i + 1).astype(U64)
        name = np.where(size > 1, mix(name[i] * _B + size), name[i])
        first, last, row = first[i], last[j], row[i]
        # Pairs: that a symbol stays alone depends on the one that it could have joined.
        right = (mix(name + _ROUNDS[level]) >> U64(63)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        before, after = np.where(opens, first - 1, np.roll(low, 1)), np.where(closes, last + 1, np.roll(high, -1))
        alone_low, alone_high = np.where(right, np.minimum(low, before), low), np.where(right, high, np.maximum(high, after))
        i = np.flatnonzero(~second)
        p = pair[i]
        j = i + p
        name = np.where(p, mix(mix(name[i] * _A + name[j]) + _ROUNDS[level]), name[i])
        low, high = np.where(p, low[i], alone_low[i]), np.where(p, high[j], alone_high[i])
        first, last, row = first[i], last[j], row[i]
    return name, low, high


def _edges(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a symbol is the first, the last of its text."""
    opens, closes = np.ones(len(row), bool), np.ones(len(row), bool)
    opens[1:] = row[1:] != row[:-1]
    closes[:-1] = opens[1:]
    return opens, closes


def windows(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the 50 words from each of the given places on."""
    out = []
    for factor in (_A, _B):
        h = {1: hashes}
        for k in (1, 2, 4, 8, 16):
            h[2 * k] = mix(h[k][: max(0, len(h[k]) - k)] * factor + h[k][k:])
        x = mix(h[32][at] * factor + h[16][at + 32])
        out.append(mix(x * factor + h[2][at + 48]))
    return out[0], out[1]


class _Slice:
    """The words of some texts, and the symbols whose contexts fit into a window."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs, self.ids = raw, offs, ids
        _, _, self.hashes, self.at = words(raw, offs, AS_IS)
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.at))
        name, low, high = symbols(self.hashes, self.row)
        fits = (high - low <= WINDOW) & (low >= 0) & (high <= len(self.row))
        fits[fits] = (self.row[low[fits]] == self.row[high[fits] - 1]) & known[self.row[low[fits]]]
        self.name, self.low, self.high = name[fits], low[fits], high[fits]
        left = np.repeat(self.at[1:], np.diff(self.at)) - np.arange(len(self.hashes))
        self.whole = (left >= WINDOW) & known[self.row]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Places of the windows all of whose symbols are shared."""
        n = len(self.hashes)
        low, high = self.low[~shared], self.high[~shared]
        step = np.bincount(np.maximum(high - WINDOW, 0), minlength=n + 1) - np.bincount(low + 1, minlength=n + 1)
        return np.flatnonzero(self.whole & (np.cumsum(step)[:n] == 0))


class _Block:
    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        self.ids, self.known, self.slices = number, known, []
        for a, b, raw, offs in slices(docs.column("text")):
            self.slices.append((a, b, _Slice(number[a:b], known[a:b], raw, offs)))
        owners = [s.ids[s.row[s.low]] for _, _, s in self.slices]
        (self.name,), self.of, self.name_low, self.name_high = _gather([(s.name,) for _, _, s in self.slices], owners, owners)

    def window_keys(self, shared: np.ndarray) -> None:
        """Finds the candidates: windows all of whose names are shared (a flag for each distinct name)."""
        end, self.places, keys, owners = 0, [], [], []
        for _, _, s in self.slices:
            begin, end = end, end + len(s.name)
            at = s.candidates(shared[self.of[begin:end]])
            self.places.append(at)
            keys.append(windows(s.hashes, at) if len(at) else (np.zeros(0, U64), np.zeros(0, U64)))
            owners.append(s.ids[s.row[at]])
        self.key, self.key_of, self.key_low, self.key_high = _gather(keys, owners, owners)


def _gather(
    parts: list[tuple[np.ndarray, ...]], least: list[np.ndarray], greatest: list[np.ndarray]
) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the number of each given key among them, and the least and greatest number that goes with each."""
    columns = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    n, ordered = len(order), [x[order] for x in columns]
    begins = np.ones(n, bool)
    begins[1:] = np.any([x[1:] != x[:-1] for x in ordered], axis=0)
    at = np.flatnonzero(begins)
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(begins) - 1
    low, high = (f.reduceat(np.concatenate(x)[order], at) if n else np.zeros(0, np.int64) for f, x in ((np.minimum, least), (np.maximum, greatest)))
    return tuple(x[at] for x in ordered), of, low, high


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of the key range begin among the ordered keys."""
    return np.searchsorted(((keys >> U64(32)) * U64(buckets)) >> U64(32), np.arange(buckets + 1, dtype=U64))


def _packed(block: int, buckets: int, columns: dict[str, np.ndarray], schema: str) -> pa.Table:
    """A row for each bucket that has keys; the first column is the key."""
    bounds = _ranges(next(iter(columns.values())), buckets)
    rows = [
        {"bucket": b, "block": block} | {c: x[bounds[b] : bounds[b + 1]].tobytes() for c, x in columns.items()}
        for b in np.flatnonzero(np.diff(bounds)).tolist()
    ]
    return pa.Table.from_pylist(rows, _arrow(schema))


def _ask_names(buckets: int):
    def ask(key: tuple, docs: pa.Table) -> pa.Table:
        b = _Block(docs)
        return _packed(key[0].as_py(), buckets, {"names": b.name, "low": b.name_low, "span": b.name_high - b.name_low}, _NAMES)

    return ask


def _answers(columns: tuple[str, ...], kind: int):
    """For a bucket: whether each key is held by different documents (kind 0), or by a smaller one than the greatest that holds
    it in the asking block, and then the smallest (kind 1)."""

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(x.as_py(), t) for x in asked.column(c)]
        keys, low, span = [get(c, U64) for c in columns], get("low", np.int64), get("span", np.int64)
        ends, high = np.cumsum([len(x) for x in low]), [x + y for x, y in zip(low, span, strict=True)]
        _, of, least, greatest = _gather(list(zip(*keys, strict=True)), low, high)
        told = (least < greatest)[of] if kind == 0 else least[of] < np.concatenate(high)
        rows = []
        for block, end, n in zip(asked.column("block"), ends, np.diff(ends, prepend=0), strict=True):
            mine = slice(end - n, end)
            if told[mine].any():
                row = {"block": block.as_py(), "kind": kind, "bucket": key[0].as_py(), "bits": np.packbits(told[mine]).tobytes()}
                rows.append(row | {"least": least[of[mine]][told[mine]].tobytes() if kind else None})
        return pa.Table.from_pylist(rows, _arrow(_ANSWER))

    return answer


def _told(answers: list[dict], kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The flags of a block's keys, and the least doc_id of each flagged one."""
    bounds, flags, least = _ranges(keys, buckets), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    for row in answers:
        if row["kind"] == kind:
            a, b = bounds[row["bucket"]], bounds[row["bucket"] + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a).astype(bool)
            if kind:
                least[a:b][flags[a:b]] = np.frombuffer(row["least"], np.int64)
    return flags, least


def _ask_windows(buckets: int):
    def ask(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _arrow(_WINDOWS).empty_table()
        b = _Block(docs)
        b.window_keys(_told(answers.to_pylist(), 0, b.name, buckets)[0])
        first, second = b.key
        return _packed(key[0].as_py(), buckets, {"first": first, "second": second, "low": b.key_low, "span": b.key_high - b.key_low}, _WINDOWS)

    return ask


def _sha(found: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(found)).hexdigest()


def _remove(buckets: int):
    def remove(_key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _arrow(_OUT).empty_table()
        b, told = _Block(docs), answers.to_pylist()
        b.window_keys(_told(told, 0, b.name, buckets)[0])
        goes, least = _told(told, 1, b.key[0], buckets)
        end, out = 0, []
        for (a, _, s), places in zip(b.slices, b.places, strict=True):
            begin, end = end, end + len(places)
            key = b.key_of[begin:end]
            at = places[goes[key] & (least[key] < s.ids[s.row[places]])]
            n = len(s.hashes)
            step = np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1)
            kept = np.cumsum(step)[:n] == 0
            before = np.concatenate(([0], np.cumsum(~kept)))
            removed = before[s.at[1:]] - before[s.at[:-1]]
            for i, gone in enumerate(removed.tolist()):
                found = s.raw[s.offs[i] : s.offs[i + 1]].tobytes().split()
                if gone:
                    sha = _sha(list(compress(found, kept[s.at[i] : s.at[i + 1]].tolist())))
                else:
                    sha = _sha(found)
                out.append((int(s.ids[i]) if b.known[a + i] else None, len(found), gone, sha))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _arrow(_OUT), strict=True)], schema=_arrow(_OUT))

    return remove


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs: its words but for those of windows of 50 words that also
    stand in a document with a smaller doc_id."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = max(size // BLOCK_BYTES + 1, tasks), max(size // BUCKET_BYTES + 1, tasks)
    blocked = base.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)))
    with short_lived_shuffles(spark):
        asked = blocked.groupBy("block").applyInArrow(_ask_names(buckets), _NAMES)
        names = cut(asked.groupBy("bucket").applyInArrow(_answers(("names",), 0), _ANSWER))
        asked = blocked.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_ask_windows(buckets), _WINDOWS)
        found = cut(asked.groupBy("bucket").applyInArrow(_answers(("first", "second"), 1), _ANSWER))
        answers = names.unionByName(found)
        return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(buckets), _OUT)
