"""Best-fit packing with exact-complement hashing.

Documents become token ids; documents longer than a sequence are cut into full pieces behind a first, shorter one. The
number of pieces of every length (a table of at most ``seq_len`` rows) decides the plan: for the longest piece left, a
single, pair or triple of lengths that exactly fills the gap is taken, as often as the availability counts allow; what
remains is packed best-fit, longest first. Pieces are then ranked among those of their length, in salted groups, and the
rank picks the sequence and offset, so no task ever holds a whole length.

Texts of any kind and length are encoded whole, also long runs of one character.

Edge cases: null text is empty, so only the end token; an empty table gives no rows; repeated ids give pieces of their
own; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._spark import cut

SEQ_LEN, END_ID = 1024, 2
#: Pieces that one window group ranks, about; and groups at most, besides one for each length.
GROUP_ROWS, GROUPS = 250, 200_000
#: Characters in a row, all white space or none, from which on a text goes to tokenizers itself.
LONG = 5000
_BLANK = re.compile(rf"\s{{{LONG}}}")
#: Where two libraries may part, if anywhere.
_PROBE = "It's  Über-\n\n 12 ½ can't漢字 <|endoftext|>\u00a0x\u2003\u0301é \x1c\x85'll٣ 🙂🙂  "
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The ids that tokenizers gives by a byte-level BPE file. tiktoken runs the file's own vocabulary at about three times
    the speed and gives the same ids; texts with long runs of one kind, which it can't take, go to tokenizers itself, and so
    do all if it should differ on a probe."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The reversible byte-to-character table of byte-level BPE: printable bytes stand for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spell = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(spell[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.alike = self.fast.encode(_PROBE, allowed_special="all") == self.by_tokenizers(_PROBE)

    def by_tokenizers(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        long_ = len(text) >= LONG and (_BLANK.search(text) or max(map(len, text.split()), default=0) >= LONG)
        if long_ or not self.alike:
            return np.array(self.by_tokenizers(text), np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        # A worker is one process of many on its machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids (array<int>) for the pieces of every document."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                first = len(ids) % seq_len or seq_len
                ends = range(min(first, len(ids)), len(ids) + 1, seq_len)
                start = 0
                for piece, end in enumerate(ends):
                    part = ids[start:end]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(end - start)
                    rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        rows["ids"].append(part.astype(np.int32))
                    start = end
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            if keep_ids:
                kinds["ids"] = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_up, schema)


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences), using up counts (length -> pieces)."""
    left = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        """As many sequences of these lengths as the counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                left[x] -= n * k
            out.append((lengths, n))

    def pair_sums(total: int) -> np.ndarray:
        """The greater lengths of available pairs that sum to total, greatest first."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        return a[(left[a] > 0) & (left[total - a] > 0)] if total >= 2 else a[:0]

    take(seq_len)
    for length in range(seq_len - 1, 0, -1):
        gap = seq_len - length
        if left[length]:
            take(length, gap)
        for a in pair_sums(gap) if left[length] else ():
            take(length, int(a), gap - int(a))
            if not left[length]:
                break
        for a in range(gap - 2, 0, -1) if left[length] else ():
            if left[a] and left[length]:
                for b in pair_sums(gap - a):
                    take(length, a, int(b), gap - a - int(b))
                    if not left[length] or not left[a]:
                        break
    # Best fit: groups of equal open sequences by the gap that they leave.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(seq_len, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g, x in open_.items() if g >= length and x), default=None)
            if gap is None:
                each = seq_len // length
                full, rest = divmod(n, each)
                if full:
                    open_.setdefault(seq_len - each * length, []).append(((length,) * each, full))
                if rest:
                    open_.setdefault(seq_len - rest * length, []).append(((length,) * rest, 1))
                n = 0
            else:
                lengths, there = open_[gap].pop()
                used = min(there, n)
                if there > used:
                    open_[gap].append((lengths, there - used))
                open_.setdefault(gap - length, []).append(((*lengths, length), used))
                n -= used
    return out + [x for groups in open_.values() for x in groups]


def place(cut_pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """cut_pieces with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Ranks of a length, in order, go to slots; a global position is the length's base plus the rank.
    base = np.zeros(seq_len + 2, np.int64)
    for length in range(1, seq_len + 1):
        base[length + 1] = base[length] + counts.get(length, 0)
    given = base.copy()
    slots: list[tuple[int, int, int]] = []
    sequence = 0
    for lengths, n in plan(counts, seq_len):
        offset = 0
        for x in lengths:
            slots.append((int(given[x]), sequence, offset))
            given[x] += n
            offset += x
        sequence += n
    slots.sort()
    begins, sequences, offsets = (np.array(x, np.int64) for x in (zip(*slots, strict=True) if slots else ([], [], [])))

    # A length that many pieces have is ranked in as many groups as its counted pieces need.
    group_rows = max(GROUP_ROWS, sum(counts.values()) // GROUPS)
    groups = F.get(F.array(*(F.lit(counts.get(x, 0) // group_rows + 1) for x in range(seq_len + 1))), F.col("length").cast("int"))
    salted = cut_pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        salted.groupBy("length", "_salt")
        .count()
        .select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "_salt"])
        .withColumn("sequence_id", F.col("_before") + F.col("_rank"))
        .drop("_salt", "_rank", "_before")
        .withColumn("offset", F.lit(0).cast("long"))
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = base[batch.column("length").to_numpy()] + batch.column("sequence_id").to_numpy()
            i = np.searchsorted(begins, at, "right") - 1
            new = {"sequence_id": sequences[i] + at - begins[i], "offset": offsets[i]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[x]) if x in new else batch.column(x) for x in batch.schema.names], names=batch.schema.names
            )

    return ranked.mapInArrow(assign, ranked.schema)


def pack(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places. Token ids are not carried along; pieces(keep_ids=True) has them."""
    return place(cut(pieces(docs, path, seq_len, end_id)), seq_len)
