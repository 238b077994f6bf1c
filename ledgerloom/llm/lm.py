"""Language-model scoring by deleted interpolation.

A token's probability is ``l2 * c(ctx, w) / c(ctx) + l1 * c(w) / N + l0 / (V + 1)``: maximum-likelihood estimates of the
bigram and the unigram and a uniform share over the V known words and one class of all others. The weights belong to the
bucket of the context's frequency (powers of two) and come from expectation-maximisation on the counts of training
documents held back from the first estimate (fold ``EM_FOLD``); the final estimates use all training documents.

Counting and scoring in blocks: documents are hashed into blocks of about BLOCK_BYTES of text. A block counts its own
distinct n-grams and sends them, one packed row for each bucket of the key range, so a frequent n-gram arrives once from
every block and no key is hot. A bucket adds up what the blocks sent and answers only for n-grams that several blocks
have; for all others a block's own count is the whole count. Nothing of the model passes through the driver but N, V and
a histogram of bounded size for the expectation-maximisation.

Edge cases: null and empty texts are one end token; a null doc_id is in fold crc32('') mod 7; no training documents give
a uniform model; repeated rows count as often as they occur; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import cut, short_lived_shuffles
from ledgerloom.llm._text import U64, mix, slices, words

FOLDS, OUT_FOLD, EM_FOLD = 7, 2, 5
BLOCK_BYTES = 8 << 20
#: Context-frequency buckets: 0 for unseen contexts, then powers of two.
BUCKETS = 32
#: The histogram's cells are quarter octaves of c(w) and of p2; a cell keeps the sums of what falls into it.
_STEPS = 200
START, END = U64(0x5354415254), U64(0x454E44)
_LOW48 = U64((1 << 48) - 1)

_ASK = "bucket int, block long, uni binary, uni_kept binary, uni_held binary, bi binary, bi_kept binary, bi_held binary"
_ANSWER = (
    "block long, bucket int, uni_at binary, uni_kept binary, uni_held binary, bi_at binary, bi_kept binary, bi_held binary, "
    "v long, v_kept long, n long, n_kept long"
)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


class _Block:
    """The tokens of a block, its distinct n-grams and their counts within the block."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id")
        column = table.column("text")
        w, lengths = [], []
        for _, _, raw, offs in slices(column):
            _, _, hashes, at = words(raw, offs)
            n = np.diff(at)
            end = np.cumsum(n + 1) - 1
            tokens = np.empty(len(hashes) + len(n), U64)
            inside = np.ones(len(tokens), bool)
            inside[end] = False
            tokens[inside], tokens[end] = hashes, END
            w.append(tokens)
            lengths.append(n + 1)
        self.lengths = np.concatenate(lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        w = np.concatenate(w)
        role = table.column("role").to_numpy().astype(np.int8)  # 0: scored only, 1: kept, 2: held back
        of_token = np.repeat(role, self.lengths)
        context = np.empty_like(w)
        context[1:] = w[:-1]
        context[self.first] = START
        bigram = mix(context * U64(0xC2B2AE3D27D4EB4F) + w)
        self.held = of_token == 2
        self.uni, inverse = np.unique(np.concatenate((w, np.full(len(role), START))), return_inverse=True)
        roles = np.concatenate((of_token, role))
        self.word = inverse[: len(w)]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = np.searchsorted(self.uni, START)
        self.uni_kept, self.uni_held = (np.bincount(inverse[roles == r], minlength=len(self.uni)) for r in (1, 2))
        self.bi, self.pair = np.unique(bigram, return_inverse=True)
        self.bi_kept, self.bi_held = (np.bincount(self.pair[of_token == r], minlength=len(self.bi)) for r in (1, 2))

    def bounds(self, kind: str, buckets: int) -> np.ndarray:
        """Where the buckets of the key range begin among the sorted keys."""
        of_key = ((getattr(self, kind) >> U64(32)) * U64(buckets)) >> U64(32)
        return np.searchsorted(of_key, np.arange(buckets + 1, dtype=U64))

    def learn(self, answers: pa.Table, buckets: int) -> None:
        """Replaces the block's counts by the whole corpus's."""
        at = {kind: self.bounds(kind, buckets) for kind in ("uni", "bi")}
        for row in answers.to_pylist():
            for kind in ("uni", "bi"):
                i = np.cumsum(_unpack(row[f"{kind}_at"])) + at[kind][row["bucket"]]
                for which in ("kept", "held"):
                    getattr(self, f"{kind}_{which}")[i] = _unpack(row[f"{kind}_{which}"])


def _pack(numbers: np.ndarray) -> bytes:
    """Small whole numbers, byte plane by byte plane, so that the many zeros take no room."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys & _LOW48).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _ask(buckets: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(table)
        uni, bi = block.bounds("uni", buckets), block.bounds("bi", buckets)
        rows = []
        for b in range(buckets):
            u, g = slice(uni[b], uni[b + 1]), slice(bi[b], bi[b + 1])
            if u.start < u.stop or g.start < g.stop:
                rows.append({
                    "bucket": b, "block": key[0].as_py(),
                    "uni": block.uni[u].tobytes(), "uni_kept": _pack(block.uni_kept[u]), "uni_held": _pack(block.uni_held[u]),
                    "bi": _pack48(block.bi[g]), "bi_kept": _pack(block.bi_kept[g]), "bi_held": _pack(block.bi_held[g]),
                })
        return pa.Table.from_pylist(rows, _arrow(_ASK))

    return ask


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    rows = [{"block": b.as_py(), "bucket": key[0].as_py()} for b in table.column("block")]
    stats = {"block": -1, "bucket": key[0].as_py()}
    for kind, unpack in (("uni", lambda x: np.frombuffer(x, U64)), ("bi", _unpack48)):
        parts = [unpack(x.as_py()) for x in table.column(kind)]
        counts = [np.concatenate([_unpack(x.as_py()) for x in table.column(f"{kind}_{w}")]) for w in ("kept", "held")]
        keys, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
        totals = [np.add.reduceat(x[order], first) if len(keys) else x for x in counts]
        if kind == "uni":
            real = ordered[first] != START
            stats |= {"v": int(((totals[0] + totals[1] > 0) & real).sum()), "v_kept": int(((totals[0] > 0) & real).sum())}
            stats |= {"n": int((totals[0] + totals[1])[real].sum()), "n_kept": int(totals[0][real].sum())}
        sizes = np.diff(np.append(first, len(keys)))
        run = np.repeat(np.arange(len(first)), sizes)
        several = np.zeros(len(keys), bool)
        several[order] = np.repeat(sizes > 1, sizes)
        run_of = np.empty(len(keys), np.int64)
        run_of[order] = run
        for i, (row, end) in enumerate(zip(rows, ends, strict=True)):
            begin = end - len(parts[i])
            at = np.flatnonzero(several[begin:end])
            row[f"{kind}_at"] = _pack(np.diff(at, prepend=0))
            for which, total in zip(("kept", "held"), totals, strict=True):
                row[f"{kind}_{which}"] = _pack(total[run_of[begin + at]])
    return pa.Table.from_pylist([*rows, stats], _arrow(_ANSWER))


def _context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(1 + np.log2(np.maximum(count, 1)).astype(np.int64), BUCKETS - 1), 0)


def _histogram(buckets: int, n_kept: int):
    def count(_key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = _arrow("cell long, n double, p1 double, p2 double")
        if not docs.num_rows:
            return schema.empty_table()
        block = _Block(docs)
        block.learn(answers, buckets)
        held = block.held
        c1, c2 = block.uni_kept[block.word[held]], block.bi_kept[block.pair[held]]
        context = block.uni_kept[block.context[held]]
        p1, p2 = c1 / max(n_kept, 1), c2 / np.maximum(context, 1)
        i1 = np.where(c1 > 0, 1 + np.minimum(4 * np.log2(np.maximum(c1, 1)), _STEPS - 2), 0).astype(np.int64)
        i2 = np.where(c2 > 0, 1 + np.minimum(-4 * np.log2(np.where(c2 > 0, p2, 1)), _STEPS - 2), 0).astype(np.int64)
        cell, inverse = np.unique((_context_bucket(context) * _STEPS + i1) * _STEPS + i2, return_inverse=True)
        sums = [np.bincount(inverse, x, len(cell)) for x in (np.ones(len(p1)), p1, p2)]
        return pa.Table.from_arrays([pa.array(cell), *map(pa.array, sums)], schema=schema)

    return count


def learn_weights(cells: list[tuple[int, float, float, float]], p0: float, rounds: int = 200) -> np.ndarray:
    """Weights (l2, l1, l0) for each context bucket by expectation-maximisation; cells: (cell, n, sum of p1, sum of p2)."""
    x = np.array(cells, np.float64).reshape(-1, 4)
    bucket, n = (x[:, 0] // (_STEPS * _STEPS)).astype(int), x[:, 1]
    parts = np.stack([x[:, 3] / np.maximum(n, 1), x[:, 2] / np.maximum(n, 1), np.full(len(x), p0)], 1)

    def fit(mine: np.ndarray, unseen: bool) -> np.ndarray:
        weights = np.array([0.0, 0.8, 0.2] if unseen else [0.1, 0.7, 0.2])
        for _ in range(rounds if n[mine].sum() else 0):
            share = parts[mine] * weights
            share *= (n[mine] / np.maximum(share.sum(1), 1e-300))[:, None]
            weights = share.sum(0) / share.sum()
        weights = np.maximum(weights, [0.0, 1e-9, 1e-6])
        return weights / weights.sum()

    seen = fit(bucket > 0, False)
    return np.stack([fit(bucket == b, b == 0) if b == 0 or n[bucket == b].sum() else seen for b in range(BUCKETS)])


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the counts."""

    n: int
    v: int
    weights: np.ndarray


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(buckets: int, model: Model):
    def score(_key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _arrow(_SCORES).empty_table()
        block = _Block(docs)
        block.learn(answers, buckets)
        uni, bi = block.uni_kept + block.uni_held, block.bi_kept + block.bi_held
        c1, c2, context = uni[block.word], bi[block.pair], uni[block.context]
        base = np.log10((c1 + 1) / (model.n + model.v + 1))
        weights = model.weights[_context_bucket(context)]
        p = weights[:, 0] * c2 / np.maximum(context, 1) + weights[:, 1] * c1 / max(model.n, 1) + weights[:, 2] / (model.v + 1)
        p = p if model.n else np.ones(len(p))
        by_doc = [np.add.reduceat(x, block.first) for x in ((c1 > 0).astype(np.int64), base, np.log10(p))]
        ids = block.ids.combine_chunks() if isinstance(block.ids, pa.ChunkedArray) else block.ids
        return pa.Table.from_arrays([ids, pa.array(block.lengths), *map(pa.array, by_doc)], schema=_arrow(_SCORES))

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.when(fold == OUT_FOLD, 0).when(fold == EM_FOLD, 2).otherwise(1).cast("int").alias("role"),
    )
    with short_lived_shuffles(spark):
        size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        blocks = size // BLOCK_BYTES + 1
        buckets = blocks // 2 + 8
        blocked = base.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)))
        asked = blocked.groupBy("block").applyInArrow(_ask(buckets), _ASK)
        answers = cut(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER))
        totals = answers.filter("block < 0").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("v", "v_kept", "n", "n_kept"))).first()
        to_blocks = answers.filter("block >= 0").select(*(x.split()[0] for x in _ANSWER.split(", ")[:8]))
        both = blocked.groupBy("block").cogroup(to_blocks.groupBy("block"))
        # At most BUCKETS * _STEPS * _STEPS cells, in practice a few thousand.
        cells = (
            both.applyInArrow(_histogram(buckets, totals["n_kept"]), "cell long, n double, p1 double, p2 double")
            .groupBy("cell")
            .agg(F.sum("n"), F.sum("p1"), F.sum("p2"))
            .collect()
        )
        model = Model(totals["n"], totals["v"], learn_weights([tuple(r) for r in cells], 1 / (totals["v_kept"] + 1)))
        scored = both.applyInArrow(_score(buckets, model), _SCORES)
        return scored.select(
            "doc_id",
            (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == OUT_FOLD).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(totals["n"]).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
