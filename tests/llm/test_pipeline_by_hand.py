"""The quality scores and every stage of the pipeline against plain Python over whole tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from test_against_brute_force import SF, components, crc, shingles, split

import corpus_pipeline
from ledgerloom.llm import catalog, decontaminate, pii, quality

STOPS, SPACES = set(b".,;:?!'\"()-"), set(b" \t\n\x0b\x0c\r")


def described(text):
    """The statistics of quality.FEATURES, in plain Python."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    w, lines, n = split(text), raw.split(b"\n"), len(raw)
    upper, low = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    digit, stop, space, beyond = (sum(map(f, raw)) for f in (lambda b: 48 <= b <= 57, STOPS.__contains__, SPACES.__contains__, lambda b: b > 127))
    x = [np.log1p(n), 0, upper / (upper + low) if upper + low else 0, digit / n, stop / n]
    x += [(n - upper - low - digit - stop - space - beyond) / n, space / n, beyond / n, 0, 0, 0, len(set(lines)) / len(lines)]
    x += [np.log1p(len(w) / len(lines)), 0, 0]
    if w:
        sizes, four = [len(v.encode()) for v in w], [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
        x[1], x[8], x[9] = np.log1p(np.mean(sizes)), len(set(w)) / len(w), max(Counter(w).values()) / len(w)
        x[10] = np.mean([a == b for a, b in zip(w, w[1:], strict=False)]) if len(w) > 1 else 0
        x[13], x[14] = 1 - len(set(four)) / len(four) if four else 0, np.mean([s > 16 for s in sizes])
    return [float(v) for v in x]


def scored(docs, labels):
    """Scores of docs (id -> text) from labels (id -> quality) outside the held-out fold."""
    x = {i: described(t) for i, t in docs.items()}
    known = {i: y for i, y in labels.items() if i in docs and crc(i, 3) != 1}
    every = np.array([x[i] for i in known])
    # The draws of the cosines are a parameter; all that is done with them is done again here.
    draws = quality.Cosines(every.mean(0), np.maximum(every.std(0), 1e-6))

    def cosines(ids):
        z = np.clip((np.array([x[i] for i in ids]) - every.mean(0)) / np.maximum(every.std(0), 1e-6), -8, 8)
        return np.hstack([np.sqrt(2 / quality.COSINES) * np.cos(z @ draws.w + draws.phase), np.ones((len(z), 1))])

    holds = [i for i in known if zlib.crc32(str(i).encode()) // 3 % 4 == 0]
    trains = [i for i in known if i not in holds]
    z, y = cosines(trains), np.array([known[i] for i in trains], float)
    # Ridge as least squares with further rows, not as normal equations.
    grown = np.vstack([z, np.sqrt(quality.RIDGE * len(z)) * np.eye(z.shape[1])])
    beta = np.linalg.lstsq(grown, np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    raw = lambda ids: np.clip(cosines(ids) @ beta, -0.5, 1.5)
    r, bins = raw(holds), {}
    for value, i in zip(r, holds, strict=True):
        bins.setdefault(int((value + 0.5) / 2 * (quality.BINS - 1)), []).append((value, known[i]))
    cells = [np.array(bins[b], float) for b in sorted(bins)]
    at, n, means = [c[:, 0].mean() for c in cells], [len(c) for c in cells], [c[:, 1].mean() for c in cells]
    k = range(len(cells))
    # Isotonic means by their min-max formula, not by pooling.
    mean = lambda a, b: np.average(means[a : b + 1], weights=n[a : b + 1])
    fitted = [max(min(mean(a, b) for b in k[i:]) for a in k[: i + 1]) for i in k]
    ids = list(docs)
    return dict(zip(ids, np.interp(raw(ids), at, fitted), strict=True))


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_quality_by_hand(spark, tables):
    docs, labels, _ = tables
    want = scored(docs, labels)
    got = {r.doc_id: r.score for r in catalog.op5_quality(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6


def leaked(text, items):
    words = {w: n for n, w in enumerate(set(split(text)).union(*map(split, items)))}
    of = lambda t: np.array([words[w] for w in split(t)], np.int64)
    return any(decontaminate.align(of(q), of(text))[0] >= 0.5 * 2 * len(split(q)) for q in items if split(q) and split(text))


def test_pipeline_by_hand(spark, tables, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items = tables
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == columns
            rows = now.collect()
            kept[name] = {r.doc_id: r.text or "" for r in rows}
            assert len(rows) == len(kept[name])
    score = scored(docs, labels)
    assert kept["quality"] == {i: t for i, t in docs.items() if score[i] >= 0.5}
    of = components({i: shingles(t, 5) for i, t in kept["quality"].items()}, 80)
    assert kept["near_duplicates"] == {i: t for i, t in kept["quality"].items() if of[i] == i}
    assert kept["decontamination"] == {i: t for i, t in kept["near_duplicates"].items() if not leaked(t, items)}
    assert len(kept["decontamination"]) < len(kept["near_duplicates"]) < len(kept["quality"]) < len(docs)
    pattern = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()))

    def personal(text):
        kinds = ((next(k for k in pii.PATTERNS if m.group(k) is not None), m[0]) for m in pattern.finditer(text))
        return any(pii.entities_of(kind, found) for kind, found in kinds)

    before, after = kept["decontamination"], kept["pii"]
    assert before.keys() == after.keys()
    assert {i for i in before if before[i] != after[i]} == {i for i in before if personal(before[i])} != set()
    encode, want = Tokenizer.from_file(catalog.tokenizer_path()), set()
    for i, text in after.items():
        ids = [*encode.encode(text, add_special_tokens=False).ids, 2]
        start = 0
        while start < len(ids):
            end = start + (len(ids) % 1024 or 1024 if start == 0 else 1024)
            want.add((i, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start = end
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(now) == sorted(want) == pieces(corpus_pipeline.run(spark, SF))
