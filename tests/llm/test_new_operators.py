"""Spelling variants, the trie of conversations and repeats of word sequences, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, prefix_trie, substrings, variants

SF = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_trie", "op13_substring_dedup"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/{sf}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, df.select(*names).collect())) == sorted(map(key, want.fetchall()))


# Variants


def words_of(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_of(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def grouped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(df).collect()}


def test_dense_vocabulary(spark, monkeypatch):
    """Few letters, so that most words have many near words and tiles have several blocks; ties of frequency; chains of forms."""
    monkeypatch.setattr(variants, "BLOCK_WORDS", 7)
    rng = random.Random(5)
    n = {}
    for _ in range(500):
        n["".join(rng.choice("abé") for _ in range(rng.randint(5, 8)))] = rng.choice([3, 4, 6, 12, 12, 25, 50, 100, 400])
    n |= {"a" * 300: 9, "a" * 299 + "b": 3, "a" * 301: 40}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert grouped(df) == groups_of(n)
    assert grouped(df.limit(0)) == {}


def test_altered_words_of_odd_rows(spark):
    rows = [(1, "Straße STRASSE strasse ÀÉÎ àéî naïve×naïve"), (1, "Straße STRASSE strasse ÀÉÎ àéî naïve×naïve"), (2, None), (3, ""), (None, "lonely lonely lonely word1word"), (4, "x" * 50_000 + " " + "over " * 30_000), (5, "東京 привет")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("raw", "id", "run", "word", "n", "m", "side")})
    assert {r.word: r.n for r in variants.altered_words(df).collect()} == words_of(rows)
    assert variants.altered_words(df.limit(0)).collect() == []


# Conversations


def trie_of(paths, tokens):
    members, kids = defaultdict(set), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (tokens(k[-1]) if k else 0) + sum(saved[x] for x in kids[k])
    sha = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k)).encode()).hexdigest()
    return {(min(m), len(k)): (min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(k, m)) for k, m in members.items()}


def nodes_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_across_shards(spark, monkeypatch):
    """Copies and long common prefixes on both sides of every cut, ends in several pieces."""
    monkeypatch.setattr(prefix_trie, "ENDS", 5)
    rng = random.Random(2)
    digest = [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(4)]
    stem = tuple(rng.choice(digest) for _ in range(40))
    paths = {}
    for c in rng.sample(range(-500, 5000), 700):
        paths[c] = rng.choice([stem, stem[: rng.randint(0, 40)], stem[: rng.randint(0, 40)] + (rng.choice(digest),), tuple(rng.choice(digest) for _ in range(rng.randint(0, 4)))])
    rows = [(c, "".join(p), [digest.index(x) + 1 for x in p]) for c, p in paths.items()]
    df = spark.createDataFrame(rows, "conv_id long, path string, tokens array<long>")
    key, n = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nodes_of(prefix_trie.trie(df))
    finally:
        spark.conf.set(key, n)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == trie_of(paths, lambda d: digest.index(d) + 1)


def test_trie_of_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (1, 5, "user", " \t"), (19, 0, "user", ""), (20, 0, "user", "x"), (21, 1, "user", "y"), (None, 1, "user", "lost"),
        (-3, 2, "user", "z"), (45, 0, "user", "word " * 20_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("path", "tokens", "h", "key", "family", "head")})
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        paths[c] = tuple(own.get(head, [])[:h] + turns[h:])
    got = nodes_of(prefix_trie.trie(prefix_trie.rebuilt(df)))
    assert got == trie_of(paths, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t[1])))
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).collect() == []


# Repeats


def removed(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_of_few_words(spark):
    """Runs, periods and copies of parts, with repeated and missing ids, over any number of blocks."""
    rng = random.Random(5)
    some, rows = [f"W{i}" for i in range(5)] + ["w1"], []
    for i in range(240):
        words = [rng.choice(some) for _ in range(rng.randint(0, 160))]
        if i % 5 == 1:
            words = ["a"] * rng.randint(40, 130) + words[:20] + ["b"] * rng.randint(40, 70)
        if i % 5 == 2:
            source = rng.choice(rows)[1].split()
            at = rng.randint(0, len(source))
            words = words[:30] + source[at : at + rng.randint(45, 90)] + words[30:60]
        if i % 5 == 3:
            words = rng.choice(rows)[1].split()
        if i % 5 == 4:
            words = (["x", "y"] * 60)[: rng.randint(30, 120)] + words
        rows.append((rng.randint(-50, 200), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(None, rows[3][1]), (7, None), (8, ""), (9, " \n"), rows[8], rows[8], (1 << 62, rows[11][1]), (-(1 << 62), rows[16][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("block", "bucket", "names", "kind", "low")})
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(df).collect()), key=str)
    assert got == removed(rows)
    assert substrings.without_repeats(df.limit(0)).collect() == []


def test_long_text(spark):
    words = [f"w{i % 9973}" for i in range(300_000)]
    rows = [(1, " ".join(words[1000:1100])), (2, " ".join(words))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (100, 0), 2: (300_000, 100 * sum(1 for k in range(31) if 1000 + 9973 * k + 100 <= 300_000))}


def test_equal_windows_have_equal_symbols():
    """Whatever stands around a window, the symbols that it decides on are the same."""
    rng = np.random.default_rng(1)
    for size in (2, 3, 50):
        window = rng.integers(0, size, 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seen = set()
        for _ in range(20):
            a, b = (rng.integers(0, size, rng.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            name, low, high = substrings.symbols(np.concatenate((a, window, b)), np.zeros(len(a) + 50 + len(b), np.int64))
            inside = (low >= len(a)) & (high <= len(a) + 50)
            seen.add(tuple(zip(name[inside].tolist(), (low[inside] - len(a)).tolist(), (high[inside] - len(a)).tolist(), strict=True)))
        assert len(seen) == 1
