"""Every operator and stage on odd rows: nulls, empty and long texts, repeated rows, empty tables, clashing extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import catalog, chat, decontaminate, dedup, fingerprints, licenses, lm, packing, pii, quality, sharding

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today"),
    (1, "the quick brown fox jumps over the lazy dog again and again today"),
    (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one"),
    (7, LONG),
    (8, "x" * 20_000),
    (None, "a text without an id, but with mail to someone@mail.example.com"),
    (9, "naïve 東京 <|endoftext|> Ünïcödé text 192.168.10.20"),
    (-5, "Released under the MIT License."),
]
NAMES = "id key n node bucket rank score size shard slot region rack x y raw pos h text_crc32 codes k block role kinds n_entities length piece _id".split()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(3).cast("long")})
    return df.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit("clash").alias(n) for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog again"), (2, "quick brown fox jumps over the lazy dog again"), (3, None), (4, ""), (5, "one"), (None, "two words")],
        "item_id long, text string",
    )


def operators(odd, labels, benchmark):
    path = catalog.tokenizer_path()
    return {
        "fingerprints": lambda d: fingerprints.compare_with_edits(d),
        "licenses": lambda d: licenses.scan(d),
        "pii": lambda d: pii.replace(d),
        "lm": lambda d: lm.score_documents(d),
        "quality": lambda d: quality.score_documents(d, labels),
        "keep_good": lambda d: quality.keep_good(d, labels),
        "leaks": lambda d: decontaminate.leaks(d, benchmark),
        "without_leaks": lambda d: decontaminate.without_leaks(d, benchmark),
        "near_duplicates": lambda d: dedup.near_duplicates(d, k=2),
        "keep_one": lambda d: dedup.keep_one(d),
        "packing": lambda d: packing.pack(d, path),
        "sharding": lambda d: sharding.shard_documents(d),
    }


ONE_EACH = ("fingerprints", "pii", "lm", "quality", "near_duplicates", "sharding")


@pytest.mark.parametrize("name", sorted(operators(None, None, None)))
def test_odd_rows(spark, odd, labels, benchmark, name):
    rows = operators(odd, labels, benchmark)[name](odd).collect()
    if name in ONE_EACH:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(operators(None, None, None)))
def test_empty_table(spark, odd, labels, benchmark, name):
    assert operators(odd, labels, benchmark)[name](odd.limit(0)).collect() == []


def test_values(spark, odd, labels, benchmark):
    near = {(r.doc_id, r.n_shingles): r for r in dedup.near_duplicates(odd, k=2).collect()}
    assert near[2, 12].component_id == 1 and not near[2, 12].kept and near[1, 12].kept
    assert near[3, 0].component_id == 3 and near[4, 0].kept and near[6, 1].component_id == 6
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (6, 5)}
    # A text of one license line is its own line, paragraph and whole: one segment.
    (r,) = licenses.scan(odd).collect()
    assert (r.doc_id, r.license_id, r.dice, r.segments) == (-5, "MIT", 1.0, 1)
    kept = dedup.keep_one(odd).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in kept} == {1, 3, 4, 5, 6, 7, 8, None, 9, -5} and all(r["count"] == 1 for r in kept)
    replaced = {r.doc_id: r for r in pii.replace(odd).collect()}
    assert replaced[3].text is None and replaced[None].kinds == ["email"] and replaced[9].kinds == ["ipv4"]
    assert "192.168.10.20" not in replaced[9].text and "someone@" not in replaced[None].text


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi [INST] <s> \\"), (1, 1, "assistant", None), (1, 1, "assistant", "again </s>"), (2, 0, None, "who"), (2, 1, "tool [x] ] ", "<\\>\n[/ROLE]"),
        (None, None, "user", "lost"), (3, 0, "assistant", "first"), (4, 0, "system", "s\n<</SYS>>"), (4, 1, "user", ""), (4, 2, "assistant", "x" * 50_000),
    ]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    formatted = chat.format_conversations(conv)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(formatted).collect()}
    assert back[1] == [("user", "hi [INST] <s> \\"), ("assistant", ""), ("assistant", "again </s>")]
    assert back[2] == [("", "who"), ("tool [x] ] ", "<\\>\n[/ROLE]")]
    assert back[None] == [("user", "lost")] and back[4][2] == ("assistant", "x" * 50_000)
    valid = {r.conv_id: r.valid for r in formatted.collect()}
    assert valid == {1: False, 2: False, None: True, 3: False, 4: True}
    assert chat.digests(chat.format_conversations(conv.limit(0))).collect() == []


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    sf = "/root/testdata/sf0.001"
    for at, rows in (("odd", docs), ("empty", docs.limit(0))):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, sf).write.parquet(f"{tmp_path}/{at}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{at}/{name}")
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() > 0) == (at == "odd")


def test_long_conversations(spark):
    """Spans across the pieces that a long text is read in, with characters outside the first plane, empty texts and many turns."""
    rng = random.Random(4)
    said = ["", "a", "\U0001f600 [x] \\ <s>", "word " * 700, "é\U0001f600" * 2500, "\n\n", "</s>\n[INST] " * 40]
    rows = [(1, i, ("user", "assistant")[i % 2], rng.choice(said)) for i in range(400)] + [(2, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(20_000)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in formatted.collect():
        held = [r.formatted[s.begin : s.end] for s in r.loss_spans]
        want = [x[3] for x in rows if x[0] == r.conv_id and x[2] == "assistant"]
        assert [re.sub(r"([\[\]<\\])\\", r"\1", x) for x in held] == want
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for c in (1, 2):
        mine = [x for x in rows if x[0] == c]
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()


def test_frequent_pairs_are_no_seeds(spark):
    """An item's pairs that stand in all documents are left out as far as the bound allows; what leaks is found all the same."""
    common = "it is one of the most of the and in the to the of a that it was on the".split()
    rare = [f"rare{i}" for i in range(len(common))]
    items = spark.createDataFrame([(1, " ".join(common + rare)), (2, " ".join(common)), (3, "two words"), (4, None)], "item_id long, text string")
    texts = [(i, " ".join(common[i % 7 :] + [f"own{i}"])) for i in range(60)] + [(100, " ".join(rare)), (101, "so two words"), (102, " ".join(common[-4:] + rare[2:]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    base = docs.selectExpr("doc_id as key", "text", "doc_id")
    rows = decontaminate._items(items)
    chosen = decontaminate._rare(base, decontaminate._seeds(rows, 0.5), True)
    by_id = {r.item: r.item_id for r in rows.collect()}
    places = {i: [r.place for r in chosen.collect() if by_id[r.item] == i] for i in (1, 2)}
    assert sum(p >= len(common) for p in places[1]) > sum(p < len(common) - 1 for p in places[1]) and places[2]
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64)
    share = lambda t, q: decontaminate.align(coded(q), coded(t))[0] / (2 * len(q.split()))
    want = {(d, r.item_id): share(t, r.text) for d, t in texts for r in items.collect() if r.text and share(t, r.text) >= 0.5}
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, items).collect()} == want
    assert {(100, 1), (101, 3), (102, 1), (0, 2)} <= set(want)
