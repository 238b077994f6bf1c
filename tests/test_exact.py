"""Amounts of 1 to 40 digits and all exponents of the ledger, against Python's decimals."""

import random
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerloom.functions import exact
from ledgerloom.operators import nodes, rejects, reports, state
from ledgerloom.streaming import ingest, kept
from tests.test_archive import ISSUANCES, I_SCHEMA, line, meta, token, transactions

WIDE = Context(prec=500)


def canon(x):
    return format(WIDE.normalize(x), "f") if x else "0"


def amounts(seed, n):
    rng = random.Random(seed)
    for key in range(n):
        for _ in range(rng.choice([1, 2, 9])):
            digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 2, 15, 16, 19, 38, 40])))
            at = rng.randrange(len(digits) + 1) if rng.random() < 0.5 else None
            plain = digits if at is None else f"{digits[:at] or '0'}.{digits[at:]}" if at < len(digits) else digits
            yield key, rng.choice(["", "-", "-", "+"]) + plain + rng.choice(["", "", "e-15", "E+3", "e-96", "e80", "e-30"])


def test_texts_and_sums(spark):
    rows = list(amounts(7, 200))
    table = spark.createDataFrame(rows, "k long, v string")
    for r in table.select("v", exact.canonical("v").alias("c")).collect():
        assert r.c == canon(Decimal(r.v)), r
    want = {}
    for k, v in rows:
        want[k] = WIDE.add(want.get(k, Decimal(0)), Decimal(v))
    assert {r.k: r.total for r in exact.exact_sum(table, ["k"], "v").collect()} == {k: canon(v) for k, v in want.items()}


@pytest.mark.parametrize("text", ["", " ", "abc", "1e", "0x1", "1e200", "--1", "1.2.3", None])
def test_no_numbers(spark, text):
    row = spark.createDataFrame([(1, text)], "k long, v string").select(exact.number("v").alias("x"), exact.canonical("v").alias("c")).first()
    assert row.x is None and row.c is None


def test_no_overflow(spark):
    """Sums beyond 20 digits before the point, of decimals and of texts."""
    big = Decimal("60000000000000000000")
    rows = [("T1", 1, "a", 1, big), ("T2", 2, "a", 1, big), ("T3", 3, "a", 1, Decimal("-0.000000000000000001"))]
    deltas = spark.createDataFrame(rows, "hash string, ledger_index long, address string, issuance_id long, delta decimal(38,18)")
    members = spark.createDataFrame([("a", 1)], "address string, issuance_id long")
    coverage = spark.createDataFrame([("a", 1, 9, "s")], "address string, from_ledger long, to_ledger long, reason string")
    asked = spark.createDataFrame([(n, 1, "a", n) for n in (1, 2, 3)], "request_id long, issuance_id long, address string, ledger long")
    got = {r.request_id: (r.status, r.balance, r.balance_text) for r in reports.balance_at(asked, deltas, members, coverage).collect()}
    assert got == {1: ("success", None, "60000000000000000000"), 2: ("success", None, "120000000000000000000"), 3: ("success", None, "119999999999999999999.999999999999999999")}
    assert [r.balance_text for r in reports.current_balances(deltas).collect()] == ["119999999999999999999.999999999999999999"]
    assert {r.ledger_index: r.balance_text for r in reports.running_balances(deltas).collect()}[2] == "120000000000000000000"


def test_large_integer_tokens(spark):
    issuances = spark.createDataFrame(ISSUANCES, I_SCHEMA)
    tx = transactions(spark, (1, meta(token("Created", "a", "1" * 23), token("Created", "b", "9" * 46))), (2, meta(token("Modified", "a", 1, "1" * 23))))
    deltas = {(r.address, r.ledger_index): r.delta_text for r in nodes.derive(tx, issuances).collect()}
    assert deltas == {("a", 1): "1" * 23, ("b", 1): "9" * 46, ("a", 2): "-" + "1" * 22 + "0"}


def test_types_of_money(spark):
    """No column of money may have fewer places behind the point than AMOUNT."""
    issuances = spark.createDataFrame(ISSUANCES, I_SCHEMA)
    tx = transactions(spark, (1, meta(line("Created", "a", "rI", "0.123456789012345678"))))
    versions = nodes.versions(nodes.flatten(tx), issuances)
    deltas = nodes.deltas(versions)
    asked = spark.createDataFrame([("x", "a", 5)], "request_id string, address string, as_of_ledger long")
    for table, column in ((versions, "amount"), (versions, "before"), (deltas, "delta"), (reports.current_balances(deltas), "balance"), (state.balances(versions), "balance"), (state.trust_lines_at(nodes.flatten(tx), asked), "balance")):
        assert table.schema[column].dataType == DecimalType(38, 18), column


def test_rejects(spark, tmp_path):
    issuances = spark.createDataFrame(ISSUANCES, I_SCHEMA)
    whole = meta(token("Created", "a", 5))
    rows = [("T1", 1, whole), ("T2", 2, whole[:-9]), ("T3", 3, None), ("T4", 4, "  "), ("T5", 5, '{"TransactionIndex":1}'), ("T6", 6, "[]"), ("T7", 7, meta(token("Created", "b", 1)))]
    tx = spark.createDataFrame(rows, "hash string, ledger_index long, meta_json string")
    got = {r.hash: r.reason for r in rejects.rejected(tx).collect()}
    assert got == {"T2": rejects.BROKEN, "T3": rejects.MISSING, "T4": rejects.MISSING, "T5": rejects.NO_NODES, "T6": rejects.BROKEN} or got.get("T6") == rejects.NO_NODES
    assert rejects.rejected(tx.limit(0)).collect() == []
    # A batch stores what it can't read; when it comes again whole, answers are given again.
    tables = ingest.Tables(spark, str(tmp_path / "tables"))
    event = lambda i, h, ledger, m: (i, "transaction", True, ledger, None, h, "Payment", None, m)
    schema = "seq long, type string, validated boolean, ledger_index long, ledger_time long, hash string, tx_type string, accounts array<string>, meta_json string"
    ingest.ingest_batch(tables, issuances, spark.createDataFrame([event(i, *r) for i, r in enumerate(rows[:2])], schema), 1)
    assert [r.hash for r in ingest.open_rejects(tables).collect()] == ["T2"]
    ingest.ingest_batch(tables, issuances, spark.createDataFrame([event(9, "T2", 2, whole)], schema), 2)
    assert ingest.open_rejects(tables).collect() == []


def test_ranges_that_hold_a_reject(spark):
    n = rejects.LEDGERS
    bad = [3, n - 1, n, 5 * n + 7, 5 * n + 7]
    rows = [(f"{a}-{b}", a, b) for a in (None, 0, 3, 4, n - 1, n, n + 1, 5 * n + 7, 5 * n + 8) for b in (None, 2, 3, n - 2, n, 4 * n, 6 * n) if b is None or (a or 0) <= b]
    asked = spark.createDataFrame(rows, "request_id string, low long, high long")
    got = {r.request_id for r in rejects.touched(asked, spark.createDataFrame([(f"T{i}", x) for i, x in enumerate(bad)], "hash string, ledger_index long")).collect()}
    assert got == {k for k, a, b in rows if any((a or 0) <= x and (b is None or x <= b) for x in bad)}
    assert rejects.touched(asked, spark.createDataFrame([], "hash string, ledger_index long")).collect() == []


def test_kept_state(spark, tmp_path):
    """Only touched buckets are rewritten; deletion, re-creation and replays in any order give the newest versions."""
    issuances = spark.createDataFrame(ISSUANCES, I_SCHEMA)
    many = [(1, meta(*(token("Created", f"h{i}", i) for i in range(200))))]
    later = [(2, meta(token("Deleted", "h1", 1))), (3, meta(token("Created", "h1", 7, object_id="h1"))), (4, meta(token("Deleted", "h2", 2)))]
    tx = transactions(spark, *many, *later)
    versions = nodes.versions(nodes.flatten(tx), issuances)
    table = kept.ObjectState(ingest.Tables(spark, str(tmp_path / "t")), buckets=32)
    assert len(table.apply(versions.filter("ledger_index = 1"))) == 32
    for ledger in (3, 2, 4, 2):
        assert len(table.apply(versions.filter(f"ledger_index = {ledger}"))) == 1
    assert table.parity(versions).collect() == []
    rows = {r.object_id: r for r in table.rows().collect()}
    assert len(rows) == 200 and rows["h1"].amount_text == "7" and not rows["h1"].deleted and rows["h2"].deleted
    last = table.commits().collect()
    assert sum(r.n for r in last) == 200 and sorted(r.generation for r in last)[0] == 1
    assert table.clean() >= 4 and {r.object_id for r in table.rows().collect()} == set(rows)
    assert table.apply(versions.limit(0)) == []
    table.rebuild(versions.filter("object_id in ('h1', 'h2')"))
    assert {r.object_id for r in table.rows().collect()} == {"h1", "h2"}


def test_kept_sums(spark, tmp_path):
    """Batches out of order, a replay and a replay with less, against sums over everything."""
    rng = random.Random(3)
    schema = "hash string, ledger_index long, address string, issuance_id long, delta_text string, delta decimal(38,18)"
    batches = {b: [(f"T{b}x{i}", rng.randrange(1000), rng.choice("abc"), rng.randrange(2), f"{rng.randrange(-99, 99)}e{rng.choice([-20, 0, 30])}", None) for i in range(60)] for b in (1, 2, 3)}
    sums = kept.KeptSums(ingest.Tables(spark, str(tmp_path / "t")), buckets=4, ledgers=100)
    members = spark.createDataFrame([(a, i) for a in "abcz" for i in (0, 1)], "address string, issuance_id long")
    coverage = spark.createDataFrame([], "address string, from_ledger long, to_ledger long, reason string")
    asked = [(f"{a}{i}{n}", i, a, n) for a in "abcz" for i in (0, 1) for n in (0, 99, 100, 555, 5000)]
    requests = spark.createDataFrame(asked, "request_id string, issuance_id long, address string, ledger long")
    for b in (2, 3, 1, 2):
        sums.add(spark.createDataFrame(batches[b], schema), b)
    batches[3] = batches[3][:20]
    sums.add(spark.createDataFrame(batches[3], schema), 3)
    rows = [r for b in batches.values() for r in b]
    got = {r.request_id: (r.status, r.balance_text) for r in sums.balance_at(requests, members, coverage).collect()}
    for key, i, a, n in asked:
        total = Decimal(0)
        for r in rows:
            if r[3] == i and r[2] == a and r[1] <= n:
                total = WIDE.add(total, Decimal(r[4]))
        assert got[key] == ("success", canon(total)), key
    # A balance reads the blocks of one bucket of accounts.
    assert sums.read([0]).select(F.countDistinct("bucket")).first()[0] <= 1
