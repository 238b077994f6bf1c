"""Discovery until nobody is new, digests of balances, coverage with holes, typed parameters."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import reconcile, scope
from ledgerloom.streaming import ingest
from tests.test_archive import ISSUANCES, I_SCHEMA, meta, token

EVENT = "seq long, type string, validated boolean, ledger_index long, ledger_time long, hash string, tx_type string, accounts array<string>, meta_json string"


def test_a_chain_of_members_is_stored_whole(spark, tmp_path):
    """a is found by the tail, b only through a's history, c only through b's; d has nothing to do with them."""
    issuances = spark.createDataFrame(ISSUANCES, I_SCHEMA)
    rows = [
        ("T1", 1, meta(token("Created", "c", 1))), ("T2", 2, meta(token("Modified", "c", 5, 1), token("Created", "b", 2))), ("T3", 3, meta(token("Modified", "b", 1, 2), token("Created", "a", 3))),
        ("T4", 4, meta(token("Created", "d", 9))), ("T9", 9, meta(token("Modified", "a", 4, 3))),
    ]
    history = spark.createDataFrame([(h, n, "Payment", m) for h, n, m in rows], "hash string, ledger_index long, tx_type string, meta_json string")
    who = {"T1": "c", "T2": "bc", "T3": "ab", "T4": "d", "T9": "a"}
    links = spark.createDataFrame([(h, a) for h, all_ in who.items() for a in all_], "hash string, address string")
    tables = ingest.Tables(spark, str(tmp_path / "t"))
    tail = spark.createDataFrame([(1, "transaction", True, 9, None, "T9", "Payment", None, rows[-1][2])], EVENT)
    state = []
    for _ in range(2):
        ingest.ingest_batch(tables, issuances, tail, 5)
        assert ingest.discover_whole(tables, issuances, history, links, 5) == 3
        log = lambda name: tables.log(name, ingest.SCHEMAS[name]).drop("batch")
        assert sorted(r.hash for r in log("transactions").collect()) == ["T1", "T2", "T3", "T9"]
        assert {(r.address, r.discovered_via) for r in log("account_issuance").collect()} == {("a", "stream"), ("b", "history"), ("c", "history")}
        state.append(sorted(map(tuple, log("balance_deltas").collect())))
    assert state[0] == state[1] and len(state[0]) == 6
    assert ingest.discover_whole(tables, issuances, history, links, 77) == 0


def test_digests_find_all_differences(spark):
    rng = random.Random(1)
    left = {(i, f"r{k}"): f"{rng.randrange(-5, 5)}e{rng.choice([0, -30, 40])}" for i in (1, 2) for k in range(400)}
    right = dict(left)
    for key in rng.sample(sorted(left), 9):
        right[key] = "1e-70"
    for key in rng.sample(sorted(left), 5):
        right.pop(key)
    right |= {(3, "new"): "7", (3, "zero"): "0.0"}
    table = lambda d: spark.createDataFrame([(i, a, x) for (i, a), x in d.items()], "issuance_id long, address string, balance string").withColumn("balance", F.col("balance"))
    a, b = table(left), table(right)
    whole = sorted(map(tuple, reconcile.compare(a, b).collect()))
    assert sorted(map(tuple, reconcile.compare_suspects(a, b, ranges=64).collect())) == whole and len(whole) > 5
    assert 0 < reconcile.suspects(a, b, ranges=64).count() <= 15 and reconcile.suspects(a, a).collect() == []
    # Spelling doesn't matter, and zero is nobody.
    assert reconcile.suspects(table({(1, "x"): "1.50", (1, "y"): "0"}), table({(1, "x"): "15e-1"})).collect() == []
    log = spark.createDataFrame([("T", 1, "a", 4, Decimal(1), 3), ("T", 1, "a", 5, Decimal(1), 8)], "hash string, ledger_index long, address string, issuance_id long, delta decimal(38,18), batch long")
    assert [r.issuance_id for r in reconcile.changed_since(log, 3).collect()] == [5]


def test_stretches_of_coverage(spark):
    rng = random.Random(4)
    members = [(f"a{k}", i) for i in range(6) for k in rng.sample(range(8), 3)]
    claims = [(f"a{rng.randrange(7)}", low, low + rng.randrange(12), "s") for low in (rng.randrange(40) for _ in range(40))]
    coverage = spark.createDataFrame(claims, "address string, from_ledger long, to_ledger long, reason string")
    table = spark.createDataFrame(members, "address string, issuance_id long")
    got = {}
    for r in scope.covered_stretches(table, coverage).collect():
        got.setdefault(r.issuance_id, []).append((r.from_ledger, r.to_ledger))
    for i in range(6):
        whole = [n for n in range(60) if all(any(a == c and low <= n <= high for c, low, high, _ in claims) for a, j in members if j == i)]
        stretches = [(n, next(m for m in range(n, 99) if m + 1 not in whole)) for n in whole if n - 1 not in whole]
        assert sorted(got.get(i, [])) == stretches, i
    windows = {r.issuance_id: r for r in scope.strict_window_with_holes(table, coverage, tail_to=70).collect()}
    for i, r in windows.items():
        if r.from_ledger is not None:
            end = min(max(high for c, _, high, _ in claims if c == a) for a, j in members if j == i)
            want = sum(b - a + 1 for a, b in ((max(x, r.from_ledger), min(y, end)) for x, y in got.get(i, [])) if b >= a) + max(0, 70 - max(end, r.from_ledger - 1))
            assert r.covered_ledgers == want and r.whole == (want == 70 - r.from_ledger + 1)


def test_types_of_parameters(spark):
    rows = [("rAbc", "5", "true"), ("r0", "5", "true"), ("rAbc", "five", "true"), ("rAbc", None, "TRUE"), (" rAbc ", "validated", None)]
    df = spark.createDataFrame(rows, "account string, ledger_index string, forward string").withColumns({"command": F.lit("account_tx"), "api_version": F.lit("2")})
    out = scope.validate(df, types={"account": "account", "ledger_index": "ledger", "forward": "boolean"}).collect()
    assert [r.error for r in out] == [None, "account is no account", "ledger_index is no ledger", "forward is neither true nor false", None]
