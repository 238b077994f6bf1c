"""Findings of round 4, on small tables."""

import json
import os
import random

from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.operators import maintenance, rejects, reports, sinks, state
from ledgerloom.plans import registry
from ledgerloom.streaming import ingest, kept

SF = "/root/testdata/sf0.001"


def _names(node) -> list[str]:
    """The names of a plan's nodes, without the plans of what is cached."""
    children = node.children()
    return [node.nodeName(), *(name for i in range(children.size()) for name in _names(children.apply(i)))]


def test_deletion_reads_tables_once(spark):
    """who goes is worked out once, links and deltas are read once for all counts, and neither is shuffled to meet who goes."""
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "issuances": made([(1, "rI"), (2, "rJ")], "issuance_id long, issuer_account string"),
        "account_issuance": made([("a", 1), ("b", 1), ("b", 2), ("rI", 1), (None, 1), ("d", None), ("d", 1)], "address string, issuance_id long"),
        "balance_deltas": made([("T1", "a", 1), ("T2", "b", 2), ("T3", "a", 2), ("T5", "a", None), (None, "b", 2)], "hash string, address string, issuance_id long"),
        "accounts": made([("a",), ("b",), ("rI",)], "address string"),
        "account_transactions": made([("T1", "a"), ("T1", "rI"), ("T2", "b"), ("T3", "a"), ("T6", None), (None, "b"), ("T7", "a")], "hash string, address string"),
        "coverage": made([("a",), ("b",), ("rI",), (None,)], "address string"),
        "transactions": made([("T1",), ("T2",), ("T3",), ("T5",), ("T6",), ("T7",), ("T9",), ("T9",), (None,)], "hash string"),
        "backfill_job": made([(1, "b"), (2, "a"), (2, "b"), (None, "a"), (None, "b")], "issuance_id long, address string"),
        "reconciliation_run": made([(1,), (1,), (2,)], "issuance_id long"),
    }
    before = tables["transactions"].count()
    new, counts = maintenance.delete_issuance(tables, 1)
    assert counts.first().asDict() == {
        "accounts_removed": 2, "deltas_removed": 1, "deltas_kept": 1, "links_removed": 4, "coverage_removed": 2, "jobs_removed": 3, "runs_removed": 2, "transactions_removed": 5,
    }
    assert before - new["transactions"].count() == 5 and {r.address for r in new["accounts"].collect()} == {"b"}
    names = _names(counts._jdf.queryExecution().sparkPlan())
    # Deltas, links, transactions, claims, jobs and runs.
    assert sum("ExistingRDD" in name for name in names) == 6 and names.count("InMemoryTableScan") == 4
    assert "SortMergeJoin" not in names and "ShuffledHashJoin" not in names
    # A table without rows counts nothing.
    none = {name: rows.limit(0) for name, rows in tables.items()} | {"issuances": tables["issuances"]}
    assert set(maintenance.delete_issuance(none, 1)[1].first().asDict().values()) == {0, 1}


def test_requests_for_one_ledger_are_not_put_in_order(spark):
    """whether ranges hold a reject is found with one row for each different end; requests pass no window, however many name a ledger."""
    bad = spark.createDataFrame([(x,) for x in (5, 9_999, 10_000, 25_000, 25_000, None)], "ledger_index long")
    ranges = [(None, 4), (0, 5), (6, 9_998), (6, 9_999), (10_001, 24_999), (10_001, 25_000), (25_001, None), (25_000, None), (None, None), (9, 3), (-3, -1), (None, 40_000), (30_000, 40_000)]
    rows = [(f"r{i}", low, high) for i, (low, high) in enumerate(ranges)]
    asked = spark.createDataFrame(rows, "request_id string, low long, high long")
    told = rejects.doubted(asked, bad, F.col("low"), F.col("high"))
    known = [r.ledger_index for r in bad.collect() if r.ledger_index is not None]
    want = {i for i, low, high in rows if any((low or 0) <= x and (high is None or x <= high) for x in known)}
    assert {r.request_id for r in told.filter("_doubt").collect()} == want and told.count() == len(rows)
    windows = [x for x in _windows(told._jdf.queryExecution().optimizedPlan()) if "request_id" in x]
    assert windows == []


def _windows(node) -> list[str]:
    children = node.children()
    own = [" ".join(node.child().output().apply(i).name() for i in range(node.child().output().size()))] if node.nodeName() == "Window" else []
    return own + [x for i in range(children.size()) for x in _windows(children.apply(i))]


def test_rejects_are_worked_out_once(spark):
    """documents are read once for all three kinds of answers."""
    plan = registry.queries()["exp2_refusals"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert "from_json" not in "".join(_expressions(plan))


def _expressions(node) -> list[str]:
    children = node.children()
    return [node.simpleString(100_000), *(x for i in range(children.size()) for x in _expressions(children.apply(i)))]


def test_parity_reads_documents_once(spark):
    """versions land once, and what a table lacked is kept although the table changes; nothing is worked out again from documents."""
    out = registry.queries()["sta7_parity"](spark, SF)
    told = _expressions(out._jdf.queryExecution().optimizedPlan())
    assert not any("from_json" in x or "InMemoryRelation" in x for x in told)
    # What is compared is all that is gathered by object.
    gathered = [x for x in told if x.startswith("Aggregate")]
    assert gathered and not any("issuer_account" in x for x in gathered)
    assert {r.found for r in out.collect()} == {"behind"}


def test_newest_version_is_ordered_and_carried_at_once(spark):
    """the newest version by ledger and index, of equal ones the least hash, in one struct; nulls stay."""
    rows = [("o", "0A", 5, 1, "x"), ("o", "0B", 5, 1, "y"), ("o", "FF", 4, 9, "z"), ("p", "B", 1, 2, None), ("p", "C", 1, 1, "w"), ("q", None, 1, None, "v")]
    versions = spark.createDataFrame(rows, "object_id string, hash string, ledger_index long, tx_index int, amount_text string")
    found = state.latest(versions)
    assert found.columns == versions.columns
    assert {tuple(r) for r in found.collect()} == {rows[0], rows[3], rows[5]}
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_kept_sums_of_short_and_long_amounts(spark, tmp_path):
    """short amounts are summed as decimals and only the others in limbs; sums of both are exact, whatever batch brought them."""
    rng = random.Random(3)
    amounts = ["0.1", "-0.000000000000000001", "999999999.999999999999999999", "-999999999", "1000000000", "12345678901234567890.5", "1e30", "-1e-40", "7"]
    rows = [(i % 2, f"r{i % 5}", rng.randrange(40), rng.choice(amounts[: 2 if i % 5 < 2 else 9])) for i in range(300)] + [(1, "r3", 20, None)]
    deltas = spark.createDataFrame([(*r, None) for r in rows], "issuance_id long, address string, ledger_index long, delta_text string, delta decimal(38,18)")
    table = kept.KeptSums(ingest.Tables(spark, str(tmp_path / "t")), buckets=2, ledgers=10)
    late = F.col("ledger_index").between(12, 25)
    for batch, part in ((1, deltas.filter(~late)), (2, deltas.filter(late)), (1, deltas.filter(~late))):
        table.add(part, batch)
    who = deltas.select("issuance_id", "address").distinct()
    asked = who.crossJoin(spark.range(-1, 45, 2).withColumnRenamed("id", "ledger")).withColumn("request_id", F.concat_ws("|", "issuance_id", "address", "ledger"))
    summed, money = table.sums_at(asked)
    coverage = spark.createDataFrame([], "address string, to_ledger long")
    told = lambda answers: {r.request_id: (r.balance_text, r.balance, r.status) for r in answers.select("request_id", "balance_text", "balance", "status").collect()}
    got, want = told(reports.balance_answers(summed, money, who, coverage)), told(reports.balance_at(asked, deltas, who, coverage))
    assert got == want and any(s == "unreadable" for _, _, s in want.values()) and any(len(b or "") > 60 for b, _, _ in want.values())
    sums = summed.filter("_sum is not null").select("address", "_sum.q", F.coalesce(*(f"_sum.n.{f}" for f in exact.FIELDS)).alias("n")).collect()
    assert all(r.n is None for r in sums if r.address in ("r0", "r1")) and any(r.n is not None for r in sums)


def test_stored_transactions_are_not_read_again(spark, tmp_path):
    """what is stored stays as it is, whatever its copy looks like, and only documents of other transactions are read."""
    node = lambda who, amount: {"CreatedNode": {"LedgerEntryType": "MPToken", "LedgerIndex": f"O{who}", "NewFields": {"Account": who, "MPTokenIssuanceID": "A" * 48, "MPTAmount": str(amount)}}}
    meta = lambda i, who, amount: json.dumps({"TransactionIndex": i, "TransactionResult": "tesSUCCESS", "AffectedNodes": [node(who, amount)]})
    issuances = spark.createDataFrame([(1, "mpt", "A" * 48, None, "rI", True)], "issuance_id long, kind string, mpt_issuance_id string, currency string, issuer_account string, enabled boolean")
    one, two, three = ("T1", 10, meta(1, "ra", 5)), ("T2", 11, meta(2, "rb", 7)), ("T3", 10, meta(3, "rc", 9))
    cut = lambda row: (*row[:2], row[2][:-9])
    tables = ingest.Tables(spark, str(tmp_path))
    log = lambda name: tables.log(name, ingest.SCHEMAS[name])

    def batch(number, *rows):
        history = spark.createDataFrame([(h, ledger, "Payment", text) for h, ledger, text in rows], "hash string, ledger_index long, tx_type string, meta_json string")
        ingest.ingest_batch(tables, issuances, ingest._as_events(history), number)

    batch(1, one, cut(two), one)
    assert [r.hash for r in ingest.open_rejects(tables).collect()] == ["T2"]
    batch(2, cut(one), two, three)
    assert ingest.open_rejects(tables).collect() == []
    for _ in range(2):
        batch(3, one, two, three)
    batch(2, cut(one), two, three)
    assert sorted(r.hash for r in log("transactions").collect()) == ["T1", "T2", "T3"]
    assert sorted((r.address, r.delta_text) for r in log("balance_deltas").collect()) == [("ra", "5"), ("rb", "7"), ("rc", "9")]
    assert sorted((r.hash, r.address) for r in log("account_transactions").collect()) == [(f"T{i + 1}", x) for i, a in enumerate("abc") for x in ("rI", f"r{a}")]
    assert sorted(r.address for r in log("account_issuance").collect()) == ["ra", "rb", "rc"]
    assert not os.listdir(tmp_path / "staged")
    # Documents are shuffled without a second copy to order them by.
    once = sinks.first_of_each(log("transactions"), ["hash"], "ledger_index", "meta_json")
    assert once.columns == log("transactions").columns and "min_by" not in once._jdf.queryExecution().optimizedPlan().toString()
