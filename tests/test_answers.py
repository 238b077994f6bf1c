"""Whole history answers, discovery's statistics and blobs against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import answers, discovery, keyset
from ledgerloom.sources import archive

ASKED = "request_id long, address string, low long, high long, forward boolean, limit int, marker string, binary boolean"


@pytest.fixture
def stored(spark):
    bodies = [(f"h{i}", 10 * i, "Payment", bytearray([i]), bytearray([255, i]), f'{{"b":{i},"a":{{"z":1,"y":[2,1]}}}}', None if i == 2 else "{" if i == 3 else f'{{"n":"{i}"}}') for i in range(1, 6)]
    transactions = spark.createDataFrame(bodies, "hash string, ledger_index long, tx_type string, tx_blob binary, meta_blob binary, tx_json string, meta_json string")
    links = spark.createDataFrame([(f"h{i}", a) for i in range(1, 6) for a in ("rCovered", "rBare")] + [("h9", "rBare")], "hash string, address string")
    coverage = spark.createDataFrame([("rCovered", 15, 45, "sweep")], "address string, from_ledger long, to_ledger long, reason string")
    accounts = spark.createDataFrame([("rCovered",), ("rBare",), ("rEmpty",)], "address string")
    return links, transactions, coverage, accounts


def _answers(spark, stored, asked, clustered=None):
    return {r.request_id: r for r in answers.account_answers(spark.createDataFrame(asked, ASKED), *stored, clustered).collect()}


def test_ranges_warnings_and_entries(spark, stored):
    asked = [
        (1, "rCovered", None, None, True, 2, None, None),
        (2, "rCovered", 15, 45, False, 2, None, True),
        (3, "rCovered", 5, None, True, 9, None, False),
        (4, "rBare", -1, -1, True, 2, "20:h2", False),
        (5, "rEmpty", None, None, True, 2, None, False),
        (6, "rStranger", None, None, True, 2, None, True),
        (7, None, None, None, True, 2, None, True),
        (8, "rCovered", 46, None, True, 2, None, True),
    ]
    got = _answers(spark, stored, asked)
    assert sorted(got) == list(range(1, 9))
    # Covered accounts tell their coverage, others what is stored, and without anything the latest ledger.
    assert [(got[i].ledger_index_min, got[i].ledger_index_max) for i in (1, 2, 4, 5, 6, 7)] == [(15, 45), (15, 45), (10, 50), (50, 50), (None, None), (None, None)]
    assert [got[i].status for i in (1, 5, 6, 7)] == ["success", "success", "notInArchive", "notInArchive"]
    assert got[1].marker == "30:h3" and got[2].marker == "30:h3" and got[4].marker == "40:h4" and got[5].marker is None
    assert [json.loads(x) for x in got[1].transactions] == [
        {"tx_json": {"b": 2, "a": {"z": 1, "y": [2, 1]}}, "hash": "h2", "ledger_index": 20, "validated": True},
        {"tx_json": {"b": 3, "a": {"z": 1, "y": [2, 1]}}, "hash": "h3", "ledger_index": 30, "validated": True},
    ]
    assert got[1].transactions[0].startswith('{"tx_json":{"a":{"y":[2,1],"z":1},"b":2},"hash"')
    assert [json.loads(x) for x in got[2].transactions] == [{"tx_blob": f"0{i}", "meta_blob": f"FF0{i}", "ledger_index": 10 * i, "validated": True} for i in (4, 3)]
    assert [json.loads(x)["ledger_index"] for x in got[3].transactions] == [20, 30, 40]
    assert [json.loads(x)["hash"] for x in got[4].transactions] == ["h3", "h4"]
    assert got[5].transactions == [] and got[8].transactions == [] and got[6].transactions is None and got[6].limit is None
    assert [got[i].warnings for i in (1, 2, 3, 4, 5, 6)] == [[2001, 65001], [2001, 65001]] + [[2001, 65001, 65003]] * 3 + [[2001, 65001]]
    assert got[3].limit == 9


def test_clustered_history_gives_the_same_answers(spark, stored, tmp_path):
    links, transactions = stored[:2]
    table = keyset.history(spark, f"file://{tmp_path}/history")
    table.append(keyset.history_rows(links, transactions), 0, 3)
    asked = [(10 * i + n, a, low, None, n % 2 == 0, n, marker, i == 1) for i, a in enumerate(("rCovered", "rBare", "rEmpty", "rStranger")) for n, low, marker in ((1, None, None), (2, 15, None), (3, None, "20:h2"))]
    assert _answers(spark, stored, asked, table) == _answers(spark, stored, asked)


def test_answers_of_nothing(spark, stored):
    links, transactions, coverage, accounts = stored
    assert _answers(spark, stored, []) == {}
    bare = (links.limit(0), transactions.limit(0), coverage.limit(0), accounts)
    got = _answers(spark, bare, [(1, "rBare", None, None, True, 2, None, None)])[1]
    assert (got.status, got.ledger_index_min, got.transactions, got.warnings) == ("success", None, [], [2001, 65001, 65003])


def test_discovery_statistics(spark):
    issuances = spark.createDataFrame(
        [(1, "iou", None, "USD", "rA", 0), (2, "mpt", "00AB", None, "rB", 4), (3, "mpt", "00CD", None, "rB", 0), (5, "iou", None, "EUR", "rA", 0)],
        "issuance_id long, kind string, mpt_issuance_id string, currency string, issuer_account string, flags long",
    )
    rows = lambda *x: spark.createDataFrame(x, "issuance_id long, address string, first_acquisition_ledger long")
    trusted, authorized = rows((1, "a", 5), (1, "b", None), (2, "x", 1)), rows((2, "c", 9), (3, "y", 1))
    current = spark.createDataFrame([(1, "b"), (1, "d"), (1, "d"), (2, "e")], "issuance_id long, address string")
    found, told = discovery.discover_checked(authorized, trusted, rows((2, "z", 1)), current, issuances)
    assert sorted((r.issuance_id, r.address) for r in found.collect()) == [(1, "a"), (1, "b"), (1, "d"), (2, "c")]
    got = {r.issuance_id: tuple(r)[2:] for r in told.collect()}
    assert got == {
        1: ("USD/rA", "trustline", 3, 1, 5, 5, 2, 1),
        2: ("00AB", "authorization", 1, 1, 9, 9, None, None),
        3: ("00CD", "traversal", 0, 0, None, None, None, None),
        5: ("EUR/rA", "trustline", 0, 0, None, None, 0, 0),
    }
    # Without a cross-check nothing is said about current holders.
    assert {(r.current_accounts, r.missing_accounts) for r in discovery.statistics(found, issuances).collect()} == {(None, None)}
    forced = discovery.statistics(found, issuances, trusted, current, F.lit("traversal")).collect()
    assert {(r.strategy, r.current_accounts) for r in forced} == {("traversal", None)}


def test_blobs(spark):
    landed = spark.createDataFrame([(1, "00ff", "Aa"), (2, "", None), (3, "0", "0g"), (4, None, " 00")], "n int, tx string, meta string")
    got = {r.n: (r.tx, r.meta, r.unread) for r in archive.with_blobs(landed, "tx", "meta").collect()}
    assert got == {1: (b"\x00\xff", b"\xaa", []), 2: (b"", None, []), 3: (None, None, ["tx", "meta"]), 4: (None, None, ["meta"])}
    back = spark.createDataFrame([(bytearray(range(256)),)], "b binary").select(X.from_hex(X.to_hex("b")).alias("b")).first().b
    assert back == bytes(range(256))
