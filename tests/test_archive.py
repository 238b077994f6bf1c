"""Examples of the domain: small tables with known answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.operators import discovery, maintenance, nodes, reconcile, reports, scope, sinks, state, timeline
from ledgerloom.plans import registry, upkeep_queries
from ledgerloom.sources import archive
from ledgerloom.sources.driver_tables import DriverTables
from ledgerloom.streaming import ingest

DELTA = "hash string, ledger_index long, address string, issuance_id long, delta decimal(38,18)"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def report(spark):
    return {
        "deltas": spark.createDataFrame([("T1", 100, "rA", 1, Decimal(10)), ("T2", 200, "rA", 1, Decimal(25))], DELTA),
        "members": spark.createDataFrame([("rA", 1)], "address string, issuance_id long"),
        "coverage": spark.createDataFrame([("rA", 100, 200, "sweep")], "address string, from_ledger long, to_ledger long, reason string"),
        "ledgers": spark.createDataFrame([(100, "2026-01-01"), (200, "2026-06-01")], "ledger_index long, t string").select("ledger_index", F.col("t").cast("timestamp").alias("close_time")),
    }


def test_balance_at(spark, report):
    asked = spark.createDataFrame([(1, 1, "rA", 150), (2, 1, "rA", 250), (3, 1, "rA", 50), (4, 1, "rZ", 150), (5, None, "rA", 150), (6, 1, "rA", None)], "request_id long, issuance_id long, address string, ledger long")
    got = {r.request_id: r for r in reports.balance_at(asked, report["deltas"], report["members"], report["coverage"]).collect()}
    assert [got[i].balance for i in (1, 2, 3)] == [10, 35, 0] and not got[1].beyond_coverage and got[2].beyond_coverage
    assert [got[i].status for i in (4, 5, 6)] == ["notInArchive", "notInArchive", "invalidParams"] and got[4].balance is None


def test_dates(spark, report):
    asked = spark.createDataFrame([(1, "2026-03-01"), (2, "2026-06-01"), (3, "2025-01-01"), (4, None)], "id long, t string").select("id", F.col("t").cast("timestamp").alias("time"))
    got = {r.id: r.resolved_ledger for r in timeline.resolve_times(asked, report["ledgers"]).collect()}
    assert got == {1: 100, 2: 200, 3: None, 4: None}


def test_latest_is_greatest_ledger_not_latest_time(spark):
    ledgers = spark.createDataFrame([(300, 10), (200, 20)], "ledger_index long, t long").select("ledger_index", F.timestamp_seconds("t").alias("close_time"))
    asked = spark.createDataFrame([(25,)], "t long").select(F.timestamp_seconds("t").alias("time"))
    assert timeline.resolve_times(asked, ledgers).first().resolved_ledger == 300


def test_obligations(spark):
    d = lambda h, ledger, a, i, x: (h, ledger, a, i, Decimal(x))
    deltas = spark.createDataFrame([d("T1", 100, "rH1", 1, 100), d("T1", 100, "rH2", 1, 50), d("T1", 100, "rHOT", 1, 30), d("T2", 200, "rH1", 1, -40), d("E1", 100, "rH1", 2, 20), d("G1", 100, "rH3", 3, 10), d("G2", 200, "rH3", 3, -10)], DELTA)
    members = spark.createDataFrame([("rH1", 1), ("rH2", 1), ("rHOT", 1), ("rH1", 2), ("rH3", 3)], "address string, issuance_id long")
    coverage = spark.createDataFrame([(a, 100, 200, "s") for a in ("rH1", "rH2", "rHOT", "rH3")], "address string, from_ledger long, to_ledger long, reason string")
    issuances = spark.createDataFrame([(1, "iou", None, "USD", "rI", True), (2, "iou", None, "EUR", "rI", True), (3, "iou", None, "GBPX", "rI", True)], "issuance_id long, kind string, mpt_issuance_id string, currency string, issuer_account string, enabled boolean")
    asked = spark.createDataFrame([("now", "rI", 200, []), ("hot", "rI", 200, ["rHOT"]), ("early", "rI", 150, []), ("late", "rI", 300, []), ("who", "rX", 200, [])], "request_id string, issuer string, ledger long, hotwallets array<string>")
    rows = reports.obligations(asked, deltas, members, coverage, issuances).collect()
    got = {(r.request_id, r.currency): r.obligation for r in rows if r.currency}
    assert got == {("now", "USD"): 140, ("now", "EUR"): 20, ("hot", "USD"): 110, ("hot", "EUR"): 20, ("early", "USD"): 180, ("early", "EUR"): 20, ("early", "4742505800000000000000000000000000000000"): 10}
    assert {r.request_id: r.status for r in rows if not r.currency} == {"late": "outOfCoverage", "who": "notInArchive"}
    (hot,) = reports.hot_wallet_balances(asked, deltas, issuances).collect()
    assert (hot.address, hot.currency, hot.balance) == ("rHOT", "USD", 30)
    bare = reports.obligations(asked.limit(1), deltas, members, coverage.filter("address <> 'rH2'"), issuances).collect()
    assert [r.status for r in bare] == ["outOfCoverage"]


ISSUANCES = [(1, "mpt", "0" * 40 + "0000000A", None, "rI", True), (2, "iou", None, "USD", "rI", True)]
I_SCHEMA = "issuance_id long, kind string, mpt_issuance_id string, currency string, issuer_account string, enabled boolean"


def token(kind, account, amount=None, before=None, mpt=ISSUANCES[0][2], object_id=None):
    fields = f'"Account":"{account}","MPTokenIssuanceID":"{mpt}"' + (f',"MPTAmount":"{amount}"' if amount is not None else "")
    previous = ',"PreviousFields":{' + (f'"MPTAmount":"{before}"' if before is not None else "") + "}" if kind == "Modified" else ""
    name = "NewFields" if kind == "Created" else "FinalFields"
    return f'{{"{kind}Node":{{"LedgerEntryType":"MPToken","LedgerIndex":"{object_id or account}","{name}":{{{fields}}}{previous}}}}}'


def line(kind, low, high, value, before=None, currency="USD"):
    side = lambda who: f'{{"currency":"{currency}","issuer":"{who}","value":"1000"}}'
    money = lambda v: f'{{"currency":"{currency}","issuer":"rOne","value":"{v}"}}'
    previous = f',"PreviousFields":{{"Balance":{money(before)}}}' if before is not None else ""
    name = "NewFields" if kind == "Created" else "FinalFields"
    return f'{{"{kind}Node":{{"LedgerEntryType":"RippleState","LedgerIndex":"{low}{high}","{name}":{{"Balance":{money(value)},"LowLimit":{side(low)},"HighLimit":{side(high)}}}{previous}}}}}'


def meta(*affected, index=0):
    return f'{{"TransactionIndex":{index},"TransactionResult":"tesSUCCESS","AffectedNodes":[{",".join(affected)}]}}'


@pytest.fixture(scope="module")
def issuances(spark):
    return spark.createDataFrame(ISSUANCES, I_SCHEMA)


def transactions(spark, *rows):
    return spark.createDataFrame([(f"T{i}", ledger, m) for i, (ledger, m) in enumerate(rows)], "hash string, ledger_index long, meta_json string")


@pytest.mark.parametrize(
    ("document", "want"),
    [
        (meta(token("Modified", "a", 40, 50), token("Modified", "b", 10)), {"a": -10, "b": 10}),
        (meta(token("Created", "a")), {}),
        (meta(token("Modified", "a", 5, 1, mpt="F" * 48)), {}),
        (meta(token("Deleted", "a", 7)), {"a": -7}),
        (meta(token("Created", "a", 9007199254740993)), {"a": 9007199254740993}),
        (meta(line("Modified", "h", "rI", 25, 0)), {"h": 25}),
        (meta(line("Modified", "rI", "h", -25, 0)), {"h": 25}),
        (meta(line("Modified", "h", "rI", "10.5", "0.25")), {"h": Decimal("10.25")}),
        (meta(line("Modified", "h", "rI", 5)), {}),
        (meta(line("Created", "h", "rI", 5)), {"h": 5}),
        (meta(line("Deleted", "h", "rI", 5)), {"h": -5}),
        (meta(line("Created", "h", "rI", 5, currency="EUR"), line("Created", "x", "y", 5)), {}),
        (meta(line("Created", "h", "rI", 5, currency="5553440000000000000000000000000000000000")), {"h": 5}),
        ("", {}),
        ("not json", {}),
    ],
)
def test_deltas(spark, issuances, document, want):
    got = {r.address: r.delta for r in nodes.derive(transactions(spark, (1, document)), issuances).collect()}
    assert got == want


def test_amounts_of_any_scale(spark, issuances):
    """Exponents and amounts beyond the decimal type: exact as texts, null as decimals, and added up all the same; only what is no
    number is refused."""
    tx = transactions(
        spark, (1, meta(line("Created", "a", "rI", "10.5"))), (2, meta(line("Created", "b", "rI", "1234e-20"))), (3, meta(line("Created", "c", "rI", "5e25"))), (4, meta(line("Created", "rI", "d", "-12E2"))),
        (5, meta(line("Modified", "a", "rI", "1.25e1", "10.5"))), (6, meta(line("Created", "e", "rI", "ten"))), (7, meta(line("Created", "f", "rI", "0.123456789012345678"))),
    )
    versions = nodes.versions(nodes.flatten(tx), issuances)
    deltas = nodes.deltas(versions)
    got = {(r.address, r.ledger_index): (r.delta, r.delta_text) for r in deltas.collect()}
    assert got == {
        ("a", 1): (Decimal("10.5"), "10.5"), ("b", 2): (None, "0.00000000000000001234"), ("c", 3): (None, "50000000000000000000000000"), ("d", 4): (1200, "1200"), ("a", 5): (2, "2"),
        ("e", 6): (None, None), ("f", 7): (Decimal("0.123456789012345678"), "0.123456789012345678"),
    }
    assert {r.address: r.balance for r in reports.exact_balances(nodes.exact_deltas(versions)).collect()}["a"] == "12.5"
    members = spark.createDataFrame([(x, 2) for x in "abcdef"], "address string, issuance_id long")
    coverage = spark.createDataFrame([(x, 1, 9, "s") for x in "abcdef"], "address string, from_ledger long, to_ledger long, reason string")
    asked = spark.createDataFrame([(x, 2, x, n) for x in "abcde" for n in (1, 9)], "request_id string, issuance_id long, address string, ledger long")
    answers = {(r.address, r.ledger): (r.status, r.balance, r.balance_text) for r in reports.balance_at(asked, deltas, members, coverage).collect()}
    assert answers["a", 9] == ("success", Decimal("12.5"), "12.5") and answers["b", 9] == ("success", None, "0.00000000000000001234")
    assert answers["b", 1] == ("success", 0, "0") and answers["c", 9][2] == "50000000000000000000000000" and answers["e", 9] == ("unreadable", None, None)
    asked = spark.createDataFrame([("x", "rI", 9, "a"), ("y", "rI", 5, "a")], "request_id string, issuer string, ledger long, hotwallets string")
    rows = reports.gateway_balances(asked, deltas, members, coverage, issuances).collect()
    assert {(r.request_id, r.status, r.address, r.amount_text) for r in rows} == {
        ("x", "unreadable", None, None), ("y", "success", "a", "12.5"), ("y", "success", None, "50000000000000000000001200.00000000000000001234"),
    }
    kept = reports.current_balances(deltas)
    assert {r.address for r in reconcile.compare(kept, kept).collect()} == {"e"}
    lines = {r.request_id: (r.balance_text, r.status) for r in state.trust_lines_at(nodes.flatten(tx), spark.createDataFrame([(x, x, 9) for x in "cde"], "request_id string, address string, as_of_ledger long")).collect()}
    assert lines == {"c": ("50000000000000000000000000", "success"), "d": ("1200", "success"), "e": (None, "unreadable")}


def test_listings_are_in_order(spark, report):
    asked = spark.createDataFrame([("r", 1, None, 0, None)], "request_id string, issuance_id long, address string, low long, high long")
    rows = reports.itemised_answers(asked, report["deltas"], spark.createDataFrame([(1,)], "issuance_id long"), report["members"]).collect()
    assert [r.hash for r in rows] == ["T1", "T2"]
    listed = reports.scope_listing(spark.createDataFrame([(3,), (1,), (2,)], "issuance_id long"), report["coverage"]).collect()
    assert [(r.issuance_id, r.from_ledger, r.to_ledger) for r in listed] == [(1, 100, 200), (2, 100, 200), (3, 100, 200)]


def test_many_buckets(spark):
    """As-of sums across buckets of ledgers, against plain sums."""
    n = reports.LEDGERS
    rows = [(f"T{i}", i * n // 3, "a", 1, Decimal(i + 1)) for i in range(30)]
    deltas = spark.createDataFrame(rows, DELTA)
    members = spark.createDataFrame([("a", 1)], "address string, issuance_id long")
    coverage = spark.createDataFrame([("a", 0, 1, "s")], "address string, from_ledger long, to_ledger long, reason string")
    asked = spark.createDataFrame([(i, 1, "a", i * n // 7) for i in range(90)], "request_id long, issuance_id long, address string, ledger long")
    for r in reports.balance_at(asked, deltas, members, coverage).collect():
        assert r.balance == sum(x[4] for x in rows if x[1] <= r.ledger), r


def test_unreadable_documents_are_reported(spark):
    assert [r.hash for r in nodes.unreadable(transactions(spark, (1, "nope"), (2, meta(token("Created", "a", 1))))).collect()] == ["T0"]


def test_state(spark, issuances):
    tx = transactions(spark, (100, meta(token("Created", "a", 5), token("Created", "b", 0))), (200, meta(token("Modified", "a", 20, 10), index=5)), (200, meta(token("Modified", "a", 10, 5), index=2)), (300, meta(token("Deleted", "b", 0))))
    versions = nodes.versions(nodes.flatten(tx), issuances)
    points = spark.createDataFrame([(1, 100), (1, 200), (1, 300)], "issuance_id long, as_of_ledger long")
    got = {(r.as_of_ledger, r.address): r.amount for r in state.holders_at(versions, points).collect()}
    assert got == {(100, "a"): 5, (100, "b"): 0, (200, "a"): 20, (200, "b"): 0, (300, "a"): 20}
    assert {r.address for r in nodes.holders(versions).collect()} == {"a", "b"}
    early, late = versions.filter("ledger_index <= 200"), versions.filter("ledger_index > 200")
    assert sorted(state.merge_state(state.latest(late), early).collect()) == sorted(state.latest(versions).collect())


def test_trust_lines(spark):
    flat = nodes.flatten(transactions(spark, (1, meta(line("Created", "l", "h", 25)))))
    asked = spark.createDataFrame([("x", "l", 5), ("y", "h", 5)], "request_id string, address string, as_of_ledger long")
    got = {r.request_id: (r.peer, r.balance, r.limit_peer) for r in state.trust_lines_at(flat, asked).collect()}
    assert got == {"x": ("h", 25, "1000"), "y": ("l", -25, "1000")}


def test_account_root(spark):
    root = lambda kind, balance: f'{{"{kind}Node":{{"LedgerEntryType":"AccountRoot","LedgerIndex":"R","FinalFields":{{"Account":"a","Balance":"{balance}"}}}}}}'
    flat = nodes.flatten(transactions(spark, (1, meta(root("Modified", 1000))), (2, meta(root("Modified", 1500))), (3, meta(root("Deleted", 1500)))))
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "z", 3)], "request_id long, address string, as_of_ledger long")
    got = {r.request_id: (r.status, r.fields.Balance if r.fields else None) for r in state.account_roots(flat, asked).collect()}
    assert got == {1: ("success", "1000"), 2: ("success", "1500"), 3: ("notInArchive", None), 4: ("notInArchive", None)}


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x", Decimal("10.5")), (1, "y", Decimal(1))], "issuance_id long, address string, balance decimal(38,18)")
    b = spark.createDataFrame([(1, "x", Decimal("10.50")), (1, "z", Decimal(2))], "issuance_id long, address string, balance decimal(38,2)")
    assert {(r.address, r.left_balance, r.right_balance) for r in reconcile.compare(a, b).collect()} == {("y", 1, 0), ("z", 0, 2)}


def test_gaps(spark):
    tail = lambda *x: spark.createDataFrame(list(enumerate(x)), "seq long, ledger_index long")
    found = lambda t, a=None: [(r.from_ledger, r.to_ledger) for r in timeline.gaps(t, a).orderBy("seq").collect()]
    assert found(tail(100, 101, 104), 99) == [(102, 103)]
    assert found(tail(100, 104, 102)) == [(101, 103)]
    assert found(tail(5, 5, 4, 6)) == [] and found(tail(5), 1) == [(2, 4)] and found(tail(5)) == []


def test_closure(spark):
    edges = spark.createDataFrame([("rI", "rA", 5), ("rA", "rB", 8), ("rB", "rA", 9), ("rX", "rZ", 1), ("rA", "rI", 6)], "account string, party string, ledger_index long")
    seeds = spark.createDataFrame([("t", "rI")], "group string, address string")
    got = {r.address: r.ledger for r in discovery.closure(edges, seeds).collect()}
    assert got == {"rI": 6, "rA": 5, "rB": 8}


def test_registration(spark):
    rows = [(1, "iou", None, " USD ", "rI", None), (2, "iou", None, "USD", "rI", 5), (3, "iou", None, "XRP", "rI", None), (4, "mpt", "A" * 48, None, None, None), (5, "mpt", "A", None, None, None), (6, "odd", None, None, None, None), (7, "iou", None, "x" * 21, "rI", None), (8, "iou", None, "EUR", None, None)]
    candidates = spark.createDataFrame(rows, "seq long, kind string, mpt_issuance_id string, currency string, issuer_account string, backfill_from_ledger long")
    got = {r.seq: r for r in sinks.register(candidates, candidates.limit(0)).collect()}
    assert {s for s, r in got.items() if r.accepted} == {1, 4} and got[1].currency == "USD" and got[1].backfill_from_ledger == 0
    assert got[2].error == "already registered"


def test_membership_log(spark):
    log = spark.createDataFrame([("a", 1, "sweep", None, 1), ("a", 1, "stream", 9, 2), ("a", 1, "stream", 7, 3)], "address string, issuance_id long, discovered_via string, first_acquisition_ledger long, log_seq long")
    (r,) = sinks.membership_view(log).collect()
    assert (r.discovered_via, r.first_acquisition_ledger) == ("sweep", 7)


def test_delete_keeps_shared_data(spark):
    tables = {
        "issuances": spark.createDataFrame(ISSUANCES, I_SCHEMA),
        "account_issuance": spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "address string, issuance_id long"),
        "balance_deltas": spark.createDataFrame([("T1", 1, "a", 1, Decimal(1)), ("T2", 1, "b", 2, Decimal(1)), ("T3", 1, "a", 2, Decimal(1))], DELTA),
        "accounts": spark.createDataFrame([("a",), ("b",), ("rI",)], "address string"),
        "account_transactions": spark.createDataFrame([("T1", "a"), ("T2", "b"), ("T3", "a")], "hash string, address string"),
        "coverage": spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "address string, from_ledger long, to_ledger long"),
        "transactions": spark.createDataFrame([("T1", 1), ("T2", 1), ("T3", 1), ("T9", 1)], "hash string, ledger_index long"),
    }
    new, counts = maintenance.delete_issuance(tables, 1)
    assert {r.address for r in new["accounts"].collect()} == {"b", "rI"} and {r.hash for r in new["transactions"].collect()} == {"T2", "T3"}
    c = counts.first()
    assert (c.accounts_removed, c.deltas_removed, c.links_removed, c.coverage_removed, c.transactions_removed, c.deltas_kept) == (1, 1, 2, 1, 2, 1)


def test_history_pages(spark):
    tx = spark.createDataFrame([(f"H{i}", 100 + i // 2, "Payment") for i in range(9)], "hash string, ledger_index long, tx_type string")
    links = tx.select("hash", F.lit("a").alias("address"))
    accounts, coverage = links.select("address").distinct(), spark.createDataFrame([], "address string, from_ledger long, to_ledger long, reason string")
    seen, marker = [], None
    for _ in range(3):
        asked = spark.createDataFrame([(1, "a", None, None, True, 4, marker)], "request_id long, address string, low long, high long, forward boolean, limit int, marker string")
        rows = sorted(reports.account_history(asked, links, tx, coverage, accounts).collect(), key=lambda r: r["rank"])
        seen += [r.hash for r in rows]
        marker = rows[-1].next_marker
    assert seen == [f"H{i}" for i in range(9)] and marker is None


def test_claims(spark, issuances):
    members = spark.createDataFrame([("a", 1, 50), ("b", 1, None)], "address string, issuance_id long, first_acquisition_ledger long")
    swept = spark.createDataFrame([(1, 10, 40), (2, 10, 40)], "issuance_id long, from_ledger long, to_ledger long")
    got = {(r.address, r.from_ledger, r.to_ledger) for r in scope.sweep_claims(issuances, members, swept).collect()}
    assert got == {("a", 40, 40), ("b", 40, 40), ("rI", 40, 40), ("rI", 10, 40)}


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: X.currency_wire(F.lit("GBPX")), "4742505800000000000000000000000000000000"),
        (lambda: X.currency_readable(F.lit("4742505800000000000000000000000000000000")), "GBPX"),
        (lambda: X.currency_readable(F.lit("0" * 40)), "0" * 40),
        (lambda: X.currency_readable(F.lit("USD")), "USD"),
        (lambda: X.integer_amount(F.lit(" ")), 0),
        (lambda: X.integer_amount(F.lit("0x10")), 0),
        (lambda: X.integer_amount(F.lit("-12")), -12),
        (lambda: X.decimal_amount(F.lit("1.0000000000000000005")), None),
        (lambda: X.plain_text(F.lit("6.50").cast("decimal(10,2)")), "6.5"),
        (lambda: X.plain_text(F.lit("100").cast("decimal(10,2)")), "100"),
        (lambda: X.negate_text(F.lit("-5")), "5"),
        (lambda: X.negate_text(F.lit("0")), "0"),
        (lambda: X.requires_auth(F.lit(6)), True),
        (lambda: X.ticker(F.lit("7B2274223A22414243227D")), "ABC"),
        (lambda: X.ticker(F.lit("zz")), None),
        (lambda: X.short_label(F.lit("abcdefghijklmnopqrstuv")), "abcdefghijkl…stuv"),
        (lambda: X.page_limit(F.lit(1000), 200, 400), 400),
        (lambda: X.page_limit(F.lit(None), 200, 400), 200),
        (lambda: X.page_limit(F.lit(0.5), 200, 400), 1),
        (lambda: F.array_join(X.warnings(F.lit(True), True), ","), "2001,65001,65003,65004"),
    ],
)
def test_expressions(spark, make, want):
    assert one(spark, make()) == want


def test_exact_sums(spark):
    rows = [("k", "0.1"), ("k", "99999999999999999999999999999999999999"), ("k", "0.0000000000000000000000000001"), ("j", "6.50")]
    got = {r.k: r.total for r in exact.exact_sum(spark.createDataFrame(rows, "k string, v string"), ["k"], "v").collect()}
    assert got == {"k": "99999999999999999999999999999999999999.1000000000000000000000000001", "j": "6.5"}


def test_landing(spark, tmp_path):
    rows = spark.createDataFrame([(f"T{i}", i * 60_000, "Payment" if i % 2 else "TrustSet") for i in range(6)], "hash string, ledger_index long, tx_type string")
    archive.write_history(rows, str(tmp_path / "h"))
    assert {r.hash for r in archive.history(spark, str(tmp_path / "h"), 60_000, 240_000, "Payment").collect()} == {"T1", "T3"}


def test_tail_ingest(spark, issuances, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    event = lambda seq, kind, ledger, h=None, m=None: (seq, kind, True, ledger, 10 * ledger, h, "Payment", None, m)
    schema = "seq long, type string, validated boolean, ledger_index long, ledger_time long, hash string, tx_type string, accounts array<string>, meta_json string"
    first = [event(1, "ledger", 100), event(2, "transaction", 100, "T1", meta(token("Created", "rA", 5))), event(3, "transaction", 100, "T9", meta(token("Created", "x", 5, mpt="F" * 48)))]
    second = [event(4, "ledger", 104), event(5, "transaction", 104, "T2", meta(token("Modified", "rA", 3, 5), token("Created", "rB", 2))), event(2, "transaction", 100, "T1", meta(token("Created", "rA", 5)))]
    tables = ingest.Tables(spark, str(tmp_path / "tables"))
    for batch in (first, second):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))
        ingest.ingest(ingest.tail(spark, str(tmp_path / "landing")), tables, issuances, str(tmp_path / "state")).awaitTermination()
    log = lambda name: tables.log(name, ingest.SCHEMAS[name])
    assert sorted(r.hash for r in log("transactions").collect()) == ["T1", "T2"]
    assert {(r.address, r.delta, r.delta_text) for r in log("balance_deltas").collect()} == {("rA", 5, "5"), ("rA", -2, "-2"), ("rB", 2, "2")}
    assert {(r.hash, r.address) for r in log("account_transactions").collect()} == {("T1", "rA"), ("T1", "rI"), ("T2", "rA"), ("T2", "rB"), ("T2", "rI")}
    assert sorted(r.address for r in log("account_issuance").collect()) == ["rA", "rB"]
    assert sorted(r.ledger_index for r in log("ledgers").collect()) == [100, 104]
    # A replay of a batch changes nothing.
    ingest.ingest_batch(tables, issuances, spark.createDataFrame(second, schema), 1)
    assert log("transactions").count() == 2 and log("balance_deltas").count() == 3


def test_whole_tables_are_asked(spark):
    sf = "/root/testdata/sf0.001"
    t = DriverTables(spark, sf)
    rows = {name: registry.queries()[name](spark, sf) for name in ("cov7_beyond", "rpt5_tx", "sta3_trust_lines", "exp7_issuance_parts")}
    assert rows["cov7_beyond"].count() == t.balance_deltas().count()
    assert rows["rpt5_tx"].filter("status = 'success'").count() == t.transactions().count()
    lines = t.nodes().filter("issuance_id % 2 = 1 and ledger_index <= 1800")
    last = lines.groupBy("object_id").agg(F.max_by(F.struct("node_kind", "address"), F.struct("ledger_index", F.conv(F.substring("hash", 2, 20), 10, 10).cast("long"))).alias("last"))
    live = last.filter("last.node_kind <> 'DeletedNode'").select("last.address").distinct().count()
    assert rows["sta3_trust_lines"].select("address").distinct().count() == live
    assert rows["exp7_issuance_parts"].count() == t.issuances().filter("kind = 'mpt'").count()


def test_stream_gaps_by_batch(spark, tmp_path):
    tables = ingest.Tables(spark, str(tmp_path / "tables"))
    batches = [
        [("a", 1, 10), ("a", 150_000, 11), ("a", 250_001, 15), ("b", 2, 5)],
        [("a", 300_000, 14), ("a", 500_000, 20), ("b", 700_000, 6), ("b", 900_000, 9), ("c", 1, 3)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "source string, seq long, ledger_index long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source string, seq long, ledger_index long").parquet(str(tmp_path / "in"))
        ingest.stream_gaps(stream, tables, str(tmp_path / "state"), anchor=2).awaitTermination()
    got = {tuple(r)[:4] for r in tables.log("gaps", ingest.SCHEMAS["gaps"]).collect()}
    assert got == {("a", 1, 3, 9), ("a", 250_001, 12, 14), ("a", 500_000, 16, 19), ("b", 2, 3, 4), ("b", 900_000, 7, 8)}


def test_large_partitions_are_split(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 8).select(F.md5(F.col("id").cast("string")).alias("hash"), (F.col("id") % 2400).alias("ledger_index"), F.lit("Payment").alias("tx_type"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "1m")
    try:
        archive.write_history(rows, str(tmp_path / "history"))
        maintenance.compact(spark, str(tmp_path / "history"), str(tmp_path / "typed"), partition="tx_type")
        maintenance.compact(spark, str(tmp_path / "history"), str(tmp_path / "plain"))
    finally:
        spark.conf.unset(key)
    for name in ("history", "typed", "plain"):
        assert len(list((tmp_path / name).rglob("*.parquet"))) > 1, name
        assert spark.read.parquet(str(tmp_path / name)).select("hash").distinct().count() == 200_000


def test_pages_grow_in_number(spark):
    lines = spark.range(40_000).select(F.lit("rHot").alias("issuer"), F.concat(F.lit("r"), "id").alias("account"), F.lit("USD").alias("currency"))
    sizes = [r["count"] for r in upkeep_queries._pages(lines).groupBy("issuer", "page").count().collect()]
    assert len(sizes) == 40 and sum(sizes) == 40_000 and max(sizes) < 1300
