"""Answers with a status for every request, exact amounts, and the smaller operators, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import discovery, maintenance, nodes, reconcile, reports, scope, sinks, state, timeline
from ledgerloom.plans.archive_queries import exp7_issuance_parts
from ledgerloom.plans.registry import query
from ledgerloom.plans.report_queries import _LINES, _issuer_requests, _mpt_holders
from ledgerloom.sources import archive
from ledgerloom.sources.driver_tables import DriverTables, told_sql
from ledgerloom.streaming import ingest


def _tables(t: DriverTables, name: str) -> ingest.Tables:
    return ingest.Tables(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}")


def _long(x) -> Column:
    return F.lit(x).cast("long")


@query("""WITH b AS (SELECT issuance_id, address, CAST(sum(delta) AS BIGINT) AS n FROM a_balance_deltas GROUP BY 1, 2)
SELECT issuance_id, address, CASE WHEN n = 0 THEN '0' WHEN issuance_id % 2 = 0 THEN concat(CAST(n AS VARCHAR), repeat('0', 25))
  ELSE rtrim(concat(CASE WHEN n < 0 THEN '-' ELSE '' END, '0.', lpad(CAST(abs(n) AS VARCHAR), 20, '0')), '0') END AS balance FROM b""")
def agg1_exact_balances(t: DriverTables) -> DataFrame:
    """Balances from deltas of amounts far outside the decimal type, spelt in several ways."""
    even, created = F.col("issuance_id") % 2 == 0, F.length("hash") % 2 == F.col("custkey") % 2
    whole = lambda c: F.col(c).cast("long").cast("string")
    text = lambda c: F.when(even & created, F.concat(whole(c), F.lit("E+25"))).when(even, F.concat(whole(c), F.lit("00.0e23"))).when(
        created, F.concat(whole(c), F.lit("e-20"))
    ).otherwise(F.concat(whole(c), F.lit(".0e-20")))
    versions = t.nodes().select("hash", "ledger_index", "address", "issuance_id", "node_kind", text("final_amount").alias("amount_text"), text("previous_amount").alias("before_text"))
    return reports.exact_balances(nodes.exact_deltas(versions))


@query("""WITH d AS (SELECT d.*, row_number() OVER (PARTITION BY issuance_id, address ORDER BY ledger_index, hash) AS n FROM a_balance_deltas d),
m AS (SELECT issuance_id, address, 2300 AS ledger FROM a_account_issuance)
SELECT m.issuance_id, m.address, CASE WHEN count(*) FILTER (WHERE d.n = 3 AND m.issuance_id = 1) > 0 THEN 'unreadable' ELSE 'success' END AS status,
  CASE WHEN count(*) FILTER (WHERE d.n = 3 AND m.issuance_id = 1) = 0 THEN CAST(coalesce(sum(d.delta), 0) AS DOUBLE) END AS balance
FROM m LEFT JOIN d ON d.issuance_id = m.issuance_id AND d.address = m.address AND d.ledger_index <= m.ledger GROUP BY m.issuance_id, m.address""")
def rpt1_unreadable(t: DriverTables) -> DataFrame:
    """One delta of each account of an issuance is known to exist but not how much it is: no balance that needs it is told."""
    order = F.row_number().over(Window.partitionBy("issuance_id", "address").orderBy("ledger_index", "hash"))
    d = t.balance_deltas().withColumn("n", order)
    unknown = d.withColumn("delta", F.when((F.col("issuance_id") != 1) | (F.col("n") != 3), F.col("delta"))).drop("n")
    asked = t.account_issuance().select(F.concat_ws("|", "issuance_id", "address").alias("request_id"), "issuance_id", "address", _long(2300).alias("ledger"))
    out = reports.balance_at(asked, unknown, t.account_issuance(), t.coverage())
    return out.select("issuance_id", "address", "status", F.col("balance").cast("double").alias("balance"))


@query("""WITH q(request_id, issuance_id, address, low, high, status) AS (
  SELECT concat('all', issuance_id), issuance_id, NULL, 500, 900, 'success' FROM a_issuances WHERE issuance_id % 2 = 0
  UNION ALL SELECT DISTINCT concat('one', issuance_id, address), issuance_id, address, 0, 1200, 'success' FROM a_account_issuance WHERE issuance_id % 2 = 1
  UNION ALL SELECT concat('nobody', issuance_id), issuance_id, 'rNobody', 0, 99999, 'notInArchive' FROM a_issuances
  UNION ALL SELECT concat('unknown', issuance_id), issuance_id + 100, NULL, 0, 99999, 'notInArchive' FROM a_issuances
  UNION ALL SELECT concat('back', issuance_id), issuance_id, NULL, 900, 500, 'invalidParams' FROM a_issuances)
SELECT q.request_id, q.status, d.ledger_index, d.address, d.hash, CAST(d.delta AS DOUBLE) AS delta FROM q LEFT JOIN a_balance_deltas d
  ON q.status = 'success' AND d.issuance_id = q.issuance_id AND d.ledger_index BETWEEN q.low AND q.high AND (q.address IS NULL OR q.address = d.address)""")
def rpt2_answers(t: DriverTables) -> DataFrame:
    i, null = t.issuances(), F.lit(None).cast("string")

    def ask(rows: DataFrame, name: str, address, low: int, high: int, issuance=None) -> DataFrame:
        key = F.concat(F.lit(name), F.col("issuance_id").cast("string"), F.coalesce(address, F.lit("")) if name == "one" else F.lit(""))
        return rows.select(key.alias("request_id"), (F.col("issuance_id") if issuance is None else issuance).alias("issuance_id"), address.alias("address"), _long(low).alias("low"), _long(high).alias("high"))

    asked = ask(i.filter("issuance_id % 2 = 0"), "all", null, 500, 900)
    asked = asked.union(ask(t.account_issuance().filter("issuance_id % 2 = 1"), "one", F.col("address"), 0, 1200))
    asked = asked.union(ask(i, "nobody", F.lit("rNobody"), 0, 99999)).union(ask(i, "unknown", null, 0, 99999, F.col("issuance_id") + 100)).union(ask(i, "back", null, 900, 500))
    out = reports.itemised_answers(asked, t.balance_deltas(), i, t.account_issuance())
    return out.drop("delta_text").withColumn("delta", F.col("delta").cast("double"))


@query("""WITH q AS (SELECT issuance_id, max(g.ledger_index) FILTER (WHERE CAST(g.close_time AS TIMESTAMP) <= TIMESTAMP '1996-01-01') AS low,
  max(g.ledger_index) FILTER (WHERE CAST(g.close_time AS TIMESTAMP) <= TIMESTAMP '1996-07-01') AS high FROM a_issuances, a_ledgers g GROUP BY 1)
SELECT q.issuance_id AS request_id, 'success' AS status, d.ledger_index, d.address, d.hash, CAST(d.delta AS DOUBLE) AS delta
FROM q LEFT JOIN a_balance_deltas d ON d.issuance_id = q.issuance_id AND d.ledger_index BETWEEN q.low AND q.high""")
def rpt2_by_time(t: DriverTables) -> DataFrame:
    """Ranges between two times, each resolved to the ledger at or before it."""
    asked = t.issuances().select(
        F.col("issuance_id").alias("request_id"), "issuance_id", F.lit(None).cast("string").alias("address"), F.lit("1996-01-01").cast("timestamp").alias("since"), F.lit("1996-07-01").cast("timestamp").alias("until")
    )
    asked = timeline.resolve_times(timeline.resolve_times(asked, t.ledgers(), "since", "low"), t.ledgers(), "until", "high").drop("since", "until")
    return reports.itemised_answers(asked, t.balance_deltas(), t.issuances(), t.account_issuance()).drop("delta_text").withColumn("delta", F.col("delta").cast("double"))


@query(
    _LINES
    + """
w AS (SELECT m.issuance_id, count(*) FILTER (WHERE c.from_ledger IS NULL) AS uncovered, max(c.from_ledger) AS f, min(c.to_ledger) AS e
      FROM a_account_issuance m LEFT JOIN a_coverage c USING (address) GROUP BY m.issuance_id),
q AS (SELECT issuer, ledger FROM r UNION ALL SELECT concat('no', issuer), ledger FROM r),
v AS (SELECT q.issuer, q.ledger, count(line.issuance_id) > 0 AS tracked,
        bool_and(line.issuance_id IS NULL OR w.issuance_id IS NULL OR (w.uncovered = 0 AND w.f <= w.e AND q.ledger BETWEEN w.f AND w.e)) AS covered
      FROM q LEFT JOIN line USING (issuer) LEFT JOIN w USING (issuance_id) GROUP BY q.issuer, q.ledger),
h AS (SELECT v.issuer, v.ledger, line.currency, CASE WHEN d.address = 'rC10' THEN d.address END AS address, sum(d.delta) AS balance FROM v JOIN line USING (issuer) JOIN a_balance_deltas d USING (issuance_id)
      WHERE v.tracked AND v.covered AND d.ledger_index <= v.ledger AND d.address <> v.issuer GROUP BY ALL HAVING sum(d.delta) <> 0)
SELECT concat(v.issuer, '@', v.ledger) AS request_id, CASE WHEN NOT tracked THEN 'notInArchive' WHEN NOT covered THEN 'outOfCoverage' ELSE 'success' END AS status,
  h.address, h.currency, CAST(h.balance AS DOUBLE) AS amount FROM v LEFT JOIN h USING (issuer, ledger)"""
)
def rpt3_combined(t: DriverTables) -> DataFrame:
    """Obligations and a hot wallet, named as one text, in one answer; unknown issuers are refused."""
    asked = _issuer_requests(t).withColumn("hotwallets", F.lit("rC10"))
    asked = asked.union(asked.withColumn("issuer", F.concat(F.lit("no"), "issuer")).withColumn("request_id", F.concat(F.lit("no"), "request_id")))
    out = reports.gateway_balances(asked, t.balance_deltas(), t.account_issuance(), t.coverage(), t.issuances())
    return out.drop("amount_text").withColumn("amount", F.col("amount").cast("double"))


@query("""
WITH r AS (SELECT DISTINCT address FROM a_account_issuance),
q AS (SELECT r.*, c.from_ledger AS f, c.to_ledger AS e FROM r LEFT JOIN a_coverage c USING (address)),
rows_ AS (SELECT q.address, x.hash, x.ledger_index FROM q JOIN a_account_transactions l USING (address) JOIN a_transactions x USING (hash)
          WHERE (q.f IS NULL OR x.ledger_index >= q.f) AND (q.e IS NULL OR x.ledger_index <= q.e)),
n AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ledger_index, hash) AS n, count(*) OVER (PARTITION BY address) AS total FROM rows_)
SELECT address AS request_id, hash, ledger_index, CAST(n - 4 AS BIGINT) AS rank, CASE WHEN n = 8 AND total > 8 THEN concat(ledger_index, ':', hash) END AS next_marker
FROM n WHERE n BETWEEN 5 AND 8""")
def rpt4_second_page(t: DriverTables) -> DataFrame:
    """The pages behind the markers of all first pages."""
    null = F.lit(None)
    asked = t.account_issuance().select("address").distinct().select(
        F.col("address").alias("request_id"), "address", null.cast("long").alias("low"), null.cast("long").alias("high"), F.lit(True).alias("forward"), F.lit(4).alias("limit"), null.cast("string").alias("marker")
    )
    page = lambda asked: reports.account_history(asked, t.account_transactions(), t.transactions(), t.coverage(), t.accounts())
    markers = page(asked).filter("next_marker is not null").select("request_id", "next_marker")
    second = asked.drop("marker").join(markers, "request_id").withColumnRenamed("next_marker", "marker")
    return page(second).select("request_id", "hash", "ledger_index", F.col("rank").cast("long").alias("rank"), "next_marker").filter("hash is not null")


@query("""WITH last AS (SELECT object_id, arg_max(node_kind, (ledger_index, hash)) AS kind, any_value(issuance_id) AS issuance_id FROM a_nodes WHERE ledger_index <= 1500 AND issuance_id % 2 = 0 GROUP BY object_id),
n AS (SELECT *, row_number() OVER (PARTITION BY issuance_id ORDER BY object_id) AS n, count(*) OVER (PARTITION BY issuance_id) AS total FROM last WHERE kind <> 'DeletedNode'),
q(request_id, issuance_id, ledger, status) AS (SELECT concat('a', issuance_id), issuance_id, 1500, CASE WHEN kind = 'mpt' THEN 'success' ELSE 'notInArchive' END FROM a_issuances
  UNION ALL SELECT concat('b', issuance_id), issuance_id, 999999, 'outOfCoverage' FROM a_issuances WHERE kind = 'mpt'
  UNION ALL SELECT concat('c', issuance_id), issuance_id, NULL, 'invalidParams' FROM a_issuances WHERE kind = 'mpt')
SELECT q.request_id, q.status, n.object_id, CASE WHEN n.n = 30 AND n.total > 30 THEN n.object_id END AS next_marker
FROM q LEFT JOIN n ON q.status = 'success' AND n.issuance_id = q.issuance_id AND n.n <= 30""")
def rpt6_answers(t: DriverTables) -> DataFrame:
    ask = lambda rows, name, ledger: rows.select(
        F.concat(F.lit(name), F.col("issuance_id").cast("string")).alias("request_id"), "issuance_id", _long(ledger).alias("as_of_ledger"), F.lit(30).alias("limit"), F.lit(None).cast("string").alias("marker")
    )
    mpt = t.issuances().filter("kind = 'mpt'")
    asked = ask(t.issuances(), "a", 1500).union(ask(mpt, "b", 999999)).union(ask(mpt, "c", None))
    return reports.holder_answers(asked, _mpt_holders(t), t.issuances(), 2400).select("request_id", "status", "object_id", "next_marker")


@query("SELECT issuance_id, kind, enabled, f AS from_ledger, e AS to_ledger FROM a_issuances, (SELECT min(from_ledger) AS f, max(to_ledger) AS e FROM a_coverage) c")
def srt6_scope_listing(t: DriverTables) -> DataFrame:
    return reports.scope_listing(t.issuances(), t.coverage()).select("issuance_id", "kind", "enabled", "from_ledger", "to_ledger")


@query("""SELECT i.issuance_id, coalesce(m.n, 0) AS members, coalesce(d.n, 0) AS deltas, (SELECT count(*) FROM a_transactions) AS transactions, (SELECT count(*) FROM a_ledgers) AS ledgers FROM a_issuances i
  LEFT JOIN (SELECT issuance_id, count(DISTINCT address) AS n FROM a_account_issuance GROUP BY 1) m USING (issuance_id) LEFT JOIN (SELECT issuance_id, count(*) AS n FROM a_balance_deltas GROUP BY 1) d USING (issuance_id)""")
def agg11_table_counts(t: DriverTables) -> DataFrame:
    return reports.table_counts(t.issuances(), t.account_issuance(), t.balance_deltas(), t.transactions(), t.ledgers())


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'invalidApiVersion' WHEN event_type = 'error' THEN 'unsupported' WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'invalidParams' ELSE 'success' END AS status,
  CASE WHEN user_id % 5 = 0 THEN concat('api_version 2 is required, not ', CASE WHEN user_id % 10 = 0 THEN '1' ELSE 'none' END) WHEN event_type = 'error' THEN 'not served: server_state'
  WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'account is missing' END AS error FROM events""")
def flt6_validate(t: DriverTables) -> DataFrame:
    u, kind = F.col("user_id"), F.col("event_type")
    asked = t.raw("events").select(
        "event_id", F.when(kind == "error", "server_state").when(kind == "purchase", "account_tx").otherwise("ledger").alias("command"),
        F.when(u % 10 == 0, "1").when(u % 5 != 0, " 2").alias("api_version"), F.when(u % 3 == 0, " ").otherwise("rA").alias("account"),
    )
    return scope.validate(asked, {"account_tx": ("account",)}).select("event_id", "status", "error")


@query("SELECT hash, 'landing/history' AS source_endpoint, TRUE AS stamped FROM a_transactions")
def src7_stamped(t: DriverTables) -> DataFrame:
    return archive.stamped(t.transactions(), "landing/history").select("hash", "source_endpoint", F.col("fetched_at").isNotNull().alias("stamped"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS ticker FROM customer")
def exp13_tickers(t: DriverTables) -> DataFrame:
    """Names in hexadecimal JSON; a third of the texts is cut off, too long or no JSON."""
    n = F.col("c_custkey")
    whole = F.hex(F.encode(F.to_json(F.struct(F.when(n % 9 == 0, F.repeat("c_name", F.lit(4))).otherwise(F.col("c_name")).alias("t"))), "UTF-8"))
    odd = F.when(n % 9 == 3, F.concat(whole, F.lit("A"))).when(n % 9 == 6, F.hex(F.encode("c_name", "UTF-8"))).otherwise(whole)
    return t.raw("customer").select("c_custkey", X.ticker(odd).alias("ticker"))


@query("SELECT hash, 'tesSUCCESS' AS result FROM a_transactions WHERE hash IN (SELECT hash FROM a_movements)")
def exp14_result_codes(t: DriverTables) -> DataFrame:
    return t.documents_of_metadata().select("hash", X.result_code(X.parse_meta("meta_json")).alias("result"))


@query("SELECT issuance_id, (issuance_id // 10) * 16 + issuance_id % 10 AS sequence, lpad(CAST(n_regionkey AS VARCHAR), 40, '0') AS issuer FROM a_issuances JOIN nation ON n_nationkey = issuance_id WHERE kind = 'mpt'")
def exp7_issuance_parts_all(t: DriverTables) -> DataFrame:
    """As exp7_issuance_parts."""
    return exp7_issuance_parts(t)


@query("""WITH RECURSIVE rel AS (SELECT DISTINCT hash, issuance_id FROM a_movements), par AS (SELECT DISTINCT hash, ledger_index, address FROM a_movements),
edge AS (SELECT rel.issuance_id, l.address AS account, p.address AS party, min(p.ledger_index) AS ledger FROM rel JOIN a_account_transactions l USING (hash) JOIN par p USING (hash) GROUP BY 1, 2, 3),
reach AS (SELECT issuance_id, issuer_account AS address FROM a_issuances UNION SELECT e.issuance_id, e.party FROM reach r JOIN edge e ON e.issuance_id = r.issuance_id AND e.account = r.address),
led AS (SELECT e.issuance_id, e.party AS address, min(e.ledger) AS ledger FROM edge e JOIN reach r ON r.issuance_id = e.issuance_id AND r.address = e.account GROUP BY 1, 2)
SELECT r.issuance_id, r.address, led.ledger FROM reach r LEFT JOIN led USING (issuance_id, address)""")
def dsc3_traversal(t: DriverTables) -> DataFrame:
    """From every issuer along related transactions to everyone that they lead to, all issuances at once."""
    m = t.movements()
    edges = discovery.transfer_edges(m.select("hash", "ledger_index", "address").distinct(), m.select("hash", "issuance_id").distinct(), t.account_transactions())
    # One graph of all issuances: an address of an issuance is a node.
    node = lambda c: F.concat_ws("|", F.col("issuance_id").cast("string"), c)
    graph = edges.select(node("account").alias("account"), node("party").alias("party"), "ledger_index")
    seeds = t.issuances().select(F.lit("all").alias("group"), node("issuer_account").alias("address"))
    shared_folder(t.spark)
    out = discovery.closure(graph, seeds)
    return out.select(F.substring_index("address", "|", 1).cast("long").alias("issuance_id"), F.substring_index("address", "|", -1).alias("address"), "ledger")


@query("""SELECT issuance_id, address, min(ledger_index) AS first_acquisition_ledger, CASE WHEN issuance_id % 2 = 1 THEN 'trustline' WHEN issuance_id % 4 = 0 THEN 'authorization' ELSE 'traversal' END AS discovered_via
  FROM a_movements WHERE ledger_index <= CASE WHEN issuance_id % 2 = 1 THEN 1500 WHEN issuance_id % 4 = 0 THEN 1200 ELSE 99999 END GROUP BY issuance_id, address""")
def dsc6_by_strategy(t: DriverTables) -> DataFrame:
    """The three strategies find different holders; each issuance takes its own strategy's."""
    held = lambda upto: t.movements().filter(F.col("ledger_index") <= upto).groupBy("issuance_id", "address").agg(F.min("ledger_index").alias("first_acquisition_ledger"))
    flagged = t.issuances().withColumn("flags", F.when(F.col("issuance_id") % 4 == 0, 6).otherwise(2))
    return discovery.discover(held(1200), held(1500), held(99999), flagged)


def _events(t: DriverTables) -> DataFrame:
    return t.documents_of_metadata().select(
        F.col("tx_index").alias("seq"), F.lit("transaction").alias("type"), F.lit(True).alias("validated"), "ledger_index", F.lit(0).cast("long").alias("ledger_time"), "hash", "tx_type",
        F.array().cast("array<string>").alias("accounts"), "meta_json",
    )


@query("SELECT DISTINCT address, issuance_id, 'stream' AS discovered_via, CAST(NULL AS BIGINT) AS first_acquisition_ledger FROM a_movements")
def dsc8_stream_discovery(t: DriverTables) -> DataFrame:
    """Members that a stream finds in two batches; those of the first aren't found again by the second."""
    tables, base = _tables(t, "discovery"), f"{shared_folder(t.spark)}/landing-{uuid.uuid4().hex}"
    for half in ("ledger_index <= 1200", "ledger_index > 1200"):
        _events(t).filter(half).write.mode("append").option("compression", "gzip").json(f"{base}/in")
        ingest.ingest(ingest.tail(t.spark, f"{base}/in"), tables, t.issuances(), f"{base}/state").awaitTermination()
    return tables.log("account_issuance", ingest.SCHEMAS["account_issuance"]).drop("batch")


@query(f"""SELECT hash, ledger_index, address, issuance_id, {told_sql('delta')} AS delta FROM a_balance_deltas WHERE ledger_index <= 1000 OR ledger_index BETWEEN 1500 AND 1600 OR ledger_index BETWEEN 1550 AND 1900""")
def str4_heal_into(t: DriverTables) -> DataFrame:
    """Deltas after a tail up to a ledger and the healing of two gaps that overlap each other and it."""
    tables, history = _tables(t, "heal"), t.documents_of_metadata()
    ingest.ingest_batch(tables, t.issuances(), _events(t).filter("ledger_index <= 1000"), 1)
    gaps = t.spark.createDataFrame([(900, 1000), (1500, 1600), (1550, 1900)], "from_ledger long, to_ledger long")
    ingest.heal_into(tables, t.issuances(), gaps, history, 2)
    return tables.log("balance_deltas", ingest.SCHEMAS["balance_deltas"]).drop("batch").withColumn("delta", F.col("delta_text")).drop("delta_text")


@query("SELECT hash, ledger_index FROM a_transactions WHERE ledger_index BETWEEN 2000 AND (SELECT max(ledger_index) FROM a_ledgers)")
def str5_after_backfill(t: DriverTables) -> DataFrame:
    """The stretch between a finished sweep and the tail, healed from landed history."""
    now = timeline.latest_seen(t.ledgers(), t.transactions()).first()["latest"]
    return ingest.heal(ingest.after_backfill(2000, now, t.spark), t.transactions()).select("hash", "ledger_index")


@query("""SELECT (SELECT count(*) FROM a_transactions) AS ingested, (SELECT count(*) FROM (SELECT ledger_index, max(ledger_index) OVER (ORDER BY seq, ledger_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a_tail) x
  WHERE ledger_index > p + 1) AS gaps, (SELECT max(ledger_index) FROM a_ledgers) AS last_ledger""")
def str8_statistics(t: DriverTables) -> DataFrame:
    tables = _tables(t, "statistics")
    tables.append("transactions", t.transactions().select("hash", "ledger_index", "tx_type", F.lit(None).cast("string").alias("meta_json")), 1)
    tables.append("ledgers", t.ledgers(), 1)
    return ingest.statistics(tables, timeline.gaps(t.tail()))


@query("""WITH s AS (SELECT o_orderkey AS n, concat('rC', CAST(o_custkey AS VARCHAR)) AS address, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 1 AS ledger FROM orders),
q AS (SELECT concat('rC', CAST(c_custkey AS VARCHAR)) AS address FROM customer)
SELECT q.address, CASE WHEN coalesce(arg_max(s.n % 7 = 0, (s.ledger, s.n)), TRUE) THEN 'notInArchive' ELSE 'success' END AS status,
  CASE WHEN NOT arg_max(s.n % 7 = 0, (s.ledger, s.n)) THEN CAST(arg_max(s.n, (s.ledger, s.n)) AS VARCHAR) END AS balance FROM q LEFT JOIN s ON s.address = q.address AND s.ledger <= 1500 GROUP BY q.address""")
def sta2_account_roots(t: DriverTables) -> DataFrame:
    """The newest root of every customer's account at a ledger; every seventh order deletes it."""
    o = t.raw("orders").withColumn("address", F.concat(F.lit("rC"), F.col("o_custkey").cast("string")))
    kind = F.when(F.col("o_orderkey") % 7 == 0, "DeletedNode").otherwise("ModifiedNode")
    fields = F.struct(F.col("address").alias("Account"), F.col("o_orderkey").cast("string").alias("Balance"))
    node = F.create_map(kind, F.struct(F.lit("AccountRoot").alias("LedgerEntryType"), F.col("address").alias("LedgerIndex"), fields.alias("FinalFields")))
    meta = F.to_json(F.struct(F.col("o_orderkey").cast("int").alias("TransactionIndex"), F.lit("tesSUCCESS").alias("TransactionResult"), F.array(node).alias("AffectedNodes")))
    tx = o.select(t._hash().alias("hash"), t._ledger().alias("ledger_index"), meta.alias("meta_json"))
    asked = t.raw("customer").select(F.concat(F.lit("rC"), F.col("c_custkey").cast("string")).alias("address")).select(F.col("address").alias("request_id"), "address", _long(1500).alias("as_of_ledger"))
    return state.account_roots(nodes.flatten(tx), asked).select("address", "status", F.col("fields.Balance").alias("balance"))


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY address) AS n FROM (SELECT DISTINCT address FROM a_accounts) x),
s AS (SELECT l.address, max(x.ledger_index) AS m FROM a_account_transactions l JOIN a_transactions x USING (hash) GROUP BY 1), l AS (SELECT max(ledger_index) AS latest FROM a_ledgers)
SELECT c.address, CASE WHEN length(c.address) % 2 = 0 THEN v.to_ledger ELSE coalesce(s.m, latest) END AS as_of_ledger, length(c.address) % 2 = 1 OR v.address IS NULL AS uncovered
FROM c LEFT JOIN (SELECT * FROM a_coverage WHERE length(address) % 2 = 0) v USING (address) LEFT JOIN s USING (address), l WHERE length(c.address) % 2 = 1 OR v.address IS NOT NULL
UNION ALL SELECT 'rNobody', latest, TRUE FROM l""")
def sta6_newest_seen(t: DriverTables) -> DataFrame:
    """Accounts without coverage tell the newest ledger in which they were seen, unknown ones the latest ledger."""
    some = t.coverage().filter("length(address) % 2 = 0")
    known = t.accounts().select("address").distinct()
    asked = known.filter("length(address) % 2 = 1").union(known.join(some, "address", "left_semi")).union(t.spark.range(1).select(F.lit("rNobody")))
    seen = scope.data_range(t.account_transactions(), t.transactions())
    return state.reported_ledger(asked, some, timeline.latest_seen(t.ledgers(), t.transactions()), seen)


@query("""WITH last AS (SELECT object_id, arg_max(node_kind, (ledger_index, CAST(substr(hash, 2) AS BIGINT) % 1000000)) AS kind, arg_max(final_amount, (ledger_index, CAST(substr(hash, 2) AS BIGINT) % 1000000)) AS amount FROM a_nodes GROUP BY object_id)
SELECT object_id, kind = 'DeletedNode' AS deleted, """ + told_sql("amount", "CAST(split_part(object_id, '|', 2) AS BIGINT)") + """ AS amount FROM last""")
def sta7_merged_state(t: DriverTables) -> DataFrame:
    """The state table made of later versions first and earlier ones merged in afterwards."""
    versions = nodes.versions(nodes.flatten(t.documents_of_metadata()), t.issuances())
    late = state.latest(versions.filter("ledger_index > 1200"))
    return state.merge_state(late, versions.filter("ledger_index <= 1200")).select("object_id", "deleted", exact.canonical("amount_text").alias("amount"))


@query("""SELECT DISTINCT address, f AS from_ledger, CAST(2000 AS BIGINT) AS to_ledger, 'issuer_sweep' AS reason FROM (SELECT issuance_id, least(2000, greatest(100, min(first_acquisition_ledger))) AS f FROM a_account_issuance GROUP BY 1) w
  JOIN (SELECT issuance_id, address FROM a_account_issuance UNION SELECT issuance_id, issuer_account FROM a_issuances) a USING (issuance_id)""")
def snk7_coverage_log(t: DriverTables) -> DataFrame:
    """Claims appended to the log by a batch that runs twice: they are there once."""
    tables = _tables(t, "coverage")
    swept = t.issuances().join(t.account_issuance(), "issuance_id", "left_semi").select("issuance_id", _long(100).alias("from_ledger"), _long(2000).alias("to_ledger"))
    for _ in range(2):
        tables.append("coverage", scope.sweep_claims(t.issuances(), t.account_issuance(), swept), 5)
    return tables.log("coverage", ingest.SCHEMAS["coverage"]).drop("batch")


_BALANCES = "b AS (SELECT issuance_id, address, sum(delta) AS balance FROM a_balance_deltas GROUP BY 1, 2)"


@query(f"""WITH {_BALANCES}, n AS (SELECT issuance_id, count(*) FILTER (WHERE (address LIKE '%7' AND balance <> 0) OR address LIKE '%3') AS n FROM b GROUP BY 1), r(run_id) AS (VALUES (1), (2))
SELECT i.issuance_id, CAST(run_id AS BIGINT) AS run_id, run_id = 1 OR coalesce(n.n, 0) = 0 AS passed, CASE WHEN run_id = 1 THEN 0 ELSE coalesce(n.n, 0) END AS discrepancies, TRUE AS stamped
FROM a_issuances i LEFT JOIN n USING (issuance_id), r""")
def snk8_run_log(t: DriverTables) -> DataFrame:
    """Two reconciliations in the log: one without differences, one with."""
    tables, ours = _tables(t, "runs"), reports.current_balances(t.balance_deltas())
    theirs = ours.drop("balance_text").filter("address not like '%7'").withColumn("balance", F.col("balance") + F.when(F.col("address").endswith("3"), 1).otherwise(0))
    for run, other in ((1, ours), (2, theirs)):
        tables.append("reconciliation_run", reconcile.verdicts(t.issuances(), reconcile.compare(ours, other), run), run)
    log = tables.log("reconciliation_run", ingest.SCHEMAS["reconciliation_run"])
    return log.select("issuance_id", "run_id", "passed", "discrepancies", F.col("ran_at").isNotNull().alias("stamped"))


@query("SELECT n_nationkey * 2 AS issuance_id, n_nationkey * 2 IN (SELECT issuance_id FROM a_issuances) AS applied FROM nation")
def snk10_changes_applied(t: DriverTables) -> DataFrame:
    changes = t.raw("nation").select((F.col("n_nationkey") * 2).cast("long").alias("issuance_id"), F.lit(False).alias("enabled"))
    return sinks.changes_applied(t.issuances(), changes).select("issuance_id", "applied")


@query("""SELECT concat('{"a":{"b":[{"c":', ledger_index, ',"d":"', tx_type, '"}],"z":"', hash, '"},"k":1}') AS value FROM a_transactions""")
def snk11_nested_export(t: DriverTables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    inner = F.array(F.struct(F.col("tx_type").alias("d"), F.col("ledger_index").alias("c")))
    sinks.export_json(t.transactions().select(F.lit(1).alias("k"), F.struct(F.col("hash").alias("z"), inner.alias("b")).alias("a")), path)
    return t.spark.read.text(path)


@query("""WITH p AS (SELECT hash, ledger_index, address FROM a_movements UNION SELECT hash, ledger_index, issuer_account FROM a_movements JOIN a_issuances USING (issuance_id) WHERE kind = 'iou'),
x AS (SELECT * FROM a_transactions WHERE hash IN (SELECT hash FROM a_movements))
SELECT hash, ledger_index, address FROM p UNION SELECT hash, ledger_index, concat('rD', tx_index % 10) FROM x WHERE tx_index % 2 = 0 UNION SELECT hash, ledger_index, concat('rH', tx_index % 10) FROM x WHERE tx_index % 3 = 0""")
def nod10_named_parties(t: DriverTables) -> DataFrame:
    """Destinations and holders that a transaction names besides those whose objects it touches."""
    n = F.col("tx_index")
    last = (n % 10).cast("string")
    first = t.movements().groupBy("hash").agg(F.min("address").alias("account"))
    tx = t.transactions().join(first, "hash").select(
        "hash", "ledger_index", "account", F.when(n % 2 == 0, F.concat(F.lit("rD"), last)).alias("destination"), F.when(n % 3 == 0, F.concat(F.lit("rH"), last)).alias("holder")
    )
    return nodes.parties(tx, nodes.flatten(t.documents_of_metadata()))


def _with_exclusive(t: DriverTables) -> dict[str, DataFrame]:
    """The tables with one account for each supplier that holds its nation's token alone, and jobs and runs."""
    s = t.raw("supplier").select(F.concat(F.lit("rS"), F.col("s_suppkey").cast("string")).alias("address"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("hash"), F.col("s_nationkey").cast("long").alias("issuance_id"))
    one = lambda *columns: s.select(*columns)
    jobs = t.account_issuance().select("issuance_id", "address").union(one((F.col("issuance_id") + 1).alias("issuance_id"), "address"))
    return {
        "issuances": t.issuances(),
        "account_issuance": t.account_issuance().select("address", "issuance_id").union(one("address", "issuance_id")),
        "balance_deltas": t.balance_deltas().union(one("hash", _long(100), "address", "issuance_id", F.lit(5).cast("decimal(28,2)"))),
        "accounts": t.accounts().select("address").union(one("address")),
        "account_transactions": t.account_transactions().union(one("hash", "address")),
        "coverage": t.coverage().select("address").union(one("address")),
        "transactions": t.transactions().select("hash").union(one("hash")),
        "backfill_job": jobs,
        "reconciliation_run": t.issuances().select("issuance_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id")),
    }


@query("SELECT concat('rS', CAST(s_suppkey AS VARCHAR)) AS address FROM supplier WHERE s_nationkey = 4")
def set1_exclusive(t: DriverTables) -> DataFrame:
    return maintenance.exclusive_accounts(_with_exclusive(t)["account_issuance"], t.issuances().filter("issuance_id = 4").select("issuance_id"))


@query("""WITH s AS (SELECT count(*) AS n FROM supplier WHERE s_nationkey = 4), d AS (SELECT count(*) AS n FROM a_balance_deltas WHERE issuance_id = 4),
t AS (SELECT count(*) AS n FROM a_transactions WHERE hash NOT IN (SELECT hash FROM a_account_transactions) AND hash NOT IN (SELECT hash FROM a_balance_deltas WHERE issuance_id <> 4)),
j AS (SELECT (SELECT count(*) FROM a_account_issuance WHERE issuance_id = 4) + (SELECT count(*) FROM supplier WHERE s_nationkey IN (3, 4)) AS n)
SELECT s.n AS accounts_removed, d.n + s.n AS deltas_removed, CAST(0 AS BIGINT) AS deltas_kept, s.n AS links_removed, s.n AS coverage_removed, j.n AS jobs_removed, CAST(2 AS BIGINT) AS runs_removed,
  t.n + s.n AS transactions_removed FROM s, d, t, j""")
def mnt1_delete_exclusive(t: DriverTables) -> DataFrame:
    """An issuance with accounts of its own goes with all that is theirs."""
    return maintenance.delete_issuance(_with_exclusive(t), 4)[1]
