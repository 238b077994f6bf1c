"""Reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reports, scope, state, timeline
from ledgerloom.plans.registry import query
from ledgerloom.sources.driver_tables import DriverTables


def _number(*names: str):
    return {n: F.col(n).cast("double") for n in names}


def _balance_requests(t: DriverTables) -> DataFrame:
    own = t.account_issuance()
    asked = own.select("address", "issuance_id", F.explode(F.array(F.lit(1200), F.lit(2000)).cast("array<long>")).alias("ledger"))
    other = own.filter("custkey % 10 = 0").select("address", F.lit(99).cast("long").alias("issuance_id"), F.lit(1200).cast("long").alias("ledger")).distinct()
    return asked.union(other).withColumn("request_id", F.concat_ws("|", "address", "issuance_id", "ledger"))


@query("""
WITH r AS (SELECT address, issuance_id, CAST(ledger AS BIGINT) AS ledger FROM a_account_issuance, (VALUES (1200), (2000)) v(ledger)
           UNION ALL SELECT DISTINCT address, CAST(99 AS BIGINT), CAST(1200 AS BIGINT) FROM a_account_issuance WHERE custkey % 10 = 0),
s AS (SELECT address, issuance_id, sum(delta) FILTER (WHERE ledger_index <= 1200) AS first, sum(delta) FILTER (WHERE ledger_index <= 2000) AS second FROM a_balance_deltas GROUP BY 1, 2)
SELECT r.address, r.issuance_id, r.ledger, CASE WHEN m.address IS NOT NULL THEN CAST(coalesce(CASE r.ledger WHEN 1200 THEN s.first ELSE s.second END, 0) AS DOUBLE) END AS balance,
  CASE WHEN m.address IS NULL THEN 'notInArchive' ELSE 'success' END AS status, coalesce(r.ledger > c.to_ledger, TRUE) AS beyond_coverage
FROM r LEFT JOIN s USING (address, issuance_id) LEFT JOIN a_account_issuance m ON m.address = r.address AND m.issuance_id = r.issuance_id
LEFT JOIN a_coverage c ON c.address = r.address""")
def rpt1_balance_at(t: DriverTables) -> DataFrame:
    out = reports.balance_at(_balance_requests(t), t.balance_deltas(), t.account_issuance(), t.coverage())
    return out.drop("request_id", "balance_text").withColumns(_number("balance"))


@query("""
SELECT issuance_id, ledger_index, address, hash, CAST(delta AS DOUBLE) AS delta FROM a_balance_deltas
WHERE (issuance_id % 2 = 0 AND ledger_index BETWEEN 500 AND 900) OR (issuance_id = 1 AND address = 'rC1')""")
def rpt2_transactions(t: DriverTables) -> DataFrame:
    even = t.issuances().filter("issuance_id % 2 = 0").select("issuance_id", F.lit(None).cast("string").alias("address"), F.lit(500).alias("low"), F.lit(900).alias("high"))
    one = t.issuances().filter("issuance_id = 1").select("issuance_id", F.lit("rC1").alias("address"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    asked = even.union(one).withColumn("request_id", F.col("issuance_id"))
    return reports.itemised(asked, t.balance_deltas()).drop("delta_text").withColumnRenamed("request_id", "issuance_id").withColumns(_number("delta"))


def _issuer_requests(t: DriverTables) -> DataFrame:
    hot = F.array(F.lit("rC10"), F.lit("rC20"), F.lit("rC31"))
    known = t.issuances().select("issuer_account").distinct().select(F.col("issuer_account").alias("issuer"))
    asked = known.select("issuer", F.explode(F.array(F.lit(2395), F.lit(100)).cast("array<long>")).alias("ledger"), hot.alias("hotwallets"))
    return asked.withColumn("request_id", F.concat_ws("@", "issuer", "ledger"))


_LINES = """
WITH r AS (SELECT DISTINCT issuer_account AS issuer, CAST(ledger AS BIGINT) AS ledger FROM a_issuances, (VALUES (2395), (100)) v(ledger)),
line AS (SELECT issuance_id, issuer_account AS issuer, CASE WHEN length(currency) = 3 THEN currency ELSE rpad(hex(encode(currency)), 40, '0') END AS currency
         FROM a_issuances WHERE kind = 'iou' AND enabled),
"""


@query(
    _LINES
    + """
w AS (SELECT m.issuance_id, count(*) FILTER (WHERE c.from_ledger IS NULL) AS uncovered, max(c.from_ledger) AS f, min(c.to_ledger) AS e
      FROM a_account_issuance m LEFT JOIN a_coverage c USING (address) GROUP BY m.issuance_id),
v AS (SELECT r.issuer, r.ledger, count(line.issuance_id) > 0 AS tracked,
        bool_and(line.issuance_id IS NULL OR w.issuance_id IS NULL OR (w.uncovered = 0 AND w.f <= w.e AND r.ledger BETWEEN w.f AND w.e)) AS covered
      FROM r LEFT JOIN line USING (issuer) LEFT JOIN w USING (issuance_id) GROUP BY r.issuer, r.ledger),
h AS (SELECT v.issuer, v.ledger, line.currency, d.address, sum(d.delta) AS balance FROM v JOIN line USING (issuer) JOIN a_balance_deltas d USING (issuance_id)
      WHERE v.tracked AND v.covered AND d.ledger_index <= v.ledger GROUP BY ALL HAVING sum(d.delta) <> 0),
o AS (SELECT issuer, ledger, currency, CAST(sum(balance) AS DOUBLE) AS obligation FROM h WHERE address NOT IN ('rC10', 'rC20', 'rC31') AND address <> issuer
      GROUP BY issuer, ledger, currency HAVING sum(balance) <> 0)
SELECT concat(v.issuer, '@', v.ledger) AS request_id, CASE WHEN NOT tracked THEN 'notInArchive' WHEN NOT covered THEN 'outOfCoverage' ELSE 'success' END AS status,
  o.currency, o.obligation FROM v LEFT JOIN o USING (issuer, ledger)"""
)
def rpt3_gateway_balances(t: DriverTables) -> DataFrame:
    out = reports.obligations(_issuer_requests(t), t.balance_deltas(), t.account_issuance(), t.coverage(), t.issuances())
    return out.drop("obligation_text").withColumns(_number("obligation"))


@query(
    _LINES
    + """
x AS (SELECT 1) SELECT concat(r.issuer, '@', r.ledger) AS request_id, d.address, line.currency, CAST(sum(d.delta) AS DOUBLE) AS balance
FROM r JOIN line USING (issuer) JOIN a_balance_deltas d USING (issuance_id)
WHERE d.ledger_index <= r.ledger AND d.address IN ('rC10', 'rC20', 'rC31') GROUP BY ALL HAVING sum(d.delta) <> 0"""
)
def rpt3_hot_wallets(t: DriverTables) -> DataFrame:
    return reports.hot_wallet_balances(_issuer_requests(t), t.balance_deltas(), t.issuances()).drop("balance_text").withColumns(_number("balance"))


@query("""
WITH r AS (SELECT DISTINCT address, custkey, custkey % 2 = 0 AS forward FROM a_account_issuance
           UNION ALL SELECT 'rNobody', CAST(-1 AS BIGINT), TRUE),
q AS (SELECT r.*, c.from_ledger AS f, c.to_ledger AS e, a.address IS NOT NULL AS known FROM r LEFT JOIN a_coverage c USING (address) LEFT JOIN a_accounts a USING (address)),
rows_ AS (SELECT q.address, q.forward, x.hash, x.ledger_index, x.tx_type FROM q JOIN a_account_transactions l USING (address) JOIN a_transactions x USING (hash)
          WHERE q.known AND x.ledger_index >= greatest(300, coalesce(q.f, 300)) AND (q.e IS NULL OR x.ledger_index <= q.e)),
n AS (SELECT *, CASE WHEN forward THEN row_number() OVER (PARTITION BY address ORDER BY ledger_index, hash)
        ELSE row_number() OVER (PARTITION BY address ORDER BY ledger_index DESC, hash DESC) END AS rank, count(*) OVER (PARTITION BY address) AS total FROM rows_)
SELECT q.address AS request_id, CASE WHEN q.known THEN 'success' ELSE 'notInArchive' END AS status, (q.f IS NULL OR 300 < q.f) AS out_of_range,
  n.hash, n.ledger_index, n.tx_type, CAST(n.rank AS BIGINT) AS rank, CASE WHEN n.rank = 5 AND n.total > 5 THEN concat(n.ledger_index, ':', n.hash) END AS next_marker
FROM q LEFT JOIN (SELECT * FROM n WHERE rank <= 5) n USING (address)""")
def rpt4_account_tx(t: DriverTables) -> DataFrame:
    who = t.account_issuance().select("address", "custkey").distinct()
    nobody = t.spark.range(1).select(F.lit("rNobody").alias("address"), F.lit(-1).cast("long").alias("custkey"))
    null = F.lit(None)
    asked = who.union(nobody).select(
        F.col("address").alias("request_id"), "address", F.lit(300).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"),
        ((F.col("custkey") % 2 == 0) | (F.col("custkey") < 0)).alias("forward"), F.lit(5).alias("limit"), null.cast("string").alias("marker"),
    )
    out = reports.account_history(asked, t.account_transactions(), t.transactions(), t.coverage(), t.accounts())
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH r AS (SELECT hash FROM a_transactions UNION ALL SELECT concat(hash, 'x') FROM a_transactions)
SELECT r.hash, x.ledger_index, x.tx_type, CASE WHEN x.hash IS NULL THEN 'notInArchive' ELSE 'success' END AS status FROM r LEFT JOIN a_transactions x USING (hash)""")
def rpt5_tx(t: DriverTables) -> DataFrame:
    tx = t.transactions()
    asked = tx.select("hash").union(tx.select(F.concat("hash", F.lit("x"))))
    return reports.transactions_by_hash(asked, tx).select("hash", "ledger_index", "tx_type", "status")


@query("""
WITH r AS (SELECT hash FROM a_transactions UNION ALL SELECT concat(hash, 'x') FROM a_transactions)
SELECT r.hash, x.ledger_index, x.tx_type, CASE WHEN x.hash IS NULL THEN 'notInArchive' ELSE 'success' END AS status FROM r LEFT JOIN a_transactions x USING (hash)""")
def rpt5_tx_all(t: DriverTables) -> DataFrame:
    """Every transaction and as many unknown hashes, as in rpt5_tx."""
    return rpt5_tx(t)


_HOLDERS = """
WITH last AS (SELECT object_id, arg_max(node_kind, (ledger_index, hash)) AS kind, arg_max(final_amount, (ledger_index, hash)) AS amount,
    any_value(address) AS address, any_value(issuance_id) AS issuance_id FROM a_nodes WHERE ledger_index <= 1500 AND issuance_id % 2 = 0 GROUP BY object_id),
live AS (SELECT * FROM last WHERE kind <> 'DeletedNode')
"""


def _mpt_holders(t: DriverTables) -> DataFrame:
    versions = t.nodes().filter("issuance_id % 2 = 0").select(
        "hash", "ledger_index", F.conv(F.substring("hash", 2, 20), 10, 10).cast("long").alias("tx_index"), "object_id", "address", "issuance_id",
        F.col("final_amount").alias("amount"), F.lit(0).alias("flags"), (F.col("node_kind") == "DeletedNode").alias("deleted"),
    )
    points = t.issuances().filter("kind = 'mpt'").select("issuance_id", F.lit(1500).cast("long").alias("as_of_ledger"))
    return state.holders_at(versions, points)


@query(_HOLDERS + "SELECT issuance_id, CAST(1500 AS BIGINT) AS as_of_ledger, address, object_id, CAST(amount AS DOUBLE) AS amount FROM live")
def sta4_token_holders(t: DriverTables) -> DataFrame:
    return _mpt_holders(t).drop("flags").withColumns(_number("amount"))


@query(
    _HOLDERS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY issuance_id ORDER BY object_id) AS rank, count(*) OVER (PARTITION BY issuance_id) AS total FROM live
WHERE object_id > 'rC2')
SELECT issuance_id, object_id, address, CAST(amount AS DOUBLE) AS amount, CAST(rank AS BIGINT) AS rank, CASE WHEN rank = 20 AND total > 20 THEN object_id END AS next_marker FROM n WHERE rank <= 20"""
)
def rpt6_mpt_holders(t: DriverTables) -> DataFrame:
    asked = t.issuances().filter("kind = 'mpt'").select(
        F.col("issuance_id").alias("request_id"), "issuance_id", F.lit(1500).cast("long").alias("as_of_ledger"), F.lit(20).alias("limit"), F.lit("rC2").alias("marker")
    )
    out = reports.holder_pages(asked, _mpt_holders(t))
    return out.select("issuance_id", "object_id", "address", F.col("amount").cast("double").alias("amount"), F.col("rank").cast("long").alias("rank"), "next_marker")


@query("""
WITH top AS (SELECT * FROM a_transactions ORDER BY ledger_index DESC, hash LIMIT 10),
lab AS (SELECT DISTINCT top.hash, CASE WHEN length(coalesce(currency, mpt_issuance_id)) > 18
        THEN concat(left(coalesce(currency, mpt_issuance_id), 12), '…', right(coalesce(currency, mpt_issuance_id), 4)) ELSE coalesce(currency, mpt_issuance_id) END AS label
        FROM top JOIN a_balance_deltas d USING (hash) JOIN a_issuances i USING (issuance_id))
SELECT top.hash, top.ledger_index, top.tx_type, string_agg(label, ',' ORDER BY label) AS labels, strftime(any_value(CAST(g.close_time AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS closed
FROM top LEFT JOIN lab USING (hash) LEFT JOIN a_ledgers g USING (ledger_index) GROUP BY top.hash, top.ledger_index, top.tx_type""")
def rpt8_recent_activity(t: DriverTables) -> DataFrame:
    out = reports.recent_activity(t.transactions(), t.balance_deltas(), t.issuances(), t.ledgers())
    return out.select("hash", "ledger_index", "tx_type", "labels", F.date_format("close_time", "yyyy-MM-dd HH:mm:ss").alias("closed"))


def _jobs(t: DriverTables) -> DataFrame:
    """A job for each membership, its state told by the customer's number."""
    s = F.element_at(F.array(*map(F.lit, ("done", "done", "running", "failed", "pending"))), (F.col("custkey") % 5 + 1).cast("int"))
    return t.account_issuance().filter("issuance_id % 4 <> 3 or custkey % 5 < 2").select("issuance_id", "address", s.alias("status"), (F.col("custkey") % 17).alias("tx_count"))


def _runs(t: DriverTables) -> DataFrame:
    """Two reconciliation runs for each issuance."""
    i = t.issuances().select("issuance_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("run_id"))
    return i.select(
        "issuance_id", "run_id", F.timestamp_seconds(F.col("run_id") * 86400 * (F.col("issuance_id") % 2)).alias("ran_at"),
        ((F.col("issuance_id") + F.col("run_id")) % 3 == 0).alias("passed"), ((F.col("issuance_id") + F.col("run_id")) % 3).alias("discrepancies"),
    )


_JOBS = """j AS (SELECT issuance_id, address, list_extract(['done', 'done', 'running', 'failed', 'pending'], CAST(custkey % 5 + 1 AS INT)) AS status, custkey % 17 AS tx_count
FROM a_account_issuance WHERE issuance_id % 4 <> 3 OR custkey % 5 < 2)"""


@query(f"""
WITH {_JOBS},
mem AS (SELECT issuance_id, count(DISTINCT address) AS members FROM a_account_issuance GROUP BY 1),
st AS (SELECT issuance_id, count(DISTINCT hash) AS transactions, min(ledger_index) AS first_ledger, max(ledger_index) AS last_ledger FROM a_balance_deltas GROUP BY 1),
w AS (SELECT m.issuance_id, max(c.from_ledger) AS f, min(c.to_ledger) AS e FROM a_account_issuance m JOIN a_coverage c USING (address) GROUP BY 1),
p AS (SELECT issuance_id, count(*) FILTER (WHERE status = 'done') AS jobs_done, count(*) AS jobs_total FROM j GROUP BY 1 HAVING count(*) FILTER (WHERE status IN ('pending', 'running')) > 0)
SELECT i.issuance_id, coalesce(mem.members, 0) AS members, coalesce(st.transactions, 0) AS transactions, st.first_ledger, st.last_ledger,
  CASE WHEN w.f <= w.e THEN w.f END AS covered_from, CASE WHEN w.f <= w.e THEN w.e END AS covered_to, p.jobs_done, p.jobs_total, (i.issuance_id + 2) % 3 = 0 AS reconciled
FROM a_issuances i LEFT JOIN mem USING (issuance_id) LEFT JOIN st USING (issuance_id) LEFT JOIN w USING (issuance_id) LEFT JOIN p USING (issuance_id)""")
def rpt9_issuance_status(t: DriverTables) -> DataFrame:
    out = reports.issuance_status(t.issuances(), t.account_issuance(), t.balance_deltas(), t.coverage(), _jobs(t), _runs(t))
    return out.select("issuance_id", "members", "transactions", "first_ledger", "last_ledger", "covered_from", "covered_to", "jobs_done", "jobs_total", "reconciled")


@query("""SELECT (SELECT count(*) FROM a_issuances) AS issuances, (SELECT count(*) FROM a_issuances WHERE enabled) AS enabled,
  min(from_ledger) AS from_ledger, max(to_ledger) AS to_ledger FROM a_coverage""")
def rpt10_scope_summary(t: DriverTables) -> DataFrame:
    return reports.scope_summary(t.issuances(), t.coverage())


@query("SELECT greatest((SELECT max(ledger_index) FROM a_ledgers), (SELECT max(ledger_index) FROM a_transactions)) AS latest")
def rpt11_latest_ledger(t: DriverTables) -> DataFrame:
    return timeline.latest_seen(t.ledgers(), t.transactions())


@query("""SELECT issuance_id, address FROM (SELECT issuance_id, address, row_number() OVER (PARTITION BY issuance_id ORDER BY md5(concat('0:', address)), address) AS n
  FROM a_account_issuance) x WHERE n <= 5""")
def rpt12_member_sample(t: DriverTables) -> DataFrame:
    return reports.sample(t.account_issuance().select("issuance_id", "address"), 5).drop("rank")


@query("SELECT issuance_id, address, CAST(sum(delta) AS DOUBLE) AS balance FROM a_balance_deltas GROUP BY 1, 2")
def agg1_balances(t: DriverTables) -> DataFrame:
    return reports.current_balances(t.balance_deltas()).drop("balance_text").withColumns(_number("balance"))


@query("""SELECT issuance_id, address, ledger_index, CAST(sum(sum(delta)) OVER (PARTITION BY issuance_id, address ORDER BY ledger_index) AS DOUBLE) AS balance
  FROM a_balance_deltas GROUP BY issuance_id, address, ledger_index""")
def win5_running_balance(t: DriverTables) -> DataFrame:
    return reports.running_balances(t.balance_deltas()).drop("balance_text").withColumns(_number("balance"))


@query("SELECT issuance_id, count(DISTINCT hash) AS transactions, min(ledger_index) AS first_ledger, max(ledger_index) AS last_ledger FROM a_balance_deltas GROUP BY 1")
def agg8_issuance_stats(t: DriverTables) -> DataFrame:
    return reports.issuance_stats(t.balance_deltas())


@query(f"""WITH {_JOBS} SELECT issuance_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(tx_count) AS BIGINT) AS fetched FROM j GROUP BY 1""")
def agg9_job_counts(t: DriverTables) -> DataFrame:
    return reports.job_counts(_jobs(t))


@query(f"""WITH {_JOBS} SELECT issuance_id, count(*) FILTER (WHERE status = 'done') AS jobs_done, count(*) AS jobs_total FROM j GROUP BY 1
  HAVING count(*) FILTER (WHERE status IN ('pending', 'running')) > 0""")
def agg10_progress(t: DriverTables) -> DataFrame:
    return reports.progress(_jobs(t))


@query("SELECT tx_type, count(*) AS n FROM a_transactions GROUP BY 1")
def agg12_transaction_types(t: DriverTables) -> DataFrame:
    return t.transactions().groupBy("tx_type").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id % 3 AS target, value, event_type <> 'error' AS ok, epoch(ts) AS s FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM e)
SELECT target, count(*) AS sent, count(*) FILTER (WHERE ok) AS ok, min(value) FILTER (WHERE i = 50 * n // 100) AS p50, min(value) FILTER (WHERE i = 95 * n // 100) AS p95,
  min(value) FILTER (WHERE i = 99 * n // 100) AS p99, max(value) AS longest, 1 - count(*) FILTER (WHERE ok) / count(*) AS error_rate FROM r GROUP BY target""")
def agg14_request_log(t: DriverTables) -> DataFrame:
    log = t.raw("events").withColumn("target", F.col("user_id") % 3)
    out = reports.request_log(log, ["target"], "value", "event_type", F.col("event_type") != "error", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return out.select("target", "sent", "ok", "p50", "p95", "p99", "longest", "error_rate")


@query("""WITH q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) - 3 AS d FROM orders)
SELECT strftime(q.d, '%Y-%m-%d') AS day, max(g.ledger_index) AS resolved_ledger FROM q LEFT JOIN a_ledgers g ON CAST(g.close_time AS TIMESTAMP) <= CAST(q.d AS TIMESTAMP) GROUP BY q.d""")
def tim1_resolve_times(t: DriverTables) -> DataFrame:
    asked = t.raw("orders").select(F.date_sub(F.col("o_orderdate").cast("date"), 3).cast("timestamp").alias("time")).distinct()
    out = timeline.resolve_times(asked, t.ledgers())
    return out.select(F.date_format("time", "yyyy-MM-dd").alias("day"), "resolved_ledger")


@query("""WITH r AS (SELECT custkey, address, CASE custkey % 4 WHEN 0 THEN 'validated' WHEN 1 THEN '77' WHEN 2 THEN 'soon' END AS text FROM (SELECT DISTINCT custkey, address FROM a_account_issuance) x),
l AS (SELECT max(ledger_index) AS latest FROM a_transactions)
SELECT address, CASE custkey % 4 WHEN 0 THEN latest WHEN 1 THEN 77 WHEN 3 THEN latest END AS point, CASE WHEN custkey % 4 = 2 THEN 'ledger_index is no ledger' END AS point_error FROM r, l""")
def rpt7_points(t: DriverTables) -> DataFrame:
    text = F.element_at(F.array(F.lit("validated"), F.lit("77"), F.lit("soon"), F.lit(None)), (F.col("custkey") % 4 + 1).cast("int"))
    asked = t.account_issuance().select("address", "custkey").distinct().select("address", text.alias("ledger_index"), F.lit(None).cast("timestamp").alias("time"))
    return timeline.resolve_points(asked, t.ledgers(), timeline.latest_archived(t.transactions())).select("address", "point", "point_error")


@query("""WITH r AS (SELECT CAST(issuance_id AS VARCHAR) AS issuance, issuance_id AS expect FROM a_issuances UNION ALL
  SELECT coalesce(mpt_issuance_id, concat(currency, '/', issuer_account)), issuance_id FROM a_issuances UNION ALL SELECT concat('NONE/', issuer_account), NULL FROM a_issuances)
SELECT DISTINCT issuance, expect AS issuance_id FROM r""")
def flt5_resolve_issuances(t: DriverTables) -> DataFrame:
    i = t.issuances()
    named = F.coalesce("mpt_issuance_id", F.concat_ws("/", "currency", "issuer_account"))
    asked = i.select(F.col("issuance_id").cast("string").alias("issuance")).union(i.select(named)).union(i.select(F.concat(F.lit("NONE/"), "issuer_account"))).distinct()
    return scope.resolve_issuances(asked, i)


@query("""WITH q AS (SELECT address, issuance_id, ledger_index FROM a_balance_deltas)
SELECT q.address, q.issuance_id, q.ledger_index, (c.from_ledger IS NULL OR q.ledger_index < c.from_ledger OR q.ledger_index > c.to_ledger) AS beyond
FROM q LEFT JOIN a_coverage c USING (address)""")
def cov7_beyond(t: DriverTables) -> DataFrame:
    rows = t.balance_deltas().join(scope.envelope(t.coverage()), "address", "left")
    return rows.select("address", "issuance_id", "ledger_index", scope.beyond(F.col("ledger_index"), F.col("ledger_index"), F.col("from_ledger"), F.col("to_ledger")).alias("beyond"))


@query("""SELECT q.address, q.issuance_id, q.ledger_index, (c.from_ledger IS NULL OR q.ledger_index < c.from_ledger OR q.ledger_index > c.to_ledger) AS beyond
FROM a_balance_deltas q LEFT JOIN a_coverage c USING (address)""")
def cov7_beyond_all(t: DriverTables) -> DataFrame:
    """Every delta, as in cov7_beyond."""
    return cov7_beyond(t)
