"""Sources, sinks, expressions and job logs over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import discovery, maintenance, nodes, reports, sinks
from ledgerloom.plans.registry import query
from ledgerloom.plans.report_queries import _JOBS, _jobs, _runs
from ledgerloom.sources import archive
from ledgerloom.sources.driver_tables import DriverTables, told
from ledgerloom.streaming import ingest


def _folder(t: DriverTables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT hash, ledger_index, tx_type FROM a_transactions WHERE ledger_index BETWEEN 500 AND 1500 AND tx_type = 'Payment'")
def src1_history(t: DriverTables) -> DataFrame:
    path = _folder(t, "history")
    archive.write_history(t.transactions().select("hash", "ledger_index", "tx_type"), path)
    return archive.history(t.spark, path, 500, 1500, "Payment")


def _lines(t: DriverTables) -> DataFrame:
    """issuer, account, currency, balance of decimal tokens, as a snapshot would tell."""
    held = reports.current_balances(t.balance_deltas()).join(t.issuances().filter("kind = 'iou'"), "issuance_id")
    return held.select(F.col("issuer_account").alias("issuer"), F.col("address").alias("account"), "currency", F.col("balance").cast("long").cast("string").alias("balance"))


#: Lines of an issuer in a page of a snapshot, about.
PAGE_LINES = 1000


def _pages(lines: DataFrame) -> DataFrame:
    """lines with page: by a hash of the account and currency, as many pages of an issuer as its counted lines need."""
    pages = lines.groupBy("issuer").agg(F.ceil(F.count("*") / PAGE_LINES).alias("_pages"))
    return lines.join(pages, "issuer").withColumn("page", F.pmod(F.xxhash64("account", "currency"), F.col("_pages"))).drop("_pages")


_HELD = "SELECT issuer_account AS issuer, address AS account, currency, sum(delta) AS balance FROM a_balance_deltas JOIN a_issuances USING (issuance_id) WHERE kind = 'iou' GROUP BY ALL"


@query(f"SELECT issuer, account, currency, CAST(CAST(balance AS BIGINT) AS VARCHAR) AS balance FROM ({_HELD}) x")
def src3_trust_lines(t: DriverTables) -> DataFrame:
    path = _folder(t, "lines")
    one = F.struct("account", "currency", "balance", F.lit("0").alias("limit"), F.lit("0").alias("limit_peer"))
    _pages(_lines(t)).groupBy("issuer", "page").agg(F.lit(1).alias("ledger_index"), F.collect_list(one).alias("lines")).drop("page").write.json(path)
    return archive.trust_lines(t.spark, path).select("issuer", "account", "currency", "balance")


@query("""SELECT m.issuance_id, m.address, CAST(coalesce(b.balance, 0) AS DOUBLE) AS balance FROM a_account_issuance m
  LEFT JOIN (SELECT issuance_id, address, sum(delta) AS balance FROM a_balance_deltas WHERE ledger_index <= 1000 GROUP BY 1, 2) b USING (issuance_id, address)""")
def src6_snapshot_balances(t: DriverTables) -> DataFrame:
    snapshot = reports.current_balances(t.balance_deltas().filter("ledger_index <= 1000"))
    out = archive.snapshot_balances(t.account_issuance().select("issuance_id", "address"), snapshot)
    return out.withColumn("balance", F.col("balance").cast("double"))


@query("SELECT event_id AS ledger_index, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS closed FROM events WHERE event_id % 3 = 0")
def str2_ledger_times(t: DriverTables) -> DataFrame:
    e = t.raw("events").select(
        F.col("event_id").alias("ledger_index"), F.when(F.col("event_id") % 3 == 0, "ledger").otherwise("transaction").alias("type"),
        (F.unix_timestamp(F.col("ts").cast("timestamp")) - archive.FEED_EPOCH).alias("ledger_time"),
    )
    return archive.ledger_times(e).select("ledger_index", X.utc_text("close_time").alias("closed"))


@query("SELECT ledger_index FROM a_ledgers WHERE ledger_index % 2 = 1")
def snk6_ledger_times(t: DriverTables) -> DataFrame:
    return sinks.new_rows(t.ledgers(), t.ledgers().filter("ledger_index % 2 = 0"), ["ledger_index"]).select("ledger_index")


@query("""SELECT concat('{"hash":"', hash, '","ledger_index":', ledger_index, ',"tx_type":"', tx_type, '"}') AS value FROM a_transactions""")
def snk11_export(t: DriverTables) -> DataFrame:
    path = _folder(t, "export")
    sinks.export_json(t.transactions().select("tx_type", "hash", "ledger_index"), path)
    return t.spark.read.text(path)


@query("""SELECT DISTINCT hash, issuance_id FROM a_movements UNION
  SELECT hash, CAST(0 AS BIGINT) FROM a_transactions WHERE tx_index % 5 = 0 UNION SELECT hash, CAST(2 AS BIGINT) FROM a_transactions WHERE tx_index % 5 = 1""")
def nod9_related(t: DriverTables) -> DataFrame:
    n = F.col("tx_index") % 5
    null = F.lit(None).cast("string")
    named = t.issuances().select(F.col("issuance_id").alias("named"), F.col("mpt_issuance_id").alias("_id"))
    tx = t.transactions().withColumn("named", F.when(n == 0, 0).when(n == 1, 2).cast("long")).join(named, "named", "left")
    tx = tx.withColumns({"mpt_issuance_id": F.when(n == 0, F.col("_id")), "amount_issuance": F.when(n == 1, F.lower("_id")), "send_max_issuance": null, "deliver_max_issuance": null})
    return nodes.related(tx, nodes.flatten(t.documents_of_metadata()), t.issuances())


@query("""SELECT m.hash, m.ledger_index, x.tx_type, concat_ws(',', m.i, m.h) AS accounts FROM (SELECT hash, ledger_index, string_agg(DISTINCT issuer_account, ',' ORDER BY issuer_account) AS i,
  string_agg(DISTINCT address, ',' ORDER BY address) AS h FROM a_movements JOIN a_issuances USING (issuance_id) GROUP BY 1, 2) m JOIN a_transactions x USING (hash)""")
def exp17_entries(t: DriverTables) -> DataFrame:
    tx = t.documents_of_metadata()
    out = nodes.entries(tx, nodes.versions(nodes.flatten(tx), t.issuances()))
    return out.withColumn("accounts", F.array_join("accounts", ","))


@query("SELECT issuance_id, 'success' AS status, CAST(0 AS BIGINT) AS missing FROM a_issuances WHERE enabled AND issuance_id <> 6 UNION ALL "
       "SELECT CAST(6 AS BIGINT), CASE WHEN count(*) > 0 THEN 'incomplete' ELSE 'success' END, count(*) FROM a_balance_deltas WHERE issuance_id = 6 AND ledger_index % 2 = 0")
def str9_rescan(t: DriverTables) -> DataFrame:
    stored = t.balance_deltas().filter("issuance_id <> 6 or ledger_index % 2 = 1")
    stored = stored.withColumn("told", told(F.col("delta"), F.col("issuance_id") % 2 == 0)).withColumn("delta_text", exact.canonical("told"))
    return nodes.rescan(t.documents_of_metadata(), t.issuances(), stored).drop("failed", "first_failure")


@query("SELECT DISTINCT issuance_id, address FROM a_movements WHERE issuance_id % 2 = 1")
def dsc4_current_holders(t: DriverTables) -> DataFrame:
    lines = t.movements().join(t.issuances().filter("kind = 'iou'"), "issuance_id").select(F.col("issuer_account").alias("issuer"), F.col("address").alias("account"), "currency")
    return discovery.current_holders(lines, t.issuances())


@query("""SELECT issuance_id, address, min(ledger_index) AS first_acquisition_ledger, CASE WHEN issuance_id % 2 = 1 THEN 'trustline' WHEN issuance_id % 4 = 0 THEN 'authorization' ELSE 'traversal' END AS discovered_via
  FROM a_movements GROUP BY issuance_id, address""")
def dsc6_discover(t: DriverTables) -> DataFrame:
    held = t.account_issuance().select("issuance_id", "address", "first_acquisition_ledger")
    flagged = t.issuances().withColumn("flags", F.when(F.col("issuance_id") % 4 == 0, 6).otherwise(2))
    return discovery.discover(held, held, held, flagged)


@query("SELECT issuance_id, (issuance_id + 2) % 3 = 0 AS reconciled, (issuance_id + 2) % 3 AS discrepancies FROM a_issuances")
def win4_latest_runs(t: DriverTables) -> DataFrame:
    return reports.latest_runs(_runs(t))


@query("SELECT issuance_id, count(*) AS members FROM a_account_issuance GROUP BY 1")
def agg11_members(t: DriverTables) -> DataFrame:
    return t.account_issuance().groupBy("issuance_id").agg(F.count("*").alias("members"))


@query(f"""WITH {_JOBS} SELECT CASE WHEN issuance_id % 2 = 0 THEN 'sweep' ELSE 'holder' END AS kind, status, count(*) AS jobs, CAST(sum(tx_count) AS BIGINT) AS fetched FROM j GROUP BY 1, 2""")
def mnt3_job_summary(t: DriverTables) -> DataFrame:
    return reports.job_summary(_jobs(t).withColumn("kind", F.when(F.col("issuance_id") % 2 == 0, "sweep").otherwise("holder")))


@query("SELECT tx_type, count(*) AS n, min(ledger_index) AS first_ledger FROM a_transactions GROUP BY 1")
def mnt2_compact(t: DriverTables) -> DataFrame:
    """Many small files rewritten by type; what is read afterwards is the same."""
    path = _folder(t, "compact")
    t.transactions().repartition(16).write.parquet(f"{path}/many")
    maintenance.compact(t.spark, f"{path}/many", f"{path}/few", partition="tx_type")
    return t.spark.read.parquet(f"{path}/few").groupBy("tx_type").agg(F.count("*").alias("n"), F.min("ledger_index").alias("first_ledger"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS whole, CASE WHEN l_quantity % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
  ELSE concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '.5') END AS plain, concat('-', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS negated FROM lineitem""")
def exp8_amounts(t: DriverTables) -> DataFrame:
    whole = F.col("l_quantity").cast("long").cast("string")
    text = F.when(F.col("l_quantity") % 2 == 0, F.concat(whole, F.lit(".00"))).otherwise(F.concat(whole, F.lit(".50")))
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", X.integer_amount(F.concat(F.lit(" "), whole)).cast("double").alias("whole"),
        X.plain_text(X.decimal_amount(text)).alias("plain"), X.negate_text(whole).alias("negated"),
    )


@query("""SELECT hash, ledger_index, CASE WHEN tx_index % 2 = 0 THEN concat('{"hash":"', hash, '","ledger_index":', ledger_index, ',"tx_blob":"', hex(encode(tx_type)), '","validated":true}')
  ELSE concat('{"hash":"', hash, '","ledger_index":', ledger_index, ',"tx_json":"', tx_type, '","validated":true}') END AS entry FROM a_transactions""")
def exp18_rendered(t: DriverTables) -> DataFrame:
    row = {"hash": F.col("hash"), "ledger_index": F.col("ledger_index"), "tx_blob": X.to_hex(F.encode("tx_type", "UTF-8")), "tx_json": F.col("tx_type")}
    return t.transactions().select("hash", "ledger_index", X.rendered(F.col("tx_index") % 2 == 0, row).alias("entry"))


@query("""SELECT issuance_id, CASE WHEN kind = 'mpt' THEN mpt_issuance_id ELSE concat(currency, '/', issuer_account) END AS named,
  CASE WHEN issuance_id % 2 = 0 THEN '2001,65001,65003' ELSE '2001,65001' END AS warnings FROM a_issuances""")
def exp20_echo_and_warnings(t: DriverTables) -> DataFrame:
    echo = X.issuance_echo(F.col("kind"), F.col("mpt_issuance_id"), F.col("currency"), F.col("issuer_account"))
    named = F.coalesce(echo["mpt_issuance_id"], F.concat_ws("/", echo["currency"], echo["issuer"]))
    return t.issuances().select("issuance_id", named.alias("named"), F.array_join(X.warnings(F.col("issuance_id") % 2 == 0), ",").alias("warnings"))


@query("""WITH x AS (SELECT DISTINCT address FROM a_movements WHERE ledger_index > 2300) SELECT h.hash, h.ledger_index FROM a_transactions h
  WHERE h.hash IN (SELECT hash FROM a_account_transactions WHERE address IN (SELECT address FROM x WHERE address NOT IN (SELECT address FROM a_movements WHERE ledger_index <= 2000)))""")
def dsc9_new_member_history(t: DriverTables) -> DataFrame:
    """Members whom a late batch discovers bring in their whole landed history."""
    tables = ingest.Tables(t.spark, _folder(t, "members"))
    m = t.movements()
    batch = m.filter("ledger_index > 2300").select("address", "issuance_id").distinct()
    known = m.filter("ledger_index <= 2000").select("address").distinct()
    fresh = batch.join(known, "address", "left_anti").withColumns({"discovered_via": F.lit("stream"), "first_acquisition_ledger": F.lit(None).cast("long")})
    tables.append("account_issuance", fresh, 7)
    return ingest.new_member_history(tables, t.transactions(), t.account_transactions(), 7).select("hash", "ledger_index")
