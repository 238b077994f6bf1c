"""Upkeep of the archive over the driver tables: coverage, calendar, idempotent writes, set operations, streaming, deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import maintenance, scope, sinks, timeline
from ledgerloom.plans.registry import query
from ledgerloom.sources.driver_tables import DriverTables, told_sql
from ledgerloom.streaming import ingest


@query("""WITH s AS (SELECT issuance_id, CAST(100 + issuance_id AS BIGINT) AS f, CAST(2000 AS BIGINT) AS e FROM a_issuances),
m AS (SELECT issuance_id, least(any_value(e), greatest(any_value(f), min(first_acquisition_ledger))) AS f, any_value(e) AS e FROM s JOIN a_account_issuance USING (issuance_id) GROUP BY 1),
w AS (SELECT s.issuance_id, coalesce(m.f, s.f) AS f, s.e FROM s LEFT JOIN m USING (issuance_id))
SELECT DISTINCT address, f AS from_ledger, e AS to_ledger FROM w JOIN (SELECT issuance_id, address FROM a_account_issuance UNION SELECT issuance_id, issuer_account FROM a_issuances) a USING (issuance_id)""")
def cov1_sweep_claims(t: DriverTables) -> DataFrame:
    swept = t.issuances().select("issuance_id", (F.col("issuance_id") + 100).alias("from_ledger"), F.lit(2000).cast("long").alias("to_ledger"))
    return scope.sweep_claims(t.issuances(), t.account_issuance(), swept).drop("reason")


@query("""SELECT address, CASE WHEN custkey % 2 = 0 THEN custkey ELSE 0 END AS from_ledger, max(ledger_index) AS to_ledger FROM a_movements GROUP BY address, custkey""")
def cov2_holder_claims(t: DriverTables) -> DataFrame:
    m = t.movements()
    asked = m.select("address", F.when(F.col("custkey") % 2 == 0, F.col("custkey")).alias("from_ledger")).distinct()
    return scope.holder_claims(m, asked).drop("reason")


def _claims(t: DriverTables) -> DataFrame:
    """Two claims for each account: the base claim and one stretch far behind it or next to it."""
    base = t.coverage()
    more = base.select("address", (F.col("to_ledger") + 1 + F.length("address") % 2 * 50).alias("from_ledger"), (F.col("to_ledger") + 100).alias("to_ledger"), F.lit("tail").alias("reason"))
    return base.unionByName(more)


@query("""SELECT address, min(from_ledger) AS from_ledger, max(to_ledger) + 100 AS to_ledger, CASE WHEN length(address) % 2 = 1 THEN 2 ELSE 1 END AS n_stretches
  FROM a_coverage GROUP BY address""")
def cov3_envelope(t: DriverTables) -> DataFrame:
    return scope.envelope(_claims(t))


_WINDOW = """SELECT m.issuance_id, count(*) AS members, count(*) FILTER (WHERE c.address IS NULL) AS uncovered, max(c.from_ledger) AS f, greatest(2399, min(c.to_ledger)) AS e
  FROM (SELECT DISTINCT issuance_id, address FROM a_account_issuance) m {} JOIN a_coverage c USING (address) GROUP BY 1"""


@query(f"WITH w AS ({_WINDOW.format('LEFT')}) SELECT issuance_id, members, uncovered, CASE WHEN uncovered = 0 AND f <= e THEN f END AS from_ledger, CASE WHEN uncovered = 0 AND f <= e THEN e END AS to_ledger FROM w")
def cov4_strict_window(t: DriverTables) -> DataFrame:
    return scope.strict_window(t.account_issuance(), t.coverage(), tail_to=2399)


@query(f"WITH w AS ({_WINDOW.format('')}) SELECT issuance_id, CASE WHEN f <= e THEN f END AS from_ledger, CASE WHEN f <= e THEN e END AS to_ledger FROM w")
def cov5_status_window(t: DriverTables) -> DataFrame:
    return scope.status_window(t.account_issuance(), t.coverage(), tail_to=2399)


@query("SELECT address, min(ledger_index) AS min_ledger, max(ledger_index) AS max_ledger FROM a_account_transactions JOIN a_transactions USING (hash) GROUP BY 1")
def cov6_data_range(t: DriverTables) -> DataFrame:
    return scope.data_range(t.account_transactions(), t.transactions())


@query("SELECT greatest((SELECT max(to_ledger) FROM a_coverage), (SELECT max(ledger_index) FROM a_ledgers)) AS high_water")
def cov8_resume(t: DriverTables) -> DataFrame:
    return scope.resume_from(t.coverage(), t.ledgers())


@query("""SELECT g.ledger_index, strftime(CAST(g.close_time AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS closed FROM a_ledgers g
  WHERE ledger_index % 3 = 0 AND ledger_index IN (SELECT ledger_index FROM a_transactions)""")
def tim2_missing_times(t: DriverTables) -> DataFrame:
    known = t.ledgers().filter("ledger_index % 3 <> 0")
    return timeline.missing_times(t.transactions(), known, t.ledgers()).select("ledger_index", X.utc_text("close_time").alias("closed"))


_GAPS = """SELECT seq, prev + 1 AS from_ledger, ledger_index - 1 AS to_ledger FROM (SELECT seq, ledger_index,
  max(ledger_index) OVER (ORDER BY seq, ledger_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a_tail) x WHERE ledger_index > prev + 1"""


@query(_GAPS)
def win3_gaps(t: DriverTables) -> DataFrame:
    return timeline.gaps(t.tail())


@query(_GAPS)
def str3_stream_gaps(t: DriverTables) -> DataFrame:
    """The same gaps from a stream over the landed tail."""
    spark, base = t.spark, f"{shared_folder(t.spark)}/gaps-{uuid.uuid4().hex}"
    t.tail().select(F.lit("tail").alias("source"), "seq", "ledger_index").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("source string, seq long, ledger_index long").parquet(f"{base}/in")
    tables = ingest.Tables(spark, f"{base}/tables")
    ingest.stream_gaps(stream, tables, f"{base}/state").awaitTermination()
    return tables.log("gaps", ingest.SCHEMAS["gaps"]).drop("source", "batch")


@query(f"SELECT hash, ledger_index, address, issuance_id, {told_sql('delta')} AS delta FROM a_balance_deltas")
def str1_stream_ingest(t: DriverTables) -> DataFrame:
    """Deltas that a stream over landed transactions stores; the same transactions landed twice are stored once."""
    spark, base = t.spark, f"{shared_folder(t.spark)}/ingest-{uuid.uuid4().hex}"
    events = t.documents_of_metadata().select(
        F.col("tx_index").alias("seq"), F.lit("transaction").alias("type"), F.lit(True).alias("validated"), "ledger_index", F.lit(0).alias("ledger_time"), "hash", "tx_type",
        F.array().cast("array<string>").alias("accounts"), "meta_json",
    )
    tables, issuances = ingest.Tables(spark, f"{base}/tables"), t.issuances()
    events.write.option("compression", "gzip").json(f"{base}/landing")
    for again in (False, True):
        if again:  # the same lines, without spelling documents anew
            spark.read.text(f"{base}/landing").write.mode("append").option("compression", "gzip").text(f"{base}/landing")
        ingest.ingest(ingest.tail(spark, f"{base}/landing"), tables, issuances, f"{base}/state").awaitTermination()
    stored = tables.log("balance_deltas", ingest.SCHEMAS["balance_deltas"]).drop("batch")
    return stored.withColumn("delta", F.col("delta_text")).drop("delta_text")


@query("""WITH g AS (SELECT prev + 1 AS f, ledger_index - 1 AS e FROM (SELECT ledger_index, max(ledger_index) OVER (ORDER BY seq, ledger_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM a_tail) x WHERE ledger_index > prev + 1) SELECT hash, ledger_index FROM a_transactions t WHERE EXISTS (SELECT 1 FROM g WHERE t.ledger_index BETWEEN g.f AND g.e)""")
def str4_heal(t: DriverTables) -> DataFrame:
    return ingest.heal(timeline.gaps(t.tail()), t.transactions()).select("hash", "ledger_index")


@query("SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2")
def snk1_new_rows(t: DriverTables) -> DataFrame:
    """Rows of a batch with repeated keys that a table with a third of the keys lacks."""
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return sinks.new_rows(lines, lines.filter("l_orderkey % 3 = 0"), ["l_orderkey", "l_linenumber"], order="l_suppkey")


@query("SELECT address, min(first_seen_ledger) AS first_seen_ledger FROM a_accounts GROUP BY 1")
def snk2_accounts(t: DriverTables) -> DataFrame:
    """A log with unknown first ledgers beside known ones."""
    log = t.accounts().unionByName(t.accounts().withColumn("first_seen_ledger", F.lit(None).cast("long")))
    return sinks.accounts_view(log)


@query("SELECT hash, unnest([concat('a', substr(hash, 2, 3)), concat('b', substr(hash, 5, 3))]) AS address FROM a_transactions")
def snk3_links(t: DriverTables) -> DataFrame:
    a, b = F.concat(F.lit("a"), F.substring("hash", 2, 3)), F.concat(F.lit("b"), F.substring("hash", 5, 3))
    return sinks.links_of(t.transactions().select("hash", F.array(a, b, a).alias("accounts")))


@query("""SELECT address, issuance_id, arg_min(tx_type, ledger_index * 10000000 + tx_index) AS discovered_via, min(ledger_index) AS first_acquisition_ledger
  FROM a_movements JOIN a_transactions USING (hash, ledger_index) GROUP BY 1, 2""")
def snk4_membership(t: DriverTables) -> DataFrame:
    log = t.movements().join(t.transactions(), ["hash", "ledger_index"]).select(
        "address", "issuance_id", F.col("tx_type").alias("discovered_via"), F.col("ledger_index").alias("first_acquisition_ledger"),
        (F.col("ledger_index") * 10000000 + F.col("tx_index")).alias("log_seq"),
    )
    return sinks.membership_view(log)


@query("SELECT hash, address, issuance_id, CAST(delta + 2 AS DOUBLE) AS delta FROM a_balance_deltas")
def snk5_delta_upsert(t: DriverTables) -> DataFrame:
    """A first run with wrong values and a second whose values come in two parts."""
    d = t.balance_deltas()
    wrong = d.withColumn("delta", F.col("delta") * 3).withColumn("run_id", F.lit(1))
    parts = d.withColumn("run_id", F.lit(2)).unionByName(d.withColumn("delta", F.lit(2).cast("decimal(28,2)")).withColumn("run_id", F.lit(2)))
    out = sinks.deltas_view(wrong.withColumn("delta", F.col("delta").cast("decimal(28,2)")).unionByName(parts))
    return out.drop("delta_text").withColumn("delta", F.col("delta").cast("double"))


@query("""SELECT n_nationkey AS seq, n_nationkey NOT IN (0, 5) AND n_regionkey <> 4 AS accepted FROM nation""")
def snk9_register(t: DriverTables) -> DataFrame:
    """Nations as candidate currencies: two are spelt wrongly, those of region 4 are there already."""
    n = F.col("n_nationkey")
    candidates = t.raw("nation").select(
        n.alias("seq"), F.lit("iou").alias("kind"), F.lit(None).cast("string").alias("mpt_issuance_id"),
        F.when(n == 0, " xrp ").when(n == 5, "").otherwise(F.concat(F.lit(" "), "n_name")).alias("currency"),
        F.concat(F.lit("rIssuer"), F.col("n_regionkey").cast("string")).alias("issuer_account"), F.lit(None).cast("long").alias("backfill_from_ledger"),
    )
    existing = candidates.join(t.raw("nation").filter("n_regionkey = 4"), F.col("seq") == F.col("n_nationkey"), "left_semi").withColumn("currency", F.trim("currency"))
    return sinks.register(candidates, existing).select("seq", "accepted")


@query("SELECT issuance_id, CASE WHEN issuance_id % 3 = 0 THEN issuance_id % 2 = 1 ELSE enabled END AS enabled FROM a_issuances")
def snk10_enabled(t: DriverTables) -> DataFrame:
    i = F.col("issuance_id")
    third = t.issuances().filter("issuance_id % 3 = 0")
    changes = third.select("issuance_id", (i % 2 == 0).alias("enabled"), F.lit(1).alias("seq")).union(third.select("issuance_id", i % 2 == 1, F.lit(2)))
    return sinks.enabled_view(t.issuances(), changes).select("issuance_id", "enabled")


@query("""SELECT address FROM a_account_issuance WHERE issuance_id % 10 = 1 EXCEPT SELECT address FROM a_account_issuance WHERE issuance_id % 10 <> 1""")
def set1_exclusive_accounts(t: DriverTables) -> DataFrame:
    return maintenance.exclusive_accounts(t.account_issuance(), t.issuances().filter("issuance_id % 10 = 1").select("issuance_id"))


@query("SELECT address FROM a_accounts UNION SELECT issuer_account FROM a_issuances")
def set5_subscriptions(t: DriverTables) -> DataFrame:
    return t.accounts().select("address").union(t.issuances().select(F.col("issuer_account"))).distinct()


@query("""WITH gone AS (SELECT address FROM a_account_issuance WHERE issuance_id = 4 EXCEPT SELECT address FROM a_account_issuance WHERE issuance_id <> 4),
l AS (SELECT * FROM a_account_transactions WHERE address NOT IN (SELECT address FROM gone)), d AS (SELECT * FROM a_balance_deltas WHERE issuance_id <> 4)
SELECT (SELECT count(*) FROM gone) AS accounts_removed, (SELECT count(*) FROM a_balance_deltas WHERE issuance_id = 4) AS deltas_removed,
  (SELECT count(*) FROM a_account_transactions) - (SELECT count(*) FROM l) AS links_removed,
  (SELECT count(*) FROM a_coverage WHERE address IN (SELECT address FROM gone)) AS coverage_removed,
  (SELECT count(*) FROM a_transactions WHERE hash NOT IN (SELECT hash FROM l UNION SELECT hash FROM d)) AS transactions_removed,
  (SELECT count(*) FROM d WHERE address IN (SELECT address FROM gone)) AS deltas_kept""")
def mnt1_delete_issuance(t: DriverTables) -> DataFrame:
    tables = {x: getattr(t, x)() for x in ("issuances", "account_issuance", "balance_deltas", "accounts", "account_transactions", "coverage", "transactions")}
    return maintenance.delete_issuance(tables, 4)[1]


@query("""SELECT n_name, CASE WHEN length(n_name) = 3 THEN n_name ELSE rpad(hex(encode(n_name)), 40, '0') END AS wire, n_name AS readable,
  CASE WHEN length(n_name) > 18 THEN concat(left(n_name, 12), '…', right(n_name, 4)) ELSE n_name END AS label FROM nation""")
def exp4_currency_codes(t: DriverTables) -> DataFrame:
    wire = t.raw("nation").select("n_name", X.currency_wire("n_name").alias("wire"))
    return wire.select("n_name", "wire", X.currency_readable("wire").alias("readable"), X.short_label("n_name").alias("label"))


@query("SELECT issuance_id, (issuance_id // 10) * 16 + issuance_id % 10 AS sequence, lpad(CAST(n_regionkey AS VARCHAR), 40, '0') AS issuer FROM a_issuances JOIN nation ON n_nationkey = issuance_id WHERE kind = 'mpt'")
def exp7_issuance_parts(t: DriverTables) -> DataFrame:
    """Every integer token; the fixture's ids spell decimal numbers, read as hexadecimal here."""
    mpt = t.issuances().filter("kind = 'mpt'")
    return mpt.select("issuance_id", X.issuance_sequence("mpt_issuance_id").alias("sequence"), X.issuance_issuer("mpt_issuance_id").alias("issuer"))


@query("""SELECT CAST(o_custkey AS BIGINT) AS custkey, CAST(sum(CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT)) AS VARCHAR) AS total
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def exact_sums(t: DriverTables) -> DataFrame:
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    text = F.when(F.col("l_linenumber") % 2 == 0, amount.cast("decimal(20,0)").cast("string")).otherwise(amount.cast("decimal(20,3)").cast("string"))
    return exact.exact_sum(lines.select(F.col("o_custkey").cast("long").alias("custkey"), text.alias("text")), ["custkey"], "text")
