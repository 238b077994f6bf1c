"""Derivations from metadata documents over the driver tables: nodes, deltas, holders, state, reconciliation, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import discovery, nodes, reconcile, reports, state, timeline
from ledgerloom.plans.registry import query
from ledgerloom.sources.driver_tables import DriverTables, told, told_sql


def _versions(t: DriverTables) -> DataFrame:
    return nodes.versions(nodes.flatten(t.documents_of_metadata()), t.issuances())


@query("SELECT hash, ledger_index, node_kind, CASE WHEN issuance_id % 2 = 0 THEN 'MPToken' ELSE 'RippleState' END AS entry_type, object_id, node_kind = 'DeletedNode' AS deleted FROM a_nodes")
def nod1_flatten(t: DriverTables) -> DataFrame:
    return nodes.flatten(t.documents_of_metadata()).select("hash", "ledger_index", "node_kind", "entry_type", "object_id", "deleted")


_DELTA = "CASE node_kind WHEN 'CreatedNode' THEN final_amount WHEN 'DeletedNode' THEN -final_amount ELSE final_amount - previous_amount END"


@query(f"SELECT hash, ledger_index, address, issuance_id, CAST({_DELTA} AS DOUBLE) AS delta FROM a_nodes WHERE issuance_id % 2 = 0 AND {_DELTA} <> 0")
def nod2_integer_deltas(t: DriverTables) -> DataFrame:
    found = nodes.deltas(_versions(t).filter("entry_type = 'MPToken'"))
    return found.drop("delta_text").withColumn("delta", F.col("delta").cast("double"))


@query(f"SELECT hash, ledger_index, address, issuance_id, {told_sql(f'({_DELTA})')} AS delta FROM a_nodes WHERE issuance_id % 2 = 1 AND {_DELTA} <> 0")
def nod4_decimal_deltas(t: DriverTables) -> DataFrame:
    """Changes of balances with 15 digits behind the point, as exact texts."""
    return _exact(nodes.deltas(_versions(t).filter("entry_type = 'RippleState'")))


def _exact(rows: DataFrame, amount: str = "delta") -> DataFrame:
    """The exact text in the amount's place."""
    return rows.drop(amount).withColumnRenamed(f"{amount}_text", amount)


@query(f"SELECT hash, ledger_index, address, issuance_id, {told_sql('delta')} AS delta FROM a_balance_deltas")
def nod5_derive_deltas(t: DriverTables) -> DataFrame:
    return _exact(nodes.derive(t.documents_of_metadata(), t.issuances()))


@query(f"SELECT hash, ledger_index, address, issuance_id, {told_sql('delta')} AS delta FROM a_balance_deltas WHERE address IN (SELECT address FROM a_account_issuance WHERE issuance_id = 2)"
       " OR hash IN (SELECT hash FROM a_movements WHERE address IN (SELECT address FROM a_account_issuance WHERE issuance_id = 2))")
def nod6_rederive(t: DriverTables) -> DataFrame:
    members = t.account_issuance().filter("issuance_id = 2")
    return _exact(nodes.rederive(t.documents_of_metadata(), t.account_transactions(), members, t.issuances()))


@query("SELECT issuance_id, address, min(ledger_index) AS first_acquisition_ledger FROM a_nodes GROUP BY 1, 2")
def nod7_holders(t: DriverTables) -> DataFrame:
    return nodes.holders(_versions(t))


@query("""SELECT hash, ledger_index, string_agg(address, ',' ORDER BY address) AS accounts FROM (SELECT hash, ledger_index, address FROM a_movements
  UNION SELECT hash, ledger_index, issuer_account FROM a_movements JOIN a_issuances USING (issuance_id)) x GROUP BY 1, 2""")
def nod12_scoped_transactions(t: DriverTables) -> DataFrame:
    return nodes.scoped_transactions(_versions(t)).withColumn("accounts", F.array_join("accounts", ","))


def _parties_input(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    # A number is aggregated in place, a text by sorting.
    first = t.movements().groupBy("hash").agg(F.min("custkey").alias("custkey")).select("hash", t._address().alias("account"))
    tx = t.transactions().join(first, "hash").select("hash", "ledger_index", "account", F.lit(None).cast("string").alias("destination"), F.lit(None).cast("string").alias("holder"))
    return tx, nodes.flatten(t.documents_of_metadata())


@query("""SELECT DISTINCT hash, ledger_index, address FROM (SELECT hash, ledger_index, address FROM a_movements UNION ALL
  SELECT hash, ledger_index, issuer_account FROM a_movements JOIN a_issuances USING (issuance_id) WHERE kind = 'iou') x""")
def nod10_parties(t: DriverTables) -> DataFrame:
    return nodes.parties(*_parties_input(t))


@query("""SELECT DISTINCT hash, address FROM (SELECT hash, address FROM a_movements UNION ALL
  SELECT hash, issuer_account FROM a_movements JOIN a_issuances USING (issuance_id) WHERE kind = 'iou') x WHERE address IN (SELECT address FROM a_accounts)""")
def nod11_in_scope(t: DriverTables) -> DataFrame:
    return nodes.in_scope_accounts(*_parties_input(t), t.accounts())


_LAST = """WITH last AS (SELECT object_id, arg_max(node_kind, (ledger_index, CAST(substr(hash, 2) AS BIGINT) % 1000000)) AS kind,
  arg_max(final_amount, (ledger_index, CAST(substr(hash, 2) AS BIGINT) % 1000000)) AS amount, any_value(address) AS address, any_value(custkey) AS custkey, any_value(issuance_id) AS issuance_id
  FROM a_nodes {where} GROUP BY object_id)"""


@query(_LAST.format(where="") + f" SELECT object_id, issuance_id, address, kind = 'DeletedNode' AS deleted, {told_sql('amount')} AS amount FROM last")
def sta1_latest_objects(t: DriverTables) -> DataFrame:
    return state.latest(_versions(t)).select("object_id", "issuance_id", "address", "deleted", exact.canonical("amount_text").alias("amount"))


@query(_LAST.format(where="") + f" SELECT issuance_id, address, {told_sql('sum(amount)')} AS balance FROM last WHERE kind <> 'DeletedNode' GROUP BY 1, 2")
def sta5_balances_from_state(t: DriverTables) -> DataFrame:
    return _exact(state.balances(_versions(t)), "balance")


@query(
    _LAST.format(where="WHERE issuance_id % 2 = 1 AND ledger_index <= 1800")
    + f""" SELECT last.address, i.issuer_account AS peer, i.currency, {told_sql("amount", "last.issuance_id")} AS balance, '0' AS "limit", '0' AS limit_peer
FROM last JOIN a_issuances i USING (issuance_id) WHERE last.kind <> 'DeletedNode'"""
)
def sta3_trust_lines(t: DriverTables) -> DataFrame:
    return _trust_lines(t, t.account_issuance())


@query(
    _LAST.format(where="WHERE issuance_id % 2 = 1 AND ledger_index <= 1800")
    + f""" SELECT last.address, i.issuer_account AS peer, i.currency, {told_sql("amount", "last.issuance_id")} AS balance, '0' AS "limit", '0' AS limit_peer
FROM last JOIN a_issuances i USING (issuance_id) WHERE last.kind <> 'DeletedNode'"""
)
def sta3_trust_lines_all(t: DriverTables) -> DataFrame:
    """Every account, as in sta3_trust_lines."""
    return sta3_trust_lines(t)


def _trust_lines(t: DriverTables, members: DataFrame) -> DataFrame:
    who = members.select("address").distinct()
    asked = who.select(F.col("address").alias("request_id"), "address", F.lit(1800).cast("long").alias("as_of_ledger"))
    out = state.trust_lines_at(nodes.flatten(t.documents_of_metadata()), asked)
    return _exact(out.withColumnRenamed("request_id", "address").drop("status"), "balance")


@query("""WITH l AS (SELECT greatest((SELECT max(ledger_index) FROM a_ledgers), (SELECT max(ledger_index) FROM a_transactions)) AS latest)
SELECT a.address, coalesce(c.to_ledger, l.latest) AS as_of_ledger, c.address IS NULL AS uncovered FROM (SELECT DISTINCT address FROM a_accounts) a LEFT JOIN a_coverage c USING (address), l""")
def sta6_reported_ledger(t: DriverTables) -> DataFrame:
    return state.reported_ledger(t.accounts().select("address").distinct(), t.coverage(), timeline.latest_seen(t.ledgers(), t.transactions()))


@query("SELECT issuance_id, TRUE AS passed, CAST(0 AS BIGINT) AS discrepancies FROM a_issuances")
def rec1_reconcile(t: DriverTables) -> DataFrame:
    ours = reports.current_balances(nodes.derive(t.documents_of_metadata(), t.issuances()))
    # The documents' index in a ledger begins again at each million of orders; balances are summed in the order of the hashes.
    theirs = state.balances(_versions(t).withColumn("tx_index", F.substring("hash", 2, 10).cast("int")))
    return reconcile.verdicts(t.issuances(), reconcile.compare(ours, theirs, t.account_issuance()), 1).select("issuance_id", "passed", "discrepancies")


@query(f"""WITH b AS (SELECT issuance_id, address, sum(delta) AS balance FROM a_balance_deltas GROUP BY 1, 2)
SELECT issuance_id, address, {told_sql('balance')} AS left_balance, '0' AS right_balance FROM b WHERE address LIKE '%7' AND balance <> 0
UNION ALL SELECT issuance_id, address, {told_sql('balance')}, concat({told_sql('balance')}, CASE WHEN contains({told_sql('balance')}, '.') THEN '' ELSE '.' END, lpad('1', 30, '0')) FROM b WHERE address LIKE '%3'""")
def rec2_differences(t: DriverTables) -> DataFrame:
    """Balances that are missing on one side, and others that differ far behind the point only."""
    sums = t.balance_deltas().groupBy("issuance_id", "address").agg(F.sum("delta").alias("units"))
    ours = sums.select("issuance_id", "address", exact.canonical(told(F.col("units"), F.col("issuance_id") % 2 == 0)).alias("balance"))
    more = F.concat("balance", F.when(F.col("balance").contains("."), "").otherwise("."), F.lit("0" * 29 + "1"))
    theirs = ours.filter("address not like '%7'").withColumn("balance", F.when(F.col("address").endswith("3"), more).otherwise(F.col("balance")))
    out = reconcile.compare(ours, theirs)
    return out.select("issuance_id", "address", F.col("left_text").alias("left_balance"), F.col("right_text").alias("right_balance"))


@query("""WITH b AS (SELECT issuance_id, address, sum(delta) AS balance FROM a_balance_deltas GROUP BY 1, 2),
s AS (SELECT * FROM (SELECT issuance_id, address, row_number() OVER (PARTITION BY issuance_id ORDER BY md5(concat('7:', address)), address) AS n FROM a_account_issuance) x WHERE n <= 30),
c AS (SELECT s.issuance_id, coalesce(b.balance, 0) AS ours, CASE WHEN s.address LIKE '%5' THEN 0 ELSE coalesce(b.balance, 0) END AS theirs FROM s LEFT JOIN b USING (issuance_id, address))
SELECT issuance_id, count(*) FILTER (WHERE ours = theirs) AS matched, count(*) FILTER (WHERE ours <> theirs) AS mismatched FROM c GROUP BY 1""")
def rec4_external_balances(t: DriverTables) -> DataFrame:
    sampled = reports.sample(t.account_issuance().select("issuance_id", "address"), 30, seed=7)
    all_ = reports.current_balances(t.balance_deltas())
    ours = sampled.join(all_, ["issuance_id", "address"], "left").withColumn("balance", F.coalesce("balance", F.lit(0)))
    return reconcile.totals(ours, all_.filter("address not like '%5'"))


def _authorizations(t: DriverTables) -> DataFrame:
    """Authorization and trust-line transactions, one for each account that a transaction of the type moves."""
    m = t.movements().join(t.transactions().select("hash", "tx_type"), "hash").join(t.issuances(), "issuance_id")
    return m.select(
        "tx_type", "ledger_index", F.when(F.col("custkey") % 2 == 0, F.col("address")).otherwise(F.col("issuer_account")).alias("account"),
        F.when(F.col("custkey") % 2 == 1, F.col("address")).alias("holder"), "mpt_issuance_id",
        F.col("issuer_account").alias("limit_issuer"), F.col("currency").alias("limit_currency"),
    )


@query("""SELECT issuance_id, address, min(ledger_index) AS first_acquisition_ledger FROM a_movements JOIN a_transactions USING (hash, ledger_index)
  WHERE tx_type = 'MPTokenAuthorize' AND issuance_id % 2 = 0 GROUP BY 1, 2""")
def dsc1_authorization_scan(t: DriverTables) -> DataFrame:
    return discovery.authorization_scan(_authorizations(t), t.issuances())


@query("""SELECT issuance_id, address, min(ledger_index) AS first_acquisition_ledger FROM a_movements JOIN a_transactions USING (hash, ledger_index)
  WHERE tx_type = 'TrustSet' AND issuance_id % 2 = 1 AND custkey % 2 = 0 GROUP BY 1, 2""")
def dsc2_trust_line_scan(t: DriverTables) -> DataFrame:
    return discovery.trust_line_scan(_authorizations(t), t.issuances())


@query("""WITH RECURSIVE reach AS (SELECT DISTINCT sender AS address FROM a_transfers WHERE sender = 1 UNION SELECT e.receiver FROM reach JOIN a_transfers e ON e.sender = reach.address),
led AS (SELECT e.receiver AS address, min(e.ledger_index) AS ledger FROM a_transfers e JOIN reach ON reach.address = e.sender GROUP BY 1)
SELECT r.address, led.ledger FROM reach r LEFT JOIN led USING (address)""")
def dsc3_closure(t: DriverTables) -> DataFrame:
    edges = t.transfers().select(F.col("sender").alias("account"), F.col("receiver").alias("party"), "ledger_index")
    seeds = t.transfers().filter("sender = 1").select(F.lit("one").alias("group"), F.col("sender").alias("address")).distinct()
    shared_folder(t.spark)
    return discovery.closure(edges, seeds).select("address", "ledger")


@query("""WITH h AS (SELECT issuance_id, address, min(ledger_index) AS first_acquisition_ledger FROM a_movements WHERE ledger_index <= 1000 AND issuance_id % 2 = 1 GROUP BY 1, 2)
SELECT issuance_id, address, first_acquisition_ledger FROM h UNION ALL
SELECT DISTINCT issuance_id, address, CAST(NULL AS BIGINT) FROM a_movements m WHERE issuance_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.issuance_id = m.issuance_id AND h.address = m.address)""")
def dsc5_cross_check(t: DriverTables) -> DataFrame:
    odd = t.movements().filter("issuance_id % 2 = 1")
    historical = odd.filter("ledger_index <= 1000").groupBy("issuance_id", "address").agg(F.min("ledger_index").alias("first_acquisition_ledger"))
    lines = odd.join(t.issuances(), "issuance_id").select(F.col("issuer_account").alias("issuer"), F.col("address").alias("account"), "currency")
    return discovery.completed(historical, discovery.current_holders(lines, t.issuances()))


@query("""WITH a AS (SELECT DISTINCT issuance_id, address FROM a_movements WHERE ledger_index <= 1200), b AS (SELECT DISTINCT issuance_id, address FROM a_movements WHERE ledger_index > 1200)
SELECT issuance_id, address, CASE WHEN a.address IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b USING (issuance_id, address) WHERE a.address IS NULL OR b.address IS NULL""")
def dsc10_disagreements(t: DriverTables) -> DataFrame:
    m = t.movements()
    return discovery.disagreements(m.filter("ledger_index <= 1200"), m.filter("ledger_index > 1200"))
