"""Exact amounts, documents that can't be read, tables kept batch by batch and coverage with holes, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import nodes, reconcile, rejects, reports, scope
from ledgerloom.plans.archive_queries import _claims
from ledgerloom.plans.derivation_queries import _LAST, _exact
from ledgerloom.plans.registry import query
from ledgerloom.plans.report_queries import _JOBS, _LINES, _balance_requests, _issuer_requests, _jobs, _mpt_holders, _runs
from ledgerloom.sources.driver_tables import DriverTables, told, told_sql
from ledgerloom.streaming import deletes, ingest, kept
from ledgerloom.streaming.ingest import Tables


def _tables(t: DriverTables, name: str) -> Tables:
    return Tables(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}")


def _derived(t: DriverTables) -> DataFrame:
    """Deltas from the documents: 15 digits behind the point in trust lines."""
    return nodes.derive(t.documents_of_metadata(), t.issuances())


_ASKED = """r AS (SELECT address, issuance_id, CAST(ledger AS BIGINT) AS ledger FROM a_account_issuance, (VALUES (1200), (2000)) v(ledger)
  UNION ALL SELECT DISTINCT address, CAST(99 AS BIGINT), CAST(1200 AS BIGINT) FROM a_account_issuance WHERE custkey % 10 = 0)"""
_BALANCES = f"""WITH {_ASKED}, s AS (SELECT r.address, r.issuance_id, r.ledger, sum(d.delta) AS total FROM r JOIN a_balance_deltas d
    ON d.address = r.address AND d.issuance_id = r.issuance_id AND d.ledger_index <= r.ledger GROUP BY ALL)
SELECT r.address, r.issuance_id, r.ledger, CASE WHEN m.address IS NOT NULL THEN {told_sql("coalesce(s.total, 0)", "r.issuance_id")} END AS balance,
  CASE WHEN m.address IS NULL THEN 'notInArchive' ELSE 'success' END AS status
FROM r LEFT JOIN s USING (address, issuance_id, ledger) LEFT JOIN a_account_issuance m ON m.address = r.address AND m.issuance_id = r.issuance_id"""


@query(_BALANCES)
def rpt1_exact(t: DriverTables) -> DataFrame:
    """As-of balances of derived amounts, every digit told."""
    out = reports.balance_at(_balance_requests(t), _derived(t), t.account_issuance(), t.coverage())
    return _exact(out, "balance").select("address", "issuance_id", "ledger", "balance", "status")


@query(
    _LINES
    + f"""
w AS (SELECT m.issuance_id, count(*) FILTER (WHERE c.from_ledger IS NULL) AS uncovered, max(c.from_ledger) AS f, min(c.to_ledger) AS e
      FROM a_account_issuance m LEFT JOIN a_coverage c USING (address) GROUP BY m.issuance_id),
v AS (SELECT r.issuer, r.ledger, count(line.issuance_id) > 0 AS tracked,
        bool_and(line.issuance_id IS NULL OR w.issuance_id IS NULL OR (w.uncovered = 0 AND w.f <= w.e AND r.ledger BETWEEN w.f AND w.e)) AS covered
      FROM r LEFT JOIN line USING (issuer) LEFT JOIN w USING (issuance_id) GROUP BY r.issuer, r.ledger),
h AS (SELECT v.issuer, v.ledger, line.currency, CASE WHEN d.address IN ('rC10', 'rC20', 'rC31') THEN d.address END AS address, sum(d.delta) AS n FROM v JOIN line USING (issuer)
      JOIN a_balance_deltas d USING (issuance_id) WHERE v.tracked AND v.covered AND d.ledger_index <= v.ledger AND d.address <> v.issuer GROUP BY ALL HAVING sum(d.delta) <> 0)
SELECT concat(v.issuer, '@', v.ledger) AS request_id, CASE WHEN NOT tracked THEN 'notInArchive' WHEN NOT covered THEN 'outOfCoverage' ELSE 'success' END AS status,
  h.address, h.currency, CASE WHEN h.n IS NOT NULL THEN {told_sql("h.n", "1")} END AS amount FROM v LEFT JOIN h USING (issuer, ledger)"""
)
def rpt3_exact(t: DriverTables) -> DataFrame:
    """Obligations and hot wallets of derived amounts, every digit told."""
    return _exact(reports.gateway_balances(_issuer_requests(t), _derived(t), t.account_issuance(), t.coverage(), t.issuances()), "amount")


#: Amounts of the orders far outside any decimal: by turns 10 ** 80, 10 ** 30, 1 and 10 ** -60 times the order's key.
_POWERS = (80, 30, 0, -60)


@query(f"""WITH s AS (SELECT o_custkey AS k, {", ".join(f"CAST(sum(CASE WHEN o_orderkey % 4 = {i} THEN (CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END) ELSE 0 END) AS HUGEINT) AS s{i}" for i in range(4))} FROM orders GROUP BY 1)
SELECT concat('rC', k) AS address, s0, s1, s2, s3, concat(s0, 'e80+', s1, 'e30+', s2, '+', s3, 'e-60') AS told FROM s""")
def exp9_far_amounts(t: DriverTables) -> DataFrame:
    """Sums over 140 digits: the places that each power of ten fills, read back from the exact total."""
    n = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    power = F.element_at(F.array(*map(F.lit, _POWERS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = t.raw("orders").select(F.concat(F.lit("rC"), F.col("o_custkey").cast("string")).alias("address"), F.concat(n.cast("string"), F.lit("e"), power.cast("string")).alias("amount"))
    total = exact.exact_sum(rows, ["address"], "amount")
    # Taking the higher powers away leaves the lower ones: the total is exact in every digit.
    by_power = rows.withColumn("_p", F.substring_index("amount", "e", -1)).groupBy("address").agg(
        *(F.coalesce(F.sum(F.when(F.col("_p") == str(p), F.substring_index("amount", "e", 1).cast("long"))), F.lit(0)).alias(f"s{i}") for i, p in enumerate(_POWERS))
    )
    both = by_power.join(total, "address")
    text = F.concat(F.col("s0").cast("string"), F.lit("e80+"), F.col("s1").cast("string"), F.lit("e30+"), F.col("s2").cast("string"), F.lit("+"), F.col("s3").cast("string"), F.lit("e-60"))
    parts = both.select("*", F.explode(F.array(*(F.concat((-F.col(f"s{i}")).cast("string"), F.lit(f"e{p}")) for i, p in enumerate(_POWERS)), F.col("total"))).alias("part"))
    nothing = exact.exact_sum(parts, ["address"], "part", "left").filter("left = '0'").select("address")
    return both.join(nothing, "address").select("address", *(F.col(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(4)), text.alias("told"))


#: Documents of these ledgers are cut off in the middle.
_CUT = (1500, 1510)


def _cut_documents(t: DriverTables) -> DataFrame:
    """The documents, some of which break off: in the ledgers _CUT, where the transaction's number is even."""
    cut = F.col("ledger_index").between(*_CUT) & (F.col("tx_index") % 2 == 0)
    return t.documents_of_metadata().withColumn("meta_json", F.when(cut, F.expr("left(meta_json, length(meta_json) - 20)")).otherwise(F.col("meta_json")))


_BROKEN = f"SELECT hash, ledger_index FROM a_transactions WHERE ledger_index BETWEEN {_CUT[0]} AND {_CUT[1]} AND tx_index % 2 = 0 AND hash IN (SELECT hash FROM a_movements)"


@query(f"SELECT hash, ledger_index, 'not readable' AS reason FROM ({_BROKEN}) x")
def exp2_rejects(t: DriverTables) -> DataFrame:
    """Documents that break off are named."""
    return rejects.rejected(_cut_documents(t))


@query(f"""WITH b AS (SELECT DISTINCT ledger_index AS l FROM ({_BROKEN}) x), q AS (
  SELECT 'balance' AS kind, concat(m.issuance_id, '|', m.address, '|', v.ledger) AS request_id, 0 AS low, v.ledger AS high, 'success' AS fine FROM a_account_issuance m, (VALUES (1499), (1505), (2300)) v(ledger)
  UNION ALL SELECT 'itemised', concat(m.issuance_id, '|', v.low), v.low, v.high, 'success' FROM a_issuances m, (VALUES (0, 1400), (1400, 1600), (1511, 2400), (1505, 1505)) v(low, high)
  UNION ALL SELECT 'holders', concat(m.issuance_id, '|', v.ledger), 0, v.ledger, 'success' FROM a_issuances m, (VALUES (1400), (1600)) v(ledger) WHERE m.kind = 'mpt')
SELECT kind, request_id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.l BETWEEN q.low AND q.high) THEN 'unreadable' ELSE fine END AS status FROM q""")
def exp2_refusals(t: DriverTables) -> DataFrame:
    """Balances, itemised answers and holders over ledgers with a document that breaks off are refused, all others answered."""
    # Few rows out of a pass over all documents, which three kinds of answers look at.
    bad, i = rejects.rejected(_cut_documents(t)).persist(StorageLevel.MEMORY_AND_DISK), t.issuances()
    ask = lambda rows, *values: rows.withColumn("v", F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(f"_{n}") for n, x in enumerate(v))) for v in values)))).select("*", "v.*")
    key = lambda *columns: F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).alias("request_id")
    asked = ask(t.account_issuance(), (1499,), (1505,), (2300,)).select(key("issuance_id", "address", "_0"), "issuance_id", "address", F.col("_0").alias("ledger"))
    out = reports.balance_at(asked, t.balance_deltas(), t.account_issuance(), t.coverage(), bad).select(F.lit("balance").alias("kind"), "request_id", "status")
    asked = ask(i, (0, 1400), (1400, 1600), (1511, 2400), (1505, 1505)).select(key("issuance_id", "_0"), "issuance_id", F.lit(None).cast("string").alias("address"), F.col("_0").alias("low"), F.col("_1").alias("high"))
    listed = reports.itemised_answers(asked, t.balance_deltas(), i, t.account_issuance(), bad).select("request_id", "status").distinct()
    out = out.union(listed.select(F.lit("itemised"), "request_id", "status"))
    asked = ask(i.filter("kind = 'mpt'"), (1400,), (1600,)).select(key("issuance_id", "_0"), "issuance_id", F.col("_0").alias("as_of_ledger"), F.lit(3).alias("limit"), F.lit(None).cast("string").alias("marker"))
    held = reports.holder_answers(asked, _mpt_holders(t), i, 2400, bad).select("request_id", "status").distinct()
    return out.union(held.select(F.lit("holders"), "request_id", "status"))


@query("""SELECT i.issuance_id, CASE WHEN i.issuance_id = 5 AND n.n > 0 THEN 'failed' ELSE 'success' END AS status, CAST(0 AS BIGINT) AS missing,
  CASE WHEN i.issuance_id = 5 THEN n.n ELSE 0 END AS failed, CASE WHEN i.issuance_id = 5 THEN n.h END AS first_failure
FROM a_issuances i, (SELECT count(*) AS n, min(hash) AS h FROM a_nodes WHERE issuance_id = 5 AND ledger_index % 10 = 0) n WHERE i.enabled""")
def str9_failures(t: DriverTables) -> DataFrame:
    """One issuance has balances that are no numbers: it fails, and all others are derived."""
    named = t.issuances().filter("issuance_id = 5").select("currency")
    docs = t.documents_of_metadata().join(F.broadcast(named), F.expr("ledger_index % 10 = 0"), "left")
    # Only the balances of the one currency are spoilt.
    spoilt = F.when(F.col("currency").isNotNull(), F.expr(r"""regexp_replace(meta_json, concat('("Balance":\\{"currency":"', currency, '","issuer":"[^"]*","value":")'), '$1x')""")).otherwise(F.col("meta_json"))
    stored = t.balance_deltas().withColumn("delta_text", exact.canonical(told(F.col("delta"), F.col("issuance_id") % 2 == 0)))
    return nodes.rescan(docs.withColumn("meta_json", spoilt).drop("currency"), t.issuances(), stored)


def _parts(t: DriverTables, tables: Tables) -> list[DataFrame]:
    """All versions in four batches that have nothing to do with the order of ledgers, landed as files: one pass over the documents."""
    versions, path = nodes.versions(nodes.flatten(t.documents_of_metadata()), t.issuances()).drop("amount", "before"), f"{tables.path}/batches"
    versions.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(4)).cast("int")).write.partitionBy("part").option("compression", "zstd").parquet(path)
    landed = t.spark.read.schema(f"{kept.VERSIONS}, part int").parquet(path)
    return [landed.filter(f"part = {i}").drop("part") for i in (2, 0, 3, 1)]


_STATE = f" SELECT object_id, issuance_id, address, kind = 'DeletedNode' AS deleted, {told_sql('amount')} AS amount FROM last"


@query(_LAST.format(where="") + _STATE)
def sta7_state_table(t: DriverTables) -> DataFrame:
    """The kept state after batches out of order, one of them twice."""
    tables = _tables(t, "state")
    table, parts = kept.ObjectState(tables, buckets=16), _parts(t, tables)
    for part in (*parts, parts[1]):
        table.apply(part)
    return table.rows().select("object_id", "issuance_id", "address", "deleted", exact.canonical("amount_text").alias("amount"))


@query(_LAST.format(where="") + " SELECT object_id, 'behind' AS found FROM last WHERE object_id IN (SELECT object_id FROM a_nodes WHERE ledger_index > 2000)")
def sta7_parity(t: DriverTables) -> DataFrame:
    """What a table that stands at ledger 2000 lacks against reconstruction from everything; once rebuilt it lacks nothing."""
    tables = _tables(t, "parity")
    # Four steps look at the versions: they land as files, in one pass over the documents.
    versions = tables.stage("versions", nodes.versions(nodes.flatten(t.documents_of_metadata()), t.issuances()).drop("amount", "before"), 0)
    table = kept.ObjectState(tables, buckets=16)
    table.apply(versions.filter("ledger_index <= 2000"))
    # As files too: what is cached would be worked out again once the table that it was read from has changed.
    behind = tables.stage("behind", table.parity(versions).select("object_id", F.lit("behind").alias("found")), 0)
    table.rebuild(versions)
    return behind.union(table.parity(versions).select("object_id", F.lit("different")))


@query(_BALANCES)
def win5_kept_balances(t: DriverTables) -> DataFrame:
    """As-of balances from kept blocks, after a tail, a late stretch that shifts later blocks, and a batch that came twice."""
    sums, deltas = kept.KeptSums(_tables(t, "sums"), buckets=16, ledgers=100), _derived(t).persist()
    late, odd = F.col("ledger_index").between(700, 1100), F.col("ledger_index") % 2 == 1
    for batch, part in ((1, deltas.filter(~late & odd)), (2, deltas.filter(~late & ~odd)), (3, deltas.filter(late)), (2, deltas.filter(~late & ~odd))):
        sums.add(part, batch)
    deltas.unpersist()
    return _exact(sums.balance_at(_balance_requests(t), t.account_issuance(), t.coverage()), "balance").select("address", "issuance_id", "ledger", "balance", "status")


_STRETCHES = """c AS (SELECT address, from_ledger AS f, to_ledger AS e FROM a_coverage UNION ALL
  SELECT address, to_ledger + 1 + length(address) % 2 * 50, to_ledger + 100 FROM a_coverage),
m AS (SELECT DISTINCT issuance_id, address FROM a_account_issuance WHERE issuance_id % 2 = 0 OR address <> 'rC429'),
n AS (SELECT issuance_id, count(*) AS members FROM m GROUP BY 1),
g AS (SELECT CAST(range AS BIGINT) AS l FROM range(0, 2600)),
x AS (SELECT m.issuance_id, g.l FROM m JOIN c USING (address) JOIN g ON g.l BETWEEN c.f AND c.e GROUP BY m.issuance_id, g.l
      HAVING count(DISTINCT m.address) = (SELECT members FROM n WHERE n.issuance_id = m.issuance_id))"""


def _holed_members(t: DriverTables) -> DataFrame:
    return t.account_issuance().filter("issuance_id % 2 = 0 or address <> 'rC429'")


@query(f"""WITH {_STRETCHES} SELECT issuance_id, min(l) AS from_ledger, max(l) AS to_ledger FROM (SELECT issuance_id, l, l - row_number() OVER (PARTITION BY issuance_id ORDER BY l) AS island FROM x) y GROUP BY issuance_id, island""")
def cov4_stretches(t: DriverTables) -> DataFrame:
    """Where all members are covered, with holes between adjacent and overlapping claims."""
    return scope.covered_stretches(_holed_members(t), _claims(t))


@query(f"""WITH {_STRETCHES}, w AS (SELECT m.issuance_id, count(*) AS members, count(*) FILTER (WHERE v.f IS NULL) AS uncovered, max(v.f) AS f, min(v.e) AS e FROM m
  LEFT JOIN (SELECT address, min(f) AS f, max(e) AS e FROM c GROUP BY 1) v USING (address) GROUP BY 1),
k AS (SELECT issuance_id, members, uncovered, CASE WHEN uncovered = 0 AND f <= e THEN f END AS from_ledger, CASE WHEN uncovered = 0 AND f <= e THEN e END AS to_ledger FROM w),
h AS (SELECT k.issuance_id, count(x.l) AS n FROM k LEFT JOIN x ON x.issuance_id = k.issuance_id AND x.l BETWEEN k.from_ledger AND k.to_ledger GROUP BY 1)
SELECT k.*, CASE WHEN from_ledger IS NOT NULL THEN h.n END AS covered_ledgers, h.n = to_ledger - from_ledger + 1 AS whole FROM k JOIN h USING (issuance_id)""")
def cov4_with_holes(t: DriverTables) -> DataFrame:
    """The strict window, and whether it has holes."""
    return scope.strict_window_with_holes(_holed_members(t), _claims(t))


@query(f"""SELECT hash, ledger_index, address, issuance_id, {told_sql("delta")} AS delta FROM a_balance_deltas WHERE address IN (SELECT address FROM a_movements WHERE ledger_index > 2390)""")
def dsc9_stored_whole(t: DriverTables) -> DataFrame:
    """Members whom a late batch finds have their whole history stored with it; the batch and its discovery run twice."""
    tables, docs, links = _tables(t, "whole"), t.documents_of_metadata(), t.account_transactions()
    late = ingest._as_events(docs.filter("ledger_index > 2390"))
    for _ in range(2):
        ingest.ingest_batch(tables, t.issuances(), late, 3)
        ingest.discover_whole(tables, t.issuances(), docs, links, 3)
    stored = tables.log("balance_deltas", ingest.SCHEMAS["balance_deltas"])
    return stored.select("hash", "ledger_index", "address", "issuance_id", F.col("delta_text").alias("delta"))


@query(f"""WITH b AS (SELECT issuance_id, address, sum(delta) AS balance FROM a_balance_deltas GROUP BY 1, 2)
SELECT issuance_id, address, {told_sql("balance")} AS left_balance, '0' AS right_balance FROM b WHERE address LIKE '%17' AND balance <> 0
UNION ALL SELECT issuance_id, address, '0', '1e-30' FROM a_account_issuance WHERE address LIKE '%18' AND (issuance_id, address) NOT IN (SELECT issuance_id, address FROM b WHERE balance <> 0)""")
def rec5_by_digests(t: DriverTables) -> DataFrame:
    """Balances that one side lacks, found through digests of hash ranges."""
    sums = t.balance_deltas().groupBy("issuance_id", "address").agg(F.sum("delta").alias("units"))
    spelt = sums.select("issuance_id", "address", told(F.col("units"), F.col("issuance_id") % 2 == 0).alias("told"))
    # Both sides are made of it, one of them three times.
    ours = spelt.select("issuance_id", "address", exact.canonical("told").alias("balance")).persist(StorageLevel.MEMORY_AND_DISK)
    every = t.account_issuance().filter("address like '%18'").select("issuance_id", "address").join(ours.filter("balance <> '0'"), ["issuance_id", "address"], "left_anti")
    more = every.withColumn("balance", F.lit("1e-30"))
    theirs = ours.filter("address not like '%17'").join(every, ["issuance_id", "address"], "left_anti").unionByName(more)
    out = reconcile.compare_suspects(ours, theirs, ranges=64)
    return out.select("issuance_id", "address", F.col("left_text").alias("left_balance"), F.when(F.col("right_text") == "0", "0").otherwise("1e-30").alias("right_balance"))


@query("""WITH top AS (SELECT * FROM a_transactions WHERE hash IN (SELECT hash FROM a_movements) ORDER BY ledger_index DESC, hash LIMIT 25),
lab AS (SELECT DISTINCT hash, CASE WHEN length(name) > 18 THEN concat(left(name, 12), '…', right(name, 4)) ELSE name END AS label FROM (
  SELECT top.hash, coalesce(currency, mpt_issuance_id) AS name FROM top JOIN a_balance_deltas d USING (hash) JOIN a_issuances i USING (issuance_id)
  UNION ALL SELECT top.hash, mpt_issuance_id FROM top JOIN a_issuances i ON i.issuance_id = top.tx_index % 25 AND kind = 'mpt') x)
SELECT top.hash, top.ledger_index, 'tesSUCCESS' AS result, string_agg(label, ',' ORDER BY label) AS labels FROM top LEFT JOIN lab USING (hash) GROUP BY top.hash, top.ledger_index""")
def rpt8_with_results(t: DriverTables) -> DataFrame:
    """Recent activity with result codes, and with the issuances that transactions name without moving them."""
    named = t.issuances().filter("kind = 'mpt'").select(F.col("issuance_id").alias("_n"), F.lower("mpt_issuance_id").alias("mpt_issuance_id"))
    docs = t.documents_of_metadata().select("hash", "ledger_index", (F.col("tx_index") % 25).alias("_n"), X.result_code(X.parse_meta("meta_json")).alias("result"))
    out = reports.recent_activity(docs.join(named, "_n", "left").drop("_n"), t.balance_deltas(), t.issuances(), t.ledgers(), k=25)
    return out.select("hash", "ledger_index", "result", "labels")


@query(f"""WITH {_JOBS} SELECT i.issuance_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done,
  count(*) FILTER (WHERE status = 'failed') AS failed, CAST(coalesce(sum(tx_count), 0) AS BIGINT) AS fetched FROM a_issuances i LEFT JOIN j USING (issuance_id) GROUP BY 1""")
def rpt9_with_jobs(t: DriverTables) -> DataFrame:
    """The job counts in the issuances' status."""
    out = reports.issuance_status(t.issuances(), t.account_issuance(), t.balance_deltas(), t.coverage(), _jobs(t), _runs(t))
    return out.select("issuance_id", "pending", "running", "done", "failed", "fetched")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 1 THEN 'account is no account' WHEN event_id % 7 = 2 THEN 'ledger_index is no ledger' WHEN event_id % 7 = 3 THEN 'forward is neither true nor false'
  WHEN event_id % 7 = 4 THEN 'account is missing' END AS error, CASE WHEN event_id % 7 BETWEEN 1 AND 4 THEN 'invalidParams' ELSE 'success' END AS status FROM events""")
def flt6_types(t: DriverTables) -> DataFrame:
    """Parameters of a wrong type are named."""
    n = F.col("event_id") % 7
    asked = t.raw("events").select(
        "event_id", F.lit("account_tx").alias("command"), F.lit("2").alias("api_version"), F.when(n == 1, "xNobody").when(n == 4, " ").otherwise("rAbc").alias("account"),
        F.when(n == 2, "-1").when(n == 5, "validated").when(n == 6, "17").alias("ledger_index"), F.when(n == 3, "yes").when(n == 0, "true").alias("forward"),
    )
    out = scope.validate(asked, {"account_tx": ("account",)}, {"account": "account", "ledger_index": "ledger", "forward": "boolean"})
    return out.select("event_id", "status", "error")


@query("""WITH s AS (SELECT count(*) AS n FROM supplier WHERE s_nationkey = 4),
d AS (SELECT issuance_id, count(*) AS n FROM a_balance_deltas GROUP BY 1)
SELECT concat('deltas of ', i.issuance_id) AS what, CASE WHEN i.issuance_id = 4 THEN 0 WHEN i.issuance_id = 5 THEN coalesce(d.n, 0) + s.n ELSE coalesce(d.n, 0) END AS n FROM a_issuances i LEFT JOIN d USING (issuance_id), s
UNION ALL SELECT 'links', count(*) FROM a_account_transactions UNION ALL SELECT 'deltas kept', n FROM s UNION ALL SELECT 'accounts removed', n FROM s
UNION ALL SELECT 'transactions', count(*) + any_value(s.n) FROM a_transactions, s WHERE hash IN (SELECT hash FROM a_movements)""")
def mnt1_applied(t: DriverTables) -> DataFrame:
    """What an applied deletion leaves in the logs after a compaction and a replay: of the deleted issuance nothing, of the others
    everything, also the deltas that its own accounts have there."""
    tables = _tables(t, "deletes")
    s = t.raw("supplier").filter("s_nationkey = 4").select(F.concat(F.lit("rS"), F.col("s_suppkey").cast("string")).alias("address"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("hash"))
    long = lambda x: F.lit(x).cast("long")
    one = lambda i: s.select("hash", long(100).alias("ledger_index"), "address", long(i).alias("issuance_id"), F.lit("5").alias("delta_text"), F.lit(5).cast("decimal(38,18)").alias("delta"))
    deltas = t.balance_deltas().select("hash", "ledger_index", "address", "issuance_id", F.col("delta").cast("long").cast("string").alias("delta_text"), F.col("delta").cast("decimal(38,18)").alias("delta"))
    members = t.account_issuance().select("address", "issuance_id", F.lit("sweep").alias("discovered_via"), "first_acquisition_ledger")
    moved = t.movements().select("hash").distinct()
    docs = t.transactions().join(moved, "hash").select("hash", "ledger_index", "tx_type", F.lit(None).cast("string").alias("meta_json"))
    first = {
        "balance_deltas": deltas.filter("ledger_index <= 1200").union(one(4)).union(one(5)),
        "account_issuance": members.union(s.select("address", long(4), F.lit("sweep"), long(100))),
        "account_transactions": t.account_transactions().union(s.select("hash", "address")),
        "transactions": docs.union(s.select("hash", long(100), F.lit("Payment"), F.lit(None).cast("string"))),
        "coverage": t.coverage().select("address", "from_ledger", F.col("to_ledger").cast("long").alias("to_ledger"), "reason"),
    }
    write = lambda: [tables.append(name, rows, 1) for name, rows in first.items()]
    write()
    tables.append("balance_deltas", deltas.filter("ledger_index > 1200"), 2)
    counts = deletes.delete(tables, t.issuances(), 4, 2)
    for name in ("balance_deltas", "account_transactions"):
        deletes.compact(tables, name)
    write()
    left = deletes.view(tables, "balance_deltas").groupBy("issuance_id").agg(F.count("*").alias("n"))
    out = t.issuances().select("issuance_id").join(left, "issuance_id", "left").select(F.concat(F.lit("deltas of "), "issuance_id").alias("what"), F.coalesce("n", F.lit(0)).alias("n"))
    for name, what in (("account_transactions", "links"), ("transactions", "transactions")):
        out = out.union(deletes.view(tables, name).agg(F.lit(what), F.count("*")))
    return out.union(counts.select(F.lit("deltas kept"), "deltas_kept")).union(counts.select(F.lit("accounts removed"), "accounts_removed"))
