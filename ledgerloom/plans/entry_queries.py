"""Account histories as whole answers, discovery with its statistics, times from a stream, registrations and blobs, over the
driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import answers, discovery, keyset, sinks
from ledgerloom.plans.registry import query
from ledgerloom.sources import archive
from ledgerloom.sources.driver_tables import DriverTables
from ledgerloom.streaming import ingest


def _with_bodies(t: DriverTables) -> DataFrame:
    """transactions with bodies as documents and as blobs; every seventh transaction's metadata is cut off."""
    x = F.col("tx_index")
    tx = F.concat(F.lit('{"TransactionType":"'), "tx_type", F.lit('","Sequence":'), x.cast("string"), F.lit(',"Flags":0}'))
    meta = F.concat(F.lit('{"TransactionResult":"tesSUCCESS","TransactionIndex":'), x.cast("string"), F.when(x % 7 == 0, "").otherwise("}"))
    return t.transactions().withColumns({"tx_json": tx, "meta_json": meta, "tx_blob": F.encode(tx, "UTF-8"), "meta_blob": F.encode(meta, "UTF-8")})


_ANSWERS = """
WITH r AS (SELECT DISTINCT address, custkey % 2 = 0 AS forward, custkey % 3 = 0 AS bin FROM a_account_issuance
           UNION ALL SELECT DISTINCT issuer_account, TRUE, FALSE FROM a_issuances UNION ALL SELECT 'rNobody', TRUE, FALSE),
q AS (SELECT r.*, c.from_ledger AS f, c.to_ledger AS e, a.address IS NOT NULL AS known FROM r LEFT JOIN a_coverage c USING (address) LEFT JOIN a_accounts a USING (address)),
x AS (SELECT hash, ledger_index, tx_index, concat('{"TransactionType":"', tx_type, '","Sequence":', tx_index, ',"Flags":0}') AS tx,
        concat('{"TransactionResult":"tesSUCCESS","TransactionIndex":', tx_index, CASE WHEN tx_index % 7 = 0 THEN '' ELSE '}' END) AS meta,
        concat('{"Flags":0,"Sequence":', tx_index, ',"TransactionType":"', tx_type, '"}') AS tx_ordered,
        CASE WHEN tx_index % 7 <> 0 THEN concat('"meta":{"TransactionIndex":', tx_index, ',"TransactionResult":"tesSUCCESS"},') ELSE '' END AS meta_ordered FROM a_transactions),
held AS (SELECT l.address, x.* FROM a_account_transactions l JOIN x USING (hash)),
span AS (SELECT address, min(ledger_index) AS lo, max(ledger_index) AS hi FROM held GROUP BY 1),
n AS (SELECT q.address, h.hash, h.ledger_index, CASE WHEN q.forward THEN row_number() OVER (PARTITION BY q.address ORDER BY h.ledger_index, h.hash)
          ELSE row_number() OVER (PARTITION BY q.address ORDER BY h.ledger_index DESC, h.hash DESC) END AS rank, count(*) OVER (PARTITION BY q.address) AS total,
        CASE WHEN q.bin THEN concat('{"tx_blob":"', hex(encode(h.tx)), '","meta_blob":"', hex(encode(h.meta)), '","ledger_index":', h.ledger_index, ',"validated":true}')
          ELSE concat('{"tx_json":', h.tx_ordered, ',', h.meta_ordered, '"hash":"', h.hash, '","ledger_index":', h.ledger_index, ',"validated":true}') END AS entry
      FROM q JOIN held h USING (address) WHERE q.known AND h.ledger_index >= greatest(300, coalesce(q.f, 300)) AND h.ledger_index <= least(2400, coalesce(q.e, 2400))),
page AS (SELECT address, string_agg(entry, chr(10) ORDER BY rank) AS entries, count(*) AS n_entries,
           max(CASE WHEN rank = 6 AND total > 6 THEN concat(ledger_index, ':', hash) END) AS marker FROM n WHERE rank <= 6 GROUP BY 1)
SELECT q.address AS request_id, CASE WHEN known THEN 'success' ELSE 'notInArchive' END AS status, CASE WHEN known THEN coalesce(f, lo, (SELECT max(ledger_index) FROM x)) END AS ledger_index_min,
  CASE WHEN known THEN coalesce(e, hi, (SELECT max(ledger_index) FROM x)) END AS ledger_index_max, CASE WHEN known THEN CAST(6 AS BIGINT) END AS "limit", coalesce(n_entries, 0) AS n_entries,
  coalesce(entries, '') AS entries, marker, CASE WHEN known AND (f IS NULL OR 300 < f OR 2400 > e) THEN '2001,65001,65003' ELSE '2001,65001' END AS warnings
FROM q LEFT JOIN page USING (address) LEFT JOIN span USING (address)"""


def _history_requests(t: DriverTables) -> DataFrame:
    holders = t.account_issuance().select("address", (F.col("custkey") % 2 == 0).alias("forward"), (F.col("custkey") % 3 == 0).alias("binary")).distinct()
    others = t.issuances().select(F.col("issuer_account").alias("address")).distinct().union(t.spark.range(1).select(F.lit("rNobody")))
    asked = holders.union(others.select("address", F.lit(True), F.lit(None).cast("boolean")))
    bound = lambda x: F.lit(x).cast("long")
    return asked.withColumns({"request_id": F.col("address"), "low": bound(300), "high": bound(2400), "limit": F.lit(6), "marker": F.lit(None).cast("string")})


def _flat(out: DataFrame) -> DataFrame:
    return out.select(
        "request_id", "status", "ledger_index_min", "ledger_index_max", "limit", F.coalesce(F.size("transactions"), F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce(F.array_join("transactions", "\n"), F.lit("")).alias("entries"), "marker", F.array_join("warnings", ",").alias("warnings"),
    )


@query(_ANSWERS)
def rpt4_answers(t: DriverTables) -> DataFrame:
    """First pages of all accounts, issuers and a stranger, as blobs or documents, with reported ranges and warnings."""
    return _flat(answers.account_answers(_history_requests(t), t.account_transactions(), _with_bodies(t), t.coverage(), t.accounts()))


@query(_ANSWERS)
def rpt4_keyset_answers(t: DriverTables) -> DataFrame:
    """The same answers from clustered history; bodies are looked up for the pages' rows."""
    table = keyset.history(t.spark, f"{shared_folder(t.spark)}/answers-{uuid.uuid4().hex}")
    links, transactions = t.account_transactions(), _with_bodies(t)
    table.append(keyset.history_rows(links, transactions), 0, 16)
    return _flat(answers.account_answers(_history_requests(t), links, transactions, t.coverage(), t.accounts(), table))


@query("""
WITH m AS (SELECT issuance_id, address, min(ledger_index) AS began, min(ledger_index) FILTER (WHERE ledger_index <= 1500) AS early, min(ledger_index) FILTER (WHERE ledger_index <= 1200) AS earlier,
  bool_or(ledger_index > 700) AS now FROM a_movements GROUP BY 1, 2),
f AS (SELECT issuance_id, address, CASE WHEN issuance_id % 2 = 1 THEN early WHEN issuance_id % 4 = 0 THEN earlier ELSE began END AS began, early, now FROM m
  WHERE CASE WHEN issuance_id % 2 = 1 THEN early IS NOT NULL OR now WHEN issuance_id % 4 = 0 THEN earlier IS NOT NULL ELSE TRUE END)
SELECT i.issuance_id, i.kind, CASE WHEN i.kind = 'iou' THEN concat(i.currency, '/', i.issuer_account) ELSE i.mpt_issuance_id END AS target,
  CASE WHEN i.issuance_id % 2 = 1 THEN 'trustline' WHEN i.issuance_id % 4 = 0 THEN 'authorization' ELSE 'traversal' END AS strategy,
  count(f.address) AS accounts, count(f.began) AS dated, min(f.began) AS first_ledger, max(f.began) AS last_ledger,
  CASE WHEN i.kind = 'iou' THEN count(*) FILTER (WHERE f.now) END AS current_accounts, CASE WHEN i.kind = 'iou' THEN count(*) FILTER (WHERE f.now AND f.early IS NULL) END AS missing_accounts
FROM a_issuances i LEFT JOIN f ON f.issuance_id = i.issuance_id GROUP BY i.issuance_id, i.kind, i.currency, i.issuer_account, i.mpt_issuance_id""")
def dsc6_statistics(t: DriverTables) -> DataFrame:
    """Each strategy's finds counted by issuance, trust lines held against those who hold one after ledger 700."""
    held = lambda rows: rows.groupBy("issuance_id", "address").agg(F.min("ledger_index").alias("first_acquisition_ledger"))
    m = t.movements()
    issuances = t.issuances().withColumn("flags", F.when(F.col("issuance_id") % 4 == 0, 6).otherwise(2))
    lines = m.filter("ledger_index > 700").join(issuances, "issuance_id").filter("kind = 'iou'").select(F.col("issuer_account").alias("issuer"), F.col("address").alias("account"), "currency")
    trusted = held(m.filter("ledger_index <= 1500 and issuance_id % 2 = 1"))
    return discovery.discover_checked(held(m.filter("ledger_index <= 1200")), trusted, held(m), discovery.current_holders(lines, issuances), issuances)[1]


@query("SELECT event_id AS ledger_index, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS closed FROM events WHERE event_id % 3 = 0")
def str2_from_stream(t: DriverTables) -> DataFrame:
    """Ledger times that a stream stores in two batches; the second tells all ledgers again, those of the first an hour later."""
    spark, base, e = t.spark, f"{shared_folder(t.spark)}/times-{uuid.uuid4().hex}", F.col("event_id")
    tables, issuances = ingest.Tables(spark, f"{base}/tables"), t.issuances()
    none = F.lit(None).cast("string")
    for first in (True, False):
        later = F.when(F.lit(not first) & (e % 2 == 0), 3600).otherwise(0)
        t.raw("events").filter(e % 2 == 0 if first else F.lit(True)).select(
            e.alias("seq"), F.when(e % 3 == 0, "ledger").otherwise("server").alias("type"), F.lit(True).alias("validated"), e.alias("ledger_index"),
            (F.unix_timestamp(F.col("ts").cast("timestamp")) - archive.FEED_EPOCH + later).alias("ledger_time"), none.alias("hash"), none.alias("tx_type"), none.alias("meta_json"),
        ).write.mode("append").json(f"{base}/in")
        ingest.ingest(ingest.tail(spark, f"{base}/in"), tables, issuances, f"{base}/state").awaitTermination()
    return tables.log("ledgers", ingest.SCHEMAS["ledgers"]).select("ledger_index", X.utc_text("close_time").alias("closed"))


@query("""
WITH c AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 3 THEN 'nft' WHEN c_custkey % 2 = 0 THEN 'mpt' ELSE 'iou' END AS kind, CASE WHEN c_custkey % 10 = 0 THEN 'zz' ELSE lpad(concat('a', c_custkey // 8), 48, '0') END AS mpt,
  concat('C', c_custkey // 4) AS currency, CASE WHEN c_custkey % 7 <> 1 THEN concat('r', c_nationkey // 5) END AS issuer, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS begin_ FROM customer),
e AS (SELECT *, CASE WHEN kind = 'nft' THEN 'kind must be mpt or iou' WHEN kind = 'mpt' AND mpt = 'zz' THEN 'mpt_issuance_id must have 48 hexadecimal digits' WHEN kind = 'iou' AND issuer IS NULL THEN 'issuer_account is missing' END AS error,
  CASE WHEN kind = 'mpt' THEN upper(mpt) ELSE concat(currency, '/', issuer) END AS key FROM c),
old AS (SELECT DISTINCT upper(lpad(concat('a', c_custkey // 8), 48, '0')) AS key FROM customer WHERE c_custkey % 24 = 2),
n AS (SELECT *, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error, key ORDER BY seq) END AS n FROM e),
d AS (SELECT *, coalesce(error, CASE WHEN n > 1 OR key IN (SELECT key FROM old) THEN 'already registered' END) AS why FROM n)
SELECT seq, kind, why IS NULL AS accepted, why AS error, CASE WHEN why IS NULL AND kind = 'mpt' THEN upper(mpt) END AS mpt_issuance_id, CASE WHEN why IS NULL AND kind = 'iou' THEN currency END AS currency,
  CASE WHEN why IS NULL THEN coalesce(begin_, 0) END AS backfill_from_ledger FROM d""")
def snk9_register_both(t: DriverTables) -> DataFrame:
    """Customers as candidates of both kinds: some of another kind, misspelt or without an issuer, some repeated or registered before."""
    k = F.col("c_custkey")
    number = F.floor(k / 8).cast("string")
    token = lambda letter: F.lpad(F.concat(F.lit(letter), number), 48, "0")
    none = F.lit(None).cast("string")
    candidates = t.raw("customer").select(
        k.alias("seq"), F.when(k % 11 == 3, "nft").when(k % 2 == 0, "mpt").otherwise("iou").alias("kind"),
        F.when(k % 10 == 0, "zz").when(k % 4 == 0, token("a")).otherwise(token("A")).alias("mpt_issuance_id"),
        F.concat(F.lit(" C"), F.floor(k / 4).cast("string")).alias("currency"), F.when(k % 7 != 1, F.concat(F.lit("r"), F.floor(F.col("c_nationkey") / 5).cast("string"))).alias("issuer_account"),
        F.when(k % 3 == 0, k).alias("backfill_from_ledger"),
    )
    existing = t.raw("customer").filter(k % 24 == 2).select(F.lit("mpt").alias("kind"), token("a").alias("mpt_issuance_id"), none.alias("currency"), none.alias("issuer_account"))
    out, shown = sinks.register(candidates, existing), ("mpt_issuance_id", "currency", "backfill_from_ledger")
    told = out.withColumn("mpt_issuance_id", F.when(F.col("kind") == "mpt", F.col("mpt_issuance_id")))
    return told.select("seq", "kind", "accepted", "error", *(F.when(F.col("accepted"), F.col(c)).alias(c) for c in shown))


@query("""SELECT hash, CASE WHEN tx_index % 5 = 0 THEN NULL ELSE tx_type END AS tx, CASE WHEN tx_index % 6 = 0 OR tx_index % 11 = 0 THEN NULL ELSE hex(encode(hash)) END AS meta,
  concat_ws(',', CASE WHEN tx_index % 5 = 0 THEN 'tx_blob' END, CASE WHEN tx_index % 6 = 0 AND tx_index % 11 <> 0 THEN 'meta_blob' END) AS unread FROM a_transactions""")
def exp3_blobs(t: DriverTables) -> DataFrame:
    """Blobs landed in hexadecimal of either case, some with a digit too few, with a letter that is none, or missing."""
    x, text = F.col("tx_index"), F.lower(F.hex(F.encode("tx_type", "UTF-8")))
    landed = t.transactions().select(
        "hash", F.when(x % 5 == 0, F.substring(text, 2, 1000)).otherwise(text).alias("tx_blob"),
        F.when(x % 11 == 0, F.lit(None)).when(x % 6 == 0, F.concat(X.to_hex(F.encode("hash", "UTF-8")), F.lit("0g"))).otherwise(X.to_hex(F.encode("hash", "UTF-8"))).alias("meta_blob"),
    )
    out = archive.with_blobs(landed, "tx_blob", "meta_blob")
    return out.select("hash", F.decode("tx_blob", "UTF-8").alias("tx"), X.to_hex("meta_blob").alias("meta"), F.array_join("unread", ",").alias("unread"))
