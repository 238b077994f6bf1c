"""Pages from clustered tables, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import keyset
from ledgerloom.plans.registry import query
from ledgerloom.plans.report_queries import _HOLDERS, _mpt_holders
from ledgerloom.sources.driver_tables import DriverTables


def _folder(t: DriverTables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("""
WITH r AS (SELECT DISTINCT address, forward FROM a_account_issuance, (VALUES (TRUE), (FALSE)) v(forward)),
q AS (SELECT r.*, c.from_ledger AS f, c.to_ledger AS e FROM r LEFT JOIN a_coverage c USING (address)),
rows_ AS (SELECT q.address, q.forward, x.hash, x.ledger_index, x.tx_type FROM q JOIN a_account_transactions l USING (address) JOIN a_transactions x USING (hash)
          WHERE (q.f IS NULL OR x.ledger_index >= q.f) AND x.ledger_index <= least(2200, coalesce(q.e, 2200))),
n AS (SELECT *, CASE WHEN forward THEN row_number() OVER (PARTITION BY address, forward ORDER BY ledger_index, hash)
        ELSE row_number() OVER (PARTITION BY address, forward ORDER BY ledger_index DESC, hash DESC) END AS n, count(*) OVER (PARTITION BY address, forward) AS total FROM rows_)
SELECT concat(CASE WHEN forward THEN 'up ' ELSE 'down ' END, address) AS request_id, hash, ledger_index, tx_type, CAST(n - 4 AS BIGINT) AS rank,
  CASE WHEN n = 8 AND total > 8 THEN concat(ledger_index, ':', hash) END AS next_marker FROM n WHERE n BETWEEN 5 AND 8""")
def srt1_keyset_pages(t: DriverTables) -> DataFrame:
    """The second pages of all accounts in both directions, from history that three batches have clustered."""
    table, links, transactions = keyset.history(t.spark, _folder(t, "history")), t.account_transactions(), t.transactions()
    for run in range(3):
        table.append(keyset.history_rows(links, transactions.filter(F.col("ledger_index") % 3 == run)), run, 16)
    asked = t.account_issuance().select("address").distinct().select(
        "address", F.lit(None).cast("long").alias("low"), F.lit(2200).cast("long").alias("high"), F.lit(4).alias("limit"), F.explode(F.array(F.lit(True), F.lit(False))).alias("forward"), F.lit(None).cast("string").alias("marker")
    ).withColumn("request_id", F.concat(F.when(F.col("forward"), "up ").otherwise("down "), "address"))
    page = lambda asked: keyset.account_pages(asked, table, t.coverage(), t.accounts())
    shared_folder(t.spark)
    markers = page(asked).filter("next_marker is not null").select("request_id", "next_marker").checkpoint()
    second = page(asked.drop("marker").join(markers, "request_id").withColumnRenamed("next_marker", "marker"))
    return second.filter("hash is not null").select("request_id", "hash", "ledger_index", "tx_type", F.col("rank").cast("long").alias("rank"), "next_marker")


@query(
    _HOLDERS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY issuance_id ORDER BY object_id) AS n, count(*) OVER (PARTITION BY issuance_id) AS total FROM live)
SELECT issuance_id, object_id, address, CAST(amount AS DOUBLE) AS amount, CAST(n - 6 AS BIGINT) AS rank, CASE WHEN n = 12 AND total > 12 THEN object_id END AS next_marker FROM n WHERE n BETWEEN 7 AND 12"""
)
def srt2_keyset_holders(t: DriverTables) -> DataFrame:
    """The second pages of holders, from holders that are clustered by object id."""
    table = keyset.holders(t.spark, _folder(t, "holders"))
    table.append(_mpt_holders(t), 0, 16)
    asked = t.issuances().filter("kind = 'mpt'").select(
        F.col("issuance_id").alias("request_id"), "issuance_id", F.lit(1500).cast("long").alias("as_of_ledger"), F.lit(6).alias("limit"), F.lit(None).cast("string").alias("marker")
    )
    markers = keyset.holder_pages(asked, table).filter("next_marker is not null").select("request_id", "next_marker").checkpoint()
    second = keyset.holder_pages(asked.drop("marker").join(markers, "request_id").withColumnRenamed("next_marker", "marker"), table)
    return second.select("issuance_id", "object_id", "address", F.col("amount").cast("double").alias("amount"), F.col("rank").cast("long").alias("rank"), "next_marker")
