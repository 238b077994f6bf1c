"""Deleting an issuance from stored logs: tombstones that views honour, and compaction that folds them in.

A deletion writes which issuance and which accounts went, up to which batch. Rows of these batches are hidden from then on, so a
stream that replays one of them brings nothing back; batches after it count again, should the issuance be registered anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import maintenance
from ledgerloom.streaming.ingest import SCHEMAS, Tables

ISSUANCES, ACCOUNTS = "issuance_id long, upto long", "address string, upto long"
BY_ISSUANCE = ("balance_deltas", "account_issuance", "reconciliation_run")
BY_ACCOUNT = ("account_transactions", "coverage")


def _recover(tables: Tables, name: str) -> None:
    """Ends a compaction that broke off between its two renames."""
    files, at, made = _places(tables, name)
    if files.exists(made) and not files.exists(at):
        files.rename(made, at)


def _places(tables: Tables, name: str):
    path = tables.spark._jvm.org.apache.hadoop.fs.Path
    at, made = path(f"{tables.path}/{name}"), path(f"{tables.path}/{name}_compacted")
    return at.getFileSystem(tables.spark._jsc.hadoopConfiguration()), at, made


def _hidden(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows but for those of the keys that went, up to the batch of their deletion."""
    last = gone.groupBy(F.col(key).alias("_k")).agg(F.max("upto").alias("_upto"))
    return rows.join(last, (F.col(key) == F.col("_k")) & (F.col("batch") <= F.col("_upto")), "left_anti")


def view(tables: Tables, name: str) -> DataFrame:
    """A log with its batches, without what deletions hide. A transaction that has lost all its links and deltas to a deletion is
    hidden too."""
    _recover(tables, name)
    rows = tables.log(name, SCHEMAS[name])
    if name in BY_ISSUANCE:
        return _hidden(rows, tables.log("deleted_issuances", ISSUANCES), "issuance_id")
    if name in BY_ACCOUNT:
        return _hidden(rows, tables.log("deleted_accounts", ACCOUNTS), "address")
    if name == "transactions":
        links, deltas = (tables.log(x, SCHEMAS[x]).select("hash") for x in ("account_transactions", "balance_deltas"))
        left = view(tables, "account_transactions").select("hash").union(view(tables, "balance_deltas").select("hash"))
        # Compacted logs no longer tell whom a transaction had; what has nobody left went.
        lost = rows.select("hash").join(left, "hash", "left_anti")
        had = links.union(deltas).union(tables.log("deleted_hashes", "hash string").select("hash"))
        return rows.join(lost.join(had, "hash", "left_semi"), "hash", "left_anti")
    return rows


def delete(tables: Tables, issuances: DataFrame, issuance_id: int, upto: int) -> DataFrame:
    """Hides an issuance's rows of all batches up to one, with its accounts' links and claims (maintenance.delete_issuance says
    whose); returns the counts. issuances: the registered ones, the deleted one among them. Running it again changes nothing."""
    spark = tables.spark
    now = {name: view(tables, name) for name in (*BY_ISSUANCE, *BY_ACCOUNT, "transactions")}
    now |= {"issuances": issuances, "accounts": now["account_transactions"].select("address").distinct()}
    counts = maintenance.delete_issuance(now, issuance_id)[1].collect()
    gone = maintenance.removed_accounts(issuances, now["account_issuance"], issuance_id)
    hashes = now["account_transactions"].join(gone, "address", "left_semi").select("hash").union(now["balance_deltas"].filter(F.col("issuance_id") == issuance_id).select("hash")).distinct()
    # All of these are worked out from the logs as they are before the first tombstone is written.
    for name, rows in (("deleted_hashes", hashes), ("deleted_accounts", gone.select("address", F.lit(upto).cast("long").alias("upto")))):
        tables.append(name, rows, upto)
    tables.append("deleted_issuances", spark.createDataFrame([(issuance_id, upto)], ISSUANCES), upto)
    return spark.createDataFrame(counts)


def compact(tables: Tables, name: str) -> None:
    """Rewrites a log without its hidden rows, beside it, and puts it in its place. Not to run beside a writer of the log."""
    files, at, made = _places(tables, name)
    _recover(tables, name)
    view(tables, name).hint("rebalance", "batch").write.mode("overwrite").partitionBy("batch").parquet(f"{tables.path}/{name}_compacted")
    files.delete(at, True)
    files.rename(made, at)
