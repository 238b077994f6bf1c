"""Deleting an issuance without touching what other issuances share, and compaction."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.session import one_row


def exclusive_accounts(membership: DataFrame, issuance: DataFrame) -> DataFrame:
    """Accounts that are members of the issuance (one row: issuance_id) and of no other."""
    # In one pass, of which one row an account is shuffled.
    marked = membership.join(issuance.select("issuance_id", F.lit(True).alias("_mine")), "issuance_id", "left")
    alone = marked.groupBy("address").agg(F.bool_and(F.col("_mine").isNotNull()).alias("_alone"))
    return alone.filter("_alone and address is not null").select("address")


def removed_accounts(issuances: DataFrame, membership: DataFrame, issuance_id: int) -> DataFrame:
    """The accounts that go with an issuance: those that belong to it alone, and its issuer if no other issuance has that issuer."""
    one = issuances.sparkSession.range(issuance_id, issuance_id + 1).withColumnRenamed("id", "issuance_id")
    issuer = issuances.join(one, "issuance_id", "left_semi").select(F.col("issuer_account").alias("address"))
    others = issuances.join(one, "issuance_id", "left_anti").select(F.col("issuer_account").alias("address"))
    # Of all members, only those that are the issuer matter.
    members_elsewhere = membership.join(one, "issuance_id", "left_anti").select("address").join(issuer, "address", "left_semi")
    return exclusive_accounts(membership, one).union(issuer.join(others, "address", "left_anti").join(members_elsewhere, "address", "left_anti")).distinct()


def delete_issuance(tables: dict[str, DataFrame], issuance_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """New versions of all tables without the issuance, and one row of counts. The removed accounts are worked out at once and kept.

    Accounts that belong to it alone, and its issuer if no other issuance has that issuer, lose their links and coverage;
    then transactions that no link and no delta refers to go. Deltas of other issuances always stay; how many of them belong
    to removed accounts is counted as deltas_kept."""
    spark = tables["issuances"].sparkSession
    one = spark.range(issuance_id, issuance_id + 1).withColumnRenamed("id", "issuance_id")
    issuances = tables["issuances"].join(one, "issuance_id", "left_anti")
    gone = removed_accounts(tables["issuances"], tables["account_issuance"], issuance_id).persist(StorageLevel.MEMORY_AND_DISK)
    # Once they are there Spark knows how few they mostly are, and sends them to the tables, which aren't shuffled to meet them.
    removed = gone.count()

    new = {"issuances": issuances}
    for name in ("account_issuance", "balance_deltas", "reconciliation_run"):
        if name in tables:
            new[name] = tables[name].join(one, "issuance_id", "left_anti")
    for name in ("accounts", "account_transactions", "coverage"):
        if name in tables:
            new[name] = tables[name].join(gone, "address", "left_anti")
    if "backfill_job" in tables:
        new["backfill_job"] = tables["backfill_job"].join(one, "issuance_id", "left_anti").join(gone, "address", "left_anti")
    new["transactions"] = tables["transactions"].join(
        new["account_transactions"].select("hash").union(new["balance_deltas"].select("hash")).distinct(), "hash", "left_semi"
    )
    # Each table is read once for all counts, with what goes marked.
    marked = gone.select("address", F.lit(True).alias("_gone"))
    mine = F.col("issuance_id").eqNullSafe(issuance_id)
    lost = lambda name: tables[name].join(marked, "address", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    one_of = lambda condition: F.when(condition, 1).otherwise(0)
    # What a hash still has, and what goes with it, in one aggregation by hash: a transaction goes if it has nothing left.
    told = {
        "balance_deltas": (lost("balance_deltas"), {"deltas_removed": mine, "deltas_kept": (F.col("issuance_id") != issuance_id) & F.col("_gone"), "_left": ~mine}),
        "account_transactions": (lost("account_transactions"), {"links_removed": F.col("_gone"), "_left": ~F.col("_gone")}),
        "transactions": (tables["transactions"], {"transactions_removed": F.lit(True)}),
    }
    names = ("deltas_removed", "deltas_kept", "links_removed", "transactions_removed", "_left")
    rows = [table.select("hash", *(one_of(flags.get(n, F.lit(False))).alias(n) for n in names)) for table, flags in told.values()]
    by_hash = reduce(DataFrame.union, rows).groupBy("hash").agg(*(F.sum(n).alias(n) for n in names))
    left = F.col("hash").isNotNull() & (F.col("_left") > 0)
    total = lambda n, value: F.coalesce(F.sum(value), F.lit(0)).alias(n)
    counts = [
        spark.range(1).select(F.lit(removed).cast("long").alias("accounts_removed")),
        by_hash.agg(*(total(n, n) for n in names[:3]), total("transactions_removed", F.when(~left, F.col("transactions_removed")))),
    ]
    if "coverage" in tables:
        counts.append(lost("coverage").agg(F.count_if("_gone").alias("coverage_removed")))
    if "backfill_job" in tables:
        counts.append(lost("backfill_job").agg(F.count_if(mine | F.col("_gone")).alias("jobs_removed")))
    if "reconciliation_run" in tables:
        counts.append(tables["reconciliation_run"].agg(F.count_if(mine).alias("runs_removed")))
    out = one_row(*counts)
    return new, out.select(*(c for c in out.columns if c != "transactions_removed"), "transactions_removed")


def compact(spark: SparkSession, source: str, target: str, partition: str | None = None, files: int | None = None) -> None:
    """Rewrites a Parquet directory into fewer files, by partition column if one is named.

    Without a number of files, tasks and files have about the advisory size, so a frequent value goes to several."""
    rows = spark.read.parquet(source)
    if partition:
        rows.hint("rebalance", partition).write.partitionBy(partition).parquet(target)
    else:
        (rows.repartition(files) if files else rows.hint("rebalance")).write.parquet(target)
