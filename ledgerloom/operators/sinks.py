"""Idempotent writes: what a batch adds to a table, and canonical views over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X


def first_of_each(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the first by order (null first); aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if "map<" in rows.select(*rest).schema.simpleString():  # maps have no order
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    # One struct with the order at its front: what orders rows, such as a document, isn't shuffled twice.
    front = [c for c in order if c in rest]
    least = F.min(F.struct(*front, *(c for c in rest if c not in front))).alias("_r")
    return rows.groupBy(*keys).agg(least).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of a batch whose keys the table doesn't have yet, one for each key: insert-or-ignore."""
    once = batch.dropDuplicates(keys) if order is None else first_of_each(batch, keys, order)
    return once.join(existing.select(*keys), keys, "left_anti")


def links_of(batch: DataFrame) -> DataFrame:
    """hash, address pairs of transactions with accounts."""
    return batch.select("hash", F.explode("accounts").alias("address")).distinct()


def accounts_view(log: DataFrame) -> DataFrame:
    """address, first_seen_ledger: the earliest one known; null gives way to any ledger."""
    return log.groupBy("address").agg(F.min("first_seen_ledger").alias("first_seen_ledger"))


def membership_view(log: DataFrame) -> DataFrame:
    """address, issuance_id, discovered_via (as first recorded), first_acquisition_ledger (earliest). log: log_seq."""
    return log.groupBy("address", "issuance_id").agg(
        F.min_by("discovered_via", "log_seq").alias("discovered_via"), F.min("first_acquisition_ledger").alias("first_acquisition_ledger")
    )


def deltas_view(log: DataFrame) -> DataFrame:
    """hash, address, issuance_id, delta_text, delta of the last run that wrote each; several of one run are added up, exactly, and
    unknown ones make the sum unknown. log: run_id."""
    keys, money = ["hash", "address", "issuance_id"], exact.Money(log)
    by_run = log.withColumn("_x", money.value).groupBy(*keys, "run_id").agg(money.sum("_x").alias("_sum"), F.count_if(F.col("_x").isNull()).alias("_unknown"))
    last = by_run.groupBy(*keys).agg(F.max_by(F.struct("_sum", "_unknown"), "run_id").alias("_r")).select(*keys, "_r.*")
    told = last.withColumn("delta_text", F.when(F.col("_unknown") == 0, money.text("_sum")))
    return told.select(*keys, "delta_text", exact.decimal("delta_text").alias("delta"))


def enabled_view(issuances: DataFrame, changes: DataFrame) -> DataFrame:
    """issuances with the last change (issuance_id, enabled, seq) of each applied; changes of unknown ones do nothing."""
    last = changes.groupBy("issuance_id").agg(F.max_by("enabled", "seq").alias("_enabled"))
    return issuances.join(last, "issuance_id", "left").withColumn("enabled", F.coalesce("_enabled", "enabled")).drop("_enabled")


def changes_applied(issuances: DataFrame, changes: DataFrame) -> DataFrame:
    """changes with applied: whether the issuance is there; what isn't there can't be enabled or disabled."""
    there = issuances.select("issuance_id", F.lit(True).alias("_there")).distinct()
    return changes.join(there, "issuance_id", "left").withColumn("applied", F.coalesce("_there", F.lit(False))).drop("_there")


def register(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates (seq, kind, mpt_issuance_id, currency, issuer_account, backfill_from_ledger) with normalised columns,
    accepted and error. Of equal candidates the first is accepted."""
    checked = candidates.withColumn("_c", X.currency_checked("currency"))
    shape = (
        F.when(~F.coalesce(F.col("kind").isin("mpt", "iou"), F.lit(False)), "kind must be mpt or iou")
        .when((F.col("kind") == "mpt") & ~F.coalesce(F.col("mpt_issuance_id").rlike("^[0-9A-Fa-f]{48}$"), F.lit(False)), "mpt_issuance_id must have 48 hexadecimal digits")
        .when((F.col("kind") == "iou") & F.col("_c.error").isNotNull(), F.col("_c.error"))
        .when((F.col("kind") == "iou") & F.col("issuer_account").isNull(), "issuer_account is missing")
    )
    key = F.when(F.col("kind") == "mpt", F.upper("mpt_issuance_id")).otherwise(F.concat_ws("/", X.currency_wire(X.currency_readable("_c.value")), "issuer_account"))
    keyed = checked.withColumn("_error", shape).withColumn("_key", F.when(F.col("_error").isNull(), key))
    old = F.when(F.col("kind") == "mpt", F.upper("mpt_issuance_id")).otherwise(F.concat_ws("/", X.currency_wire(X.currency_readable("currency")), "issuer_account"))
    known = existing.select(old.alias("_key")).distinct().withColumn("_known", F.lit(True))
    order = Window.partitionBy("_key").orderBy("seq")
    ranked = keyed.join(known, "_key", "left").withColumn("_n", F.when(F.col("_key").isNotNull(), F.row_number().over(order)))
    error = F.coalesce("_error", F.when(F.coalesce("_known", F.lit(False)) | (F.col("_n") > 1), "already registered"))
    return ranked.select(
        "seq",
        "kind",
        F.upper("mpt_issuance_id").alias("mpt_issuance_id"),
        F.when(F.col("kind") == "iou", F.coalesce("_c.value", "currency")).alias("currency"),
        "issuer_account",
        F.coalesce("backfill_from_ledger", F.lit(0)).cast("long").alias("backfill_from_ledger"),
        F.lit(True).alias("enabled"),
        error.isNull().alias("accepted"),
        error.alias("error"),
    )


def export_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines whose keys are in order at every level."""
    rows.select(X.sorted_json(rows.schema).alias("value")).write.text(path)
