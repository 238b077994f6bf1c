"""Times and ledgers: as-of resolution and calendar upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket; events of one bucket are sorted together, buckets are joined by their greatest ledgers.
BUCKET_SECONDS = 7 * 24 * 3600


def resolve_times(requests: DataFrame, ledgers: DataFrame, time: str = "time", out: str = "resolved_ledger") -> DataFrame:
    """requests with the greatest ledger index whose close time is at or before the request's time (null: none).

    Both sides are cut into time buckets: inside a bucket a running maximum answers, and what earlier buckets hold comes
    as one number a bucket. No task sorts more than a bucket."""
    bucket = F.floor(F.unix_timestamp("_t") / BUCKET_SECONDS)
    order = "_t"
    known = ledgers.filter("close_time is not null").select(F.col("close_time").alias("_t"), F.col("ledger_index").alias("_l")).withColumn("_b", bucket)
    asked = requests.withColumn("_t", F.col(time).cast("timestamp")).withColumn("_b", bucket)
    most = known.groupBy("_b").agg(F.max("_l").alias("_most"))
    # One row a bucket: a week's bucket gives some thousands of rows for a century.
    spine = most.select("_b").union(asked.select("_b")).distinct().join(most, "_b", "left")
    before = spine.select(F.col("_b").alias("_bucket"), F.max("_most").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    columns = requests.columns
    row = F.struct(*(F.col(c) for c in columns))
    both = asked.select("_t", "_b", F.lit(None).cast("long").alias("_l"), row.alias("_r"), F.lit(1).alias("_q")).unionByName(
        known.select("_t", "_b", "_l", F.lit(0).alias("_q")), allowMissingColumns=True
    )
    inside = Window.partitionBy("_b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_here", F.max("_l").over(inside))
        .filter("_q = 1")
        .join(before, F.col("_b").eqNullSafe(F.col("_bucket")), "left")
        .select("_r.*", F.when(F.col("_t").isNotNull(), F.greatest("_here", "_before")).alias(out))
    )


def resolve_points(requests: DataFrame, ledgers: DataFrame, latest: DataFrame, fallback: Column | None = None) -> DataFrame:
    """requests (ledger_index as text, time) with point (a ledger) and point_error.

    A number is itself; validated, current, latest and nothing at all mean latest (one row, column latest), or fallback;
    else a time is resolved."""
    text = F.lower(F.trim(F.col("ledger_index").cast("string")))
    alias = text.isin("validated", "current", "latest")
    number = F.when(text.rlike("^[0-9]{1,15}$"), text).cast("long")
    resolved = resolve_times(requests, ledgers).withColumn("_latest", latest.select("latest").scalar())
    none = text.isNull() & F.col("time").isNull()
    usual = F.col("_latest") if fallback is None else F.coalesce(fallback, F.col("_latest"))
    point = F.coalesce(number, F.when(alias, F.col("_latest")), F.when(none, usual), F.when(text.isNull(), F.col("resolved_ledger")))
    error = F.when(text.isNotNull() & number.isNull() & ~alias, "ledger_index is no ledger").when(
        text.isNull() & F.col("time").isNotNull() & F.col("resolved_ledger").isNull(), "no ledger at or before the time"
    )
    return resolved.withColumn("point_error", error).withColumn("point", F.when(F.col("point_error").isNull(), point)).drop("_latest", "resolved_ledger")


def missing_times(wanted: DataFrame, ledgers: DataFrame, feed: DataFrame) -> DataFrame:
    """New calendar rows: the wanted ledgers that ledgers doesn't know, as far as the feed has their close times."""
    unknown = wanted.select("ledger_index").distinct().join(ledgers.filter("close_time is not null").select("ledger_index"), "ledger_index", "left_anti")
    return unknown.join(feed.groupBy("ledger_index").agg(F.min("close_time").alias("close_time")), "ledger_index")


def latest_archived(transactions: DataFrame) -> DataFrame:
    """One row: the greatest ledger of a transaction, null without any."""
    return transactions.agg(F.max("ledger_index").alias("latest"))


def latest_seen(ledgers: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: the greatest ledger of the calendar or of a transaction, 0 without any."""
    both = ledgers.select("ledger_index").union(transactions.select("ledger_index"))
    return both.agg(F.coalesce(F.max("ledger_index"), F.lit(0)).alias("latest"))


def gaps(tail: DataFrame, anchor: int | None = None) -> DataFrame:
    """Ranges of ledgers that an event skipped, against the greatest ledger that arrived before it (order: seq).

    Arrival order counts: an older ledger that comes late neither makes nor closes a gap. Events are numbered in buckets of
    seq, with the greatest ledger of earlier buckets carried over, so that no task sorts the whole stream."""
    size = 100_000
    events = tail.select("seq", "ledger_index").withColumn("_b", F.floor(F.col("seq") / size))
    most = events.groupBy("_b").agg(F.max("ledger_index").alias("_most"))
    before = most.select("_b", F.max("_most").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("seq", "ledger_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.max("ledger_index").over(inside), F.col("_before"), F.lit(anchor).cast("long"))
    return (
        events.join(before, "_b")
        .withColumn("_last", last)
        .filter(F.col("ledger_index") > F.col("_last") + 1)
        .select("seq", (F.col("_last") + 1).alias("from_ledger"), (F.col("ledger_index") - 1).alias("to_ledger"))
    )


def source_gaps(events: DataFrame, high: DataFrame, anchor: int | None = None, size: int = 100_000) -> DataFrame:
    """source, seq, from_ledger, to_ledger: the gaps of each source (see gaps); high (source, last) has the greatest ledgers
    that arrived before these events, anchor stands in where there is none."""
    rows = events.select("source", "seq", "ledger_index").withColumn("_b", F.floor(F.col("seq") / size))
    most = rows.groupBy("source", "_b").agg(F.max("ledger_index").alias("_most"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = high.select("source", F.col("last").alias("_high"))
    before = (
        most.join(known, "source", "left")
        .withColumn("_before", F.greatest(F.max("_most").over(earlier), F.coalesce("_high", F.lit(anchor).cast("long"))))
        .select("source", "_b", "_before")
    )
    inside = Window.partitionBy("source", "_b").orderBy("seq", "ledger_index").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(before, ["source", "_b"])
        .withColumn("_last", F.greatest(F.max("ledger_index").over(inside), "_before"))
        .filter(F.col("ledger_index") > F.col("_last") + 1)
        .select("source", "seq", (F.col("_last") + 1).alias("from_ledger"), (F.col("ledger_index") - 1).alias("to_ledger"))
    )
