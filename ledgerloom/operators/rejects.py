"""Documents that can't be read, and the answers that they make unsafe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.schemas import META

#: Ledgers of a bucket by which ranges and rejects meet.
LEDGERS = 10_000
MISSING, BROKEN, NO_NODES = "no document", "not readable", "no affected nodes"


def reason(meta_json: Column | str) -> Column:
    """Why a metadata document gives no objects; null if it can be read."""
    text = F.col(meta_json) if isinstance(meta_json, str) else meta_json
    schema = f"{META[:-1]},_broken:string>"
    read = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})

    def why(x: Column) -> Column:
        return F.when(F.coalesce(F.trim(x["text"]), F.lit("")) == "", MISSING).when(x["read"].isNull() | x["read"]["_broken"].isNotNull(), BROKEN).when(x["read"]["AffectedNodes"].isNull(), NO_NODES)

    # Under a name, so that each document is read once and not in every branch.
    return F.transform(F.array(F.struct(text.alias("text"), read.alias("read"))), why)[0]


def rejected(transactions: DataFrame) -> DataFrame:
    """hash, ledger_index, reason of the transactions whose document can't be read; whatever needs their ledgers is incomplete."""
    return transactions.select("hash", F.col("ledger_index").cast("long").alias("ledger_index"), reason("meta_json").alias("reason")).filter("reason is not null")


def still_open(rejects: DataFrame, mended: DataFrame) -> DataFrame:
    """The rejects whose transaction hasn't come since with a document that can be read (mended: hash)."""
    return rejects.join(mended.select("hash").distinct(), "hash", "left_anti")


#: Where open ranges end: behind every reject.
_END = (1 << 62) - 1


def _last_rejects(ends: DataFrame, rejects: DataFrame) -> DataFrame:
    """_high and _last, the last reject at or before it, of the distinct ends (_high) that have one.

    Running maxima inside buckets of ledgers and one carried number a bucket: a bucket has a row for each of its ledgers at most."""
    bucket = F.floor(F.col("_high") / LEDGERS).cast("long")
    known = rejects.select(F.col("ledger_index").cast("long").alias("_high")).filter("_high is not null").distinct()
    points = known.withColumn("_last", F.col("_high")).unionByName(ends.withColumn("_last", F.lit(None).cast("long")))
    points = points.groupBy("_high").agg(F.max("_last").alias("_last"), (F.count("*") > F.count("_last")).alias("_asked")).withColumn("_bucket", bucket)
    here = Window.partitionBy("_bucket").orderBy("_high").rowsBetween(Window.unboundedPreceding, 0)
    # Ledgers are numbered without gaps, so there are few buckets: one row a bucket that has a reject or an asked end.
    highest = points.groupBy("_bucket").agg(F.max("_last").alias("_last"))
    carried = highest.select("_bucket", F.max("_last").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = points.select("_bucket", "_high", "_asked", F.max("_last").over(here).alias("_last")).filter("_asked").join(carried, "_bucket")
    return found.select("_high", F.coalesce("_last", "_before").alias("_last")).filter("_last is not null")


def touched(ranges: DataFrame, rejects: DataFrame) -> DataFrame:
    """The request_ids of ranges (request_id, low, high; null: open) that hold the ledger of a reject."""
    return doubted(ranges, rejects, F.col("low"), F.col("high")).filter("_doubt").select("request_id").distinct()


def doubted(requests: DataFrame, rejects: DataFrame | None, low: Column, high: Column) -> DataFrame:
    """requests with _doubt: whether the range of ledgers behind the answer (null: open) holds a reject.

    A range holds one if the last reject up to its end doesn't lie before its beginning. Requests meet one row for each different
    end, so however many ask for one ledger, no task orders them, and no range meets single rejects."""
    if rejects is None:
        return requests.withColumn("_doubt", F.lit(False))
    ended = requests.withColumn("_high", F.coalesce(high.cast("long"), F.lit(_END)))
    last = _last_rejects(ended.select("_high").distinct(), rejects)
    holds = F.coalesce(F.col("_last") >= F.coalesce(low.cast("long"), F.lit(0)), F.lit(False))
    return ended.join(last, "_high", "left").select(*requests.columns, holds.alias("_doubt"))
