"""Two independent derivations of every balance, held against each other."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact


def compare(left: DataFrame, right: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """issuance_id, address, left_text, right_text, left_balance, right_balance where two balance tables differ, exactly and as
    decimals (null where these can't hold them); who isn't there has 0. A balance that is there but unknown differs from
    everything."""
    keys = ["issuance_id", "address"]
    if scope is not None:
        left, right = (x.join(scope.select(*keys).distinct(), keys, "left_semi") for x in (left, right))
    return _compare(_told(left), _told(right))


def _told(balances: DataFrame) -> DataFrame:
    """issuance_id, address and the balance as canonical text, null if it is unknown."""
    return balances.select("issuance_id", "address", exact.Money(balances, "balance").told_text.alias("told"))


def _compare(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.withColumnRenamed("told", "left_text"), right.withColumnRenamed("told", "right_text")
    a, b = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    told = lambda c, there: F.when(F.col(there).isNull(), "0").otherwise(F.col(c))
    both = a.join(b, ["issuance_id", "address"], "full_outer").withColumns({"left_text": told("left_text", "_l"), "right_text": told("right_text", "_r")})
    differ = both.drop("_l", "_r").filter("coalesce(left_text <> right_text, true)")
    return differ.withColumns({"left_balance": exact.decimal("left_text"), "right_balance": exact.decimal("right_text")})


def digests(balances: DataFrame, ranges: int) -> DataFrame:
    """issuance_id, part, n, and two sums of hashes over the accounts of each of so many hash ranges: sides with equal digests
    hold equal balances. Aggregates before the shuffle: a range of an issuance is one row a task."""
    return _digests(_told(balances), ranges)


def _digests(told: DataFrame, ranges: int) -> DataFrame:
    told = told.withColumnRenamed("told", "_t").filter("_t is null or _t <> '0'")
    h = F.xxhash64("issuance_id", "address", F.coalesce("_t", F.lit("?")))
    hashed = told.select("issuance_id", _part(ranges).alias("part"), h.alias("_h"), F.xxhash64(h, F.lit("again")).cast("decimal(20,0)").alias("_g"))
    return hashed.groupBy("issuance_id", "part").agg(F.count("*").alias("n"), F.bit_xor("_h").alias("one"), F.sum("_g").alias("two"))


def _part(ranges: int):
    return F.pmod(F.xxhash64("address"), F.lit(ranges))


def suspects(left: DataFrame, right: DataFrame, ranges: int = 1024) -> DataFrame:
    """issuance_id, part of the hash ranges in which two balance tables differ."""
    return _suspects(_told(left), _told(right), ranges)


def _suspects(left: DataFrame, right: DataFrame, ranges: int) -> DataFrame:
    a, b = _digests(left, ranges), _digests(right, ranges)
    state = lambda d, name: d.select("issuance_id", "part", F.struct("n", "one", "two").alias(name))
    both = state(a, "_a").join(state(b, "_b"), ["issuance_id", "part"], "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("issuance_id", "part")


def compare_suspects(left: DataFrame, right: DataFrame, ranges: int = 1024) -> DataFrame:
    """compare, over the hash ranges whose digests differ only: what is joined grows with the differences and not with the
    tables. A balance that is unknown on both sides counts as equal here."""
    # Each side is read for its digests and once more for its rows in these ranges, so it is worked out once and kept.
    left, right = (_told(side).persist(StorageLevel.MEMORY_AND_DISK) for side in (left, right))
    where = _suspects(left, right, ranges)
    inside = lambda rows: rows.withColumn("part", _part(ranges)).join(where, ["issuance_id", "part"], "left_semi").drop("part")
    return _compare(inside(left), inside(right))


def changed_since(delta_log: DataFrame, batch: int) -> DataFrame:
    """issuance_id of those with deltas in the batches of a log after one: the others needn't be reconciled again."""
    return delta_log.filter(F.col("batch") > batch).select("issuance_id").distinct()


def verdicts(issuances: DataFrame, differences: DataFrame, run_id: int) -> DataFrame:
    """A log row for each issuance: passed if nothing differs."""
    n = differences.groupBy("issuance_id").agg(F.count("*").alias("_n"))
    return issuances.select("issuance_id").join(n, "issuance_id", "left").select(
        "issuance_id",
        F.lit(run_id).cast("long").alias("run_id"),
        F.current_timestamp().alias("ran_at"),
        F.col("_n").isNull().alias("passed"),
        F.coalesce("_n", F.lit(0)).alias("discrepancies"),
    )


def totals(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """issuance_id, matched, mismatched of our sampled balances against an external snapshot (missing there: 0)."""
    keys = ["issuance_id", "address"]
    b = theirs.select(*keys, exact.Money(theirs, "balance").told_text.alias("_theirs"))
    same = F.col("_ours") == F.coalesce("_theirs", F.lit("0"))
    return ours.withColumn("_ours", exact.Money(ours, "balance").told_text).join(b, keys, "left").groupBy("issuance_id").agg(F.count_if(same).alias("matched"), F.count_if(~same).alias("mismatched"))
