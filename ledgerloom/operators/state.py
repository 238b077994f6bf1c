"""The state of ledger objects as of any ledger, from their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.operators import reports, scope


def latest(object_versions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest version of each object, by (ledger, index in the ledger); of equal ones the least hash. Deleted ones stay,
    marked. Aggregates before the shuffle, so an object with a long history costs one row a task."""
    keys = keys or ["object_id"]
    rest = [c for c in object_versions.columns if c not in keys]
    order = ["ledger_index", "tx_index", "hash"]
    # The greatest of (ledger, index); hash order breaks ties the other way round. The rest comes behind it in the same struct, so
    # that what versions are ordered by is shuffled once.
    turned = lambda c: F.translate(c, "0123456789ABCDEF", "FEDCBA9876543210")
    newest = F.max(F.struct("ledger_index", "tx_index", turned("hash").alias("hash"), *(c for c in rest if c not in order)))
    found = object_versions.groupBy(*keys).agg(newest.alias("_v"))
    return found.select(*keys, *((turned("_v.hash") if c == "hash" else F.col(f"_v.{c}")).alias(c) for c in rest))


def latest_at(object_versions: DataFrame, points: DataFrame) -> DataFrame:
    """The newest version at each requested ledger. points: issuance_id, as_of_ledger."""
    joined = object_versions.join(points.select("issuance_id", "as_of_ledger").distinct(), "issuance_id").filter("ledger_index <= as_of_ledger")
    return latest(joined, ["object_id", "as_of_ledger"])


def holders_at(object_versions: DataFrame, points: DataFrame) -> DataFrame:
    """issuance_id, as_of_ledger, address, object_id, amount, flags of live token objects, also those with 0."""
    return latest_at(object_versions, points).filter("not deleted").select("issuance_id", "as_of_ledger", "address", "object_id", "amount", "flags")


def balances(object_versions: DataFrame) -> DataFrame:
    """issuance_id, address, balance_text, balance from the newest live objects: exact, and as a decimal where that can hold it."""
    live = latest(object_versions).filter("not deleted").withColumnRenamed("amount", "delta")
    if "amount_text" in live.columns:
        live = live.withColumnRenamed("amount_text", "delta_text")
    return reports.current_balances(live)


def account_roots(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, address, as_of_ledger) with the live account's fields; status notInArchive where there is none."""
    roots = nodes.filter("entry_type = 'AccountRoot'").withColumn("address", F.col("fields.Account"))
    found = (
        roots.join(requests.select("request_id", "address", "as_of_ledger"), "address")
        .filter("ledger_index <= as_of_ledger")
        .groupBy("request_id")
        .agg(F.max_by(F.struct("fields", "deleted"), F.struct("ledger_index", "tx_index")).alias("_v"))
        .select("request_id", F.when(~F.col("_v.deleted"), F.col("_v.fields")).alias("fields"))
    )
    return requests.join(found, "request_id", "left").withColumn(
        "status", F.when(F.col("fields").isNull(), "notInArchive").otherwise("success")
    )


def trust_lines_at(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Live trust lines of requested accounts, seen from their side: request_id, peer, currency (as stored), balance_text (exact),
    balance (a decimal, null where that can't hold it), limit, limit_peer, status (unreadable if the balance is no number)."""
    told = F.trim(X.object_value("fields.Balance"))
    lines = nodes.filter("entry_type = 'RippleState'")
    side = lambda low: F.struct(
        F.col(f"fields.{'Low' if low else 'High'}Limit.issuer").alias("address"),
        F.col(f"fields.{'High' if low else 'Low'}Limit.issuer").alias("peer"),
        F.col(f"fields.{'Low' if low else 'High'}Limit.value").alias("limit"),
        F.col(f"fields.{'High' if low else 'Low'}Limit.value").alias("limit_peer"),
        (told if low else X.negate_text(told)).alias("balance_text"),
    )
    views = lines.select(
        "object_id", "ledger_index", "tx_index", "deleted", F.get_json_object("fields.Balance", "$.currency").alias("currency"),
        F.explode(F.array(side(True), side(False))).alias("s"),
    ).select("object_id", "ledger_index", "tx_index", "deleted", "currency", "s.*")
    newest = (
        views.join(requests.select("request_id", "address", "as_of_ledger"), "address")
        .filter("ledger_index <= as_of_ledger")
        .groupBy("request_id", "object_id")
        .agg(F.max_by(F.struct("deleted", "peer", "currency", "balance_text", "limit", "limit_peer"), F.struct("ledger_index", "tx_index")).alias("v"))
        .filter("not v.deleted")
        .select("request_id", "v.peer", "v.currency", exact.canonical("v.balance_text").alias("balance_text"), "v.limit", "v.limit_peer")
    )
    return newest.withColumn("balance", exact.decimal("balance_text")).withColumn("status", scope.status((F.col("balance_text").isNull(), reports.UNREADABLE)))


def reported_ledger(requests: DataFrame, coverage: DataFrame, latest: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """requests (address) with as_of_ledger and uncovered: the end of coverage, else the newest ledger in which the account
    was seen (seen: address, max_ledger, as scope.data_range gives), else the latest known ledger."""
    ends = coverage.groupBy("address").agg(F.max("to_ledger").alias("_to"))
    newest = ends.select("address", F.lit(None).cast("long").alias("_seen")).limit(0) if seen is None else seen.groupBy("address").agg(F.max("max_ledger").alias("_seen"))
    return (
        requests.join(ends, "address", "left")
        .join(newest, "address", "left")
        .withColumn("_latest", latest.select("latest").scalar())
        .withColumn("as_of_ledger", F.coalesce("_to", "_seen", "_latest"))
        .withColumn("uncovered", F.col("_to").isNull())
        .drop("_to", "_seen", "_latest")
    )


def merge_state(current: DataFrame, new_versions: DataFrame) -> DataFrame:
    """A materialised latest-version table with new versions merged in, in whatever order they arrive."""
    return latest(current.unionByName(new_versions))
