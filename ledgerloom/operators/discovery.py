"""Who ever held a token: scans of landed history, closure of the transfer graph, cross-checks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X


def authorization_scan(history: DataFrame, issuances: DataFrame) -> DataFrame:
    """issuance_id, address, ledger: holders in the issuers' authorization transactions, with the earliest ledger (null
    ledgers lose). history: tx_type, account, holder, mpt_issuance_id, ledger_index."""
    dim = issuances.filter("kind = 'mpt'").select("issuance_id", F.upper("mpt_issuance_id").alias("_mpt"), "issuer_account")
    who = F.coalesce("holder", F.when(F.col("account") != F.col("issuer_account"), F.col("account")))
    found = history.filter("tx_type = 'MPTokenAuthorize'").withColumn("_mpt", F.upper("mpt_issuance_id")).join(dim, "_mpt")
    return _earliest(found.withColumn("address", who).filter("address is not null"))


def trust_line_scan(history: DataFrame, issuances: DataFrame) -> DataFrame:
    """The same for trust lines set towards an issuer. history: tx_type, account, limit_issuer, limit_currency, ledger_index."""
    dim = issuances.filter("kind = 'iou'").select("issuance_id", X.currency_readable("currency").alias("_c"), F.col("issuer_account").alias("limit_issuer"))
    found = history.filter("tx_type = 'TrustSet'").withColumn("_c", X.currency_readable("limit_currency")).join(dim, ["_c", "limit_issuer"])
    return _earliest(found.filter("account <> limit_issuer").withColumn("address", F.col("account")))


def _earliest(found: DataFrame) -> DataFrame:
    return found.groupBy("issuance_id", "address").agg(F.min("ledger_index").alias("first_acquisition_ledger"))


def closure(edges: DataFrame, seeds: DataFrame, checkpoint_every: int = 4, most_rounds: int = 10_000) -> DataFrame:
    """group, address, ledger of everyone reached from seeds (group, address) over edges (account, party, ledger_index).

    Breadth first: each round joins the frontier with the edges, and one aggregation puts who is reached beside who was visited.
    An address gets the earliest ledger of the edges that lead to it from visited accounts; seeds start without one. The edges
    are worked out once and kept, a round's result is kept until the next one is there. Rounds are cut by checkpoints, the
    driver only learns whether anyone is new."""
    ways = edges.select(F.col("account").alias("address"), "party", "ledger_index").persist(StorageLevel.MEMORY_AND_DISK)
    visited = seeds.select("group", "address", F.lit(None).cast("long").alias("ledger"), F.lit(True).alias("_new")).distinct()
    kept = None
    try:
        for round_ in range(most_rounds):
            reached = visited.filter("_new").select("group", "address").join(ways, "address").select("group", F.col("party").alias("address"), F.col("ledger_index").alias("ledger"), F.lit(True).alias("_new"))
            # Who was visited before isn't new, whatever leads there.
            both = visited.withColumn("_new", F.lit(False)).unionByName(reached)
            merged = both.groupBy("group", "address").agg(F.min("ledger").alias("ledger"), F.min("_new").alias("_new")).persist(StorageLevel.MEMORY_AND_DISK)
            some = merged.agg(F.max("_new")).first()[0]
            if kept is not None:
                kept.unpersist()
            visited = kept = merged
            if not some:
                return visited.drop("_new")
            if round_ % checkpoint_every == checkpoint_every - 1:
                visited, kept = merged.checkpoint(), None
                merged.unpersist()
    finally:
        ways.unpersist()
    raise RuntimeError(f"no closure within {most_rounds} rounds")


def transfer_edges(parties: DataFrame, related: DataFrame, links: DataFrame) -> DataFrame:
    """account, party, ledger_index, issuance_id: a related transaction listed under an account leads to its parties."""
    listed = links.select("hash", F.col("address").alias("account"))
    return (
        related.join(listed, "hash")
        .join(parties.select("hash", "ledger_index", F.col("address").alias("party")), "hash")
        .groupBy("issuance_id", "account", "party")
        .agg(F.min("ledger_index").alias("ledger_index"))
    )


def current_holders(lines: DataFrame, issuances: DataFrame) -> DataFrame:
    """issuance_id, address of the accounts on current trust lines (issuer, account, currency)."""
    dim = issuances.filter("kind = 'iou'").select("issuance_id", X.currency_readable("currency").alias("_c"), F.col("issuer_account").alias("issuer"))
    return lines.withColumn("_c", X.currency_readable("currency")).join(dim, ["_c", "issuer"]).select("issuance_id", F.col("account").alias("address")).distinct()


def missing_from(historical: DataFrame, current: DataFrame) -> DataFrame:
    """Current holders that the historical set lacks."""
    return current.select("issuance_id", "address").distinct().join(historical, ["issuance_id", "address"], "left_anti")


def completed(historical: DataFrame, current: DataFrame) -> DataFrame:
    """The union of both; those that only the current set has come without a ledger."""
    missing = missing_from(historical, current).withColumn("first_acquisition_ledger", F.lit(None).cast("long"))
    return historical.select("issuance_id", "address", "first_acquisition_ledger").unionByName(missing)


def discover(authorized: DataFrame, trusted: DataFrame, traversed: DataFrame, issuances: DataFrame, override: Column | None = None) -> DataFrame:
    """Membership of all issuances, each by the strategy that its kind and flags choose (issuances: flags)."""
    chosen = issuances.select("issuance_id", X.discovery_strategy(F.col("kind"), F.col("flags"), override).alias("discovered_via"))
    found = None
    for name, rows in (("authorization", authorized), ("trustline", trusted), ("traversal", traversed)):
        part = rows.select("issuance_id", "address", "first_acquisition_ledger").join(chosen.filter(F.col("discovered_via") == name), "issuance_id")
        found = part if found is None else found.unionByName(part)
    return found


def discover_checked(
    authorized: DataFrame, trusted: DataFrame, traversed: DataFrame, current: DataFrame, issuances: DataFrame, override: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """discover() with trust lines completed by current holders (issuance_id, address), and its statistics."""
    found = discover(authorized, completed(trusted, current), traversed, issuances, override)
    return found, statistics(found, issuances, trusted, current, override)


def statistics(found: DataFrame, issuances: DataFrame, trusted: DataFrame | None = None, current: DataFrame | None = None, override: Column | None = None) -> DataFrame:
    """One row for each issuance, those that nobody holds too: issuance_id, kind, target (how it is named), strategy, accounts,
    dated (of these, with a ledger of acquisition), first and last of these ledgers; and where trust lines were held against
    current holders current_accounts and missing_accounts (those that history lacks: missing_from tells who), else null."""
    target = F.when(F.col("kind") == "iou", F.concat_ws("/", "currency", "issuer_account")).otherwise(F.col("mpt_issuance_id"))
    all_ = issuances.select("issuance_id", "kind", target.alias("target"), X.discovery_strategy(F.col("kind"), F.col("flags"), override).alias("strategy"))
    ledger = "first_acquisition_ledger"
    told = found.groupBy("issuance_id").agg(
        F.count("*").alias("accounts"), F.count(ledger).alias("dated"), F.min(ledger).alias("first_ledger"), F.max(ledger).alias("last_ledger")
    )
    out = all_.join(told, "issuance_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("accounts", "dated")})
    if current is None or trusted is None:
        return out.withColumns({"current_accounts": F.lit(None).cast("long"), "missing_accounts": F.lit(None).cast("long")})
    # A current holder counts as missing where history has no row of the pair.
    known = trusted.select("issuance_id", "address").distinct().withColumn("_known", F.lit(True))
    checked = (
        current.select("issuance_id", "address").distinct().join(known, ["issuance_id", "address"], "left")
        .groupBy("issuance_id").agg(F.count("*").alias("_current"), F.count_if(F.col("_known").isNull()).alias("_missing"))
    )
    by_lines = F.col("strategy") == "trustline"
    counts = {name: F.when(by_lines, F.coalesce(c, F.lit(0).cast("long"))) for name, c in (("current_accounts", F.col("_current")), ("missing_accounts", F.col("_missing")))}
    return out.join(checked, "issuance_id", "left").withColumns(counts).drop("_current", "_missing")


def disagreements(left: DataFrame, right: DataFrame) -> DataFrame:
    """issuance_id, address, side: members that only one of two strategies finds."""
    a = left.select("issuance_id", "address").distinct().withColumn("_a", F.lit(True))
    b = right.select("issuance_id", "address").distinct().withColumn("_b", F.lit(True))
    both = a.join(b, ["issuance_id", "address"], "full_outer").filter("_a is null or _b is null")
    return both.select("issuance_id", "address", F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))
