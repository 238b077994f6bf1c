"""Requests: validation, issuance resolution, scope flags; and the completeness of what the archive holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X

OK, NOT_IN_ARCHIVE, OUT_OF_COVERAGE, INVALID = "success", "notInArchive", "outOfCoverage", "invalidParams"


def status(*cases: tuple[Column, str]) -> Column:
    """The first case that holds names the status; else success."""
    out = None
    for condition, name in cases:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(OK) if out is None else out.otherwise(OK)


#: The answering version of the interface, and the operations that requests can name.
VERSION = 2
OPERATIONS = ("account_tx", "account_info", "account_lines", "gateway_balances", "ledger", "mpt_holders", "archive_balance_at", "archive_transactions", "tx")


#: What a parameter's text must look like, by type.
TYPES = {
    "account": ("^r[1-9A-HJ-NP-Za-km-z]{1,34}$", "is no account"),
    "integer": ("^-?[0-9]{1,18}$", "is no integer"),
    "boolean": ("^(true|false)$", "is neither true nor false"),
    "hash": ("^[0-9A-Fa-f]{64}$", "is no hash"),
    "ledger": ("^([0-9]{1,18}|validated|closed|current)$", "is no ledger"),
}


def validate(requests: DataFrame, needs: dict[str, tuple[str, ...]] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """requests (command, api_version and parameters, all as text) with status and error, the first of: another version than
    VERSION, an operation that isn't served, a parameter that the operation needs (needs: operation -> columns) and lacks, one
    that is given and not of its type (types: column -> one of TYPES), in the order of columns."""
    needs = needs or {}
    lacking = None
    for command, columns in needs.items():
        for c in columns:
            bad = (F.col("command") == command) & (F.coalesce(F.trim(c), F.lit("")) == "")
            lacking = F.when(bad, f"{c} is missing") if lacking is None else lacking.when(bad, f"{c} is missing")
    for c, kind in (types or {}).items():
        pattern, what = TYPES[kind]
        given = F.trim(c)
        bad = (F.coalesce(given, F.lit("")) != "") & ~given.rlike(pattern)
        lacking = F.when(bad, f"{c} {what}") if lacking is None else lacking.when(bad, f"{c} {what}")
    missing = F.lit(None).cast("string") if lacking is None else lacking
    version = F.trim("api_version").try_cast("int")
    state = status(
        (F.coalesce(version != VERSION, F.lit(True)), "invalidApiVersion"),
        (~F.coalesce(F.col("command").isin(*OPERATIONS), F.lit(False)), "unsupported"),
        (missing.isNotNull(), INVALID),
    )
    error = F.when(F.col("status") == "invalidApiVersion", F.concat(F.lit(f"api_version {VERSION} is required, not "), F.coalesce("api_version", F.lit("none")))).when(
        F.col("status") == "unsupported", F.concat(F.lit("not served: "), F.coalesce("command", F.lit("none")))
    ).when(F.col("status") == INVALID, missing)
    return requests.withColumn("status", state).withColumn("error", error)


def resolve_issuances(requests: DataFrame, issuances: DataFrame) -> DataFrame:
    """requests (issuance: 'id', 'CURRENCY/issuer' or an mpt id) with issuance_id, null if nothing is tracked by that name.
    A local id goes before an mpt id, and that before currency and issuer."""
    text = F.trim("issuance")
    keyed = requests.withColumn("_n", F.when(text.rlike("^[0-9]{1,18}$"), text).cast("long")).withColumn("_m", F.upper(text))
    keyed = keyed.withColumn("_c", X.currency_wire(X.currency_readable(F.trim(F.substring_index(text, "/", 1))))).withColumn(
        "_i", F.when(text.contains("/"), F.trim(F.substring_index(text, "/", -1)))
    )
    one = lambda key, *cols: issuances.filter(key).select(F.col("issuance_id").alias(cols[-1]), *cols[:-1])
    by_id = issuances.select(F.col("issuance_id").alias("_n"), F.col("issuance_id").alias("_by_id"))
    by_mpt = one("kind = 'mpt'", F.upper("mpt_issuance_id").alias("_m"), "_by_mpt")
    by_line = one("kind = 'iou'", X.currency_wire(X.currency_readable("currency")).alias("_c"), F.col("issuer_account").alias("_i"), "_by_line")
    return (
        keyed.join(by_id, "_n", "left")
        .join(by_mpt, "_m", "left")
        .join(by_line, ["_c", "_i"], "left")
        .withColumn("issuance_id", F.coalesce("_by_id", "_by_mpt", "_by_line"))
        .drop("_n", "_m", "_c", "_i", "_by_id", "_by_mpt", "_by_line")
    )


def flag(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with whether others has their keys."""
    there = others.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(there, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def envelope(coverage: DataFrame) -> DataFrame:
    """address, from_ledger, to_ledger: from the lowest to the highest ledger of an account's claims; holes don't show
    (n_stretches counts the separate stretches, for those who want to know)."""
    order = Window.partitionBy("address").orderBy("from_ledger", "to_ledger")
    reach = F.max("to_ledger").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("from_ledger") > reach + 1), 1).otherwise(0)
    return (
        coverage.withColumn("_opens", opens)
        .groupBy("address")
        .agg(F.min("from_ledger").alias("from_ledger"), F.max("to_ledger").alias("to_ledger"), F.sum("_opens").alias("n_stretches"))
    )


def strict_window(membership: DataFrame, coverage: DataFrame, tail_to: int | None = None) -> DataFrame:
    """issuance_id, from_ledger, to_ledger over which all members are covered; null if a member has no claim or nothing is
    left. The tail's high-water mark lifts the end for all."""
    own = envelope(coverage).select("address", "from_ledger", "to_ledger")
    joined = membership.select("issuance_id", "address").distinct().join(own, "address", "left")
    high = F.greatest(F.min("to_ledger"), F.lit(tail_to).cast("long"))
    window = joined.groupBy("issuance_id").agg(
        F.count("*").alias("members"),
        F.count_if(F.col("from_ledger").isNull()).alias("uncovered"),
        F.max("from_ledger").alias("_from"),
        high.alias("_to"),
    )
    whole = (F.col("uncovered") == 0) & (F.col("_from") <= F.col("_to"))
    return window.select(
        "issuance_id", "members", "uncovered", F.when(whole, F.col("_from")).alias("from_ledger"), F.when(whole, F.col("_to")).alias("to_ledger")
    )


def covered_stretches(membership: DataFrame, coverage: DataFrame) -> DataFrame:
    """issuance_id, from_ledger, to_ledger: the stretches over which every member is covered, holes seen; none for an issuance with
    a member that has no claim.

    Overlapping and adjacent claims of an account become one stretch first. Then each stretch opens and closes at a ledger, openings
    and closings of an issuance are added up by ledger, and the running sum tells how many members are covered from there on:
    the sweep keeps one row a ledger where something changes, however many members there are."""
    order = Window.partitionBy("address").orderBy("from_ledger", "to_ledger")
    reach = F.max("to_ledger").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("from_ledger") > reach + 1), 1).otherwise(0)
    claims = coverage.filter("from_ledger <= to_ledger").select("address", "from_ledger", "to_ledger").withColumn("_opens", opens)
    own = claims.withColumn("_stretch", F.sum("_opens").over(order)).groupBy("address", "_stretch").agg(F.min("from_ledger").alias("from_ledger"), F.max("to_ledger").alias("to_ledger"))
    members = membership.select("issuance_id", "address").distinct()
    change = F.explode(F.array(F.struct(F.col("from_ledger").alias("ledger"), F.lit(1).alias("n")), F.struct((F.col("to_ledger") + 1).alias("ledger"), F.lit(-1).alias("n"))))
    changes = members.join(own, "address").select("issuance_id", change.alias("c")).groupBy("issuance_id", F.col("c.ledger").alias("ledger")).agg(F.sum("c.n").alias("n"))
    sweep = Window.partitionBy("issuance_id").orderBy("ledger")
    counted = changes.select("issuance_id", "ledger", F.sum("n").over(sweep.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"), (F.lead("ledger").over(sweep) - 1).alias("to_ledger"))
    # Where one member's claim ends and another's begins the count stays the same; such neighbours are one stretch.
    whole = counted.join(members.groupBy("issuance_id").agg(F.count("*").alias("members")), "issuance_id").filter("covered = members and to_ledger >= ledger")
    before = F.lag("to_ledger").over(sweep)
    marked = whole.withColumn("_new", F.when(before.isNull() | (before + 1 < F.col("ledger")), 1).otherwise(0)).withColumn("_stretch", F.sum("_new").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("issuance_id", "_stretch").agg(F.min("ledger").alias("from_ledger"), F.max("to_ledger").alias("to_ledger")).drop("_stretch")


def strict_window_with_holes(membership: DataFrame, coverage: DataFrame, tail_to: int | None = None) -> DataFrame:
    """strict_window with covered_ledgers (how many ledgers of the window all members are covered in) and whole: whether that is
    all of them. The window spans each member's claims from end to end; whole tells whether it may be trusted."""
    window = strict_window(membership, coverage, tail_to)
    held = window.select("issuance_id", F.col("from_ledger").alias("_from"), F.col("to_ledger").alias("_to")).join(covered_stretches(membership, coverage), "issuance_id")
    # The tail covers all members between the end of the shortest envelope and its own high-water mark.
    ends = membership.select("issuance_id", "address").distinct().join(envelope(coverage), "address").groupBy("issuance_id").agg(F.min("to_ledger").alias("_end"))
    inside = F.greatest(F.least("to_ledger", "_to") - F.greatest("from_ledger", "_from") + 1, F.lit(0))
    counted = held.join(ends, "issuance_id").withColumn("to_ledger", F.least("to_ledger", "_end")).groupBy("issuance_id").agg(F.sum(inside).alias("_n"))
    out = window.join(counted, "issuance_id", "left").join(ends, "issuance_id", "left")
    tail = F.greatest(F.col("to_ledger") - F.greatest(F.col("_end"), F.col("from_ledger") - 1), F.lit(0))
    covered = F.when(F.col("from_ledger").isNotNull(), F.coalesce("_n", F.lit(0)) + tail)
    return out.select(
        "issuance_id", "members", "uncovered", "from_ledger", "to_ledger", covered.alias("covered_ledgers"), (covered == F.col("to_ledger") - F.col("from_ledger") + 1).alias("whole")
    )


def status_window(membership: DataFrame, coverage: DataFrame, tail_to: int | None = None) -> DataFrame:
    """Like strict_window over the members that have claims; those without are ignored, issuances without any left out."""
    own = envelope(coverage)
    joined = membership.select("issuance_id", "address").distinct().join(own, "address")
    window = joined.groupBy("issuance_id").agg(
        F.max("from_ledger").alias("_from"), F.greatest(F.min("to_ledger"), F.lit(tail_to).cast("long")).alias("_to")
    )
    whole = F.col("_from") <= F.col("_to")
    return window.select("issuance_id", F.when(whole, F.col("_from")).alias("from_ledger"), F.when(whole, F.col("_to")).alias("to_ledger"))


def sweep_claims(issuances: DataFrame, membership: DataFrame, swept: DataFrame) -> DataFrame:
    """Coverage after sweeps of issuers. swept: issuance_id, from_ledger, to_ledger. All holders and the issuer are covered
    from the earliest acquisition (within the swept range) to the sweep's end."""
    first = membership.groupBy("issuance_id").agg(F.min("first_acquisition_ledger").alias("_first"))
    floor = F.coalesce(F.least("to_ledger", F.greatest("from_ledger", "_first")), F.col("from_ledger"))
    floor = F.when(F.col("_first").isNull(), F.col("from_ledger")).otherwise(floor)
    ranges = swept.join(first, "issuance_id", "left").select("issuance_id", floor.alias("from_ledger"), "to_ledger")
    who = membership.select("issuance_id", "address").union(issuances.select("issuance_id", "issuer_account")).distinct()
    return who.join(ranges, "issuance_id").select("address", "from_ledger", "to_ledger", F.lit("issuer_sweep").alias("reason")).distinct()


def holder_claims(scanned: DataFrame, requested: DataFrame) -> DataFrame:
    """Coverage after scans of holders: from the requested start (0 if none) to the highest ledger scanned, in scope or not.
    scanned: address, ledger_index; requested: address, from_ledger."""
    high = scanned.groupBy("address").agg(F.max("ledger_index").alias("to_ledger"))
    return requested.join(high, "address").select(
        "address", F.coalesce("from_ledger", F.lit(0)).cast("long").alias("from_ledger"), "to_ledger", F.lit("holder_sweep").alias("reason")
    )


def data_range(links: DataFrame, transactions: DataFrame) -> DataFrame:
    """address, lowest and highest ledger of its stored transactions."""
    joined = links.join(transactions.select("hash", "ledger_index"), "hash")
    return joined.groupBy("address").agg(F.min("ledger_index").alias("min_ledger"), F.max("ledger_index").alias("max_ledger"))


def beyond(low: Column, high: Column, from_ledger: Column, to_ledger: Column) -> Column:
    """Whether a range (null: open) reaches outside a covered one; without coverage it does."""
    return from_ledger.isNull() | F.coalesce(low < from_ledger, F.lit(False)) | F.coalesce(high > to_ledger, F.lit(False))


def resume_from(coverage: DataFrame, ledgers: DataFrame) -> DataFrame:
    """One row: the ledger up to which nothing has to be fetched again."""
    a = coverage.agg(F.max("to_ledger").alias("m")).union(ledgers.agg(F.max("ledger_index")))
    return a.agg(F.max("m").alias("high_water"))
