"""Whole answers about accounts' histories: one row a request, with the range that it speaks for, warnings and rendered entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import keyset, reports, scope

_BODY = "tx_blob binary, meta_blob binary, tx_json string, meta_json string"


def account_answers(
    requests: DataFrame, links: DataFrame, transactions: DataFrame, coverage: DataFrame, accounts: DataFrame, clustered: keyset.Clustered | None = None
) -> DataFrame:
    """Answers to (request_id, address, low, high, forward, limit, marker 'ledger:hash', binary): request_id, status, address,
    ledger_index_min, ledger_index_max, limit, transactions (entries as JSON, in the page's order), marker (of the next page, or
    null) and warnings. Without a status of success only request_id, status, address and the two standing warnings are told.

    The range is what the account's coverage spans; without coverage that of its stored transactions, and without any of these
    the archive's latest ledger. An entry is the two blobs in hexadecimal where binary is asked for, else hash and the two
    documents (keys in order; a document that can't be read is null); a null binary asks for documents.

    Pages are cut first, from links and transactions or from clustered history; the bodies (of transactions: tx_blob, meta_blob,
    tx_json, meta_json) are looked up for the rows of pages only. A page has at most reports.MOST_ROWS rows, which bounds the list."""
    asked = reports.history_requests(requests, coverage, accounts)
    if clustered is None:
        pages = reports.history_pages(asked, links, transactions)
    else:
        pages = keyset.account_pages(requests, clustered, coverage, accounts)
    rows = pages.filter("hash is not null").join(asked.select("request_id", F.coalesce("binary", F.lit(False)).alias("binary")), "request_id")
    bodies = transactions.select("hash", *(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _BODY.split(", ")))
    listed = (
        rows.join(bodies, "hash", "left")
        .withColumn("entry", history_entry())
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("_page"), F.max("next_marker").alias("_next"))
    )
    told = asked.join(listed, "request_id", "left").join(_ranges(asked, links, transactions), "address", "left")
    latest = transactions.agg(F.max("ledger_index")).scalar()
    good = F.col("status") == scope.OK
    shown = {
        "ledger_index_min": F.coalesce("_from", "min_ledger", latest),
        "ledger_index_max": F.coalesce("_to", "max_ledger", latest),
        "limit": F.col("_limit"),
        "transactions": F.coalesce(F.transform("_page", lambda x: x["entry"]), F.array().cast("array<string>")),
    }
    return told.select(
        "request_id",
        "status",
        "address",
        *(F.when(good, c).alias(name) for name, c in shown.items()),
        F.col("_next").alias("marker"),
        F.when(good, X.warnings(F.col("out_of_range"))).otherwise(X.warnings()).alias("warnings"),
    )


def history_entry():
    """An entry of a page, from ledger_index, hash, binary and the bodies."""
    common = [F.col("ledger_index"), F.lit(True).alias("validated")]
    blobs = F.to_json(F.struct(X.to_hex("tx_blob").alias("tx_blob"), X.to_hex("meta_blob").alias("meta_blob"), *common))
    parsed = F.to_json(F.struct(F.try_parse_json("tx_json").alias("tx_json"), F.try_parse_json("meta_json").alias("meta"), F.col("hash"), *common))
    return F.when(F.col("binary"), blobs).otherwise(parsed)


def _ranges(asked: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """scope.data_range of the accounts that are asked for and have no coverage."""
    bare = asked.filter((F.col("status") == scope.OK) & F.col("_from").isNull()).select("address").distinct()
    return scope.data_range(links.join(bare, "address", "left_semi"), transactions)
