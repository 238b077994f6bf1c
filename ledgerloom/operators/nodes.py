"""From metadata documents to object versions, deltas, holders and parties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.sources.schemas import AMOUNT

KINDS = ("CreatedNode", "ModifiedNode", "DeletedNode")


def flatten(transactions: DataFrame) -> DataFrame:
    """One row for each affected object: hash, ledger_index, tx_index, node_kind, entry_type, object_id, fields, previous,
    deleted. Nodes without type or id are left out; documents that can't be read give none (rejects.rejected names them)."""
    meta = transactions.select("hash", "ledger_index", X.parse_meta("meta_json").alias("meta"))
    # The plain explode would have Spark check before it that there are nodes, which reads every document twice.
    node = meta.select("hash", "ledger_index", F.coalesce("meta.TransactionIndex", F.lit(0)).alias("tx_index"), F.explode_outer("meta.AffectedNodes").alias("n"))
    kind = F.coalesce(*(F.when(F.col("n")[k].isNotNull(), k) for k in KINDS))
    body = F.coalesce(*(F.col("n")[k] for k in KINDS))
    return (
        node.select("hash", "ledger_index", "tx_index", kind.alias("node_kind"), body.alias("b"))
        .filter("b.LedgerEntryType is not null and b.LedgerIndex is not null")
        .select(
            "hash",
            "ledger_index",
            "tx_index",
            "node_kind",
            F.col("b.LedgerEntryType").alias("entry_type"),
            F.col("b.LedgerIndex").alias("object_id"),
            F.coalesce("b.FinalFields", "b.NewFields").alias("fields"),
            F.col("b.PreviousFields").alias("previous"),
            (F.col("node_kind") == "DeletedNode").alias("deleted"),
        )
    )


def unreadable(transactions: DataFrame) -> DataFrame:
    """hash, ledger_index of documents that are there but can't be read; answers over their ledgers are incomplete."""
    return transactions.filter(F.col("meta_json").isNotNull() & X.parse_meta("meta_json")["AffectedNodes"].isNull()).select("hash", "ledger_index")


def versions(nodes: DataFrame, issuances: DataFrame) -> DataFrame:
    """Object versions of all tracked issuances, of both kinds, in one pass over the nodes: with issuance_id, address (the
    holder), amount_text and before_text (seen from the holder, as they were spelt, with every digit) and amount and before, the
    same as decimals (null where the decimal type can't hold them exactly).

    Integer tokens match by issuance id. Trust lines match by currency, compared in readable form, and the issuer on either
    side; where both sides issue the currency, the low one counts."""
    mpt = issuances.filter("kind = 'mpt'").select(F.upper("mpt_issuance_id").alias("_mpt"), F.col("issuance_id").alias("_t"), F.col("issuer_account").alias("_t_issuer"))
    iou = issuances.filter("kind = 'iou'").select("issuance_id", X.currency_readable("currency").alias("_c"), "issuer_account")
    side = lambda name: iou.select(F.concat_ws("/", "_c", "issuer_account").alias(f"_{name}"), F.col("issuance_id").alias(f"_{name}_id"))
    token = F.col("entry_type") == "MPToken"
    # A key that a row doesn't have becomes one of its own, so that such rows don't gather in one task of a shuffle join.
    own = F.concat(F.lit("-"), "hash", "object_id")
    code = F.coalesce(F.get_json_object("fields.Balance", "$.currency"), "fields.LowLimit.currency", "fields.HighLimit.currency")
    # What several branches look at is worked out in steps of their own: a branch evaluates again what it names.
    told = {"_code": F.when(~token, code), "_told": F.when(~token, F.trim(F.coalesce(X.object_value("fields.Balance"), F.lit("0")))), "_before": F.when(~token, F.trim(X.object_value("previous.Balance")))}
    currency = F.col("_currency")
    low, high = F.col("fields.LowLimit.issuer"), F.col("fields.HighLimit.issuer")
    # What is alike for both sides, and for both amounts, is said once as a function of an array. Such a step also stands for
    # itself: fused with the explode and the joins it would be one method of over 8000 bytes, which the JVM doesn't compile.
    sides = F.transform(F.array(low, high), lambda x: F.when(~token & currency.isNotNull() & x.isNotNull(), F.concat_ws("/", currency, x)).otherwise(own))
    keyed = (
        nodes.filter("entry_type in ('MPToken', 'RippleState')").withColumns(told).withColumn("_currency", X.currency_readable("_code"))
        .withColumns({"_mpt": F.coalesce(F.when(token, F.upper("fields.MPTokenIssuanceID")), own), "_sides": sides})
        .withColumns({"_low": F.col("_sides")[0], "_high": F.col("_sides")[1]})
    )
    found = keyed.join(mpt, "_mpt", "left").join(side("low"), "_low", "left").join(side("high"), "_high", "left")
    issuer_low = F.col("_low_id").isNotNull()
    texts = F.when(token, F.array(F.col("fields.MPTAmount"), F.col("previous.MPTAmount"))).otherwise(F.array("_told", "_before"))
    as_held = F.transform(texts, lambda x: F.when(token, X.integer_text(x)).when(issuer_low, X.negate_text(x)).otherwise(x))
    seen = found.filter("coalesce(_t, _low_id, _high_id) is not null").select(
        "hash", "ledger_index", "tx_index", "node_kind", "entry_type", "object_id", "deleted",
        F.coalesce("_t", "_low_id", "_high_id").alias("issuance_id"),
        F.when(token, F.col("_t_issuer")).when(issuer_low, low).otherwise(high).alias("issuer_account"),
        F.when(token, F.col("fields.Account")).when(issuer_low, high).otherwise(low).alias("address"),
        as_held.alias("_texts"),
        F.when(token, F.coalesce("fields.Flags", F.lit(0))).otherwise(F.lit(0)).alias("flags"),
    ).filter("address is not null")
    seen = seen.withColumns({"amount_text": F.col("_texts")[0], "before_text": F.col("_texts")[1]}).drop("_texts")
    return seen.withColumns({"amount": exact.decimal("amount_text"), "before": exact.decimal("before_text")})


def deltas(object_versions: DataFrame) -> DataFrame:
    """hash, ledger_index, address, issuance_id, delta_text, delta of every transaction: what its objects' amounts changed by, as
    exact text and as a decimal (null where that can't hold it). Zero deltas are left out, several of one account in a
    transaction are added up.

    Created objects count from zero and deleted ones to zero. A modified integer token without a prior amount counts from
    zero (versions has 0 there); a modified trust line without one doesn't count (its prior amount is null). Where an amount is
    no number, the delta is there without text and decimal, and whatever adds it up refuses."""
    kind = F.col("node_kind")
    counted = object_versions.filter(~((kind == "ModifiedNode") & F.col("before_text").isNull()))
    after = F.when(kind != "DeletedNode", F.col("amount_text"))
    before = F.when(kind == "DeletedNode", F.col("amount_text")).when(kind == "ModifiedNode", F.col("before_text"))
    keys = ["hash", "ledger_index", "address", "issuance_id"]
    known = "amount" in object_versions.columns and "before" in object_versions.columns
    read = counted.select(*keys, after.alias("_after"), before.alias("_before"), *([
        F.when(kind != "DeletedNode", F.col("amount")).alias("_more"), F.when(kind == "DeletedNode", F.col("amount")).when(kind == "ModifiedNode", F.col("before")).alias("_less"),
    ] if known else []))
    # Short amounts are summed as decimals; only the others are parsed.
    quick = (F.col("_after").isNull() | exact.quick("_more")) & (F.col("_before").isNull() | exact.quick("_less"))
    read = read.withColumn("_quick", quick if known else F.lit(False))
    read = exact.parsed(read, {x: F.when(~F.col("_quick"), F.coalesce(f"_{side}", F.lit("0"))) for x, side in (("_a", "after"), ("_b", "before"))})
    if not known:
        read = read.withColumn("_quick", exact.short("_a") & exact.short("_b")).withColumns({"_more": F.when(F.col("_quick"), F.col("_after").try_cast(AMOUNT)), "_less": F.when(F.col("_quick"), F.col("_before").try_cast(AMOUNT))})
    # Most long ones are told at once, each row's by one decimal.
    read = exact.difference(read, "_a", "_b", "_one")
    # Few amounts are long, so their texts are gathered: sums of all limbs in every row would be most of what is shuffled.
    left = F.struct("_one", *(F.when(F.col("_one").isNull(), F.col(c)).alias(c) for c in ("_after", "_before")))
    read = read.select(*keys, F.when(F.col("_quick"), _short("_more") - _short("_less")).alias("_q"), F.when(~F.col("_quick"), left).alias("_long"))
    summed = read.groupBy(*keys).agg(F.sum("_q").alias("_q"), F.collect_list("_long").alias("_long"))
    summed = summed.withColumns({"_short": F.size("_long") == 0, "_one": F.when(F.col("_q").isNull() & (F.size("_long") == 1), F.col("_long")[0]["_one"])})
    long = F.transform("_long", _limbs)
    bad = lambda x: (x["after"] & x["a"].isNull()) | (x["before"] & x["b"].isNull())
    # Where a key has both kinds, the short sum goes to the limbs.
    total = lambda rows: F.aggregate(rows, exact.number(F.col("_q").cast("string")), lambda so_far, x: exact.minus(so_far, exact.minus(x["b"], x["a"])))
    limbs = summed.select(*keys, "_q", "_short", "_one", F.when(~F.col("_short") & F.col("_one").isNull(), long).alias("_x"))
    # Exploded, so that the condition below takes the text and doesn't work it out again.
    text = F.when(F.col("_short"), exact.short_text(F.col("_q"))).when(F.col("_one").isNotNull(), F.col("_one")).when(~F.exists("_x", bad), exact.text(total("_x")))
    spelt = limbs.select(*keys, "_q", "_short", F.explode(F.array(text)).alias("delta_text")).filter("coalesce(delta_text <> '0', true)")
    spelt = spelt.select(*keys, "delta_text", F.when(F.col("_short"), F.col("_q").cast(AMOUNT)).alias("_q"))
    return spelt.select(*keys, "delta_text", F.coalesce("_q", exact.decimal("delta_text")).alias("delta"))


def _limbs(x):
    """Of a long amount's texts, or of their difference: whether they are there, and their limbs."""
    after = F.coalesce(x["_one"], x["_after"])
    return F.struct(after.isNotNull().alias("after"), x["_before"].isNotNull().alias("before"), exact.number(after).alias("a"), exact.number(x["_before"]).alias("b"))


def _short(amount: str):
    return F.coalesce(F.col(amount).cast("decimal(28,18)"), F.lit(0).cast("decimal(28,18)"))


def exact_deltas(object_versions: DataFrame) -> DataFrame:
    """hash, ledger_index, address, issuance_id and the delta as canonical text."""
    return deltas(object_versions).drop("delta").withColumnRenamed("delta_text", "delta")


def derive(transactions: DataFrame, issuances: DataFrame) -> DataFrame:
    """Balance deltas of all tracked issuances from transactions with metadata."""
    return deltas(versions(flatten(transactions), issuances))


def rederive(transactions: DataFrame, links: DataFrame, membership: DataFrame, issuances: DataFrame) -> DataFrame:
    """Deltas again from the stored transactions that belong to members of an issuance."""
    members = membership.select("address").distinct()
    in_scope = links.join(members, "address", "left_semi").select("hash")
    return derive(transactions.join(in_scope, "hash", "left_semi"), issuances)


def holders(object_versions: DataFrame) -> DataFrame:
    """issuance_id, address, first ledger of every account whose object was touched, also with a zero balance."""
    return object_versions.groupBy("issuance_id", "address").agg(F.min("ledger_index").alias("first_acquisition_ledger"))


def owners(nodes: DataFrame) -> DataFrame:
    """hash and owner accounts of all token and line nodes, of any issuance."""
    token = F.col("entry_type").isin("MPToken", "AccountRoot")
    # One pass over the nodes: two filters of them would read every document twice.
    who = F.when(token, F.array("fields.Account")).when(F.col("entry_type") == "RippleState", F.array("fields.LowLimit.issuer", "fields.HighLimit.issuer"))
    return nodes.select("hash", "ledger_index", F.explode_outer(who).alias("address")).filter("address is not null")


def parties(transactions: DataFrame, nodes: DataFrame) -> DataFrame:
    """hash, ledger_index, address of everyone that a transaction names (account, destination, holder) or whose object it touches.

    transactions: hash, ledger_index, account, destination, holder."""
    named = transactions.select("hash", "ledger_index", F.explode(F.array_compact(F.array("account", "destination", "holder"))).alias("address"))
    return named.union(owners(nodes)).distinct()


def related(transactions: DataFrame, nodes: DataFrame, issuances: DataFrame) -> DataFrame:
    """hash, issuance_id of transactions that name an issuance (by id or in an amount) or touch one of its objects."""
    dim = issuances.filter("kind = 'mpt'").select("issuance_id", F.upper("mpt_issuance_id").alias("_mpt"))
    named = transactions.select("hash", F.explode(F.array_compact(F.array("mpt_issuance_id", "amount_issuance", "send_max_issuance", "deliver_max_issuance"))).alias("_id"))
    by_name = named.withColumn("_mpt", F.upper("_id")).join(dim, "_mpt").select("hash", "issuance_id")
    return by_name.union(versions(nodes, issuances).select("hash", "issuance_id")).distinct()


def in_scope_accounts(transactions: DataFrame, nodes: DataFrame, accounts: DataFrame) -> DataFrame:
    """hash, address of a transaction's parties that the archive follows."""
    return parties(transactions, nodes).join(accounts.select("address"), "address", "left_semi").select("hash", "address")


def scoped_transactions(object_versions: DataFrame) -> DataFrame:
    """hash, ledger_index, accounts (holders touched and their issuers, distinct and sorted) of transactions that touch a
    tracked issuance; all others aren't kept."""
    return (
        object_versions.select("hash", "ledger_index", F.explode(F.array("address", "issuer_account")).alias("address"))
        .groupBy("hash", "ledger_index")
        .agg(F.sort_array(F.collect_set("address")).alias("accounts"))
    )


def rescan(transactions: DataFrame, issuances: DataFrame, stored: DataFrame) -> DataFrame:
    """issuance_id, status, missing, failed, first_failure: a safety re-derivation of all enabled issuances against the stored deltas.

    One job covers all issuances. One with amounts that are no numbers has failed (failed counts them, first_failure is the least
    hash); one whose derivation differs is incomplete; neither holds up the others."""
    enabled = issuances.filter("enabled")
    keys = ["hash", "address", "issuance_id"]
    fresh = derive(transactions, enabled).select(*keys, F.col("delta_text").alias("_fresh"))
    both = fresh.join(stored.select(*keys, exact.Money(stored).told_text.alias("_stored")), keys, "left")
    bad = F.col("_fresh").isNull()
    wrong = F.count_if(~bad & ~F.col("_fresh").eqNullSafe(F.col("_stored")))
    found = both.groupBy("issuance_id").agg(wrong.alias("_wrong"), F.count_if(bad).alias("_failed"), F.min(F.when(bad, F.col("hash"))).alias("first_failure"))
    missing, failed = F.coalesce("_wrong", F.lit(0)), F.coalesce("_failed", F.lit(0))
    state = F.when(failed > 0, "failed").when(missing == 0, "success").otherwise("incomplete")
    return enabled.select("issuance_id").join(found, "issuance_id", "left").select("issuance_id", state.alias("status"), missing.alias("missing"), failed.alias("failed"), "first_failure")


def entries(transactions: DataFrame, object_versions: DataFrame) -> DataFrame:
    """Landed transactions as rows to store: type (unknown if missing) and the distinct accounts, issuer before holders."""
    who = object_versions.select("hash", "issuer_account", "address").groupBy("hash").agg(
        F.array_sort(F.collect_set("issuer_account")).alias("_i"), F.array_sort(F.collect_set("address")).alias("_h")
    )
    return transactions.join(who, "hash").select(
        "hash", "ledger_index", F.coalesce("tx_type", F.lit("unknown")).alias("tx_type"), F.array_distinct(F.concat("_i", "_h")).alias("accounts")
    )
