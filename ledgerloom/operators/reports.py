"""Batch reports: a table of requests in, a table of answers out, each with a status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import exact
from ledgerloom.functions import exprs as X
from ledgerloom.functions.session import one_row
from ledgerloom.operators import scope
from ledgerloom.operators.rejects import doubted
from ledgerloom.operators.scope import INVALID, NOT_IN_ARCHIVE, OUT_OF_COVERAGE, status


#: Ledgers of a bucket by which ranges and kept sums are cut.
LEDGERS = 10_000
#: What an answer says when a delta behind it is known to exist but can't be told exactly.
UNREADABLE = "unreadable"
#: Rows of a page at most.
MOST_ROWS = 400


def running_balances(deltas: DataFrame) -> DataFrame:
    """issuance_id, address, ledger_index, balance_text, balance after that ledger (null from the first unknown delta on): the
    as-of table behind many requests."""
    keys, money = ["issuance_id", "address"], exact.Money(deltas)
    read = deltas.withColumn("_x", money.value)
    by_ledger = read.groupBy(*keys, "ledger_index").agg(money.sum("_x").alias("_x"), F.count_if(F.col("_x").isNull()).alias("_n"))
    upto = exact.upto(*keys)
    sums = by_ledger.select(*keys, "ledger_index", money.over("_x", upto).alias("_sum"), F.sum("_n").over(upto).alias("_unknown"))
    return _told(sums, money, "balance").select(*keys, "ledger_index", "balance_text", "balance")


def current_balances(deltas: DataFrame) -> DataFrame:
    """issuance_id, address, balance_text, balance over everything: exact, and as a decimal where that can hold it; both null if
    one of the deltas is unknown."""
    keys, money = ["issuance_id", "address"], exact.Money(deltas)
    sums = deltas.withColumn("_x", money.value).groupBy(*keys).agg(money.sum("_x").alias("_sum"), F.count_if(F.col("_x").isNull()).alias("_unknown"))
    return _told(sums, money, "balance").select(*keys, "balance_text", "balance")


def _told(sums: DataFrame, money: exact.Money, name: str) -> DataFrame:
    """sums (_sum, _unknown) with name_text and name, both null where something is unknown."""
    told = sums.withColumn(f"{name}_text", F.when(F.col("_unknown") == 0, money.text("_sum")))
    return told.withColumn(name, F.when(F.col("_unknown") == 0, money.decimal_of("_sum", f"{name}_text")))


def exact_balances(deltas: DataFrame) -> DataFrame:
    """issuance_id, address, balance as canonical text, from deltas as texts of any scale (nodes.exact_deltas)."""
    return exact.exact_sum(deltas, ["issuance_id", "address"], "delta", "balance")


def sums_at(requests: DataFrame, deltas: DataFrame, keys: list[str]) -> tuple[DataFrame, exact.Money]:
    """requests (keys, ledger and whatever else) with _sum, _unknown: the deltas of the keys up to the ledger, and how many of
    them are unknown (both null where a key or the ledger is); and how _sum is told.

    Deltas are summed by ledger first, so a busy key has one row a ledger; then these and the requests of a key are put in
    order and summed as they pass. A request never meets single deltas."""
    money, rest = exact.Money(deltas), [c for c in requests.columns if c not in (*keys, "ledger")]
    known = " and ".join(f"{k} is not null" for k in (*keys, "ledger"))
    plain = requests.withColumn("ledger", F.col("ledger").cast("long"))
    asked = plain.filter(known).select(*keys, "ledger", F.struct(*rest, F.lit(1).alias("_asks")).alias("_r"))
    by_ledger = deltas.select(*keys, F.col("ledger_index").cast("long").alias("ledger"), money.value.alias("_x")).groupBy(*keys, "ledger").agg(
        money.sum("_x").alias("_x"), F.count_if(F.col("_x").isNull()).alias("_n")
    )
    of_asked = by_ledger.join(asked.select(*keys).distinct(), keys, "left_semi")
    nothing = asked.select(*keys, "ledger", money.none.alias("_x"), F.lit(0).cast("long").alias("_n"), "_r")
    # At one ledger the deltas come before the requests.
    upto = Window.partitionBy(*keys).orderBy("ledger", F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    events = of_asked.withColumn("_r", F.lit(None).cast(asked.schema["_r"].dataType)).unionByName(nothing)
    sums = events.select(*keys, "ledger", "_r", money.over("_x", upto).alias("_sum"), F.sum("_n").over(upto).alias("_unknown"))
    found = sums.filter("_r is not null").select(*keys, "ledger", *(F.col("_r")[c].alias(c) for c in rest), "_sum", "_unknown")
    others = plain.filter(f"not ({known})").withColumns({"_sum": money.none, "_unknown": F.lit(None).cast("long")})
    return found.select(*requests.columns, "_sum", "_unknown").unionByName(others), money


def balance_at(requests: DataFrame, deltas: DataFrame, membership: DataFrame, coverage: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Answers to (request_id, issuance_id, address, ledger): balance (0 without deltas; null where a decimal can't hold it),
    balance_text (exact), status, beyond_coverage. A balance with an unknown delta, or with one of rejects' ledgers up to its own,
    is refused as unreadable."""
    return balance_answers(*sums_at(requests, deltas, ["issuance_id", "address"]), membership, coverage, rejects)


def balance_answers(summed: DataFrame, money: exact.Money, membership: DataFrame, coverage: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """balance_at from requests whose sums are known already (_sum, _unknown; null: no delta)."""
    asked = [c for c in summed.columns if c not in ("_sum", "_unknown")]
    known = scope.flag(doubted(summed, rejects, F.lit(0), F.col("ledger")), membership, ["issuance_id", "address"], "_member")
    ends = coverage.groupBy("address").agg(F.max("to_ledger").alias("_to"))
    answered = known.join(ends, "address", "left")
    state = status(
        (F.col("ledger").isNull(), INVALID), (F.col("issuance_id").isNull() | ~F.col("_member"), NOT_IN_ARCHIVE), ((F.col("_unknown") > 0) | F.col("_doubt"), UNREADABLE)
    )
    told = _told(answered.withColumn("status", state).withColumn("_unknown", F.when(F.col("status") == scope.OK, 0).otherwise(1)), money, "balance")
    beyond = F.coalesce(F.col("ledger") > F.col("_to"), F.lit(True)).alias("beyond_coverage")
    return told.select(*asked, "balance", "status", beyond, "balance_text")


def itemised(requests: DataFrame, deltas: DataFrame) -> DataFrame:
    """Deltas of (request_id, issuance_id, address or null, low, high): request_id, ledger_index, address, hash, delta,
    delta_text.

    Requests for one account meet its deltas only, not all of the issuance; those for all accounts are cut into buckets of
    ledgers and meet only the deltas of these."""
    asked = requests.select("request_id", "issuance_id", F.col("address").alias("_who"), F.coalesce("low", F.lit(0)).cast("long").alias("_low"), F.col("high").cast("long").alias("high"))
    rows = deltas.withColumn("delta_text", exact.Money(deltas).told_text)
    inside = "ledger_index >= _low and (high is null or ledger_index <= high)"
    out = ("request_id", "ledger_index", "address", "hash", "delta", "delta_text")
    bucket = lambda c: F.floor(F.col(c) / LEDGERS).cast("long")
    everyone = asked.filter("_who is null").drop("_who")
    bounded = everyone.filter("high >= _low").withColumn("_bucket", F.explode(F.sequence(bucket("_low"), bucket("high"))))
    for_all = bounded.join(rows.withColumn("_bucket", bucket("ledger_index")), ["issuance_id", "_bucket"]).filter(inside).select(*out)
    open_ended = everyone.filter("high is null").join(rows, "issuance_id").filter(inside).select(*out)
    for_one = asked.filter("_who is not null").withColumnRenamed("_who", "address").join(rows, ["issuance_id", "address"]).filter(inside).select(*out)
    return for_all.unionByName(open_ended).unionByName(for_one)


def itemised_answers(requests: DataFrame, deltas: DataFrame, issuances: DataFrame, membership: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """itemised with a status for every request, in the order of request, ledger, address and hash: its deltas, or one row
    without any. An issuance that isn't tracked or an account that isn't its member is not in the archive; a range that ends
    before it begins is invalid. A delta that is unknown, or a reject in the range, makes the answer unreadable."""
    asked = scope.flag(scope.flag(doubted(requests, rejects, F.col("low"), F.col("high")), issuances, ["issuance_id"], "_tracked"), membership, ["issuance_id", "address"], "_member")
    state = status(
        (F.col("high") < F.coalesce("low", F.lit(0)), INVALID),
        (~F.col("_tracked") | (F.col("address").isNotNull() & ~F.col("_member")), NOT_IN_ARCHIVE),
        (F.col("_doubt"), UNREADABLE),
    )
    asked = asked.withColumn("status", state)
    rows = itemised(asked.filter(F.col("status") == scope.OK), deltas)
    unknown = rows.filter("delta_text is null").select("request_id").distinct().withColumn("_unknown", F.lit(True))
    told = asked.select("request_id", "status").join(unknown, "request_id", "left")
    told = told.select("request_id", F.when(F.col("_unknown"), UNREADABLE).otherwise(F.col("status")).alias("status"), F.coalesce("_unknown", F.lit(False)).alias("_unknown"))
    shown = rows.join(unknown.select("request_id"), "request_id", "left_anti")
    return told.drop("_unknown").join(shown, "request_id", "left").orderBy("request_id", "ledger_index", "address", "hash")


def _lines_of(issuances: DataFrame) -> DataFrame:
    wire = X.currency_wire("currency").alias("currency")
    return issuances.filter("kind = 'iou' and enabled").select("issuance_id", F.col("issuer_account").alias("issuer"), wire)


def _verdicts(
    requests: DataFrame, membership: DataFrame, coverage: DataFrame, issuances: DataFrame, tail_to: int | None, rejects: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(request_id, status) of every request, and request_id, issuer, ledger, hotwallets, issuance_id, currency of the lines of
    those that can be answered."""
    windows = scope.strict_window(membership, coverage, tail_to)
    hot = F.col("hotwallets")
    if isinstance(requests.schema["hotwallets"].dataType, StringType):
        hot = F.when(hot.isNotNull(), F.array(hot))
    asked = doubted(requests.select("request_id", "issuer", "ledger", hot.alias("hotwallets")), rejects, F.lit(0), F.col("ledger")).join(_lines_of(issuances), "issuer", "left").join(windows, "issuance_id", "left")
    inside = F.coalesce((F.col("ledger") >= F.col("from_ledger")) & (F.col("ledger") <= F.col("to_ledger")), F.lit(False))
    # Issuances without members owe nothing and need no coverage.
    fine = F.col("members").isNull() | inside
    verdict = asked.groupBy("request_id").agg(
        F.bool_or(F.col("issuance_id").isNotNull()).alias("_tracked"), F.bool_and(F.col("issuance_id").isNull() | fine).alias("_covered"), F.bool_or(F.col("ledger").isNull()).alias("_odd"),
        F.bool_or("_doubt").alias("_doubt"),
    )
    verdict = verdict.withColumn(
        "status", status((F.col("_odd"), INVALID), (~F.col("_tracked"), NOT_IN_ARCHIVE), (~F.col("_covered"), OUT_OF_COVERAGE), (F.col("_doubt"), UNREADABLE))
    )
    good = asked.join(verdict.filter(F.col("status") == scope.OK).select("request_id"), "request_id", "left_semi")
    lines = good.filter("issuance_id is not null").select("request_id", "issuer", "ledger", "hotwallets", "issuance_id", "currency")
    return verdict.select("request_id", "status"), lines


def _owed(
    requests: DataFrame, deltas: DataFrame, membership: DataFrame, coverage: DataFrame, issuances: DataFrame, tail_to: int | None, rejects: DataFrame | None
) -> DataFrame:
    """request_id, status of every request, with _rows: currency, address (null: all but the issuer and the hot wallets),
    amount_text, amount, hot of those that can be answered, as many as the request has lines and hot wallets for them.

    Sums are linear: what an issuance owes is the sum of all its deltas up to the ledger less the balances of the issuer and the
    hot wallets. So a request meets one sum by ledger of the issuance and those of a few accounts, never its holders."""
    verdict, lines = _verdicts(requests, membership, coverage, issuances, tail_to, rejects)
    apart = lines.select(
        "request_id", "issuer", "ledger", "issuance_id", "currency", F.explode(F.array_distinct(F.array_append(F.array_compact(F.coalesce("hotwallets", F.array())), F.col("issuer")))).alias("address")
    )
    whole, money = sums_at(lines.drop("hotwallets"), deltas, ["issuance_id"])
    own, _ = sums_at(apart, deltas, ["issuance_id", "address"])
    none = F.lit(None).cast("string")
    parts = whole.withColumn("address", none).unionByName(own).withColumn("_whole", F.col("address").isNull())
    # An unknown delta of anyone but the issuer makes the whole answer unreadable.
    weight = F.when(F.col("_whole"), F.col("_unknown")).when(F.col("address") == F.col("issuer"), -F.col("_unknown")).otherwise(0)
    sides = {"_all": F.when(F.col("_whole"), F.col("_sum")), "_apart": F.when(~F.col("_whole"), F.col("_sum"))}
    hot = F.collect_list(F.when(~F.col("_whole") & (F.col("address") != F.col("issuer")), F.struct("address", F.col("_sum").alias("s"))))  # the hot wallets that one request names
    by_line = parts.withColumns(sides | {"_weight": weight}).groupBy("request_id", "issuance_id", "currency").agg(
        money.sum("_all").alias("_all"), money.sum("_apart").alias("_apart"), F.sum("_weight").alias("_weight"), hot.alias("_hot")
    )
    left = by_line.select("request_id", "currency", "_weight", money.plus("_all", "_apart", -1).alias("_sum"), "_hot")
    told = left.withColumn("_bad", F.max(F.when(F.col("_weight") > 0, 1).otherwise(0)).over(Window.partitionBy("request_id")))
    wide = left.schema["_sum"].dataType
    one = lambda address, total, is_hot: F.struct(address.alias("address"), total.cast(wide).alias("s"), F.lit(is_hot).alias("hot"))
    entries = F.concat(F.array(one(none, F.col("_sum"), False)), F.transform("_hot", lambda h: one(h["address"], h["s"], True)))
    rows = told.select("request_id", "currency", "_bad", F.explode(entries).alias("e")).select("request_id", "currency", "_bad", "e.address", "e.hot", F.col("e.s").alias("_sum"))
    rows = _told(rows.withColumn("_unknown", F.col("_bad")), money, "amount").filter("_bad = 1 or amount_text <> '0'")
    by_request = rows.groupBy("request_id").agg(F.max("_bad").alias("_bad"), F.collect_list(F.struct("currency", "address", "amount_text", "amount", "hot")).alias("_rows"))
    answers = verdict.join(by_request, "request_id", "left")
    state = F.when(F.col("_bad") == 1, UNREADABLE).otherwise(F.col("status"))
    return answers.select("request_id", state.alias("status"), F.when(F.coalesce("_bad", F.lit(0)) == 0, F.col("_rows")).alias("_rows"))


def _shown(answers: DataFrame, wanted: Callable[[Column], Column], *columns: Column) -> DataFrame:
    """The entries of answers that are wanted, or one row without any."""
    held = answers.select("request_id", "status", F.explode_outer(F.filter(F.coalesce("_rows", F.array()), wanted)).alias("e"))
    return held.select("request_id", "status", *columns)


def obligations(
    requests: DataFrame, deltas: DataFrame, membership: DataFrame, coverage: DataFrame, issuances: DataFrame, tail_to: int | None = None, rejects: DataFrame | None = None
) -> DataFrame:
    """What issuers owe, for (request_id, issuer, ledger, hotwallets: a list or one address): one row for each request and
    currency (wire form) with a total other than zero, or one row with a status if the request can't be answered: request_id,
    status, currency, obligation_text (exact), obligation (a decimal, null where that can't hold it).

    The issuer's own balance and those of hot wallets are left out of the totals; all enabled currencies of the issuer must be
    covered at the ledger, else the whole answer is refused; so is one with a reject up to its ledger."""
    answers = _owed(requests, deltas, membership, coverage, issuances, tail_to, rejects)
    e = F.col("e")
    return _shown(answers, lambda x: ~x["hot"], e["currency"].alias("currency"), e["amount_text"].alias("obligation_text"), e["amount"].alias("obligation"))


def gateway_balances(
    requests: DataFrame, deltas: DataFrame, membership: DataFrame, coverage: DataFrame, issuances: DataFrame, tail_to: int | None = None, rejects: DataFrame | None = None
) -> DataFrame:
    """obligations and the balances of hot wallets in one answer under one refusal: request_id, status, address (null: the
    obligation to all others), currency, amount_text, amount, in order."""
    answers = _owed(requests, deltas, membership, coverage, issuances, tail_to, rejects)
    shown = _shown(answers, lambda _: F.lit(True), *(F.col("e")[c].alias(c) for c in ("address", "currency", "amount_text", "amount")))
    return shown.orderBy("request_id", "address", "currency")


def hot_wallet_balances(requests: DataFrame, deltas: DataFrame, issuances: DataFrame) -> DataFrame:
    """request_id, address, currency, balance_text, balance (not zero) of the hot wallets that requests name; null where a delta
    is unknown."""
    asked = requests.select("request_id", "issuer", "ledger", F.explode("hotwallets").alias("address")).distinct().join(_lines_of(issuances), "issuer")
    told = _told(*sums_at(asked, deltas, ["issuance_id", "address"]), "balance")
    return told.filter("balance_text is null or balance_text <> '0'").select("request_id", "address", "currency", "balance_text", "balance")


def account_history(requests: DataFrame, links: DataFrame, transactions: DataFrame, coverage: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pages of account history for (request_id, address, low, high, forward, limit, marker 'ledger:hash').

    With coverage the range is the request's within the covered one; negative bounds mean none; a marker that can't be read
    starts from the beginning. Answers: request_id, status, out_of_range, then hash, ledger_index, tx_type, rank, marker."""
    return history_pages(history_requests(requests, coverage, accounts), links, transactions)


def history_requests(requests: DataFrame, coverage: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests for history with their status, the range to answer for (_low, _high), _limit and the marker (_at, _after)."""
    own = scope.envelope(coverage).select("address", F.col("from_ledger").alias("_from"), F.col("to_ledger").alias("_to"))
    asked = scope.flag(requests, accounts, ["address"], "_known").join(own, "address", "left")
    bound = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return asked.withColumns(
        {
            "_low": F.greatest(bound("low"), F.col("_from")),
            "_high": F.least(bound("high"), F.col("_to")),
            "_limit": X.page_limit("limit", 200, MOST_ROWS),
            "_at": F.when(F.col("marker").rlike("^[0-9]{1,15}:.+$"), F.substring_index("marker", ":", 1)).cast("long"),
            "_after": F.substring_index("marker", ":", -1),
            "out_of_range": scope.beyond(bound("low"), bound("high"), F.col("_from"), F.col("_to")),
            "status": status((~F.col("_known"), NOT_IN_ARCHIVE)),
        }
    )


def history_pages(asked: DataFrame, links: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """The pages of history_requests, from links and transactions, or from links with (ledger_index, tx_type)."""
    rows = asked.filter(F.col("status") == scope.OK).join(links, "address")
    if transactions is not None:
        rows = rows.join(transactions.select("hash", "ledger_index", "tx_type"), "hash")
    rows = rows.filter("(_low is null or ledger_index >= _low) and (_high is null or ledger_index <= _high)")
    position, marker = F.struct("ledger_index", "hash"), F.struct(F.col("_at").alias("ledger_index"), F.col("_after").alias("hash"))
    rows = rows.filter(F.col("_at").isNull() | F.when(F.col("forward"), position > marker).otherwise(position < marker))
    # The greatest page bounds every ranking, so a task ranks no more of a busy account's rows than that.
    ranked = None
    for side, order in (("forward", ("ledger_index", "hash")), ("not forward", (F.desc("ledger_index"), F.desc("hash")))):
        part = rows.filter(side).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).filter(F.col("rank") <= MOST_ROWS + 1)
        ranked = part if ranked is None else ranked.unionByName(part)
    pages = ranked.withColumn("_n", F.max("rank").over(Window.partitionBy("request_id"))).filter("rank <= _limit").select(
        "request_id", "hash", "ledger_index", "tx_type", "rank",
        F.when((F.col("rank") == F.col("_limit")) & (F.col("_n") > F.col("_limit")), F.concat_ws(":", "ledger_index", "hash")).alias("next_marker"),
    )
    return asked.select("request_id", "status", "out_of_range").join(pages, "request_id", "left")


def transactions_by_hash(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """Answers to (request_id, hash)."""
    found = requests.join(transactions, "hash", "left")
    return found.withColumn("status", status((F.col("hash").isNull(), INVALID), (F.col("ledger_index").isNull(), NOT_IN_ARCHIVE)))


def holder_limit() -> Column:
    """Rows of a page of holders."""
    return X.page_limit("limit", 50, MOST_ROWS)


def holder_pages(requests: DataFrame, holders: DataFrame) -> DataFrame:
    """Pages of holders by object id for (request_id, issuance_id, as_of_ledger, limit, marker)."""
    asked = requests.withColumn("_limit", holder_limit())
    rows = asked.join(holders, ["issuance_id", "as_of_ledger"]).filter(F.col("marker").isNull() | (F.col("object_id") > F.col("marker")))
    order = Window.partitionBy("request_id").orderBy("object_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST_ROWS + 1)
    return ranked.withColumn("_n", F.max("rank").over(Window.partitionBy("request_id"))).filter("rank <= _limit").select(
        "request_id", "issuance_id", "as_of_ledger", "object_id", "address", "amount", "flags", "rank",
        F.when((F.col("rank") == F.col("_limit")) & (F.col("_n") > F.col("_limit")), F.col("object_id")).alias("next_marker"),
    )


def holder_answers(requests: DataFrame, holders: DataFrame, issuances: DataFrame, latest: int, rejects: DataFrame | None = None) -> DataFrame:
    """holder_pages with a status for every request: its page, or one row without holders. What isn't tracked is not in the
    archive, a ledger beyond the latest one out of coverage; with a reject up to its ledger the answer is unreadable."""
    asked = scope.flag(doubted(requests, rejects, F.lit(0), F.col("as_of_ledger")), issuances.filter("kind = 'mpt'"), ["issuance_id"], "_tracked")
    state = status((F.col("as_of_ledger").isNull(), INVALID), (~F.col("_tracked"), NOT_IN_ARCHIVE), (F.col("as_of_ledger") > latest, OUT_OF_COVERAGE), (F.col("_doubt"), UNREADABLE))
    asked = asked.withColumn("status", state)
    pages = holder_pages(asked.filter(F.col("status") == scope.OK).select(*requests.columns), holders).drop("issuance_id", "as_of_ledger")
    return asked.select("request_id", "issuance_id", "as_of_ledger", "status").join(pages, "request_id", "left")


def recent_activity(transactions: DataFrame, deltas: DataFrame, issuances: DataFrame, ledgers: DataFrame, k: int = 10) -> DataFrame:
    """The k newest transactions (ledger descending, hash ascending) with the labels of the issuances that they move or, where
    transactions has an mpt_issuance_id, name themselves. Other columns of transactions, such as a result, are kept."""
    top = transactions.orderBy(F.desc("ledger_index"), "hash").limit(k)
    label = F.coalesce("currency", "mpt_issuance_id")
    meant = top.select("hash").join(deltas.select("hash", "issuance_id").distinct(), "hash")
    if "mpt_issuance_id" in transactions.columns:
        ids = issuances.filter("kind = 'mpt'").select(F.upper("mpt_issuance_id").alias("_m"), "issuance_id")
        meant = meant.union(top.select("hash", F.upper("mpt_issuance_id").alias("_m")).join(ids, "_m").select("hash", "issuance_id"))
    touched = (
        meant.join(issuances.select("issuance_id", X.short_label(label).alias("label")), "issuance_id")
        .groupBy("hash")
        .agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    )
    times = ledgers.groupBy("ledger_index").agg(F.min("close_time").alias("close_time"))
    return top.join(touched, "hash", "left").join(times, "ledger_index", "left")


def issuance_stats(deltas: DataFrame) -> DataFrame:
    """issuance_id, transactions, first and last ledger."""
    return deltas.groupBy("issuance_id").agg(
        F.count_distinct("hash").alias("transactions"), F.min("ledger_index").alias("first_ledger"), F.max("ledger_index").alias("last_ledger")
    )


def issuance_status(issuances: DataFrame, membership: DataFrame, deltas: DataFrame, coverage: DataFrame, jobs: DataFrame, runs: DataFrame, tail_to: int | None = None) -> DataFrame:
    """All issuances with members, statistics, job progress and counts, the covered window and the last reconciliation."""
    members = membership.select("issuance_id", "address").distinct().groupBy("issuance_id").agg(F.count("*").alias("members"))
    window = scope.status_window(membership, coverage, tail_to).withColumnsRenamed({"from_ledger": "covered_from", "to_ledger": "covered_to"})
    out = issuances
    for part in (members, issuance_stats(deltas), window, progress(jobs), job_counts(jobs), latest_runs(runs)):
        out = out.join(part, "issuance_id", "left")
    return out.fillna(0, ["members", "transactions", "pending", "running", "done", "failed", "fetched"])


def job_counts(jobs: DataFrame) -> DataFrame:
    """issuance_id, jobs by status, transactions fetched."""
    by = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "failed")}
    return jobs.groupBy("issuance_id").agg(*by.values(), F.sum("tx_count").alias("fetched"))


def progress(jobs: DataFrame) -> DataFrame:
    """issuance_id, done and total jobs of the issuances that still have pending or running ones."""
    counted = jobs.groupBy("issuance_id").agg(
        F.count_if(F.col("status").isin("pending", "running")).alias("_open"),
        F.count_if(F.col("status") == "done").alias("jobs_done"),
        F.count("*").alias("jobs_total"),
    )
    return counted.filter("_open > 0").drop("_open")


def latest_runs(runs: DataFrame) -> DataFrame:
    """issuance_id with the newest reconciliation run (ran_at, then id)."""
    return runs.groupBy("issuance_id").agg(F.max_by(F.struct("passed", "discrepancies"), F.struct("ran_at", "run_id")).alias("_r")).select(
        "issuance_id", F.col("_r.passed").alias("reconciled"), F.col("_r.discrepancies").alias("discrepancies")
    )


def scope_summary(issuances: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: how many issuances are tracked and the span of all coverage."""
    return one_row(
        issuances.agg(F.count("*").alias("issuances"), F.count_if("enabled").alias("enabled")),
        coverage.agg(F.min("from_ledger").alias("from_ledger"), F.max("to_ledger").alias("to_ledger")),
    )


def scope_listing(issuances: DataFrame, coverage: DataFrame) -> DataFrame:
    """All tracked issuances, in order of their ids, each with the span of all coverage."""
    span = coverage.agg(F.min("from_ledger").alias("from_ledger"), F.max("to_ledger").alias("to_ledger"))
    values = {c: span.select(c).scalar() for c in ("from_ledger", "to_ledger")}
    return issuances.withColumns(values).orderBy("issuance_id")


def table_counts(issuances: DataFrame, membership: DataFrame, deltas: DataFrame, transactions: DataFrame, ledgers: DataFrame) -> DataFrame:
    """issuance_id, members, deltas of every issuance, with the row counts of the transactions and of the calendar."""
    members = membership.select("issuance_id", "address").distinct().groupBy("issuance_id").agg(F.count("*").alias("members"))
    moved = deltas.groupBy("issuance_id").agg(F.count("*").alias("deltas"))
    rows = one_row(transactions.agg(F.count("*").alias("transactions")), ledgers.agg(F.count("*").alias("ledgers")))
    counted = issuances.select("issuance_id").join(members, "issuance_id", "left").join(moved, "issuance_id", "left").fillna(0)
    return counted.withColumns({c: rows.select(c).scalar() for c in ("transactions", "ledgers")})


def sample(membership: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """At most limit (1 to 1000) members of each issuance in the order of a hash: random, but the same on every run."""
    n = min(max(int(limit), 1), 1000)
    order = Window.partitionBy("issuance_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "address")), "address")
    return membership.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def request_log(log: DataFrame, keys: list[str], latency: str, code: str, ok: Column, seconds: Column) -> DataFrame:
    """Summary of a request log by keys: sent, ok, error_rate, throughput, nearest-rank percentiles, max, counts by code.

    Percentiles are exact: each latency's rank comes from counts of equal latencies, so a hot group is pre-aggregated."""
    counts = log.groupBy(*keys, latency).agg(F.count("*").alias("_n"), F.count_if(ok).alias("_ok"))
    upto = Window.partitionBy(*keys).orderBy(latency).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * F.col("_all") / 100), F.col(latency))).alias(f"p{p}")
    main = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("sent"), F.sum("_ok").alias("ok"), at(50), at(95), at(99), F.max(latency).alias("longest")
    ).withColumn("error_rate", 1 - F.col("ok") / F.col("sent"))
    codes = log.groupBy(*keys, code).count().groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "count")))).alias("codes"))
    spans = log.groupBy(*keys).agg((F.max(seconds) - F.min(seconds)).alias("_s"))
    return main.join(codes, keys).join(spans, keys).withColumn("throughput", F.when(F.col("_s") > 0, F.col("ok") / F.col("_s"))).drop("_s")


def job_summary(jobs: DataFrame) -> DataFrame:
    """kind, status, jobs, fetched: how far backfill has come."""
    return jobs.groupBy("kind", "status").agg(F.count("*").alias("jobs"), F.sum("tx_count").alias("fetched"))
