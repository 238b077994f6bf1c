"""Column expressions of the archive's domain; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ledgerloom.sources.schemas import AMOUNT, META

#: Fixed values of the ledger's protocol.
REQUIRE_AUTH_FLAG = 0x0004
NATIVE_CURRENCY = "XRP"
LONGEST_CURRENCY = 20
HEX_CURRENCY = "^[0-9A-Fa-f]{40}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_meta(meta_json: Column | str) -> Column:
    """The metadata document; null where it is empty or can't be read."""
    return F.from_json(_c(meta_json), META)


def result_code(meta: Column) -> Column:
    return meta["TransactionResult"]


def to_hex(data: Column | str) -> Column:
    return F.upper(F.hex(_c(data)))


def from_hex(text: Column | str) -> Column:
    """The bytes; null where the text isn't pairs of hexadecimal digits."""
    c = _c(text)
    return F.unhex(F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), c))


def currency_readable(code: Column | str) -> Column:
    """Three characters as they are; 40 hexadecimal digits as the text before the first NUL, or as they are if that is empty."""
    c = _c(code)
    inside = F.substring_index(F.decode(F.unhex(F.when(c.rlike(HEX_CURRENCY), c)), "ISO-8859-1"), "\0", 1)
    return F.when(F.length(c) == 3, c).when(c.rlike(HEX_CURRENCY) & (inside != ""), inside).otherwise(c)


def currency_wire(code: Column | str) -> Column:
    """Three characters as they are; longer codes in upper-case hexadecimal, padded with zeros to 40 digits."""
    c = _c(code)
    digits = F.hex(F.encode(c, "UTF-8"))
    return F.when(F.length(c) == 3, c).when(c.rlike(HEX_CURRENCY), F.upper(c)).when(F.length(digits) <= 40, F.rpad(digits, 40, "0"))


def currency_checked(code: Column | str) -> Column:
    """struct(value, error): the trimmed code, or why it can't be registered."""
    c = F.trim(F.coalesce(_c(code), F.lit("")))
    error = (
        F.when(c == "", "currency is empty")
        .when(F.upper(c) == NATIVE_CURRENCY, f"{NATIVE_CURRENCY} is not an issued currency")
        .when((F.length(c) > LONGEST_CURRENCY) & ~c.rlike(HEX_CURRENCY), f"currency is longer than {LONGEST_CURRENCY} characters")
    )
    return F.struct(F.when(error.isNull(), c).alias("value"), error.alias("error"))


def issuance_sequence(mpt_issuance_id: Column | str) -> Column:
    """The sequence number in the first 8 of an issuance id's 48 hexadecimal digits."""
    return F.conv(F.substring(_c(mpt_issuance_id), 1, 8), 16, 10).cast("long")


def issuance_issuer(mpt_issuance_id: Column | str) -> Column:
    """The issuer's account bytes, in hexadecimal."""
    return F.upper(F.substring(_c(mpt_issuance_id), 9, 40))


def integer_amount(text: Column | str) -> Column:
    """An integer token's amount; 0 for what is missing, blank or no integer."""
    t = F.trim(_c(text))
    return F.coalesce(F.when(t.rlike("^-?[0-9]+$"), t).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def integer_text(text: Column | str) -> Column:
    """An integer token's amount as it is spelt, of any length; '0' for what is missing, blank or no integer."""
    t = F.trim(_c(text))
    return F.when(t.rlike("^-?[0-9]+$"), t).otherwise("0")


_NUMBER = r"^([+-]?)([0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE]([+-]?[0-9]{1,4}))?$"


def number_parts(text: Column | str) -> tuple[Column, Column, Column]:
    """(negative, digits, exponent) of a decimal text, with an exponent or without: its value is digits * 10 ** exponent, digits
    have no zeros at either end ('' is zero). All null for what is no number."""
    t = F.trim(_c(text))
    n = F.when(t.rlike(_NUMBER), t)
    body = F.regexp_extract(n, _NUMBER, 2)
    whole = F.replace(body, F.lit("."), F.lit(""))
    shorter = F.regexp_replace(whole, "0+$", "")
    shift = F.when(F.regexp_extract(n, _NUMBER, 3) != "", F.regexp_extract(n, _NUMBER, 3)).try_cast("int")
    exponent = F.coalesce(shift, F.lit(0)) - F.length(F.regexp_extract(body, r"\.([0-9]*)$", 1)) + F.length(whole) - F.length(shorter)
    return n.startswith("-"), F.regexp_replace(shorter, "^0+", ""), F.when(n.isNotNull(), exponent)


def fits_fast_decimal(text: Column | str) -> Column:
    """Whether a decimal text has at most 19 integer and 18 fraction digits, so that AMOUNT keeps every digit, also of a
    difference of two."""
    t = F.trim(_c(text))
    _, digits, exponent = number_parts(text)
    other = (digits == "") | ((exponent >= -18) & (F.length(digits) + exponent <= 19))
    return F.when(t.rlike(r"^-?[0-9]{1,19}(\.[0-9]{1,18})?$"), True).otherwise(F.coalesce(other, F.lit(False)))


def decimal_amount(text: Column | str) -> Column:
    """A decimal token's amount, spelt with an exponent or without. Text that AMOUNT can't hold exactly gives null, never a
    rounded number; functions.exact adds such texts."""
    t = F.trim(_c(text))
    return F.when(fits_fast_decimal(text), t).try_cast(AMOUNT)


def sum_or_null(amount: Column | str) -> Column:
    """The sum of a group's amounts; null, not the sum of the rest, if one of them is unknown."""
    return F.when(F.count_if(_c(amount).isNull()) == 0, F.sum(_c(amount)))


def object_value(balance: Column | str) -> Column:
    """The value of a trust line's balance (a JSON object); null if the balance is a plain string."""
    return F.get_json_object(_c(balance), "$.value")


def plain_text(amount: Column | str) -> Column:
    """Canonical text of a number: no exponent, no trailing zeros."""
    t = _c(amount).cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def holder_sign(holder_is_low: Column) -> Column:
    return F.when(holder_is_low, 1).otherwise(-1)


def negate_text(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), r"^\+", "")
    return F.when(t.rlike(r"^-?[0.]*$"), t).when(t.startswith("-"), F.substring(t, 2, 1 << 30)).otherwise(F.concat(F.lit("-"), t))


def requires_auth(flags: Column | str) -> Column:
    return F.coalesce(_c(flags).bitwiseAND(REQUIRE_AUTH_FLAG) != 0, F.lit(False))


def discovery_strategy(kind: Column, flags: Column, override: Column | None = None) -> Column:
    chosen = F.when(kind == "iou", "trustline").when(requires_auth(flags), "authorization").otherwise("traversal")
    return chosen if override is None else F.coalesce(override, chosen)


def ticker(metadata_hex: Column | str) -> Column:
    """The short name in an issuance's metadata (hexadecimal JSON); null unless it has 1 to 32 characters."""
    m = _c(metadata_hex)
    whole = F.when(m.rlike("^([0-9A-Fa-f]{2})+$"), m)
    t = F.get_json_object(F.decode(F.unhex(whole), "UTF-8"), "$.t")
    return F.when(F.length(t).between(1, 32), t)


def short_label(text: Column | str) -> Column:
    t = _c(text)
    return F.when(F.length(t) > 18, F.concat(F.left(t, F.lit(12)), F.lit("…"), F.right(t, F.lit(4)))).otherwise(t)


def utc_text(time: Column | str) -> Column:
    return F.date_format(_c(time), "yyyy-MM-dd HH:mm:ss")


def page_limit(limit: Column | str, usual: int, most: int, least: int = 1) -> Column:
    """A requested page size, cut to whole numbers within bounds; the usual one if none is given."""
    n = F.coalesce(_c(limit).cast("double"), F.lit(float(usual)))
    return F.least(F.greatest(n, F.lit(float(least))), F.lit(float(most))).cast("long")


def issuance_echo(kind: Column, mpt_issuance_id: Column, currency: Column, issuer: Column) -> Column:
    """How an answer names its issuance: by id, or by currency and issuer."""
    mpt = kind == "mpt"
    return F.struct(
        F.when(mpt, mpt_issuance_id).alias("mpt_issuance_id"),
        F.when(~mpt, currency).alias("currency"),
        F.when(~mpt, issuer).alias("issuer"),
    )


def warnings(beyond: Column | None = None, obligations_only: bool = False) -> Column:
    """Warning ids of an answer: two that always stand, and those for answers beyond coverage or of obligations only."""
    ids = [F.lit(2001), F.lit(65001)]
    if beyond is not None:
        ids.append(F.when(beyond, F.lit(65003)))
    if obligations_only:
        ids.append(F.lit(65004))
    return F.array_compact(F.array(*ids))


def rendered(binary: Column, row: dict[str, Column]) -> Column:
    """An entry as JSON: with binary its hexadecimal blobs, else its parsed documents."""
    common = [row[x].alias(x) for x in ("hash", "ledger_index") if x in row]
    blobs = [row[x].alias(x) for x in ("tx_blob", "meta_blob") if x in row]
    parsed = [row[x].alias(x) for x in ("tx_json", "meta") if x in row]
    return F.when(binary, F.to_json(F.struct(*common, *blobs, F.lit(True).alias("validated")))).otherwise(
        F.to_json(F.struct(*common, *parsed, F.lit(True).alias("validated")))
    )


def sorted_fields(column: Column, kind: DataType) -> Column:
    """A column with the fields of its structs, at every level, in order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*(sorted_fields(column[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.array_sort(F.map_entries(column))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], sorted_fields(e["value"], kind.valueType))))
    return column


def sorted_json(schema: StructType) -> Column:
    """A row as JSON whose keys are in order at every level."""
    fields = sorted(schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)))
