"""Exact amounts of any scale, in built-in functions.

An amount is a struct of LIMBS decimals, its limbs: limb k has the digits at the places LOWEST + 28 k to LOWEST + 28 k + 27 of
the decimal point, with the amount's sign, and is null where there are none, so most amounts fill two of them. Limbs are summed
each on its own: ten digits are left for carries, enough for 10 ** 10 summands. Carries are settled only where a sum becomes a
text again. All amounts of 1 to 40 digits and exponents of -96 to 80 fit, wherever their point is; what doesn't, or is no number, is null, and whoever
adds it up is told (Money.value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType
from pyspark.sql.window import WindowSpec

from ledgerloom.sources.schemas import AMOUNT

DIGITS, LIMBS, LOWEST = 28, 10, -140
FIELDS = tuple(f"l{k}" for k in range(LIMBS))
_WIDE = f"decimal({DIGITS + 10},0)"
#: The limbs of the digits just before and just behind the point.
_UNITS, _BEHIND = -LOWEST // DIGITS, -LOWEST // DIGITS - 1


#: What a Spark user would nest as functions is spelt as SQL here: one expression is parsed at once, where hundreds of columns
#: would be built one by one.
_NUMBER = r"^([+-]?)([0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE]([+-]?[0-9]{1,4}))?$"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body, with value under a name, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _apply(value: Column, name: str, body: str) -> Column:
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}"))[0]


#: Of a text t: struct(negative, digits, e): its value is digits * 10 ** e, digits have no zeros at either end; null for no number.
_PARTS = _let(
    "s", "trim(t)",
    f"if(s rlike r'{_NUMBER}', "
    + _let(
        "b", f"struct(regexp_extract(s, r'{_NUMBER}', 2) AS body, try_cast(nullif(regexp_extract(s, r'{_NUMBER}', 3), '') AS int) AS shift)",
        _let(
            "w", "struct(replace(b.body, '.', '') AS whole, regexp_replace(replace(b.body, '.', ''), '0+$', '') AS short)",
            r"named_struct('negative', startswith(s, '-'), 'digits', regexp_replace(w.short, '^0+', ''), "
            r"'e', coalesce(b.shift, 0) - length(regexp_extract(b.body, r'\.([0-9]*)$', 1)) + length(w.whole) - length(w.short))",
        ),
    )
    + ", null)",
)


def _limb(k: int) -> str:
    # The digit at index i from the left stands at the place e + n - 1 - i.
    place = LOWEST + DIGITS * k
    start, stop = f"greatest(0, q.e + q.n - {place} - {DIGITS})", f"least(q.n, q.e + q.n - {place})"
    part = f"concat(q.sign, substring(q.digits, {start} + 1, {stop} - {start}), repeat('0', greatest(0, q.e - {place})))"
    return f"if({stop} > {start}, cast({part} AS {_WIDE}), null) AS {FIELDS[k]}"


_LIMBS_OF = _let(
    "p", _PARTS,
    f"if(p.digits = '' or (p.e >= {LOWEST} and length(p.digits) + p.e <= {LOWEST + DIGITS * LIMBS}), "
    + _let("q", "struct(p.digits AS digits, p.e AS e, length(p.digits) AS n, if(p.negative, '-', '') AS sign)", f"struct({', '.join(map(_limb, range(LIMBS)))})")
    + ", null)",
)


def _plain() -> str:
    """The limbs of a text without exponent whose digits lie in the two limbs around the point."""
    sign = "if(startswith(t, '-'), '-', '')"
    own = {_UNITS: "substring_index(t, '.', 1)", _BEHIND: f"concat({sign}, rpad(if(instr(t, '.') > 0, substring_index(t, '.', -1), '0'), {DIGITS}, '0'))"}
    return "struct(" + ", ".join(f"cast({own.get(k, 'null')} AS {_WIDE}) AS {f}" for k, f in enumerate(FIELDS)) + ")"


#: Most texts are plain ones.
_READ = f"if(t rlike r'^-?[0-9]{{1,{DIGITS}}}([.][0-9]{{1,{DIGITS}}})?$', {_plain()}, {_LIMBS_OF})"


def number(text: Column | str) -> Column:
    """The limbs of a decimal text, spelt with an exponent or without."""
    return _apply(F.col(text) if isinstance(text, str) else text, "t", _READ)


#: Amounts of up to nine digits before the point and 18 behind it, which Spark's decimals sum exactly (ten digits are left for carries).
QUICK = 1_000_000_000


def quick(amount: Column | str) -> Column:
    """Whether an amount of decimal() is there and short enough to be summed as it is."""
    return F.coalesce(F.abs(F.col(amount) if isinstance(amount, str) else amount) < F.lit(QUICK), F.lit(False))


def short_text(total: Column) -> Column:
    """Canonical text of a decimal with 18 places."""
    plain = F.rtrim(F.rtrim(total.cast("string"), F.lit("0")), F.lit("."))
    return F.when(total == 0, "0").otherwise(plain)


_ZERO = f"cast(0 AS {_WIDE})"
_MINUS = "struct(" + ", ".join(f"if(p.a.{f} is null and p.b.{f} is null, null, cast(coalesce(p.a.{f}, {_ZERO}) - coalesce(p.b.{f}, {_ZERO}) AS {_WIDE})) AS {f}" for f in FIELDS) + ")"


def minus(a: Column, b: Column) -> Column:
    """a - b; null limbs, and null as a whole, count as nothing."""
    return _apply(F.struct(a.alias("a"), b.alias("b")), "p", _MINUS)


def _spelt(negative: str, whole: str, behind: str) -> str:
    body = "concat(if({n}, '-', ''), if(y.w = '', '0', y.w), if(y.f = '', '', concat('.', y.f)))".format(n=negative)
    return _let("y", f"struct(regexp_replace({whole}, '^0+', '') AS w, regexp_replace({behind}, '0+$', '') AS f)", body)


def _full() -> str:
    """Carries settled from the lowest limb up, then all limbs made positive and borrows settled."""
    carry = _let(
        "v", f"cast(l + acc.carry AS {_WIDE})",
        _let(
            "d", f"struct(if(v < 0, '-', '') AS sign, lpad(ltrim('-', cast(v AS string)), {DIGITS + 10}, '0') AS s)",
            f"named_struct('carry', cast(concat(d.sign, left(d.s, 10)) AS {_WIDE}), 'out', array_append(acc.out, cast(concat(d.sign, right(d.s, {DIGITS})) AS {_WIDE})))",
        ),
    )
    limbs = f"array({', '.join(f'coalesce(x.{f}, {_ZERO})' for f in FIELDS)})"
    carried = f"aggregate({limbs}, named_struct('carry', {_ZERO}, 'out', cast(array() AS array<{_WIDE}>)), (acc, l) -> {carry}, acc -> array_append(acc.out, acc.carry))"
    sign = "aggregate(c, 0, (g, u) -> if(u < 0, -1, if(u > 0, 1, g)))"
    borrow = _let(
        "v", f"cast(l - acc.borrow AS {_WIDE})",
        f"named_struct('borrow', if(v < 0, cast(1 AS {_WIDE}), {_ZERO}), "
        f"'out', concat(lpad(cast(cast(if(v < 0, v + cast('1{'0' * DIGITS}' AS {_WIDE}), v) AS {_WIDE}) AS string), {DIGITS}, '0'), acc.out))",
    )
    digits = f"aggregate(transform(z.limbs, u -> if(z.sign < 0, cast(-u AS {_WIDE}), u)), named_struct('borrow', {_ZERO}, 'out', ''), (acc, l) -> {borrow}, acc -> acc.out)"
    told = _let("o", digits, _spelt("z.sign < 0", f"left(o, length(o) - {-LOWEST})", f"right(o, {-LOWEST})"))
    return _let("c", carried, _let("z", f"struct(c AS limbs, {sign} AS sign)", told))


def _quick() -> tuple[str, str]:
    """When one decimal holds an amount (up to nine digits before the point, none beyond the limb behind it), and its text."""
    others = ", ".join(f"x.{f}" for k, f in enumerate(FIELDS) if k not in (_UNITS, _BEHIND))
    units, behind = f"coalesce(x.{FIELDS[_UNITS]}, {_ZERO})", f"coalesce(x.{FIELDS[_BEHIND]}, {_ZERO})"
    short = f"coalesce({others}) is null and abs({units}) < 1000000000 and abs({behind}) < cast('1{'0' * DIGITS}' AS {_WIDE})"
    one = f"cast(cast(concat(cast({units} AS string), '{'0' * DIGITS}') AS {_WIDE}) + {behind} AS {_WIDE})"
    told = _let("s", f"lpad(ltrim('-', cast(v AS string)), {DIGITS + 10}, '0')", _spelt("v < 0", "left(s, 10)", f"right(s, {DIGITS})"))
    return short, _let("v", one, told)


_SHORT, _QUICK = _quick()
_TEXT = f"if(x is null, null, if({_SHORT}, {_QUICK}, {_full()}))"


def text(x: Column) -> Column:
    """Canonical text: no exponent, no zeros at either end; of null limbs '0', of null null."""
    return _apply(x, "x", _TEXT)


#: Texts that lack of their canonical form only that zeros end them; a name's are trimmed without the higher-order function.
_TRIMMED = r"^-?(0|[1-9][0-9]{0,27})([.][0-9]{1,28})?$"
_TRIM = "if(instr(t, '.') > 0, rtrim('.', rtrim('0', t)), t)"
_CANONICAL = f"if(t rlike r'{_TRIMMED}', if({_TRIM} = '-0', '0', {_TRIM}), {_let('x', _READ, _TEXT)})"


def canonical(told: Column | str) -> Column:
    """A decimal text in canonical form; null for what is no number or out of range."""
    if not isinstance(told, str):
        return _apply(told, "t", _CANONICAL)
    t = F.col(told)
    plain = F.when(t.contains("."), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)
    return F.when(t.rlike(_TRIMMED), F.when(plain == "-0", "0").otherwise(plain)).otherwise(text(number(t)))


#: Texts that a cast reads exactly; a name is looked at without the higher-order function.
_CAST = r"^-?[0-9]{1,19}((\.[0-9]{1,18})?|[eE]-([0-9]|1[0-8]))$"
_DECIMAL = (
    f"if(t rlike r'{_CAST}', try_cast(t AS {AMOUNT}), "
    + _let("p", _PARTS, f"if(p.digits = '' or (p.e >= -18 and length(p.digits) + p.e <= 19), try_cast(trim(t) AS {AMOUNT}), null)")
    + ")"
)


def decimal(told: Column | str) -> Column:
    """A decimal text as AMOUNT, null where that can't hold it exactly."""
    if not isinstance(told, str):
        return _apply(told, "t", _DECIMAL)
    t = F.col(told)
    return F.when(t.rlike(_CAST), t.try_cast(AMOUNT)).otherwise(_apply(t, "t", _DECIMAL))


class Money:
    """How the amounts of a table are added up, and told again.

    A decimal column of up to 28 digits is summed as it is (Spark's sum has ten digits more). Any other, and a column whose exact
    texts stand beside it as <name>_text, is summed in limbs."""

    def __init__(self, rows: DataFrame, amount: str = "delta"):
        kind, names = rows.schema[amount].dataType, rows.columns
        self.amount, self.told = amount, f"{amount}_text" if f"{amount}_text" in names else None
        narrow = isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.precision <= DIGITS and kind.scale <= 18
        self.plain = narrow and self.told is None
        self.scale = kind.scale if isinstance(kind, DecimalType) else 0

    @property
    def value(self) -> Column:
        """A row's summable amount; null if it isn't known."""
        if self.plain:
            return F.col(self.amount).cast(f"decimal({DIGITS},{self.scale})")
        return number(F.coalesce(self.told, F.col(self.amount).cast("string")) if self.told else F.col(self.amount).cast("string"))

    @property
    def told_text(self) -> Column:
        """A row's amount as canonical text; null if it isn't known."""
        if self.told:  # as value: a known amount counts where its text isn't there
            return F.coalesce(F.col(self.told), canonical(F.col(self.amount).cast("string")))
        return F.when(F.col(self.amount).isNotNull(), self.text(F.col(self.amount))) if self.plain else canonical(F.col(self.amount).cast("string"))

    def sum(self, value: str) -> Column:
        return F.sum(value) if self.plain else F.struct(*(F.sum(f"{value}.{f}").alias(f) for f in FIELDS))

    def over(self, value: str, window: WindowSpec) -> Column:
        return F.sum(value).over(window) if self.plain else F.struct(*(F.sum(f"{value}.{f}").over(window).alias(f) for f in FIELDS))

    @property
    def none(self) -> Column:
        """The sum of nothing."""
        return F.lit(None).cast(f"decimal({DIGITS},{self.scale})") if self.plain else F.struct(*(F.lit(None).cast(_WIDE).alias(f) for f in FIELDS))

    def plus(self, a: str, b: str, sign: int = 1) -> Column:
        """a + b (sign -1: a - b) of two sums; null counts as nothing."""
        if self.plain:
            wide = f"decimal(38,{self.scale})"
            a_, b_ = (F.coalesce(F.col(c).cast(wide), F.lit(0).cast(wide)) for c in (a, b))
            return (a_ + b_ if sign > 0 else a_ - b_).cast(wide)
        zero, a_, b_ = F.lit(0).cast(_WIDE), F.col(a), F.col(b)
        both = lambda x, y: (x + y if sign > 0 else x - y).cast(_WIDE)
        return F.struct(*(F.when(a_[f].isNotNull() | b_[f].isNotNull(), both(F.coalesce(a_[f], zero), F.coalesce(b_[f], zero))).alias(f) for f in FIELDS))

    def text(self, total: str | Column) -> Column:
        total = F.col(total) if isinstance(total, str) else total
        if not self.plain:
            return F.coalesce(text(total), F.lit("0"))
        return self._plain_text(total)

    def _plain_text(self, total: Column) -> Column:
        plain = F.coalesce(total, F.lit(0).cast(f"decimal(38,{self.scale})")).cast("string")
        return canonical(plain) if self.scale > 6 else F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)

    def decimal(self, told: str) -> Column:
        """The column of a text of text() as AMOUNT."""
        return decimal(told)

    def decimal_of(self, total: str, told: str) -> Column:
        """AMOUNT of a sum whose text is known too; a plain sum needn't be read from it."""
        if not self.plain:
            return decimal(told)
        c = F.coalesce(F.col(total), F.lit(0).cast(f"decimal(38,{self.scale})"))
        return F.when(F.abs(c) < F.lit("1" + "0" * 19).cast("decimal(20,0)"), c).try_cast(AMOUNT)


def _apart(c: Column) -> Column:
    """c, in a way that keeps its step out of the method that the steps around it are fused to: over 8000 bytes the JVM doesn't
    compile it."""
    return F.transform(F.array(c), lambda x: x)[0]


def parsed(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """rows with <name>_d, <name>_e, <name>_s of each text: its value is s d * 10 ** e (s: '-' or nothing; d has no zeros at either
    end, '' is zero; all null for what is no number or out of range, and for null).

    As number() reads it, but in plain steps that are compiled, since functions of arrays aren't: a step names what the last one
    worked out."""
    x = lambda told: {f"{n}{to}": F.expr(sql.replace("#", n)) for n in texts for to, sql in told.items()}
    rows = rows.withColumns({f"{n}_t": _apart(F.lower(F.trim(t))) for n, t in texts.items()})
    rows = rows.withColumns(x({"_b": f"nullif(regexp_extract(#_t, r'{_NUMBER}', 2), '')", "_x": "if(instr(#_t, 'e') > 0, try_cast(substring_index(#_t, 'e', -1) AS int), 0)"}))
    rows = rows.withColumns(x({"_w": "replace(#_b, '.', '')", "_f": "if(instr(#_b, '.') > 0, length(#_b) - instr(#_b, '.'), 0)"}))
    rows = rows.withColumns(x({"_r": "rtrim('0', #_w)"}))
    rows = rows.withColumns(x({"_d": "ltrim('0', #_r)", "_e": "if(#_r = '', 0, #_x - #_f + length(#_w) - length(#_r))", "_s": "if(startswith(#_t, '-'), '-', '')"}))
    fits = f"#_d = '' or (#_e >= {LOWEST} and length(#_d) + #_e <= {LOWEST + DIGITS * LIMBS})"
    rows = rows.withColumns(x({"_fit": fits}))
    rows = rows.withColumns({n: _apart(c) if n.endswith("_s") else c for n, c in x({c: f"if(#_fit, #{c}, null)" for c in ("_d", "_e", "_s")}).items()})
    return rows.drop(*(f"{n}{c}" for n in texts for c in ("_t", "_b", "_x", "_w", "_f", "_r", "_fit")))


def short(name: str) -> Column:
    """Whether a text that parsed() has read is quick()."""
    return F.expr(f"coalesce({name}_d = '' or ({name}_e >= -18 and length({name}_d) + {name}_e <= 9), false)")


def _told(rows: DataFrame, value: str, place: str, out: str) -> DataFrame:
    """rows with the canonical text of value * 10 ** place (a whole decimal, an int), in compiled steps; null of null."""
    # abs and the minus sign round a decimal to 34 digits.
    rows = rows.withColumn("_n", F.expr(f"ltrim('-', cast({value} AS string))"))
    rows = rows.withColumn("_n", F.expr(f"if({place} >= 0, concat(_n, repeat('0', {place})), lpad(_n, greatest(length(_n), 1 - {place}), '0'))"))
    rows = rows.withColumns({"_f": F.expr(f"if({place} >= 0, '', rtrim('0', right(_n, -{place})))"), "_n": F.expr(f"if({place} >= 0, _n, left(_n, length(_n) + {place}))")})
    sign = F.when(F.col(value) < 0, "-").otherwise("")
    text = F.when(F.col(value) == 0, "0").otherwise(F.concat(sign, "_n", F.when(F.col("_f") == "", "").otherwise(F.concat(F.lit("."), "_f"))))
    return rows.withColumn(out, text).drop("_n", "_f")


def difference(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """rows with the canonical text of a - b of parsed() amounts, where one decimal can hold what both digits span; else null."""
    rows = rows.withColumn("_e", F.expr(f"if({a}_d = '', {b}_e, if({b}_d = '', {a}_e, least({a}_e, {b}_e)))"))
    fits = " and ".join(f"({n}_d = '' or length({n}_d) + {n}_e - _e < {DIGITS + 9})" for n in (a, b))
    rows = rows.withColumn("_fit", F.expr(fits))
    one = lambda n: f"cast(if({n}_d = '', '0', concat({n}_s, {n}_d, repeat('0', {n}_e - _e))) AS {_WIDE})"
    rows = rows.withColumn("_v", F.expr(f"if(_fit, cast({one(a)} - {one(b)} AS {_WIDE}), null)"))
    return _told(rows, "_v", "_e", out).drop("_e", "_fit", "_v")


def _limb_sums_told(sums: DataFrame, out: str) -> DataFrame:
    """sums (FIELDS) with their canonical text; where they are in two neighbours that one decimal holds, which most are, in
    compiled steps."""
    found = " ".join(f"WHEN {f} is not null THEN {k}" for k, f in enumerate(FIELDS))
    above = " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(FIELDS[1:]))
    sums = sums.withColumns({"_k": F.expr(f"CASE {found} END"), "_lo": F.coalesce(*FIELDS), "_c": F.expr(" + ".join(f"if({f} is null, 0, 1)" for f in FIELDS))})
    sums = sums.withColumn("_hi", F.expr(f"CASE _k {above} END")).withColumn("_p", F.expr(f"{LOWEST} + {DIGITS} * _k"))
    fits = f"_c = if(_hi is null, 1, 2) and abs(coalesce(_hi, {_ZERO})) < 1000000000 and abs(_lo) < cast('1{'0' * (DIGITS + 8)}' AS {_WIDE})"
    sums = sums.withColumn("_fit", F.expr(fits))
    one = f"if(_hi is null, {_ZERO}, cast(concat(cast(_hi AS string), '{'0' * DIGITS}') AS {_WIDE}))"
    sums = _told(sums.withColumn("_v", F.expr(f"if(_fit, cast({one} + _lo AS {_WIDE}), null)")), "_v", "_p", "_short")
    every = F.struct(*FIELDS)
    return sums.withColumn(out, F.when(F.col("_c") == 0, "0").when(F.col("_fit"), F.col("_short")).otherwise(text(every))).drop("_k", "_lo", "_c", "_hi", "_p", "_fit", "_v", "_short")


def exact_sum(rows: DataFrame, keys: list[str], told: str, out: str = "total") -> DataFrame:
    """keys and the exact sum of the column told as canonical text; null if one of a key's texts is no number. Null texts don't
    count."""
    split = parsed(rows.filter(F.col(told).isNotNull()).select(*keys, F.col(told).alias("_told")), {"_q": F.col("_told")}).drop("_told").withColumn("_q_n", F.length("_q_d"))
    limbs = split.select(*keys, _apart(F.col("_q_d")).alias("_q_d"), *(F.expr(_limb(k).replace("q.", "_q_").replace("_q_digits", "_q_d").replace("_q_sign", "_q_s")) for k in range(LIMBS)))
    sums = limbs.groupBy(*keys).agg(*(F.sum(f).cast(_WIDE).alias(f) for f in FIELDS), F.count_if(F.col("_q_d").isNull()).alias("_bad"))
    return _limb_sums_told(sums, "_text").select(*keys, F.when(F.col("_bad") == 0, F.col("_text")).alias(out))


#: Texts whose amounts are quick() and spelt without exponent.
_FEW = r"^-?[0-9]{1,9}([.][0-9]{1,18})?$"


class Mixed:
    """How amounts that are canonical texts are added up where most are short: these as decimals, and only the others in limbs,
    which the functions of arrays read and tell. A sum is struct(q, n): the short ones' and the limbs of the others'."""

    @staticmethod
    def read(rows: DataFrame, told: str) -> DataFrame:
        """rows with _q or _n of the text told; both null if it isn't known."""
        short = F.coalesce(F.col(told).rlike(_FEW), F.lit(False))
        return rows.withColumns({"_q": F.when(short, F.col(told).cast("decimal(28,18)")), "_n": F.when(~short, number(told))})

    #: Of what read() gives: whether the amount isn't known.
    unknown = staticmethod(lambda: F.col("_q").isNull() & F.col("_n").isNull())

    @staticmethod
    def sum(window: WindowSpec | None = None) -> Column:
        over = lambda c: F.sum(c) if window is None else F.sum(c).over(window)
        return F.struct(over("_q").cast(AMOUNT).alias("q"), F.struct(*(over(f"_n.{f}").alias(f) for f in FIELDS)).alias("n"))

    @staticmethod
    def plus(a: Column, b: Column) -> Column:
        """a + b of two sums; null counts as nothing."""
        zero, wide = F.lit(0).cast(_WIDE), "decimal(37,18)"
        q = (F.coalesce(a["q"], F.lit(0)).cast(wide) + F.coalesce(b["q"], F.lit(0)).cast(wide)).cast(AMOUNT)
        limb = lambda x, y: F.when(x.isNotNull() | y.isNotNull(), (F.coalesce(x, zero) + F.coalesce(y, zero)).cast(_WIDE))
        return F.struct(q.alias("q"), F.struct(*(limb(a["n"][f], b["n"][f]).alias(f) for f in FIELDS)).alias("n"))

    @staticmethod
    def _short(total: Column) -> Column:
        return F.coalesce(*(total["n"][f] for f in FIELDS)).isNull()

    @classmethod
    def text(cls, total: str | Column) -> Column:
        """Canonical text; of a sum of nothing, and of null, '0'."""
        total = F.col(total) if isinstance(total, str) else total
        none = F.struct(*(F.lit(None).cast(_WIDE).alias(f) for f in FIELDS))
        every = minus(number(total["q"].cast("string")), minus(none, total["n"]))
        return F.when(cls._short(total), short_text(F.coalesce(total["q"], F.lit(0).cast(AMOUNT)))).otherwise(text(every))

    @classmethod
    def decimal_of(cls, total: str, told: str) -> Column:
        """AMOUNT of a sum whose text is known too."""
        return F.when(cls._short(F.col(total)), F.coalesce(F.col(total)["q"], F.lit(0).cast(AMOUNT))).otherwise(decimal(told))


def upto(*keys: str, order: str = "ledger_index", last: int = 0) -> WindowSpec:
    """The window from a key's beginning to the row (last -1: to the row before it)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
