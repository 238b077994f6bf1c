"""Personal data: detection by patterns and replacement by keyed, type-consistent surrogates.

Entities are found by one regular expression; texts are cut at them and joined again around the replacements, so nothing
else of a text changes. Card and bank account numbers count only with right check digits. Every distinct entity (in a form
that its spellings share, so that they stay together) gets a surrogate from a keyed hash: digits for digits with all
separators kept, right check digits, letters for letters of the same case and alphabet, given names of the same gender and
script, surnames of the same script and, where it shows, gender. A person's surname gets one surrogate, whatever title, given
names, initials and particles stand before it; addresses of one domain share theirs. What tells a secret's kind stays, and
private addresses stay private. Proposals that two entities share, that are taken, or that occur
as real entities go to another round with a new hash; so distinct entities stay distinct, and equal ones are replaced alike in
all documents. Later rounds lengthen formats that have few forms, so none runs out.

Nothing is left because it is long: addresses, secrets and names have no greatest length (an IBAN has at most 34 characters
by its standard, a card 19).

Edge cases: null and empty texts stay as they are; an entity that repeats in a text is replaced everywhere; a secret of marks
alone (a masked one) gets other marks; rows that hint at no entity pass unchanged and unshuffled; repeated rows stay repeated;
a null doc_id is an id of its own; an empty table gives no rows; other columns are kept whatever their names, but for
n_entities and kinds, which the operator's own replace.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import Scratch, cut, short_lived_shuffles, small

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or '::' and up to seven, of which one has a digit or two are there; an IPv4 address may be the end.
_IPV6 = (
    rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{6}}{_IPV4}|(?=[A-Fa-f:]*[0-9]|{_HEX}(?::{_HEX})*::{_HEX}|::{_HEX}:{_HEX}|{_HEX}:{_HEX}(?::{_HEX})*::)"
    rf"(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,5}}{_IPV4}|{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:])(?!\.[0-9])"
)
_FOURS = r"(?:[0-9]{4}[ -]){3}[0-9]{4}"
_PAIRS = "|".join(rf"0[1-9](?:{x}[0-9]{{2}}){{4}}(?![0-9])" for x in (" ", r"\.", "-"))
_NANP = "|".join(rf"[2-9][0-9]{{2}}{x}[0-9]{{3}}{x}[0-9]{{4}}(?![0-9])" for x in (" ", r"\.", "-"))
#: No other entity begins here: numbers don't run over a separator into the next one.
_OWN = (
    rf"(?!{_IPV4}|[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]|{_SSN}|{_PAIRS}|{_NANP}|[A-Za-z0-9._%+-]++@|[0-9]{{13,19}}(?![0-9])"
    rf"|{_FOURS}(?:[ -]{_FOURS})*(?![0-9]|[ -][0-9]{{4}}(?![0-9]))|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}(?![0-9]))"
)
#: Digits behind the country code (a pattern of codes: least and most); other codes: 6 to 12.
_PHONE_DIGITS = {
    "1": (10, 10), "7": (10, 10), "3[0134]": (9, 10), "32|36|4[1578]|51|6[16]": (8, 9), "39": (8, 11), "4[03]": (9, 11), "44": (9, 10),
    "4[56]": (7, 9), "49": (7, 11), "5[24578]|6[023]|8[26]|9[0-2]": (8, 11), "65": (8, 8), "81": (9, 10),
}


def _digits(least: int, most: int) -> str:
    """So many digits, with a separator or the end of an area code's parenthesis between any two."""
    return rf"\(?[0-9](?:(?:[ .-]{_OWN}|\)[ .-]?)?[0-9]){{{least - 1},{most - 1}}}(?![0-9])"


_PHONE = "|".join(rf"(?:{code})[ .-]?(?:\(0\) ?)?{_digits(*n)}" for code, n in _PHONE_DIGITS.items()) + rf"|[0-9]{{1,3}}[ .-]?{_digits(6, 12)}"
#: Without a country code: an area code in parentheses or of three digits, pairs behind 0x, or a trunk 0 and two or three groups.
_NATIONAL = (
    rf"(?<![0-9])\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])|(?<![0-9.+-])(?:1[ .-])?(?:{_NANP})(?!\.[0-9])|(?<![0-9.+-])(?:{_PAIRS})(?!\.[0-9])"
    rf"|(?<![0-9.+-])(?!{_FOURS}(?![0-9]))\(?0[1-9][0-9]{{1,3}}(?:\) ?|[ -]){_OWN}[0-9]{{3,4}}[ -]{_OWN}[0-9]{{3,4}}(?![0-9])"
    rf"|(?<![0-9.+-])\(?0[1-9][0-9]{{1,4}}(?:\) ?|[ /-]){_OWN}[0-9]{{5,8}}(?![0-9])"
)
#: Characters of an IBAN by country; others: 16 to 35 in groups.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|CY|DO|GT|HU|LB|PL|SV",
    29: "BR|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
_IBAN = "|".join(
    rf"(?:{codes})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
    for n, codes in _IBAN_LENGTHS.items()
) + rf"|[A-Z]{{2}}[0-9]{{2}}(?:(?: {_OWN})?[A-Z0-9]{{4}}){{3,7}}(?:(?: {_OWN})?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: A single letter that stands for a given name, and words that stand before a surname and aren't names themselves.
_INITIAL = r"\p{Lu}(?:\. ?| (?=\p{Lu}))"
_PARTICLE = r"von|vom|van|zu|zur|zum|de|der|den|del|della|di|da|dal|do|dos|das|du|des|la|le|ter|ten|bin|ibn|al|el|af|av|y|St\."
_MALE = r"Mr|MR|Herr|HERR|Sr|SR|Señor|Monsieur|Mister|господин|г-н"
_FEMALE = r"Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Sra|SRA|Señora|Madame|Mme|Mlle|госпожа|г-жа"
#: Titles of either gender.
_EITHER = r"Dr|DR|Prof|PROF|Professor|Доктор|доктор"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_EITHER})"
_SECRET_KEY = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
#: What begins with a capital behind a name of one word, and is another entity.
_NO_SURNAME = (
    rf"{_TITLE}\.? |{_SECRET_KEY}\s{{0,3}}[=:]|AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|[\p{{L}}\p{{M}}\p{{N}}._%+-]++@|[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]"
)
#: A name with the initials and particles before it.
_NAMED = rf"(?:{_INITIAL}|(?:{_PARTICLE}) )*+{_NAME}"

#: kind -> pattern; earlier kinds win where several begin at one place.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|xox[abeprs]-[A-Za-z0-9-]{10,}+"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9]){_SECRET_KEY}[\"']?\s{{0,3}}[=:]\s{{0,3}}"
    r"(?:\"[^\"\s]{6,}+\"|'[^'\s]{6,}+'|[^\s\"'<>,;&]{5,}[^\s\"'<>,;&.:?!)\]}])",
    "ipv4": rf"(?<![0-9.]){_IPV4}",
    "ipv6": rf"(?<![0-9A-Za-z:.]){_IPV6}",
    "phone": rf"(?<![0-9+])\+(?:{_PHONE})|{_NATIONAL}",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})",
    "ssn": rf"(?<![0-9-]){_SSN}",
    "card": rf"(?<![0-9])(?:{_FOURS}(?![0-9]|[ -][0-9]{{1,3}}(?![0-9.:@-]))|3[0-9]{{3}}[ -][0-9]{{6}}[ -][0-9]{{5}}(?![0-9])|[0-9](?:(?:[ ]{_OWN}|-)?[0-9]){{12,18}}(?![0-9]))",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? (?:{_TITLE}\.? )*+{_NAMED}(?: (?!{_NO_SURNAME}){_NAMED}(?![\p{{L}}0-9]))*",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity. The class of first characters turns most places down at once.
_HINT = rf"(?=[0-9@:=AsgxeMHFSDPгГдД])(?:[0-9@:=]|AKIA|sk-|gh[pousr]_|xox|eyJ|{_TITLE})"

#: Given names for surrogates, by gender and script.
NAMES = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Marco Nils Oscar Paul Rafael Simon Tomas Viktor".split(),
    ("f", "latin"): "Alba Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tessa Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина София".split(),
}
NAMES |= {("u", script): NAMES["m", script] + NAMES["f", script] for script in ("latin", "cyrillic")}
#: Stems and endings of surnames; where a script's surnames have a gender, the endings have it too.
_STEMS = {
    "latin": "Al Ber Cor Dan Esk Fal Gor Hal Is Kal Lin Mar Nor Or Pel Ros Sand Tor Ver Wes".split(),
    "cyrillic": "Бел Вол Гор Дуб Зим Крас Лес Мор Нов Озер Пет Род Сад Тим Чер".split(),
}
_ENDINGS = {
    ("", "latin"): "den berg ström mann ford well ton ville sen".split(),
    ("m", "cyrillic"): "ский ин ов ев".split(),
    ("f", "cyrillic"): "ская ина ова ева".split(),
}

_TITLES = re.compile(rf"\A{_TITLE}\.? (?:{_TITLE}\.? )*")
_PARTICLES = re.compile(_PARTICLE)
#: What tells the kind of a secret, and stays.
_PREFIX = re.compile(r"\A(?:AKIA|gh[pousr]_|sk-|xox[abeprs]-|eyJ)")
_PRIVATE = re.compile(r"\A(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\.")
#: What stands before a secret's value.
_SECRET_VALUE = re.compile(rf"\A{_SECRET_KEY}[\"']?\s{{0,3}}[=:]\s{{0,3}}")


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        # The entity alone: what stands around it can't matter any more.
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def iban_check(iban: str) -> int:
    """1 for a valid number."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def entities_of(kind: str, surface: str) -> list[tuple[str, str]]:
    """(sort, entity) of what a surface form names, in the form that all its spellings share; none if check digits are wrong.

    A name is any number of given names or initials (by gender and script) and a surname, apart from its titles and particles,
    so that a person's full name and bare surname stay together; an e-mail address is itself and its domain. Sorts are apart:
    surrogates only have to differ within one."""
    digits = re.sub(r"\D", "", surface)
    if kind == "card":
        return [(kind, digits)] if luhn(digits) == 0 else []
    if kind == "iban":
        compact = surface.replace(" ", "")
        return [(kind, compact)] if iban_check(compact) == 1 else []
    if kind in ("phone", "ssn"):
        return [(kind, "+" * surface.startswith("+") + digits)]
    if kind == "secret":
        return [(kind, _SECRET_VALUE.sub("", surface).strip("\"'"))]
    if kind == "ipv6":
        return [(kind, str(ipaddress.IPv6Address(surface)))]
    if kind == "name":
        titles = _TITLES.match(surface)[0]
        *given, family = (x for x in _words_of(surface[len(titles) :]) if not _PARTICLES.fullmatch(x))
        told = {"f" if re.fullmatch(_FEMALE, x) else "m" for x in titles.replace(".", "").split() if not re.fullmatch(_EITHER, x)}
        gender = min(told, default="u")
        script = "cyrillic" if re.search(r"[Ѐ-ӿ]", family) else "latin"
        return [(f"given/{gender}/{script}", x.casefold()) for x in given] + [
            (f"family/{gender.replace('u', 'm') if script == 'cyrillic' else ''}/{script}", family.casefold())
        ]
    if kind == "email":
        return [(kind, surface.lower()), ("domain", surface.lower().partition("@")[2])]
    return [(kind, surface.lower())]


def _words_of(names: str) -> list[str]:
    """Names, particles and initials (with their dots) of what stands behind a title."""
    return re.findall(r"[^\s.]+\.?", names)


#: Marks that stand in for marks.
_MARKS = "#$%*+=@^_~"
#: Letters and digits that a text must have to be told apart by them alone.
_FORMS = 6


@lru_cache(maxsize=4096)
def _sort_of(c: str) -> str:
    """Characters of the same sort as c: letters of its case and block, digits of its script, marks."""
    kind = unicodedata.category(c)
    if c in string.digits or c in string.ascii_lowercase or c in string.ascii_uppercase:
        return next(x for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in x)
    if kind[0] not in "LN" or kind == "Nl":
        return ""
    block = ord(c) & ~63
    return "".join(x for x in map(chr, range(block, block + 64)) if unicodedata.category(x) == kind)


class _Draw:
    """A stream of keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.at, self.pool = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.digest(self.key, self.at.to_bytes(4, "big") + self.seed, "sha256")
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n

    def pick(self, options):
        return options[self.below(len(options))]

    def digits(self, n: int) -> str:
        return "".join(self.pick(string.digits) for _ in range(n))

    def like(self, text: str) -> str:
        """Every letter and digit drawn anew, each of its own sort; hexadecimal text stays hexadecimal. Other characters
        stay, but where too few letters and digits are left to tell texts apart."""
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and re.search(r"[a-fA-F]", text):
            return "".join(self.pick("0123456789abcdef" if text == text.lower() else "0123456789ABCDEF") for _ in text)
        marks = "" if sum(len(_sort_of(c)) > 1 for c in text) >= _FORMS else _MARKS
        return "".join(self.pick(sort) if (sort := _sort_of(c) or marks) else c for c in text)


def surrogate(key: bytes, sort: str, entity: str, attempt: int) -> str:
    """A replacement of the entity, in the shared form: of the same sort and, where that matters, format. Later attempts get
    longer where a format has few forms."""
    draw = _Draw(key, sort, entity, attempt)
    kind, *which = sort.split("/")
    if kind == "email":
        # The part before the @; addresses of one domain stay with one domain.
        return f"{draw.like(entity.partition('@')[0])}{draw.digits(max(0, attempt - 2))}".lower()
    if kind == "domain":
        # Under the domains that are reserved for examples.
        return f"{draw.like(entity.split('.')[0])}{draw.digits(max(0, attempt - 2))}.{draw.pick(('example.com', 'example.org', 'example.net'))}".lower()
    if kind == "ipv4":
        # Private and local addresses stay in their ranges, while these have room.
        if (private := _PRIVATE.match(entity)) and attempt < 8:
            kept = private[0].rstrip(".").split(".")
            return ".".join([*kept, *(str(1 + draw.below(254)) for _ in range(4 - len(kept)))])
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(":".join(f"{draw.below(1 << 16):x}" for _ in range(8))))
    if kind == "phone":
        keep = 1 if entity.startswith(("+1", "0")) else 2 if entity.startswith("+") else 0
        digits = entity.lstrip("+")
        new = digits[:keep] + str(2 + draw.below(8)) + draw.digits(len(digits) - keep - 1 + max(0, attempt - 8))
        return "+" * entity.startswith("+") + new
    if kind == "card":
        body = str(1 + draw.below(9)) + draw.digits(len(entity) - 2)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)) == 0)
    if kind == "iban":
        body = draw.like(entity[4:])
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    if kind == "given":
        return "-".join(draw.pick(NAMES[tuple(which)]) for _ in range(1 + attempt // 2)).casefold()
    if kind == "family":
        stem = "".join(draw.pick(_STEMS[which[1]]) for _ in range(1 + attempt // 2))
        return (stem + draw.pick(_ENDINGS[tuple(which)])).casefold()
    if kind == "secret" and (told := _PREFIX.match(entity)):
        rest = entity[told.end() :]
        return told[0] + draw.like(rest) + "".join(draw.pick(string.ascii_uppercase + string.digits) for _ in range(attempt - 2))
    return draw.like(entity) + "".join(draw.pick(string.ascii_lowercase + string.digits) for _ in range(attempt - 2))


def dress(kind: str, surface: str, new: list[str]) -> str:
    """The surrogates in the spelling of a surface form: its separators, quotes, dots and case."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = list(reversed(new[0].lstrip("+")))
        taken = "".join(left.pop() if c.isalnum() else c for c in surface)
        return taken + "".join(reversed(left))
    if kind == "secret":
        before = surface[: len(surface) - len(_SECRET_VALUE.sub("", surface))]
        quote = surface[-1] if len(before) < len(surface) and surface[len(before)] in "\"'" else ""
        return f"{before}{quote}{new[0]}{quote}"
    if kind == "name":
        titles, left = _TITLES.match(surface)[0], iter(new)

        def cased(old: re.Match) -> str:
            if _PARTICLES.fullmatch(old[0]):
                return old[0]
            name, bare = next(left), old[0].rstrip(".")
            if len(bare) == 1:
                return name[0].upper() + old[0][1:]
            return name.upper() if bare == bare.upper() else "-".join(x.capitalize() for x in name.split("-"))

        return titles + re.sub(r"[^\s.]+\.?", cased, surface[len(titles) :])
    if kind == "email":
        address = "@".join(new)
        return address.upper() if surface == surface.upper() else address
    return new[0].upper() if kind == "ipv6" and surface == surface.upper() else new[0]


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """The rows that f makes of each row's cells; schema: names and kinds (string or int)."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [pa.int32() if kind == "int" else pa.string() for kind in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in f(*r)]
            cells = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, types, strict=True)], names=list(names))

    return df.mapInArrow(run, schema)


def assign(entities: DataFrame, key: bytes, tables: Scratch, most_rounds: int = 64) -> DataFrame:
    """sort, entity, surrogate for the distinct entities (sort, entity), one surrogate for each and none twice."""
    left = tables.keep(entities.distinct())
    real, done = left.select("sort", F.col("entity").alias("surrogate")), None
    for attempt in range(most_rounds):
        proposed = tables.keep(
            _map(left, lambda s, e, a=attempt: [(s, e, surrogate(key, s, e, a))], "sort string, entity string, surrogate string")
        )
        won = proposed.groupBy("sort", "surrogate").agg(F.min("entity").alias("entity")).join(real, ["sort", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done, ["sort", "surrogate"], "left_anti")
        won = tables.keep(won.select("sort", "entity", "surrogate"))
        done = won if done is None else done.union(won)
        left = tables.keep(left.join(won, ["sort", "entity"], "left_anti"))
        tables.drop(proposed)
        if left.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates in {most_rounds} rounds: an entity's format leaves too few")


def replace(docs: DataFrame, key: bytes = b"surrogates-1") -> DataFrame:
    """docs with text replaced, and the columns n_entities and kinds (sorted distinct kinds) after all others; columns of docs
    with these two names are replaced by them."""
    docs = docs.drop("n_entities", "kinds")
    with short_lived_shuffles(docs.sparkSession):
        tables = Scratch(docs.sparkSession)
        hinted = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
        untouched = docs.filter(~hinted).withColumns(
            {"n_entities": F.lit(0).cast("long"), "kinds": F.array().cast("array<string>")}
        )
        # The caller's columns travel as one struct, so none can clash.
        found = docs.filter(hinted).select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
            F.xxhash64("text").alias("hash"),
            F.struct("*").alias("row"),
        )
        # explode(array(...)) keeps the filter below from working the entities out a second time.
        entities = found.select("id", "hash", F.explode(F.array(F.regexp_extract_all("row.text", F.lit(_ANY), F.lit(0)))).alias("entities"))
        each = tables.keep(
            entities.filter(F.size("entities") > 0)
            .select("id", "hash", F.posexplode("entities").alias("at", "surface"))
            .withColumn("kind", kind_of(F.col("surface")))
        )
        surfaces = tables.keep(
            _map(
                each.select("kind", "surface").distinct(),
                lambda k, s: [(k, s, i, *x) for i, x in enumerate(entities_of(k, s))],
                "kind string, surface string, part int, sort string, entity string",
            )
        )
        given = assign(surfaces.select("sort", "entity"), key, tables)
        # A surface form has as many parts as it has names.
        parts = surfaces.join(given, ["sort", "entity"]).groupBy("kind", "surface").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]).alias("new")
        )
        mapping = tables.keep(_map(parts, lambda k, s, n: [(k, s, dress(k, s, n))], "kind string, surface string, new string"))
        # The entities of one text, which bounds them; equal rows share theirs. What has wrong check digits stays as it is.
        by_text = cut(
            each.join(small(mapping, mapping.count()), ["kind", "surface"], "left")
            .groupBy("id", "hash")
            .agg(
                F.array_sort(
                    F.collect_set(F.struct("at", F.coalesce("new", "surface").alias("new"), F.when(F.col("new").isNotNull(), F.col("kind")).alias("kind")))
                ).alias("new")
            )
        )
        tables.drop_all()
    between = F.when(F.col("new").isNotNull(), F.split("row.text", _ANY, -1))
    rest = F.zip_with(F.slice("between", F.lit(2), F.size("new")), "new", lambda s, n: F.concat(n["new"], s))
    text = F.coalesce(F.concat(F.get("between", F.lit(0)), F.array_join(rest, "")), F.col("row.text"))
    kinds = F.array_compact(F.transform(F.coalesce("new", F.array()), lambda n: n["kind"]))
    changed = (
        found.join(by_text, ["id", "hash"], "left")
        .withColumn("between", between)
        .select(F.col("row").withField("text", text).alias("row"), F.size(kinds).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))
        .select("row.*", "n_entities", "kinds")
    )
    return untouched.unionByName(changed)
