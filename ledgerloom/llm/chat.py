"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, for each role, the control strings around its text and whether the text counts for the loss, and says
which roles may follow which. Inside texts the first character of any control string is followed by the escape character,
so a text never contains a control string; every escape is undone on reading back. Roles that the template doesn't know
keep their (escaped) name between the marks of ``OTHER``.

Edge cases: null text is empty; a null role or one that the template doesn't know makes the conversation invalid but is
formatted, null as the empty name; the turns of a conversation are taken in the order of (turn, role, text), null turns
first, ties and repeated rows are turns of their own; a null conv_id is a conversation of its own; an empty table gives no
rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Characters of a piece that a formatted text is cut into before spans are read from it.
PIECE = 4096


@dataclass(frozen=True)
class Turn:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """turns: role -> control strings; follows: role -> roles that may come next ("" is the start); ends: allowed last roles."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Turn("<s>[INST] ", " [/INST]"),
            "assistant": Turn("[OUT] ", "</s>\n", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE ", "] ", "[/ROLE]\n")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("user", "assistant")

    @property
    def heads(self) -> str:
        """First visible characters of all control strings; these and the escape are escaped in texts."""
        marks = [m.strip() for t in self.turns.values() for m in (t.opens, t.closes)] + [m.strip() for m in self.other]
        return "".join(sorted({m[0] for m in marks}))


def escape(text: Column, template: Template) -> Column:
    heads = re.escape(template.heads + ESCAPE)
    return F.regexp_replace(text, f"([{heads}])", "$1" + ESCAPE * 2)


def unescape(text: Column, template: Template) -> Column:
    heads = re.escape(template.heads + ESCAPE)
    return F.regexp_replace(text, f"([{heads}])" + ESCAPE * 2, "$1")


def segments(conversations: DataFrame, template: Template) -> DataFrame:
    """A row for each turn: conv_id, turn, role, text, opens, body (escaped), closes, loss, allowed (by the state machine).

    The state is the role of the turn before, so one window over a conversation's turns runs the machine."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    before = F.coalesce(F.lag("role", 1, "").over(order), F.lit("\0"))
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        allowed = allowed | ((before == state) & F.coalesce(F.col("role"), F.lit("\0")).isin(*roles))
    known = F.col("role")
    opens = F.concat(F.lit(template.other[0]), escape(F.coalesce("role", F.lit("")), template), F.lit(template.other[1]))
    closes, loss = F.lit(template.other[2]), F.lit(False)
    for role, t in template.turns.items():
        opens = F.when(known == role, F.lit(t.opens)).otherwise(opens)
        closes = F.when(known == role, F.lit(t.closes)).otherwise(closes)
        loss = F.when(known == role, F.lit(t.loss)).otherwise(loss)
    return rows.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        "role",
        "text",
        opens.alias("opens"),
        escape(F.col("text"), template).alias("body"),
        closes.alias("closes"),
        loss.alias("loss"),
        allowed.alias("allowed"),
    )


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans (array of begin and end, in characters of formatted), valid for each conversation."""
    template = template or Template()
    turns = segments(conversations, template).withColumn("whole", F.concat("opens", "body", "closes"))
    # Where each turn begins: the running sum of the lengths of the turns before, so the work grows with the turns.
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("whole")).over(before), F.lit(0)) + F.char_length("opens")
    placed = turns.withColumn("begin", begin).withColumn("end", F.col("begin") + F.char_length("body"))
    turn = F.struct("n", "role", "whole", "begin", "end", "loss", "allowed")
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end")))
    last = F.element_at("turns", -1)["role"]
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        (F.forall("turns", lambda t: t["allowed"]) & F.coalesce(last, F.lit("\0")).isin(*template.ends)).alias("valid"),
    )


def spans_of(text: str, spans: str) -> Column:
    """The pieces of a text at spans (begin, end in characters), as an array. A text's characters can only be counted from its
    start, so it is cut once into pieces of equal size and a span is read from those that it touches."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def read(cut: Column, s: Column) -> Column:
        first, last = F.floor(s["begin"] / PIECE), F.floor((s["end"] - 1) / PIECE)

        def part(i: Column) -> Column:
            low = F.greatest(s["begin"] - i * PIECE, F.lit(0))
            high = F.least(s["end"] - i * PIECE, F.lit(PIECE))
            return F.substring(F.get(cut, i.cast("int")), (low + 1).cast("int"), (high - low).cast("int"))

        return F.when(s["end"] > s["begin"], F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")

    # A transform over the pieces as one value computes them once for all spans.
    return F.flatten(F.transform(F.array(pieces), lambda cut: F.transform(spans, lambda s: read(cut, s))))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted with turns (array of role, text), found by the control strings of the formatted text alone."""
    template = template or Template()
    q = re.escape
    options = [f"{q(t.opens)}.*?{q(t.closes)}" for t in (*template.turns.values(), Turn(template.other[0], template.other[2]))]
    whole = F.regexp_extract_all("formatted", F.lit(f"(?s){'|'.join(options)}"), F.lit(0))

    def parse(x: Column) -> Column:
        head, mid, tail = (len(m) for m in template.other)
        inside = F.substring(x, F.lit(head + 1), F.char_length(x) - head - tail)
        cut = F.instr(inside, F.lit(template.other[1]))
        role = unescape(F.substring(inside, F.lit(1), cut - 1), template)
        text = F.substring(inside, cut + mid, F.char_length(inside))
        out = F.struct(role.alias("role"), text.alias("text"))
        for name, t in template.turns.items():
            body = F.substring(x, F.lit(len(t.opens) + 1), F.char_length(x) - len(t.opens) - len(t.closes))
            out = F.when(F.startswith(x, F.lit(t.opens)), F.struct(F.lit(name).alias("role"), body.alias("text"))).otherwise(out)
        return out

    parsed = formatted.withColumn("turns", F.transform(whole, parse))
    return parsed.withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), unescape(t["text"], template).alias("text")))
    )


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and digests of what is read back from the output of format_conversations."""
    template = template or Template()
    back = read_back(formatted, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    spans = F.transform(spans_of("formatted", "loss_spans"), lambda x: unescape(x, template))
    return (
        back.withColumn("loss", F.array_join(spans, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
