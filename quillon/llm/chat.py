"""Chat formatting: a finite-state machine over roles and a declarative template.

The turns of a conversation are folded into one string. Control strings inside a text get a
backslash after their first character and backslashes are doubled, so that markers only
occur where the template puts them and every text can be read back. Each segment of the output has a
loss flag; the spans under the loss mask are offsets in code points.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Template:
    """Marks of each role: what opens and closes its turns, and whether its text is under the loss mask."""

    opens: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST] ", "assistant": "<s>"})
    closes: dict[str, str] = field(default_factory=lambda: {"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"})
    #: any other role: its name stands between the first two, its text before the third
    other: tuple[str, str, str] = ("[ROLE]", "[=]", "[/ROLE]")
    loss: tuple[str, ...] = ("assistant",)
    #: roles that may follow a role; the empty string is the start
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({s.strip() for s in [*self.opens.values(), *self.closes.values(), *self.other]})


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls():
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _mark(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, segments, valid, invalid_turn.

    Turns are ordered by number, null first; repeated numbers by role, then text. A null text or
    role is empty. segments is an array of (text, loss) whose texts joined are `formatted`; loss_spans are
    the (start, end) of escaped texts under the loss mask. valid tells whether the machine
    accepts the roles; invalid_turn is the position of the first that it rejects (the number of turns if
    only the end is wrong), else null. Invalid conversations are formatted too, and the
    caller decides. Rows with a null conv_id are one conversation. Other columns
    are ignored; an empty table gives an empty result. A conversation is one output value, so its turns meet
    in one task, as the output does.
    """
    template = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b, c = template.other
    opened = _mark(F.col("role"), template.opens, F.concat(F.lit(a), escape(F.col("role"), template), F.lit(b)))
    closed = _mark(F.col("role"), template.closes, F.lit(c))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns({"opened": opened, "body": escape(F.col("text"), template), "closed": closed})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("opened") + F.length("body") + F.length("closed")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"k": F.row_number().over(order), "start": (before + F.length("opened")).cast("int"), "loss": F.col("role").isin(*template.loss)})
    per = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "opened", "body", "closed", "start", "loss"))).alias("turns"))

    def segments(t: Column) -> Column:
        return F.array(F.struct(t["opened"].alias("text"), F.lit(False).alias("loss")), F.struct(t["body"].alias("text"), t["loss"].alias("loss")), F.struct(t["closed"].alias("text"), F.lit(False).alias("loss")))

    moves = F.create_map(*[F.lit(x) for k, v in template.follows.items() for x in (k, "|" + "|".join(v) + "|")])

    def step(state: Column, t: Column) -> Column:
        allowed = F.coalesce(F.contains(F.element_at(moves, state["role"]), F.concat(F.lit("|"), t["role"], F.lit("|"))), F.lit(False)) & (t["role"] != "")
        bad = F.when(state["bad"].isNotNull(), state["bad"]).when(~allowed, state["at"])
        return F.struct(t["role"].alias("role"), (state["at"] + 1).alias("at"), bad.alias("bad"))

    start = F.struct(F.lit("").alias("role"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    final = F.aggregate("turns", start, step)
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end")))
    out = per.withColumns({"segments": F.flatten(F.transform("turns", segments)), "_final": final})
    invalid = F.when(F.col("_final.bad").isNotNull(), F.col("_final.bad")).when(~F.col("_final.role").isin(*template.ends), F.col("_final.at"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"), "segments", invalid.isNull().alias("valid"), invalid.alias("invalid_turn"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns and loss texts that the formatted string and its spans hold: adds turns (role, text) and loss_texts."""
    template = template or Template()
    ends = sorted({*template.closes.values(), template.other[2]})
    quoted = "|".join("\\Q" + e + "\\E" for e in ends)
    pieces = F.split("formatted", quoted)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    a, b, _ = template.other

    def turn(p: Column) -> Column:
        name = F.regexp_extract(p, "(?s)^" + "\\Q" + a + "\\E(.*?)\\Q" + b + "\\E", 1)
        role, opened = unescape(name), F.length(name) + len(a) + len(b)
        for r, mark in template.opens.items():
            role, opened = F.when(F.startswith(p, F.lit(mark)), F.lit(r)).otherwise(role), F.when(F.startswith(p, F.lit(mark)), F.lit(len(mark))).otherwise(opened)
        return F.struct(role.alias("role"), unescape(F.substring(p, opened + 1, F.length(p))).alias("text"))

    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_texts": spans})
