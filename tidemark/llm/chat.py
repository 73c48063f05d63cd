"""Chat formatting of conversation tables, in Spark expressions alone.

A formatted conversation is a run of blocks, each of one or more adjacent
turns of one role:

    <|im_start|>role\\ntext<|im_sep|>text of the next turn<|im_end|>\\n

Texts cannot hold a control string: every `<|` in them, with any number of
backslashes between, gets one backslash more, and loses it when read back. A
role's line feeds become `<|im_nl|>`.

Turns are collected by conversation and by runs of SEGMENT turn numbers, so a
conversation of any length is dealt out over many tasks; what is joined at the
end is one struct for each such run. Adjacent turns of one role are merged
within a run by an array aggregation, and across runs by their first and last
roles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BREAK, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|im_nl|>"
SEGMENT = 512  # turn numbers whose rows are collected together
LOSS_ROLES = ("assistant",)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def header(role: Column) -> Column:
    """What opens a block of an escaped role."""
    return F.concat(F.lit(START), role, F.lit("\n"))


def segment(turns: Column) -> Column:
    """Sorted turns of one run: pieces of text, the loss spans in them by bytes, and the roles at both ends.

    The first block's header and the last one's end are left to whoever joins the runs.
    """
    empty = F.struct(
        F.lit(None).cast("string").alias("first"),
        F.lit(None).cast("string").alias("last"),
        F.lit(0).cast("long").alias("size"),
        F.array().cast("array<string>").alias("pieces"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )

    def merge(so_far: Column, turn: Column) -> Column:
        lead = F.when(so_far.last.isNull(), F.lit("")).when(so_far.last == turn.role, F.lit(BREAK)).otherwise(F.concat(F.lit(END), header(turn.role)))

        def add(lead: Column) -> Column:
            start = so_far["size"] + F.octet_length(lead)
            stop = start + F.octet_length(turn.text)
            span = F.when(turn.loss, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array())
            return F.struct(
                F.coalesce(so_far.first, turn.role).alias("first"),
                turn.role.alias("last"),
                stop.cast("long").alias("size"),
                F.concat(so_far.pieces, F.array(F.concat(lead, turn.text))).alias("pieces"),
                F.concat(so_far.spans, span.cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
            )

        return bound(lead, add)

    return F.aggregate(turns, empty, merge, lambda s: s.withField("text", F.array_join(s.pieces, "")).dropFields("pieces"))


def joined(runs: Column) -> Column:
    """The text and the loss spans of a conversation from its sorted runs."""
    ends = lambda i: F.get(runs, i).body
    leads = F.transform(runs, lambda r, i: F.when((i > 0) & (ends(i - 1).last == r.body.first), F.lit(BREAK)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), header(r.body.first))))

    def spans(leads: Column) -> Column:
        sizes = F.zip_with(runs, leads, lambda r, lead: F.octet_length(lead) + r.body["size"])
        starts = bound(sizes, lambda s: F.aggregate(s, F.array(F.lit(0).cast("long")), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n))))
        moved = bound(
            starts,
            lambda at: F.transform(runs, lambda r, i: F.transform(r.body.spans, lambda s: F.struct(*((s[k] + F.get(at, i) + F.octet_length(F.get(leads, i))).alias(k) for k in ("start", "stop"))))),
        )
        text = F.concat(F.array_join(F.zip_with(runs, leads, lambda r, lead: F.concat(lead, r.body.text)), ""), F.lit(END))
        return F.struct(text.alias("text"), F.flatten(moved).alias("loss_spans"))

    return bound(leads, spans)


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: Sequence[str] = LOSS_ROLES, segment_turns: int = SEGMENT
) -> DataFrame:
    """(conv_id, text, loss_spans): each conversation as one string, and the byte ranges [start, stop) of it that the loss covers.

    Turns go by number (null first), then by role and text, so ties and
    repeated rows have one order; every row stays a turn. A null role or text
    is empty. Rows without a conversation form one of their own. An empty table
    gives no rows; other columns are not read.
    """
    text, role = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{role_col}`"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        (F.col(f"`{turn_col}`") - F.pmod(F.col(f"`{turn_col}`"), F.lit(segment_turns))).alias("run"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("plain"), text.alias("body")).alias("t"),
    )
    runs = rows.groupBy("conv_id", "run").agg(F.collect_list("t").alias("turns"))
    marked = F.transform(
        F.sort_array("turns"),
        lambda t: F.struct(F.replace(escaped(t.plain), F.lit("\n"), F.lit(LINE)).alias("role"), escaped(t.body).alias("text"), t.plain.isin(list(loss_roles)).alias("loss")),
    )
    bodies = runs.select("conv_id", F.struct("run", segment(marked).alias("body")).alias("r"))
    whole = bodies.groupBy("conv_id").agg(F.collect_list("r").alias("runs"))
    out = whole.select("conv_id", bound(F.sort_array("runs"), joined).alias("out"))
    return out.select("conv_id", "out.text", "out.loss_spans")


def read_turns(text: Column) -> Column:
    """The (role, text) structs of every turn of a formatted conversation, in order."""
    blocks = F.split(text, r"\Q<|im_end|>\E\n")  # behind the last end there is nothing

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        plain = unescaped(F.replace(F.substring(role, len(START) + 1, 1 << 30), F.lit(LINE), F.lit("\n")))
        body = F.substr(block, F.char_length(role) + 2)
        return F.transform(F.split(body, r"\Q<|im_sep|>\E"), lambda t: F.struct(plain.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    part = lambda raw: lambda s: unescaped(F.substr(raw, s.start.cast("int") + 1, (s.stop - s.start).cast("int")).cast("string"))
    return bound(text.cast("binary"), lambda raw: F.array_join(F.transform(spans, part(raw)), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from text and loss_spans."""
    read = formatted.select("conv_id", F.struct(read_turns(F.col("text")).alias("turns"), read_loss(F.col("text"), F.col("loss_spans")).alias("loss"), F.char_length("text").alias("size")).alias("r"))
    lines = F.array_join(F.transform("r.turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("r.turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("r.loss").cast("long").alias("loss_chars"),
        F.sha2("r.loss", 256).alias("loss_sha256"),
        F.col("r.size").cast("long").alias("formatted_chars"),
    )
