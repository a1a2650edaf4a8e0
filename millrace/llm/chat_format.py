"""Conversations of any layout to one training template, with a loss mask.

A record's *layout* is its nested field names. They are taken from the parsed record, hashed to a
fingerprint, and the fingerprint selects a declarative mapping: either named fields with the role
that each stands for, or an array of messages with its role and text fields. What comes out is the
same for all layouts: an array of turns (role, text), which the template turns into one string.

Inside roles and texts, whatever looks like a control string is escaped reversibly, so the
formatted text can be split into its turns again. Everything is a Column expression.

Edge cases: null roles and texts are empty; a record whose layout is unknown has null turns and
a null ``layout``; turns with the same number are ordered by role and text; an empty table gives
an empty result. One conversation becomes one string, so a conversation must fit into a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
TURNS_TYPE = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """``example`` shows the field names. Either ``fields`` maps JSON paths to roles, in order, or
    ``messages`` is the path of an array whose elements have ``role`` and ``text``; ``roles`` renames roles."""

    name: str
    example: str
    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout("turns", '{"turns":[{"role":"","text":"","turn":0}]}', messages="$.turns", role="role", text="text"),
    Layout("messages", '{"messages":[{"content":"","role":""}]}', messages="$.messages", role="role", text="content"),
    Layout("from_value", '{"conversations":[{"from":"","value":""}]}', messages="$.conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", '{"prompt":"","response":""}', fields=(("$.prompt", "user"), ("$.response", "assistant"))),
    Layout("completion", '{"completion":"","prompt":""}', fields=(("$.prompt", "user"), ("$.completion", "assistant"))),
    Layout("instruction", '{"input":"","instruction":"","output":""}', fields=(("$.instruction", "user"), ("$.input", "user"), ("$.output", "assistant"))),
    Layout("system_prompt", '{"question":"","response":"","system_prompt":""}', fields=(("$.system_prompt", "system"), ("$.question", "user"), ("$.response", "assistant"))),
)


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field names; the types of the values don't count."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    names = F.regexp_replace(shape, r": (?!OBJECT|ARRAY)[A-Z][A-Z0-9(), ]*?(?=, \w+:|>|$)", "")
    return F.sha2(names, 256)


def _turn_of(layout: Layout):
    """The turn of one element of a layout's array of messages."""
    renamed = F.create_map(*(F.lit(x) for pair in layout.roles.items() for x in pair)) if layout.roles else None

    def turn(m: Column) -> Column:
        role = m[layout.role]
        role = F.coalesce(F.try_element_at(renamed, role), role) if layout.roles else role
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text"))

    return turn


def canonical_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(turns, name of the layout) of a JSON record."""
    print_ = fingerprint(record)
    parsed = F.try_parse_json(record)
    turns, name = F.lit(None).cast(TURNS_TYPE), F.lit(None).cast("string")
    for layout in layouts:
        known = print_ == fingerprint(F.lit(layout.example))
        if layout.messages:
            listed = F.try_variant_get(parsed, layout.messages, f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")
            found = F.transform(listed, _turn_of(layout))
        else:
            listed = [
                F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(parsed, path, "string"), F.lit("")).alias("text"))
                for path, role in layout.fields
            ]
            found = F.array(*listed)
        turns = F.when(known, found).otherwise(turns)
        name = F.when(known, F.lit(layout.name)).otherwise(name)
    return turns, name


def escape(text: Column) -> Column:
    r"""Take the first character out of control strings: < becomes \l, [ becomes \s; a backslash
    that could be read as such a mark becomes \b."""
    text = F.regexp_replace(text, r"\\(?=[blsn])", r"\\b")
    text = F.regexp_replace(text, r"<(?=\|turn\|>|\|end\|>|/?s>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\s")


def unescape(text: Column) -> Column:
    for mark, plain in ((r"\l", "<"), (r"\s", "["), (r"\n", "\n"), (r"\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def head(role: Column) -> Column:
    return F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit(r"\n")), F.lit("\n"))


def formatted(turns: Column) -> Column:
    """The whole conversation in the template."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t["role"]), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, end) in code points of the formatted text, of each text that the loss is taken on."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(head(t["role"]))
        last = first + F.length(escape(t["text"]))
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        spans = F.when(t["role"] == role, F.concat(F.coalesce(state["spans"], F.array().cast("array<struct<start: bigint, end: bigint>>")), span)).otherwise(state["spans"])
        return F.struct((last + len(END)).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return F.aggregate(turns, start, step, lambda s: F.coalesce(s["spans"], none))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(text, F.lit(r"<\|end\|>\n"), -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(TURN) + 1))
        cut = F.instr(body, "\n")
        return F.struct(unescape(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask of a formatted text, unescaped."""
    pieces = F.transform(spans, lambda s: F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(pieces, unescape), "")


def records_of_rows(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One JSON record for each conversation of a table with a row for each turn."""
    entry = F.struct(
        F.coalesce(turn, F.lit(-1)).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    listed = F.array_sort(F.collect_list(entry)).alias("turns")
    return rows.groupBy(F.col(conversation).alias("conv_id")).agg(F.to_json(F.struct(listed)).alias("record"))


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with the columns layout, formatted and loss_spans in place of the record."""
    turns, layout = canonical_turns(F.col(record))
    kept = [c for c in records.columns if c not in (record, "layout", "formatted", "loss_spans")]
    return records.select(*kept, turns.alias("__turns"), layout.alias("layout")).select(
        *kept, "layout", formatted(F.col("__turns")).alias("formatted"), loss_spans(F.col("__turns")).alias("loss_spans")
    )
