"""Chat formatting by schema fingerprint, in DataFrame functions only.

A record's nested field paths, as far as any layout knows them, are sorted and hashed. The hash selects a
declarative mapping, and the mapping's fields become canonical turns ``(position, role, text)``. Turns of one
conversation are set in a template that can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<position:bigint,role:string,text:string>"
#: Layouts that hold a list of messages: list field, role field, text field.
#: Layouts of fixed fields: the role each field speaks.
LISTS = {
    "messages": ("messages", "role", "content"),
    "messages_text": ("messages", "role", "text"),
    "conversations": ("conversations", "from", "value"),
    "turns": ("turns", "speaker", "text"),
}
FIELDS = {
    "turn_row": (("role", "text"),),
    "prompt": (("user", "prompt"), ("assistant", "completion")),
    "prompt_response": (("user", "prompt"), ("assistant", "response")),
    "system_prompt_response": (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    "instruction": (("user", "instruction"), ("assistant", "output")),
    "instruction_input": (("user", "instruction"), ("user", "input"), ("assistant", "output")),
    "question": (("user", "question"), ("assistant", "answer")),
}
#: Other names of roles in such data.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>"
#: Control strings that no text may hold unescaped, as what stands before the inserted backslash.
CONTROL = r"(<(?=\||/?s>|</?SYS>>|</SYS)|\[(?=/?INST\]))"


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]


def _layouts() -> list[Layout]:
    lists = [Layout(n, (f, f"{f}[].{r}", f"{f}[].{t}")) for n, (f, r, t) in LISTS.items()]
    fields = [Layout(n, tuple(f for _, f in spec)) for n, spec in FIELDS.items() if n != "turn_row"]
    return [*lists, *fields, Layout("turn_row", ("role", "text"))]


LAYOUTS = _layouts()
TOP = sorted({p.split("[]")[0] for x in LAYOUTS for p in x.paths})
NESTED = sorted({p.split("[].")[1] for x in LAYOUTS for p in x.paths if "[]." in p})
RECORD = "struct<{}>".format(
    ",".join(
        f"`{f}`:array<struct<{','.join(f'`{n}`:string' for n in NESTED)}>>" if any(f == spec[0] for spec in LISTS.values()) else f"`{f}`:string"
        for f in TOP
    )
)


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _under(field: str):
    return lambda key: F.concat(F.lit(f"{field}[]."), key)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record that any layout knows; null for what isn't an object."""
    keys = F.array_intersect(F.json_object_keys(record), F.array(*map(F.lit, TOP)))
    paths = keys
    for field in sorted({spec[0] for spec in LISTS.values()}):
        inner = F.array_intersect(F.json_object_keys(F.get_json_object(record, f"$.{field}[0]")), F.array(*map(F.lit, NESTED)))
        paths = F.concat(paths, F.coalesce(F.transform(inner, _under(field)), F.array().cast("array<string>")))
    return _hash(paths)


def layout_of(print_: Column) -> Column:
    """Name of the layout with this fingerprint, or null."""
    out = F.lit(None).cast("string")
    for layout in LAYOUTS:
        out = F.when(print_ == _hash(F.array(*map(F.lit, layout.paths))), F.lit(layout.name)).otherwise(out)
    return out


def _role(role: Column) -> Column:
    out = role
    for other, ours in ROLES.items():
        out = F.when(role == other, F.lit(ours)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def turns_of(record: Column, layout: Column) -> Column:
    """Canonical turns of a parsed record (type ``RECORD``); null text is empty, unknown layouts give none.

    An absent ``input`` beside an instruction is no turn of its own; its layout has another fingerprint.
    """
    out = F.array().cast(f"array<{TURN}>")
    def message(role: str, text: str):
        return lambda m, i: F.struct(i.cast("long").alias("position"), _role(m[role]).alias("role"), _text(m[text]).alias("text"))

    for name, (field, role, text) in LISTS.items():
        out = F.when(layout == name, F.transform(record[field], message(role, text))).otherwise(out)
    for name, spec in FIELDS.items():
        if name == "turn_row":
            # One turn of a table of turns: its role is a value of that table, kept as it is.
            turns = F.array(F.struct(F.lit(0).cast("long").alias("position"), _text(record["role"]).alias("role"), _text(record["text"]).alias("text")))
        else:
            turns = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(r).alias("role"), _text(record[f]).alias("text")) for i, (r, f) in enumerate(spec)])
        out = F.when(layout == name, turns).otherwise(out)
    return out


def _unfolded(parsed: DataFrame) -> DataFrame:
    """Turns of ``(_c, _p, layout, _r)``."""
    turns = parsed.select("_c", "_p", "layout", F.explode_outer(turns_of(F.col("_r"), F.col("layout"))).alias("t"))
    return turns.select(
        F.col("_c").alias("conversation"), F.col("_p").alias("record"), F.col("t.position").alias("position"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout"
    )


def _message_of(known: list[str]):
    return lambda m: F.struct(*[(m[n] if n in known else F.lit(None)).cast("string").alias(n) for n in NESTED])


def turns_of_columns(rows: DataFrame, conversation: str, position: str | None) -> DataFrame:
    """The same for a table whose columns are the fields: its column names are the paths of the fingerprint.

    Texts stay columns, so their length has no bound but a row's. ``messages`` columns hold arrays of structs.
    """
    base = F.col(position).cast("long") if position else F.lit(None).cast("long")
    kinds = T._parse_datatype_string(RECORD)
    paths, fields = [], []
    for field in kinds:
        if field.name not in rows.columns:
            fields.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        given = rows.schema[field.name].dataType
        paths.append(field.name)
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(given, T.ArrayType) and isinstance(given.elementType, T.StructType):
            inner = [n for n in given.elementType.names if n in NESTED]
            paths += [f"{field.name}[].{n}" for n in inner]
            value = F.transform(value, _message_of(inner))
        fields.append(value.cast(field.dataType).alias(field.name))
    print_ = _hash(F.array(*map(F.lit, paths))) if paths else F.lit(None).cast("long")
    return _unfolded(rows.select(F.col(conversation).alias("_c"), base.alias("_p"), layout_of(print_).alias("layout"), F.struct(*fields).alias("_r")))


def canonical_turns(records: DataFrame, conversation: str, position: str | None, record: str) -> DataFrame:
    """``(conversation, position, role, text, layout)``, a row for each turn of each JSON record.

    ``position`` orders records of one conversation. Records of no known layout keep one row with a null
    layout and no role or text, so that nothing vanishes unseen.
    """
    base = F.col(position).cast("long") if position else F.lit(None).cast("long")
    parsed = records.select(
        F.col(conversation).alias("_c"), base.alias("_p"), layout_of(fingerprint(F.col(record))).alias("layout"), F.from_json(F.col(record), RECORD).alias("_r")
    )
    return _unfolded(parsed)


def escape(text: Column) -> Column:
    """A backslash before each backslash, and inside each control string; ``unescape`` undoes it."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """``(conversation, formatted, loss_spans)``, a row for each conversation with at least one turn.

    Turns are ordered by record, position, role and text, nulls first, so ties have one order. ``loss_spans``
    are the code points of ``formatted`` (start from 0, length) that are assistant text: there the loss counts.
    A conversation is one output text, so its turns meet in one row.
    """
    grouped = (
        turns.where("layout is not null")
        .groupBy("conversation")
        .agg(F.sort_array(F.collect_list(F.struct("record", "position", "role", "text"))).alias("t"))
    )
    parts = F.transform(
        "t", lambda t: F.struct(F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit(CLOSE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))
    )
    grouped = grouped.select("conversation", parts.alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc, p):
        body = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(body.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
        return F.struct(
            (body + F.length(p["body"]) + len(END)).cast("long").alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return grouped.select("conversation", text.alias("formatted"), F.aggregate("p", start, add)["spans"].alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """Turns read back from the text: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|", -1), lambda p: p.startswith(OPEN[2:]))
    head = lambda p: F.substring_index(p, CLOSE, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring(head(p), F.lit(len(OPEN) - 1), F.length(p))).alias("role"),
            unescape(F.substring(p, F.length(head(p)) + len(CLOSE) + 1, F.length(p))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
