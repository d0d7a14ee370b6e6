r"""Chat formatting: layouts found by schema fingerprint, mapped to canonical turns.

A record's layout is the sorted set of its nested field paths; the hash of those paths selects a
declarative mapping to ``turns array<struct<role, text>>``. Turns are rendered with marks and the
marks' opening ``<|`` is escaped inside roles and texts, so the output parses back exactly.

Escaping: ``<``, any number of ``\`` and ``|`` gets one more ``\``; a line break in a role then becomes
``<|nl|>``. Unescaping takes both away again.

Defined results: null role or text is empty; unknown layouts have null turns and layout; turns
that tie keep the order role, text, repeated ones included; texts of any length are kept whole, though a JSON record
over the size of a variant (128 MB) has an unknown layout; an empty table has no conversations; other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfacet.llm.common import column, spare, worker_cache

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Sorted paths of all leaf fields; array levels are marked ``[]``."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


# ---- layouts of one JSON record each -------------------------------------------------------


class _Struct:
    """A typed record, read by the same paths as a parsed one."""

    def __init__(self, col: Column):
        self.col = col


def _get(v: Column | _Struct, path: str, kind: str = "string") -> Column:
    if isinstance(v, _Struct):
        at = v.col
        for name in path[2:].split("."):
            at = at[name]
        return at if kind.startswith("array") else at.cast(kind)
    return F.try_variant_get(v, path, kind)


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _messages(list_path: str, role: str, text: str, rename: bool = True) -> Callable[[Column | _Struct], Column]:
    """A list of objects with a role and a text field; common role names become canonical, unless roles stay as they are."""

    def build(v: Column | _Struct) -> Column:
        named = F.create_map(*[F.lit(x) for x in ("human", "user", "gpt", "assistant", "bot", "assistant", "model", "assistant")])
        items = _get(v, list_path, f"array<struct<{role}:string,{text}:string>>")
        return F.transform(items, lambda m: _turn(F.coalesce(named[m[role]], m[role]) if rename else m[role], m[text]))

    return build


def _pairs(*parts: tuple[str, str]) -> Callable[[Column | _Struct], Column]:
    """Fixed fields, each a turn of a given role; missing or empty ones give no turn."""

    def build(v: Column | _Struct) -> Column:
        turns = F.array(*[_turn(role, _get(v, path)) for role, path in parts])
        return F.filter(turns, lambda t: F.coalesce(t["text"], F.lit("")) != "")

    return build


def _instruction(v: Column | _Struct) -> Column:
    asked = F.concat_ws("\n\n", F.nullif(_get(v, "$.instruction"), F.lit("")), F.nullif(_get(v, "$.input"), F.lit("")))
    return F.array(_turn("user", asked), _turn("assistant", _get(v, "$.output")))


#: Field paths and mapping of each known layout. Types don't count, so a null field keeps the layout.
LAYOUTS: dict[str, tuple[tuple[str, ...], Callable[[Column | _Struct], Column]]] = {
    "turns": (("turns[].role", "turns[].text"), _messages("$.turns", "role", "text", rename=False)),
    "messages": (("messages[].content", "messages[].role"), _messages("$.messages", "role", "content")),
    "conversations": (("conversations[].from", "conversations[].value"), _messages("$.conversations", "from", "value")),
    "instruction": (("instruction", "output"), _instruction),
    "instruction_input": (("input", "instruction", "output"), _instruction),
    "prompt_completion": (("completion", "prompt"), _pairs(("user", "$.prompt"), ("assistant", "$.completion"))),
    "prompt_response": (("prompt", "response"), _pairs(("user", "$.prompt"), ("assistant", "$.response"))),
    "question_answer": (("answer", "question"), _pairs(("user", "$.question"), ("assistant", "$.answer"))),
    "system_question": (("question", "response", "system_prompt"), _pairs(("system", "$.system_prompt"), ("user", "$.question"), ("assistant", "$.response"))),
}


def variant_shape(v: Column) -> Column:
    """The layout of a variant as text: its schema with every scalar type written ``*``."""
    scalar = r"\b(STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\d+\)|VARIANT)\b(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(v), scalar, "*")


def shape_paths(shape: str) -> list[str]:
    """Leaf paths of a shape such as ``OBJECT<a: *, b: ARRAY<OBJECT<c: *>>>``."""

    def walk(s: str, at: str) -> list[str]:
        if s.startswith("ARRAY<"):
            return walk(s[6:-1], at + "[]")
        if s.startswith("OBJECT<"):
            out, depth, start, body = [], 0, 0, s[7:-1]
            for i, c in enumerate(body + ","):
                depth += (c == "<") - (c == ">")
                if c == "," and depth == 0:
                    name, _, rest = body[start:i].partition(": ")
                    out += walk(rest.strip(), f"{at}.{name.strip().strip('`')}" if at else name.strip().strip("`"))
                    start = i + 1
            return out
        return [at]

    return sorted(walk(shape, ""))


@F.pandas_udf(T.StringType())
def _shape_print(shapes: pd.Series) -> pd.Series:
    known = worker_cache("shapes")
    if len(known) > 100_000:
        known.clear()
    return shapes.map(lambda s: None if s is None else known[s] if s in known else known.setdefault(s, fingerprint(shape_paths(s))))


def canonical(records: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Add ``layout`` (name), ``fingerprint`` and ``turns`` to rows with a record each: a JSON text or a struct.

    The field paths of a struct are those of its type; those of a JSON text are found row by row, and only its
    shape goes to Python to be hashed. The fingerprint then picks one of the known mappings.
    """
    known = {fingerprint(list(paths)): name for name, (paths, _) in LAYOUTS.items()}
    kind = records.schema[payload_col].dataType
    turns, layout, print_col = F.lit(None).cast(TURNS), F.lit(None).cast("string"), "fingerprint"
    if isinstance(kind, T.StructType):
        mark = fingerprint(field_paths(kind))
        if mark in known:
            turns, layout = LAYOUTS[known[mark]][1](_Struct(column(payload_col))).cast(TURNS), F.lit(known[mark])
        return records.withColumns({print_col: F.lit(mark), "layout": layout, "turns": turns})
    parsed, shape = spare([*records.columns, print_col, "layout", "turns"], "parsed", "shape")
    v = records.withColumn(parsed, F.try_parse_json(column(payload_col))).withColumn(shape, variant_shape(F.col(parsed)))
    v = v.withColumn(print_col, _shape_print(F.col(shape)))
    for mark, name in known.items():
        at = F.col(print_col) == mark
        layout = F.when(at, name).otherwise(layout)
        turns = F.when(at, LAYOUTS[name][1](F.col(parsed)).cast(TURNS)).otherwise(turns)
    return v.withColumns({"layout": layout, "turns": turns}).drop(parsed, shape)


# ---- layouts of one row a turn --------------------------------------------------------------

#: Columns of a row-a-turn table: conversation, order, role, text.
ROW_LAYOUTS = {
    fingerprint(["conv_id", "turn", "role", "text"]): ("conv_id", "turn", "role", "text"),
    fingerprint(["conversation_id", "index", "role", "content"]): ("conversation_id", "index", "role", "content"),
    fingerprint(["thread", "position", "from", "value"]): ("thread", "position", "from", "value"),
}


def records_of_rows(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``record`` of a table with one row a turn, its columns found by fingerprint.

    The record nests the ``turns`` in order, role and text of each. Extra columns are ignored if a known
    layout is contained. A conversation is one output record, so its turns meet in one task; map-side
    nothing but role, text and order is sent.
    """
    have = set(field_paths(rows.schema))
    mark = fingerprint(sorted(have))
    fits = ROW_LAYOUTS.get(mark) or next((c for c in ROW_LAYOUTS.values() if set(c) <= have), None)
    if fits is None:
        raise ValueError(f"no layout for columns {sorted(have)}")
    conv, turn, role, text = fits
    turn_row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(turn_row))
    turns = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.struct(turns.alias("turns")).alias("record"))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``fingerprint``, ``layout`` and ``turns`` of a table with one row a turn: its records by :func:`canonical`."""
    return canonical(records_of_rows(rows), "record").drop("record")


# ---- template -------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def render(convs: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``, the places of assistant texts in it (code points)."""
    pieces = F.transform(
        F.coalesce(F.col(turns_col), F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(START), _escape_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long").alias("at"),
        F.when(
            p["loss"],
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).cast("long").alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("end")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return (
        convs.withColumn("__p", pieces)
        .withColumn("formatted", F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
        .withColumn("loss_spans", F.aggregate("__p", zero, step, lambda a: a["spans"]))
        .drop("__p")
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation; inverse of :func:`render`."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            _unescape_role(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
