"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

The layout of a table or of a JSON record is the set of its nested field paths, arrays
as `[]`, over all elements and all depths. Paths that no mapping knows are extras and
are left out; the hash of the sorted rest, the fingerprint, selects a mapping: an SQL
expression that gives array<struct<role, text>>. Mappings of kind `record` give the turns
of one record, mappings of kind `row` the one turn of a row, and rows are then grouped.
A table is fingerprinted once, from its schema; JSON records one by one, from the schema
of the parsed variant, which is the union over all elements of an array. Turns are rendered
with a template that marks each turn and escapes its control strings inside texts.

Defined cases: a null text or role is empty; turns with equal or null number are put
in order of role and text, nulls first; repeated rows are repeated turns; a table of
unknown layout is an error; a JSON record of unknown layout or that doesn't parse has
null turns and is kept; an empty list of messages is a record without turns; an empty
table gives an empty result; other columns and fields, whatever their names, don't matter.
A conversation is one document, so its turns do meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: '&' first, so that what it writes is not taken for an escape of the text's own; then the first characters of control strings, of this template and of others ("</s>", "[INST]").
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("\n", "&NewLine;"))
TURNS = "array<struct<role string, text string>>"


class Mapping(NamedTuple):
    """paths: the layout; kind: `record` or `row`; turns: SQL over the fields of `r`, the turns of a record or the turn of a row; key, order: of rows, what a conversation and a place in it are."""

    paths: tuple[str, ...]
    kind: str
    turns: str
    key: str = ""
    order: str = ""


def _pair(asked: str, told: str) -> str:
    return f"array(struct('user' AS role, {asked} AS text), struct('assistant' AS role, {told} AS text))"


_NAMES = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
_ASKED = "CASE WHEN coalesce(r.input, '') = '' THEN r.instruction ELSE concat(r.instruction, '\\n\\n', r.input) END"
MAPPINGS = (
    Mapping(("conv_id", "role", "text", "turn"), "row", "struct(r.role AS role, r.text AS text)", "conv_id", "turn"),
    Mapping(("messages[].content", "messages[].role"), "record", "transform(r.messages, m -> struct(m.role AS role, m.content AS text))"),
    Mapping(("messages[].content[].text", "messages[].content[].type", "messages[].role"), "record", "transform(r.messages, m -> struct(m.role AS role, array_join(transform(from_json(m.content, 'array<struct<text string>>'), p -> coalesce(p.text, '')), '') AS text))"),
    Mapping(("messages[]",), "record", "array()"),
    Mapping(("conversations[].from", "conversations[].value"), "record", f"transform(r.conversations, m -> struct({_NAMES} AS role, m.value AS text))"),
    Mapping(("conversations[]",), "record", "array()"),
    Mapping(("prompt", "response"), "record", _pair("r.prompt", "r.response")),
    Mapping(("completion", "prompt"), "record", _pair("r.prompt", "r.completion")),
    Mapping(("instruction", "output"), "record", _pair("r.instruction", "r.output")),
    Mapping(("input", "instruction", "output"), "record", _pair(_ASKED, "r.output")),
    Mapping(("answer", "question"), "record", _pair("r.question", "r.answer")),
)
RECORD = "messages array<struct<role string, content string>>, conversations array<struct<`from` string, value string>>, prompt string, response string, completion string, instruction string, input string, output string, question string, answer string"


def fingerprint(paths: Iterable[str], kind: str = "record") -> str:
    """The hash of those of the paths that a mapping of this kind knows."""
    return hashlib.sha256("\n".join(sorted(known(kind) & set(paths))).encode()).hexdigest()


def known(kind: str) -> set[str]:
    return {p for m in MAPPINGS if m.kind == kind for p in m.paths}


def select(kind: str) -> dict[str, Mapping]:
    """The mappings of a kind by their fingerprint."""
    return {fingerprint(m.paths, kind): m for m in MAPPINGS if m.kind == kind}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def record_paths(json: Column) -> Column:
    """The field paths of a JSON record, as field_paths() has them of a schema; null if it doesn't parse.

    The variant's schema is read token by token: a name opens a path, an array one more for its elements, and the end of a value closes the last.
    """
    token = r"(?:`(?:[^`]|``)*`|[^\s`<>:,]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"
    tokens = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(json)), F.lit(token), F.lit(0))
    zero = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(a, t):
        top, closed = F.element_at(a["open"], -1), F.slice(a["open"], F.lit(1), F.greatest(F.lit(0), F.size(a["open"]) - 1))
        name = F.replace(F.regexp_replace(F.substr(t, F.lit(1), F.length(t) - 2), "^`|`$", ""), F.lit("``"), F.lit("`"))
        opened = F.when(t.endswith(": "), F.concat(a["open"], F.array(F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))))).when(t == "ARRAY<", F.concat(a["open"], F.array(F.concat(top, F.lit("[]"))))).when(t == "OBJECT<", a["open"]).otherwise(closed)
        leaf = ~(t.endswith(": ") | t.isin("OBJECT<", "ARRAY<", ">"))
        return F.struct(opened.alias("open"), F.when(leaf, F.concat(a["paths"], F.array(top))).otherwise(a["paths"]).alias("paths"))

    return F.aggregate(tokens, zero, step)["paths"]


def record_fingerprint(json: Column) -> Column:
    own = F.array(*map(F.lit, sorted(known("record"))))
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(record_paths(json), own)), "\n"), 256)


def canonical_json(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds `layout` (the fingerprint) and `turns`, the canonical turns of each JSON record."""
    r = records.select(F.struct("*").alias("own"), record_fingerprint(F.col(column)).alias("layout"), F.from_json(column, RECORD).alias("r"))
    turns = F.lit(None).cast(TURNS)
    for told, m in select("record").items():
        turns = F.when(F.col("layout") == told, F.expr(m.turns).cast(TURNS)).otherwise(turns)
    return r.select(*[F.col(f"own.`{c}`") for c in records.columns if c not in ("layout", "turns")], "layout", turns.alias("turns"))


def canonical(table: DataFrame) -> DataFrame:
    """A typed table of any known layout -> turns, and conv_id if it has one row a turn; the fingerprint of its schema selects the mapping."""
    paths = field_paths(table.schema)
    for kind in ("row", "record"):
        m = select(kind).get(fingerprint(paths, kind))
        if m is not None and m.kind == "record":
            return table.select(F.struct("*").alias("r")).select(F.expr(m.turns).cast(TURNS).alias("turns"))
        if m is not None:
            turn = table.select(F.col(f"`{m.key}`").alias("conv_id"), F.col(f"`{m.order}`").alias("n"), F.struct("*").alias("r")).select("conv_id", "n", F.expr(m.turns).alias("t"))
            blank = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit("")).alias(c)
            in_order = F.array_sort(F.collect_list(F.struct(F.col("n").isNotNull().alias("k"), F.col("n"), blank("role"), blank("text"))))
            return turn.groupBy("conv_id").agg(in_order.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    raise ValueError(f"no mapping for the layout {sorted(paths)}")


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_mask`, the (start, end) code points of each text of the role to train on, from `turns`."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == trained, F.lit(False)).alias("loss")))
    c = conversations.withColumn("_parts", parts)
    one = lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))
    lengths = F.transform("_parts", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), p["loss"].alias("loss")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<turn int, start int, end int>>)").alias("spans"), F.lit(0).alias("i"))
    step = lambda a, p: F.struct((a["at"] + p["h"] + p["b"] + len(CLOSE)).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(a["i"].alias("turn"), (a["at"] + p["h"]).alias("start"), (a["at"] + p["h"] + p["b"]).alias("end"))))).otherwise(a["spans"]).alias("spans"), (a["i"] + 1).alias("i"))
    return c.withColumn("formatted", F.array_join(F.transform("_parts", one), "")).withColumn("loss_mask", F.aggregate(lengths, zero, step)["spans"]).drop("_parts")


def read_back(c: DataFrame) -> DataFrame:
    """From `formatted` and `loss_mask` alone: read_turns (role, text), and loss_text, what stands under the mask."""
    body = F.expr(f"substring(formatted, 1, length(formatted) - {len(CLOSE)})")
    parts = F.when(F.length("formatted") > 0, F.split(body, r"<\|im_end\|>\n", -1)).otherwise(F.array().cast("array<string>"))
    turn = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"))
    under = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return c.withColumn("read_turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(under, ""))


def digest(c: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
