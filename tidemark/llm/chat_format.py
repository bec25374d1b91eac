"""Chat formatting: schema fingerprints select the mapping that turns a record into canonical turns.

A record's fingerprint is a hash of its nested field paths, of those that any layout uses. Each known
layout is a declarative mapping: where the turns are, which fields hold role and text, and which fixed
prompts stand around. Canonical turns are written with a template whose control strings are escaped,
reversibly, wherever they stand in a role or text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Control strings of this and of common templates; none is left whole inside a text.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: A control string's first character is written as a backslash and a letter; so is a backslash, and a line end in a role.
CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    paths: the field paths that make its fingerprint. turns: the list field with a turn in each element
    (None: the fields below are the record's own). fields: (role, path of the text) in order, or with
    turns one pair of paths (role, text). roles: names of roles in the layout -> canonical names.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None
    fields: tuple[tuple[str, str], ...]
    roles: tuple[tuple[str, str], ...] = ()


SHARE_ROLES = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"))
LAYOUTS = [
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), None, (("role", "text"),)),
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", (("role", "content"),)),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", (("from", "value"),), SHARE_ROLES),
    Mapping("instruction", ("instruction", "output"), None, (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), None, (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt_completion", ("prompt", "completion"), None, (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), None, (("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), None, (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("question", "answer"), None, (("user", "question"), ("assistant", "answer"))),
]
#: Paths that a layout uses, and its list of turns where that is empty.
KNOWN_PATHS = {p for m in LAYOUTS for p in (*m.paths, *([f"{m.turns}[]"] if m.turns else []))}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths & KNOWN_PATHS)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint({*m.paths}): m for m in LAYOUTS} | {fingerprint({f"{m.turns}[]"}): m for m in LAYOUTS if m.turns}


def mapping_of(paths: set[str]) -> Mapping | None:
    """The layout with the paths' fingerprint; for paths that have a whole layout and stray fields of others, the
    layout with turns in a list, else the one with the most fields (ties: the first). Found once for each fingerprint."""
    mark = fingerprint(paths)
    if mark not in BY_FINGERPRINT:
        inside = [m for m in LAYOUTS if paths.issuperset(m.paths)]
        BY_FINGERPRINT[mark] = max(inside, key=lambda m: (m.turns is not None, len(m.paths)), default=None)
    return BY_FINGERPRINT[mark]


def record_mapping(record) -> Mapping | None:
    """The layout of a parsed record: by the fields that hold a value, else by all, nulls among them."""
    if not isinstance(record, dict):
        return None
    return mapping_of(value_paths(record, nulls=False)) or mapping_of(value_paths(record))


def value_paths(value, at: str = "", nulls: bool = True) -> set[str]:
    """Field paths of a parsed record; list elements are marked [], and so is an empty list itself."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if nulls or v is not None for p in value_paths(v, f"{at}.{k}" if at else k, nulls)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]", nulls)} or {f"{at}[]"}
    return {at}


def schema_paths(kind: DataType, at: str = "") -> set[str]:
    """Field paths of a DataFrame's schema, written as value_paths writes them."""
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def record_turns(record) -> list[tuple[str, str]] | None:
    """Canonical turns of a parsed record, or None if it has no layout."""
    mapping = record_mapping(record)
    if mapping is None:
        return None
    names = dict(mapping.roles)
    if mapping.turns is not None:
        role, text = mapping.fields[0]
        return [(names.get(r := _text(t.get(role)), r), _text(t.get(text))) for t in record[mapping.turns] or [] if isinstance(t, dict)]
    if mapping.name == "turn_rows":
        return [(_text(record.get("role")), _text(record.get("text")))]
    return [(role, _text(record.get(path))) for role, path in mapping.fields]


def json_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, layout, turns of JSON records of any layout; an unknown layout or bad JSON gives null for both.

    A null field is an empty text, unless the record is of a layout without it; a list without turns gives none.
    Elements of a list of turns that are not records are left out. Repeated records are converted one by one; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, turns = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                found = record_turns(record)
                layouts.append(record_mapping(record).name if found is not None else None)
                turns.append(None if found is None else [{"role": r, "text": t} for r, t in found])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(layouts, pa.string()), pa.array(turns, kind)], ["conv_id", "layout", "turns"])

    kind = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, json_col).mapInArrow(run, f"conv_id {kind}, layout string, turns array<{TURN}>")


def table_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, layout, turns of a table whose schema's fingerprint is known.

    Turn rows are gathered by conversation, ordered by turn (null first), role and text; of a table with
    one conversation a row, each row is one. Null roles and texts are empty; columns that no layout uses
    are ignored. An empty table gives an empty result; an unknown layout raises ValueError.
    """
    mapping = mapping_of(schema_paths(df.schema))
    if mapping is None:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(df.schema))}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    renamed = F.create_map(*[F.lit(x) for pair in mapping.roles for x in pair]) if mapping.roles else None
    role_name = lambda c: F.coalesce(F.element_at(renamed, text(c)), text(c)) if renamed is not None else text(c)
    turn = lambda role, t: F.struct(role.alias("role"), t.alias("text"))
    if mapping.name == "turn_rows":
        row = F.struct(F.col("turn"), text(F.col("role")).alias("role"), text(F.col("text")).alias("text"))
        grouped = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        turns = F.transform("rows", lambda r: turn(r["role"], r["text"]))
        return grouped.select("conv_id", F.lit(mapping.name).alias("layout"), turns.alias("turns"))
    if mapping.turns is not None:
        role, path = mapping.fields[0]
        turns = F.transform(F.coalesce(F.col(mapping.turns), F.array()), lambda m: turn(role_name(m[role]), text(m[path])))
    else:
        turns = F.array(*[turn(F.lit(role), text(F.col(path))) for role, path in mapping.fields])
    return df.select(F.col(id_col).alias("conv_id"), F.lit(mapping.name).alias("layout"), turns.alias("turns"))


def escaped(c: Column, line_ends: bool = False) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit(CODES["\\"]))
    for first in "<[":
        rest = "|".join(re.escape(x[1:]) for x in CONTROL if x[0] == first)
        out = F.regexp_replace(out, rf"{re.escape(first)}(?={rest})", CODES[first].replace("\\", "\\\\"))
    return F.replace(out, F.lit("\n"), F.lit(CODES["\n"])) if line_ends else out


_BACK = {v[1]: k for k, v in CODES.items()}


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, layout, formatted, loss_spans: the text and the code-point spans (start, end) under the loss mask.

    Null turns stay null; a conversation without turns is an empty text. A conversation is one row, so its texts must
    fit into one. Repeated rows are formatted one by one; other columns are ignored; an empty table stays empty.
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        more = F.when(p["loss"], F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct((b + len(CLOSE)).alias("at"), F.concat(acc["spans"], more).alias("spans"))

    done = turns.select("conv_id", "layout", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return done.select("conv_id", "layout", text.alias("formatted"), F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(MIDDLE)
        out.append((unescaped(role), unescaped(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each formatted conversation, read from its text and loss spans alone.

    A null text has null in all of them, an empty one no turns. Other columns are ignored; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns, digest = parsed(text), hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    names = ["conv_id", "layout", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "layout", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, layout string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
