"""Decoded app records that own a context breakdown (tools doubao and doubaowork)."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring_ascii

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import fixed
from usagelens.functions import variants as V
from usagelens.functions.names import basename, normalize_model
from usagelens.functions.times import to_millis
from usagelens.sources.lines import as_rows

_OWNED = "context_window_usage"
_TOTALS = ["total_tokens", "used_tokens"]
_PARTS = ["system_prompt", "messages", "skills", "tools"]
_TIME = ["create_time_ms", "create_time", "createTime", "update_time_ms", "querySendTimestamp"]
_CONVERSATION = ["conversation_id", "local_conversation_id", "conversationId"]
_MESSAGE = ["message_id", "local_message_id", "uniqueId"]
_MODEL = ["model_id", "llm_model_type", "model_type", "model_name"]
_FOLDER = ["workspace", "agent_workspace", "shared_folder_path", "folder", "cwd"]
_PARAMS = ["general_task_param", "agent_task_param", "task_param"]
#: bytes of owners that a task hands back at once
_BATCH_BYTES = 4 << 20
#: Spark's JSON parser takes 1,000 levels; json.loads may need a call for each
_CALLS = 4000


def rejected_records(records: DataFrame) -> DataFrame:
    """Records that mention a breakdown and are no JSON: (tool, value, reason)."""
    bad = F.col("value").contains(_OWNED) & V.parse(F.col("value")).isNull()
    return records.filter(bad).select("tool", "value", F.lit("malformed").alias("reason"))


_FIELDS = _TIME + _CONVERSATION + _MESSAGE + _MODEL + _FOLDER + _PARAMS
_RANK = {name: i for i, name in enumerate(_FIELDS)}
_FIELD_SET = frozenset(_FIELDS)
_FACT = "struct<depth:int,name:string,number:boolean,value:variant>"


def _shape(names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:variant" for n in names) + ">"


_WALKED = "tool string, held string, depth int, above string"


class _Raw(str):
    """JSON text that stands as it is: a number of the record, so that Spark reads it as it was written."""


_JSON = json.JSONDecoder(parse_float=_Raw, parse_int=_Raw, strict=False)
_LITERALS = {True: "true", False: "false", None: "null"}


def _text(value: object) -> str:
    """JSON text of a decoded value, without recursion."""
    if type(value) is _Raw:
        return value
    out, rest = [], [value]
    while rest:
        v = rest.pop()
        kind = type(v)
        if kind is str:
            out.append(encode_basestring_ascii(v))
        elif kind is _Raw:
            out.append(v)
        elif kind is dict or kind is list:
            parts = [_Raw("{" if kind is dict else "[")]
            for inner in v:
                if len(parts) > 1:
                    parts.append(_Raw(","))
                parts += [_Raw(f"{encode_basestring_ascii(inner)}:"), v[inner]] if kind is dict else [inner]
            parts.append(_Raw("}" if kind is dict else "]"))
            rest += reversed(parts)
        else:
            out.append(_LITERALS[v])
    return "".join(out)


class _Opened:
    """An object on the way down, with the next object above that is kept; its text is made once, for the first owner below."""

    __slots__ = ("value", "depth", "above", "text")

    def __init__(self, value: dict, depth: int, above: _Opened | None):
        self.value, self.depth, self.above, self.text = value, depth, above, None


def _facts(opened: _Opened) -> str:
    """Direct fields of an object that an event may take something from; they are few, whatever else it holds."""
    facts, v = [], opened.value
    for name in sorted(_FIELD_SET.intersection(v), key=_RANK.__getitem__):
        value = v[name]
        number = "true" if type(value) is _Raw else "false"
        text = encode_basestring_ascii(value) if type(value) is str else _text(value)
        facts.append(f'{{"depth":{opened.depth},"name":"{name}","number":{number},"value":{text}}}')
    return ",".join(facts)


def _owning(record: str, skip: Callable[[dict], bool]) -> Iterator[tuple[object, int, _Opened | None]]:
    """Every breakdown in a record, with the depth of its owner (the count of objects down to it) and the nearest
    object, owner included, that ``skip`` leaves. Any depth is searched, each value once.
    """
    rest = [(_JSON.raw_decode(record.lstrip(" \t\r\n"))[0], 0, None)]
    while rest:
        v, depth, above = rest.pop()
        if type(v) is dict:
            depth += 1
            if not skip(v):
                above = _Opened(v, depth, above)
            if _OWNED in v:
                yield v[_OWNED], depth, above
            v = v.values()
        for inner in v:
            if type(inner) is dict or type(inner) is list:
                rest.append((inner, depth, above))


def _walk(records: DataFrame, skip: Callable[[dict], bool], render: Callable[[_Opened], str]) -> DataFrame:
    """Owners of a breakdown: (tool, held, depth, above). ``held`` is the breakdown and ``above`` a list, nearest first,
    of what ``render`` makes of the objects down to the owner that ``skip`` leaves, both as JSON text.

    Spark's parser decides what a record is. A record is decoded once more, into plain objects, and walked in one pass
    in the task, whatever its depth; as columns, every level would copy all that is below it.
    """
    spark = records.sparkSession
    # the walk costs far more than the reading, so it spreads further than the splits of the input
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    value = F.col("value")
    # bytes that are no UTF-8 become the characters that Spark's parser reads
    text = F.when(F.is_valid_utf8(value), value).otherwise(F.regexp_replace(value, "\ufffd", "\ufffd"))
    mentions = records.filter(value.contains(_OWNED)).repartition(tasks)
    valid = mentions.select("tool", V.once(F.when(V.parse(value).isNotNull(), text)).alias("value")).filter("value IS NOT NULL")

    def chain(opened: _Opened | None) -> str:
        texts = []
        while opened is not None:
            if opened.text is None:
                opened.text = render(opened)
            texts.append(opened.text)
            opened = opened.above
        return f"[{','.join(texts)}]"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _CALLS))
        for batch in batches:
            rows, size = [], 0
            for tool, record in zip(*(c.to_pylist() for c in batch.columns)):
                for held, depth, opened in _owning(record, skip):
                    rows.append((tool, _text(held), depth, chain(opened)))
                    size += len(rows[-1][1]) + len(rows[-1][3])
                    if size > _BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return valid.mapInArrow(walk, _WALKED)


def _batch(rows: list[tuple[str | None, str, int, str]]) -> pa.RecordBatch:
    tool, held, depth, above = zip(*rows)
    columns = [pa.array(tool, pa.string()), pa.array(held, pa.string()), pa.array(depth, pa.int32()), pa.array(above, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["tool", "held", "depth", "above"])


def owners(records: DataFrame, levels: int | None = None) -> DataFrame:
    """Every object that directly owns a context breakdown, with its ancestors, nearest first.

    Malformed records have no owners, see :func:`rejected_records`. All ``levels`` are searched in one pass, so their
    number makes no difference.
    """
    found = _walk(records, lambda v: False, lambda opened: _text(opened.value))
    return found.select("tool", V.get(F.parse_json("above"), "$", "array<variant>").alias("chain"))


def _named(facts: Column, names: list[str]) -> Column:
    return F.filter(facts, lambda f: f["name"].isin(*names))


def _first(values: Column) -> Column:
    """First value that is not null: by object (nearest first), then by field name."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _first_id(facts: Column, names: list[str]) -> Column:
    """First text or number that is not blank."""
    texts = F.transform(_named(facts, names), lambda f: F.trim(V.get(f["value"], "$", "string")))
    return F.get(F.filter(texts, lambda x: x != ""), F.lit(0))


def _number_or_text(value: Column, is_number: Column) -> Column:
    """A value converted once, as what it is; text of a number says no more than the number."""
    return F.struct(
        F.when(is_number, V.get(value, "$", "double")).alias("number"),
        F.when(~is_number, V.get(value, "$", "string")).alias("text"),
    )


def _counts(v: Column, names: list[str]) -> Column:
    """Array of token counts by name: non-negative safe integers, or text of up to 15 digits; others are null."""
    fields = F.array(V.get(v, "$", _shape(names)))
    values = F.flatten(F.transform(fields, lambda o: F.array(*[o[n] for n in names])))
    kinds = F.transform(values, lambda x: F.struct(x.alias("value"), V.is_number(x, "$").alias("number")))
    typed = F.transform(kinds, lambda x: _number_or_text(x["value"], x["number"]))

    def count(t: Column) -> Column:
        number, text = t["number"], t["text"]
        whole = (number == F.floor(number)) & number.between(0, float(fixed.MAX_SAFE_INTEGER))
        return F.when(whole, number.cast("long")).when(text.rlike(r"^\d{1,15}$"), text.try_cast("long"))

    return F.transform(typed, count)


def _tokens(counts: Column) -> Column:
    """An explicit total, else the sum of the parts; ``counts`` are those of ``_TOTALS`` and ``_PARTS``."""
    totals, parts = F.slice(counts, 1, len(_TOTALS)), F.slice(counts, len(_TOTALS) + 1, len(_PARTS))
    summed = F.aggregate(parts, F.lit(0).cast("long"), lambda total, n: total + F.coalesce(n, F.lit(0)))
    return F.coalesce(_first(totals), summed)


def _absolute(path: Column) -> Column:
    return F.when((F.length(path) > 1) & path.rlike(r"^(/|[A-Za-z]:[\\/])"), path)


def _folders(facts: Column) -> Column:
    """Working folders that fields name, directly or, a task parameter, in the object it holds as text."""
    texts = F.transform(
        _named(facts, [*_FOLDER, *_PARAMS]),
        lambda f: F.struct(f["name"].isin(*_PARAMS).alias("inside"), V.get(f["value"], "$", "string").alias("text")),
    )

    def folder(t: Column) -> Column:
        inside = F.transform(
            F.array(V.get(V.parse(t["text"]), "$", _shape(_FOLDER))),
            lambda o: F.coalesce(*[_absolute(V.text(o[n], "$")) for n in _FOLDER]),
        )
        return F.when(t["inside"], F.get(inside, F.lit(0))).otherwise(_absolute(t["text"]))

    return F.transform(texts, folder)


def norm_context_records(records: DataFrame, now_ms: int) -> DataFrame:
    """One event per distinct breakdown of a reply: its input context, without output.

    ``records`` has tool and value (decoded JSON text).
    """
    facts, held = F.col("above"), F.col("held")
    raw_text = V.text(held, "$")
    found = _walk(records, _FIELD_SET.isdisjoint, _facts).select(
        "tool",
        "depth",
        V.once(F.struct(V.get(F.parse_json("above"), "$", f"array<{_FACT}>").alias("above"), F.parse_json("held").alias("held"))).alias("o"),
    )
    rows = found.select("tool", "depth", "o.*").select(
        "tool",
        "depth",
        "above",
        V.once(F.struct(F.coalesce(V.parse(raw_text), held).alias("u"), F.coalesce(raw_text, F.to_json(held)).alias("u_text"))).alias("o"),
    )
    rows = rows.select("tool", "depth", "above", "o.*")
    u = F.col("u")
    counts = F.transform(F.array(_counts(u, [*_TOTALS, *_PARTS])), _tokens)

    def stamp(t: Column) -> Column:
        return F.coalesce(to_millis(t["number"], now_ms), to_millis(t["text"], now_ms, is_text=True))

    times = F.transform(_named(facts, _TIME), lambda f: _number_or_text(f["value"], f["number"]))
    near = F.filter(facts, lambda f: f["depth"] >= F.col("depth") - 1)
    digest = F.substring(F.sha1("u_text"), 1, 16)
    fields = F.struct(
        F.get(counts, F.lit(0)).alias("tokens"),
        _first(F.transform(times, stamp)).alias("ts_ms"),
        _first_id(facts, _CONVERSATION).alias("conversation"),
        _first_id(facts, _MESSAGE).alias("message"),
        _first_id(near, _MODEL).alias("raw_model"),
        basename(_first(_folders(facts))).alias("project"),
        digest.alias("digest"),
    )
    flat = rows.filter(V.is_object(u, "$")).select("tool", V.once(fields).alias("f")).select("tool", "f.*")
    identity = F.coalesce("message", "digest")
    numeric = F.col("raw_model").rlike(r"^\d+$")
    shaped = flat.filter((F.col("tokens") > 0) & F.col("ts_ms").isNotNull()).select(
        F.concat_ws(":", "tool", F.coalesce("conversation", F.lit("-")), identity, "digest").alias("dedup_key"),
        "ts_ms",
        "tool",
        F.when(numeric, F.concat(F.lit("doubao-model-"), "raw_model"))
        .otherwise(normalize_model(F.col("raw_model")))
        .alias("model"),
        F.coalesce("conversation", identity).alias("session_id"),
        F.nullif(F.col("project"), F.lit("")).alias("project"),
        F.col("tokens").alias("input_tokens"),
        F.lit(0).cast("long").alias("output_tokens"),
        F.col("tokens").alias("total_tokens"),
    )
    return as_rows(shaped)
