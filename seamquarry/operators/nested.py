"""Deeply nested JSON to related flat tables, in one pass.

A depth-first visitor walks each value once and emits tagged rows: the table's tag, the object's own key (record key and
path), its parent's key, and the scalar fields as payload. `write_tables` writes them partitioned by tag; `read_table` reads
one tag's table back with typed columns, by the schema of all rows of that tag.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

TAGGED = "origin string, record_key string, tag string, path string, parent_path string, in_array boolean, payload string"
BOM = "\ufeff"
sys.set_int_max_str_digits(0)  # a long number is whole JSON as well


def _clean(s: str) -> str:
    """Lone surrogates, which JSON may escape but no UTF-8 can hold, become question marks."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _no_constant(name: str) -> None:
    raise ValueError(name)


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")


def deep_json(text: str):
    """The value of a whole JSON text by a stack of its own, for texts nested deeper than the plain parser goes; ValueError if it isn't whole."""
    top: list = []
    stack: list = [top]
    at, want = _BLANK.match(text).end(), "value"
    keys: list = [None]

    def put(v) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = v
        else:
            stack[-1].append(v)

    while at < len(text):
        c = text[at]
        if want == "next" and len(stack) > 1 and c == ",":
            want, at = ("key" if isinstance(stack[-1], dict) else "value"), at + 1
        elif want in ("next", "first") and len(stack) > 1 and c == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop(), keys.pop()
            want, at = "next", at + 1
        elif want == "key" or want == "first" and isinstance(stack[-1], dict):
            if c != '"':
                raise ValueError("key")
            keys[-1], at = json.decoder.scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("colon")
            want, at = "value", at + 1
        elif want in ("value", "first"):
            if c in "{[":
                new: dict | list = {} if c == "{" else []
                put(new)
                stack.append(new), keys.append(None)
                want, at = "first", at + 1
            elif c == '"':
                v, at = json.decoder.scanstring(text, at + 1, True)
                put(v)
                want = "next"
            elif m := _SCALAR.match(text, at):
                put(json.loads(m[0]))
                want, at = "next", m.end()
            else:
                raise ValueError("value")
        else:
            raise ValueError("end")
        at = _BLANK.match(text, at).end()
    if len(stack) > 1 or len(top) != 1 or want != "next":
        raise ValueError("not whole")
    return top[0]


def _loaded(text: str):
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return deep_json(text)


def whole_json(text: str | None):
    """The value of a whole JSON text, decoded again where it was encoded twice; ValueError if it isn't whole JSON.

    A leading byte-order mark is ignored. NaN and Infinity are not JSON. Any depth of nesting is read.
    """
    if text is None:
        raise ValueError("null")
    value = _loaded(text.removeprefix(BOM))
    return _loaded(value.removeprefix(BOM)) if isinstance(value, str) else value


def visit(value) -> Iterator[tuple[str, str, str | None, bool, dict]]:
    """tag, path, parent path, whether it is an array's element, scalar fields: one for each object, parents first.

    The tag is the path without its positions. The parent is the nearest object above; the top object has the path ''.
    Scalars in arrays stay with the object that holds the array, as an array.
    """
    stack = [(value, "", "", None, False)]
    while stack:
        node, path, tag, parent, element = stack.pop()
        if isinstance(node, dict):
            flat, deeper = {}, []
            for k, v in node.items():
                if isinstance(v, dict) or (isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v)):
                    deeper.append((v, f"{path}.{k}" if path else k, f"{tag}.{k}" if tag else k, path, False))
                else:
                    flat[k] = v
            yield tag, path, parent, element, flat
            stack += reversed(deeper)
        elif isinstance(node, list):
            stack += reversed([(v, f"{path}[{i}]", f"{tag}[]", parent, True) for i, v in enumerate(node) if isinstance(v, (dict, list))])


def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """origin, record_key, text to TAGGED rows; a text that isn't whole JSON gives one row with the tag '#broken'."""
    cols = ["origin", "record_key", "tag", "path", "parent_path", "in_array", "payload"]
    for b in batches:
        out = []
        for origin, key, text in zip(b["origin"], b["record_key"], b["text"]):
            try:
                value = whole_json(text)
            except ValueError:
                out.append((origin, key, "#broken", "", None, False, None))
                continue
            out += [(origin, key, _clean(tag), _clean(path), parent and _clean(parent), element, _clean(json.dumps(flat, ensure_ascii=False))) for tag, path, parent, element, flat in visit(value)]
        yield pd.DataFrame(out, columns=cols)


def emit_elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As `emit`, but only the keys of objects that are array elements: nothing is serialised that nobody reads."""
    for b in batches:
        o, k, p = [], [], []
        for origin, key, text in zip(b["origin"], b["record_key"], b["text"]):
            try:
                value = whole_json(text)
            except ValueError:
                continue
            for _, path, _, element, _ in visit(value):
                if element:
                    o.append(origin), k.append(key), p.append(_clean(path))
        yield pd.DataFrame({"origin": o, "record_key": k, "child_path": p}, dtype=object)


def json_texts(sarif: DataFrame, log: DataFrame) -> DataFrame:
    """origin, record_key, text of both nested columns."""
    a = sarif.select(F.lit("sarif").alias("origin"), F.col("report_id").cast("string").alias("record_key"), F.col("payload").alias("text"))
    b = log.select(F.lit("runlog").alias("origin"), F.col("record_id").alias("record_key"), F.col("attributes").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull() & F.col("record_key").isNotNull())


def flatten(texts: DataFrame) -> DataFrame:
    """TAGGED rows of each distinct record. Null texts give none; repeated rows count once; payload is a JSON object."""
    return texts.select("origin", "record_key", "text").mapInPandas(emit, TAGGED).distinct()


def array_elements(texts: DataFrame) -> DataFrame:
    """origin, record_key, child_path: each object that is an element of an array, at any depth, once.

    Only texts with a bracket can hold an array, so the others don't leave the JVM (the bracket may be escaped where the
    text is encoded twice).
    """
    may = F.col("text").contains("[") | F.lower("text").contains("\\u005b")
    return texts.where(may).select("origin", "record_key", "text").mapInPandas(emit_elements, "origin string, record_key string, child_path string").distinct()


def _part(tag: Column) -> Column:
    """The partition of a tag; its hash, as tags may be empty, long or different in case only."""
    return F.concat(F.lit("t"), F.md5(tag))


def write_tables(tagged: DataFrame, path: str) -> None:
    """TAGGED rows to Parquet files, partitioned by tag."""
    tagged.withColumn("part", _part(F.col("tag"))).write.partitionBy("part").parquet(path)


def schemas(tagged: DataFrame) -> DataFrame:
    """tag, field, type: each field of each tag with the one type that holds its values in all rows; fields of mixed types or only nulls are strings."""
    v = tagged.select("tag", F.try_parse_json("payload").alias("v"))
    fields = v.lateralJoin(tagged.sparkSession.tvf.variant_explode(F.col("v").outer())).select("tag", F.col("key").alias("field"), "value")
    kind = F.lower(F.schema_of_variant_agg("value"))
    return fields.groupBy("tag", "field").agg(F.regexp_replace(kind, "variant|void", "string").alias("type"))


def _rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("part") == _part(F.lit(tag))) & (F.col("tag") == tag))


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """origin, record_key, path, parent_path, in_array and the fields of one tag, typed; a name that is taken, whatever its case, gets a number.

    Arrays of scalars are array columns; `read_array` has them as rows.
    """
    rows = _rows(spark, path, tag)
    keys = ["origin", "record_key", "path", "parent_path", "in_array"]
    taken, source, named = set(keys), [], []
    for field, kind in sorted((r.field, r.type) for r in schemas(rows).collect()):
        name, n = field, 1
        while name.lower() in taken:
            n += 1
            name = f"{field}_{n}"
        taken.add(name.lower())
        source.append(StructField(field, DataType.fromDDL(kind)))
        named.append(StructField(name, DataType.fromDDL(kind)))
    if not source:
        return rows.select(*keys)
    return rows.select(*keys, F.from_json("payload", StructType(source)).cast(StructType(named)).alias("fields")).select(*keys, "fields.*")


def read_array(spark: SparkSession, path: str, tag: str, column: str) -> DataFrame:
    """origin, record_key, path, position, value: the elements of one array column of a tag's table, from position 0."""
    return read_table(spark, path, tag).select("origin", "record_key", "path", F.posexplode(F.col("`" + column.replace("`", "``") + "`")).alias("position", "value"))
