"""Deeply nested records to related flat tables (tagged emission in a single pass).

`emit_nodes` visits each payload depth first and emits one row for every node: a table tag, the node's path (primary
key), its parent's path (foreign key) and the node's own payload without the child nodes. `flatten_to` writes the rows
partitioned by tag; `typed_table` applies a tag's schema.

Defined results for odd input: a null, blank, damaged or non-object payload gives no row; blanks and byte order marks
around the JSON and JSON wrapped in JSON strings (any number of times) are read through; of a repeated key the last
value counts; NaN and Infinity are not JSON; null elements are no nodes but keep their index; a non-null element that
is no object is a node without children; a child list that is no list has no elements. Nesting of any depth is
visited with an explicit stack. Other columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT, SUB, DETECTION, FRAME, BOX = "object", "sub_object", "detection", "frame", "box"
NODE_SCHEMA = "record_id long, tag string, node_path string, parent_path string, payload string"

#: Characters of emitted rows that are held before they go on.
FLUSH = 8_000_000
_BLANK = " \t\r\n﻿"
_TOKEN = re.compile(r"[ \t\r\n]*(?:([{}\[\],:])|(\")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))")


_encode = json.JSONEncoder(ensure_ascii=False, check_circular=False).encode


def _refuse(name: str):
    raise ValueError(name)


def _number(text: str):
    return float(text) if any(c in text for c in ".eE") else int(text)


def parse_deep(text: str):
    """A JSON parser without recursion, for documents nested deeper than the interpreter's own limit."""
    at, stack, key, expect = 0, [], None, "value"
    result = None
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if expect == "end" and not text[at:].strip(" \t\r\n"):
                return result
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, quote, number, word = m.groups()
        if expect == "end":
            raise ValueError("text after the JSON")
        if quote:
            value, at = scanstring(text, at, True)
            if expect in ("key", "key or end"):
                key, expect = value, "colon"
                continue
        elif number is not None:
            value = _number(number)
        elif word:
            value = {"true": True, "false": False, "null": None}[word]
        elif sign == ":" and expect == "colon":
            expect = "value"
            continue
        elif sign == "," and expect == "comma":
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif sign in "{[" and expect in ("value", "value or end"):
            stack.append(({} if sign == "{" else [], key))
            expect = "key or end" if sign == "{" else "value or end"
            continue
        elif sign in "}]" and stack and expect in ("comma", "key or end", "value or end") and isinstance(stack[-1][0], dict) == (sign == "}"):
            value, key = stack.pop()
            expect = "value"
        else:
            raise ValueError(f"unexpected {sign!r} at {at}")
        if expect not in ("value", "value or end"):
            raise ValueError(f"unexpected value at {at}")
        if not stack:
            result, expect = value, "end"
        else:
            top = stack[-1][0]
            if isinstance(top, dict):
                top[key] = value
            else:
                top.append(value)
            expect = "comma"


def read_payload(text: str | None):
    """The object that a payload holds, or None where it holds no complete JSON object."""
    value = text
    while isinstance(value, str):
        value = value.strip(_BLANK)
        if value[:1] not in ("{", '"'):
            return None
        try:
            value = json.loads(value, parse_constant=_refuse)
        except RecursionError:
            try:
                value = parse_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


def visit(root: dict) -> Iterator[tuple[str, str, str, str | None]]:
    """(tag, node path, parent path, payload) of every node, depth first in document order."""
    def dump(value, without):
        if without and isinstance(value, dict):
            value = {k: x for k, x in value.items() if k not in without}
        return _encode(value)

    stack = [(ROOT, "$", "", root)]
    while stack:
        tag, path, parent, value = stack.pop()
        children = []
        if tag in (ROOT, SUB):
            without = ("mSubObjectMetadatas", "mDetectedObjectMetadatas", "mFrame")
            if isinstance(value, dict):
                if value.get("mFrame") is not None:
                    children.append((FRAME, f"{path}/frame", path, value["mFrame"]))
                for key, letter, kind in (("mDetectedObjectMetadatas", "d", DETECTION), ("mSubObjectMetadatas", "s", SUB)):
                    if isinstance(value.get(key), list):
                        children += [(kind, f"{path}/{letter}{i}", path, x) for i, x in enumerate(value[key]) if x is not None]
        elif tag == DETECTION:
            without = ("mBox",)
            if isinstance(value, dict) and value.get("mBox") is not None:
                children.append((BOX, f"{path}/box", path, value["mBox"]))
        else:
            without = ()
        yield tag, path, parent, dump(value, without)
        stack.extend(reversed(children))


def emit_nodes(df: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """One tagged row for every node of every payload: record_id, tag, node_path, parent_path, payload. No shuffle."""
    names = ["record_id", "tag", "node_path", "parent_path", "payload"]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64())] + [pa.array(c, pa.string()) for c in out[1:]], names)

    def run(batches):
        for batch in batches:
            out, size = [[], [], [], [], []], 0
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = read_payload(text.as_py())
                if root is None:
                    continue
                for tag, path, parent, body in visit(root):
                    out[0].append(rid)
                    out[1].append(tag)
                    out[2].append(path)
                    out[3].append(parent)
                    out[4].append(body)
                    size += len(path) + len(parent) + len(body)
                    if size > FLUSH:  # a deep record's paths may be long
                        yield batch_of(out)
                        out, size = [[], [], [], [], []], 0
            yield batch_of(out)

    source = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(payload_col).cast("string").alias("payload"))
    return source.mapInArrow(run, NODE_SCHEMA)


#: Fields of each flat table; values of another type become null under `typed_table`.
TABLE_FIELDS = {
    FRAME: "mChannelId int, mFrameId long, mTimestamp long, mWidth int, mHeight int, mEndOfStream boolean, mSpData string",
    BOX: "mX int, mY int, mWidth int, mHeight int",
    DETECTION: "mScores array<float>, mClassify int, mLabelName string",
    ROOT: "mFps double, mSubId int, mGraphId int",
    SUB: "mFps double, mSubId int, mGraphId int",
}


def typed_table(nodes: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag with its schema applied; keys record_id, node_path, parent_path stay first."""
    body = F.from_json("payload", TABLE_FIELDS[tag])
    return nodes.where(F.col("tag") == tag).select("record_id", "node_path", "parent_path", body.alias("f")).select("record_id", "node_path", "parent_path", "f.*")


def flatten_to(df: DataFrame, path: str) -> None:
    """Writes the nodes of all payloads below `path`, partitioned by tag, in one pass over the input."""
    emit_nodes(df).write.mode("overwrite").partitionBy("tag").parquet(path)
