"""Parsing of model output: brace-matching scanners in pandas UDFs, and the canonical graph schema in SQL.

These are the operators that built-in functions can't express: they walk characters with a state.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import constants as C

BRACE = re.compile(r"[{}]")
RELATIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("target", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)


def balanced(text: str, opening: str, at: int, quoted: bool = True) -> int:
    """One past the bracket that closes the one at ``at``; -1 if none does. quoted: brackets in strings don't count."""
    pairs = {"{": "}", "[": "]"}
    depth, inside, escaped = 0, False, False
    for i in range(at, len(text)):
        ch = text[i]
        if inside:
            inside, escaped = (True, False) if escaped else (ch != '"', ch == "\\")
        elif quoted and ch == '"':
            inside = True
        elif ch == opening:
            depth += 1
        elif ch == pairs[opening]:
            depth -= 1
            if not depth:
                return i + 1
    return -1


def first_object(text: str | None) -> str | None:
    """J-1: the first balanced object if it parses to one, else None."""
    at = (text or "").find("{")
    end = balanced(text, "{", at) if at >= 0 else -1
    if end < 0:
        return None
    try:
        json.loads(text[at:end])
    except ValueError:
        return None
    return text[at:end]


def _closes(text: str) -> dict[int, int]:
    """One past the brace that closes each brace that is closed, in one pass; braces in strings count."""
    out, open_ = {}, []
    for m in BRACE.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def all_objects(text: str) -> list[dict]:
    """J-2: relations in every outermost balanced object; wrappers with 'relations' are opened. Linear in the text."""
    out, upto = [], 0
    for at, end in sorted(_closes(text).items()):
        if at < upto:  # inside one that was taken; what is cut off has no end, so whole objects inside it are outermost
            continue
        try:
            found = json.loads(text[at:end])
        except ValueError:
            found = None
        inner = found.get("relations", [found]) if isinstance(found, dict) else []
        out += [r for r in inner or [] if isinstance(r, dict) and "source" in r and "target" in r]
        upto = end
    return out


def relation_list(text: str | None) -> list[dict] | None:
    """J-4: what a model's answer holds as relations: after its last channel mark, in a fence, or its last balanced
    array or object; whole objects of what is cut off. None where there is no bracket at all."""
    text = (text or "").strip()
    mark = C.CHANNEL_MARK
    text = text[text.rfind(mark) + len(mark) :].strip() if mark in text else text
    fence = re.search(C.FENCE, text, re.S)
    if fence:
        whole, rest = fence.group(1).strip(), fence.group(1)
    elif (at := text.rfind("[")) >= 0:
        end = balanced(text, "[", at, quoted=False)
        whole, rest = (text[at:end] if end > 0 else None), text
    elif (at := text.rfind("{")) >= 0:
        whole, rest = text[at:], text
    else:
        return None
    try:
        data = json.loads(whole) if whole else None
    except ValueError:
        data = None
    if data is None:
        return all_objects(rest)
    found = data if isinstance(data, list) else data.get("relations", []) if isinstance(data, dict) else []
    return [r for r in found or [] if isinstance(r, dict)]


def reasoned_relations(text: str | None) -> list[dict]:
    """J-5: triples written in prose, ``-> A REL B`` or ``A REL B``."""
    text = text or ""
    out = re.findall(C.ARROW_TRIPLE, text) + re.findall(C.PLAIN_TRIPLE, text)
    return [{"source": a.strip(), "type": r, "target": b.strip()} for a, r, b in out]


def _row(r: dict) -> dict:
    try:
        sure = float(r.get("confidence", 1.0))
    except (TypeError, ValueError):
        sure = 1.0
    pick = lambda *keys: next((str(r[k]) for k in keys if r.get(k)), None)
    return {
        "source": pick("source", "source_name"),
        "target": pick("target", "target_name"),
        "type": pick("type", "relation_type"),
        "confidence": sure,
    }


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(first_object, na_action=None)


def with_json_object(df: DataFrame, text: str, out: str) -> DataFrame:
    """J-1 for a table: df with ``out``, the text's first balanced object. Texts that are one whole JSON object never
    leave the JVM; only broken ones and those with words around go through the scanner."""
    bare = F.trim(F.col(text))
    # In brackets: the parser would not mind what comes after an object.
    alone = F.concat(F.lit("["), bare, F.lit("]"))
    whole = bare.startswith("{") & bare.endswith("}") & F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1)
    marked = df.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    clean = marked.where("_whole").withColumn(out, bare).drop("_whole")
    return clean.union(marked.where("not _whole").drop("_whole").withColumn(out, json_object(F.col(text))))


@F.pandas_udf(RELATIONS)
def salvaged(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [_row(r) for r in all_objects(t or "")])


@F.pandas_udf(RELATIONS)
def parsed_relations(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[dict]:
        found = relation_list(t)
        return [_row(r) for r in (reasoned_relations(t) if found is None else found)]

    return text.map(one)


def _first(obj: Column, *keys: str) -> Column:
    """The first key whose value is neither missing nor empty (nor false, zero or null)."""
    empty = ("", "false", "0", "[]", "{}")
    values = [F.get_json_object(obj, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(~v.isin(*empty), v) for v in values])


def _list(text: Column, key: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(text, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))


def normal_nodes(text: Column) -> Column:
    """J-3: array of (id, type, discovered_by) from a JSON object's nodes, whatever names its keys have."""
    nodes = F.transform(
        _list(text, "nodes"),
        lambda n: F.struct(
            _first(n, *C.NODE_NAMES).alias("id"),
            F.coalesce(_first(n, *C.NODE_TYPES), F.lit("Unknown")).alias("type"),
            _first(n, "discovered_by").alias("discovered_by"),
        ),
    )
    return F.filter(nodes, lambda n: n["id"].isNotNull())


def normal_edges(text: Column) -> Column:
    """J-3: array of (source, target, type)."""
    edges = F.transform(
        _list(text, "edges"),
        lambda e: F.struct(
            _first(e, *C.EDGE_SOURCES).alias("source"),
            _first(e, *C.EDGE_TARGETS).alias("target"),
            F.coalesce(_first(e, *C.EDGE_TYPES), F.lit("RELATED")).alias("type"),
        ),
    )
    return F.filter(edges, lambda e: e["source"].isNotNull() & e["target"].isNotNull())
