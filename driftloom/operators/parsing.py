"""Tolerant parsing of model output, in Arrow batches."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.actions import ACTION_TYPES, CLICK_TYPES
from driftloom.functions.text import strip
from driftloom.operators.stemming import stem

PARSED = "ok boolean, rationale string, type string, click_type string, name string, text string"
#: Fixed value: an object in a code fence.
FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S | re.I)
#: Ends of strings and braces; an escaped character never ends a string.
PART = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}]', re.S)


def loaded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def first_object(text: str):
    """The first fenced object if it parses, else the first balanced one; None if that doesn't parse."""
    fence = FENCED.search(text)
    if fence and (found := loaded(fence[1])) is not None:
        return found
    begin, depth = text.find("{"), 0
    for part in PART.finditer(text, max(begin, 0)) if begin >= 0 else ():
        if part[0] == '"':  # a string without an end
            return None
        depth += {"{": 1, "}": -1}.get(part[0], 0)
        if depth == 0:
            return loaded(text[begin : part.end()])
    return None


def filled(value) -> str | None:
    """None for null, NaN and blank, else the string."""
    if value is None or isinstance(value, float) and value != value:
        return None
    return str(value) if str(value).strip() else None


def parsed_action(data) -> dict | None:
    kind = str(data["type"]).lower().strip() if isinstance(data, dict) and data.get("type") is not None else None
    if kind not in ACTION_TYPES:
        return None
    click = filled(data.get("click_type")) if kind == "click" else None
    if click is not None and click not in CLICK_TYPES:
        return None
    return {"type": kind, "click_type": click, "name": filled(data.get("name")) if kind != "terminate" else None, "text": filled(data.get("text")) if kind == "input" else None}


def parse(text: str | None) -> dict:
    nothing = {"ok": False, "rationale": None, "type": None, "click_type": None, "name": None, "text": None}
    data = first_object(text or "")
    action = parsed_action(data["action"]) if isinstance(data, dict) and "action" in data else None
    if action is None:
        return nothing
    said = data.get("rationale", "")
    return {"ok": True, "rationale": said if isinstance(said, str) else str(said), **action}


def parse_completion(text: Column, rationale: bool = True) -> Column:
    """Struct of ok, rationale and the action's fields; rationale may be left out."""
    fields = [f for f in PARSED.split(", ") if rationale or f != "rationale string"]

    @F.pandas_udf(", ".join(fields))
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in texts], columns=[c.split()[0] for c in fields])

    return each(text)


def said(rationale: Column) -> Column:
    """A parsed rationale, stripped; null if that leaves nothing."""
    return F.nullif(strip(rationale), F.lit(""))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    places: dict = {}
    for i, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def words_of(text: str) -> list[str]:
    """Lower-cased words of letters and digits, those of more than three characters stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower())]


@functools.lru_cache(maxsize=32)
def scored(x: str | None, y: str | None) -> float | None:
    """F measure of two texts. Rows that say the same mostly follow each other."""
    if x is None or y is None:
        return None
    x, y = words_of(x), words_of(y)
    n = lcs_length(x, y) if x and y else 0
    return 2 * n / (len(x) + len(y)) if n else 0.0


def rouge_l(said: Column, true: Column) -> Column:
    """F measure of the longest common subsequence of stemmed words."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([scored(x, y) for x, y in zip(a, b)])

    return score(said, true)
