"""The few functions that Spark has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import contextlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from itertools import pairwise

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unify_macron(texts: pd.Series) -> pd.Series:
    """Macrons to tildes, on decomposed letters; the result is composed."""
    change = lambda t: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).replace("̄", "̃"))
    return texts.map(change, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def combining_macrons(texts: pd.Series) -> pd.Series:
    """Letters with a combining macron after decomposition."""
    return texts.map(lambda t: len(re.findall("[^\\s\\d\\W]̄", unicodedata.normalize("NFD", t or "")))).astype("int32")


#: Longest run of seeds that is looked up; texts with longer ones have their places compared one by one.
LONGEST_RUN = 200
#: Characters that are compared at once.
STEP = 16


def _runs(a: str, b: str, seeds: list[int], b_seeds: list[int], places: dict[str, list[int]]) -> list[tuple[list[int], list[list[int]]]] | None:
    """For each length, from 1: where a has runs of seeds that b has too, and for each of them its places in b; None if
    some are longer than LONGEST_RUN."""
    out, size, starts, at = [], 1, seeds, b_seeds
    where = [places[a[i]] for i in starts]
    while starts:
        if size > LONGEST_RUN:
            return None
        out.append((starts, where))
        size += 1
        found: dict[str, list[int]] = {a[i : i + size]: [] for i, j in pairwise(starts) if j == i + 1}
        at = [i for i, j in pairwise(at) if j == i + 1 and b[i : i + size] in found] + ([at[-1]] if at and b[at[-1] : at[-1] + size] in found else [])
        for i in at:
            found[b[i : i + size]].append(i)
        starts = [i for i in starts if found.get(a[i : i + size])]
        where = [found[a[i : i + size]] for i in starts]
    return out


def _looked_up(runs: list[tuple[list[int], list[list[int]]]], most: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest run, of up to most seeds, within the ranges; of equal ones the first in a, then in b."""
    for size in range(min(most, len(runs)), 0, -1):
        starts, where = runs[size - 1]
        for s in range(bisect_left(starts, alo), bisect_left(starts, ahi - size + 1)):
            js = where[s]
            first = bisect_left(js, blo)
            if first < len(js) and js[first] + size <= bhi:
                return starts[s], js[first], size
    return alo, blo, 0


def _compared(a: str, seeds: list[int], places: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The same by comparing the places of neighbours; each place of a seed that follows none is a run of one."""
    x, y, size = alo, blo, 0
    ends: dict[int, int] = {}  # place in b: length of the run that ends there and at the seed before
    before = -2
    for s in range(bisect_left(seeds, alo), bisect_left(seeds, ahi)):
        i = seeds[s]
        js = places[a[i]]
        first, last = bisect_left(js, blo), bisect_left(js, bhi)
        if i != before + 1:
            ends = {}
        before = i
        if first == last:
            ends = {}
            continue
        if not size:
            x, y, size = i, js[first], 1
        inner = s + 1 < len(seeds) and seeds[s + 1] == i + 1
        if not ends:
            if inner:
                ends = dict.fromkeys(js[first:last], 1)
            continue
        runs = {}
        for j in js[first:last]:
            k = runs[j] = ends.get(j - 1, 0) + 1
            if k > size:
                x, y, size = i - k + 1, j - k + 1, k
        ends = runs
    return x, y, size


def matched_characters(a: str, b: str) -> int:
    """Characters in the matching blocks of ``difflib.SequenceMatcher(None, a, b)``, the same blocks by less work.

    difflib seeds its blocks by characters that aren't popular in b, and takes the longest run of seeds first.  The runs
    that both texts have are found once, by length; a block within given ranges is then looked up.  Ranges only
    shrink, so no longer run is looked for within a part than was found in the whole.
    """
    if a == b:
        return len(a)
    limit = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    places: dict[str, list[int]] = {c: [] for c, n in Counter(b).items() if n <= limit}
    seeds, b_seeds = [], []
    if places:
        rare = re.compile("[" + "".join(map(re.escape, places)) + "]")
        for m in rare.finditer(b):
            places[m[0]].append(m.start())
            b_seeds.append(m.start())
        seeds = [m.start() for m in rare.finditer(a)]
    runs = _runs(a, b, seeds, b_seeds, places)
    total, todo = 0, [(LONGEST_RUN, 0, len(a), 0, len(b))]
    while todo:
        most, alo, ahi, blo, bhi = todo.pop()
        x, y, size = _looked_up(runs, most, alo, ahi, blo, bhi) if runs is not None else _compared(a, seeds, places, alo, ahi, blo, bhi)
        most = size
        while x - STEP >= alo and y - STEP >= blo and a[x - STEP : x] == b[y - STEP : y]:
            x, y, size = x - STEP, y - STEP, size + STEP
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        p, q = x + size, y + size
        while p + STEP <= ahi and q + STEP <= bhi and a[p : p + STEP] == b[q : q + STEP]:
            p, q = p + STEP, q + STEP
        while p < ahi and q < bhi and a[p] == b[q]:
            p, q = p + 1, q + 1
        if p > x:
            total += p - x
            if alo < x and blo < y:
                todo.append((most, alo, x, blo, y))
            if p < ahi and q < bhi:
                todo.append((most, p, ahi, q, bhi))
    return total


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of whole texts as the standard library computes it; a null is an empty text."""
    pairs = ((x or "", y or "") for x, y in zip(a, b, strict=True))
    return pd.Series([2.0 * matched_characters(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in pairs], dtype="float64")


_DECODER, _FENCE = json.JSONDecoder(), re.compile(r"\A```(?:json)?\s*(.*?)(?:\s*```)?\Z", re.S)


def first_value(answer: str):
    """The JSON value that a model's answer is, or holds: places to read from, in order of preference, are the start (if
    nothing follows the value), the first object and the first array."""
    body = answer.strip()
    fence = _FENCE.match(body)
    body = fence[1] if fence else body
    for place, alone in [(0, True), *((body.find(sign), False) for sign in "{[" if sign in body)]:
        with contextlib.suppress(ValueError):
            value, end = _DECODER.raw_decode(body, place)
            if not alone or not body[end:].strip():
                return value
    return None


@F.pandas_udf(T.StringType())
def json_blob(texts: pd.Series) -> pd.Series:
    """The first JSON value in a fenced or noisy answer, written compactly; null where there is none."""

    def found(t: str | None) -> str | None:
        value = first_value(t) if t else None
        return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    return texts.map(found)
