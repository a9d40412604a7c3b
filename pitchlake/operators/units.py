"""Quantities stated in different units and scales, converted to the base unit of their field.

A stated value is cut into numbers and unit strings. Each unit string is segmented by dynamic programming over
tries of prefixes, roots and exponents; a string such as ``m`` or ``in`` has several decompositions, and each gets
the log prior of its pieces plus the log prior of its dimension and magnitude for the field at hand. A figure without a
unit takes the unit whose converted value the field finds plausible. Arithmetic is exact (``Fraction``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit prefixes, as written in English and Vietnamese, and their factors.
PREFIXES = {
    "": Fraction(1), "k": Fraction(1000), "kilo": Fraction(1000), "kilô": Fraction(1000), "ki-lô-": Fraction(1000),
    "d": Fraction(1, 10), "deci": Fraction(1, 10), "đề-xi-": Fraction(1, 10), "đề xi ": Fraction(1, 10), "đêxi": Fraction(1, 10),
    "c": Fraction(1, 100), "centi": Fraction(1, 100), "xăng-ti-": Fraction(1, 100), "xăng ti ": Fraction(1, 100), "xen-ti-": Fraction(1, 100),
    "m": Fraction(1, 1000), "milli": Fraction(1, 1000), "mili": Fraction(1, 1000), "mi-li-": Fraction(1, 1000), "mi li ": Fraction(1, 1000),
}
# Unit roots with dimension, factor to the dimension's base unit (cm, g), log prior, metric or not.
ROOTS = {
    "m": ("length", Fraction(100), -0.1, True), "mét": ("length", Fraction(100), 0.0, True), "met": ("length", Fraction(100), 0.0, True),
    "metre": ("length", Fraction(100), 0.0, True), "meter": ("length", Fraction(100), 0.0, True), "metres": ("length", Fraction(100), 0.0, True), "meters": ("length", Fraction(100), 0.0, True),
    "in": ("length", Fraction(254, 100), -0.1, False), "inch": ("length", Fraction(254, 100), 0.0, False), "inches": ("length", Fraction(254, 100), 0.0, False), '"': ("length", Fraction(254, 100), -0.2, False),
    "ft": ("length", Fraction(3048, 100), 0.0, False), "foot": ("length", Fraction(3048, 100), 0.0, False), "feet": ("length", Fraction(3048, 100), 0.0, False), "'": ("length", Fraction(3048, 100), -0.2, False),
    "yd": ("length", Fraction(9144, 100), -0.5, False), "mi": ("length", Fraction(16093440, 100), -3.0, False),
    "g": ("mass", Fraction(1), -0.1, True), "gam": ("mass", Fraction(1), 0.0, True), "gram": ("mass", Fraction(1), 0.0, True), "grams": ("mass", Fraction(1), 0.0, True),
    "lb": ("mass", Fraction(45359237, 100000), 0.0, False), "lbs": ("mass", Fraction(45359237, 100000), 0.0, False), "pound": ("mass", Fraction(45359237, 100000), 0.0, False), "pounds": ("mass", Fraction(45359237, 100000), 0.0, False),
    "min": ("time", Fraction(60), -0.1, False), "s": ("time", Fraction(1), -0.5, True),
}
EXPONENTS = {"": 1, "2": 2, "²": 2, "^2": 2, "3": 3, "³": 3, "^3": 3}
_BASE_PREFIX_LOG = {True: -0.3, False: -6.0}  # a decimal prefix on a metric root, on another root


@dataclass(frozen=True)
class Field:
    """What a field measures: its dimension, the plausible range in the base unit, and log priors."""

    dimension: str
    low: int
    high: int
    off_dimension: float = log(0.01)
    off_range: float = log(0.05)


FIELDS = {"height": Field("length", 140, 220), "weight": Field("mass", 35_000, 160_000)}
#: Units that a bare figure of a dimension may stand for.
BARE = {"length": ("m", "dm", "cm", "mm", "in", "ft"), "mass": ("kg", "g", "lb")}
_NEXT = {"ft": "in", "foot": "in", "feet": "in", "'": "in"}


def _trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


_TRIES = (_trie(PREFIXES), _trie(ROOTS), _trie(EXPONENTS))


def _walk(trie: dict, s: str, at: int):
    """Words of ``trie`` that start at position ``at`` of ``s``."""
    node = trie
    if "" in node:
        yield node[""]
    for i in range(at, len(s)):
        node = node.get(s[i])
        if node is None:
            return
        if "" in node:
            yield node[""]


@lru_cache(maxsize=4096)
def segmentations(unit: str) -> tuple[tuple[str, Fraction, bool, float, str], ...]:
    """All decompositions of a unit string as (dimension, factor, metric, log prior, root).

    ``best[layer][position]`` holds the partial decompositions that end there; the layers are prefix, root, exponent.
    """
    states = {0: [("", "", 0.0)]}
    for layer, trie in enumerate(_TRIES):
        following: dict[int, list] = {}
        for at, partial in states.items():
            for word in _walk(trie, unit, at):
                for prefix, root, score in partial:
                    if layer == 0:
                        new = (word, root, score)
                    elif layer == 1:
                        metric = ROOTS[word][3]
                        new = (prefix, word, score + ROOTS[word][2] + (_BASE_PREFIX_LOG[metric] if prefix else 0.0))
                    else:
                        new = (prefix, root, score) if not word else (prefix, root + word, score - 0.5)
                    following.setdefault(at + len(word), []).append(new)
        states = following
    out = []
    for prefix, root, score in states.get(len(unit), []):
        name = root.rstrip("23²³^")
        power = EXPONENTS[root[len(name) :]]
        dimension, factor, _, metric = ROOTS[name]
        out.append((dimension if power == 1 else f"{dimension}^{power}", (PREFIXES[prefix] * factor) ** power, metric, score, name))
    return tuple(sorted(out, key=lambda x: -x[3]))


def _score(value: Fraction, dimension: str, prior: float, field: Field) -> float:
    score = prior + (0.0 if dimension == field.dimension else field.off_dimension)
    return score + (0.0 if dimension == field.dimension and field.low <= value <= field.high else field.off_range)


def _best(number: Fraction, unit: str, field: Field):
    """Best reading (value, dimension, metric, root) of a figure with its unit string, or None."""
    found = [(_score(number * factor, d, prior, field), number * factor, d, metric, root) for d, factor, metric, prior, root in segmentations(unit)]
    return max(found, key=lambda x: x[0])[1:] if found else None


_NUMBER = re.compile(r"\d+(?:[.,]\d+)?(?:\s?[½¼¾])?|[½¼¾]")
_KEYED = re.compile(r"([a-zà-ỹđ]+)\s*=\s*(\d+(?:[.,]\d+)?[½¼¾]?)")
_SAME = str.maketrans({"’": "'", "′": "'", "‘": "'", "ʹ": "'", "”": '"', "“": '"', "″": '"', "–": "-", "—": "-", " ": " "})
_BRACES = str.maketrans("{}|", "   ")
_PART = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4)}


def _figure(text: str) -> Fraction:
    extra = _PART.get(text[-1], Fraction(0))
    plain = text.rstrip("½¼¾ ").replace(",", ".")
    return (Fraction(plain) if plain else Fraction(0)) + extra


def readings(text: str, field: Field) -> list[tuple[Fraction, str, bool]]:
    """Readings (value in the base unit, dimension, metric) of a stated value, compound figures joined."""
    s = " ".join(text.translate(_SAME).lower().replace("''", '"').split())
    s = _KEYED.sub(r"\2 \1 ", s).translate(_BRACES)
    numbers = list(_NUMBER.finditer(s))
    parts = []
    for i, m in enumerate(numbers):
        end = numbers[i + 1].start() if i + 1 < len(numbers) else len(s)
        gap = s[m.end() : end]
        unit = re.match(r"[\s-]*(['\"]|[a-zà-ỹđ²³^]+(?:[- ][a-zà-ỹđ²³]+){0,3})?", gap)
        word = (unit.group(1) or "").strip()
        while word and not segmentations(word) and re.search(r"[- ]", word):
            word = re.sub(r"[- ][^- ]*$", "", word)
        parts.append((_figure(m.group()), m.group(), word if word and segmentations(word) else "", bool(word) and not segmentations(word), gap))
    out: list[tuple[Fraction, str, bool]] = []
    i = 0
    while i < len(parts):
        number, _, unit, strange, gap = parts[i]
        following = parts[i + 1] if i + 1 < len(parts) else None
        touching = following and not re.search(r"[,;/(]", gap)
        if unit:
            best = _best(number, unit, field)
            value, dimension, metric, root = best
            i += 1
            if following and touching and dimension == "length":
                if root in _NEXT and (not following[2] or segmentations(following[2])[0][4] in ("in", "inch", "inches", '"')) and not following[3] and following[0] < 12:
                    value += following[0] * Fraction(254, 100)
                    i += 1
                elif metric and number < 10 and root in ("m", "mét", "met", "metre", "meter") and re.fullmatch(r"\d{1,2}", following[1]) and not following[2] and not following[3]:
                    value += Fraction(following[1].ljust(2, "0")) if len(following[1]) == 2 else Fraction(int(following[1]) * 10)
                    i += 1
            out.append((value, dimension, metric))
            continue
        if not strange and following and gap.strip() == "-" and field.dimension == "length" and following[0] < 12 and not following[2] and number.denominator == 1 and 3 <= number <= 8:
            out.append((number * Fraction(3048, 100) + following[0] * Fraction(254, 100), "length", False))
            i += 2
            continue
        if not strange:
            found = []
            for name in BARE[field.dimension]:
                d, factor, metric, prior, _ = segmentations(name)[0] if name != "m" else next(x for x in segmentations("m") if x[4] == "m")
                if field.low <= number * factor <= field.high:
                    found.append((prior, number * factor, d, metric))
            if found:
                out.append(max(found, key=lambda x: x[0])[1:])
        i += 1
    return out


@lru_cache(maxsize=200_000)
def base_value(text: str | None, field_name: str) -> int | None:
    """The stated value rounded half up to a whole base unit, or None where none of the field's dimension is stated.

    A metric figure counts before one of another system; of several of a kind the first counts. Values outside the
    field's plausible range give None, as do null, empty and unreadable texts.
    """
    if not text:
        return None
    field = FIELDS[field_name]
    found = [r for r in readings(text, field) if r[1] == field.dimension]
    if not found:
        return None
    value = next((v for v, _, metric in found if metric), found[0][0])
    if not field.low <= value <= field.high:
        return None
    return int((2 * value + 1) // 2)


def to_base_unit(column: Column, field_name: str) -> Column:
    """Column of whole base units (cm for ``height``, g for ``weight``) of a column of stated values.

    Null, empty and unreadable texts give null, texts of any length are read whole; equal texts always give equal values. The parsing runs in Arrow
    batches, once for each different text of a batch.
    """

    @F.pandas_udf("bigint")
    def convert(s: pd.Series) -> pd.Series:
        from pitchlake.operators.units import base_value

        codes, texts = pd.factorize(s)
        values = pd.array([base_value(t, field_name) for t in texts], dtype="Int64")
        return pd.Series(values.take(codes, allow_fill=True))

    return convert(column)
