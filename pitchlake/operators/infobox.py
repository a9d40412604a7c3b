"""Infobox templates of wiki pages: parameters and career histories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import text as X


def templates(wikitext: str) -> list[str]:
    """Bodies of the outermost templates, braces balanced."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(wikitext) - 1:
        pair = wikitext[i : i + 2]
        if pair == "{{":
            if depth == 0:
                start = i + 2
            depth, i = depth + 1, i + 2
        elif pair == "}}" and depth:
            depth, i = depth - 1, i + 2
            if depth == 0:
                out.append(wikitext[start : i - 2])
        else:
            i += 1
    return out


def parameters(body: str) -> tuple[str, dict[str, str]]:
    """(name, parameters) of a template body: cut at bars outside of links and templates; empty values dropped, the last of a name wins."""
    parts, depth, last = [], 0, 0
    i = 0
    while i < len(body):
        pair = body[i : i + 2]
        if pair in ("[[", "{{"):
            depth, i = depth + 1, i + 2
        elif pair in ("]]", "}}"):
            depth, i = max(0, depth - 1), i + 2
        else:
            if body[i] == "|" and depth == 0:
                parts.append(body[last:i])
                last = i + 1
            i += 1
    parts.append(body[last:])
    found: dict[str, str] = {}
    for p in parts[1:]:
        name, sign, value = p.partition("=")
        if sign and value.strip():
            found[name.strip()] = value.strip()  # as it stands, and in one writing
            found["_".join(name.strip().lower().split())] = value.strip()
    return parts[0].strip(), found


def infobox_params(wikitext: Column, markers: list[str], keywords: list[str], exact: tuple[str, ...] = ()) -> Column:
    """Map of the parameters of the first template whose name is listed or has a marker and a keyword; empty where there is none (Arrow function)."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def params(s: pd.Series) -> pd.Series:
        from pitchlake.operators.infobox import parameters, templates

        out = []
        for t in s:
            hit: dict[str, str] = {}
            for body in templates(t or ""):
                name, found = parameters(body)
                low = name.lower()
                if low.strip() in exact or (any(m in low for m in markers) and any(k in low for k in keywords)):
                    hit = found
                    break
            out.append(hit)
        return pd.Series(out)

    return params(wikitext)


def career(params: Column, names: str, years: str, caps: str, goals: str, most: int = 19) -> Column:
    """Array of stints of numbered parameters ``names1 .. namesN``; a stint needs a name."""

    def stint(i: Column) -> Column:
        at = lambda p: F.element_at(params, F.concat(F.lit(p), i.cast("string")))
        span = X.year_range(at(years))
        return F.struct(
            X.clean_name(at(names)).alias("club_name"), span["from_year"].alias("from_year"), span["to_year"].alias("to_year"),
            X.digits_int(at(caps)).cast("int").alias("appearances"), X.digits_int(at(goals)).cast("int").alias("goals"),
        )

    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), stint), lambda s: F.coalesce(s["club_name"], F.lit("")) != "")


def consecutive_career(params: Column, names: str, years: str, caps: str, goals: str, most: int = 40) -> Column:
    """Stints as ``career``, but only those before the first number without a name."""
    at = lambda i: F.coalesce(F.element_at(params, F.concat(F.lit(names), i.cast("string"))), F.lit(""))
    gap = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda n, i: F.when((n == i - 1) & (at(i) != ""), i).otherwise(n))
    return F.slice(career(params, names, years, caps, goals, most), 1, gap)


def career_in_text(wikitext: Column) -> Column:
    """Array of (club_name, from_year, to_year) of a text's lines ``years: [[club]]`` or ``[[club]] (years)``: where a page has no numbered parameters."""
    lines = F.split(wikitext, "\n")

    def stint(line: Column) -> Column:
        club = F.regexp_extract(line, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", 1)
        span = X.year_range(F.regexp_replace(line, r"\[\[[^\[\]]*\]\]", " "))
        return F.struct(X.clean_name(club).alias("club_name"), span["from_year"].alias("from_year"), span["to_year"].alias("to_year"))

    return F.filter(F.transform(lines, stint), lambda s: (s["club_name"] != "") & s["from_year"].isNotNull())


def first_classified(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Class of the first rule whose text the folded column holds."""
    low, out = F.lower(c), None
    for text, name in rules:
        out = F.when(low.contains(text), name) if out is None else out.when(low.contains(text), name)
    return out.otherwise(default)
