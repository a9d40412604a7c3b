"""Sentences, spans and relations in text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs that stand for the end of a sentence and for a point that ends none.
_END, _POINT = "\u001e", "\u001f"
# Shortened words whose point ends no sentence.
ABBREVIATIONS = ("tp", "ts", "ths", "gs", "pgs", "tr", "mr", "mrs", "dr", "st", "no", "vs")


def sentences(df: DataFrame, key: str, text: str, low: int = 10, high: int = 500) -> DataFrame:
    """(sentence_id, key, sentence_idx, sentence): a text cut after ``. ! ?`` and at line ends.

    A point after a word of ``ABBREVIATIONS`` or a sign before a small letter ends no sentence. A sentence longer than
    ``high`` is cut at commas and semicolons; what is shorter than ``low`` or still longer than ``high`` is left out.
    """
    shortened = rf"([ \t\r\n(])((?i:{'|'.join(ABBREVIATIONS)}))\."
    marked = F.regexp_replace(F.regexp_replace(text, shortened, f"$1$2{_POINT}"), r"([.!?])[ \t]++(?!\p{Ll})", f"$1{_END}")
    whole = F.transform(F.split(F.regexp_replace(marked, "[\r\n]+", _END), _END), lambda s: F.trim(F.replace(s, F.lit(_POINT), F.lit(".")), F.lit(" \t")))
    parts = F.flatten(F.transform(whole, lambda s: F.when(F.length(s) > high, F.transform(F.split(s, "[,;]"), lambda p: F.trim(p, F.lit(" \t")))).otherwise(F.array(s))))
    kept = F.filter(parts, lambda s: F.length(s).between(low, high))
    s = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(kept).alias("sentence_idx", "sentence"))
    return s.select(F.concat_ws("_", F.col(key).cast("string"), F.col("sentence_idx").cast("string")).alias("sentence_id"), key, "sentence_idx", "sentence")


_SPAN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))


def pattern_spans(text: Column, patterns: list[tuple[str, str, float]]) -> Column:
    """Spans (text, type, start, end, confidence) of (pattern, type, confidence) rules in a text, with offsets (Arrow function)."""

    @F.pandas_udf(_SPAN)
    def find(s: pd.Series) -> pd.Series:
        compiled = [(re.compile(p, re.IGNORECASE), k, c) for p, k, c in patterns]
        return pd.Series([[(m.group(), k, m.start(), m.end(), c) for p, k, c in compiled for m in p.finditer(t)] if t is not None else [] for t in s])

    return find(text)


def resolve_spans(spans: list, overlaps_allowed: int = 0) -> list:
    """Spans that don't overlap, chosen greedily by priority (first element), then length, then start; returned by start."""
    taken: list = []
    for s in sorted(spans, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if all(s[2] <= t[1] + overlaps_allowed or s[1] >= t[2] - overlaps_allowed for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda x: x[1])


def resolved(df: DataFrame, group: str, priority: Column, start: str, end: str, ident: str) -> DataFrame:
    """(group, ident, start, end): the spans of each group that remain after greedy resolution.

    Equal spans count once, by the least id, so a group is no larger than its text has spans.
    """
    once = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(group, start, end).agg(F.min(priority).alias("_p"), F.min(ident).alias("_i"))
    grouped = once.groupBy(group).agg(F.collect_list(F.struct("_p", start, end, "_i")).alias("_s"))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
    def choose(s: pd.Series) -> pd.Series:
        from pitchlake.operators.textops import resolve_spans

        return pd.Series([[(x[3], x[1], x[2]) for x in resolve_spans([tuple(d.values()) for d in spans])] for spans in s])

    return grouped.select(group, F.explode(choose("_s")).alias("r")).select(group, F.col("r.i").alias(ident), F.col("r.s").alias(start), F.col("r.e").alias(end))


#: Kinds of first words that ``_with_sizes`` tells apart: its table has no more rows, however many names there are.
FIRST_WORDS = 1 << 14


def _with_sizes(starts: DataFrame, entries: DataFrame) -> DataFrame:
    """``starts`` (with ``_first``) that can begin an entry, with ``_sizes``: how many words entries with such a first word have.

    First words meet by a hash, so the table that goes to every executor has a row per hash at most; the join of whole runs
    is exact. It's named as the side to broadcast: a planner that goes by the size of files takes the words of all texts for smaller.
    """
    kind = lambda c: F.pmod(F.xxhash64(c), F.lit(FIRST_WORDS))
    sizes = entries.groupBy(kind(F.col("_words")[0]).alias("_kind")).agg(F.collect_set(F.size("_words")).alias("_sizes"))
    return starts.withColumn("_kind", kind("_first")).join(F.broadcast(sizes), "_kind").drop("_kind")


def dictionary_mentions(df: DataFrame, key: str, text: str, names: DataFrame, name: str, ident: str, by: list[str] | None = None) -> DataFrame:
    """(key, by columns, ident): entries whose whole name, folded, stands in the text at word bounds; least id of equal names (of each ``by``).

    Equi-joins on runs of words: a run begins where a name begins, and is as long as a name with that first word can be.
    Runs and names are both shuffled, as either may be large.
    """
    by = by or []
    entries = names.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_r"), *by).agg(F.min(ident).alias(ident)).withColumn("_words", F.split("_r", " "))
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[,.;:!?()\"]", " "), " +", " "), " ")
    starts = df.filter(F.col(text).isNotNull()).select(key, words.alias("_w")).select(key, "_w", F.posexplode("_w").alias("_at", "_first"))
    runs = F.transform(F.filter("_sizes", lambda n: F.col("_at") + n <= F.size("_w")), lambda n: F.array_join(F.slice("_w", F.col("_at") + 1, n), " "))
    found = _with_sizes(starts, entries).select(key, F.explode(runs).alias("_r"))
    return found.join(entries.select("_r", *by, ident).hint("merge"), "_r").select(key, *by, ident).distinct()


def without_sections(text: Column, excluded: list[str]) -> Column:
    """A wiki text without the sections whose folded heading is listed, up to the next heading of the same or a higher level.

    One pass over the lines by an aggregate: the state is the level of the section being dropped, 0 outside of one.
    """
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        marks = F.length(F.regexp_extract(line, r"^(={2,6})[^=]", 1))
        title = F.lower(F.trim(F.regexp_extract(line, r"^={2,6}\s*([^=]*?)\s*={2,6}\s*$", 1)))
        listed = F.exists(F.array(*[F.lit(e) for e in excluded]), lambda e: title == e)
        heading = marks > 0
        open_level = F.when(heading & (acc["level"] > 0) & (marks > acc["level"]), acc["level"]).when(heading & listed, marks).when(heading, 0).otherwise(acc["level"])
        return F.struct(open_level.alias("level"), F.when(open_level > 0, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def pattern_relations(df: DataFrame, key: str, text: str, rules: list[tuple[str, str, bool, float]], name: str) -> DataFrame:
    """(key, predicate, subject, object, confidence, swapped): every match of each rule in a text.

    A rule is (verb pattern, predicate, reversed, confidence); a match is a name, the verb, a name. Reversed rules swap the
    two. Each text is searched once a rule; names are taken from the matches.
    """
    def matches(verb: str, predicate: str, swapped: bool, confidence: float) -> Column:
        pattern, (s, o) = f"({name}) (?:{verb}) ({name})", (2, 1) if swapped else (1, 2)

        def read(m: Column) -> Column:
            return F.struct(F.lit(predicate).alias("predicate"), F.regexp_extract(m, pattern, s).alias("subject"), F.regexp_extract(m, pattern, o).alias("object"), F.lit(confidence).alias("confidence"), F.lit(swapped).alias("swapped"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), read)

    return df.filter(F.col(text).isNotNull()).select(key, F.inline(F.flatten(F.array(*[matches(*r) for r in rules]))))


def pattern_texts(text: Column, patterns: list[tuple[str, str, float]]) -> Column:
    """Array of (rule, mention, type) of all that (pattern, type, confidence) rules find in a text; stays in the JVM."""

    def found(i: int, pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(i).alias("rule"), m.alias("mention"), F.lit(kind).alias("type")))

    return F.flatten(F.array(*[found(i, p, k) for i, (p, k, _) in enumerate(patterns)]))


def words_present(text: Column, words: tuple[str, ...]) -> Column:
    """Bit mask of the words (at most 63) that a text holds, folded, anywhere: bit i for ``words[i]``; null for null (Arrow function).

    One pass of an automaton over the text finds them all, overlapping ones included.
    """

    @F.pandas_udf(T.LongType())
    def present(s: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, 1 << i)
        automaton.make_automaton()
        out = []
        for t in s:
            mask = 0
            if t is not None:
                for _, bit in automaton.iter(t.lower()):
                    mask |= bit
            out.append(None if t is None else mask)
        return pd.Series(out, dtype="Int64")

    return present(text)


def dictionary_spans(df: DataFrame, key: str, text: str, names: DataFrame, name: str, kept: list[str]) -> DataFrame:
    """(key, start_pos, end_pos, kept columns): where entries' folded names stand in a text at word bounds, all occurrences.

    As ``dictionary_mentions``; signs become spaces one by one, so a word's place in the folded text is its place in the text.
    """
    entries = names.filter(F.col(name).isNotNull()).select(F.lower(name).alias("_r"), *kept).withColumn("_words", F.split("_r", " "))
    words = F.split(F.regexp_replace(F.lower(text), r"[,.;:!?()\"\n]", " "), " ")
    starts = df.filter(F.col(text).isNotNull()).select(key, words.alias("_w")).select(key, "_w", F.posexplode("_w").alias("_at", "_first"))
    found = _with_sizes(starts, entries).select(key, "_w", "_at", F.explode("_sizes").alias("_n")).filter("_at + _n <= size(_w)")
    before = F.aggregate(F.slice("_w", 1, F.col("_at")), F.lit(0), lambda a, w: a + F.length(w) + 1)
    found = found.select(key, before.alias("start_pos"), F.array_join(F.slice("_w", F.col("_at") + 1, F.col("_n")), " ").alias("_r")).join(entries.drop("_words").hint("merge"), "_r")
    return found.select(key, "start_pos", (F.col("start_pos") + F.length("_r")).alias("end_pos"), *kept)


def recognised(spans: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """(key, start_pos, end_pos, kept columns): spans (with priority) that remain when overlaps are resolved in each text; of equal spans the least of the kept columns."""
    once = spans.groupBy(key, "start_pos", "end_pos").agg(F.min(F.struct("priority", *kept)).alias("_m"))
    numbered = once.select(key, "start_pos", "end_pos", "_m", F.xxhash64("start_pos", "end_pos").alias("_i"))
    left = resolved(numbered, key, F.col("_m.priority"), "start_pos", "end_pos", "_i").select(key, "start_pos", "end_pos")
    return left.join(once, [key, "start_pos", "end_pos"]).select(key, "start_pos", "end_pos", *[F.col(f"_m.{c}").alias(c) for c in kept])


#: Types of entities by the labels that models of names give.
MODEL_LABELS = {"PER": "PLAYER", "ORG": "CLUB", "LOC": "PROVINCE"}


def model_spans(text: Column, load: Callable[[], Callable[[str], list[tuple]]], labels: dict[str, str] | None = None) -> Column:
    """Spans of a model of names: ``load`` makes the model on each worker once, the model gives (start, end, label, confidence) of a text.

    Labels are mapped to types, others are left out. Texts are read whole; null and empty ones give none (Arrow function).
    """
    known = MODEL_LABELS if labels is None else labels

    @F.pandas_udf(_SPAN)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series([[(t[a:b], known[k], a, b, float(c)) for a, b, k, c in model(t) if k in known] if t else [] for t in s])

    return find(text)
