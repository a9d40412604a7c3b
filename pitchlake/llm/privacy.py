"""Personal information in free text: information-theoretic sanitisation.

Terms are found with their places: direct identifiers (mail addresses, telephone and identity numbers, street addresses) by
their form, other numbers and handles beside them, and name-like runs of capitalised words. The corpus tells how strongly a
term reveals a private person: every context of a term (the words before and after it) is counted over all texts, for names
with names that no public table lists and with all whole names, for identifiers with those of a personal form and with all
numbers and handles. The information that a context carries is ``log2(p(personal | context) / p(personal))``. A term that
is personal by itself (an unlisted whole name, an identifier's form) is removed where its best context carries the threshold
or more; a short or abbreviated name, which says little by itself, only where its context makes a private person likelier
than not. What is removed is replaced by a typed placeholder.

Which words begin names is measured in the same way, from the places at which words stand in public names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.names import bare, tidy
from pitchlake.llm.variants import _person_words, read_person
from pitchlake.llm.wordsets import WordFilter, filter_bits, word_forms
from pitchlake.session import materialize

TYPES = ("email", "phone", "id_number", "address", "name")

_UPPER = "A-ZÀ-ÖØ-ÞĂĐĨŨƠƯ" + "".join(chr(c) for c in range(0x1EA0, 0x1EFA, 2))
_MARK = "̀-ͯ"
_CAP = rf"[{_UPPER}][\w{_MARK}]*"
_CAPS = rf"{_CAP}(?: {_CAP}){{0,3}}"
# Digits as words, in Vietnamese and English.
_DIGIT = "(?:không|một|mốt|hai|ba|bốn|tư|năm|lăm|sáu|bảy|bẩy|tám|chín|zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_AFTER = r"(?![\w/]|[.-]\d| \d{2})"
EMAIL = re.compile(
    r"(?<![\w.+=/-])[\w+-][\w.+-]*(?:\s?[@＠]\s?|\s?[\[(](?:at|a|a còng)[\])]\s?| a còng | at (?=[\w-]+ dot ))[\w-]+(?:(?:\.|\s?[\[(](?:dot|chấm)[\])]\s?| chấm | dot )[\w-]+)+"
)
PHONE = re.compile(rf"[(+0](?<![\w/+.-].)(?:(?:(?<=\()\+84\)|(?<=\+)84|(?<=0)084)(?:[ .-]?\d){{9}}|(?<=\()0\d{{2}}\)(?:[ .-]?\d){{7}}|(?<=0)\d(?:[ .-]?\d){{8}}){_AFTER}")
SPOKEN = re.compile(rf"(?:[Kk]hông|[Zz]ero|[Oo]h)(?:[ -]{_DIGIT}){{8,11}}(?!\w)", re.IGNORECASE)
# (patterns begin with a class of characters, which the engine looks for fast, and look behind after it)
ID_NUMBER = re.compile(rf"[0-9A-Z](?<![\w/+.,-].)(?:(?<=0)\d{{2}}(?:[ .-]?\d){{9}}|(?<=\d)\d{{2}} \d{{3}} \d{{3}}|(?<=\d)\d{{8}}|(?<=[A-Z]) ?\d{{7}}){_AFTER}")
_UNIT = rf"(?:(?:phường|xã|huyện|quận|thị trấn|thị xã|thành phố|tỉnh|phuong|xa|huyen|quan|tinh|thanh pho|khu phố|tổ|ấp|thôn|Ward|District|Q\.|P\.|H\.|X\.|TP\.|TP|T\.)\s?(?:\d+|{_CAPS})|{_CAP}(?: {_CAP}){{0,2}} (?:district|ward|city|province)|{_CAP}(?: {_CAP}){{0,2}})"
_STREET = rf"(?:(?:đường|duong|phố|pho|khu phố|khu pho|ấp|thôn) {_CAPS}|{_CAP}(?: {_CAP}){{0,3}}? (?:Street|St\.|Road|Rd\.|Lane|Avenue|Ave\.)|{_CAP}(?: {_CAP}){{0,2}}(?=, (?:TP|P|Q|H|phường|quận|xã|huyện|Ward)))"
ADDRESS = re.compile(rf"\d(?<![\w/.,-].)\d{{0,3}}[A-Za-z]?(?:[/-]\d+)*(?: (?:ngõ|hẻm|ngách|kiệt|ngo|hem) \d+(?:/\d+)*)? {_STREET}(?:, {_UNIT})*")
_WORD = rf"[{_UPPER}](?:[\w{_MARK}]+|(?!\.))"
_RUN = re.compile(rf"[{_UPPER}](?<![\w{_MARK}].)(?:\.[ ]?(?:[{_UPPER}]\.[ ]?)*{_WORD}|[\w{_MARK}]+|(?!\.))(?:[ -]{_WORD})+")
_TOKEN = re.compile(rf"[\w{_MARK}]+|[^\w\s]")
_SPLIT = re.compile("[ -]")


#: Numbers of seven digits and more and handles, which are no identifiers by their form.
LOOSE = re.compile(r"\d(?<!\w.)(?:[ .()/-]{0,2}\d){6,}")
HANDLE = re.compile(r"[@＠]\w+")

_SPOKEN_START = re.compile(rf"(?:hông|HÔNG|ero|ERO|oh|OH|Oh)[ -]{_DIGIT}[ -]{_DIGIT}[ -]{_DIGIT}(?!\w)")


def direct_identifiers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of mail addresses, street addresses, telephone and identity numbers, without overlaps."""
    out: list[tuple[int, int, str]] = []

    def add(pattern: re.Pattern, kind: str) -> None:
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e, _ in out):
                out.append((m.start(), m.end(), kind))

    if "@" in text or "＠" in text or "(a" in text or "[a" in text or " a còng " in text or " dot " in text:
        add(EMAIL, "email")
    add(ADDRESS, "address")
    add(PHONE, "phone")
    if _SPOKEN_START.search(text):
        add(SPOKEN, "phone")
    add(ID_NUMBER, "id_number")
    return sorted(out)


_DIGITS = re.compile(r"\d+")
_AROUND = 32


@lru_cache(maxsize=200_000)
def _low(word: str) -> str:
    return _DIGITS.sub("9", word.lower())


def _before(text: str, start: int) -> list[str]:
    """The last two words or signs before a place, whole however long they are."""
    n = _AROUND
    while True:
        low = max(0, start - n)
        found = _TOKEN.findall(text[low:start])
        if len(found) > 2 or low == 0:  # of more than two the first may be cut
            return found[-2:]
        n *= 4


def _behind(text: str, end: int) -> list[str]:
    """The first two words or signs after a place, whole however long they are."""
    n = _AROUND
    while True:
        found = _TOKEN.findall(text[end : end + n])
        if len(found) > 2 or end + n >= len(text):
            return found[:2]
        n *= 4


def _context(text: str, start: int, end: int) -> list[str]:
    """Keys of the words before and after a term: one and two each, lower case, digits as one sign."""
    left = [_low(w) for w in _before(text, start)]
    right = [_low(w) for w in _behind(text, end)]
    out = []
    if left:
        out.append("<1 " + left[-1])
        if len(left) == 2:
            out.append(f"<2 {left[0]} {left[1]}")
    if right:
        out.append(">1 " + right[0])
        if len(right) == 2:
            out.append(f">2 {right[0]} {right[1]}")
    return out


_NO_WORD = re.compile(r"\W*")
_SHOUT = re.compile(rf"[{_UPPER}]{{2,}}(?!\w)")


def _in_capitals(text: str, start: int, end: int) -> bool:
    """A word of capitals stands before or after a run."""
    at = start
    while at > 0 and not (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    if at > 1 and text[at - 1].isupper() and text[at - 2].isupper():
        return True
    return _SHOUT.match(text, _NO_WORD.match(text, end).end()) is not None


class Lexicon:
    """Which words begin names, stand second in long names, stand third or later, and fifth or later.

    Each set is a container of words in lower case and, after ~, of words without marks.
    """

    __slots__ = ("far", "first", "inner", "second")

    def __init__(self, first, second, inner=frozenset(), far=frozenset()) -> None:
        self.first, self.second, self.inner, self.far = first, second, inner, far

    def length(self, words: list[str], at: int) -> int:
        """Words of the name that begins at ``at`` in a run of capitalised words, of which three or more are left.

        A fourth word belongs to it after a common second word or where it is a word of names itself, further ones where
        public names have them at such places.
        """
        left = len(words) - at
        if left == 3:
            return 3
        form = 1 if all(w.isascii() for w in words[at : at + 4]) else 0
        if word_forms(words[at + 1])[form] not in self.second and word_forms(words[at + 3])[form] not in self.inner:
            return 3
        n = 4
        while n < left and word_forms(words[at + n])[form] in self.far:
            n += 1
        return n


def name_terms(text: str, lexicon: Lexicon) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of name-like terms: capitalised words from a surname on, and short or abbreviated names.

    A whole name has a surname and two words more or as many as ``Lexicon.length`` tells. A short name is a run of a surname
    and one word, or of initials with two words.
    """
    out = []
    surnames = lexicon.first
    for m in _RUN.finditer(text):
        run = m.group()
        if "." not in run:
            words = _SPLIT.split(run)
            if len(words) == 2:
                low, plain = word_forms(words[0])
                if (plain if run.isascii() else low) in surnames:
                    out.append((m.start(), m.end(), False))
                continue
            initials = 0
        else:
            words = [w for w in re.split(r"(?<=\.)[ ]?|[ -]", run) if w]
            initials = sum(w.endswith(".") for w in words)
        if run.isupper() and (len(words) > 4 or _in_capitals(text, m.start(), m.end())):
            continue  # a sentence in capitals shows no names
        i = found = 0
        start = m.start()
        starts = []
        for w in words:
            start = text.index(w, start)
            starts.append(start)
            start += len(w)
        while i < len(words):
            if len(words) - i >= 3:
                form = 1 if all(w.isascii() for w in words[i : i + 4]) else 0
                if word_forms(words[i])[form] in surnames:
                    n = lexicon.length(words, i)
                    out.append((starts[i], starts[i + n - 1] + len(words[i + n - 1]), True))
                    i += n
                    found += 1
                    continue
            i += 1
        if not found and initials and len(words) - initials == 2:
            out.append((starts[0], m.end(), False))
    return out


def _rows(text: str, lexicon: Lexicon) -> list[tuple]:
    """(start, end, type, text, whole, words with marks, words without, contexts) of what a text holds; type ``other`` for loose numbers and handles."""
    spans = direct_identifiers(text)
    free = lambda s, e: not any(a < e and s < b for a, b, _ in spans)
    others = [m.span() for m in LOOSE.finditer(text)] + ([m.span() for m in HANDLE.finditer(text)] if "@" in text or "＠" in text else [])
    loose = [(s, e, "other") for s, e in others if free(s, e)]
    out = [(s, e, kind, text[s:e], True, None, None, _context(text, s, e)) for s, e, kind in (*spans, *loose)]
    for s, e, whole in name_terms(text, lexicon):
        if free(s, e):
            out.append((s, e, "name", text[s:e], whole, *_sorted_words(text[s:e]), _context(text, s, e)))
    return out


@lru_cache(maxsize=200_000)
def _sorted_words(name: str) -> tuple[str, str]:
    """The words of a name in order with marks and without."""
    words = sorted(tidy(name).split())
    return " ".join(words), " ".join(sorted(bare(w) for w in words))


def lexicon_bits(people: DataFrame) -> tuple[bytes, bytes, bytes, bytes]:
    """Bit maps of the words that begin the names of ``public_names``, stand second in names of four words or more, third or later, fifth or later.

    A word begins names where its information on the first place, ``log2(p(first | word) / p(first))``, reaches the
    threshold; so with the second place.
    """
    names = people.select(F.col("words").alias("w")).filter("w IS NOT NULL").distinct()
    placed = names.select(F.posexplode("w").alias("at", "word"), F.size("w").alias("size"))
    counts = placed.groupBy("word").agg(
        F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("first"), F.count_if((F.col("at") == 1) & (F.col("size") >= 4)).alias("second"),
        F.count_if(F.col("at") >= 2).alias("inner"), F.count_if(F.col("at") >= 4).alias("far"),
    )
    counts = materialize(counts, "p10-words")
    total = counts.agg(*[F.sum(c).alias(c) for c in ("n", "first", "second")]).first()

    def telling(place: str) -> DataFrame:
        prior = max(total[place] or 0, 1) / max(total["n"] or 0, 1)
        share = (F.col(place) + SMOOTHING * prior) / (F.col("n") + SMOOTHING)
        return counts.filter((F.col(place) > 0) & (F.log2(share / F.lit(prior)) >= THRESHOLD_BITS)).select("word")

    return filter_bits(telling("first")), filter_bits(telling("second")), filter_bits(counts.filter("inner > 0").select("word")), filter_bits(counts.filter("far > 0").select("word"))


def name_keys(name: str) -> tuple[str, str, bool]:
    """(words with marks, words without, has marks) of a public person's name without titles, sorted as parts are reordered."""
    _, words, _, _, _, _ = read_person(name)
    words = sorted(words.split())
    plain = [bare(w) for w in words]
    return " ".join(words), " ".join(sorted(plain)), words != plain


_NAME = T.StructType([T.StructField("marked", T.StringType()), T.StructField("plain", T.StringType()), T.StructField("marks", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType()))])


@F.pandas_udf(_NAME)
def _read_names(names: pd.Series) -> pd.DataFrame:
    rows = []
    for n in names:
        words = _person_words(n)
        whole = len(words) >= 3 and all(len(w) > 1 for w in words)
        rows.append((*name_keys(n), words if whole else None))
    return pd.DataFrame(rows, columns=["marked", "plain", "marks", "words"])


def public_names(names: DataFrame) -> DataFrame:
    """(marked, plain, marks, words): the keys of each public name and, of whole names of three words or more, the words without titles, nicknames and initials."""
    return names.select("name").filter("name IS NOT NULL AND name <> ''").distinct().select(_read_names("name").alias("k")).select("k.*")


def public_keys(people: DataFrame) -> DataFrame:
    """(plain_key, marked_keys, bare): the names of ``public_names`` by their words without marks; ``bare`` where one is listed without any."""
    k = people.select("marked", "plain", "marks").distinct()
    return k.groupBy(F.xxhash64("plain").alias("plain_key")).agg(F.collect_set(F.xxhash64("marked")).alias("marked_keys"), F.max(~F.col("marks")).alias("bare"))


_TERM = "text_hash bigint, start int, end int, type string, text string, whole boolean, marked string, plain string, contexts array<string>"


def terms_of(df: DataFrame, key: str, text: str, lexicon: tuple[bytes, bytes, bytes, bytes]) -> DataFrame:
    """One row per term of each text with its place and contexts. Texts are read whole; null and empty ones give none.

    ``text_hash`` tells the texts of repeated keys apart. The broadcast is four word filters of 2 MB.
    """
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pitchlake.llm.privacy import Lexicon, _rows
        from pitchlake.llm.wordsets import WordFilter

        known = Lexicon(*[WordFilter(b) for b in sent.value])
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t:
                    found = _rows(t, known)
                    rows += found
                    at += [i] * len(found)
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            at = pa.array(at, pa.int32())
            arrays = [b.column(0).take(at), b.column(1).take(at), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "text_hash", "start", "end", "type", "text", "whole", "marked", "plain", "contexts"])

    return df.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {_TERM}")


#: Bits of information on a private person, and share of private names, from which a context removes a name.
THRESHOLD_BITS, THRESHOLD_SHARE = 1.0, 0.5
#: Information is measured against a prior of at most this: a context at the share above has the bits above even where most names are private.
MOST_PRIOR = THRESHOLD_SHARE / 2**THRESHOLD_BITS
#: Names as common as the corpus's that each context is counted with, so that few cases decide little.
SMOOTHING = 1


def revealing_contexts(terms: DataFrame) -> DataFrame:
    """(direct, context, any): contexts that reveal private persons, of names and of direct identifiers apart.

    ``terms`` has direct, personal, whole and contexts. ``any`` is the share of personal terms among all in the context,
    short names included.
    """
    count = lambda c: F.sum(F.col(c).cast("int"))
    seen = terms.select("direct", F.explode("contexts").alias("context"), "personal", "whole")
    seen = seen.groupBy("direct", "context").agg(count("personal").alias("personal"), count("whole").alias("whole"), F.count("*").alias("n")).filter("personal > 0")
    totals = terms.groupBy("direct").agg((F.greatest(count("personal"), F.lit(1)) / F.greatest(count("whole"), F.lit(1))).alias("prior"))
    share = lambda n: (F.col("personal") + SMOOTHING * F.col("prior")) / (F.col(n) + SMOOTHING)
    told = seen.join(F.broadcast(totals), "direct").withColumn("any", share("n")).withColumn("of_whole", share("whole"))
    bits = F.log2(F.col("of_whole") / F.least("prior", F.lit(MOST_PRIOR)))
    return told.filter((F.col("of_whole") >= THRESHOLD_SHARE) & (bits >= THRESHOLD_BITS)).select("direct", "context", "any")


def private_spans(df: DataFrame, key: str, text: str, public: DataFrame) -> DataFrame:
    """(key, text_hash, start, end, pii_type, pii_text): the pieces of personal information of each text and their places.

    ``public`` has the names of persons who are public. A text without any gives no row; null and empty texts none.
    """
    people = materialize(public_names(public), "p10-public")
    found = materialize(terms_of(df, key, text, lexicon_bits(people)), "p10-terms")
    names = found.filter("type = 'name'").withColumn("marked_key", F.xxhash64("marked")).withColumn("plain_key", F.xxhash64("plain"))
    # a name is listed as it stands; written without marks, or where the list has it without, by its letters alone
    listed = F.col("marked_keys").isNotNull() & (F.col("bare") | F.array_contains("marked_keys", F.col("marked_key")) | (F.col("marked_key") == F.col("plain_key")))
    place = [F.col(key), F.col("text_hash"), F.col("start"), F.col("end"), F.col("type").alias("pii_type"), F.col("text").alias("pii_text")]
    names = names.join(public_keys(people), "plain_key", "left").withColumn("personal", F.col("whole") & ~F.coalesce(listed, F.lit(False)))
    direct = found.filter("type <> 'name'").select(*place, F.lit(True).alias("direct"), "whole", (F.col("type") != "other").alias("personal"), "contexts")
    terms = materialize(names.select(*place, F.lit(False).alias("direct"), "whole", "personal", "contexts").unionByName(direct), "p10-judged")
    revealing = materialize(revealing_contexts(terms), "p10-contexts")
    asked = terms.filter("personal OR NOT whole").withColumn("context", F.explode("contexts"))
    removed = asked.join(revealing, ["direct", "context"]).filter(F.col("whole") | (F.col("any") >= THRESHOLD_SHARE))
    return removed.select(key, "text_hash", "start", "end", "pii_type", "pii_text").distinct()


def personal_information(df: DataFrame, key: str, text: str, public: DataFrame) -> DataFrame:
    """(key, pii_type, pii_text): the different pieces of personal information of each text, exactly as they stand."""
    return private_spans(df, key, text, public).select(key, "pii_type", "pii_text").distinct()


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text with the spans (start, end, type), which don't overlap, replaced by ``[TYPE]``."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, key: str, text: str, public: DataFrame) -> DataFrame:
    """(key, text): each text with its personal information replaced by ``[EMAIL]``, ``[NAME]`` and so on; null stays null.

    Pieces are replaced at their places, so equal characters elsewhere stay. Every row of ``df`` comes out once.
    """
    spans = private_spans(df, key, text, public)
    pieces = spans.groupBy(F.col(key).alias("_key"), "text_hash").agg(F.collect_list(F.struct("start", "end", "pii_type")).alias("pieces"))

    @F.pandas_udf("string")
    def replace(texts, pieces):
        from pitchlake.llm.privacy import replace_spans

        return pd.Series([t if t is None or ps is None else replace_spans(t, [tuple(p.values()) for p in ps]) for t, ps in zip(texts, pieces)], dtype=object)

    texts = df.select(F.col(key), F.col(text), F.xxhash64(text).alias("_hash"))
    joined = texts.join(pieces, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("text_hash")), "left")
    return joined.select(key, replace(F.col(text), "pieces").alias(text))
