"""Column expressions on text. All stay in the JVM but those marked as Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters by case, for patterns that must not depend on a regular expression engine's Unicode mode.
UPPER = "A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"


def null_if_blank(c: Column) -> Column:
    """Null for null, empty and blank texts, else the trimmed text."""
    return F.nullif(F.trim(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    """First text that isn't null or blank."""
    return F.coalesce(*[null_if_blank(c) for c in columns])


def squash(c: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))


def clean_name(c: Column) -> Column:
    """A name without text in parentheses, wiki links and tags."""
    c = F.regexp_replace(c, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>", ""), r"\([^()]*\)", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_templates(text: str) -> str:
    """A wiki text without its templates, however deep they nest; braces that nothing closes stay."""
    out: list[str] = []
    opened: list[int] = []
    at = 0
    for m in _BRACES.finditer(text):
        if m.group() == "{{":
            out.append(text[at : m.start()])
            opened.append(len(out))
            at = m.start()
        elif opened:
            del out[opened.pop() :]
            at = m.end()
    return "".join([*out, text[at:]])


_BRACES = re.compile(r"\{\{|\}\}")


def without_templates(c: Column) -> Column:
    """``strip_templates`` of a column (Arrow function)."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        from pitchlake.functions.text import strip_templates

        return s.map(lambda x: strip_templates(x) if x is not None and "{{" in x else x)

    return strip(c)


def clean_wikitext(c: Column) -> Column:
    """Text without references, links, templates, tags and quotes marks of wiki markup."""
    c = F.regexp_replace(c, r"(?s)<ref[^<>]*?/>|<ref[^<>]*>.*?</ref>", "")
    c = F.regexp_replace(c, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    c = without_templates(c)
    c = F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>", ""), "'{2,}", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def article_text(c: Column) -> Column:
    """Prose of a wiki page: ``clean_wikitext`` without comments, tables, files, categories, links to the web, headings' signs, list signs and character entities."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->|\{\|.*?\|\}", "")
    c = F.regexp_replace(c, r"(?i)\[\[(?:file|image|tập tin|hình|category|thể loại):(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"), r"https?://\S+", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^={2,6}\s*(.*?)\s*={2,6}\s*$", "$1"), r"(?m)^[*#:;]+\s*", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return clean_wikitext(c)


def clean_text(c: Column) -> Column:
    """Text without links, mail addresses, tags and signs that are neither letters, digits nor common punctuation, white space runs as one space."""
    c = F.regexp_replace(c, r"https?://[^ \t\r\n]+", " ")
    c = F.regexp_replace(c, r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", " ")
    c = F.regexp_replace(c, r"<[^<>]*>", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}\s.,;:!?()'\"/%&+-]", " ")
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def field_name(c: Column, names: dict[str, str]) -> Column:
    """Name of an infobox field: trimmed, lower case, spaces as underscores, then mapped where it or its spaced form is known."""
    key = F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(known, key), F.element_at(known, F.replace(key, F.lit("_"), F.lit(" "))), key)


def year_in(c: Column) -> Column:
    """First year 19xx or 20xx in a text."""
    return F.regexp_extract(c, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")


def last_year_in(c: Column) -> Column:
    """Last year 19xx or 20xx in a text."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1)), F.lit(-1)).try_cast("int")


def year_range(c: Column) -> Column:
    """struct(from_year, to_year): two years; one with a word for the present has an open end; one alone is both; two-digit ends are expanded."""
    years = F.regexp_extract_all(c, F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1))
    short = F.regexp_extract(c, r"((?:19|20)[0-9]{2})\s*[-–—/]\s*([0-9]{2})(?![0-9])", 2)
    start = F.try_element_at(years, F.lit(1)).try_cast("int")
    second = F.try_element_at(years, F.lit(2)).try_cast("int")
    expanded = F.when(short != "", F.floor(start / 100) * 100 + short.try_cast("int")).cast("int")
    expanded = F.when(expanded < start, expanded + 100).otherwise(expanded)
    is_open = F.lower(c).rlike(r"nay|hiện tại|present|now|[-–—]\s*$")
    end = F.when(second.isNotNull(), second).when(expanded.isNotNull(), expanded).when(is_open, F.lit(None).cast("int")).otherwise(start)
    return F.struct(start.alias("from_year"), end.alias("to_year"))


def digits_int(c: Column) -> Column:
    """The digits of a text as a number, null without any."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint")


def capacity(c: Column) -> Column:
    """Number of seats: thousands separators dropped, first run of digits."""
    return F.regexp_extract(F.regexp_replace(c, r"([0-9])[.,  ]([0-9]{3})(?![0-9])", "$1$2"), r"([0-9]+)", 1).try_cast("bigint")


def height_m(c: Column) -> Column:
    """Height in metres by the plain rule: first figure, divided by 100 above 2.5, two places; null where there is none."""
    kept = F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, r"[^0-9., ]", ""), F.lit(","), F.lit(".")), " +", " "))
    value = F.split(kept, " ")[0].try_cast("decimal(12,4)")
    return F.round(F.when(value > 2.5, value / 100).otherwise(value), 2).cast("double")


def birth_year(c: Column, low: int = 1940, high: int = 2010) -> Column:
    """First four digits of a date text where they make a year in the range."""
    y = F.regexp_extract(c, r"([0-9]{4})", 1).try_cast("int")
    return F.when(y.between(low, high), y)


def parse_date(c: Column) -> Column:
    """ISO text of a date: ISO, day/month/year, or named month in English or Vietnamese; a year alone becomes January 1."""
    iso = F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    template = F.regexp_extract(c, r"\|\s*([0-9]{4})\s*\|\s*([0-9]{1,2})\s*\|\s*([0-9]{1,2})", 0)
    dmy = r"([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})"
    viet = r"(?i)([0-9]{1,2})\s+tháng\s+([0-9]{1,2})(?:\s*,|\s+năm)?\s+([0-9]{4})"
    english = r"(?i)([0-9]{1,2})\s+(january|february|march|april|may|june|july|august|september|october|november|december)\s+([0-9]{4})"
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

    def joined(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    number = F.array_position(F.array(*[F.lit(m) for m in months]), F.lower(F.regexp_extract(c, english, 2))).cast("string")
    parts = F.regexp_extract_all(template, F.lit("([0-9]+)"), F.lit(1))
    year = F.regexp_extract(c, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    return (
        F.when(template != "", joined(parts[0], parts[1], parts[2]))
        .when(iso != "", iso)
        .when(F.regexp_extract(c, dmy, 0) != "", joined(F.regexp_extract(c, dmy, 3), F.regexp_extract(c, dmy, 2), F.regexp_extract(c, dmy, 1)))
        .when(F.regexp_extract(c, viet, 0) != "", joined(F.regexp_extract(c, viet, 3), F.regexp_extract(c, viet, 2), F.regexp_extract(c, viet, 1)))
        .when(F.regexp_extract(c, english, 0) != "", joined(F.regexp_extract(c, english, 3), number, F.regexp_extract(c, english, 1)))
        .when(year != "", F.concat(year, F.lit("-01-01")))
    )


def json_list(c: Column, element: str) -> Column:
    """A JSON list as an array, an empty one where it isn't a list."""
    return F.coalesce(F.from_json(c, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def json_text(c: Column) -> Column:
    """JSON of an array, ``[]`` for null."""
    return F.coalesce(F.to_json(c), F.lit("[]"))


def split_list(c: Column) -> Column:
    """Parts of a list in text, split at commas and line ends, blanks dropped."""
    return F.filter(F.transform(F.split(c, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def safe_int(c: Column) -> Column:
    """Whole number of a text that may have been widened to a float, null where it is none."""
    return c.try_cast("double").try_cast("bigint")


def safe_bool(c: Column) -> Column:
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def split_two_scripts(c: Column, foreign: str) -> Column:
    """``A (B)`` for a name whose first part matches the pattern ``foreign`` and whose rest, longer than two letters, is written together with it."""
    whole = rf"^({foreign}) ([{UPPER}].{{2,}})$"
    return F.when(c.rlike(whole), F.regexp_replace(c, whole, "$1 ($2)")).otherwise(c)


def without_prefix(c: Column, prefixes: list[str]) -> Column:
    """A name without the first of the prefixes that it begins with."""
    return F.regexp_replace(c, rf"^(?:{'|'.join(re.escape(p) for p in prefixes)})\s+", "")


def ngrams(words: Column, longest: int) -> Column:
    """All runs of up to ``longest`` words as texts, longest first."""
    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    parts = [runs(n) for n in range(longest, 0, -1)]
    return F.flatten(F.array(*parts))


def name_variants(c: Column) -> Column:
    """Forms under which a person's name is mentioned: whole, without its first word, last word, last two words."""
    w = F.split(c, " ")
    rest = F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " ")
    last = F.element_at(w, -1)
    two = F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2), " ")
    return F.array_distinct(F.filter(F.array(c, rest, last, two), lambda x: x != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Half the share of words that two texts have in common, of the longer set."""
    x, y = F.array_distinct(F.split(F.lower(a), " ")), F.array_distinct(F.split(F.lower(b), " "))
    return F.lit(0.5) * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def context_window(text: Column, term: Column, around: int) -> Column:
    """The term's first occurrence with so many characters before and after it, null without one."""
    at = F.instr(text, term)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(term) + around))


def unique_sentences(c: Column) -> Column:
    """A text's sentences, repeated ones once, in order."""
    return F.array_join(F.array_distinct(F.split(c, r"(?<=[.!?])\s+")), " ")


# Signs that are typed for a Vietnamese letter or mark.
REPLACED = {"Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ʼ": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\u0340": "\u0300", "\u0341": "\u0301"}


def nfc(c: Column, replaced: dict[str, str] | None = None) -> Column:
    """Composed form of a text, with signs replaced by a table before (Arrow function; Spark has no built-in one)."""
    signs = str.maketrans(replaced or {})

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.translate(signs) if signs else x))

    return compose(c)


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts by their sets of words, 0 to 1: best ratio among the shared words and each side's rest."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(s - (x & y)))}".strip() for s in (x, y))
    return max(_ratio(both, one), _ratio(both, two), _ratio(one, two)) if both else _ratio(one, two)


def _ratio(a: str, b: str) -> float:
    """2 x longest common subsequence over both lengths."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, other in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if ch == other else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def similarity(a: Column, b: Column) -> Column:
    """``token_set_ratio`` of two columns (Arrow function)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from pitchlake.functions.text import token_set_ratio

        return pd.Series([token_set_ratio(p, q) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """A folded text holds one of the words; false for null."""
    low, out = F.lower(c), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def classified(c: Column, rules: list[tuple[tuple[str, ...], str]], default: str | None) -> Column:
    """Class of the first rule (words, class) of which the folded text holds a word, else ``default``."""
    out = F.lit(default)
    for words, name in reversed(rules):
        out = F.when(contains_any(c, words), name).otherwise(out)
    return out


def mapped(c: Column, pairs: list[tuple[str, str]], default: Column) -> Column:
    """Value of the key that equals the folded text, else of the first key in it, else ``default``; null for null and blank texts.

    ``pairs`` are (folded key, value) of a small list of fixed size; of equal keys the first counts.
    """
    low = F.lower(F.trim(c))
    none = F.lit(None).cast("string")
    exact = F.coalesce(none, *[F.when(low == k, F.lit(v)) for k, v in pairs])
    first = F.coalesce(none, *[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in pairs])
    return F.when(low.isNotNull() & (low != ""), F.coalesce(exact, first, default))


def title_case(c: Column) -> Column:
    """Capital letters after every sign that is no letter, small ones elsewhere."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(x)).otherwise(F.lower(x))), "")


def season(c: Column) -> Column:
    """struct(year, years): the first year of a text and the span it begins, a two-digit end completed from the start; null without a year."""
    found = r"([0-9]{4})(?:\s*[-–]\s*([0-9]{4}|[0-9]{2}))?"
    year, end = F.regexp_extract(c, found, 1), F.regexp_extract(c, found, 2)
    end = F.when(F.length(end) == 2, F.concat(F.left(year, F.lit(2)), end)).otherwise(end)
    span = F.when(end != "", F.concat_ws("-", year, end)).otherwise(year)
    return F.struct(F.nullif(year, F.lit("")).cast("int").alias("year"), F.nullif(span, F.lit("")).alias("years"))


def corrected(c: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A text in which, for each rule (sign, wrong, right), ``wrong`` is replaced where ``sign`` stands beside it."""
    for sign, wrong, right in rules:
        c = F.when(c.contains(sign) & c.contains(wrong), F.replace(c, F.lit(wrong), F.lit(right))).otherwise(c)
    return c


def normal_answer(c: Column) -> Column:
    """``true``, ``false``, ``yes`` or ``no`` of an answer that says so at its start, else the folded answer."""
    low = F.trim(F.lower(F.regexp_replace(c, r"[.!?,;:\"']+", " ")))
    first = F.regexp_extract(low, r"^(không đúng|không|có|đúng|sai|true|false|yes|no)(?: |$)", 1)
    named = F.create_map(*[F.lit(x) for kv in {"đúng": "true", "true": "true", "sai": "false", "false": "false", "không đúng": "false", "có": "yes", "yes": "yes", "không": "no", "no": "no"}.items() for x in kv])
    return F.coalesce(F.element_at(named, F.nullif(first, F.lit(""))), low)


def answers_match(given: Column, expected: Column) -> Column:
    """Two answers are the same: equal in normal form, or one holds the other where neither is a mere yes or no."""
    a, b = normal_answer(given), normal_answer(expected)
    plain = F.array(*[F.lit(x) for x in ("true", "false", "yes", "no")])
    free = ~F.array_contains(plain, a) & ~F.array_contains(plain, b) & (a != "") & (b != "")
    return F.coalesce((a == b) | (free & (F.contains(a, b) | F.contains(b, a))), F.lit(False))


def without_affixes(c: Column, affixes: list[str]) -> Column:
    """A folded name without the affixes anywhere in it."""
    return squash(F.regexp_replace(F.lower(c), "|".join(re.escape(a) for a in affixes), " "))


def without_special_tokens(c: Column) -> Column:
    """An answer of a language model without its control tokens, repeated sentences once."""
    return unique_sentences(F.trim(F.regexp_replace(c, r"<\|[^|<>]*\|>|</?s>|\[/?INST\]|<(?:pad|unk|eos|bos)>", "")))


def masked_ngrams(words: Column, longest: int, stop: list[str]) -> Column:
    """Runs of up to ``longest`` words, longest first, without those that are stop words alone."""
    return F.filter(ngrams(words, longest), lambda g: ~F.lower(g).isin(*stop))
