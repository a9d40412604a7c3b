"""Visually identical text in one form, by SQL of an embedded DuckDB inside Arrow partitions.

The plain form has composed letters of ordinary width, single ordinary spaces inside only, nothing invisible, and in each
text with a Latin letter only letters of the Vietnamese or English alphabet. A text wholly in another script keeps its
letters. The steps are expressions of one SQL statement: ``nfc_normalize``, ``translate`` for compatibility forms and
look-alikes, and regular expressions for invisible characters and white space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Letters of other scripts and kinds that look like Latin letters, and the letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "в": "b", "н": "h", "м": "m", "п": "n", "и": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "γ": "y",
    "Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "Y", "Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "ſ": "s", "Ɩ": "I", "ƀ": "b", "Օ": "O", "օ": "o", "ո": "n", "հ": "h", "ս": "u",
}
# Characters that show nothing, and characters that show as white space, as regular expression classes.
INVISIBLE = r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]"
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{2800}\x{3000}]"
_VOWELS = "aăâeêioôơuưy"
_TONES = "̣̀́̃̉"


def alphabet() -> str:
    """Letters of the Vietnamese and English alphabets, both cases, composed."""
    low = {chr(c) for c in range(97, 123)} | {"đ", *_VOWELS} | {unicodedata.normalize("NFC", v + t) for v in _VOWELS for t in _TONES}
    return "".join(sorted(low | {c.upper() for c in low}))


@lru_cache(maxsize=1)
def width_table() -> tuple[str, str]:
    """Compatibility forms of one character (full and half width, fonts, circles, scripts above and below) and their ordinary ones."""
    pairs = {}
    for block in (range(0xA8, 0x250), range(0x2B0, 0x300), range(0x1D00, 0x1E00), range(0x2070, 0x24F0), range(0x3000, 0x3001), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x1F130, 0x1F14A)):
        for code in block:
            ch = chr(code)
            if unicodedata.decomposition(ch).startswith("<"):
                plain = unicodedata.normalize("NFKC", ch)
                if len(plain) == 1 and plain != ch and not plain.isspace():
                    pairs[ch] = plain
    return "".join(pairs), "".join(pairs.values())


@lru_cache(maxsize=1)
def letter_table() -> tuple[str, str]:
    """Letters outside the alphabet and those that stand for them: look-alikes, and foreign marks dropped."""
    known = set(alphabet())
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch not in known and base != ch and base.isascii() and base.isalpha():
            pairs[ch] = base
    pairs |= LOOKALIKES
    return "".join(pairs), "".join(pairs.values())


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ready_sql(column: str) -> str:
    """DuckDB expression: a text is plain by its characters alone."""
    sign = f"[!-~–—’‘“”…{alphabet()}]"
    return f"regexp_full_match({column}, {_quoted(f'(?:{sign}+(?: {sign}+)*)?')})"


def plain_sql(column: str) -> str:
    """DuckDB expression for the plain form of a text column. Null stays null, an empty text empty.

    A text of single-spaced letters of the alphabet, ASCII signs and common punctuation is its own plain form, which one
    pass of a regular expression tells; only the others take the steps.
    """
    width, letters = width_table(), letter_table()
    s = f"translate(nfc_normalize({column}), {_quoted(width[0])}, {_quoted(width[1])})"
    s = f"regexp_replace({s}, {_quoted(INVISIBLE)}, '', 'g')"
    s = f"nfc_normalize(trim(regexp_replace({s}, {_quoted(SPACES + '+')}, ' ', 'g')))"
    latin = f"regexp_replace(nfc_normalize(translate(x, {_quoted(letters[0])}, {_quoted(letters[1])})), '[\\x{{300}}-\\x{{36f}}]', '', 'g')"
    mapped = f"list_transform([{s}], lambda x: CASE WHEN regexp_matches(x, '\\p{{Latin}}') THEN {latin} ELSE x END)[1]"
    return f"CASE WHEN {ready_sql(column)} THEN {column} ELSE {mapped} END"


def strange_sql(plain: str) -> str:
    """DuckDB expression: a Latin text in plain form still holds a letter outside the alphabet."""
    return f"(regexp_matches({plain}, '\\p{{Latin}}') AND regexp_matches(regexp_replace({plain}, {_quoted('[' + alphabet() + ']')}, '', 'g'), '\\p{{L}}'))"


def variant_sql(source: str, key: str, columns: list[str]) -> str:
    """DuckDB statement: (key, field) of the cells of ``columns`` that aren't in plain form."""
    parts = [
        f"SELECT {key}, '{c}' AS field FROM (SELECT {key}, {c}, {plain_sql(c)} AS plain FROM {source} WHERE {c} IS NOT NULL AND NOT {ready_sql(c)}) WHERE plain <> {c} OR {strange_sql('plain')}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


_CONNECTION: list = []


def run_sql(statement: str, batch: pa.RecordBatch) -> pa.Table:
    """Result of a DuckDB statement over one Arrow batch, which it names ``batch``; one connection a worker, one thread."""
    import duckdb

    if not _CONNECTION:
        _CONNECTION.append(duckdb.connect(config={"threads": 1, "memory_limit": "600MB"}))
    con = _CONNECTION[0]
    con.register("batch", pa.Table.from_batches([batch]))
    table = con.sql(statement).to_arrow_table()
    con.unregister("batch")
    return table


def _map(df: DataFrame, statement: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pitchlake.llm.lookalikes import run_sql

        for b in batches:
            yield from run_sql(statement, b).to_batches()

    return df.mapInArrow(run, schema)


def plain_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``{column}_plain`` beside each text column: its plain form. No shuffle."""
    added = ", ".join(f"{plain_sql(f'"{c}"')} AS \"{c}_plain\"" for c in columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{c}_plain` string" for c in columns)
    return _map(df, f"SELECT *, {added} FROM batch", schema)


def not_plain(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field): one row per non-null cell of ``columns`` that isn't in plain form. An empty text is plain. No shuffle."""
    kind = df.schema[key].dataType.simpleString()
    return _map(df.select(key, *columns), variant_sql("batch", key, columns), f"`{key}` {kind}, field string")
