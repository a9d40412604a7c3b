"""Text helpers shared by the operators on names: folding, edit distance, deletion neighbourhoods."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

_APART = re.compile(r"[\W_]+")
_MARKS = re.compile("[̀-ͯ]")


def tidy(s: str) -> str:
    """Composed lower-case text with punctuation as single spaces; marks stay."""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s).lower().replace("ð", "đ")
    return _APART.sub(" ", unicodedata.normalize("NFC", s.lower())).strip()


def bare(s: str) -> str:
    """A tidy text without marks, đ as d."""
    return s if s.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", s)).replace("đ", "d")


def fold(s: str) -> str:
    """``tidy`` without marks, đ as d."""
    return bare(tidy(s))


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``; ``most + 1`` where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletions(s: str, most: int) -> set[str]:
    """``s`` and what is left of it after deleting up to ``most`` characters: two strings within ``most`` edits share one."""
    out = {s}
    for n in range(1, min(most, len(s)) + 1):
        for cut in combinations(range(len(s)), n):
            kept, last = [], 0
            for c in cut:
                kept.append(s[last:c])
                last = c + 1
            kept.append(s[last:])
            out.add("".join(kept))
    return out


def plain_name(s: str) -> str:
    """``tidy`` of the text with look-alike letters replaced where it holds a Latin letter."""
    global _LETTERS
    if _LETTERS is None:
        from pitchlake.llm.lookalikes import INVISIBLE, letter_table

        _LETTERS = (str.maketrans(*letter_table()), re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", INVISIBLE)))
    if not s.isascii():
        s = _LETTERS[1].sub("", unicodedata.normalize("NFKC", s))
        if _ASCII_LETTER.search(s):
            s = s.translate(_LETTERS[0])
    return tidy(s)


_ASCII_LETTER = re.compile("[A-Za-z]")
_LETTERS = None

# Words that make a club's name out of its proper name, folded, longest first.
CLUB_WORDS = ("cau lac bo bong da", "cau lac bo", "doi bong da", "doi bong", "football club", "bong da", "clb", "f c", "fc", "s c", "sc")
_CLUB = re.compile(r"\b(?:" + "|".join(CLUB_WORDS) + r")\b")


def club_core(s: str) -> str:
    """Folded name of a club without the words that every club may bear; a side marked B keeps its b."""
    return " ".join(_CLUB.sub(" ", bare(plain_name(s))).split())
