"""Freely typed values mapped to the entries of a reference list.

A multi-pattern automaton over the folded canonical names and aliases finds mentions embedded in a value; of mentions
that overlap the longest wins. What has no mention goes to token-set similarity: the value's words are compared as a set
with the words of every name that shares a near word, each word with its nearest by edits, so that typing errors, reordered,
joined and abbreviated words still find their entry. Near words are found through deletion neighbourhoods of the list's
words. Values that reach neither are reported as unmatched. The list is small and of fixed size; it is sent to the workers as
part of the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchlake.llm.names import deletions, edits, fold, tidy

UNMATCHED = "UNMATCHED"
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")

# Short forms of positions by code, folded.
POSITION_ALIASES = {
    "GK": ("goalie", "keeper", "goal keeper", "tm"),
    "DF": ("def", "defence", "hv", "back", "back line defender"),
    "CB": ("center back", "centre half", "center half", "central defender", "stopper", "hv giua", "trung ve"),
    "LB": ("left fullback", "left full back", "hv trai", "left defender"),
    "RB": ("right fullback", "right full back", "hv phai", "right defender"),
    "MF": ("mid", "midfield", "tv"),
    "DM": ("cdm", "def mid", "defensive mid", "holding midfielder", "tv phong ngu", "tv tru", "tien ve mo neo", "mo neo", "anchor"),
    "CM": ("c midfielder", "central mid", "center midfielder", "centre midfielder", "tv trung tam", "tv giua"),
    "AM": ("cam", "att mid", "attacking mid", "playmaker", "tv tan cong"),
    "LW": ("left wing", "canh trai", "td canh trai", "left wingman"),
    "RW": ("right wing", "canh phai", "td canh phai", "right wingman"),
    "FW": ("fwd", "attacker", "td", "tien dao"),
    "ST": ("cf", "centre forward", "center forward", "td cam", "trung phong", "number 9", "main striker", "chan sut cam"),
    "SS": ("td lui", "ho cong", "second forward", "support striker", "2nd striker"),
}
# Words before the name of a place below a province, and words that say nothing of which province, folded.
LOWER_UNITS = ("xa", "huyen", "lang", "thon", "ap", "phuong", "quan", "thi tran", "thi xa", "ban", "commune", "district", "ward", "village", "town")
PLACE_NOISE = ("tinh", "thanh pho", "tp", "t p", "province", "city", "nay thuoc", "now")


def set_errors(a: tuple[str, ...], b: tuple[str, ...], most: int) -> int:
    """Errors between two sets of words: edits of each word from its partner, the letters of words without one, and one more where the order differs.

    The best assignment counts; ``most + 1`` where there are more errors. The similarity of the sets is 1 less the errors'
    share of the letters.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a

    def best(i: int, left: tuple[str, ...], low: int, moved: int, allowed: int) -> int:
        """Errors of the words of ``a`` from the i-th on with the words ``left``, of which those from ``low`` on keep the order."""
        if i == len(a):
            return min(sum(map(len, left)), allowed + 1)
        out = allowed + 1
        for j, w in enumerate(left):
            turn = int(j < low and not moved)
            n = edits(a[i], w, allowed) + turn
            if n <= allowed:
                out = min(out, n + best(i + 1, left[:j] + left[j + 1 :], j, moved or turn, allowed - n))
                if out == 0:
                    break
        return min(out, len(a[i]) + best(i + 1, left, low, moved, allowed - len(a[i]))) if len(a[i]) <= allowed else out

    return min(best(0, tuple(b), 0, 0, most), most + 1)


@dataclass
class Canonicalizer:
    """Maps one value at a time. ``names`` are (target, name) pairs, aliases included.

    ``first`` takes the first part of a value only and its first mention; otherwise the last mention counts, as the
    widest unit of an address stands last. A part that follows a word of ``lower`` isn't an entry of the list.
    """

    names: list[tuple[str, str]]
    first: bool = False
    lower: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    full: dict[str, str] = field(default_factory=dict)
    exact: dict[str, str] = field(default_factory=dict)
    _memo: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        by_name: dict[str, set[str]] = {}
        for target, name in self.names:
            f = fold(name)
            forms = {f}
            words = f.split()
            if len(words) == 2:
                forms.add(f"{words[0][0]} {words[1]}")
            for form in forms:
                by_name.setdefault(form, set()).add(target)
        self.full = full = {fold(name): target for target, name in self.names}
        self.exact = full | {n: next(iter(t)) for n, t in by_name.items() if len(t) == 1 and n not in full}
        self.automaton = ahocorasick.Automaton()
        for n in self.exact:
            if len(n) > 3:  # shorter ones only stand alone
                self.automaton.add_word(f" {n} ", n)
        self.automaton.make_automaton()
        self.sets: dict[str, list[tuple[str, ...]]] = {}  # the sets of words of each name: its words, and all of them joined
        self.by_word: dict[str, set[str]] = {}
        self.longest = 0
        for n in self.exact:
            joined = n.replace(" ", "")
            self.sets[n] = [tuple(n.split())] + ([(joined,)] if " " in n else [])
            self.longest = max(self.longest, len(joined))
            most = self._allowed(joined)
            for words in self.sets[n]:
                for w in words:  # of several words one has at most half of the errors
                    for d in deletions(w, most if len(words) == 1 else most // 2):
                        self.by_word.setdefault(d, set()).add(n)
        self.marked = {}
        for _, name in self.names:
            self.marked.setdefault(fold(name), tidy(name).replace(" ", ""))

    @staticmethod
    def _allowed(name: str) -> int:
        """Errors that a name may be typed with, by its letters."""
        return 2 if len(name) >= 6 else 1 if len(name) >= 4 else 0

    def _mentions(self, part: str) -> list[tuple[int, int, str]]:
        """Longest non-overlapping mentions (start, end, name) in a folded part, in order."""
        text = f" {part} "
        found = sorted(((end - len(n) - 1, end + 1, n) for end, n in self.automaton.iter(text)), key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int, str]] = []
        for s, e, n in found:
            if all(e - 1 <= ts or s + 1 >= te for ts, te, _ in taken):
                taken.append((s, e, n))
        return sorted(taken)

    def _below(self, part: str, at: int) -> bool:
        return any(part[:at].rstrip().endswith(w) and (len(part[:at].rstrip()) == len(w) or part[:at].rstrip()[-len(w) - 1] == " ") for w in self.lower)

    def _bare(self, part: str) -> str:
        """A part without its words of ``noise``; empty where it begins with a word of ``lower``."""
        text = f" {part} "
        for w in self.noise:
            text = text.replace(f" {w} ", " ")
        return "" if any(text.startswith(f" {w} ") for w in self.lower) else text.strip()

    def _near_names(self, words: tuple[str, ...]) -> set[str]:
        """Names with a word near one of the value's words."""
        out: set[str] = set()
        for w in words:
            if len(w) <= self.longest + 2:  # a longer word is within two edits of no word of the list
                for d in deletions(w, 2 if len(words) == 1 else 1):
                    out |= self.by_word.get(d, set())
        return out

    def _similar(self, part: str, raw: str) -> str | None:
        """Name most similar to a whole part by its set of words, within the allowed errors, or None where none or two are."""
        text = self._bare(part)
        words = tuple(text.split())
        if not words:
            return None
        sets = [words] + ([("".join(words),)] if len(words) > 1 else [])
        marked = "".join(w for w in tidy(raw).split() if fold(w) in words)
        found: dict[str, tuple] = {}
        for n in {n for own in sets for n in self._near_names(own)}:
            joined = self.sets[n][-1][0] if len(self.sets[n]) > 1 else self.sets[n][0][0]
            most = self._allowed(joined)
            errors = min(set_errors(own, other, most) for own in sets for other in self.sets[n])
            if errors <= most:
                found[n] = (errors, n not in self.full, edits(marked, self.marked.get(n, joined), 6))
        if not found:
            return None
        best = min(found.values())
        names = [n for n, score in found.items() if score == best]
        return min(names) if len({self.exact[n] for n in names}) == 1 else None

    def map(self, value: str) -> str:
        """Target of a value, or ``UNMATCHED``."""
        hit = self._memo.get(value)
        if hit is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            hit = self._memo[value] = self._map(value)
        return hit

    def _map(self, value: str) -> str:
        value = _LINK.sub(r" \1 ", value)
        parts = [p for p in re.split(r"[,;/()\n]+", value) if p.strip()]
        if self.first:
            parts = parts[:1] if parts else []
        best: str | None = None
        for p in parts if self.first else reversed(parts):
            f = fold(p)
            inside = [(s, n) for s, _, n in self._mentions(f) if not self._below(f, s)]
            mention = (inside[0] if self.first else inside[-1])[1] if inside else None
            if mention is not None and len(mention) == len(self._bare(f)):
                return self.exact[mention]
            whole = self._similar(f, p)
            name = whole if whole is not None and (mention is None or len(whole) > len(mention)) else mention
            if name is not None:
                if mention is not None or self.first:
                    return self.exact[name]
                best = best or name
        return UNMATCHED if best is None else self.exact[best]


def place_canonicalizer(provinces: Iterable) -> Canonicalizer:
    """For birthplaces: the list's names; mentions below a province don't count."""
    return Canonicalizer([(r["name"], r["name"]) for r in provinces], lower=LOWER_UNITS, noise=PLACE_NOISE)


def position_canonicalizer(positions: Iterable) -> Canonicalizer:
    """For positions: codes, English and Vietnamese names, short forms; of several positions the first counts."""
    names = [(r["position_code"], n) for r in positions for n in (r["position_code"], r["position_name"], r["position_name_vi"], *POSITION_ALIASES.get(r["position_code"], ()))]
    return Canonicalizer(names, first=True)


def to_canonical(column: Column, canonicalizer: Canonicalizer) -> Column:
    """Target of each value of a column, ``UNMATCHED`` where it reaches no entry; null stays null.

    Empty texts are unmatched, texts of any length are read whole, equal texts get equal targets. No shuffle.
    """
    names, first, lower, noise = canonicalizer.names, canonicalizer.first, canonicalizer.lower, canonicalizer.noise

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        from pitchlake.llm.canonical import worker_canonicalizer

        own = worker_canonicalizer(tuple(names), first, lower, noise)
        codes, texts = pd.factorize(s)
        mapped = pd.Series([own.map(t) for t in texts], dtype=object)
        return pd.Series([None if c < 0 else mapped[c] for c in codes], dtype=object)

    return convert(column)


_OWN: dict = {}


def worker_canonicalizer(names: tuple, first: bool, lower: tuple, noise: tuple) -> Canonicalizer:
    """This worker's canonicalizer for a list."""
    key = (names, first, lower, noise)
    if key not in _OWN:
        _OWN.clear() if len(_OWN) > 8 else None
        _OWN[key] = Canonicalizer(list(names), first, lower, noise)
    return _OWN[key]
