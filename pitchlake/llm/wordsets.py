"""Sets of words in filters of fixed size, which are sent to the workers however many words there are."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.names import bare


@lru_cache(maxsize=200_000)
def word_forms(word: str) -> tuple[str, str]:
    """A word in lower case, composed, and after ~ without marks; the mark tells the sets of the two apart."""
    low = unicodedata.normalize("NFC", word).lower()
    return low, f"~{bare(low)}"


#: Bits of a word filter and places that each word sets: 2 MB however many words there are.
FILTER_BITS, FILTER_PLACES = 1 << 24, 4


def _places(word: str) -> list[int]:
    h = blake2b(word.encode(), digest_size=4 * FILTER_PLACES).digest()
    return [int.from_bytes(h[i : i + 4], "little") % FILTER_BITS for i in range(0, 4 * FILTER_PLACES, 4)]


class WordFilter:
    """Set of words as a bit map of fixed size: every word put in is found, another one by chance.

    At a million words the chance is about 1 in 500.
    """

    def __init__(self, bits: bytes) -> None:
        self.bits, self.known = bits, {}

    def __contains__(self, word: str) -> bool:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = self.known[word] = all(self.bits[p >> 3] >> (p & 7) & 1 for p in _places(word))
        return hit


def filter_bits(words: DataFrame) -> bytes:
    """Bit map of the words of a one-column table and of their forms without marks. Places reach the driver, at most ``FILTER_BITS``."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(ws: pd.Series) -> pd.Series:
        from pitchlake.llm.wordsets import _places, word_forms

        return pd.Series([[p for f in set(word_forms(w)) for p in _places(f)] for w in ws])

    found = words.select(F.explode(places(words.columns[0])).alias("p")).distinct().toArrow()["p"].to_numpy()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, found >> 3, (1 << (found & 7)).astype(np.uint8))
    return bits.tobytes()
