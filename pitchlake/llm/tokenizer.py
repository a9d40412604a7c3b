"""Byte-level BPE encoding of a corpus with a public vocabulary, in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every adjacent pair by binary search over the sorted
pair keys, takes each word's lowest rank, merges that pair wherever it stands in the word, and drops the words that
are done. A merge never makes a pair of a lower rank than its own, so a round per rank equals merging one pair at a
time. A text is cut at its white space; equal pieces are encoded once per worker, and a batch's ids are gathered from
the pieces' ids without a loop over tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Default place of the vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: White space of Unicode, which the pattern's ``\s`` means.
_WS = "\t-\r \x85\xa0  -     　"
#: Fixed value: the published pattern that splits text before merging.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: A piece is white space with the run that follows it: a token never spans two pieces.
_PIECE = rf"[{_WS}]*[^{_WS}]+|[{_WS}]+"
#: Rounds over words of more symbols look again only around merges; over the whole array they would cost the length squared.
LONG_WORD = 2048
#: Pieces a worker remembers before it starts again; a bound on memory, not on what is encoded.
REMEMBERED = 300_000
_NONE = np.iinfo(np.int32).max


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tables(path: str = VOCABULARY) -> dict[str, np.ndarray]:
    """Tables of a byte-level BPE file: id of each byte; sorted pair keys with rank and merged id. About 1 MB for 50,000 merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, chars = model["vocab"], byte_characters()
    size = max(vocab.values()) + 1
    byte_ids = np.zeros(256, np.int64)
    for ch, b in chars.items():
        byte_ids[b] = vocab[ch]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    new = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return {"byte_ids": byte_ids, "keys": keys[order], "ranks": order.astype(np.int32), "new": new[order], "size": np.array([size], np.int64)}


class Encoder:
    """Encodes texts; remembers the ids of pieces it has seen."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.byte_ids, self.keys, self.ranks, self.new = (tables[k] for k in ("byte_ids", "keys", "ranks", "new"))
        self.size = int(tables["size"][0])
        self.at_rank = np.argsort(self.ranks)
        self.split = regex.compile(PATTERN).findall
        self.pieces = regex.compile(_PIECE).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.values = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the tables of each pair; rank ``_NONE`` where it isn't one."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        for i, ids in zip(long, self._merge_around([words[i] for i in long]) if long else ()):
            out[i] = ids
        if not short:
            return out
        symbols = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        names = np.array(short)
        lengths = np.array([len(words[i]) for i in short])
        while len(names):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            last = starts + lengths - 1
            rank, at = self._lookup(symbols[:-1], symbols[1:]) if len(symbols) > 1 else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            rank = np.append(rank, _NONE)
            rank[last] = _NONE
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            if done.any():
                for n, s, e in zip(names[done], starts[done], last[done]):
                    out[n] = symbols[s : e + 1].astype(np.int32)
                stay = np.repeat(~done, lengths)
                symbols, rank, at = symbols[stay], rank[stay], np.append(at, 0)[stay]
                names, lengths, lowest = names[~done], lengths[~done], lowest[~done]
                if not len(names):
                    break
            place = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # of pairs that overlap (a a a) every second one is merged, from the left
            first = np.concatenate(([True], np.diff(place) != 1))
            run_start = place[np.flatnonzero(first)][np.cumsum(first) - 1]
            place = place[(place - run_start) % 2 == 0]
            symbols[place] = self.new[at[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            lengths = np.add.reduceat(keep.astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
            symbols = symbols[keep]
        return out

    def _merge_around(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of long words: one round per rank over the flat array of all of them, looking again only around merges.

        A round takes the places where a pair of its rank was last seen, merges those that still hold it and looks up the
        pairs at both sides of each merge, which have higher ranks; so all rounds together look at each merge once.
        """
        lengths = np.array([len(w) for w in words])
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        there = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Note the pairs that begin at these places under their ranks."""
            rank, _ = self._lookup(symbols[at], symbols[after[at]])
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist() if len(rank) else ()):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            seen = waiting.pop(r)
            at = seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))
            key, new = int(self.keys[self.at_rank[r]]), int(self.new[self.at_rank[r]])
            left, right = divmod(key, self.size)
            at = at[there[at] & (after[at] >= 0)]
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if not len(at):
                continue
            if left == right:  # of pairs that overlap (a a a) every second one is merged, from the left
                first = np.concatenate(([True], after[at[:-1]] != at[1:]))
                run = np.flatnonzero(first)[np.cumsum(first) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            symbols[at], there[gone] = new, False
            after[at] = after[gone]
            follows = after[at] >= 0
            before[after[at][follows]] = at[follows]
            ahead = before[at]
            wait(np.unique(np.concatenate((ahead[ahead >= 0], at[follows]))))
        kept = np.split(symbols.astype(np.int32), ends[:-1])
        return [k[t] for k, t in zip(kept, np.split(there, ends[:-1]))]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't known and append their ids."""
        cut = [self.split(p) for p in pieces]
        fresh = list({w for words in cut for w in words if w not in self.words})
        self.words.update(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        ids = [np.concatenate([self.words[w] for w in words]) for words in cut]
        self.values = np.concatenate([self.values, *ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, offsets of the texts in it). Null and empty texts have no ids."""
        if len(self.known) > REMEMBERED or len(self.words) > REMEMBERED:
            self._forget()
        known, codes, counts, fresh = self.known, [], [], []
        for t in texts:
            pieces = self.pieces(t) if t else ()
            counts.append(len(pieces))
            for p in pieces:
                c = known.get(p)
                if c is None:
                    c = known[p] = len(known)
                    fresh.append(p)
                codes.append(c)
        if fresh:
            self._learn(fresh)
        code = np.array(codes, np.int64)
        sizes = np.diff(self.offsets)[code]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.offsets[code] - (ends - sizes), sizes)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))] if len(texts) else np.zeros(1, np.int64)
        return self.values[index], bounds.astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, tables) -> Encoder:
    """This worker's encoder of a vocabulary; ``tables`` is a broadcast variable."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(tables.value)
    return _ENCODERS[name]


#: Characters of text that are encoded at once within an Arrow batch.
AT_ONCE = 4_000_000


def _slices(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Parts of a batch of texts of about ``AT_ONCE`` characters."""
    held, size, start = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        held.append(t)
        size += len(t or "")
        if size >= AT_ONCE:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def encode_corpus(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): the ids of each row's text, without special tokens; a row for every row of ``df``.

    Null and empty texts have an empty array. Strings of special tokens in a text are ordinary text. Texts of any length
    are encoded whole. No shuffle; the broadcast is the vocabulary's tables, about 1 MB.
    """
    tables = df.sparkSession.sparkContext.broadcast(read_tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pitchlake.llm.tokenizer import _slices, encoder

        enc = encoder(path, tables)
        for b in batches:
            for start, texts in _slices(b.column(1)):
                values, bounds = enc.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns of ``df`` but the text, and ``n_tokens`` bigint: the number of its ids, 0 for null and empty texts."""
    tables = df.sparkSession.sparkContext.broadcast(read_tables(path))
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pitchlake.llm.tokenizer import _slices, encoder

        enc = encoder(path, tables)
        for b in batches:
            for start, texts in _slices(b.column(len(others))):
                bounds = enc.encode(texts)[1]
                kept = [b.column(i).slice(start, len(texts)) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds), pa.int64())], names=[*others, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*others, text).mapInArrow(run, f"{schema}, n_tokens bigint")
