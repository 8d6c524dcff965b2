"""Byte-level BPE by automaton: encode by table-driven transitions, decode by arc labels.

Every merge ``a b -> c`` of rank ``k`` is a gadget of the token automaton: at time ``k`` the
states whose text then ends in ``a`` lose their arcs to tokens whose text then begins with
``b`` (their text goes through ``c`` instead). After all gadgets a state, "the last token
was u", has arcs to exactly those tokens that may follow ``u``; a token sequence is the BPE
result of its text when the automaton accepts it. With tokens numbered so that the right
(left) descendants of a token at a time are an interval, one gadget removes one rectangle
of arcs, and the arcs of a state are the complement of a few intervals, instead of
thousands of millions of single arcs.

Encoding runs over bytes. The determinised automaton's state holds every open reading (the
last token, and how far into the next one the bytes are); each state knows the one token
that ends the reading of the text so far. Its transitions are a table, filled when first
met. A word is read forward through the table and its tokens are picked from the end.
"""

from __future__ import annotations

import gc
import json
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# Fixed value: how byte-level BPE splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# An open reading is one number: the last token plus one, and the place in the trie of the next one.
_PLACE = (1 << 32) - 1
_START = array("q", [0]).tobytes()

#: Entries of a worker's tables; a full table is emptied and filled anew, so results don't change.
WORD_ENTRIES = 120_000
TABLE_ENTRIES = 250_000
#: Bytes of text whose ids and decoded text a worker holds at once, if no single text has more.
PART_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Table(dict):
    """Transitions of the byte automaton: the following state by ``state | byte``, filled when first met.

    States are multiples of 256, from 0, the start. Numbers and packed bytes take a fraction of the
    memory of objects for states.
    """

    __slots__ = ("automaton", "ended", "readings", "states")

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        # By state: its open readings, packed, and the token that ends there.
        self.readings, self.ended = [_START], array("i", [-1])
        self.states = {_START: 0}

    def __missing__(self, key: int) -> int:
        return self.automaton.transition(self, key)


class Words(dict):
    """Packed ids by word. Of a full table the words met lately are kept."""

    __slots__ = ("automaton", "older")

    def __init__(self, automaton: Automaton):
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            ids = self.automaton.word(word.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= WORD_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed


class Automaton:
    """The automaton of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: str):
        content = json.loads(vocabulary)
        model, letters = content["model"], byte_letters()
        text = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        size = max([*text, *(a["id"] for a in content["added_tokens"])]) + 1
        self.labels: list[bytes] = [text.get(i, b"") for i in range(size)]
        self.special = {}
        for added in content["added_tokens"]:
            self.labels[added["id"]] = added["content"].encode()
            self.special[added["content"]] = added["id"]
        self._splits = regex.compile(PATTERN)
        self._lengths = array("i", map(len, self.labels))
        self._specials = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special else None
        )
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._gadgets(size, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._trie(text)
        self._empty_table()
        self._words = Words(self)

    def close(self) -> None:
        """Let go of the tables; the automaton can go on, with empty ones."""
        self._empty_table()
        self._words = Words(self)
        self._closed = {}

    # --- the token automaton -------------------------------------------------

    def _gadgets(self, size: int, merges: list[tuple[int, int, int]]) -> None:
        rank = [-1] * size
        self._left, self._right = [-1] * size, [-1] * size
        for k, (a, b, c) in enumerate(merges):
            rank[c], self._left[c], self._right[c] = k, a, b
        self._rank = rank
        # Children in falling order of rank come first, so "all descendants through children
        # of rank above k" is an interval that starts at the token itself.
        self._place, after = _intervals(self._left, rank, size)
        first_of: dict[int, list[int]] = {}
        lows, highs = np.zeros(len(merges), np.int64), np.zeros(len(merges), np.int64)
        for k, (a, b, _) in enumerate(merges):
            first_of.setdefault(a, []).append(k)
            # On the right side the pair itself counts too: in "aaa" the left two merge first.
            lows[k], highs[k] = self._place[b], after(b, k)
        self._first_of = {a: np.array(ks, np.int64) for a, ks in first_of.items()}
        self._lows, self._highs = lows, highs
        self._closed: dict[int, tuple[array, array]] = {}

    def _removed(self, u: int) -> tuple[array, array]:
        """Intervals of arcs that the gadgets took from state ``u``."""
        found = self._closed.get(u)
        if found is None:
            ks, a, until = [], u, len(self._lows)
            while a >= 0:
                merges = self._first_of.get(a)
                if merges is not None:
                    ks.append(merges[: np.searchsorted(merges, until)])
                until, a = self._rank[a], self._right[a]
            ks = np.concatenate(ks) if ks else np.zeros(0, np.int64)
            lows, highs = self._lows[ks], self._highs[ks]
            order = np.argsort(lows, kind="stable")
            starts: list[int] = []
            ends: list[int] = []
            for low, high in zip(lows[order].tolist(), highs[order].tolist()):
                if ends and low <= ends[-1]:
                    ends[-1] = max(ends[-1], high)
                else:
                    starts.append(low)
                    ends.append(high)
            found = self._closed[u] = (array("i", starts), array("i", ends))
            if len(self._closed) > TABLE_ENTRIES:
                self._closed = {u: found}
        return found

    def follows(self, u: int, v: int) -> bool:
        """Whether state ``u`` has an arc labelled ``v``."""
        starts, ends = self._closed.get(u) or self._removed(u)
        place = self._place[v]
        at = bisect_right(starts, place) - 1
        return at < 0 or place >= ends[at]

    # --- the byte automaton --------------------------------------------------

    def _trie(self, text: dict[int, bytes]) -> None:
        self._step: dict[int, int] = {}
        self._token, self._open = [-1], [True]
        for i, label in text.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                following = self._step.get(key)
                if following is None:
                    following = self._step[key] = len(self._token)
                    self._token.append(-1)
                    self._open.append(False)
                    self._open[node] = True
                node = following
            self._token[node] = i

    def _empty_table(self) -> None:
        self._table = Table(self)

    def transition(self, table: Table, key: int) -> int:
        """Fill one entry of the table."""
        readings, ended, byte = array("q"), -1, key & 255
        step, tokens, opened = self._step, self._token, self._open
        for reading in array("q", table.readings[key >> 8]):
            node = step.get((reading & _PLACE) << 8 | byte)
            if node is None:
                continue
            if ended < 0:
                token = tokens[node]
                if token >= 0 and (reading <= _PLACE or self.follows((reading >> 32) - 1, token)):
                    ended = token
            if opened[node]:
                readings.append(reading & ~_PLACE | node)
        if ended < 0:
            raise ValueError("the vocabulary lacks a byte")
        readings.append(ended + 1 << 32)
        packed = readings.tobytes()
        following = table.states.get(packed)
        if following is None:
            following = table.states[packed] = len(table.readings) << 8
            table.readings.append(packed)
            table.ended.append(ended)
        table[key] = following
        return following

    def word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        if len(self._table) > TABLE_ENTRIES:
            self._empty_table()
        table, lengths, state, passed = self._table, self._lengths, 0, []
        for byte in word:
            state = table[state | byte]
            passed.append(state)
        ids, at, ended = [], len(word), table.ended
        while at:
            token = ended[passed[at - 1] >> 8]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    # --- texts ---------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self._specials is not None:
            parts = self._specials.split(text)
            if len(parts) > 1:
                special = self.special
                return b"".join(
                    np.array([special[p]], "<u4").tobytes() if p in special else self._plain(p) for p in parts if p
                )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._splits.findall(text)))

    def decode(self, packed: bytes) -> str:
        """The text of token ids: their arc labels, one after the other."""
        labels = self.labels
        return b"".join(map(labels.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _intervals(parents: list[int], rank: list[int], size: int):
    """Numbers tokens so that descendants of rank above k are intervals.

    ``parents[c]`` is the part that token ``c`` extends. Returns each token's number and a
    function giving the end of the interval of ``token`` and its descendants through
    children of rank ``k`` and above.
    """
    children: list[list[int]] = [[] for _ in range(size)]
    roots = []
    for c, parent in enumerate(parents):
        (children[parent] if parent >= 0 else roots).append(c)
    place, end = [0] * size, [0] * size
    at = 0
    for root in roots:
        stack = [(root, False)]
        while stack:
            token, done = stack.pop()
            if done:
                end[token] = at
                continue
            place[token] = at
            at += 1
            stack.append((token, True))
            stack.extend((c, False) for c in sorted(children[token], key=lambda c: rank[c]))
    ordered = [sorted(cs, key=lambda c: -rank[c]) for cs in children]

    def after(token: int, k: int) -> int:
        low, high, own = 0, len(ordered[token]), ordered[token]
        while low < high:
            middle = (low + high) // 2
            if rank[own[middle]] >= k:
                low = middle + 1
            else:
                high = middle
        return end[own[low - 1]] if low else place[token] + 1

    return place, after


@contextmanager
def _automaton(vocabulary):
    """The automaton for one task. Workers live on, so its memory is given back at the end."""
    loaded = [Automaton(vocabulary.value)]
    try:
        yield loaded[0]
    finally:
        loaded[0].close()
        loaded.clear()
        gc.collect()


def _sent(spark, vocabulary_path: str):
    """The vocabulary, a file of fixed size on the driver, for all workers."""
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read()
    return spark.sparkContext.broadcast(content)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch cut into consecutive parts of about ``PART_BYTES``."""
    begin, held = 0, 0
    for end, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
        held += length or 0
        if held >= PART_BYTES or end == len(texts):
            yield texts[begin:end]
            begin, held = end, 0


def bpe_codec(spark, vocabulary_path: str):
    """A function on text columns giving ``struct<n_tokens, ids, decoded>``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers.
    """
    sent = _sent(spark, vocabulary_path)

    @F.arrow_udf("n_tokens long, ids binary, decoded string")
    def codec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _automaton(sent) as automaton:
            for texts in batches:
                for part in _parts(texts):
                    ids = [automaton.encode(t or "") for t in part.to_pylist()]
                    columns = {
                        "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary()),
                        "decoded": pa.array([automaton.decode(i) for i in ids], pa.string()),
                    }
                    yield pa.StructArray.from_arrays([*columns.values()], [*columns])

    return codec


def encode_documents(df: DataFrame, vocabulary_path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (packed) and ``decoded`` to every row.

    A null text counts as empty. Columns of ``df`` of the same names are replaced. Rows stay
    where they are: there is no shuffle, and whole texts of any length are encoded.
    """
    codec, column = bpe_codec(df.sparkSession, vocabulary_path), free_name(df, "codec")
    new = df.withColumn(column, codec(F.col(text)))
    kept = [c for c in df.columns if c.lower() not in ("n_tokens", "ids", "decoded")]
    added = ["n_tokens", "ids", *(["decoded"] if decode else [])]
    return new.select(*(F.col(f"`{c}`") for c in kept), *(F.col(column)[a].alias(a) for a in added))


def decode_documents(df: DataFrame, vocabulary_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of packed token ids; null stays null."""
    sent = _sent(df.sparkSession, vocabulary_path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with _automaton(sent) as automaton:
            for packed in batches:
                yield packed.map(lambda p: None if p is None else automaton.decode(p))

    return df.withColumn(into, decoded(F.col(ids)))


def token_ids(packed: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.pandas_udf("array<long>")
    def unpacked(values: pd.Series) -> pd.Series:
        return values.map(lambda p: None if p is None else np.frombuffer(p, "<u4").astype(np.int64))

    return unpacked(packed)
