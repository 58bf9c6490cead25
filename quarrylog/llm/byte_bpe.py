"""Byte-level BPE: exact merges in linear time, without merging.

A piece of text is encoded by walking it with the longest vocabulary entry at
each position, found by an Aho-Corasick automaton over the bytes written as
Latin-1 characters.  Two neighbouring tokens are accepted only if merging
would leave that very pair, which depends on the two tokens alone and is
remembered; otherwise the walk tries a shorter entry or steps back.  Each
position fails at most once, so a piece costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Pieces remembered in one worker, at most twice as many, and the longest piece worth remembering.  Spark's workers outlive their stage, so
#: what one remembers is held beside every later stage.
REMEMBERED = 1 << 17
LONGEST = 64
#: Slots for remembered neighbours, 8 bytes each; a later pair takes the slot of an earlier one.
NEIGHBOURS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder over a rank table whose ranks are the order of merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits = array("q", bytes(8 * NEIGHBOURS))
        for r in sorted(self.token):
            self._learn(r)
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.spelled = {str(r): t for t, r in ranks.items()}

    def _prefix(self, r: int) -> int:
        """The longest token that is a proper prefix of token ``r``, or -1."""
        got = self.shorter.get(r)
        if got is None:
            t = self.token[r]
            got = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
            self.shorter[r] = got
        return got

    def _learn(self, r: int) -> None:
        """The pair whose merge makes token ``r``; a token that no merge makes stands for itself."""
        t, left = self.token[r], self._prefix(r)
        while left >= 0:
            right = self.ranks.get(t[len(self.token[left]) :], -1)
            if 0 <= right < r and left < r and self._adjacent(left, right):
                self.merged[left, right] = r
                self.parts[r] = (left, right)
                return
            left = self._prefix(left)
        self.parts[r] = (r, r)

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether merging the text of tokens ``a`` and ``b`` leaves just these two.

        The merges are undone from the latest: if, at some moment, the tokens
        at the border would have merged before the one just undone, the pair
        can't stand.
        """
        limit = len(self.token) + 1
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def _fits(self, a: int, b: int) -> bool:
        pair = (a << 32 | b) + 1  # 0 is an empty slot
        at = (a * 0x9E3779B1 ^ b) % NEIGHBOURS
        got = self.fits[at]
        if got != pair and got != -pair:
            got = self.fits[at] = pair if self._adjacent(a, b) else -pair
        return got > 0

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None and self._stands(whole):
            return [whole]
        n = len(data)
        longest = [(0, -1)] * n
        for end, (size, r) in self.automaton.iter(data.decode("latin-1")):
            if size > longest[end - size + 1][0]:
                longest[end - size + 1] = (size, r)
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, r = 0, longest[0][1] if n else -1
        while at < n:
            while True:
                end = at + len(self.token[r])
                if open_at[end] and (not out or self._fits(out[-1], r)):
                    out.append(r)
                    at = end
                    r = longest[at][1] if at < n else -1
                    break
                r = self._prefix(r)
                if r < 0:  # nothing fits here: this position is no token border
                    open_at[at] = 0
                    r = out.pop()
                    at -= len(self.token[r])
                    break
        return out

    def _stands(self, r: int) -> bool:
        return len(self.token[r]) == 1 or self.parts[r] != (r, r)

    def spell(self, piece: str) -> str:
        """The ids of a piece, in decimal, joined by spaces."""
        got = self.older.get(piece) or " ".join(map(str, self.piece(piece.encode("utf-8"))))
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:  # what is still in use comes back from the older ones
                self.older = dict(self.known)
                self.known.clear()
            self.known[piece] = got
        return got

    def encode_text(self, text: str) -> str:
        """All ids of a text, in decimal, joined by spaces."""
        known, spell = self.known, self.spell
        return " ".join([known.get(p) or spell(p) for p in self.split(text)])

    def decode_text(self, ids: str) -> bytes:
        spelled = self.spelled
        return b"".join([spelled[x] for x in ids.split(" ")]) if ids else b""


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _run(path: str, pattern: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches:
            bpe = bpe or tokenizer(path, pattern)
            count, sha, back, lists = [], [], [], []
            for x in b.column(1):
                coded = bpe.encode_text(x.as_py())
                count.append(coded.count(" ") + 1 if coded else 0)
                sha.append(hashlib.sha256(coded.encode("ascii")).hexdigest())
                back.append(hashlib.sha256(bpe.decode_text(coded)).hexdigest())
                if ids:
                    lists.append(np.fromstring(coded, dtype=np.int32, sep=" ") if coded else np.zeros(0, dtype=np.int32))
            cols = [b.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:  # numbers of 4 bytes, never a list of Python's
                ends = np.cumsum([0, *count], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *lists]))))
            yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * ids)

    return run


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode every whole text of ``docs(doc_id, text)`` and decode the ids again.

    Returns for each row doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by a space), decoded_sha256 (of the decoded bytes) and with ``ids``
    the ids.  ``path`` is a rank file on every executor, ``pattern`` splits the
    text into pieces; special tokens are ordinary text.  Null and empty texts
    have no tokens.  An empty table gives an empty result; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(_run(path, pattern, ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bpe = tokenizer(path, pattern)
            texts = [None if x is None else b"".join(bpe.token[i] for i in x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of ``coded(doc_id, ids)``; null ids give a null text."""
    kind = dict(coded.dtypes)["doc_id"]
    return coded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(_decode(path, pattern), f"doc_id {kind}, text string")
