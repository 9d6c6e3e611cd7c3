"""Byte-level BPE as a monoid: encodings of neighbours join by re-encoding their boundary.

The encoding of a byte string is the reduction of its single bytes under an
associative join. join(L, R) re-encodes a window of tokens around the boundary
and widens it until the tokens outside provably stay: a token sequence is the
encoding of its bytes exactly if every adjacent pair of tokens is, on its own,
the encoding of the two tokens' bytes. Halves are encoded recursively, so a
long stretch without a break costs about n log n instead of n squared.

Texts are first cut by the pattern of the vocabulary; each match is encoded
separately. Decoding concatenates token bytes up the same tree.

Nulls count as empty texts and give no ids. Repeated rows encode alike, empty
tables give none, extra columns are ignored. Lone surrogates, which Parquet
strings cannot hold, do not occur.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import map_columns

#: Remembered encodings a Python worker keeps of each kind; past it, new ones are computed each time.
REMEMBERED = 100_000
#: Byte strings up to this length are merged directly.
LEAF = 6


#: White space by Unicode's property, which the pattern's engine means by its class; this one's differs for \x1c to \x1f.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOUCHING = re.compile(f"[{_WHITE}\x1c-\x1f] | [{_WHITE}\x1c-\x1f]|\\A | \\Z").search


def own_white_space(pattern: str) -> str:
    """The pattern with white space spelled out."""
    return pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")


class Encoder:
    """A vocabulary of ranks and the pattern that cuts texts before merging."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cut = regex.compile(own_white_space(pattern)).findall
        self.merged: dict[bytes, list[int]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none is in the vocabulary."""
        found = self.merged.get(data)
        if found is None:
            found = self._merge(data)
            if len(self.merged) < REMEMBERED and len(data) <= 4 * LEAF:
                self.merged[data] = found
        return found

    def _merge(self, data: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        around = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while around:
            low = min(around)
            if low == 1 << 60:
                break
            i = around.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del around[i]
            if i < len(around):
                around[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                around[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def holds(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their own bytes."""
        found = self.stable.get((a, b))
        if found is None:
            found = self._merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self.stable) < REMEMBERED:
                self.stable[a, b] = found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left and right, both of which are encodings."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of either side inside the window
        while True:
            inside = left[len(left) - i :] + right[:j]
            window = self.window(inside)
            grown = False
            if i < len(left) and not self.holds(left[-i - 1], window[0]):
                i, grown = min(len(left), 2 * i), True
            if j < len(right) and not self.holds(window[-1], right[j]):
                j, grown = min(len(right), 2 * j), True
            if not grown:
                return left[: len(left) - i] + window + right[j:]

    def window(self, ids: list[int]) -> list[int]:
        return self.merge(b"".join(map(self.tokens.__getitem__, ids)))

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tree reduction; levels are kept in lists, so depth is no limit."""
        if data in self.ranks:
            return [self.ranks[data]]
        level = [self.merge(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def packed(self, match: str) -> bytes:
        """The ids of one match of the pattern as little-endian 32-bit integers."""
        found = self.known.get(match)
        if found is None:
            found = np.array(self.encode_bytes(match.encode()), "<u4").tobytes()
            if len(self.known) < REMEMBERED and len(match) < 64:
                self.known[match] = found
        return found

    def _stretch(self, text: str) -> bytes:
        return b"".join(map(self.packed, self.cut(text)))

    def encode(self, text: str) -> bytes:
        """The packed ids of a text.

        No match of the pattern runs past a single space between two characters
        that aren't white space, so such a space may start a stretch of its own.
        """
        if not text:
            return b""
        if _TOUCHING(text):  # white space beside such a space: cut the text as a whole
            return self._stretch(text)
        first, *rest = text.split(" ")
        found = list(map(self.pieces.get, rest))
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    piece = rest[i]
                    found[i] = got = self._stretch(" " + piece)
                    if len(self.pieces) < REMEMBERED and len(piece) < 64:
                        self.pieces[piece] = got
        return self._stretch(first) + b"".join(found)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, pattern)


def encode_column(docs: DataFrame, vocabulary: str, pattern: str, keep: bool = True) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, digests of ids and decoded bytes, and, if keep, the ids themselves.

    vocabulary is a path that every machine has, or the name of a file given to SparkContext.addFile.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(rows: dict) -> dict:
        import os

        e = encoder(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)), pattern)
        packed = [e.encode(t or "") for t in rows["text"]]
        out = {"doc_id": rows["doc_id"], "n_tokens": [len(p) // 4 for p in packed]}
        out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
        out["decoded_sha256"] = [hashlib.sha256(e.decode(p)).hexdigest() for p in packed]
        if keep:
            out["ids"] = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
        return out

    ids = ", ids array<int>" if keep else ""
    return map_columns(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
