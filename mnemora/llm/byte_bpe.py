"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash resolves whole pre-tokens that the vocabulary has; the others are merged with a heap
over linked bytes, in O(n log n). The vocabulary file is a parameter; the driver builds the hash once and its
arrays, a few MB whatever the corpus, go to the tasks with the function.

Defined cases: a null or empty text has no tokens; texts are never cut, however long; repeated rows are encoded
each; an empty table gives an empty table; other columns are carried or left out, never read:
results get underscores before their names until these are free.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_text

#: Odd multipliers of the slot hash.
STEP, MIX, MASK = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xFFFFFFFFFFFFFFFF
#: Pieces whose ids a task remembers, and the characters of those that are too long to remember.
MEMO, LONG_PIECE = 300_000, 64
PACK = struct.Struct("<I").pack
#: White space but space and line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: The pattern (a fixed value) of whose matches none holds a single space or line feed together with what stands before it.
CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PerfectHash:
    """Minimal perfect hash from tokens to ranks: keys hash to buckets, each bucket has a seed that places its keys."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        place = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(self.buckets + 1))
        taken, seeds, slot_of = np.zeros(n, bool), np.zeros(self.buckets, np.int64), np.zeros(len(keys), np.int64)
        for b in np.argsort(np.diff(starts))[::-1]:
            members = order[starts[b] : starts[b + 1]]
            if not len(members):
                break
            seed = 0
            while True:  # seeds are tried in blocks
                tries = np.arange(seed, seed + 64, dtype=np.uint64)[:, None]
                slots = self._slots(hashes[members][None, :], tries, n)
                good = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    i = int(np.argmax(good))
                    seeds[b], slot_of[members] = seed + i, slots[i]
                    taken[slots[i]] = True
                    break
                seed += 64
        self.seeds = seeds.tolist()
        self.keys: list[bytes] = [b""] * n
        self.ranks = [-1] * n
        for k, s in zip(keys, slot_of.tolist()):
            self.keys[s], self.ranks[s] = k, ranks[k]

    @staticmethod
    def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
        x = hashes ^ (seeds * np.uint64(STEP))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)

    def get(self, token: bytes) -> int:
        """The rank of `token`, -1 if the vocabulary lacks it."""
        h = xxhash.xxh3_64_intdigest(token)
        x = h ^ (self.seeds[h % self.buckets] * STEP & MASK)
        x = (x ^ (x >> 33)) * MIX & MASK
        slot = (x ^ (x >> 29)) % self.n
        return self.ranks[slot] if self.keys[slot] == token else -1


class Memo:
    """Remembers about `MEMO` values in two turns: what was not asked for since the last turn is forgotten at the next."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > MEMO // 2:
            self.new, self.old = {}, self.new


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.hash = PerfectHash(ranks)
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.tokens = {r: k for k, r in ranks.items()}
        self.pattern = pattern

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(k): int(r) for k, r in (line.split() for line in f if line.strip())}, pattern)

    def start(self) -> None:
        """Make what only a task needs: by left id the merges with right ids, those of single bytes as a table, the memo."""
        self.split, self.memo = regex.compile(self.pattern).findall, Memo()
        ids, none = {k: r for r, k in self.tokens.items()}, {}
        self.merges: list[dict[int, int]] = [none] * (max(self.tokens) + 1)
        for token, rank in ids.items():
            for i in range(1, len(token)):
                left, right = ids.get(token[:i]), ids.get(token[i:])
                if left is not None and right is not None:
                    if self.merges[left] is none:
                        self.merges[left] = {}
                    self.merges[left][right] = rank
        self.pairs = [[self.merges[x].get(y, -1) for y in self.bytes] for x in self.bytes]

    def stop(self) -> None:
        for name in ("split", "memo", "merges", "pairs"):
            self.__dict__.pop(name, None)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "merges", "pairs")}

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that the vocabulary lacks: the lowest-ranked pair merges first, the leftmost of equals.

        The parts are linked by the places where they begin; the heap holds rank and place of each pair in one number.
        """
        n, merges, pairs = len(token), self.merges, self.pairs
        ids = [self.bytes[b] for b in token]
        rank = [pairs[x][y] for x, y in zip(token, token[1:])]
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return ids
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i] = r
            ids[j] = rank[j] = -1
            if k < n:
                before[k] = i
                rank[i] = r2 = merges[r].get(ids[k], -1)
                if r2 >= 0:
                    push(heap, r2 * n + i)
            else:
                rank[i] = -1
            if (p := before[i]) >= 0:
                rank[p] = r2 = merges[ids[p]].get(r, -1)
                if r2 >= 0:
                    push(heap, r2 * n + p)
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of the matches of the pattern in `piece`, as little-endian 32-bit integers."""
        out, memo = [], self.memo.new
        # a word of letters with a space before it or none is one match of the pattern that is known
        word = self.pattern == CUT_AT_SPACES and piece.removeprefix(" ").isalpha()
        found = (piece,) if word else self.split(piece)
        for pre in found:
            ids = memo.get(pre) if len(found) > 1 else None
            if ids is None:
                token = pre.encode()
                r = self.hash.get(token)
                ids = PACK(r) if r >= 0 else struct.pack(f"<{len(m := self.merge(token))}I", *m)
                if len(found) > 1 and len(pre) < LONG_PIECE:
                    memo[pre] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text.

        By the pattern `CUT_AT_SPACES` a single space or line feed between two characters that are not white space
        never lies inside a match together with what stands before it, so pieces cut there are encoded apart and
        remembered. Texts with other white space, and all texts under other patterns, are split by the pattern itself.
        """
        self.memo.turn()
        memo, old = self.memo.new, self.memo.old
        # as many words as spaces and line feeds part, if no other white space parts any: each of them stands alone
        if self.pattern != CUT_AT_SPACES or len(text.split()) != text.count(" ") + text.count("\n") + 1 or OTHER_SPACE.search(text):
            pieces = self.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = []
            for piece in (first, *(" " + x for x in rest)):
                if "\n" in piece:
                    # a line feed is a match of its own; what follows it begins a new piece
                    start, *lines = piece.split("\n")
                    pieces.append(start)
                    for line in lines:
                        pieces += ("\n", line)
                else:
                    pieces.append(piece)
        out = []
        for piece in pieces:
            if (ids := memo.get(piece)) is None:
                if (ids := old.get(piece)) is None:
                    ids = self.packed(piece)
                if len(piece) < LONG_PIECE:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row the columns `keep`, `ids` (packed little-endian 32-bit), and `decoded`, the bytes of the ids."""
    bpe = ByteBPE.from_file(vocabulary, pattern)
    return _mapped(df, bpe, text, keep, lambda bpe, ids: (ids, bpe.decode(ids)), [("ids", "binary"), ("decoded", "binary")], [pa.binary(), pa.binary()])


def encode_digest(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns `keep`, the number of tokens and the SHA-256 of the packed ids and of the decoded bytes."""
    bpe = ByteBPE.from_file(vocabulary, pattern)

    def digest(bpe: ByteBPE, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(df, bpe, text, keep, digest, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], [pa.int64(), pa.string(), pa.string()])


def _mapped(df, bpe, text, keep, result, fields, types) -> DataFrame:
    def encoded(texts: pa.Array) -> list[pa.Array]:
        if not hasattr(bpe, "memo"):
            bpe.start()
        found = [result(bpe, bpe.encode(t.as_py())) for t in texts]
        return [pa.array(x, t) for x, t in zip(zip(*found), types)]

    return map_text(df, text, keep, encoded, fields, bpe.stop)
