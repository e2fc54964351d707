"""Exact token counts of texts of any length.

Huge texts are encoded in overlapping chunks with offsets; two chunks are spliced at a common boundary that is
proven stable: both end a token before, and begin one after, the same white space, across which neither the
normaliser nor the pre-tokenizer of the vocabulary joins anything. Where the overlap has no such boundary it is
widened until it has one or the chunk reaches the end of the text. Texts of up to one chunk are summed from the
counts of their words, parted by the same stable boundaries, which the library has encoded once; this way is taken only
if the vocabulary's file names a normaliser and a pre-tokenizer that allow it (`counts_by_word`), else such texts, too,
go to the library whole.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts are never cut; repeated rows are counted
each; an empty table gives an empty table; columns other than the text are carried or left out, whatever their names:
results get underscores before theirs until these are free.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import WHITE, map_text

#: Texts of more than a chunk are encoded in chunks.
CHUNK, OVERLAP = 16_384, 256
#: Normalisers and pre-tokenizers of the library that work on each stretch between white space by itself, and those
#: that part the text there (fixed values).
PLAIN = frozenset(("Lowercase", "NFC", "NFD", "StripAccents", "Punctuation", "Digits"))
PARTS = frozenset(("BertPreTokenizer", "Whitespace", "WhitespaceSplit"))
#: Words whose counts a task remembers before it starts afresh, and the most characters of such a word.
MEMO, LONG_WORD = 500_000, 64


def counts_by_word(vocabulary: dict) -> bool:
    """Whether a text's tokens are those of its words, one after the other, by what the vocabulary's file says."""

    def steps(part: dict | None) -> list[dict]:
        if part is None:
            return []
        return [s for p in part.get("normalizers", part.get("pretokenizers", ())) for s in steps(p)] if part["type"] == "Sequence" else [part]

    def parts(step: dict) -> bool:
        """Whether a step leaves no piece with white space: it keeps only the matches of a pattern that matches none."""
        if step["type"] != "Split":
            return step["type"] in PARTS
        pattern = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", step["pattern"].get("Regex", " "))
        return step["behavior"] == "Removed" and step["invert"] and re.fullmatch(r"(?:[\w'|+?\[\]]|\\p\{[LN]\})*", pattern) is not None

    def plain(step: dict) -> bool:
        if step["type"] == "Replace":
            return step["pattern"].get("Regex") == r"\s+" and step["content"] == " "
        return step["type"] in PLAIN or step["type"] == "ByteLevel" and not step["use_regex"] and not step["add_prefix_space"]

    spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in vocabulary.get("added_tokens", ()))
    split = steps(vocabulary.get("pre_tokenizer"))
    return not spaced and all(map(plain, steps(vocabulary.get("normalizer")))) and any(map(parts, split)) and all(parts(s) or plain(s) for s in split)


class Counter:
    """Counts tokens with one vocabulary of the tokenizers library."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int | None = None):
        self.path, self.chunk, self.overlap, self.huge = path, chunk, overlap, chunk if huge is None else huge

    def start(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(self.path), {}
        self.by_word = counts_by_word(json.loads(self.tokenizer.to_str()))

    def stop(self) -> None:
        for k in ("tokenizer", "memo", "by_word"):
            self.__dict__.pop(k, None)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tokenizer", "memo", "by_word")}

    def _encode(self, text: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the tokens of `text`."""
        offsets = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return [a for a, _ in offsets], [b for _, b in offsets]

    def spliced(self, text: str) -> int:
        """Tokens of `text`, from overlapping chunks."""
        n, total, at = len(text), 0, 0  # what lies before `at`, a stable boundary, is counted
        size, overlap = self.chunk, self.overlap
        left = self._encode(text[at : at + size])
        while at + size < n:
            end = at + size
            start = max(at, end - overlap)
            right = self._encode(text[start : start + self.chunk])
            found = self._boundary(text, left, at, right, start, end)
            if found is None:
                if start > at:
                    overlap *= 2  # widen the overlap to the left
                else:
                    size *= 2  # the chunk itself has no boundary: let it grow
                    left = self._encode(text[at : at + size])
                continue
            before, after, cut = found
            total += before
            at, size, overlap = cut, start + self.chunk - cut, self.overlap
            left = [x - (cut - start) for x in right[0][after:]], [x - (cut - start) for x in right[1][after:]]
        return total + len(left[0])

    @staticmethod
    def _boundary(text, left, at, right, start, end) -> tuple[int, int, int] | None:
        """The last stable boundary of both: tokens of `left` before it, tokens of `right` before it, its place.

        A boundary is a place of white space where no token of either chunk lies; chunk ends do not count.
        """
        ends = {at + e: i + 1 for i, e in enumerate(left[1])}
        starts = {}
        for i, s in enumerate(right[0]):
            starts.setdefault(start + s, i)
        best = None
        for s, i in starts.items():
            if s - 1 <= start or s >= end or text[s - 1] not in WHITE:
                continue
            p = s - 1
            while p > start and text[p - 1] in WHITE:
                p -= 1
            if p in ends and p > start and (best is None or s > best[2]):
                before = ends[p]
                if before == len(left[0]) or at + left[0][before] == s:
                    best = before, i, s
        return best

    def count(self, text: str) -> int:
        if len(text) > self.huge or not self.by_word:
            return self.spliced(text)
        memo, total, new = self.memo, 0, {}
        for word in text.replace("\n", " ").split(" "):
            got = memo.get(word)
            if got is None:
                new[word] = new.get(word, 0) + 1
            else:
                total += got
        if new:
            words = list(new)
            if len(memo) > MEMO:
                memo.clear()
            for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
                got = len(e)
                total += got * new[word]
                if len(word) <= LONG_WORD:
                    memo[word] = got
        return total


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, **sizes: int) -> DataFrame:
    """Per row the columns `keep`, the bytes and tokens of its text, and whether they are over `limit` tokens."""
    counter = Counter(vocabulary, **sizes)

    def counted(texts: pa.Array) -> list[pa.Array]:
        if not hasattr(counter, "memo"):
            counter.start()
        tokens = [counter.count(t.as_py()) for t in texts]
        return [pa.compute.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())]

    return map_text(df, text, keep, counted, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], counter.stop)
