"""Byte-level BPE and token counts against the libraries, with edge cases."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from mnemora.llm.byte_bpe import ByteBPE, encode, encode_digest
from mnemora.llm.token_counts import Counter, count_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "\n", "Hello world", "  two  spaces \n\n and lines\r\n\tend ", "it's we'll I'M 'sdx'dd", "naïve Éàç ñ ß 漢字 emoji 😀😀  x",
    "a" * 5000, "ab" * 3000 + " " + "!?" * 900, "x1234567890 12 3", "line one.\nLine two, here.\nthree", "\x1c a\x1fb \x85 q", "tok<|endoftext|>en <|startoftext|>",
    "é ́x ﬁ İI ΑΣ Σ", "zzqxj kkwv " * 40, "\x00\x01 a", "end ",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice("aehtion  .,'s\n\t12É漢_-") for _ in range(n))


def test_byte_bpe_like_the_library(spark, library):
    texts = TEXTS + [noise(i, 200) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(encode_digest(df, BYTE, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want)
    assert encode(df, BYTE, public_tokenizers.PATTERN).filter("length(ids) = 0").count() == 2
    assert encode_digest(df.limit(0), BYTE, public_tokenizers.PATTERN).count() == 0


def test_other_white_space_beside_runs_like_the_library(library):
    bpe = ByteBPE.from_file(BYTE, public_tokenizers.PATTERN)
    bpe.start()
    others = "\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u3000"
    texts = [f"a{x}b{x}c{run}d" for x in others for run in ("\n\n\n", "   ", " \n ", "\n \n")] + [f" a{x}b c" for x in others] + [f"a{x}b\n" for x in others]
    rnd = random.Random(9)
    texts += ["".join(rnd.choice(f"ab \n{rnd.choice(others)}") for _ in range(30)) for _ in range(500)]
    taken = [t for t in texts if len(t.split()) == t.count(" ") + t.count("\n") + 1]
    assert len(taken) > 50  # where the count of words alone says nothing
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == library.encode_ordinary(t), t


def test_perfect_hash_is_minimal():
    bpe = ByteBPE.from_file(BYTE, public_tokenizers.PATTERN)
    assert sorted(bpe.hash.ranks) == list(range(len(bpe.tokens))) and bpe.hash.get(b"\xff\xfe\xfd") == -1
    assert all(bpe.hash.get(k) == r for r, k in bpe.tokens.items())


def test_counts_like_the_library(spark):
    lib = Tokenizer.from_file(WORD)
    texts = TEXTS + [noise(i, 300) for i in range(40)] + [noise(i, 4000) for i in range(8)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 2)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_bytes_", T.IntegerType())]))
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False)), len(lib.encode(t, add_special_tokens=False)) > 2048) for i, t in enumerate(texts)} | {-1: (0, 0, False)}
    for sizes in ({}, {"huge": 0, "chunk": 64, "overlap": 4}, {"huge": 10, "chunk": 500, "overlap": 16}):
        assert {r[0]: tuple(r[1:]) for r in count_tokens(df, WORD, **sizes).collect()} == want
    assert count_tokens(df.limit(0), WORD).count() == 0


def test_splice_widens_where_no_boundary_is_near():
    counter = Counter(WORD, chunk=40, overlap=2, huge=0)
    counter.start()
    lib = Tokenizer.from_file(WORD)
    for text in ("q" * 300 + " tail of text " + "w" * 500 + " x", "no white space at all".replace(" ", "-") * 30, " " * 400 + "a " * 200):
        assert counter.count(text) == len(lib.encode(text, add_special_tokens=False))


def test_other_vocabularies_like_the_library():
    """Where words do not stand for themselves the library gets whole texts or chunks."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(other)
    for sizes in ({}, {"chunk": 64, "overlap": 4}):
        counter = Counter(other, **sizes)
        counter.start()
        assert not counter.by_word
        for text in [*TEXTS, noise(3, 3000)]:
            assert counter.count(text) == len(lib.encode(text, add_special_tokens=False)), text
    counter = Counter(WORD)
    counter.start()
    assert counter.by_word


def test_kept_columns_with_any_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, None)], "doc_id long, text string, n_tokens int, `a.b` string")
    keep = ("doc_id", "n_tokens", "a.b")
    out = encode_digest(df, BYTE, public_tokenizers.PATTERN, keep=keep)
    assert out.columns == [*keep, "_n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id, r.n_tokens, r["a.b"], r._n_tokens) for r in out.collect()) == [(1, 7, "x", 2), (2, 8, None, 0)]
    counts = count_tokens(df, WORD, keep=keep)
    assert sorted((r.doc_id, r.n_tokens, r._n_tokens) for r in counts.collect()) == [(1, 7, 2), (2, 8, 0)]
