"""The pipeline against the stages' brute-force versions on a small table."""

import hashlib

import public_tokenizers

import corpus_pipeline
from mnemora.llm import decontaminate, pii
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_tokens import BYTE


def test_run_like_brute_force(spark, tmp_path):
    import base64

    import tiktoken

    rows = []
    for i in range(40):
        words = [f"w{(i * 7 + k * k) % 97}x{k % 13}" for k in range(60 + i)]
        if i % 5 == 1:
            words = rows[i - 1][1].split()
        if i % 7 == 2:
            words[10:10] = "test item of some ten words that nobody should learn by heart".split()
        if i % 7 == 3:
            words[5] = "ann@example.org, +1 (017) 555-7713"
        if i % 9 == 4:
            words = words[:20]
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 0))
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s, _ in rows] + [(100, None, None, None, None), (101, "", "en", "src0", 0)]
    bench = [(7, "test item of some ten words that nobody should learn by heart")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    left = {d: t for d, t, *_ in rows if brute_quality(rows)[d][-1]}
    groups = brute_groups(list(left.items()), 5, 80)
    left = {d: left[d] for d, _, c, _ in groups if d == c}
    item = decontaminate.words_of(bench[0][1])
    left = {d: t for d, t in left.items() if " ".join(item) not in " ".join(decontaminate.words_of(t))}
    want = []
    for d, t in left.items():
        at, clean = 0, ""
        for s, e, k in pii.find(t, pii.trained())[1]:
            if s >= at:
                clean += t[at:s] + f"<{k}>"
            at = max(at, e)
        clean += t[at:]
        ids = library.encode_ordinary(clean)
        want.append((d, len(clean), len(ids), hashlib.sha256(clean.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_chars", "n_tokens", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 10 < len(want) < 35
