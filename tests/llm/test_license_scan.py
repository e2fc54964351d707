"""Licence scan: held-out accuracy, and the DataFrame form against the plain one."""

import random

from mnemora.llm import license_scan as ls


def plain(text):
    out = []
    for k, line in enumerate((text or "").split("\n")):
        words = ls.words_of(line)
        if not set(words) & set(ls.ANCHORS):  # no feature of the model
            assert not ls.grams_of(words)
            continue
        p = ls.trained().probabilities(line)
        best = ls.FAMILIES[int(p.argmax())]
        share = ls.template_share(words, best)
        out.append((k, best if p.max() >= ls.MIN_PROBABILITY and share >= ls.MIN_TEMPLATE else ls.UNKNOWN, round(float(p.max()), 3)))
    return out


def test_held_out_families():
    rnd, right, n = random.Random(77), 0, 0
    for f in ls.FAMILIES:
        for _ in range(30):
            line = ls.example(rnd, f)
            got = plain(line)
            right += (got[0][1] if got else ls.UNKNOWN) == f
            n += 1
    assert right / n > 0.9, right / n


def test_scan_like_the_plain_form(spark):
    rnd = random.Random(5)
    texts = ["", None, "no notice here", "Licensed under CC BY-NC 4.0.", "a\nb\nReleased under the MIT License.\n" + "word " * 30_000, "license " * 5_000, "LICENSE", "Licensed under"]
    texts += ["\n".join(ls.example(rnd, rnd.choice(ls.FAMILIES)) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, words string")
    got = sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 3)) for r in ls.scan(df).collect())
    want = sorted((i, *x) for i, t in [*enumerate(texts), (3, texts[3])] for x in plain(t))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-3 for g, w in zip(got, want))
    assert ls.scan(df.limit(0)).count() == 0
    by = {r.doc_id: r.family for r in ls.scan(df).filter("doc_id in (3, 4)").collect()}
    assert by == {3: "cc-by-nc", 4: "mit"}


def test_no_line_with_a_feature_is_left_out(spark):
    rnd = random.Random(6)
    lines = ["Released under CC BY-SA 4.0.", "CC BY 4.0", "Affero", "MPL 2.0", "under MIT", "all his rights", "Creative", "a by-nc b", "GPL-3.0", "of permitted use", "no word of it", *ls.ANCHORS, "éMIT x", "(mit)", "x.mit cc-by", "success of an admittance", *(a.upper() for a in ls.ANCHORS)]
    lines += [" ".join(x for x in ls.example(rnd, rnd.choice(ls.FAMILIES)).split() if rnd.random() > 0.4) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(df).collect()}
    assert set(got) == {i for i, t in enumerate(lines) if ls.grams_of(ls.words_of(t))}  # brute force, no search before it
    for i, r in got.items():
        assert abs(r.probability - ls.trained().probabilities(lines[i]).max()) < 2e-3
    assert got[0].family == "cc-by-sa" and set(range(9)) - {8} <= set(got) and not {9, 10} & set(got)
