"""Decontamination against Smith-Waterman over all pairs, planted copies and edge cases."""

import random

import numpy as np

from mnemora.llm import decontaminate as dc


def brute_score(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
            best = max(best, h[i, j])
    return best


def test_alignment_like_the_table():
    rnd = random.Random(2)
    for _ in range(60):
        a = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 15))]
        b = [rnd.randint(1, 6) for _ in range(rnd.randint(0, 25))]
        score, s, e = dc.align(np.array(a), np.array(b, dtype=int))
        assert score == brute_score(a, b)
        assert score == 0 or brute_score(a, b[s:e]) == score


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((1, 2, 3, 5))))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 40)))) for i in range(12)] + [(50, ""), (51, None), (52, "zyx wvu")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rnd.randint(0, 150))]
        if d % 3 == 0:
            c = items[rnd.randrange(12)][1].split()
            c = [x if rnd.random() > 0.15 else rnd.choice(("", word(), f"{x} {word()}")) for x in c]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + rnd.choice(("", "!!", ",")) for x in c if x]
        docs.append((d, " ".join(w)))
    return items, docs + [(100, None), (101, ""), (102, "| *** !!"), (103, "so Zyx, wvu it"), (0, docs[0][1])]


def test_copies_like_all_pairs(spark):
    items, docs = corpus(1)
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = dc.words_of(x or ""), dc.words_of(t or "")
            if a and b and brute_score(a, b) / (dc.MATCH * len(a)) >= (dc.MIN_SCORE if len(a) >= dc.SHORT_WORDS else dc.SHORT_SCORE):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, item_id long").repartition(3)
    found = dc.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 15 and (103, 52) in want
    left = dc.without_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_both_routes_find_the_same(spark, monkeypatch):
    items, docs = corpus(3)
    items += [(7, items[7][1]), (60, "solo"), (61, " ".join(x for _, x in items[:5]))]  # a repeated id, one word, a long item
    docs += [(200, "a solo walk"), (201, None), (202, items[3][1]), (203, items[3][1])]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda **k: sorted(map(tuple, dc.contaminated(df, bench, **k).collect()))
    whole = rows()
    left = sorted(map(str, dc.without_contaminated(df, bench).collect()))
    for common in (64, 1):  # with and without seeds left out
        monkeypatch.setattr(dc, "COMMON", common)
        assert rows(task_words=0) == whole and len(whole) > 15
        assert sorted(map(str, dc.without_contaminated(df, bench, task_words=0).collect())) == left
    assert dc.contaminated(df.limit(0), bench, task_words=0).count() == 0 and dc.contaminated(df, bench.limit(0), task_words=-1).count() == 0


def test_ids_of_any_type_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(3, text)], "id int, text string").selectExpr("CAST(id AS decimal(9,2)) AS item_id", "text")
    df = spark.createDataFrame([(1, text, "x", 5), (2, "else", "y", 6)], "doc_id int, text string, text_key string, item long").selectExpr("CAST(doc_id AS smallint) AS doc_id", "text", "text_key", "item")
    for words in (dc.TASK_WORDS, 0):
        out = dc.contaminated(df, bench, task_words=words)
        assert out.schema["doc_id"].dataType.simpleString() == "smallint" and [(r.doc_id, str(r.item_id)) for r in out.collect()] == [(1, "3.00")]
        assert [r.doc_id for r in dc.without_contaminated(df, bench, task_words=words).collect()] == [2]


def edited(rnd, words):
    """Two of every three words kept, so no three of them stand together."""
    return [f"new{rnd.randrange(10**9)}" if k % 3 == 2 else x for k, x in enumerate(words)]


def test_copies_in_a_third_and_in_all_rows(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    item = [word() for _ in range(15)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(word() for _ in range(15)))], "item_id long, text string")
    forms = {"exact": item, "edited": edited(rnd, item)}
    assert brute_score(item, forms["edited"]) >= dc.MIN_SCORE * dc.MATCH * len(item)
    for share in (3, 1):
        for form in forms.values():
            docs = [(d, " ".join([word() for _ in range(20)] + (form if d % share == 0 else []) + [word() for _ in range(20)])) for d in range(60)]
            df = spark.createDataFrame(docs, "doc_id long, text string")
            assert {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()} == {(d, 1) for d in range(60) if d % share == 0}
            assert dc.without_contaminated(df, bench).count() == 60 - len(range(0, 60, share))


def test_bounds_and_common_seeds_lose_no_copy(monkeypatch):
    """Items and texts of few words, so seeds are common and copies have gaps, against alignment with the whole text."""
    for common, letters in ((64, "abcdefghijkl"), (1, "abcdefghijkl"), (1, "abcd")):
        monkeypatch.setattr(dc, "COMMON", common)
        rnd, found = random.Random(common), 0
        items = [(i, " ".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24)))) for i in range(40)]
        searched = dc.Items(items)
        for _ in range(60):
            w = [rnd.choice(letters) for _ in range(rnd.randint(0, 30))]
            for x in rnd.choice(items)[1].split():
                w += [x] if rnd.random() > 0.3 else rnd.choice(([], ["zz"], [x, "zz"], ["zz", "zz", x]))
            t = " ".join(w)
            want = set()
            for k, own in enumerate(searched.words):
                score = dc.align(own, searched.read(t))[0] / (dc.MATCH * len(own))
                want |= {(searched.ids[k], score)} if score >= (dc.MIN_SCORE if len(own) >= dc.SHORT_WORDS else dc.SHORT_SCORE) else set()
            assert {(i, s) for i, s, *_ in searched.copies(t)} == want
            found += len(want)
        assert found > 60


def test_items_without_ascii_white_space_count_by_their_bytes(spark):
    item = "　".join(f"w{k}" for k in range(1000))
    items = spark.createDataFrame([(1, item), (2, "a b c"), (3, "")], "item string, text string")
    assert dc.words_in(items) >= 1003
    docs = spark.createDataFrame([(1, item, "x"), (2, "nothing here at all", "y")], "doc_id long, text string, `a.b` string")
    kept = dc.without_contaminated(docs, items.withColumnRenamed("item", "item_id"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
