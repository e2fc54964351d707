"""N-gram Jaccard join against all pairs by brute force, with small blocks, and edge cases."""

import itertools
import random
import re

import numpy as np

from mnemora.llm import ngram_join as nj


def brute(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)), links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups=6, size=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeÉ") for _ in range(rnd.randint(1, 3)))
    passage = [word() for _ in range(50)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice((3, 20, 90, 200)))]
        for _ in range(rnd.randint(1, size)):
            w = base[:]
            for _ in range(rnd.choice((0, 0, 1, 2, 5))):
                w[rnd.randrange(len(w))] = word()
            if g % 2:
                w += passage
            rows.append(rnd.choice((" ", "  ", "\n")).join(w) if rnd.random() < 0.9 else " ".join(w).upper())
    rows += ["", None, "  \n", "one", "ONE", "one two", "one two three", "É é", "é é"]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return list(zip(ids, rows))


def test_components_like_brute_force(spark):
    for seed, block in ((1, 1024), (2, 3), (3, 8)):
        rows = corpus(seed)
        rows += [(None, rows[0][1]), (None, "alone and without an id, far from others"), rows[1], (rows[2][0], "same id, another text, of some words")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = nj.jaccard_components(df, block=block).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert nj.jaccard_components(df.limit(0)).count() == 0
    got = nj.jaccard_components(df, n=5, percent=80, block=4, block_grams=300).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 80)


def chain(n, length=40):
    """Texts of which each shares half its n-grams with the next: one group by n-grams, no link."""
    return [(i, " ".join(f"w{k}" for k in range(i * length // 2, i * length // 2 + length))) for i in range(n)]


def test_a_long_chain_makes_few_tiles(spark, monkeypatch):
    seen = []
    whole = nj.placements
    monkeypatch.setattr(nj, "placements", lambda *a: seen.append(whole(*a)) or seen[-1])
    near = [(10_000 + i, " ".join(f"n{k}" if k != i else f"edit{i}" for k in range(120))) for i in range(90)]
    made = {}
    for n in (150, 600):
        rows = chain(n) + near
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        # room for many n-grams that others lack, so that the chain's classes stay and are one group
        got = nj.jaccard_components(df, percent=30, block=16).select("doc_id", "component_id", "n_links").collect()
        assert {(r.component_id, r.n_links) for r in got if r.doc_id >= 10_000} == {(10_000, 89)}
        assert all(r.component_id == r.doc_id and r.n_links == 0 for r in got if r.doc_id < 10_000)
        made[n] = seen[-1].select("tile").distinct().count()
    assert made[600] < 6 * made[150] and made[600] < 8 * 600, made


def test_a_dense_group_fills_its_blocks(spark, monkeypatch):
    seen = []
    whole = nj.placements
    monkeypatch.setattr(nj, "placements", lambda *a: seen.append(whole(*a)) or seen[-1])
    rnd, base = random.Random(6), [f"b{k}" for k in range(150)]
    rows = []
    for i in range(400):
        w = base[:]
        for _ in range(rnd.randint(1, 2)):
            w[rnd.randrange(150)] = f"e{i}x{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = nj.jaccard_components(df, block=40).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    copies = seen[-1].count() / len(rows)
    assert copies < 2 * 400 / 40, copies  # each class meets all others in whole blocks


def test_hubs_and_components(spark):
    from mnemora.llm import common, graphs

    ids = list(range(1000, 1400))
    random.Random(3).shuffle(ids)  # a chain in no order, and one in order
    links = [(0, i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900)] + list(zip(ids, ids[1:]))
    df = spark.createDataFrame(links, "a long, b long")
    want = {**{i: 0 for i in range(300)}, **{500 + i: 500 for i in range(41)}, 900: 900, **dict.fromkeys(ids, 1000)}
    assert {r.node: r.root for r in graphs.components(df).collect()} == want
    usual, graphs.join_hot = graphs.join_hot, lambda *a: common.join_hot(*a, hot=20, most=30)
    try:
        assert {r.node: r.root for r in graphs.components(df).collect()} == want
    finally:
        graphs.join_hot = usual


def test_text_keys_like_the_built_in_function(spark):
    texts = ["", "a", "é漢字 text", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.selectExpr("xxhash64(t)").collect()] == [nj.text_key(t) for t in texts]


def test_overlaps_like_sets():
    rnd = random.Random(5)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 50))], np.uint64)) for _ in range(40)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    assert (nj.overlaps(sets, None) == np.triu(want, 1)).all()
    assert (nj.overlaps(sets[:15], sets[15:]) == want[:15, 15:]).all()


def test_one_of_each_stays(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows] + [(rows[0][0], rows[0][1], "x", -1), (None, "q", "x", -2)], "doc_id long, text string, gone string, key long")
    got = nj.one_of_each(df)
    assert got.columns == df.columns
    assert nj.one_of_each(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v"), (4, ""), (4, None)], "doc_id int, text string")
    assert sorted(map(tuple, nj.one_of_each(two).collect()), key=str) == [(1, "a b c d e f"), (2, "q r s t u v"), (4, ""), (4, None)]
    want = {d for d, _, c, _ in brute(rows) if d == c}
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(want) and got.filter("doc_id is null").count() == 1


def test_held_like_sets(spark, monkeypatch):
    monkeypatch.setattr(nj, "DEAL_ROWS", 30)  # lists of several parts of a batch meet in a bin
    rows = corpus(9, groups=8)
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("coalesce(text, '') AS text")
    sets = {nj._class(s): set(s[s % np.uint64(4) == 1].tolist()) for _, t in rows if len(s := nj.gram_set(t or "", nj.WordHashes(), 4))}
    want = {c: sum(any(g in o for d, o in sets.items() if d != c) for g in s) for c, s in sets.items()}
    for split, bins in ((1, 1), (3, 7)):
        dealt = nj._dealt(texts.repartition(split), 4, 1, bins)
        got = dict(dealt.groupBy("bin").applyInArrow(nj._held, "cls long, held long").groupBy("cls").sum("held").collect())
        # never fewer; more only where a class is in several lists
        assert all(got.get(c, 0) >= n for c, n in want.items()) and set(got) == {c for c, n in want.items() if n}
    one = {nj._class(nj.gram_set(t, nj.WordHashes(), 4)): t for _, t in rows if t and t.strip()}
    alone = spark.createDataFrame([(t,) for t in one.values()], "text string").repartition(3)
    got = dict(nj._dealt(alone, 4, 1, 5).groupBy("bin").applyInArrow(nj._held, "cls long, held long").groupBy("cls").sum("held").collect())
    assert got == {c: n for c, n in want.items() if n}


def test_texts_without_partners_leave_no_ngrams(spark, monkeypatch, tmp_path):
    seen = []
    whole = nj.materialise
    monkeypatch.setattr(nj, "materialise", lambda d: seen.append(whole(d)) or seen[-1])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(200)]
    assert nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 200
    assert not [d for d in seen if any(t.startswith("array") for _, t in d.dtypes) and d.count()]


def test_classes_without_the_common_ngram_make_blocks_together(spark):
    for g in (200, 800):
        # most have n-gram 0; each of the others has one of its own, which three of these have too
        held = {i: {0, 1000 + i % (g // 4)} if i < g * 3 // 4 else {1000 + i - g * 3 // 4} for i in range(g)}
        m = {x: sum(x in h for h in held.values()) for x in set().union(*held.values())}
        groups = spark.createDataFrame([(i, 0) for i in held], "node long, root long")
        chosen = spark.createDataFrame([(i, 100 + i % 3, 1) for i in held], "cls long, n long, copies long")
        prefix = spark.createDataFrame([(i, x, m[x]) for i, h in held.items() for x in h], "cls long, gram long, m long")
        rows = nj.placements(groups, chosen, prefix, 85, g - 1).collect()
        assert len(rows) < 8 * g, len(rows) / g  # before, the block of those that have it went to each of the others
        tiles, met = {}, {}
        for r in rows:
            tiles.setdefault(r.tile, ([], []))[r.side].append(r.cls)
        for left, right in tiles.values():
            for pair in itertools.product(left, right) if right else itertools.combinations(left, 2):
                met[frozenset(pair)] = met.get(frozenset(pair), 0) + 1
        assert set(met.values()) == {1}
        assert all(frozenset(p) in met for p in itertools.combinations(held, 2) if held[p[0]] & held[p[1]])


def test_counts_of_bins_come_back_as_lists(spark):
    rows = corpus(9, groups=8)
    for times in (1, 4):
        texts = spark.createDataFrame([(f"{t or ''} tail{k}",) for _, t in rows for k in range(times)], "text string").repartition(3)
        old = nj._dealt(texts, 4, 1, 9).groupBy("bin").applyInArrow(nj._held, "cls long, held long")
        lists = nj._dealt(texts, 4, 1, 9).groupBy("bin").applyInArrow(lambda t: nj._held_lists(t, 2), "share long, cls array<long>, held array<int>")
        assert lists.count() <= 9 * 2 < old.count()
        got = nj._held_by_class(texts, 4, 1, 9, 2).collect()
        assert len({r.cls for r in got}) == len(got)
        assert sorted(map(tuple, got)) == sorted(map(tuple, old.groupBy("cls").sum("held").collect()))
    assert nj._held_by_class(texts.limit(0), 4, 1, 1, 1).count() == 0
