"""PII: base patterns against the plain regular expressions, the field on held-out sentences, edge cases."""

import hashlib
import random
import re
import tracemalloc

import numpy as np

from mnemora.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]]))


def texts():
    rnd = random.Random(3)
    out = ["", "a@b.c@d.e", "x@y", "@@a.b@c.d-e.f.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0004", "4111 1111 1111 1111-4111111111111111", "+1 (017) 555-7713 4736962573099581", "+1 2 +34 912 345 678 9.", "٣٤ +٣ 1٣2", "9" * 3000, "1.2." * 500, "a" * 3000 + "@"]
    for _ in range(400):
        out.append("".join(rnd.choice("aB1409 .-+@()% \n") for _ in range(rnd.randint(1, 80))))
    for _ in range(60):
        out.append(pii.sentence(rnd)[0])
    return out


def test_base_spans_like_the_plain_patterns():
    for t in texts():
        assert pii.base_spans(t) == brute(t), t


def test_field_on_held_out_sentences():
    rnd, field, right, found, there = random.Random(99), pii.trained(), 0, 0, 0
    for _ in range(200):
        text, spans = pii.sentence(rnd)
        got, want = set(field.best(text)), set(spans)
        right, found, there = right + len(got & want), found + len(got), there + len(want)
    assert right / found > 0.9 and right / there > 0.85, (right, found, there)


def every_segmentation(field, text):
    """Best spans by trying all segmentations and labels of a short text."""
    atoms = list(pii.atoms_in(text))
    scores = field.scores(field.segments(text, atoms))
    best = (-np.inf, None)

    def go(i, label, total, spans):
        nonlocal best
        if i == len(atoms):
            best = max(best, (total + field.t[label, 0], spans), key=lambda x: x[0])
            return
        for j in range(i + 1, len(atoms) + 1):
            if (i, j) in scores:
                for y in range(len(pii.LABELS)):
                    if scores[i, j][y] > -np.inf:
                        go(j, y, total + field.t[label, y] + scores[i, j][y], spans + ((atoms[i][0], atoms[j - 1][1], pii.LABELS[y]),) * (y > 0))

    go(0, 0, 0.0, ())
    return list(best[1] or ())


def test_decoding_like_all_segmentations():
    field, rnd, labelled = pii.trained(), random.Random(5), 0
    few = ["token: aBcDeFgHiJk", "+1 (017) 555-7713", "ann @ x.org", "DE44 5001 0517", "", ".", "12 34-56", "ssn 123-45-6789", "password hunterABCD!"]
    for text in [*few, *(" ".join(rnd.choice(("key", "a", "12", "x@y.de", "1.2.3.4", "Ab", "-", "(5)")) for _ in range(rnd.randint(1, 4))) for _ in range(25))]:
        if len(list(pii.atoms_in(text))) > 5:
            continue
        got = list(field.best(text))
        assert got == every_segmentation(field, text), text
        labelled += len(got)
    assert labelled > 10


def test_windows_and_settled_ways_lose_nothing(monkeypatch):
    field, rnd = pii.trained(), random.Random(6)
    words = ["foo", "bar", "Xy.", "nada,", "(q)", "a-b", "JavaScript", "key", "Call", "tel:", "İstanbul", "deadbeef" * 4, "٣٤"]
    for settle in (1024, 8):
        monkeypatch.setattr(pii.Ways, "SETTLE", settle)
        for _ in range(60):
            t = rnd.choice(("\n", " ", "\u00a0")).join(pii.sentence(rnd)[0] if rnd.random() < 0.4 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 5)))
            whole = list(field.best(t))
            assert [s for a, b in pii.windows(t) for s in field.best(t, a, b)] == whole
            monkeypatch.setattr(pii.Ways, "SETTLE", 10**9)
            assert list(field.best(t)) == whole
            monkeypatch.setattr(pii.Ways, "SETTLE", settle)


def test_long_and_letter_secrets():
    field = pii.trained()
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6Ikpv" * 3 + ".SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"
    assert pii.find(f"token: {jwt}", field)[1] == [(7, 7 + len(jwt), "secret")]
    assert pii.find("password: hunterhunterABCD", field)[1] == [(10, 26, "secret")]
    assert pii.find("the key word is call and the card of my account server host", field)[1] == []


def test_long_texts_in_bounded_memory():
    field = pii.trained()
    text, word = " ".join(map(str, range(12_000))), "a1" * 100_000
    tracemalloc.start()
    pii.find(text, field)
    pii.find(word, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000, peak


def test_digest_and_edge_cases(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (-1, None), (0, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans_digest(df).collect()}
    for i, t in rows:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(pii.listed(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[2] == k for s in want) for k in pii.BASE_KINDS]
        assert set(filter(None, pii.listed(want).split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_spans == len(list(filter(None, got[i].spans.split(","))))
    assert got[-1].spans == "" and pii.spans_digest(df).count() == len(rows) + 2
    assert pii.spans_digest(df.limit(0)).count() == 0
    clean = spark.createDataFrame([("Write to ann@x.org or +1 (017) 555-7713 now.", 1, "s")], "text string, spans int, _clean string")
    assert [tuple(r) for r in pii.redact(clean).collect()] == [("Write to <email> or <phone> now.", 1, "s")]
    assert pii.find_spans(df).filter("doc_id = -1").first().spans == []


def test_account_numbers_of_the_longest_layout(spark):
    """All groups of a spaced number are one span, and no column's name is in the way of the redaction."""
    long = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    df = spark.createDataFrame([(1, f"my account {long} is known", "x", 2)], "doc_id long, text string, `a.b` string, said int")
    (row,) = pii.redact(df).collect()
    assert row.text == "my account <iban> is known" and row["a.b"] == "x" and row.said == 2
    shaped = pii.SHAPES["iban"]
    longest = "XX00 " + "AB12 " * pii.IBAN_GROUPS + "AB1"
    assert shaped.fullmatch(longest) and len(longest.split()) == pii.LONGEST and not shaped.fullmatch(longest.replace("AB1", "AB12", 1) + "2 AB1")
