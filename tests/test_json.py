"""Canonical JSON and containment against a plain version on random documents."""

import json
import random

from mnemora.functions import json as js
from mnemora.operators import graph


def holds(value, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], v, False) for k, v in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and all(any(holds(e, p, False) for e in value) for p in pattern)
    same = lambda v: not isinstance(v, (dict, list)) and type(v) is type(pattern) and v == pattern
    return same(value) or (top and isinstance(value, list) and any(map(same, value)))


def anything(rnd, depth=3):
    kind = rnd.randrange(8 if depth else 5)
    if kind < 5:
        return rnd.choice((1, 2, "a", "b c", "é'\"", None, True, False, ""))
    if kind == 5:
        return [anything(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(("a", "b", "x y", "q'r", 'd"e', "é")): anything(rnd, depth - 1) for _ in range(rnd.randint(0, 3))}


def test_containment_like_the_plain_version(spark):
    rnd = random.Random(6)
    values = [anything(rnd) for _ in range(250)]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(-1, None), (-2, "{bad")], "id int, t string")
    patterns = [{}, [], 1, "a", None, True, {"a": 1}, {"a": {}}, {"a": []}, [1], [["a"]], [{"a": 1}], {"a": {"b": [2]}}, {"x y": None}, {"q'r": "b c"}, {'d"e': True}, {"é": "é'\""}, [1, "a"], {"a": 1, "b": 2}]
    got = df.select("id", *(js.contains("t", p).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for r in got:
        for k, p in enumerate(patterns):
            want = None if r.id == -1 else r.id >= 0 and holds(values[r.id], p)
            assert r[f"p{k}"] == want, (r.id >= 0 and values[r.id], p)


def test_canonical_texts(spark):
    rnd = random.Random(7)
    turned = lambda v: {k: turned(v[k]) for k in rnd.sample(sorted(v), len(v))} if isinstance(v, dict) else [turned(e) for e in v] if isinstance(v, list) else v
    values = [anything(rnd) for _ in range(120)]
    df = spark.createDataFrame([(json.dumps(v), json.dumps(turned(v), indent=1)) for v in values], "a string, b string")
    forms = [(r.a, r.b) for r in df.select(js.canonical("a").alias("a"), js.canonical("b").alias("b")).collect()]
    assert all(a == b and json.loads(a) == v for (a, b), v in zip(forms, values))
    plain = lambda v: json.dumps(v, sort_keys=True)
    assert len({a for a, _ in forms}) == len(set(map(plain, values)))
    odd = spark.createDataFrame([("1.50",), ("bad",), ('{"a":1,"a":2}',), (None,)], "a string").select(js.canonical("a").alias("a"))
    assert [r.a for r in odd.collect()] == ["1.5", "bad", '{"a":1,"a":2}', None]


def test_nested_attributes_in_another_order_are_no_conflict(spark):
    rows = [(1, 2, "uses", '{"a":{"x":1,"y":[1,2]}}'), (1, 2, "uses", '{"a":{"y":[1,2],"x":1.0}}'), (1, 3, "uses", '{"a":1}'), (1, 3, "uses", '{"a":2}'), (1, 4, "uses", "{}"), (1, 4, "uses", '{"a":2}'), (1, 5, "uses", None)]
    df = spark.createDataFrame(rows, "from_entity long, to_entity long, relation_type string, attributes string")
    assert [(r.from_entity, r.to_entity, r.n) for r in graph.attribute_conflicts(df).collect()] == [(1, 3, 2)]
