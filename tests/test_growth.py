"""Chains, records made along them, vocabularies and alias classes against brute force."""

import random

import pytest
from murmura.operators import chains as C
from murmura.operators import vocabulary as V


def brute_chains(rows):
    following = {}
    for shop, node, after in rows:
        if shop is not None and node is not None:
            following.setdefault((shop, node), set()).add(after)
    after = {k: min((x for x in v if x is not None), default=None) for k, v in following.items()}
    before = {}
    for (shop, node), x in sorted(after.items(), reverse=True):
        if x is not None and x != node:
            before[shop, x] = node
    out = []
    for shop, node in after:
        path, seen = [node], {node}
        while (shop, path[-1]) in before and before[shop, path[-1]] not in seen:
            path.append(before[shop, path[-1]])
            seen.add(path[-1])
        if (shop, path[-1]) not in before:
            out.append((shop, path[-1], node, len(path), before.get((shop, node))))
    went_on = {(s, p) for s, _, _, _, p in out if p is not None}
    return sorted((*r, (r[0], r[2]) not in went_on) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_chains(spark, seed):
    r = random.Random(seed)
    rows = [(f"s{r.randint(0, 2)}", n, r.choice([None, n + 1, n + 1, r.randint(0, 40), n])) for n in [r.randint(0, 40) for _ in range(70)]]
    rows += [("long", n, n + 1) for n in range(100, 170)] + [("ring", 1, 2), ("ring", 2, 3), ("ring", 3, 1), (None, 1, 2), ("s0", None, 3)]
    frame = spark.createDataFrame(rows, "shop string, node int, next int")
    got = sorted(tuple(x) for x in C.chains(frame).collect())
    known = {(s, n) for s, n, _ in rows if s is not None and n is not None}
    assert got == [x for x in brute_chains(rows) if (x[0], x[2]) in known]
    assert ("long", 100, 169, 70, 168, True) in got and not any(x[0] == "ring" for x in got)
    assert C.chains(frame.limit(0)).collect() == []


def test_node_of_shop_or_default(spark):
    paths = spark.createDataFrame([("GEN", "A1", 1, None), ("GEN", "A2", 2, "A1"), ("x", "B1", 1, None)], "shop string, node string, place int, previous string")
    asked = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), (None, 1), ("y", None)], "shop string, round int")
    assert sorted(map(tuple, C.node_of(asked, paths).collect()), key=str) == sorted([("x", 1, "B1", None), ("x", 2, None, None), ("y", 2, "A2", "A1"), (None, 1, "A1", None), ("y", None, None, None)], key=str)


def test_templates(spark):
    rows = [("s", "A1-b", 2, ["gmv_x", "v"], "two", "n"), ("s", "A1-a", 1, None, "one", None), ("s", "B", 3, ["gmv_x"], "b", None), ("t", "B", 1, [], None, None)]
    records = spark.createDataFrame(rows, "shop string, id string, place long, flags array<string>, title string, note string")
    made = C.synthesised(records, [C.Template("N", ("A1-b", "A1-"), {"title": "new"}, ("v", "w")), C.Template("M", ("A1-",), {}, ("w",), keep_flags=False)], ("A1-",), ("gmv_",))
    got = {(r.shop, r.id): (r.place, r.flags, r.title, r.note) for r in made.collect()}
    assert got == {("s", "N"): (0, ["v", "w"], "new", "n"), ("s", "M"): (1, ["w"], "one", None), ("t", "N"): (0, ["v", "w"], "new", None), ("t", "M"): (1, ["w"], None, None), ("s", "B"): (5, [], "b", None), ("t", "B"): (3, [], None, None)}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_vocabulary(spark):
    values, aliases = frame(spark, [("f", "Red"), ("f", "Blue")], "field string, value string"), frame(spark, [("f", "Red", "crimson")], "field string, canon string, alias string")
    new = frame(spark, [("f", " red"), ("f", "GREEN "), ("f", "green"), ("f", " "), ("f", None), ("g", "x"), (None, "y")], "field string, value string")
    more = frame(spark, [("f", "Red", "Crimson"), ("f", "red", "RED"), ("f", "Blue", "navy"), ("f", "Blue", "Navy"), ("f", None, "z")], "field string, canon string, alias string")
    vocabulary, log = V.merged(values, aliases, new, more)
    assert sorted(map(tuple, vocabulary.collect()), key=str) == sorted([("f", "value", None, "Red"), ("f", "value", None, "Blue"), ("f", "value", None, "GREEN"), ("f", "alias", "Red", "crimson"), ("f", "alias", "Blue", "Navy"), ("f", "alias", None, "z")], key=str)
    got = sorted(((r.field, r.kind, r.item, r.action, r.reason) for r in log.collect()), key=str)
    want = [("f", "value", "red", "rejected", "known"), ("f", "value", "GREEN", "inserted", None), ("f", "value", "", "rejected", "blank"), ("g", "value", "x", "rejected", "unknown_field"), (None, "value", "y", "rejected", "unknown_field"), ("f", "alias", "Crimson", "rejected", "known"), ("f", "alias", "RED", "rejected", "same_as_canon"), ("f", "alias", "Navy", "inserted", None), ("f", "alias", "z", "inserted", None)]
    assert got == sorted(want, key=str)
    assert V.merged(values.limit(0), aliases.limit(0), new.limit(0), more.limit(0))[0].collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_alias_classes(spark, seed):
    r = random.Random(seed)
    rows = [(f"f{r.randint(0, 1)}", f"n{r.randint(0, 60)}".upper(), f" n{r.randint(0, 60)}") for _ in range(50)] + [("long", f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [(None, "a", "b"), ("f0", "", "b"), ("f0", None, "b")]
    sets = {}
    for field, a, b in rows:
        if field and a and b.strip():
            a, b = (field, a.strip().lower()), (field, b.strip().lower())
            both = sets.get(a, {a}) | sets.get(b, {b})
            for x in both:
                sets[x] = both
    got = {(x.field, x.name): x.head for x in V.classes(frame(spark, rows, "field string, canon string, alias string")).collect()}
    assert got == {k: min(n for _, n in v) for k, v in sets.items()}
    assert V.classes(frame(spark, [], "field string, canon string, alias string")).collect() == []
