import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmura.llm import jaccard, substring_dedup
from murmura.llm.jaccard import jaccard_components
from murmura.llm.runtime import connected_components
from murmura.llm.substring_dedup import remove_repeats

WORDS = [f"v{i}" for i in range(400)]


def near_copies(seed=3):
    """Bases with chains of edited copies, exact copies and a passage that many share."""
    r, docs = random.Random(seed), []
    passage = [r.choice(WORDS) for _ in range(50)]
    for _ in range(12):
        base = [r.choice(WORDS) for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(r.choice([1, 2, 9])):
            docs.append(" ".join(base))
            base = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                base[r.randrange(len(base))] = r.choice(WORDS)
            if r.random() < 0.3:
                base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
    return [(i * 3 % 101 + 1000 * (i // 101), t) for i, t in enumerate(docs)]


def brute_components(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_components_equal_brute_force(spark):
    for seed in (3, 4):
        docs = near_copies(seed)
        found = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(docs)


def test_chains_link_although_their_ends_do_not(spark):
    words = [f"x{i}" for i in range(120)]
    docs = [(i, " ".join(words[i * 10 : i * 10 + 100])) for i in range(3)]
    want = brute_components(docs)
    assert {c for _, c in want.values()} == {0}
    found = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_hot_tokens_are_split_and_still_link(spark, monkeypatch):
    """Salted leaders of one token meet again."""
    docs = [(i, " ".join([f"c{k}" for k in range(40)] + [f"own{i}"])) for i in range(40)]
    rows = sorted((7, 100 + i, 2 << 56 | 40) for i in range(40))
    rows.sort(key=lambda r: (r[0], r[1] & 3, r[2], r[1]))
    made = spark.createDataFrame(rows, "token long, set_id long, packed long").coalesce(1).mapInArrow(jaccard._stars(75), "token long, set_id long, size long, place long, leader long, under long, over long, before long, heads_salt boolean, posted boolean").collect()
    assert len(made) == 40 and [r.set_id for r in made if r.heads_salt] == [100, 101, 102, 103] and all(r.posted for r in made)
    assert {r.leader for r in made} == {None, 100, 101, 102, 103}
    found = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_stars_do_not_depend_on_batches():
    r = random.Random(11)
    band = lambda size: np.floor(np.log(size) * jaccard._width(75))
    rows = sorted((t, k & ((1 << s) - 1), band(60 + k % 7 * 9), k % 5, k, s << 56 | (k % 5) << 28 | (60 + k % 7 * 9)) for t in range(60) for s in [r.choice([0, 0, 0, 1])] for k in r.choices(range(40), k=r.choice([1, 2, 3, 30])))
    columns = [(x[0], x[4], x[5]) for x in rows]

    def made(size, wait):
        old, jaccard._WAIT = jaccard._WAIT, wait
        parts = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in columns[at : at + size]], pa.int64()) for i in range(3)], ["token", "set_id", "packed"]) for at in range(0, len(columns), size)]
        try:
            return [tuple(x.values()) for b in jaccard._stars(75)(iter(parts)) for x in b.to_pylist()]
        finally:
            jaccard._WAIT = old

    whole = made(10_000, 10_000)
    assert made(1, 10_000) == made(7, 10_000) == whole and len(whole) > 100
    without_next = lambda x: x[:6] + x[7:8]  # noqa: E731  the leader of the band over may not have come yet
    for size, wait in ((1, 3), (5, 4), (16, 8)):  # tokens with more rows than wait are given as they come, all posted
        part = made(size, wait)
        assert {without_next(x) for x in part} >= {without_next(x) for x in whole if x[9]}


def copies_of(base, n, edits, seed):
    """Copies of base, each with words of its own put in so many places."""
    r, docs = random.Random(seed), []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(0, len(base), 6), edits):
            words[k] = f"e{i}x{k}"
        docs.append(" ".join(words))
    return docs


def test_many_copies_that_do_not_link_with_each_other(spark, monkeypatch):
    """500 copies that link with their original alone, 500 that link with nothing: what is compared grows in proportion."""
    base, far = [f"b{i}" for i in range(200)], [f"f{i}" for i in range(200)]
    asked = {}

    def counted(df, name, keep=jaccard.materialize):
        out = keep(df, name)
        if name in ("pairs", "asked"):
            asked.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    docs = [*enumerate(copies_of(base, 500, 5, 1), 10), (5, " ".join(base)), *enumerate(copies_of(far, 500, 11, 2), 1000)]
    random.Random(3).shuffle(docs)
    want = brute_components(docs)
    assert len({c for i, (_, c) in want.items() if i >= 1000}) == 500 and {c for i, (_, c) in want.items() if i < 1000} == {5}
    found = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert asked["pairs"][0] < 10 * len(docs) and asked["asked"][0] < 10 * len(docs), asked


def test_without_stars_the_matrix_finds_all(spark, monkeypatch):
    """All links by groups, of many unions and in several parts."""
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 2_000)
    monkeypatch.setattr(jaccard, "QUERIES", 7)
    stars = jaccard._stars

    def none_linked(percent):
        run = stars(percent)

        def over(batches):
            for b in run(batches):
                for c in ("leader", "under", "over", "before"):
                    b = b.set_column(b.schema.names.index(c), c, pa.nulls(len(b), pa.int64()))
                yield b

        return over

    monkeypatch.setattr(jaccard, "_stars", none_linked)
    # every token of these is in no text or in more than two
    docs = [*enumerate(t for k, edits in enumerate((1, 3, 4, 5, 7, 9)) for t in copies_of([f"b{k}y{i}" for i in range(60 + 30 * k)], 20, edits, 4))]
    assert 20 < len({c for _, c in brute_components(docs).values()}) < 110
    found = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(docs)


def test_sets_whose_keys_clash_stay_apart(spark):
    a, b = (jaccard.shingles(t) for t in (b"a b c d e f", b"g h i j k l"))
    (key, more), (_, other) = jaccard._name(a), jaccard._name(b)
    assert jaccard._key(a, {}) == key >= 0
    clashes = {key: sorted([more, more + 1 if more < 0 else more - 1])}
    keys = {jaccard._key(a, {key: [x, more]}) for x in (more, more - 1)}
    assert len(keys) == 2 and min(keys) < 0 and jaccard._key(b, clashes) == jaccard._name(b)[0]
    rows = spark.createDataFrame([(5, 1), (5, 2), (6, other), (6, other), (None, None)], "set_id long, more long")
    assert jaccard._clashes(rows) == {5: [1, 2]}


def test_awkward_rows(awkward, no_rows):
    rows = jaccard_components(awkward).collect()
    assert len(rows) == awkward.count()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1
    assert got[(6, 56, 5)] == 2 and got[(5, 56, 5)] == 1 and got[(None, 56, None)] == 1
    assert got[(8, 1, 7)] == 1
    assert jaccard_components(no_rows).collect() == []


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 6), (None, 4), (20, 19), (19, 18), (18, 17), (17, 16)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **dict.fromkeys(range(16, 21), 16)}


def brute_repeats(docs, span=35):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[k : k + span]) for w in words for k in range(len(w) - span + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - span + 1):
            gone[k : k + span] |= seen[tuple(w[k : k + span])] > 1
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return Counter(out)


def planted(seed):
    r, docs = random.Random(seed), []
    few = WORDS[: r.choice([3, 40, 400])]
    passages = [[r.choice(few) for _ in range(n)] for n in (34, 35, 36, 80, 200)]
    for i in range(60):
        text = [r.choice(few) for _ in range(r.randint(0, 120))]
        for p in r.sample(passages, r.randint(0, 3)):
            k = r.randint(0, len(text))
            a, b = (0, len(p)) if r.random() < 0.7 else (r.randint(0, 10), len(p) - r.randint(0, 10))
            text[k:k] = p[a:b]
        docs.append((i, " ".join(text)))
    return docs + [docs[0], docs[1], (77, docs[2][1])]


def test_repeats_equal_brute_force(spark):
    for seed in range(4):
        docs = planted(seed)
        found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_repeats(docs)


def test_hot_anchors_list_their_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    for seed in (0, 2):
        docs = planted(seed)
        found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_repeats(docs)


def test_extensions_do_not_depend_on_batches():
    r, span = random.Random(2), 20
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(30):
        a = r.randint(0, 30)
        text = [f"x{r.random()}" for _ in range(r.randint(0, 20))] + passage[a : a + r.randint(10, 30)] + [f"y{r.random()}" for _ in range(20)]
        texts.append(" ".join(text).encode())
    rows = []
    for key, t in enumerate(texts):
        h = substring_dedup._words(t)
        for anchor, _, start, shape in zip(*substring_dedup._described(t, span), strict=True):
            n = int(shape) & (1 << substring_dedup._BITS) - 1
            rows.append((int(anchor), key, int(start), int(shape), False, h[start : start + n - 1 + span].tobytes()))
    rows.sort(key=lambda x: (x[0], x[1], x[2]))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def made(size, together):
        old, substring_dedup.TOGETHER = substring_dedup.TOGETHER, together
        parts = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at : at + size]], k) for i, k in enumerate(kinds)], ["anchor", "doc_key", "start", "shape", "repeats", "words"]) for at in range(0, len(rows), size)]
        try:
            return sorted(tuple(x.values()) for b in substring_dedup._extend(span)(iter(parts)) for x in b.to_pylist())
        finally:
            substring_dedup.TOGETHER = old

    whole = made(10_000, 10_000)
    assert whole and whole == made(1, 1) == made(7, 20)
    words = [t.split() for t in texts]
    windows = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    want = {(d, i) for d, w in enumerate(words) for i in range(len(w) - span + 1) if windows[tuple(w[i : i + span])] > 1}
    assert {(d, s + k) for d, s, n in whole for k in range(n)} == want


def test_names_that_clash_are_refused(awkward):
    for name in ("n_words", "kept", "text"):
        with pytest.raises(ValueError, match=name):
            remove_repeats(awkward.withColumn("n_words", F.lit(1)), keep=(name,))


def test_a_text_that_repeats_itself(spark):
    text = " ".join(["again"] * 36 + [f"w{i}" for i in range(50)])
    docs = [(1, text), (2, " ".join(["again"] * 35))]
    found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_repeats(docs)


def test_blocks_cover_every_window_once():
    h = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    place, first, n = substring_dedup.blocks(h, 35)
    assert n.sum() == 500 - 34 and (np.cumsum(n)[:-1] == first[1:]).all()
    assert ((place >= first + n - 1) & (place + substring_dedup.GRAM <= first + 35)).all()


def test_repeats_of_awkward_rows(awkward, no_rows):
    rows = remove_repeats(awkward, keep=("source",)).collect()
    assert len(rows) == awkward.count() and rows[0].asDict().keys() == {"doc_id", "source", "n_words", "n_removed", "kept"}
    got = {(r.doc_id, r.n_words, r.n_removed) for r in rows}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 30_000, 30_000), (5, 60, 60), (6, 60, 60), (None, 60, 60), (7, 3, 0)} <= got
    assert remove_repeats(no_rows).collect() == []
