import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import language, quality
from murmura.llm.queries import held_out

SYLLABLES = {"xa": ["ka", "ro", "mi", "tu", "sel"], "xb": ["zge", "pfa", "lich", "sten", "ung"], "xc": ["дом", "ре", "ка", "сто"], "xd": ["日", "本", "語", "文"]}


def sentence(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [(i, sentence(lang, r.randint(5, 60), r), lang) for i, lang in enumerate(r.choice(sorted(SYLLABLES)) for _ in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(corpus):
    return language.train(corpus.where(~held_out()), sample_docs=300)


def test_held_out_accuracy(corpus, model):
    rows = language.identify(corpus.where(held_out()), model, keep=("lang",)).collect()
    assert len(rows) > 60 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_spans(spark, model):
    r = random.Random(2)
    text = f"{sentence('xa', 30, r)} {sentence('xb', 40, r)} {sentence('xc', 10, r)}"
    row = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).first()
    assert [(s.lang, s.start, s.end) for s in row.spans] == [("xa", 0, 30), ("xb", 30, 70), ("xc", 70, 80)] and row.lang_pred == "xb"


def test_scripts_narrow_candidates(model):
    cyrillic = language.SCRIPTS.index("cyrillic")
    assert [k for k, ok in zip(model.langs, model.allowed[cyrillic], strict=True) if ok] == ["xc"]
    assert [language.SCRIPTS[language.script_of(c)] for c in "aДא한ひ語"] == ["latin", "cyrillic", "hebrew", "hangul", "kana", "han"]


def best_path(scores, penalty):
    n, k = scores.shape
    return max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False)))


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(150):
        scores = r.normal(0, 4, (r.integers(1, 8), 3))
        penalty = float(r.choice([0.5, 3, 12]))
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        want = value(best_path(scores, penalty))
        assert value(language.viterbi(scores, penalty)) == pytest.approx(want)
        if (k := language.constant(scores, penalty)) is not None:
            assert value([k] * len(scores)) == pytest.approx(want)


def test_language_of_awkward_rows(awkward, no_rows, model, spark):
    rows = language.identify(awkward, model, keep=("doc_id", "text", "source")).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == awkward.count() and got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[9][0] == "xd" and 0 < got[9][1] < 1
    assert language.identify(no_rows, model).collect() == []
    greek = language.identify(spark.createDataFrame([(1, "αβγ δεζ")], "doc_id long, text string"), model).first()
    assert greek.lang_pred in model.langs and greek.score == 0
    nothing = language.train(no_rows)
    assert {r.lang_pred for r in language.identify(awkward, nothing).collect()} == {"und"}


def brute_counts(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else "\0" for c in text).split("\0") if w]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_base_counts_equal_brute_force():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "é", "日", " ", " ", "\n", "\t", "#", "|", "<", "\xa0", "a b\n"]) for _ in range(r.randint(0, 80)))
        assert quality.describe(text.encode()) == brute_counts(text), repr(text)


def test_decoding_equals_brute_force():
    r = np.random.default_rng(6)
    for _ in range(100):
        crf = quality.Crf(r.normal(0, 1, (quality.FEATURES, 2)), r.normal(0, 1, (2, 2)))
        features = [[int(a) + int(r.integers(0, n)) for a, n in zip(quality._FIRST, quality._SIZES, strict=False)] for _ in range(r.integers(1, 8))]
        value = lambda p: sum(crf.emit[f, y].sum() for f, y in zip(features, p, strict=True)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert value(crf.decode(features)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(features)))))


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(7)
    sequences = [([[int(a) + int(r.integers(0, n)) for a, n in zip(quality._FIRST, quality._SIZES, strict=False)] for _ in range(k)], r.integers(0, 2, k).tolist()) for k in (4, 2, 1)]
    lengths = np.array([4, 2, 1])
    active = [int((lengths > t).sum()) for t in range(4)]
    at = [np.array([sequences[i][0][t] for i in range(n)]) for t, n in enumerate(active)]
    gold = [np.array([sequences[i][1][t] for i in range(n)]) for t, n in enumerate(active)]
    weight = [np.ones(n) for n in active]

    def loss(theta):
        emit, move = theta[: quality.FEATURES * 2].reshape(-1, 2), theta[quality.FEATURES * 2 :].reshape(2, 2)
        value = lambda f, p: sum(emit[x, y].sum() for x, y in zip(f, p, strict=True)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))
        return sum(np.log(sum(np.exp(value(f, p)) for p in itertools.product((0, 1), repeat=len(f)))) - value(f, y) for f, y in sequences)

    theta = r.normal(0, 0.5, quality.FEATURES * 2 + 4)
    g = quality._gradient(theta, at, gold, weight, active)
    for i in [*range(0, len(theta), 9), *range(len(theta) - 4, len(theta))]:
        step = np.eye(1, len(theta), i)[0] * 1e-5
        assert g[i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-5, abs=1e-4)


def test_quality_learns_and_handles_awkward_rows(spark, awkward, no_rows):
    r = random.Random(8)
    clean = lambda: "\n".join(" ".join(f"word{r.randrange(900)}" for _ in range(r.randint(6, 14))) + "." for _ in range(10))
    junk = lambda: "\n".join(" ".join(f"J{r.randrange(900)}###" for _ in range(r.randint(6, 14))) for _ in range(10))
    docs = spark.createDataFrame([(i, junk() if i % 3 == 0 else clean()) for i in range(150)], "doc_id long, text string")
    labels = docs.where("doc_id < 75").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    odd = spark.createDataFrame([(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    crf = quality.train(docs, labels.union(odd).union(labels))
    rows = quality.quality(docs, crf).collect()
    assert all(x.kept == (x.doc_id % 3 != 0) for x in rows)
    got = {x.doc_id: x for x in quality.quality(awkward, crf, keep=("doc_id", "text", "source")).collect()}
    assert len(got) == 11 and got[1].base_failed and not got[1].kept and got[2].n_words == 0
    assert quality.quality(no_rows, crf).collect() == []
    untrained = quality.train(no_rows, labels.limit(0))
    assert quality.quality(docs, untrained).count() == 150


def test_long_labelled_texts_are_learned_in_bounded_time(spark):
    """200,000 lines of one label do not hold the driver, and do not outweigh other documents."""
    long_text = "\n".join(f"word{i} and more of it here." for i in range(200_000))
    junk = "\n".join("J### $$ ||" for _ in range(5))
    docs = spark.createDataFrame([(1, long_text), (2, junk), (3, junk + "\nX## $$")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    began = time.perf_counter()
    crf = quality.train(docs, labels)
    assert time.perf_counter() - began < 60
    found = {r.doc_id: r.content_share for r in quality.quality(docs, crf).collect()}
    assert found[1] == 1.0 and found[2] == found[3] == 0.0


def test_equal_scores_are_content():
    crf = quality.Crf(np.zeros((quality.FEATURES, 2)), np.zeros((2, 2)))
    assert crf.decode(quality.lines_of(b"a b c\nd e\n### f")[0]) == [1, 1, 1]


def test_held_out_accuracy_on_documents(spark):
    """Trained on documents that are not held out, right on those that are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trained = language.train(docs.where(~held_out()), sample_docs=4_000)
    rows = language.identify(docs.where(held_out() & F.col("lang").isNotNull()), trained, keep=("lang", "text"), penalty=16.0).where("lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)


def test_tied_languages_are_told_apart_by_name(spark):
    same = spark.createDataFrame([(i, "one and the same text", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    found = {r.lang_pred for r in language.identify(same, language.train(same)).collect()}
    assert len(found) == 1 and found < {"a", "b"}


def test_rare_languages_are_learned(spark):
    common = spark.range(6_000).selectExpr("id doc_id", "if(id % 3 = 0, 'the house by the river', 'old garden of the town') text", "'en' lang")
    rare = spark.createDataFrame([(10_000 + i, "αβγ δεζ ηθι", "el") for i in range(3)], "doc_id long, text string, lang string")
    model = language.train(common.union(rare), sample_docs=300)
    assert model.langs == ["el", "en"] and model.prior == 1
    found = language.identify(rare, model).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("el", 1.0)] * 3


def test_sample_shares():
    assert language.sample_shares({}, 10) == {}
    assert language.sample_shares({"a": 400, "b": 500}, 1_000) == {"a": 1.0, "b": 1.0}
    assert language.sample_shares({"a": 10_000, "b": 100, "c": 4_500}, 1_000) == {"a": 0.045, "b": 1.0, "c": 0.1}
    assert language.sample_shares({str(i): 2_000 for i in range(1_000)}, 1_000) == {str(i): 0.01 for i in range(1_000)}
