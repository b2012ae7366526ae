import random

import corpus_pipeline as pipeline
import pytest
from murmura.llm import queries

from .test_near_duplicates import WORDS


@pytest.fixture
def folder(spark, tmp_path):
    """A small corpus: clean texts, a near copy, an exact copy, a shared passage, junk, text without letters, nulls."""
    r = random.Random(1)
    line = lambda n: " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(line(r.randint(8, 14)) for _ in range(12))
    clean = [text() for _ in range(30)]
    passage = line(50)
    docs = [(i, t, "en") for i, t in enumerate(clean)]
    docs += [(100, clean[0].replace("a", "a", 1) + " More.", "en"), (101, clean[1], "en"), (102, text() + "\n" + passage, "en"), (103, text() + "\n" + passage, "en")]
    docs += [(200 + i, "\n".join(" ".join(f"X{r.randrange(999)}$$$" for _ in range(12)) for _ in range(12)), "en") for i in range(10)]
    docs += [(300, None, "en"), (301, "123 456 !!!", None), (302, "", "en"), (None, text(), "en"), (5, clean[5], "en")]
    rows = [(i, t, lang, "s", len(t or ""), "clash") for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i >= 200 else 1, 0) for i in [*range(30), *range(200, 210)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = queries.documents(spark, folder)
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = {r.doc_id: r for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    clean = set(range(30)) | {102, 103, None}
    assert kept["language"].keys() == clean | {100, 101} | set(range(200, 210))
    assert kept["quality"].keys() == clean | {100, 101}
    assert kept["near_duplicates"].keys() == clean
    assert kept["repeats"].keys() == clean
    before, after = kept["near_duplicates"], kept["repeats"]
    for i in clean:
        if i in (102, 103):
            assert after[i].text == " ".join(before[i].text.split()[:-50]) and after[i].n_chars == len(after[i].text)
        else:
            assert after[i].text == " ".join(before[i].text.split())
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == clean and len(packed) == len(clean)


def test_run(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    assert len(rows) == 33 and {r.doc_id for r in rows} == set(range(30)) | {102, 103, None}


def test_empty_tables(spark, folder, tmp_path):
    queries.documents(spark, folder).limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/e").collect() == []


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    a, b, c, d = (" ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(80)) for _ in range(4))
    # 5: a near copy of 1 and a text of its own; 6: two heads, one twice; 7: two near copies of each other
    rows = [(1, a), (5, a + " more"), (5, b), (6, c), (6, c), (6, b[:200] + d), (7, d), (7, d + " more"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(x) for x in pipeline.one_of_near_duplicates(spark, docs, str(tmp_path)).collect()]
    sevens = [t for i, t in left if i == 7]
    assert len(sevens) == 1 and sevens[0] in (d, d + " more")
    assert sorted((i or 0, t) for i, t in left if i != 7) == sorted([(0, a), (1, a), (5, b), (6, c), (6, b[:200] + d)])
