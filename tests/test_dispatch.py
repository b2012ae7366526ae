"""Files by suffix, rows of fetchers, labels of key information."""

import pytest
from murmura.operators import labels as L
from murmura.sources import dispatch


def test_folder_of_several_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.HTML").write_text("<h1>S</h1><h2>I</h2>" + "text " * 40)
    (tmp_path / "q.txt").write_text("1. é one\n2. two")
    (tmp_path / "r.json").write_text('[{"title": "t", "content": "c"}]')
    (tmp_path / "s.docx").write_text("x")
    (tmp_path / "~$q.txt").write_text("1. lock")
    got = sorted((r.source_file, r.seq, r.intent_category, r.title) for r in dispatch.folder(spark, str(tmp_path)).collect())
    assert got == [("a/p.HTML", 1, "I", "I"), ("q.txt", 1, "GEN", "é one"), ("q.txt", 2, "GEN", "two"), ("r.json", 1, None, "t")]
    rows = spark.createDataFrame([("x.docx", "1"), ("y.txt", "1. a"), (None, "1. a"), ("z.txt", None)], "source_file string, text string")
    assert [r.source_file for r in dispatch.unknown(rows).collect()] == ["x.docx", None] and dispatch.chunked(rows).count() == 1


def test_longest_suffix_takes_a_file(spark):
    from pyspark.sql import functions as F

    kinds = {".json": lambda df: df.select("source_file", F.lit("any").alias("title")), ".chunks.json": lambda df: df.select("source_file", F.lit("chunks").alias("title"))}
    rows = spark.createDataFrame([("a.json", ""), ("b.chunks.json", "")], "source_file string, text string")
    assert sorted((r.source_file, r.title) for r in dispatch.chunked(rows, kinds).collect()) == [("a.json", "any"), ("b.chunks.json", "chunks")]
    with pytest.raises(ValueError, match="already"):
        dispatch.chunker(".txt")(lambda df: df)


def rows_of_numbers(wanted, part, parts, upto="0"):
    """A fetcher: numbers of this part; what is asked for only."""
    for i in range(part, int(upto), parts):
        if i in wanted.get("id", {i}):
            yield i, ",".join(f"{k}={sorted(v)}" for k, v in wanted.items())


def test_fetched_rows_with_pushed_filters(spark):
    table = lambda: dispatch.fetched(spark, "tests.test_dispatch:rows_of_numbers", "id int, asked string", parts=3, upto="20")
    assert sorted(r.id for r in table().collect()) == list(range(20)) and table().rdd.getNumPartitions() == 3
    assert [tuple(r) for r in table().where("id = 7").collect()] == [(7, "id=[7]")]
    assert sorted(r.asked for r in table().where("id in (3, 4) and id > 3").collect()) == ["id=[3, 4]"]


def test_longest_prefix(spark):
    slots = spark.createDataFrame([(1, "wa_group_1"), (2, "wa_x"), (3, "w"), (4, ""), (5, None)], "i int, slot string")
    prefixes = spark.createDataFrame([("wa_", "wa"), ("wa_group_", "group"), ("x", "x")], "prefix string, tag string")
    assert sorted((r.i, r.tag) for r in L.slot_tags(slots, prefixes).collect()) == [(1, "group"), (2, "wa")]
    assert L.slot_tags(slots, prefixes.limit(0)).collect() == []


def test_labels(spark):
    rows = [
        (1, "s", ["wa_group_a", "affiliate_link_x"], None, None, None), (2, "s", None, "go {affiliate_link_x}", "{wa_group_a}", []), (3, "s", ["wa_group_a"], None, None, ["nothing", " WA  "]), (4, "s", ["wa_group_a", "affiliate_link_x"], "", "", ["AFFILIATE_LINK", "WA", "wa"]),
        (5, "s", ["wa_group_none"], None, None, None), (6, None, ["wa_group_a"], None, None, None), (7, "t", ["wa_group_a"], None, None, None), (8, "u", ["wa_group_a", "affiliate_link_x"], None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id int, shop string, slots array<string>, content string, encontent string, information array<string>")
    values = spark.createDataFrame([(s, n, "v") for s in "stu" for n in ("wa_group_a", "affiliate_link_x")] + [("s", "wa_group_none", " ")], "shop string, slot string, value string")
    extracted = spark.createDataFrame([("t", "affiliate_link"), ("u", "affiliate_link"), ("u", "whatsapp_group")], "shop string, tag string")
    aliases = spark.createDataFrame([("s", "whatsapp_group", 2, "group"), ("s", "whatsapp_group", 1, "WA")], "shop string, tag string, place int, alias string")
    got = {r.record_id: r.labels for r in L.labels(records, values, extracted, aliases, L.fixed_prefixes(records)).collect()}
    assert got == {1: ["WA", "affiliate link"], 2: ["affiliate link", "WA"], 3: ["WA"], 4: ["affiliate link", "WA"], 8: ["whatsapp group", "affiliate link"]}
    assert L.labels(records.limit(0), values, extracted, aliases, L.fixed_prefixes(records)).collect() == []
