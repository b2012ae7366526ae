"""Readers and sinks on temporary folders."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from murmura.sources import files, sinks


def test_documents_by_suffix(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.html": "<p>a", "b.HTM": "b", "~$c.html": "lock", "d.txt": "d", "in/e.html": "e"}.items():
        (tmp_path / name).write_text(text)
    found = {r.source_file: r.size for r in files.documents(spark, str(tmp_path), (".html", ".htm")).collect()}
    assert found == {"a.html": 4, "b.HTM": 1, "in/e.html": 1}
    flat = files.documents(spark, str(tmp_path), (".html",), recursive=False).collect()
    assert [r.source_file for r in flat] == ["a.html"] and len(flat[0].sha256) == 64
    assert [r.source_file for r in files.documents(spark, str(tmp_path), (".html",), only=["in/e.html"]).collect()] == ["in/e.html"]
    assert files.documents(spark, str(tmp_path), (".xlsx",)).collect() == []


def test_chunks_and_texts(spark, tmp_path):
    (tmp_path / "book.chunks.json").write_text(json.dumps([{"id": "1", "title": "A", "content": "x"}, {"id": "2"}]))
    (tmp_path / "other.json").write_text("[]")
    rows = files.chunks(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.title, r.stem) for r in rows] == [("1", "A", "book"), ("2", None, "book")]
    (tmp_path / "gen.txt").write_text("1. one\n2. two")
    assert files.text_document(spark, str(tmp_path / "gen.txt")).first().text == "1. one\n2. two"
    assert "## 1: A" in sinks.preview(files.chunks(spark, str(tmp_path))).orderBy("value").first().value


def test_optional_tables(spark, tmp_path):
    assert files.vectors(spark, str(tmp_path / "none")).collect() == []
    spark.range(3).write.parquet(str(tmp_path / "some"))
    rows = files.optional(spark, lambda: spark.read.parquet(str(tmp_path / "some")), "id long, name string").collect()
    assert len(rows) == 3 and {r.name for r in rows} == {None}
    with pytest.raises(AnalysisException):
        files.optional(spark, lambda: spark.range(3).select("nothing"), "id long")


def test_change_lists(spark):
    rows = files.changes(spark, {"added": ["a\\b", "c", "c"], "deleted": ["d", " "]}).orderBy("place").collect()
    assert [(r.operation, r.source_file) for r in rows] == [("added", "a/b"), ("added", "c"), ("deleted", "d")]
    for bad in ({"renamed": ["a"]}, {"added": []}, {"added": ["a"], "deleted": ["a"]}):
        with pytest.raises(ValueError):
            files.changes(spark, bad)


def test_tables_keep_whole_versions(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "t"), files.MANIFEST)
    assert table.read().collect() == [] and table.versions() == []
    new = lambda *rows: spark.createDataFrame([(f, c, 1, None) for f, c in rows], files.MANIFEST).withColumn("built_at", F.lit("2024-01-01").cast("timestamp"))
    assert sinks.upsert(table, new(("a", "1"), ("b", "1")), ["source_file"], "built_at") == 2
    (tmp_path / "t" / "v00000009-broken").mkdir()  # a writer that was lost
    assert sinks.upsert(table, new(("b", "2")), ["source_file"], "built_at") == 2
    assert {r.source_file: r.checksum for r in table.read().collect()} == {"a": "1", "b": "2"}
    assert sinks.delete(table, spark.createDataFrame([("a",), ("z",)], "source_file string"), "source_file") == 1
    assert [r.source_file for r in table.read().collect()] == ["b"] and len(table.versions()) == 3
    table.drop_old(1)
    assert len(table.versions()) == 1 and table.read().count() == 1
    assert sinks.reset(table) == 0


def test_vectors_and_columns(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "v"), files.VECTOR)
    rows = spark.createDataFrame([("1", "f", [1.0]), ("2", "g", [2.0])], "id string, source_file string, embedding array<double>")
    assert sinks.add_vectors(table, rows) == 2 and sinks.add_vectors(table, rows.where("id = '2'")) == 2
    people = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, name string, note string")
    made = sinks.column_updates(people, spark.createDataFrame([(1, "n"), (3, "z")], "id long, note string"), "id").orderBy("id").collect()
    assert [tuple(r) for r in made] == [(1, "a", "n"), (2, "b", "x")]
    with pytest.raises(ValueError):
        sinks.column_updates(people, spark.createDataFrame([(1, 1)], "id long, other long"), "id")


def test_csv_opens_as_utf8(spark, tmp_path):
    sinks.csv_with_mark(spark.createDataFrame([("é", 1), ("B", 2), ("a", 3)], "name string, n int"), str(tmp_path / "c"), [F.lower("name")])
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfname,n")


def test_requests_and_records(spark):
    rows = spark.createDataFrame([('{"shop": " ", "applicable_shops": "s", "creatorId": "1"}',), ("no json",), (None,)], "raw string")
    found = rows.select(files.request(F.col("raw")).alias("r")).select("r.shop", "r.creator_id").collect()
    assert [tuple(r) for r in found] == [("s", "1"), (None, None), (None, None)]
    texts = spark.createDataFrame([('[{"id": "1"}]',), ('{"records": [{"id": "2"}, {"id": "3"}]}',), ("{}",), (None,)], "t string")
    assert [None if r.x is None else [i.id for i in r.x] for r in texts.select(files.records(F.col("t"), "id string").alias("x")).collect()] == [["1"], ["2", "3"], None, None]


def test_second_writer_from_one_version_fails_and_tries_again(spark, tmp_path):
    schema, path = "k int, v int", str(tmp_path / "t")
    one, two = (sinks.Table(spark, path, schema) for _ in range(2))
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    base = two.entry()
    one.replace(rows((1, 1)))
    with pytest.raises(sinks.Stale):
        two.commit(base, two.write(rows((2, 2))))
    assert one.read().count() == 1 == len(two.versions())
    calls = []

    def make(old):
        if not calls:  # another writer comes in between
            one.change(lambda old: old.union(rows((3, 3))))
        calls.append(1)
        return old.union(rows((2, 2)))

    two.change(make)
    assert sorted(map(tuple, two.read().collect())) == [(1, 1), (2, 2), (3, 3)] and len(calls) == 2
    assert one.read(2).count() == 2  # an older version is still whole


def test_a_change_of_one_key_writes_one_bucket(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "t"), "k int, v int", ["k"], 16)
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    assert sinks.upsert(table, rows(*[(i, 1) for i in range(300)]), ["k"], "v") == 300
    first = table.entry()
    assert sinks.upsert(table, rows((7, 2)), ["k"], "v") == 300
    second = table.entry()
    changed = [k for k in second["parts"] if second["parts"][k] != first["parts"][k]]
    assert len(changed) == 1 and table.read().where("v = 2").count() == 1
    written = {p.name for p in (tmp_path / "t" / second["parts"][changed[0]].split("/__")[0]).iterdir() if p.is_dir()}
    assert written == {f"__bucket={changed[0]}"}
    assert sinks.delete(table, rows((7, 0)), "k") == 1 and table.read().where("k = 7").count() == 0
    assert table.read(first["version"]).count() == 300
    table.drop_old(1)
    assert table.versions() == [3] and table.read().count() == 299
    with pytest.raises(ValueError, match="16 buckets"):
        sinks.upsert(sinks.Table(spark, str(tmp_path / "t"), "k int, v int", ["k"], 4), rows((1, 1)), ["k"], "v")


def test_batches_are_taken_in_once(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "t"), "k int", ["k"], 4)
    add = lambda *x: (lambda old: old.union(spark.createDataFrame([(i,) for i in x], "k int")))
    for number, ids in ((0, (1,)), (1, (2,)), (1, (2,)), (0, (1,))):
        table.change(add(*ids), spark.createDataFrame([(i,) for i in ids], "k int"), ("run", number))
    assert sorted(r.k for r in table.read().collect()) == [1, 2] and len(table.versions()) == 2
    table.change(add(1), spark.createDataFrame([(1,)], "k int"), ("another", 0))
    assert table.read().count() == 3


def test_json_tables_and_duplicates(spark, tmp_path):
    table = sinks.Table(spark, str(tmp_path / "t"), "k int, v array<double>, n int", form="json")
    table.replace(spark.createDataFrame([(1, [1.5], 2), (1, [2.5], 1), (2, None, 5)], table.schema))
    assert sinks.drop_duplicates(table, ["k"], "n") == 1
    assert sorted(map(tuple, table.read().collect())) == [(1, [2.5], 1), (2, None, 5)]


def test_chunks_and_vectors_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("1", "é", "a"), ("2", None, "a"), ("1", "x", "b/c")], "id string, title string, stem string")
    sinks.write_chunks(rows, str(tmp_path / "c"))
    assert sorted((r.stem, r.id, r.title) for r in files.written_chunks(spark, str(tmp_path / "c")).collect()) == [("a", "1", "é"), ("a", "2", None), ("b/c", "1", "x")]
    assert files.written_chunks(spark, str(tmp_path / "none")).collect() == []
    sinks.write_vectors_json(spark.createDataFrame([("v", [1.0, -2.5])], "id string, embedding array<double>"), str(tmp_path / "v"))
    (tmp_path / "v" / "more.json").write_text('[{"id": "w", "embedding": [3]}, {"id": "x"}]')
    assert sorted(map(tuple, files.vectors_json(spark, str(tmp_path / "v")).collect())) == [("v", [1.0, -2.5]), ("w", [3.0])]


def test_database_by_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(50).selectExpr("id", "cast(id % 3 as int) n").write.format("jdbc").option("url", url).option("dbtable", "APP.T").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    read = lambda **o: files.database(spark, url, "APP.T", driver="org.apache.derby.jdbc.EmbeddedDriver", **o)
    assert read().where("n = 1").count() == 17
    parted = read(key="id", bounds=(0, 50), parts=4)
    assert parted.rdd.getNumPartitions() == 4 and parted.count() == 50
    assert "n" in read().where("n = 1")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_checkpoint_folders_are_shared(spark):
    from murmura import session

    assert session.shared_folder("local[4]", "file:/w", "file:///").startswith("/tmp")
    assert session.shared_folder("yarn", "hdfs://n/w/", "file:///") == "hdfs://n/w/murmura-checkpoint" == session.shared_folder("k8s://x", "hdfs://n/w", "file:///")
    assert session.shared_folder("yarn", "/w", "hdfs://n") == "/w/murmura-checkpoint"
    for warehouse, store in (("file:/w", "hdfs://n"), ("/w", "file:///")):
        with pytest.raises(ValueError, match="share"):
            session.shared_folder("spark://x:7077", warehouse, store)


def test_sweep(spark):
    from murmura import session

    session.sweep(spark)
    spark.range(3).write.parquet(f"{session.checkpoint_dir(spark)}/murmura-something")
    spark.range(3).write.parquet(f"{session.checkpoint_dir(spark)}/other")
    assert session.sweep(spark) == 1 == session.sweep(spark) + 1 and spark.read.parquet(f"{session.checkpoint_dir(spark)}/other").count() == 3
