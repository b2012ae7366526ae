"""Composite reports and stored state, case by case."""

from murmura.operators import summaries as S


def test_daily(spark):
    audit = spark.createDataFrame([("2024-01-02 00:00:00", " b ", "x", "m"), ("2024-01-02 01:00:00", "a", "x", " "), ("2024-01-03 00:00:00", None, "x", "m"), ("2024-02-02 00:00:00", "a", "x", "m")], "create_time string, source string, creator_name string, message_info string").selectExpr("cast(create_time as timestamp) create_time", "source", "creator_name", "message_info")
    keys = spark.createDataFrame([("2024-01-02 00:00:00", "a", "100%"), ("2024-01-02 00:00:00", "", "k")], "create_time string, source string, key_words string").selectExpr("cast(create_time as timestamp) create_time", "source", "key_words")
    row = S.daily(audit, keys, "2024-01-01 00:00:00", "2024-01-03 00:00:00").first()
    assert row.plain == "统计区间：2024-01-01 00:00 ~ 2024-01-03 00:00\n达人问询数：3个人（a：2人，b：1人）\nAI回复次数：2次；\n关键词回复次数：2次（其中 【100%】触发：1人； 【k】触发：1人）\n"
    assert row.markdown.split("\n")[1] == "**达人问询数：** 3个人（a：2人，b：1人）"
    empty = S.daily(audit.limit(0), keys.limit(0), "2024-01-01 00:00:00", "2024-01-03 00:00:00").collect()
    assert len(empty) == 1 and "0个人（无）" in empty[0].plain and "0次（其中 无）" in empty[0].plain


def test_transcripts(spark):
    rows = [(2, " c ", 2, "[1] hi\n\n[SYSTEM] x\n[2] yo"), (1, "c", 1, '{"2": "two", "1": " one "}'), (3, "c", 3, "[2] yo\none\nnew"), (4, "d", 1, None), (5, None, 1, "z")]
    audit = spark.createDataFrame(rows, "id int, creator_name string, create_time int, message_info string")
    got = sorted((r.position, r.line) for r in S.transcripts(audit).where("creator = 'c'").collect())
    assert got == [(1, "one"), (2, "two"), (3, "[1] hi"), (4, "[2] yo"), (5, "new")]


def test_histories_in_chunks(spark):
    audit = spark.createDataFrame([(1, "c"), (2, "c "), (3, "x"), (4, None)], "id int, creator_name string")
    timeline = spark.createDataFrame([("c", i, f"t{i}") for i in range(1, 6)], "creator string, position long, text string")
    lines = spark.createDataFrame([("c", 1, "l")], "creator string, position long, line string")
    got = sorted(tuple(r) for r in S.with_histories(audit, timeline, lines, 2).collect())
    assert got == [(i, "c", p, n, t) for i in (1, 2) for p, n, t in (("chat", 0, "l"), ("history", 0, "t1\nt2"), ("history", 1, "t3\nt4"), ("history", 2, "t5"))]


def test_state(spark):
    schema = "creator_id string, shop string, tier string, progress array<string>, emotion string, sales double, conditions array<string>"
    asked = [("c", "s", "GEN", [], " ", None, None), ("c", "s", "A", ["p"], "calm", 1.0, ["x"]), ("c", "t", None, None, None, None, ["GEN"]), (None, "s", "GEN", [], "GEN", 2.0, []), (" ", "s", "GEN", [], "GEN", None, [])]
    state = spark.createDataFrame([(" c ", "s", "S-level", ["q"], "glad", 9.0, ["y"], True), ("", "s", "bad", ["bad"], "bad", 0.0, [], True)], schema + ", rejected boolean")
    got = [tuple(r) for r in S.with_state(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, " + schema), state).select("n", "tier", "progress", "emotion", "sales", "conditions", "rejected").orderBy("n").collect()]
    assert got == [(0, "S-level", ["q"], "glad", 9.0, ["y"], True), (1, "A", ["p"], "calm", 1.0, ["x"], True), (2, "GEN", [], "GEN", None, [], False), (3, "GEN", [], "GEN", 2.0, [], False), (4, "GEN", [], "GEN", None, [], False)]
