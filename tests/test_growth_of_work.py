"""What grows with rows is dealt out; what can be done once for rows that are alike is."""

import uuid

import pytest
from murmura.operators import common
from murmura.operators import conditions as C
from murmura.operators import knowledge as K
from murmura.operators import reports as R
from murmura.operators import routing as W
from murmura.operators import rules as L
from murmura.operators import slots as S
from murmura.plans import conditions, matching
from murmura.plans.replies import HEAD
from murmura.plans.slots import documents_of
from murmura.sources.requests import requests
from pyspark.sql import functions as F

from .conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_pairs_are_made_from_lists_of_ids(spark, monkeypatch, ids):
    for name, value in (("BROADCAST_IDS", ids), ("CONTEXT_LIST", 3), ("RULE_LIST", 2)):
        monkeypatch.setattr(common, name, value)
    copies = lambda df, key: df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(key, F.col(key) * 3 + F.col("k")).drop("k")
    rules, contexts = matching.rules_of(spark, DATA).where("rule_id < 60"), matching.contexts_of(spark, DATA).where("context_id < 60")
    shorter, once = L.match_rules(copies(rules, "rule_id"), copies(contexts, "context_id")), L.match_rules(rules, contexts)
    want = sorted((3 * c + i, 3 * r + j) for c, r in once.collect() for i in range(3) for j in range(3))
    assert sorted(map(tuple, shorter.collect())) == want != []
    firsts = {c: [r for x, r in want if x == c][:2] for c, _ in want}
    assert sorted(map(tuple, L.first_rules(copies(rules, "rule_id"), copies(contexts, "context_id"), 2).collect())) == sorted((c, r, i + 1) for c, rs in firsts.items() for i, r in enumerate(rs))
    rules, contexts = conditions.rules_of(spark, DATA).where("rule_id < 60"), conditions.contexts_of(spark, DATA).where("context_id < 60")
    once = C.match_conditions(rules, contexts, conditions.WORDS)
    want = sorted((3 * c + i, 3 * r + j) for c, r in once.collect() for i in range(3) for j in range(3))
    assert sorted(map(tuple, C.match_conditions(copies(rules, "rule_id"), copies(contexts, "context_id"), conditions.WORDS).collect())) == want != []


def test_one_file_is_many_tasks(spark):
    few = documents_of(spark, DATA).coalesce(1)
    assert S.candidates(few).rdd.getNumPartitions() > 1
    decided, open_ = W.by_gates(requests(spark, DATA).coalesce(1), HEAD, "north")
    assert decided.rdd.getNumPartitions() > 1 < open_.rdd.getNumPartitions()


def test_alike_scopes_ask_once(spark):
    tree = spark.createDataFrame([("A", "T1", "GEN", "x"), ("a", "gen", "s", "y"), ("gen", "gen", "gen", "x"), ("A", "t1", "S", "z"), ("b", "gen", "gen", "w")], "shop string, tier string, progress string, intent string")
    scopes = spark.createDataFrame([(1, "a", "t1", "s"), (2, "A", "T1", "S"), (3, "A", None, "s"), (4, "c", "t1", "s"), (5, "a", "t1", "q"), (5, "b", "t", None), (None, "b", "t", None), (6, None, "t1", "s")], "scope_id int, shop string, tier string, progress string")
    found = K.allowed_intents(tree, scopes)
    all_ = [("x", 1), ("y", 2), ("z", 0)]
    want = [(i, *p) for i in (1, 2) for p in all_] + [(3, "x", 4), (3, "y", 2), (5, "x", 1), (5, "w", 3), (None, "w", 3), (None, "x", 4)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert plan(found).count("keys=[scope_id") < plan(found).count("inline")  # rows of single scopes are not grouped


def test_numbering_moves_whole_rows_once(spark):
    rows = spark.range(2000).select((F.col("id") % 7).cast("string").alias("creator"), (F.col("id") * 37 % 101).alias("dt"), F.lit(1).alias("source_no"), F.col("id").cast("string").alias("text"))
    rows = rows.withColumn("creator", F.when(F.col("creator") != "3", F.col("creator"))).union(spark.range(3).selectExpr("'hot'", "id", "2", "'same'"))
    found = R.timeline(rows)
    assert not any("Exchange" in line and "text" in line for line in plan(found).splitlines())
    by_key = {}
    for r in found.collect():
        by_key.setdefault(r.creator, []).append((r.position, r.dt, r.source_no, r.text))
    assert len(by_key) == 8
    for each in by_key.values():
        each.sort()
        assert [e[0] for e in each] == list(range(1, len(each) + 1)) and [e[1:] for e in each] == sorted(e[1:] for e in each)


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_pairs_of_lists_are_short_and_hold_plain_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    own = lambda name, n: spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias(f"{name}_id"), F.lit("x").alias("signature"))
    found = common.spread(spark.createDataFrame([("x", "x")], "context_signature string, rule_signature string"), own("rule", 900), own("context", 300))
    made = plan(found)
    assert "inline" not in made and found.count() == 900 * 300
    assert found.distinct().count() == 900 * 300 and found.where("rule_id IS NULL").count() == 300 and found.where("context_id IS NULL").count() == 900
    lists = common._lists(own("rule", 9000), "rule", common.RULE_LIST)[1]
    assert lists.agg(F.max(F.size("rules"))).head()[0] * common.CONTEXT_LIST <= 1 << 16


def shuffled(spark, df):
    """Rows of df, and rows that its shuffles write when it is run."""
    context, group = spark.sparkContext, f"shuffled-{uuid.uuid4()}"
    context.setJobGroup(group, group)
    rows = df.count()
    context.setJobGroup("", "")
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
    found = [context._jsc.sc().statusStore().lastStageAttempt(s) for s in stages]
    return rows, sum(s.shuffleWriteRecords() for s in found)


def copies_of(df, key, n):
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(key, F.col(key) * n + F.col("k")).drop("k")


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_rule_match_pairs_of_lists_are_no_rows_of_a_shuffle(spark, monkeypatch, ids):
    for name, value in (("BROADCAST_IDS", ids), ("CONTEXT_LIST", 4), ("RULE_LIST", 4)):
        monkeypatch.setattr(common, name, value)
    rules, contexts = matching.rules_of(spark, DATA).where("rule_id < 60"), matching.contexts_of(spark, DATA).where("context_id < 60")
    once = L.match_rules(rules, contexts).count()
    (few, small), (many, large) = [shuffled(spark, L.match_rules(copies_of(rules, "rule_id", n), copies_of(contexts, "context_id", n))) for n in (60, 120)]
    assert few == 60 * 60 * once > 0 and many == 4 * few
    assert large < 3 * small and large < many / 16  # both sides doubled: four times the pairs, of ids and of lists


@pytest.mark.parametrize("rules,contexts", [(30, 4), (4, 30), (1, 1)])
@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_pairs_are_made_in_bounded_cells(spark, monkeypatch, ids, rules, contexts):
    for name, value in (("BROADCAST_IDS", ids), ("CONTEXT_LIST", 3), ("RULE_LIST", 5), ("GROUP_IDS", 50), ("CELL_PAIRS", (200, 200))):
        monkeypatch.setattr(common, name, value)
    own = lambda name, n, signatures: spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias(f"{name}_id"), F.concat(F.lit(name), F.col("id") % signatures).alias("signature"))
    pairs = [(f"context{c}", f"rule{r}") for c in range(contexts) for r in range(rules) if (c + r) % 3 < 2]
    found = common.spread(spark.createDataFrame(pairs, "context_signature string, rule_signature string"), own("rule", 400, rules), own("context", 300, contexts))
    assert "SortMergeJoin" in plan(found) and found.columns == ["context_id", "rule_id"]
    want = sorted((c or -1, r or -1) for c in range(300) for r in range(400) if (c % contexts + r % rules) % 3 < 2)
    assert sorted((-1 if c is None else c, -1 if r is None else r) for c, r in found.collect()) == want
    none = common.spread(spark.createDataFrame([], "context_signature string, rule_signature string"), own("rule", 4, rules), own("context", 3, contexts))
    assert none.count() == 0
