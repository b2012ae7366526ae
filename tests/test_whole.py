"""Queries over whole tables: no row is left out by its id."""

from murmura.plans import queries

from .conftest import DATA


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_histories_have_every_event(spark):
    rows = queries()["history_timeline_all"](spark, DATA).collect()
    by_source = [sum(r.source_no == n for r in rows) for n in range(1, 5)]
    lines = table(spark, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, "orders"), "o_orderkey").selectExpr("o_custkey % 37 c", "l_suppkey", "l_partkey", "o_orderdate", "l_returnflag", "l_linestatus").collect()
    assert by_source[0] == table(spark, "conversations").select("conv_id").distinct().count()
    assert by_source[1] == table(spark, "events").count()
    assert by_source[2] == len({(r.c, r.o_orderdate, r.l_suppkey, r.l_partkey) for r in lines if r.l_returnflag == "R"})
    assert by_source[3] == len({(r.c, r.l_suppkey) for r in lines if r.l_linestatus == "F"})
    texts = queries()["history_text_all"](spark, DATA).collect()
    assert sum(len(r.history.split("\n")) for r in texts) == len(rows)


def test_every_row_is_on_one_side(spark):
    newest = {}
    for e in table(spark, "events").select("event_id", "user_id", "event_type").collect():
        key = (e.event_id % 2, e.event_id)  # a change wins over the state
        newest[e.user_id] = max(newest.get(e.user_id, ((-1, -1), None)), (key, e.event_type))
    found = {r.user_id: r.event_type for r in queries()["state_upsert_all"](spark, DATA).collect()}
    assert found == {k: v for k, (_, v) in newest.items()}
    lines, parts = table(spark, "lineitem").collect(), table(spark, "part").collect()
    ops = {}
    for r in lines:
        ops.setdefault(f"p{r.l_partkey % 97}", set()).add({"A": "added", "R": "deleted"}.get(r.l_returnflag, "modified"))
    assert {r.path: r.ops for r in queries()["overlapping_changes_all"](spark, DATA).collect()} == {k: len(v) for k, v in ops.items() if len(v) > 1}
    chunked = {r.l_partkey for r in lines if r.l_quantity > 40}
    assert {r.stem for r in queries()["orphan_files_all"](spark, DATA).collect()} == {f"f{r.p_partkey}" for r in parts if r.p_partkey not in chunked}
    assert {r.value.lower() for r in queries()["vocab_merge_all"](spark, DATA).collect()} == {r.p_type.lower() for r in parts}
    owners = {r.o_orderkey: r.o_custkey % 37 for r in table(spark, "orders").collect()}
    shown = [owners[r.l_orderkey] for r in lines if r.l_orderkey in owners]
    rows = queries()["shop_rows_all"](spark, DATA).collect()
    assert rows and all(r.n == shown.count(int(r.creator_name.split("_")[1])) for r in rows)


def test_every_dimension_row_is_met(spark):
    known = {f"creator_{r.c_custkey}": str(r.c_acctbal) for r in table(spark, "customer").collect()}
    rows = queries()["showcase_enrich_all"](spark, DATA).collect()
    assert {r.user_name for r in rows if r.creator_gmv is None} == {r.user_name for r in rows} - known.keys()
    talked = {f"creator_{r.conv_id % 37}" for r in table(spark, "conversations").select("conv_id").collect()}
    assert {r.creator_name for r in queries()["missing_dim_all"](spark, DATA).collect()} == talked - known.keys()
    names = {r.p_partkey: r.p_name for r in table(spark, "part").collect()}
    rows = queries()["product_map_left_all"](spark, DATA).collect()
    assert rows and all(r["product"] == names.get(r.campaign_id, f"campaign {r.campaign_id}") for r in rows)
    rows = queries()["tap_video_join_all"](spark, DATA).collect()
    assert rows and all(r["product"] == names.get(r.product_id, str(r.product_id)) for r in rows)
