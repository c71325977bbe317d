"""What a query shuffles and holds does not grow faster than its tables."""

import re

import pytest

FOLDER = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_shuffled(spark):
    """Answers are crossed with the registry behind all exchanges by answer: nothing is dealt out by candidate."""
    from lexigauge.operators.panel import panel_filter, relative
    from lexigauge.sources import corpus as c

    for rows in (c.pairs(spark, FOLDER), relative(panel_filter(c.pairs(spark, FOLDER, sizes=True)), keep=("category", "query_id"))):
        text = plan(rows)
        assert "BroadcastNestedLoopJoin" in text
        assert "Exchange" not in text[: text.index("BroadcastNestedLoopJoin")]
        assert not re.search(r"hashpartitioning\(\S*record_id\S*, brand", text)


def test_tasks_grow_with_results(spark, monkeypatch):
    from lexigauge.sources import corpus as c

    wanted = c.results(spark, FOLDER)
    assert wanted.rdd.getNumPartitions() == 1
    rows = sorted(map(tuple, wanted.collect()))
    monkeypatch.setattr(c, "TASK_RESULTS", 500)
    many = c.results(spark, FOLDER)
    assert many.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, many.collect())) == rows


@pytest.mark.parametrize("name", ["brand_sources_topk", "brand_source_pages_topk"])
def test_answers_are_counted_where_their_results_lie(spark, monkeypatch, name):
    """Results are dealt out by answer once, to tasks of bounded size, and stay there until the answers are told apart."""
    from lexigauge.plans.catalogue import QUERIES
    from lexigauge.sources import corpus as c

    monkeypatch.setattr(c, "TASK_RESULTS", 500, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = re.findall(r"hashpartitioning\((l_orderkey|record_id)#\d+L, (\d+)\)", text)
    assert sorted(k for k, _ in dealt) == ["l_orderkey", "record_id"]  # the results, and the responses that join them
    assert len({n for _, n in dealt}) == 1 and int(dealt[0][1]) > 10
    assert not re.search(r"hashpartitioning\([^)]*brand#[^)]*record_id#", text)


def test_relative_keeps_repeated_answers_apart_from_each_other(spark):
    """A candidate row stays one row, also where an answer is there twice (a join with itself would make four)."""
    from lexigauge.operators.panel import relative

    rows = [(1, b, 0, n, int(n > 0), n, n, 4) for b, n in (("a", 1), ("b", 0), ("c", 2))] * 2
    table = spark.createDataFrame(rows, "record_id long, brand string, y_top long, n_results_mentioning long, in_search_results long, best_position long, n_official long, n_results long")
    assert relative(table, keep=("n_results",)).count() == 6


@pytest.mark.parametrize("ties", [False, True])
def test_rank_shares(spark, ties):
    from lexigauge.operators.panel import average_rank_share
    from pyspark.sql import functions as F

    values = [3, 1, 1, 2, 2, 2, None] if ties else [5, 3, 4, 1]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v int")
    key = [(v is not None, v) if v is not None else (False, 0) for v in values]
    want = {i: (sum(x < k for x in key) + (sum(x == k for x in key) + 1) / 2) / len(key) for i, k in enumerate(key)}
    assert {r.i: r.s for r in rows.select("i", average_rank_share(F.col("v"), ["g"]).alias("s")).collect()} == pytest.approx(want)
