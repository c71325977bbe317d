"""Rows that stand for several give what the several rows give."""

import numpy as np
import pytest


def test_rank_correlation_of_counted_rows(spark):
    from lexigauge.operators.ordering import rank_correlation

    rows = [("g", x % 4, (x * x) % 5) for x in range(40)]
    counts = {r: rows.count(r) for r in rows}
    whole = spark.createDataFrame(rows, "g string, x int, y int")
    cells = spark.createDataFrame([(*k, n) for k, n in counts.items()], "g string, x int, y int, m long")
    want, got = (rank_correlation(t, ["g"], "x", "y", *m).collect() for t, m in ((whole, []), (cells, ["m"])))
    assert len(counts) < len(rows) and got == want


def test_covers_count_rows(spark):
    """Of a tree that was fitted on cells the covers are those of all rows."""
    from lexigauge.operators.contributions import Tree, counted_covers

    tree = Tree([0, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 1.0, 3.0], [2.0, 1.0, 1.0], {})
    cells = spark.createDataFrame([([0.0], 30), ([1.0], 10)], "x array<double>, m long")
    (counted,) = counted_covers([tree], cells, "x", "m")
    assert counted.cover == [40.0, 30.0, 10.0]
    assert counted.expected() == pytest.approx(np.average([1.0, 3.0], weights=[30, 10]))


def test_places_and_deals(spark):
    """Places follow record_id and brand; a deal keeps the values of a group."""
    from lexigauge.operators.models import dealt, placed

    rows = [("a" if r % 3 else "b", r, b, float(r * 3 + i)) for r in (9, 2, 11, 4, 6) for i, b in enumerate(("x", "y", "z"))]
    table = spark.createDataFrame(rows, "category string, record_id long, brand string, v double")
    found = placed(table).collect()
    for g in ("a", "b"):
        own = sorted((r.record_id, r.brand) for r in found if r.category == g)
        assert {(r.record_id, r.brand): r.place for r in found if r.category == g} == {k: i for i, k in enumerate(own)}
    anew = dealt(table, ["v"], 3).collect()
    assert len(anew) == len(rows)
    for g in ("a", "b"):
        assert sorted(r.dealt.v for r in anew if r.category == g) == sorted(v for c, _, _, v in rows if c == g)
