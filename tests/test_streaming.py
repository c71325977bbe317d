"""Streams driven to their end over a few files."""

import json


def _write(folder, name, rows):
    (folder / name).write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))


def _rec(key, status, minute, attempt=1):
    return {"key": key, "model": key[0], "status": status, "at": f"2024-01-01T00:{minute:02d}:00", "attempt": attempt, "content": "x"}


def test_once_and_breaker(spark, tmp_path):
    from lexigauge.streaming.records import breakers, once, record_stream

    folder = tmp_path / "in"
    folder.mkdir()
    _write(folder, "a.json", [_rec("a1", "ok", 1), _rec("a2", "error", 2), "{broken\n", _rec("b1", "error", 3)])
    _write(folder, "b.json", [_rec("a2", "error", 2), _rec("a3", "error", 4), {"model": "a"}])
    rows = once(record_stream(spark, str(folder)))
    q = rows.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.table("once").collect()) == ["a1", "a2", "a3", "b1"]
    q = breakers(record_stream(spark, str(folder)), run=3).writeStream.format("memory").outputMode("update").queryName("breakers").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.model: (r.failures, r.open) for r in spark.table("breakers").collect()}
    assert last == {"a": (3, True), "b": (1, False)}


def test_breaker_does_not_depend_on_frames(spark, tmp_path):
    """One batch in frames of two rows: the run follows the records' order, not the order of the frames."""
    from lexigauge.streaming.records import breakers, record_stream

    folder = tmp_path / "in"
    folder.mkdir()
    times = [9, 3, 7, 1, 8, 2, 6, 5, 4]
    _write(folder, "a.json", [_rec(f"a{m}", "ok" if m == 4 else "error", m) for m in times])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        q = breakers(record_stream(spark, str(folder)), run=5).writeStream.format("memory").outputMode("update").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(key, before)
    assert [(r.failures, r.open) for r in spark.table("frames").collect()] == [(5, True)]


def test_status_counts(spark, tmp_path):
    """Records by status and ten minutes of event time, in whatever files they come."""
    from lexigauge.streaming.records import record_stream, status_counts

    folder = tmp_path / "in"
    folder.mkdir()
    _write(folder, "a.json", [_rec("a1", "ok", 1), _rec("a2", "error", 2), _rec("a3", "ok", 12)])
    _write(folder, "b.json", [_rec("b1", "ok", 9), _rec("b2", "ok", 19), {"model": "a"}])
    q = status_counts(record_stream(spark, str(folder), 1), "10 minutes", "1 hour").writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.minute, r.status, r.n) for r in spark.table("counts").collect()) == [(0, "error", 1), (0, "ok", 2), (10, "ok", 2)]


def test_no_large_dimension_is_crossed(spark):
    import pytest

    from lexigauge.operators.rates import small

    assert small(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError, match="crossed"):
        small(spark.range(11), 10)
