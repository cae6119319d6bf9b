"""Filters of keys: no key is missed, and a task needs one Python worker."""

import numpy as np

from graphloom.llm.id_filter import maybe_among, maybe_id


def plans_of(spark, monkeypatch, act):
    """The plans that ``act`` collects."""
    seen, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    act()
    return seen


def test_filters_take_one_python_worker_a_task(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "pairs")
    spark.range(5000).selectExpr("id * 8 as doc_id", "cast(id % 7 as int) as line").repartition(8).write.parquet(path)
    pairs = spark.read.parquet(path)
    found = {}
    plans = plans_of(spark, monkeypatch, lambda: found.update(pair=maybe_among(pairs), one=maybe_id(pairs.select("doc_id"))))
    assert len(plans) == 2
    for plan in plans:
        assert max(part.count("MapInArrow") for part in plan.split("Exchange")) == 1
    k = np.arange(5000)
    assert found["pair"](k * 8, (k % 7).astype(np.int32)).all() and found["one"](k * 8).all()
    assert found["pair"](k * 8, (k % 7 + 7).astype(np.int32)).mean() < 0.05 and found["one"](k * 8 + 1).mean() < 0.05
