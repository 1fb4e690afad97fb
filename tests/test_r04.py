"""Findings of round 4."""

from pulsegrid.llm import common


def test_a_worker_keeps_one_thing_of_one_stage(monkeypatch):
    """encoder and bit map of a stage went on taking memory in workers that ran the stages behind it."""
    stage = [0]

    class Task:
        def stageId(self):
            return stage[0]

    monkeypatch.setattr(common.TaskContext, "get", lambda: Task())
    made = []
    make = lambda x: lambda: made.append(x) or x
    common._KEPT.clear()
    for _ in range(2):
        common.let_go()
        assert common.kept("a", make(1)) == 1
    assert made == [1] and list(common._KEPT) == ["a"]
    assert common.kept("b", make(2)) == 2 and list(common._KEPT) == ["b"]
    stage[0] = 1
    common.let_go()
    assert not common._KEPT


def test_bit_map_stays_in_slices(spark):
    """the driver neither opens nor joins what the tasks have compressed."""
    import numpy as np

    bits = common.bit_map(spark.createDataFrame([(5,), (common.BITS - 1,), (None,)], "h long").where("h is not null"))
    assert len(bits) == common.SLICES and [k for k, x in enumerate(bits) if x] == [0, common.SLICES - 1]
    whole = common.joined(bits, common.BITS // 8 // common.SLICES)
    assert common.among(whole, np.array([5, 6, common.BITS - 1])).tolist() == [True, False, True]


def test_sparse_distribution_keeps_every_probability(spark, small):
    """objects of a probability up to 0.25 were left out."""
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{small}/lineitem.parquet'")
    want = sorted(con.execute(e.oracle_sql()["sparse_distribution"]).fetchall())
    got = sorted(tuple(r) for r in e.queries()["sparse_distribution"](spark, small).collect())
    assert got == want
    assert any(0 < p <= 0.25 and obj for _, _, obj, p in got)
    assert len(got) == sum(p > 0 or o == 0 for _, _, o, p in con.execute(e.oracle_sql()["target_probs"]).fetchall())


def test_quality_reports_follow_time_where_ids_do_not(spark, small, tmp_path):
    """with copies of the same times under later ids the stream reported in order of ids."""
    import duckdb
    import math

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id + k * 5 AS user_id, event_type, value, props FROM '{small}/events.parquet', (SELECT unnest([0, 1]) AS k) ORDER BY 1) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {r[:3]: r[3:] for r in con.execute(e.oracle_sql()["stream_quality"]).fetchall()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in e.queries()["stream_quality"](spark, str(tmp_path)).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=2e-5) for k in want for a, b in zip(got[k], want[k], strict=True))
