import pytest
from pyspark.sql import functions as F

from terrashift.streaming import events as streams


@pytest.fixture()
def folder(spark, tmp_path):
    """Events in two files, two of them twice."""
    rows = [(k, f"2024-01-{1 + k % 9:02d} 0{k % 9}:00:00", k % 3, "click" if k % 2 else "view", 1.5 * k, "{}") for k in range(30)]
    names = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
    frame = spark.createDataFrame(rows, names).withColumn("ts", F.to_timestamp_ntz("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "a"))
    frame.where("event_id < 2").coalesce(1).write.parquet(str(tmp_path / "b"))
    out = tmp_path / "in"
    out.mkdir()
    for k, part in enumerate("ab"):
        next((tmp_path / part).glob("*.parquet")).rename(out / f"{k}.parquet")
    return str(out), rows


def test_each_event_counts_once(spark, folder):
    path, rows = folder
    got = streams.drain(streams.totals(streams.deduplicated(streams.event_stream(spark, path, "*.parquet"), "40 days")), "once")
    want = {t: (sum(r[3] == t for r in rows), sum(r[4] for r in rows if r[3] == t)) for t in ("click", "view")}
    assert {r.event_type: (r.n, r.total) for r in got.collect()} == want


def test_windows_and_sessions(spark, folder):
    path, rows = folder
    days = streams.drain(streams.tumbling(streams.event_stream(spark, path, "0.parquet")), "days")
    assert sum(r.n for r in days.collect()) == len(rows)
    spans = streams.drain(streams.sessions(streams.event_stream(spark, path, "0.parquet")), "spans", "append")
    assert all(r.end > r.start for r in spans.collect())


def test_running_spend_keeps_state(spark, folder):
    path, rows = folder
    got = streams.drain(streams.running_spend(streams.event_stream(spark, path, "0.parquet"), 60.0), "spend", "append").collect()
    assert len(got) == len(rows)
    for user in range(3):
        mine = [r for r in got if r.user_id == user]
        assert max(r.running for r in mine) == pytest.approx(sum(r[4] for r in rows if r[2] == user))
        assert all(r.within_cap == (r.running <= 60.0) for r in mine)
