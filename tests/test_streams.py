"""Running daily totals over restarts and stops, and trailing counts in a stream against the batch rule."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cardlens.operators.windows import velocity_count
from cardlens.streaming import jobs

SCHEMA = "event_time timestamp, mcc int, amount double"


class Stopped(Exception):
    pass


class Landing:
    """A folder of arriving rows, its running totals and what they should be."""

    def __init__(self, spark, folder):
        self.spark, self.want = spark, {}
        self.source, self.path, self.progress = (str(folder / n) for n in ("in", "out", "progress"))

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        for when, mcc, amount in rows:
            total, n = self.want.get((when.date(), mcc), (0.0, 0))
            self.want[when.date(), mcc] = (total + amount, n + 1)

    def run(self):
        jobs.daily_rollup_stream(self.spark.readStream.schema(SCHEMA).parquet(self.source), self.path, self.progress)

    def read(self):
        return {(r.transaction_date, r.mcc): (r.total_amount, r.transaction_count) for r in jobs.daily_rollup(self.spark, self.path).collect()}


def batch(step):
    """Sixty rows; some of each step are years late."""
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 4, float(i)) for i in range(step * 60, step * 60 + 58)]
    return rows + [(dt.datetime(2001, 5, 5, 1), 1, 2.0), (dt.datetime(2024, 1, 1), None, 1.0)]


def test_rollup_survives_restarts_and_compaction(spark, tmp_path):
    land = Landing(spark, tmp_path)
    for step in range(4):
        land.arrive(batch(step))
        land.run()
        assert land.read() == land.want
        if step in (1, 2):
            jobs.compact_rollup(spark, land.path)
            jobs.compact_rollup(spark, land.path)
            assert land.read() == land.want and len(jobs._manifests(spark, land.path)) == 1
    assert jobs.daily_rollup(spark, land.path).where(F.col("avg_amount").isNull()).count() == 0


def test_nothing_is_committed_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.daily_rollup(spark, str(tmp_path / "none"))
    jobs.compact_rollup(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("after", [False, True])
def test_stop_around_the_manifest_of_a_batch(spark, tmp_path, monkeypatch, after):
    """A stop between data and manifest, or after the manifest and before the stream notes its progress."""
    land, commit = Landing(spark, tmp_path), jobs._commit
    land.arrive(batch(0))
    land.run()
    first = dict(land.want)

    def stop(*args):
        if after:
            commit(*args)
        raise Stopped

    land.arrive(batch(1))
    monkeypatch.setattr(jobs, "_commit", stop)
    with pytest.raises(Exception, match="Stopped"):
        land.run()
    assert land.read() == (land.want if after else first)
    monkeypatch.setattr(jobs, "_commit", commit)
    if after:
        jobs.compact_rollup(spark, land.path)  # the batch that is run again is known from the base
    land.run()
    assert land.read() == land.want


@pytest.mark.parametrize("where", ["write", "manifest", "cleanup"])
def test_stop_in_compaction(spark, tmp_path, monkeypatch, where):
    land = Landing(spark, tmp_path)
    for step in range(2):
        land.arrive(batch(step))
        land.run()
    with monkeypatch.context() as m:
        if where == "write":      # a half-written base
            (tmp_path / "out" / "data" / "base-0-half").mkdir()
            (tmp_path / "out" / "data" / "base-0-half" / "part-0.parquet").write_bytes(b"PAR1")
            m.setattr(jobs, "_summed", lambda *a: (_ for _ in ()).throw(Stopped()))
        elif where == "manifest":
            m.setattr(jobs, "_commit", lambda *a: (_ for _ in ()).throw(Stopped()))
        else:
            calls = []
            m.setattr(jobs, "_delete", lambda s, p: calls.append(p) if not calls else (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            jobs.compact_rollup(spark, land.path)
    assert land.read() == land.want
    land.arrive(batch(2))
    land.run()
    assert land.read() == land.want
    jobs.compact_rollup(spark, land.path)
    assert land.read() == land.want
    assert len(list((tmp_path / "out" / "data").glob("[!.]*"))) == 1 and len(jobs._manifests(spark, land.path)) == 1


def test_trailing_counts_equal_the_batch_rule(spark, tmp_path):
    """Rows arrive in several batches, out of order within the watermark; a card is hot, one is NULL."""
    r = random.Random(8)
    begin = dt.datetime(2024, 3, 1)
    rows = [(begin + dt.timedelta(seconds=r.randint(0, 4 * 3600), milliseconds=r.randint(0, 999)), r.choice(["hot", "hot", "a", "b", None])) for _ in range(400)]
    rows.sort(key=lambda x: x[0] + dt.timedelta(seconds=r.randint(-240, 240)))
    schema = "event_time timestamp, card string"
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for step in range(4):
        spark.createDataFrame(rows[step * 100:(step + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        jobs.run_to_end(jobs.trailing_velocity_stream(events, 3, 1800), path, progress, keyed_state=True)
    closed = max(t for t, _ in rows) - dt.timedelta(minutes=10)
    df = spark.createDataFrame(rows, schema).withColumn("event_time", F.date_trunc("second", "event_time"))
    want = {(x.card, x.event_time, x.velocity_count) for x in velocity_count(df, "card", "event_time", 1800).where("velocity_count > 3").collect()
            if x.event_time.replace(second=0) + dt.timedelta(minutes=1) < closed}
    got = [(x.card, x.event_time, x.velocity_count) for x in spark.read.parquet(path).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({c for c, _, _ in want}) > 2


def progress_of(query, *names):
    """The largest value of each state figure over the batches of a run."""
    found = [op for p in query.recentProgress for op in p["stateOperators"]]
    return [max(int(op["customMetrics"].get(n, op.get(n, 0))) for op in found) for n in names]


@pytest.mark.parametrize("span,slide", [("1 hour", "5 minutes"), ("25 minutes", "10 minutes"), ("10 minutes", "10 minutes")])
def test_sliding_alerts_equal_the_batch_rule(spark, tmp_path, span, slide):
    """Rows arrive in several batches, out of order within the watermark; the watermark ends on the end of a window."""
    r = random.Random(5)
    begin = dt.datetime(2024, 3, 1)
    rows = [(begin + dt.timedelta(seconds=r.randint(0, 4 * 3600), milliseconds=r.randint(0, 999)), r.choice(["hot", "hot", "a", "b", None])) for _ in range(400)]
    rows.sort(key=lambda x: x[0] + dt.timedelta(seconds=r.randint(-240, 240)))
    rows += [(None, "a")] * 9 + [(begin + dt.timedelta(hours=5), "b")]
    schema = "event_time timestamp, card string"
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for step in range(4):
        spark.createDataFrame(rows[step * 103:(step + 1) * 103], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.run_to_end(jobs.velocity_alerts_stream(spark.readStream.schema(schema).parquet(source), 2, span, slide), path, progress, keyed_state=True)
    closed = begin + dt.timedelta(hours=5) - dt.timedelta(minutes=10)
    windows = spark.createDataFrame(rows, schema).groupBy(F.window("event_time", span, slide).alias("w"), "card").count().where("count > 2").collect()
    want = {(x.card, x.w.start, x.w.end, x["count"]) for x in windows if x.w.end <= closed}
    got = [tuple(x) for x in spark.read.parquet(path).select("card", "window_start", "window_end", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({c for c, *_ in want}) > 2


def test_late_rows_count_in_open_windows_only(spark, tmp_path):
    begin = dt.datetime(2024, 3, 1)
    at = lambda *minutes: [(begin + dt.timedelta(minutes=m), "c") for m in minutes]
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for batch in (at(1, 50), at(2, 41, 44), at(120)):  # after the first batch the watermark is at minute 40
        spark.createDataFrame(batch, "event_time timestamp, card string").coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema("event_time timestamp, card string").parquet(source)
        jobs.run_to_end(jobs.velocity_alerts_stream(events, 1, "30 minutes", "15 minutes"), path, progress, keyed_state=True)
    got = sorted(((x.window_start - begin).total_seconds() // 60, x.n) for x in spark.read.parquet(path).collect())
    assert got == [(15, 2), (30, 3)]


def test_state_does_not_grow_by_window_or_minute(spark, tmp_path):
    """A backlog of one row an hour for each of three cards: one list and one timer for a group of cards."""
    begin = dt.datetime(2024, 3, 1)
    rows = [(begin + dt.timedelta(hours=h), c) for h in range(200) for c in "abc"]
    spark.createDataFrame(rows, "event_time timestamp, card string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, alerts in (("sliding", jobs.velocity_alerts_stream), ("trailing", jobs.trailing_velocity_stream)):
        events = spark.readStream.schema("event_time timestamp, card string").parquet(str(tmp_path / "in"))
        query = jobs.run_to_end(alerts(events, 0), str(tmp_path / name), str(tmp_path / f"{name}-progress"), keyed_state=True)
        timers, kept = progress_of(query, "numRegisteredTimers", "numRowsTotal")
        assert 0 < timers <= 6 and kept <= 18
        assert spark.read.parquet(str(tmp_path / name)).count() > 500
