"""Stream queries over an events table of many files, in no order of time, must give the rows of the single-file table."""

import pytest
from compare import compare, oracle_connection

from lumenframe.plans import registry
from lumenframe.sources.tables import TABLES
import __spark_entry__  # noqa: F401  registers the plans

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scattered")
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(24, "event_id").write.parquet(f"{folder}/events.parquet")
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(f"{FOLDER}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["session_window", "count_window_drift_stream", "velocity_state", "tumbling_window", "dedup_stream", "late_data_policy", "stream_interval_join"])
def test_rows_do_not_depend_on_files(spark, scattered, name):
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # a split for each file
    try:
        plan = registry.PLANS[name]
        build = registry.callables()[name]
        assert compare(spark, oracle_connection(FOLDER), build, registry.oracles().get(name, plan.sql), scattered) == ""
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_write_makes_all_files_in_order(spark, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameWriter

    from lumenframe.plans import streams
    from lumenframe.sources.tables import Tables

    writes, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **k: (writes.append(path), real(self, path, **k))[1])
    monkeypatch.setattr(streams, "STRETCHES", 30)
    tables = Tables(spark, FOLDER)
    path = streams.event_files(tables, replay=True)
    assert len(writes) == 1
    seen = spark.read.parquet(path).select("ts", "event_id", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("changed"))
    files = seen.groupBy("name", "changed").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).orderBy("changed").collect()
    assert len(files) >= 25 and len({f.changed for f in files}) == len(files)
    assert all(x.b <= y.a or (x.a, x.b, x.n) == (y.a, y.b, y.n) for x, y in zip(files, files[1:]))
    assert sum(f.n for f in files) > tables.events.count() == seen.select("event_id").distinct().count()


def test_a_very_active_key(spark, tmp_path):
    """A hundred events a minute of one key, beside a quiet one: equal to the batch frames."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lumenframe.streaming import jobs

    n = 30_000
    e = spark.range(n + 50).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 600_000 + F.col("id") % 7).alias("ts"),
        F.when(F.col("id") % 9999 == 0, 2).otherwise(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 10).cast("double").alias("value"), F.lit("{}").alias("props"))
    staged, path = str(tmp_path / "staged"), str(tmp_path / "stream")
    e.repartitionByRange(6, "ts").write.parquet(staged)
    jobs.publish_in_order(spark, staged, path)
    got = jobs.with_rocksdb(spark, lambda: jobs.collect_stream(jobs.velocity(jobs.stream_source(spark, path, files_per_trigger=2)), "append"))
    us = F.unix_micros("ts")
    frame = lambda h: Window.partitionBy("user_id").orderBy(us).rangeBetween(-h * 3_600_000_000, 0)
    want = e.select("event_id", F.count("*").over(frame(1)).alias("a"), F.count("*").over(frame(24)).alias("b"), F.sum("value").over(frame(24)).alias("c"))
    both = got.join(want, "event_id")
    assert both.count() >= 0.95 * n
    assert both.where("n_1h <> a OR n_24h <> b OR abs(s_24h - c) > 1e-6").count() == 0


def test_sessions_over_in_the_last_hour_are_sent(spark, tmp_path):
    """All sessions that end before the last event count, also one that ended less than a millisecond before it."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from lumenframe.plans import streams

    at = [(1, 0), (1, 600_000_000), (2, 3_600_000_000), (1, 3_700_000_000), (2, 5_500_000_000 - 1), (3, 7_300_000_000)]
    rows = [(i, u, 1_704_067_200_000_000 + us) for i, (u, us) in enumerate(at)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, us long").select(
        "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    found = sorted((r.user_id, r.start[11:], r.n) for r in streams.session_window(SimpleNamespace(spark=spark, events=e)).collect())
    assert found == [(1, "00:00:00", 2), (1, "01:01:40", 1), (2, "01:00:00", 1), (2, "01:31:39", 1)]


class _Kept:
    """Map and value state of one key in memory, counting the calls."""

    def __init__(self):
        self.calls, self.entries, self.timers = 0, {}, []

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)

    def get(self):
        self.calls += 1
        return self.entries.get(None)

    def getValue(self, key):
        self.calls += 1
        return self.entries[key]

    def update(self, value):
        self.updateValue(None, value)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.entries[key]


def _steps(processor, steps):
    """Rows that a key's processor sends: each step brings a table and then moves the watermark to its last time."""
    import pandas as pd

    kept, out, mark = _Kept(), [], -1
    processor.init(kept)
    for rows in steps:
        cut = max(1, len(rows) // 2)
        processor.handleInputRows((7,), (rows[i : i + cut] for i in range(0, len(rows), cut)), None)
        mark = max(mark, int(rows["us"].max()) // 1000)
        while due := [t for t in kept.timers if t < mark]:
            kept.timers.remove(min(due))
            out += processor.handleExpiredTimer((7,), type("", (), {"getCurrentWatermarkInMs": lambda self: mark})(), None)
    return pd.concat(out), kept, mark * 1000


@pytest.mark.parametrize("chunk", [4, 50, 4096])
def test_velocity_of_rows_in_no_order(monkeypatch, chunk):
    """Chunks of any size, ties, rows out of order inside and between steps, missing values: the frames over all rows."""
    import numpy as np
    import pandas as pd

    from lumenframe.streaming import jobs

    monkeypatch.setattr(jobs._Velocity, "CHUNK", chunk)
    monkeypatch.setattr(jobs._Velocity, "TAKEN", 60)
    monkeypatch.setattr(jobs._Velocity, "READ", 2)
    r = np.random.default_rng(chunk)
    us = np.sort(r.integers(0, 4 * 1440, 700)) * 60_000_000 + 1_704_067_200_000_000
    e = pd.DataFrame({"us": us, "event_id": np.arange(700), "value": np.where(r.random(700) < 0.3, np.nan, r.integers(-9, 99, 700))})
    e.loc[(e["us"] // 3_600_000_000) % 48 >= 20, "value"] = np.nan
    steps = [e[i : i + 140].sample(frac=1, random_state=1) for i in range(0, 700, 140)]
    got, kept, upto = _steps(jobs._Velocity(), steps)
    want = []
    for t, i in zip(e["us"], e["event_id"]):
        frame = lambda back: e[(e["us"] >= t - back) & (e["us"] <= t)]["value"]  # noqa: B023, E731
        if t < upto:
            want.append((i, len(frame(3_600_000_000)), len(frame(86_400_000_000)), frame(86_400_000_000).sum(min_count=1)))
    assert [x[:3] for x in want] == list(got.sort_values("event_id")[["event_id", "n_1h", "n_24h"]].itertuples(index=False, name=None))
    np.testing.assert_allclose(got.sort_values("event_id")["s_24h"].to_numpy(float), [x[3] for x in want], atol=1e-9)
    assert any(np.isnan(x[3]) for x in want)
    assert len(kept.entries) <= 700 // chunk + 2


def test_velocity_calls_its_state_a_few_times_a_step(monkeypatch):
    """A quiet key's events, each in a minute of its own, come and go in a handful of calls."""
    import numpy as np
    import pandas as pd

    from lumenframe.streaming import jobs

    e = pd.DataFrame({"us": np.arange(400) * 7_300_000_000 + 1_704_067_200_000_000, "event_id": np.arange(400), "value": 1.0})
    got, kept, _ = _steps(jobs._Velocity(), [e[:200], e[200:]])
    assert len(got) == 399 and kept.calls < 20
