"""Structured Streaming jobs: sources, windows, keyed state, sinks, run metrics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenframe.operators.scaling import ranked, top_per_group
from lumenframe.session import scratch_path
from lumenframe.sources.keyed_table import FILE_ROWS, KeyedTable

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_source(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 2) -> DataFrame:
    """Append-only file stream; with a broker only the format and options change."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def publish_in_order(spark: SparkSession, staged: str, path: str, again: int | None = None) -> str:
    """Hands the part files of ``staged`` over to the folder of a stream, in the order of their numbers; the ``again``-th is sent twice.

    A file stream takes files by the time of their last change, so each gets a time a second after the one before; a store that keeps no such
    times gives them the time of the move, which has the same order.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path
    files = place(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(place(staged)) if f.getPath().getName().startswith("part-"))
    files.mkdirs(place(path))
    sent = list(names)
    if again is not None and again < len(names):
        copied = place(staged, "again-" + names[again])
        jvm.org.apache.hadoop.fs.FileUtil.copy(files, place(staged, names[again]), files, copied, False, spark._jsc.hadoopConfiguration())
        sent.insert(again + 1, copied.getName())
    first = int(time.time() * 1000) - 1000 * len(sent)
    for k, name in enumerate(sent):
        files.rename(place(staged, name), place(path, name))
        files.setTimes(place(path, name), first + 1000 * k, -1)
    return path


def kafka_options(servers: str, topic: str, from_start: bool) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if from_start else "latest"}


def parse_json_values(raw: DataFrame, schema: str) -> DataFrame:
    """Key-value records of a topic with a JSON value."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def watermark(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay)


def windowed(stream: DataFrame, keys: Sequence[str], ts: str, length: str, slide: str | None = None, aggs: Sequence[Column] = ()) -> DataFrame:
    """Tumbling, or sliding if ``slide`` is given."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.groupBy(*keys, w.alias("w")).agg(*aggs).withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).drop("w")


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, aggs: Sequence[Column]) -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.groupBy(*keys, w.alias("w")).agg(*aggs).withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).drop("w")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Process what is there and stop (``availableNow``), or keep going in micro-batches of ``every``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    if every:
        return writer.trigger(processingTime=every).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch id: a replayed batch replaces its own output."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def collect_stream(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run to the end into a new folder and read it back; with ``keys`` the newest batch wins per key."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    q = run_to_end(stream, batch_sink(out), scratch_path(spark, "stream-state"), mode)
    if q.exception():
        raise q.exception()
    got = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return top_per_group(got, keys, ["-batch"], 1).drop("batch") if keys else got.drop("batch")


class UpsertSink:
    """Latest value per key in a keyed table. A batch is merged under its id, so a replay changes nothing, and rewrites only the files that hold its keys."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], order: str, file_rows: int = FILE_ROWS):
        self.table, self.order = KeyedTable(spark, scratch_path(spark, "upsert"), keys, file_rows=file_rows), order

    def __call__(self, df: DataFrame, batch: int) -> None:
        self.table.merge(df, ["-" + self.order], against_target=True, tag=batch)

    def read(self) -> DataFrame:
        return self.table.read()


class LateSplit:
    """Rows older than the high-water mark of earlier batches minus the delay go to a side output."""

    def __init__(self, spark: SparkSession, ts: str, delay: str):
        self.spark, self.ts, self.delay = spark, ts, delay
        self.main, self.late, self.marks = (scratch_path(spark, n) for n in ("on-time", "late", "marks"))

    def __call__(self, df: DataFrame, batch: int) -> None:
        schema = "high timestamp, n bigint"
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.marks}/batch=-1")
        marks = self.spark.read.option("basePath", self.marks).schema(schema + ", batch int").parquet(f"{self.marks}/batch=*")
        high = marks.where(F.col("batch") < batch).agg((F.max("high") - F.expr(f"interval {self.delay}")).alias("h")).first()["h"]
        late = F.lit(False) if high is None else F.col(self.ts) < F.lit(high)
        df.where(~late).write.mode("overwrite").parquet(f"{self.main}/batch={batch}")
        df.where(late).write.mode("overwrite").parquet(f"{self.late}/batch={batch}")
        df.agg(F.max(self.ts).alias("high"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.marks}/batch={batch}")

    def read(self, side: str) -> DataFrame:
        path = self.main if side == "main" else self.late
        return self.spark.read.option("basePath", path).parquet(f"{path}/batch=*")


class CountWindowDrift:
    """Every ``size`` rows in arrival order: per-window sums, stored per batch, so that a window may span batches."""

    def __init__(self, spark: SparkSession, value: str, order: Sequence[str], size: int = 1000):
        self.spark, self.value, self.order, self.size = spark, value, list(order), size
        self.path = scratch_path(spark, "count-windows")

    SCHEMA = "win bigint, n bigint, s double"

    def __call__(self, df: DataFrame, batch: int) -> None:
        done = self._read().where(F.col("batch") < batch).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] if batch else 0
        numbered = ranked(df, [], self.order, {"_rn": "row_number"})
        win = F.floor((F.col("_rn") - 1 + F.lit(done)) / self.size).alias("win")
        numbered.groupBy(win).agg(F.count("*").alias("n"), F.sum(self.value).alias("s")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).schema(self.SCHEMA + ", batch int").parquet(f"{self.path}/batch=*")

    def alarms(self, mean: float, sd: float) -> DataFrame:
        return window_alarms(self._read().groupBy("win").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), mean, sd, self.size)


def window_alarms(sums: DataFrame, mean: float, sd: float, size: int, limit: float = 3) -> DataFrame:
    """Full windows with their z distance from the reference."""
    z = F.abs(F.col("s") / F.col("n") - F.lit(mean)) / F.lit(sd + 1e-8)
    return sums.where(F.col("n") == size).select("win", (F.col("s") / F.col("n")).alias("mean"), z.alias("z"), (z > limit).alias("drift"))


def count_windows(df: DataFrame, order: Sequence[str], value: str, size: int = 1000) -> DataFrame:
    """Batch twin of ``CountWindowDrift``."""
    win = F.floor((F.col("_rn") - 1) / size).alias("win")
    return ranked(df, [], order, {"_rn": "row_number"}).groupBy(win).agg(F.count("*").alias("n"), F.sum(value).alias("s"))


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str) -> DataFrame:
    """Right rows of the same key no later than ``within`` after the left row."""
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay)
    cond = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return a.withColumnRenamed(key, f"l_{key}").join(b.withColumnRenamed(key, f"r_{key}"), cond)


class _Held:
    """What a key keeps in its value state: a table of the full chunks, the newest rows themselves, and how far rows were sent."""

    SCHEMA = ("chunk array<bigint>, last array<bigint>, n array<bigint>, s array<double>, known array<bigint>, us array<bigint>, ids array<bigint>, vals array<double>, "
              "fresh bigint, sent bigint, timer bigint")

    def __init__(self, found: tuple | None):
        chunk, last, n, s, known, us, ids, vals, self.fresh, self.sent, self.timer = found or ([], [], [], [], [], [], [], [], 0, -(1 << 62), None)
        self.chunks = list(zip(chunk, last, n, s, known))
        self.tail = (np.array(us, np.int64), np.array(ids, np.int64), np.array(vals, np.float64))

    def record(self) -> tuple:
        return (*([c[i] for c in self.chunks] for i in range(5)), *(x.tolist() for x in self.tail), self.fresh, self.sent, self.timer)


class _Velocity(StatefulProcessor):
    """Trailing counts and sums of a key's events, sent once the watermark has passed an event.

    A key's rows are held in order of time. The newest, fewer than CHUNK, lie in its value state, so a quiet key costs one read and one write a step; older ones are cut into chunks of CHUNK rows, each
    an entry of a map state, and the value state has every chunk's last time, count and sum. Whole chunks of a frame are added up from those; only the chunks in which an event and the edges of its
    frames lie are read, however long the day is. Rows that come out of order rewrite the chunks they fall into. Chunks that no later frame reaches are removed. A key has one timer,
    for its first event not yet sent; it sends everything the watermark has passed and sets the next.
    """

    HOUR, DAY, CHUNK, TAKEN, READ = 3_600_000_000, 86_400_000_000, 4096, 2_000_000, 16

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "chunk bigint", "us array<bigint>, ids array<bigint>, vals array<double>")
        self.held = handle.getValueState("held", _Held.SCHEMA)

    @staticmethod
    def _in_order(*parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        whole = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(whole[0], kind="stable")
        return tuple(x[order] for x in whole)

    def _chunk(self, number: int) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, kind) for x, kind in zip(self.rows.getValue((number,)), (np.int64, np.int64, np.float64)))

    def _put(self, held: _Held, rows: tuple[np.ndarray, ...]) -> tuple:
        number, held.fresh = held.fresh, held.fresh + 1
        self.rows.updateValue((number,), tuple(x.tolist() for x in rows))
        return number, int(rows[0][-1]), len(rows[0]), float(np.nansum(rows[2])), int((~np.isnan(rows[2])).sum())

    def _take(self, held: _Held, rows: tuple[np.ndarray, ...]) -> None:
        """Puts rows in their places: those before the end of a chunk into it, the others to the newest."""
        rows = self._in_order(rows)
        chunks = []
        for chunk in held.chunks:
            before = np.searchsorted(rows[0], chunk[1])
            if not before:
                chunks.append(chunk)
                continue
            merged = self._in_order(self._chunk(chunk[0]), tuple(x[:before] for x in rows))
            rows = tuple(x[before:] for x in rows)
            self.rows.removeKey((chunk[0],))
            parts = max(1, len(merged[0]) // self.CHUNK)
            chunks += [self._put(held, part) for part in zip(*(np.array_split(x, parts) for x in merged))]
        tail = self._in_order(held.tail, rows)
        while len(tail[0]) >= self.CHUNK:
            chunks.append(self._put(held, tuple(x[: self.CHUNK] for x in tail)))
            tail = tuple(x[self.CHUNK :] for x in tail)
        held.chunks, held.tail = chunks, tail

    def _wait(self, held: _Held, us: int) -> None:
        """A timer for the moment after an event."""
        held.timer = int(us) // 1000 + 1
        self.handle.registerTimer(held.timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, waiting, n, first = _Held(self.held.get()), [], 0, None
        for pdf in rows:
            waiting.append((pdf["us"].to_numpy(np.int64), pdf["event_id"].to_numpy(np.int64), pdf["value"].to_numpy(np.float64)))
            if not len(pdf):
                continue
            n, low = n + len(pdf), waiting[-1][0].min()
            first = low if first is None else min(first, low)
            if n >= self.TAKEN:
                self._take(held, self._in_order(*waiting))
                waiting, n = [], 0
        if n:
            self._take(held, self._in_order(*waiting))
        if first is not None and (held.timer is None or int(first) // 1000 + 1 < held.timer):
            self._wait(held, first)
        self.held.update(held.record())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, held = timerValues.getCurrentWatermarkInMs() * 1000, _Held(self.held.get())
        if held.sent >= upto:
            return
        sizes = [*held.chunks, (None, held.tail[0][-1] if len(held.tail[0]) else np.iinfo(np.int64).max, 0, 0.0, 0)]
        last = np.array([c[1] for c in sizes], np.int64)
        before = [np.concatenate([[0], np.cumsum([c[i] for c in sizes])]) for i in (2, 3, 4)]  # rows, sum and known values ahead of a chunk
        read = {}

        def chunk(at: int) -> tuple:
            """Rows of a chunk, and the running sum and count of its known values."""
            if at not in read:
                us, ids, vals = held.tail if at == len(held.chunks) else self._chunk(held.chunks[at][0])
                if len(read) >= self.READ:
                    del read[next(iter(read))]
                read[at] = us, ids, np.concatenate([[0.0], np.cumsum(np.nan_to_num(vals, nan=0.0))]), np.concatenate([[0], np.cumsum(~np.isnan(vals))])
            read[at] = read.pop(at)  # the longest unused goes first
            return read[at]

        def ahead(us: np.ndarray, side: str) -> list[np.ndarray]:
            """Rows, sum and known values of all held rows ahead of each of these times."""
            place = np.minimum(np.searchsorted(last, us, side), len(held.chunks))
            out = [x[place] for x in before]
            for at in np.unique(place).tolist():
                mine = place == at
                times, _, total, known = chunk(at)
                row = np.searchsorted(times, us[mine], side)
                for x, more in zip(out, (row, total[row], known[row])):
                    x[mine] += more
            return out

        for at in range(int(np.searchsorted(last, held.sent)), len(sizes)):
            us, ids, _, _ = chunk(at)
            a, b = np.searchsorted(us, [held.sent, upto])
            if a < b:
                own, total, known = ahead(us[a:b], "right")
                hour, (day, less, unknown) = ahead(us[a:b] - self.HOUR, "left")[0], ahead(us[a:b] - self.DAY, "left")
                user = pd.array([key[0]] * (b - a), "Int64")
                yield pd.DataFrame({"user_id": user, "event_id": ids[a:b], "n_1h": own - hour, "n_24h": own - day, "s_24h": np.where(known > unknown, total - less, np.nan)})
            if b < len(us):
                self._wait(held, us[b])
                break
        else:
            held.timer = None
        old = upto - self.DAY
        for c in held.chunks:
            if c[1] < old:
                self.rows.removeKey((c[0],))
        held.chunks = [c for c in held.chunks if c[1] >= old]
        held.tail = tuple(x[held.tail[0] >= old] for x in held.tail)
        held.sent = int(upto)
        self.held.update(held.record())

    def close(self) -> None:
        pass


def velocity(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Exact trailing 1 h and 24 h counts and sums per event of a key, in event time; rows without a time are in no frame."""
    timed = stream.where(F.col("ts").isNotNull()).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Velocity(), outputStructType="user_id bigint, event_id bigint, n_1h bigint, n_24h bigint, s_24h double",
        outputMode="append", timeMode="EventTime")


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Keyed state with timers needs the RocksDB store; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def observed(stream: DataFrame, name: str, metrics: Sequence[Column]) -> DataFrame:
    """Named per-batch metrics, readable from the query's progress."""
    return stream.observe(name, *metrics)


def progress_rows(query: StreamingQuery, spark: SparkSession, name: str | None = None) -> DataFrame:
    """One row per batch: input rows, dropped late rows, source offsets, observed metrics as JSON."""
    rows = []
    for p in query.recentProgress:
        d = json.loads(p.json) if hasattr(p, "json") else p
        src = d["sources"][0]
        dropped = sum(s.get("numRowsDroppedByWatermark", 0) for s in d.get("stateOperators", []))
        seen = d.get("observedMetrics", {}).get(name) if name else None
        rows.append((d["batchId"], d["numInputRows"], dropped, json.dumps(src.get("startOffset")), json.dumps(src.get("endOffset")),
                     json.dumps(src.get("latestOffset")), json.dumps(seen)))
    return spark.createDataFrame(rows, "batch bigint, input_rows bigint, dropped_rows bigint, start_offset string, end_offset string, latest_offset string, observed string")


def consumer_lag(progress: DataFrame) -> DataFrame:
    """Files (or records) the query is behind after each batch."""
    at = lambda c: F.get_json_object(c, "$.logOffset").cast("bigint")
    return progress.select("batch", "input_rows", F.greatest(F.coalesce(at("latest_offset"), at("end_offset")) - at("end_offset"), F.lit(0)).alias("lag"))


def source_freshness(df: DataFrame, ts: str, as_of: str, warn_hours: float = 12, error_hours: float = 24) -> DataFrame:
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / 3.6e9
    return df.agg(hours.alias("hours")).withColumn(
        "status", F.when(F.col("hours") > error_hours, "error").when(F.col("hours") > warn_hours, "warn").otherwise("pass"))


def error_alerts(windows: DataFrame, warn: float = 0.01, page: float = 0.05) -> DataFrame:
    rate = F.col("errors") / F.col("n")
    return windows.withColumn("rate", rate).withColumn("alert", F.when(rate > page, "page").when(rate > warn, "warn").otherwise("ok"))


def enrich(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Stream rows with the columns of a static table."""
    return stream.join(dim, key, "left")
