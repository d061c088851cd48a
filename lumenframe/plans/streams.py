"""Streams over the events table, written as time-ordered files; each result must equal its batch form."""

from pyspark.sql import functions as F

from lumenframe.operators.scaling import attach_row
from lumenframe.plans.registry import plan
from lumenframe.session import scratch_path
from lumenframe.streaming import jobs

DELAY = "1 hour"  # files come in time order, so only rows of one trigger are out of order
STRETCHES, STRETCH_ROWS = 8, 2_000_000


def in_time_order(t, events, path, again=None):
    """Hands the rows over to a stream's folder as a producer would leave them: a file for each stretch of time, oldest first.

    One range partitioning by time and one write make all files, at least STRETCHES of about STRETCH_ROWS rows.
    """
    n = max(STRETCHES, -(-t.events.count() // STRETCH_ROWS))
    staged = scratch_path(t.spark, "events-by-time")
    events.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(staged)  # rows without a time come first
    return jobs.publish_in_order(t.spark, staged, path, again)


def event_files(t, replay=False):
    """All events in order of time; ``replay`` sends one stretch twice."""
    return in_time_order(t, t.events.withColumn("ts", F.col("ts").cast("timestamp")), scratch_path(t.spark, "events-stream"), 1 if replay else None)


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@plan("I01 I13", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_source(t):
    got = jobs.collect_stream(jobs.stream_source(t.spark, event_files(t)))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@plan("I02 I03 I14", "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(t):
    s = jobs.watermark(jobs.stream_source(t.spark, event_files(t)), "ts", DELAY)
    w = jobs.windowed(s, ["event_type"], "ts", "1 hour", aggs=[F.count("*").alias("n"), F.sum("value").alias("total")])
    return jobs.collect_stream(w, "update", ["event_type", "start"]).select("event_type", stamp("start").alias("start"), "n", F.round("total", 2).alias("total"))


@plan("I04", """SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS s FROM events) GROUP BY ALL""")
def sliding_window(t):
    s = jobs.watermark(jobs.stream_source(t.spark, event_files(t)), "ts", DELAY)
    w = jobs.windowed(s, ["user_id"], "ts", "24 hours", "6 hours", [F.count("*").alias("n")])
    return jobs.collect_stream(w, "update", ["user_id", "start"]).select("user_id", stamp("start").alias("start"), "n")


@plan("I05 O01", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g), f AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM s GROUP BY user_id, sid)
  SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n FROM f WHERE e < (SELECT max(ts) FROM events)""")
def session_window(t):
    """All sessions that are over when the last event comes. A row far behind it ends the stream, so that the delay and the watermark's whole milliseconds hold none of them back."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    end = e.agg(F.max("ts").alias("_end"))
    last = end.where("_end IS NOT NULL").select((F.col("_end") + F.expr(f"interval {DELAY}") + F.expr("interval 1 hour")).alias("ts"))
    path = in_time_order(t, e.unionByName(last, allowMissingColumns=True), scratch_path(t.spark, "events-stream"))
    s = jobs.watermark(jobs.stream_source(t.spark, path), "ts", DELAY)
    w = jobs.sessions(s, ["user_id"], "ts", "30 minutes", [F.count("*").alias("n")])
    over = attach_row(jobs.collect_stream(w, "append"), end).where(F.col("end") < F.col("_end"))
    return over.select("user_id", stamp("start").alias("start"), "n")


@plan("I06 E06", """SELECT event_id, count(*) OVER h AS n_1h, count(*) OVER d AS n_24h, round(sum(value) OVER d, 2) AS s_24h FROM events WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) QUALIFY ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def velocity_state(t):
    def run():
        return jobs.collect_stream(jobs.velocity(jobs.stream_source(t.spark, event_files(t), files_per_trigger=16)), "append")

    got = jobs.with_rocksdb(t.spark, run)
    # the last moments wait for the watermark; compare up to one hour before the end
    end = t.events.agg(F.max("ts")).first()[0]
    done = t.events.where(F.col("ts") < F.lit(end) - F.expr("interval 1 hour")).select("event_id")
    return got.join(done, "event_id", "left_semi").select("event_id", "n_1h", "n_24h", F.round("s_24h", 2).alias("s_24h"))


@plan("I07", """WITH c AS (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS cut FROM events) SELECT 'main' AS side, count(*) FILTER (WHERE event_id % 50 <> 0) AS n FROM events
  UNION ALL SELECT 'late', count(*) FILTER (WHERE event_id % 50 = 0) FROM events, c WHERE ts < cut UNION ALL SELECT 'dropped', count(*) FILTER (WHERE event_id % 50 = 0) FROM events, c WHERE ts < cut""")
def late_data_policy(t):
    """Every 50th event of the first quarter of the time arrives at the end; other 50ths never come."""
    path = scratch_path(t.spark, "late-stream")
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    held_back = F.col("event_id") % 50 == 0
    in_time_order(t, e.where(~held_back), path)
    early = F.unix_micros("ts") < span["a"] + (span["b"] - span["a"]) // 4
    e.where(held_back & early).repartitionByRange("ts").write.mode("append").parquet(path)
    split = jobs.LateSplit(t.spark, "ts", "1 day")
    jobs.run_to_end(jobs.stream_source(t.spark, path), split, scratch_path(t.spark, "late-state"))
    s = jobs.watermark(jobs.stream_source(t.spark, path), "ts", "1 day")
    w = jobs.windowed(s, ["event_id"], "ts", "1 second", aggs=[F.count("*").alias("n")])
    q = jobs.run_to_end(w, jobs.batch_sink(scratch_path(t.spark, "late-out")), scratch_path(t.spark, "late-state"), "append")
    dropped = jobs.progress_rows(q, t.spark).agg(F.lit("dropped").alias("side"), F.sum("dropped_rows").alias("n"))
    sides = [split.read(x).agg(F.lit(x).alias("side"), F.count("*").alias("n")) for x in ("main", "late")]
    return sides[0].unionByName(sides[1]).unionByName(dropped)


@plan("I08", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def dedup_stream(t):
    s = jobs.dedup_stream(jobs.stream_source(t.spark, event_files(t, replay=True)), ["event_id"], "ts", DELAY)
    return jobs.collect_stream(s).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@plan("I09", "SELECT c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
def stream_static_join(t):
    dim = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return jobs.collect_stream(jobs.enrich(jobs.stream_source(t.spark, event_files(t)), dim, "user_id")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@plan("I10", """SELECT v.user_id, count(*) AS pairs, count(DISTINCT p.event_id) AS purchases FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR GROUP BY 1""")
def stream_interval_join(t):
    path = event_files(t)
    view = jobs.stream_source(t.spark, path).where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("v_ts"))
    buy = jobs.stream_source(t.spark, path).where(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("p_ts"), "event_id")
    got = jobs.collect_stream(jobs.interval_join(view, buy, "user_id", "v_ts", "p_ts", "6 hours", DELAY))
    return got.groupBy(F.col("l_user_id").alias("user_id")).agg(F.count("*").alias("pairs"), F.count_distinct("event_id").alias("purchases"))


WINDOWS = """w AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS win, value FROM events) SELECT win, round(avg(value), 6) AS mean, round(abs(avg(value) - 10) / (5 + 1e-8), 6) AS z, abs(avg(value) - 10) / (5 + 1e-8) > 3 AS drift FROM w GROUP BY win HAVING count(*) = 1000"""


@plan("I11", "WITH " + WINDOWS)
def count_window_drift(t):
    a = jobs.window_alarms(jobs.count_windows(t.events, ["ts", "event_id"], "value"), 10, 5, 1000)
    return a.select("win", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"), "drift")


@plan("I11", "WITH " + WINDOWS)
def count_window_drift_stream(t):
    sink = jobs.CountWindowDrift(t.spark, "value", ["ts", "event_id"])
    jobs.run_to_end(jobs.stream_source(t.spark, event_files(t), files_per_trigger=1), sink, scratch_path(t.spark, "state"))
    a = sink.alarms(10, 5)
    return a.select("win", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"), "drift")


@plan("I12", "SELECT user_id, event_id, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_sink(t):
    sink = jobs.UpsertSink(t.spark, ["user_id"], "pos")
    s = jobs.stream_source(t.spark, event_files(t, replay=True)).withColumn("pos", F.struct("ts", "event_id"))
    jobs.run_to_end(s, sink, scratch_path(t.spark, "state"))
    return sink.read().select("user_id", "event_id", F.round("value", 2).alias("value"))


@plan("I14", "SELECT 2 AS runs, count(*) AS n, round(sum(value), 2) AS total FROM events")
def kappa_replay(t):
    """Two runs from the start with fresh state give the same table."""
    path = event_files(t)
    runs = [jobs.collect_stream(jobs.stream_source(t.spark, path)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")) for _ in range(2)]
    return runs[0].unionByName(runs[1]).groupBy("n", "total").agg(F.count("*").cast("int").alias("runs"))


@plan("I15", "SELECT sum(1)::BIGINT AS rows, count_if(value > 20)::BIGINT AS large, 0::BIGINT AS nulls FROM events")
def stream_quality_metrics(t):
    s = jobs.observed(jobs.stream_source(t.spark, event_files(t)), "quality", [
        F.count("*").alias("rows"), F.count_if(F.col("value") > 20).alias("large"), F.count_if(F.col("user_id").isNull()).alias("nulls")])
    q = jobs.run_to_end(s, jobs.batch_sink(scratch_path(t.spark, "out")), scratch_path(t.spark, "state"))
    p = jobs.progress_rows(q, t.spark, "quality")
    got = p.select(F.from_json("observed", "rows bigint, large bigint, nulls bigint").alias("m")).where("m is not null")
    return got.agg(F.sum("m.rows").alias("rows"), F.sum("m.large").alias("large"), F.sum("m.nulls").alias("nulls"))


@plan("I16", """WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts), INTERVAL 30 MINUTE)) AS s, event_type FROM events), g AS (SELECT s, count(*) AS n, count_if(event_type = 'error') AS e FROM w GROUP BY s)
  SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, round(e / n, 6) AS rate, CASE WHEN e / n > 0.05 THEN 'page' WHEN e / n > 0.01 THEN 'warn' ELSE 'ok' END AS alert FROM g""")
def rolling_error_rate(t):
    s = jobs.watermark(jobs.stream_source(t.spark, event_files(t)), "ts", DELAY)
    w = jobs.windowed(s, [], "ts", "1 hour", "30 minutes", [F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")])
    a = jobs.error_alerts(jobs.collect_stream(w, "update", ["start"]))
    return a.select(stamp("start").alias("start"), F.round("rate", 6).alias("rate"), "alert")


@plan("I17", "SELECT round((epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 3.6e9, 6) AS hours, CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 3.6e9 > 24 THEN 'error' WHEN (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 3.6e9 > 12 THEN 'warn' ELSE 'pass' END AS status FROM events")
def source_freshness(t):
    return jobs.source_freshness(t.events, "ts", "2024-01-31 12:00:00").select(F.round("hours", 6).alias("hours"), "status")


@plan("I18", "SELECT count(*)::BIGINT AS input_rows, 0::BIGINT AS last_lag FROM events")
def consumer_lag(t):
    q = jobs.run_to_end(jobs.stream_source(t.spark, event_files(t)), jobs.batch_sink(scratch_path(t.spark, "out")), scratch_path(t.spark, "state"))
    lag = jobs.consumer_lag(jobs.progress_rows(q, t.spark))
    return lag.agg(F.sum("input_rows").alias("input_rows"), F.max_by("lag", "batch").alias("last_lag"))
