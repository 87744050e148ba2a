"""Queries on windows, lags, splits and time reduction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvial.common import shared_path
from fluvial.operators import history, skill, splits, windows
from fluvial.plans import views as V
from fluvial.plans.registry import query, rounded
from fluvial.streaming import daily

FILLED_SQL = f"{V.DENSE_SQL}, filled AS (SELECT cell, date, coalesce(value, 0) AS value FROM dense)"


def _filled(spark, sf):
    return V.dense(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))


LAGS = (0, 1, 2, 3, 7, 14)


@query(f"WITH {FILLED_SQL} SELECT cell, date, round(value, 6) AS value, " + ", ".join(f"round(coalesce(lag(value, {k}) OVER w, 0), 6) AS value_lag{k}" for k in LAGS) + " FROM filled WINDOW w AS (PARTITION BY cell ORDER BY date)")
def q16_lags_zero(spark, sf):
    return rounded(windows.lags(_filled(spark, sf), "value", LAGS, ["cell"], "date"))


@query(f"WITH {FILLED_SQL} SELECT cell, date, round(value, 6) AS value, " + ", ".join(f"round(coalesce(lag(value, {k}) OVER w, first_value(value) OVER w), 6) AS value_lag{k}" for k in LAGS) + " FROM filled WINDOW w AS (PARTITION BY cell ORDER BY date)")
def q17_lags_repeat_first(spark, sf):
    return rounded(windows.lags(_filled(spark, sf), "value", LAGS, ["cell"], "date", "repeat_first"))


@query(f"WITH {V.DENSE_SQL} SELECT cell, date, round(coalesce(avg(value) OVER (PARTITION BY cell ORDER BY date ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), 0), 6) AS smooth FROM dense")
def q18_moving_average(spark, sf):
    return rounded(V.dense(spark, sf).select("cell", "date", skill.moving_average(F.col("value"), 6, ["cell"], "date").alias("smooth")))


@query(f"WITH {V.DENSE_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY date) - 1) // 7 AS s FROM dense) SELECT cell, date, round(coalesce(avg(value) OVER (PARTITION BY cell, s), 0), 6) AS value_section FROM n")
def q19_section_mean(spark, sf):
    return rounded(skill.section_mean(V.dense(spark, sf), ["value"], 7, ["cell"], "date").select("cell", "date", "value_section"))


DAY_WINDOWS = """span AS (SELECT min(date) AS a, max(date) AS b FROM series), starts AS (SELECT unnest(generate_series((a + 30)::TIMESTAMP, (b + 1 - 180)::TIMESTAMP, INTERVAL 90 DAY))::DATE AS s, a FROM span),
wins AS (SELECT row_number() OVER (ORDER BY s) - 1 AS window_id, greatest(s - 30, a) AS context_start, s AS start, s + 180 AS end_ FROM starts)"""


@query(f"""WITH {V.SERIES_SQL}, {DAY_WINDOWS} SELECT window_id, context_start, start, end_ AS "end", count(DISTINCT date) AS days, count(observation) AS targets, round(sum(prediction), 0) AS total FROM wins JOIN series ON date >= context_start AND date < end_ GROUP BY ALL""")
def q20_calendar_windows_days(spark, sf):
    s = V.series(spark, sf)
    span = s.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    w = windows.with_targets(windows.day_windows(span, 180, 90, 30), s, "observation")
    rows = windows.window_rows(w, s, context="context_start")
    return rounded(rows.groupBy("window_id", "context_start", "start", "end").agg(F.countDistinct("date").alias("days"), F.count("observation").alias("targets"), F.sum("prediction").alias("total")), 0)


@query("""WITH n AS (SELECT l_suppkey AS gauge, count(DISTINCT l_shipdate::DATE) AS steps FROM lineitem GROUP BY 1), s AS (SELECT gauge, unnest(range(0, greatest(steps - 30 + 1, 0), 15)) AS start FROM n)
SELECT gauge, row_number() OVER (PARTITION BY gauge ORDER BY start) - 1 AS window_id, start, start + 30 AS "end" FROM s""")
def q21_step_windows(spark, sf):
    n = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gauge")).agg(F.countDistinct(F.to_date("l_shipdate")).alias("steps"))
    return windows.step_windows(n, "steps", 30, 15, ["gauge"])


RUNS_SQL = f"""{V.SAMPLES_SQL}, d AS (SELECT DISTINCT cell, time::DATE AS date FROM samples WHERE value > 60), r AS (SELECT *, date - (row_number() OVER (PARTITION BY cell ORDER BY date))::INT AS k FROM d),
runs AS (SELECT cell, min(date) AS start, max(date) + 1 AS end_, count(*) AS n FROM r GROUP BY cell, k)"""


def _runs(spark, sf):
    return windows.runs_of_days(V.samples(spark, sf).where("value > 60").select("cell", F.to_date("time").alias("date")), ["cell"])


@query(f"""WITH {RUNS_SQL}, o AS (SELECT *, coalesce((start > max(end_) OVER (PARTITION BY cell ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2)::INT, 1) AS f FROM runs), g AS (SELECT *, sum(f) OVER (PARTITION BY cell ORDER BY start) AS s FROM o)
SELECT cell, min(start) AS start, max(end_) AS "end" FROM g GROUP BY cell, s""")
def q22_segments_merge(spark, sf):
    return windows.merge_segments(_runs(spark, sf), ["cell"], gap=2)


@query(f"""WITH {V.SERIES_SQL}, {DAY_WINDOWS}, x AS (SELECT gauge_id, date, window_id, CASE WHEN (window_id + day(date)) % 5 <> 0 THEN prediction + window_id END AS prediction, observation FROM wins JOIN series ON date >= start AND date < end_)
SELECT gauge_id, date, round(avg(prediction), 4) AS prediction, round(avg(observation), 4) AS observation, count(prediction) AS prediction_windows, count(observation) AS observation_windows, count(*) FILTER (WHERE prediction IS NOT NULL AND observation IS NOT NULL) AS metric_windows FROM x GROUP BY 1, 2""")
def q23_window_overlap_dedupe(spark, sf):
    s = V.series(spark, sf)
    span = s.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    x = windows.window_rows(windows.day_windows(span, 180, 90, 30), s)
    x = x.withColumn("prediction", F.when((F.col("window_id") + F.dayofmonth("date")) % 5 != 0, F.col("prediction") + F.col("window_id")))
    return rounded(skill.merge_windows(x, ["gauge_id", "date"]), 4)


@query("""WITH e AS (SELECT o_custkey, min(o_orderdate) AS start_time, max(o_orderdate) AS end_time FROM orders GROUP BY 1), b AS (SELECT min(o_orderdate) AS a FROM orders),
w AS (SELECT k AS window_id, a::DATE + (k * 100)::INT AS s, a::DATE + (k * 100 + 40)::INT AS t FROM b, (SELECT unnest(range(0, 20)) AS k)) SELECT window_id, count(*) AS files FROM e JOIN w ON start_time <= t AND end_time >= s GROUP BY 1""")
def q55_interval_overlap(spark, sf):
    o = V.table(spark, sf, "orders")
    e = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("start_time"), F.max("o_orderdate").alias("end_time"))
    first = o.agg(F.to_date(F.min("o_orderdate")).alias("a"))
    w = first.select("a", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    w = w.select(F.col("k").cast("bigint").alias("window_id"), F.date_add("a", F.col("k") * 100).alias("start"), F.date_add("a", F.col("k") * 100 + 40).alias("end"))
    return windows.overlapping(e, w, bucket_days=365).groupBy("window_id").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {FILLED_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY date) - 1) // 5 AS step FROM filled) SELECT cell, step, round(avg(value), 6) AS value FROM n GROUP BY 1, 2")
def q56_temporal_reduction(spark, sf):
    return rounded(windows.reduce_steps(_filled(spark, sf), "value", 5, ["cell"], "date"))


@query(f"""WITH {FILLED_SQL} SELECT cell, date, round(0.2 * coalesce(lag(value, 1) OVER w, 0) + 0.5 * value + 0.3 * coalesce(lead(value, 1) OVER w, 0), 6) AS centred,
  round(0.25 * coalesce(lag(value, 4) OVER w, 0) + 0.25 * coalesce(lag(value, 2) OVER w, 0) + 0.5 * value, 6) AS causal FROM filled WINDOW w AS (PARTITION BY cell ORDER BY date)""")
def q56b_temporal_filter(spark, sf):
    d = windows.filtered(_filled(spark, sf), "value", (0.2, 0.5, 0.3), ["cell"], "date", name="centred")
    return rounded(windows.filtered(d, "value", (0.25, 0.25, 0.5), ["cell"], "date", causal=True, dilation=2, name="causal").drop("value"))


@query(f"""WITH {V.SAMPLES_SQL}, t AS (SELECT DISTINCT cell, time FROM samples), d AS (SELECT *, epoch_us(lead(time) OVER (PARTITION BY cell ORDER BY time)) - epoch_us(time) AS us FROM t)
SELECT cell, min(time) AS start_time, max(time) AS end_time, count(*) AS n_steps, round(median(us / 1e6), 3) AS step_seconds FROM d GROUP BY 1""")
def q55b_manifest(spark, sf):
    return rounded(windows.median_step_seconds(V.samples(spark, sf), ["cell"]), 3)


@query(f"""WITH {V.DAILY_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date DESC) AS back FROM daily), b AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date DESC) AS back FROM daily WHERE dayofweek(date) <> 0)
SELECT a.cell, a.date, round(a.value, 6) AS value, round(b.value, 6) AS other FROM a JOIN b ON a.cell = b.cell AND a.back = b.back""")
def q23b_tail_alignment(spark, sf):
    d = V.daily(spark, sf)
    return rounded(windows.align_tails(d, d.where(F.dayofweek("date") != 1).withColumnRenamed("value", "other"), ["cell"], "date"))


@query(f"""WITH {FILLED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY date) - 1 AS k FROM filled), s AS (SELECT cell, value, unnest(range(k, 12, 5)) - 12 AS step FROM n WHERE k < 5) SELECT cell, step, round(value, 6) AS value FROM s""")
def q23c_spin_up(spark, sf):
    return rounded(windows.spin_up(_filled(spark, sf), 12, 5, ["cell"], "date").select("cell", "step", "value"))


BLOCKS_SQL = f"""{V.DENSE_SQL}, b AS (SELECT *, (((date - (SELECT min(date) FROM dense))::INT) // 5)::BIGINT AS block_id, CASE WHEN value IS NOT NULL THEN ln(1 + greatest(value, 0)) END AS x FROM dense),
allf AS (SELECT block_id, avg(x) AS mean_log_flow, quantile_cont(x, 0.1) AS p10_log_flow, quantile_cont(x, 0.9) AS p90_log_flow, count(x) / count(*) AS valid_fraction FROM b GROUP BY 1),
dayf AS (SELECT block_id, stddev_pop(m) AS daily_std_log_flow FROM (SELECT block_id, date, avg(x) AS m FROM b GROUP BY 1, 2) GROUP BY 1),
gaugef AS (SELECT block_id, stddev_pop(m) AS gauge_mean_spread, avg(s) AS gauge_std_mean FROM (SELECT block_id, cell, avg(x) AS m, stddev_pop(x) AS s FROM b GROUP BY 1, 2) GROUP BY 1),
mid AS (SELECT block_id, 2 * pi() * (dayofyear(min(date) + 2) - 1) / 366.0 AS angle FROM b GROUP BY 1),
feats AS (SELECT block_id, valid_fraction, mean_log_flow, p10_log_flow, p90_log_flow, daily_std_log_flow, gauge_mean_spread, gauge_std_mean, sin(angle) AS season_sin, cos(angle) AS season_cos FROM allf JOIN dayf USING (block_id) JOIN gaugef USING (block_id) JOIN mid USING (block_id))"""
NAMES = splits.FEATURES


def _features(spark, sf):
    return splits.block_features(splits.blocks_of(V.dense(spark, sf), 5), "cell")


@query(f"WITH {BLOCKS_SQL} SELECT block_id, round(valid_fraction, 6) AS valid_fraction, " + ", ".join(f"round({c}, 6) AS {c}" for c in NAMES) + " FROM feats")
def q51_block_features(spark, sf):
    return rounded(_features(spark, sf).select("block_id", "valid_fraction", *NAMES))


SCALED_SQL = ", ".join(f"(SELECT median({c}) AS med, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, stddev_pop({c}) AS sd FROM feats) AS s_{c}" for c in NAMES)
SCORE_SQL = f"""scaled AS (SELECT block_id, ['train', 'validation', 'test'][1 + block_id % 3] AS period, {", ".join(f"({c} - s_{c}.med) / CASE WHEN abs(s_{c}.iqr) > 1e-8 THEN s_{c}.iqr WHEN abs(s_{c}.sd) > 1e-8 THEN s_{c}.sd ELSE 1 END AS {c}" for c in NAMES)} FROM feats, {SCALED_SQL}),
g AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NAMES)} FROM scaled), p AS (SELECT period, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NAMES)} FROM scaled GROUP BY 1)
SELECT round(sum(sqrt({" + ".join(f"(p.m_{c} - g.m_{c}) ** 2" for c in NAMES)}) + 0.25 * sqrt({" + ".join(f"(p.d_{c} - g.d_{c}) ** 2" for c in NAMES)})), 6) AS score FROM p, g"""


@query(f"WITH {BLOCKS_SQL}, {SCORE_SQL}")
def q52_block_score(spark, sf):
    f = _features(spark, sf)
    period = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (1 + F.col("block_id") % 3).cast("int"))
    return rounded(splits.score(splits.robust_scaled(f).withColumn("period", period)))


BEST_SQL = f"""z AS (SELECT block_id, {", ".join(f"({c} - s_{c}.med) / CASE WHEN abs(s_{c}.iqr) > 1e-8 THEN s_{c}.iqr WHEN abs(s_{c}.sd) > 1e-8 THEN s_{c}.sd ELSE 1 END AS {c}" for c in NAMES)} FROM feats, {SCALED_SQL}),
g AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NAMES)} FROM z), picks AS (SELECT v.block_id AS v, t.block_id AS t FROM z v, z t WHERE v.block_id <> t.block_id),
p AS (SELECT v, t, CASE block_id WHEN v THEN 'validation' WHEN t THEN 'test' ELSE 'train' END AS period, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NAMES)} FROM picks, z GROUP BY ALL),
scored AS (SELECT v, t, sum(sqrt({" + ".join(f"(p.m_{c} - g.m_{c}) ** 2" for c in NAMES)}) + 0.25 * sqrt({" + ".join(f"(p.d_{c} - g.d_{c}) ** 2" for c in NAMES)})) AS score FROM p, g GROUP BY 1, 2)
SELECT (SELECT count(*) FROM z) - 2 AS train, 1::BIGINT AS validation, 1::BIGINT AS test, round(min(score), 6) AS score FROM scored"""


@query(f"WITH {BLOCKS_SQL}, {BEST_SQL}")
def q58b_balanced_score(spark, sf):
    """Counts and score of the split that the search finds. Of the few blocks here SQL tries all assignments, so the search has to find the best one."""
    f = _features(spark, sf)
    found = splits.robust_scaled(f).join(splits.balanced(f, seed=42).select("block_id", "period"), "block_id")
    counts = found.agg(*[F.count_if(F.col("period") == p).alias(p) for p in splits.PERIODS])
    return rounded(counts.crossJoin(splits.score(found)))  # one row each


@query()
def q58_balanced_split(spark, sf):
    return rounded(splits.balanced(_features(spark, sf), seed=42))


@query(f"""WITH {V.SERIES_SQL}, span AS (SELECT gauge_id, min(date) AS a, max(date) AS b FROM series GROUP BY 1), s AS (SELECT gauge_id, b, unnest(range(0, 40)) AS k, a FROM span), w AS (SELECT gauge_id, k AS window_id, (a + to_years(k::INT))::DATE AS start, (a + to_years((k + 1)::INT))::DATE AS end_, b FROM s)
SELECT gauge_id, window_id, start, end_ AS "end" FROM w WHERE end_ <= b + 1""")
def q20b_calendar_windows_years(spark, sf):
    span = V.series(spark, sf).groupBy("gauge_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return windows.year_windows(span, 1, 1, by=["gauge_id"])


HISTORY_SQL = """history AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, o_totalprice AS val_loss FROM orders)"""


def _history(spark, sf):
    o = V.table(spark, sf, "orders")
    w = Window.partitionBy("run").orderBy("o_orderkey")
    return o.withColumn("run", F.col("o_custkey")).select("run", F.row_number().over(w).cast("bigint").alias("epoch"), F.col("o_totalprice").alias("val_loss"))


@query(f"WITH {HISTORY_SQL} SELECT run, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_loss FROM history GROUP BY 1")
def q61_best_epoch(spark, sf):
    return history.best_epochs(_history(spark, sf))


@query(f"WITH {HISTORY_SQL} SELECT run, epoch, val_loss FROM (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM history) WHERE m IS NULL OR val_loss < m")
def q61b_kept_checkpoints(spark, sf):
    return history.improvements(_history(spark, sf)).where("is_best").drop("is_best")


@query(f"""WITH RECURSIVE {HISTORY_SQL}, f AS (SELECT run, epoch, val_loss AS best, 0 AS bad FROM history WHERE epoch = 1 UNION ALL SELECT h.run, h.epoch, CASE WHEN val_loss < best - 100 THEN val_loss ELSE best END, CASE WHEN val_loss < best - 100 THEN 0 ELSE bad + 1 END FROM f JOIN history h ON h.run = f.run AND h.epoch = f.epoch + 1 WHERE bad < 3)
SELECT run, min(epoch) FILTER (WHERE bad >= 3) AS stop_epoch FROM f GROUP BY 1""")
def q62_early_stop(spark, sf):
    return history.stop_epochs(_history(spark, sf), 3, 100.0)


@query("""SELECT user_id AS cell, ts::DATE AS date, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def q60_stream_daily(spark, sf):
    """The stream puts out all that has arrived; in complete mode that is every day."""
    events = V.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, checkpoint = shared_path(spark, "stream-daily"), shared_path(spark, "stream-checkpoint")
    daily.run_once(daily.daily_stream(stream.withColumnRenamed("user_id", "cell"), ["cell"], "ts"), out, checkpoint, "complete")
    return rounded(spark.read.parquet(out).withColumn("total", F.round("total", 4)))
