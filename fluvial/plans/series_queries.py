"""Queries on metrics, losses, reports, daily aggregation and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.common import table
from fluvial.functions import columns as C
from fluvial.operators import compare, prepare, quantiles, skill
from fluvial.plans import views as V
from fluvial.plans.registry import query, rounded

E64, E32, BEST = "2.220446049250313e-16", "1.1920928955078125e-07", "(-0.41421356237309515)"

#: Statistics of valid pairs for a grouping; what follows are the definitions of each metric.
STATS = """stats AS (SELECT {by}, count(*) FILTER (WHERE prediction IS NOT NULL AND observation IS NOT NULL) AS n, avg(p) AS mp, avg(o) AS mo, stddev_pop(p) AS sp, stddev_pop(o) AS so, covar_pop(p, o) AS cov,
  avg((p - o) ** 2) AS mse, sum(p - o) AS error, sum(o) AS total FROM (SELECT *, CASE WHEN observation IS NOT NULL THEN prediction END AS p, CASE WHEN prediction IS NOT NULL THEN observation END AS o FROM {table}) GROUP BY ALL)"""
ANALYSIS = f"""comp AS (SELECT *, CASE WHEN n >= 2 AND sp > {E64} AND so > {E64} THEN cov / nullif(sp * so, 0) END AS r, CASE WHEN n >= 2 THEN sp / nullif(so + {E64}, 0) END AS alpha,
  CASE WHEN n >= 2 THEN (mp + {E64}) / nullif(mo + {E64}, 0) END AS beta FROM stats), done AS (SELECT *, 1 - sqrt((r - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2) AS kge FROM comp)"""
ANALYSIS_COLUMNS = f"""n, round(r, 6) AS r, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(kge, 6) AS kge, round((kge - {BEST}) / (1 - {BEST}), 6) AS kgess,
  round(CASE WHEN n >= 2 AND n * so * so > {E64} THEN 1 - mse * n / (n * so * so) END, 6) AS nse, round(CASE WHEN n >= 2 THEN error / n END, 3) AS bias, round(CASE WHEN n >= 2 THEN 100 * error / (total + {E64}) END, 6) AS pbias, round(CASE WHEN n >= 2 THEN sqrt(mse) END, 3) AS rmse"""


@query(f"""WITH {V.SERIES_SQL}, {STATS.format(by="gauge_id", table="series")},
comp AS (SELECT *, CASE WHEN n > 1 AND sp > {E64} AND so > {E64} THEN cov / (sp * so) END AS r, CASE WHEN so > {E64} THEN sp / so END AS a, CASE WHEN abs(mo) > {E64} THEN mp / mo END AS b FROM stats)
SELECT gauge_id, n, round(mse, 3) AS mse, round(sqrt(mse), 3) AS rmse, round(r, 6) AS correlation, round(a, 6) AS variability, round(b, 6) AS bias_ratio, round(1 - sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2), 6) AS kge,
  round(CASE WHEN n * so * so > {E64} THEN 1 - mse * n / (n * so * so) END, 6) AS nse FROM comp""")
def q01_series_metrics_eval(spark, sf):
    m = skill.series_metrics(V.series(spark, sf), ["gauge_id"])
    return rounded(m.withColumns({"mse": F.round("mse", 3), "rmse": F.round("rmse", 3)}))


def _reported(m):
    return rounded(m.withColumns({"bias": F.round("bias", 3), "rmse": F.round("rmse", 3)}))


MOMENT_STATS = f"""m AS (SELECT gauge_id, count(*) AS n, sum(prediction) AS sp, sum(observation) AS so, sum(prediction ** 2) AS spp, sum(observation ** 2) AS soo, sum(prediction * observation) AS spo, sum((prediction - observation) ** 2) AS sse
  FROM series WHERE prediction IS NOT NULL AND observation IS NOT NULL GROUP BY 1),
v AS (SELECT *, sp / n AS mp, so / n AS mo, greatest(spp / n - (sp / n) ** 2, 0) AS vp, greatest(soo / n - (so / n) ** 2, 0) AS vo, greatest(soo - n * (so / n) ** 2, 0) AS sst FROM m),
k AS (SELECT *, (spo / n - mp * mo) / (sqrt(vp + {E64}) * sqrt(vo + {E64}) + {E64}) AS r, sqrt(vp + {E64}) / (sqrt(vo + {E64}) + {E64}) AS a, (mp + {E64}) / (mo + {E64}) AS b FROM v),
rows AS (SELECT gauge_id, n, n > 1 AND vo > {E64} AND abs(mo) > {E64} AS kge_valid, r, a AS alpha, b AS beta, 1 - sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2) AS kge, n > 1 AND sst > {E64} AS nse_valid, 1 - sse / greatest(sst, {E64}) AS nse, sse / n AS mse FROM k)"""


@query(f"""WITH {V.SERIES_SQL}, {MOMENT_STATS} SELECT gauge_id, n, kge_valid, round(r, 5) AS r, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(kge, 5) AS kge, nse_valid, round(nse, 5) AS nse, round(mse, 2) AS mse FROM rows""")
def q02_metrics_validation_moments(spark, sf):
    parts = skill.moments(V.series(spark, sf).withColumn("part", F.month("date")), ["gauge_id", "part"])
    m = skill.metrics_from_moments(skill.merge_moments(parts, ["gauge_id"]), ["gauge_id"])
    return rounded(m.withColumn("mse", F.round("mse", 2)), 5)


@query(f"""WITH {V.SERIES_SQL}, {MOMENT_STATS}, s AS (SELECT count(*) AS series, count(*) FILTER (WHERE kge_valid) AS kge_series, count(*) FILTER (WHERE nse_valid) AS nse_series, avg(kge) FILTER (WHERE kge_valid) AS mean_kge, avg(nse) FILTER (WHERE nse_valid) AS mean_nse,
  avg(r) FILTER (WHERE kge_valid) AS mean_r, avg(alpha) FILTER (WHERE kge_valid) AS mean_alpha, avg(beta) FILTER (WHERE kge_valid) AS mean_beta, sum(n)::BIGINT AS points FROM rows)
SELECT series, kge_series, nse_series, round(mean_kge, 5) AS mean_kge, round(mean_nse, 5) AS mean_nse, round(mean_r, 5) AS mean_r, round(mean_alpha, 5) AS mean_alpha, round(mean_beta, 5) AS mean_beta, points,
  round(1 - sqrt((mean_r - 1) ** 2 + (mean_alpha - 1) ** 2 + (mean_beta - 1) ** 2), 5) AS component_kge FROM s""")
def q02b_metrics_summary(spark, sf):
    return rounded(skill.summary(skill.metrics_from_moments(skill.moments(V.series(spark, sf), ["gauge_id"]), ["gauge_id"])), 5)


@query(f"""WITH {V.SERIES_SQL}, monthly AS (SELECT *, month(date) AS month FROM series), {STATS.format(by="gauge_id, month", table="monthly")}, {ANALYSIS} SELECT gauge_id, month, {ANALYSIS_COLUMNS} FROM done""")
def q03_metrics_analysis_monthly(spark, sf):
    return _reported(compare.by_month(V.series(spark, sf)))


@query(f"""WITH {V.SERIES_SQL}, names AS (SELECT * FROM (VALUES ('DJF', [12, 1, 2]), ('MAM', [3, 4, 5]), ('JJA', [6, 7, 8]), ('SON', [9, 10, 11]), ('Dec-May', [12, 1, 2, 3, 4, 5]), ('Jul-Sep', [7, 8, 9])) t(season, months)),
seasonal AS (SELECT series.*, season FROM series JOIN names ON list_contains(months, month(date))), {STATS.format(by="gauge_id, season", table="seasonal")}, {ANALYSIS} SELECT gauge_id, season, {ANALYSIS_COLUMNS} FROM done""")
def q04_metrics_seasonal_overlap(spark, sf):
    return _reported(compare.by_season(V.series(spark, sf)))


@query(f"""WITH {V.SERIES_SQL}, {STATS.format(by="gauge_id", table="series")}, {ANALYSIS} SELECT gauge_id, {ANALYSIS_COLUMNS} FROM done""")
def q05_kgess_bias_pbias(spark, sf):
    return _reported(skill.analysis_metrics(V.series(spark, sf), ["gauge_id"]))


@query(f"""WITH {V.SAMPLES_SQL} SELECT variable, count(value) AS value_count, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, round(median(value), 6) AS value_median, max(value) AS value_max FROM samples GROUP BY 1""")
def q06_distribution_summary(spark, sf):
    return rounded(compare.distribution(V.samples(spark, sf), ["variable"], ["value"]))


@query(f"""WITH {V.SAMPLES_SQL}, q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM samples GROUP BY 1)
SELECT q.variable, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS high FROM samples s JOIN q ON s.variable = q.variable GROUP BY ALL""")
def q06b_quartiles(spark, sf):
    return rounded(compare.quartiles(V.samples(spark, sf), ["variable"], "value"))


@query(f"""WITH {V.SAMPLES_SQL} SELECT variable, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS med, quantile_disc(value, 0.5) AS low_med, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS top FROM samples GROUP BY 1""")
def q13b_quantiles_by_selection(spark, sf):
    """As for groups of any size: sketches bracket the ranks, counts narrow the brackets."""
    shares = {"p01": 0.01, "med": 0.5, "low_med": (0.5, "disc"), "p99": 0.99, "top": 1.0}
    return rounded(quantiles.exact_quantiles(V.samples(spark, sf), ["variable"], "value", shares, within=100))


@query(f"""WITH {V.DAILY_SQL} SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY value DESC) AS rank, round(100.0 * row_number() OVER (PARTITION BY cell ORDER BY value DESC) / (count(*) OVER (PARTITION BY cell) + 1), 6) AS exceedance, round(value, 6) AS value FROM daily""")
def q07_flow_duration(spark, sf):
    return rounded(compare.flow_duration(V.daily(spark, sf), ["cell"], "value"))


RULES = {"click": prepare.DailyRule("click", "sum", 3600.0, "click_depth"), "view": prepare.DailyRule("view", "max"), "purchase": prepare.DailyRule("purchase", "min", 0.5, "purchase_low")}


@query(f"""WITH {V.SAMPLES_SQL} SELECT cell, time::DATE AS date, CASE variable WHEN 'click' THEN 'click_depth' WHEN 'purchase' THEN 'purchase_low' ELSE variable END AS name,
  round(CASE variable WHEN 'click' THEN coalesce(sum(value * 3600.0), 0) WHEN 'view' THEN max(value) WHEN 'purchase' THEN min(value * 0.5) ELSE avg(value) END, 4) AS value FROM samples GROUP BY cell, time::DATE, variable""")
def q08_daily_aggregate_plan(spark, sf):
    s = V.samples(spark, sf)
    plan = prepare.daily_plan([r[0] for r in s.select("variable").distinct().collect()], RULES)
    return rounded(prepare.aggregate_daily(s, plan, ["cell"]), 4)


@query(f"""WITH {V.DAILY_SQL}, span AS (SELECT cell, min(date) AS a, max(date) AS b FROM daily GROUP BY 1), days AS (SELECT cell, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM span)
SELECT days.cell, days.date, round(value, 6) AS value FROM days LEFT JOIN daily USING (cell, date)""")
def q09_daily_densified(spark, sf):
    return rounded(prepare.densify(V.daily(spark, sf), ["cell"]))


@query("""WITH a AS (SELECT o_orderdate::DATE AS date, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT l_shipdate::DATE AS date, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1)
SELECT a.date, orders, round(shipped, 2) AS shipped FROM a JOIN b USING (date)""")
def q10_align_days(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("shipped"))
    a, b = prepare.common_days(a, b)
    return rounded(a.join(b, "date"), 2)


@query("""WITH a AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), b AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)
SELECT date, 'left' AS only_in FROM a WHERE date NOT IN (SELECT date FROM b) UNION ALL SELECT date, 'right' FROM b WHERE date NOT IN (SELECT date FROM a)""")
def q10b_unmatched_days(spark, sf):
    a = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return prepare.same_days(a, table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")))


@query(f"WITH {V.DENSE_SQL} SELECT cell, date, round(value, 6) AS value FROM dense")
def q11_union_reindex(spark, sf):
    return rounded(V.dense(spark, sf))


@query(f"""WITH {V.SAMPLES_SQL} SELECT variable, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) > 1e-6 THEN stddev_pop(value) ELSE 1 END, 6) AS std FROM samples GROUP BY 1""")
def q12_scaler_standard(spark, sf):
    return rounded(prepare.standard_scaler(V.samples(spark, sf), ["variable"]))


@query(f"""WITH {V.SAMPLES_SQL}, s AS (SELECT variable, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM samples GROUP BY 1)
SELECT event_id, samples.variable, round(greatest(least((value - lo) / CASE WHEN hi - lo > 1e-6 THEN hi - lo ELSE 1 END, 1), 0), 6) AS value FROM samples JOIN s USING (variable)""")
def q13_scaler_percentile_clip(spark, sf):
    s = V.samples(spark, sf)
    return rounded(prepare.scale(s, prepare.percentile_scaler(s, ["variable"]), ["variable"], limits=(0.0, 1.0)).select("event_id", "variable", "value"))


@query(f"""WITH {V.SAMPLES_SQL} SELECT variable, round(avg(value), 6) AS mean, round(greatest(sqrt(greatest(avg(value ** 2) - avg(value) ** 2, 0)), 1e-6), 6) AS std FROM samples GROUP BY 1""")
def q14_scaler_merge_moments(spark, sf):
    parts = prepare.scaler_sums(V.samples(spark, sf).withColumn("file", F.to_date("time")), ["variable", "file"])
    return rounded(prepare.scaler_from_sums(parts, ["variable"]))


@query(f"""WITH {V.SERIES_SQL}, s AS (SELECT gauge_id, avg(ln(1 + greatest(observation, 0))) AS mean, stddev_pop(ln(1 + greatest(observation, 0))) AS std FROM series WHERE observation IS NOT NULL GROUP BY 1)
SELECT gauge_id, date, round((ln(1 + greatest(observation, 0)) - mean) / std, 6) AS scaled, round(observation, 4) AS back FROM series JOIN s USING (gauge_id) WHERE observation IS NOT NULL""")
def q14b_scale_round_trip(spark, sf):
    s = V.series(spark, sf).select("gauge_id", "date", "observation").where("observation IS NOT NULL")
    sc = prepare.standard_scaler(s.withColumn("observation", C.log_flow("observation")), ["gauge_id"], "observation")
    scaled = prepare.scale(s, sc, ["gauge_id"], "observation", "log1p").withColumn("scaled", F.col("observation"))
    back = prepare.unscale(scaled, sc, ["gauge_id"], "observation", "log1p").withColumn("back", F.round("observation", 4))
    return rounded(back.select("gauge_id", "date", "scaled", "back"))


@query("""SELECT DISTINCT o_orderdate::DATE AS date, round(sin(2 * pi() * (dayofyear(o_orderdate) - 1) / 366.0), 6) + 0.0 AS sin_doy, round(cos(2 * pi() * (dayofyear(o_orderdate) - 1) / 366.0), 6) + 0.0 AS cos_doy,
  round(sin(2 * pi() * (month(o_orderdate) - 1) / 12.0), 6) + 0.0 AS sin_month, round(cos(2 * pi() * (month(o_orderdate) - 1) / 12.0), 6) + 0.0 AS cos_month, year(o_orderdate) + (month(o_orderdate) >= 10)::INT AS water_year, strftime(o_orderdate, '%b') AS month_name FROM orders""")
def q15_time_features(spark, sf):
    d = prepare.time_features(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct())
    d = rounded(d.withColumns({"water_year": C.water_year("date"), "month_name": F.date_format("date", "MMM")}))
    return d.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in prepare.TIME_FEATURES})


@query(f"""WITH {V.SAMPLES_SQL}, w AS (SELECT cell, time::DATE // 1 AS date FROM samples LIMIT 0), d AS (SELECT cell, time::DATE AS date, count(DISTINCT time) AS steps, avg(value) AS value FROM samples GROUP BY 1, 2)
SELECT cell, date, 'all' AS name, round(value, 6) AS value FROM d WHERE steps >= 12""".replace("w AS (SELECT cell, time::DATE // 1 AS date FROM samples LIMIT 0), ", ""))
def q08b_daily_min_steps(spark, sf):
    s = V.samples(spark, sf).withColumn("variable", F.lit("all"))
    return rounded(prepare.aggregate_daily(s, prepare.daily_plan(["all"]), ["cell"], min_steps=12))


# -- losses ------------------------------------------------------------------------------------------------------------

PAIRS = "pairs AS (SELECT gauge_id, prediction AS p, observation AS o FROM series WHERE prediction IS NOT NULL AND observation IS NOT NULL)"


@query(f"WITH {V.SERIES_SQL}, {PAIRS} SELECT round(avg(v), 2) AS loss FROM (SELECT avg((p - o) ** 2) AS v FROM pairs GROUP BY gauge_id)")
def q24_loss_mse(spark, sf):
    return rounded(skill.mse_loss(V.series(spark, sf), ["gauge_id"]), 2)


@query(f"WITH {V.SERIES_SQL}, {PAIRS} SELECT round(sum(v * w) / sum(w), 2) AS loss FROM (SELECT sum((1 + month(date)) * (prediction - observation) ** 2) / sum(1 + month(date)) AS v, avg(1 + month(date)) AS w FROM series WHERE prediction IS NOT NULL AND observation IS NOT NULL GROUP BY gauge_id)")
def q24b_loss_mse_weighted(spark, sf):
    return rounded(skill.mse_loss(V.series(spark, sf), ["gauge_id"], (1 + F.month("date")).cast("double")), 2)


@query(f"WITH {V.SERIES_SQL}, {PAIRS} SELECT round(avg(v), 6) AS loss FROM (SELECT avg((ln(1 + greatest(p, 0)) - ln(1 + greatest(o, 0))) ** 2) AS v FROM pairs GROUP BY gauge_id)")
def q25_log_mse(spark, sf):
    return rounded(skill.log_mse_loss(V.series(spark, sf), ["gauge_id"]))


@query(f"WITH {V.SERIES_SQL}, {PAIRS}, w AS (SELECT *, least(1 + 2 * greatest(o / 10000 - 0.5, 0), 8) AS w FROM pairs) SELECT round(sum(v * m) / sum(m), 6) AS loss FROM (SELECT sum(w * (p / 10000 - o / 10000) ** 2) / sum(w) AS v, avg(w) AS m FROM w GROUP BY gauge_id)")
def q26_peak_mse(spark, sf):
    s = V.series(spark, sf).withColumns({"prediction": F.col("prediction") / 10000, "observation": F.col("observation") / 10000})
    return rounded(skill.peak_mse_loss(s, ["gauge_id"]))


KGE_L = f"""k AS (SELECT gauge_id, count(*)::DOUBLE AS n, avg(p) AS mp, avg(o) AS mo, var_pop(p) AS vp, var_pop(o) AS vo, covar_pop(p, o) AS cov FROM pairs GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT n * cov / (sqrt(n * vp * n * vo + {E32}) + {E32}) AS r, sqrt(vp + {E32}) / (sqrt(vo + {E32}) + {E32}) AS a, (mp + {E32}) / (mo + {E32}) AS b FROM k)"""


@query(f"WITH {V.SERIES_SQL}, {PAIRS}, {KGE_L} SELECT round(1 - avg(1 - sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2)), 6) AS loss FROM c")
def q27_loss_kge(spark, sf):
    return rounded(skill.kge_loss(V.series(spark, sf), ["gauge_id"]))


@query(f"WITH {V.SERIES_SQL}, {PAIRS}, {KGE_L} SELECT round(sqrt((avg(r) - 1) ** 2 + (avg(a) - 1) ** 2 + (avg(b) - 1) ** 2), 6) AS loss FROM c")
def q28_kge_components(spark, sf):
    return rounded(skill.kge_component_loss(V.series(spark, sf), ["gauge_id"]))


JKGE = """sums AS (SELECT gauge_id, count(*) AS n, sum((p - bp) * (o - bo)) AS d, sqrt(sum((p - bp) ** 2)) AS np, sqrt(sum((o - bo) ** 2)) AS no, sqrt(sum((bp - bo) ** 2)) AS nd, avg(o) AS mo FROM bench WHERE p IS NOT NULL AND o IS NOT NULL GROUP BY 1),
norms AS (SELECT s.*, (SELECT 1) AS one FROM sums s), cb AS (SELECT b.gauge_id, sqrt(sum((bo - mo) ** 2)) AS nb FROM bench b JOIN sums USING (gauge_id) WHERE p IS NOT NULL AND o IS NOT NULL GROUP BY 1),
comp AS (SELECT d / (np * no + 1e-8) AS c, np / (no + 1e-8) AS v, nd / (nb + 1e-8) AS m FROM sums JOIN cb USING (gauge_id) WHERE n > 2 AND no > 1e-8)
SELECT round(avg(c), 6) AS correlation, round(avg(v), 6) AS variability, round(avg(m), 6) AS mismatch, round(sqrt((avg(c) - 1) ** 2 + (avg(v) - 1) ** 2 + avg(m) ** 2), 6) AS loss FROM comp"""
MASKED = "masked AS (SELECT gauge_id, date, CASE WHEN observation IS NOT NULL THEN prediction END AS p, CASE WHEN prediction IS NOT NULL THEN observation END AS o FROM series)"


@query(f"""WITH {V.SERIES_SQL}, {MASKED}, bench AS (SELECT *, coalesce(avg(p) OVER w, 0) AS bp, coalesce(avg(o) OVER w, 0) AS bo FROM masked WINDOW w AS (PARTITION BY gauge_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING)), {JKGE}""")
def q29_jkge(spark, sf):
    return rounded(skill.jkge_loss(V.series(spark, sf), ["gauge_id"], "date"))


@query(f"""WITH {V.SERIES_SQL}, {MASKED}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY gauge_id ORDER BY date) - 1) // 30 AS s FROM masked),
bench AS (SELECT *, coalesce(avg(p) OVER w, 0) AS bp, coalesce(avg(o) OVER w, 0) AS bo FROM numbered WINDOW w AS (PARTITION BY gauge_id, s)), {JKGE}""")
def q29b_jkge_sections(spark, sf):
    return rounded(skill.jkge_loss(V.series(spark, sf), ["gauge_id"], "date", section=30))


@query(f"WITH {V.SERIES_SQL}, {PAIRS}, {KGE_L}, m AS (SELECT avg(v) AS mse FROM (SELECT avg((p - o) ** 2) AS v FROM pairs GROUP BY gauge_id)) SELECT round(0.9 * (SELECT mse FROM m) + 0.1 * (1 - avg(1 - sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2))), 2) AS loss FROM c")
def q30_mixed(spark, sf):
    return rounded(skill.mixed_loss(V.series(spark, sf), ["gauge_id"]), 2)


# -- two models --------------------------------------------------------------------------------------------------------

MONTHLY = """m AS (SELECT gauge_id, date_trunc('month', date)::DATE AS month, coalesce(sum(gnn), 0) AS gnn, coalesce(sum(observed), 0) AS observed, coalesce(sum(other), 0) AS other FROM compared WHERE gnn IS NOT NULL AND observed IS NOT NULL AND other IS NOT NULL GROUP BY 1, 2)"""
HALF = "CASE WHEN month(month) IN (12, 1, 2, 3, 4, 5) THEN 'Dec-May' WHEN month(month) IN (6, 7, 8, 9) THEN 'Jun-Sep' ELSE 'Other' END AS season"


def _monthly(spark, sf):
    c = V.compared(spark, sf)
    d = compare.align_models(c.select("gauge_id", "date", "gnn", "observed"), c.select("gauge_id", "date", "other"))
    return compare.monthly(d, ["gauge_id"], ["gnn", "observed", "other"])


@query(f"WITH {V.COMPARED_SQL}, {MONTHLY} SELECT gauge_id, month, {HALF}, round(gnn, 4) AS gnn, round(observed, 4) AS observed, round(other, 4) AS other FROM m")
def q48_model_comparison_monthly(spark, sf):
    return rounded(_monthly(spark, sf), 4)


@query(f"""WITH {V.COMPARED_SQL}, {MONTHLY}, long AS (SELECT gauge_id, 'gnn' AS model, gnn AS prediction, observed AS observation FROM m UNION ALL SELECT gauge_id, 'other', other, observed FROM m), {STATS.format(by="gauge_id, model", table="long")}, {ANALYSIS},
w AS (SELECT gauge_id, max(CASE WHEN model = 'gnn' THEN kge END) AS gnn, max(CASE WHEN model = 'other' THEN kge END) AS other FROM done GROUP BY 1) SELECT gauge_id, round(gnn, 6) AS gnn, round(other, 6) AS other, round(gnn - other, 6) AS difference FROM w""")
def q49_pivot_difference(spark, sf):
    m = compare.long_form(_monthly(spark, sf).drop("season"), ["gauge_id", "month", "observed"], ["gnn", "other"], "model", "prediction")
    k = skill.analysis_metrics(m.withColumnRenamed("observed", "observation"), ["gauge_id", "model"])
    return rounded(compare.difference(k, ["gauge_id"], "model", "kge", "gnn", "other"))


@query(f"""WITH {V.COMPARED_SQL}, {MONTHLY} SELECT gauge_id, month, source, round(value, 4) AS value FROM (SELECT gauge_id, month, 'gnn' AS source, gnn AS value FROM m UNION ALL SELECT gauge_id, month, 'observed', observed FROM m UNION ALL SELECT gauge_id, month, 'other', other FROM m)""")
def q50_unpivot(spark, sf):
    return rounded(compare.long_form(_monthly(spark, sf), ["gauge_id", "month"], ["gnn", "observed", "other"]), 4)


@query(f"""WITH {V.SERIES_SQL}, monthly AS (SELECT *, month(date) AS month FROM series), {STATS.format(by="gauge_id, month", table="monthly")}, {ANALYSIS} SELECT gauge_id, """ + ", ".join(f"round(max(CASE WHEN month = {k} THEN kge END), 6) AS m{k}" for k in range(1, 13)) + " FROM done GROUP BY 1")
def q50b_heat_table(spark, sf):
    t = compare.heat_table(compare.by_month(V.series(spark, sf)), "gauge_id", "month", range(1, 13), "kge")
    return rounded(t.withColumnsRenamed({str(k): f"m{k}" for k in range(1, 13)}))


# -- text and metadata -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, 'run7.dailymean.' || strftime(o_orderdate, '%Y%m%d') || '.nc' AS name, date_trunc('day', o_orderdate) AS time FROM orders""")
def q53_filename_timestamp(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("run7.dailymean."), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".nc")).alias("name"))
    return o.withColumn("time", C.file_timestamp("name"))


@query("""SELECT c_custkey, coalesce(nullif(ltrim(lpad(c_custkey::VARCHAR, 8, '0'), '0'), ''), '0') AS id, trim(regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9]+', '_', 'g'), '_') AS safe FROM customer""")
def q54_canonical_id(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", C.canonical_id(F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id"), C.safe_name(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("safe"))


@query("""SELECT event_type, count(*) AS n, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k, max((props->>'$.k')::BIGINT) AS max_k FROM events GROUP BY 1""")
def q57_json_metadata(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(k).alias("mean_k"), F.max(k).alias("max_k")))
