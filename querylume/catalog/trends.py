"""Trend fits of compile time by number of joins."""

from pyspark.sql import functions as F

from querylume.catalog.core import log_sql, query, rounded, table_query, written_table
from querylume.catalog.summaries import M5
from querylume.fixture import query_log
from querylume.operators.joins import join_unique
from querylume.plans import trend, views

POINTS = M5 + """
, points AS (SELECT CAST(x AS DOUBLE) AS x, y, ln(1 + y) AS z FROM m5 WHERE y IS NOT NULL)
"""
LINE = POINTS + """
, line AS (SELECT regr_slope(z, x) AS a, regr_intercept(z, x) AS b FROM points)
, scored AS (
 SELECT 1 - sum(pow(y - (exp(a * x + b) - 1), 2)) / regr_syy(y, y) AS r2 FROM points, line
)
"""
PARABOLA = POINTS + """
, centre AS (SELECT avg(x) AS m FROM points)
, s AS (
 SELECT any_value(m) AS m, count(*) AS s0, sum(x - m) AS s1, sum(pow(x - m, 2)) AS s2,
  sum(pow(x - m, 3)) AS s3, sum(pow(x - m, 4)) AS s4, sum(z) AS t0, sum((x - m) * z) AS t1,
  sum(pow(x - m, 2) * z) AS t2
 FROM points, centre
)
, dets AS (
 SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS d,
  t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS dp,
  s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS dq,
  s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2) AS dr
 FROM s
)
, curve AS (
 SELECT dp / d AS a, dq / d - 2 * dp / d * m AS b, dp / d * m * m - dq / d * m + dr / d AS c
 FROM dets
)
, scored AS (
 SELECT 1 - sum(pow(y - (exp(a * x * x + b * x + c) - 1), 2)) / regr_syy(y, y) AS r2
 FROM points, curve
)
"""


def _points(log):
    """One row per join count, computed from the log once and kept for the fit."""
    return written_table(views.compile_by_joins(log))


@query("t1_ols", """
SELECT round(regr_slope(compile_duration_ms, num_joins), 6) AS slope,
 round(regr_intercept(compile_duration_ms, num_joins), 6) AS intercept,
 round(regr_r2(compile_duration_ms, num_joins), 6) AS r2
FROM query_log WHERE query_type = 'select'
""")
def t1(log):
    return rounded(trend.ols(log), "slope", "intercept", "r2")


@query("t2_fit_linear", LINE + """
SELECT 'Linear' AS model, round(a, 6) AS a, round(b, 6) AS b, CAST(NULL AS DOUBLE) AS c,
 round(r2, 6) AS r2
FROM line, scored
""")
def t2(log):
    return rounded(trend.fit_linear(_points(log)), "a", "b", "r2")


@query("t3_fit_quadratic", PARABOLA + """
SELECT 'Quadratic' AS model, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c,
 round(r2, 6) AS r2
FROM curve, scored
""")
def t3(log):
    return rounded(trend.fit_quadratic(_points(log)), "a", "b", "c", "r2")


# Gauss-Newton from the log-linear start, a fixed number of steps.
EXPONENTIAL_STEPS = 60
EXPONENTIAL = POINTS + f"""
, steps AS (
 SELECT 0 AS i, exp(regr_intercept(ln(z), x)) AS a, regr_slope(ln(z), x) AS b
 FROM points WHERE z > 0
 UNION ALL
 SELECT i + 1, a + (ga * bb - gb * ab) / (aa * bb - ab * ab),
  b + (gb * aa - ga * ab) / (aa * bb - ab * ab)
 FROM (
  SELECT i, a, b, sum(e * e) AS aa, sum(e * a * x * e) AS ab, sum(a * x * e * a * x * e) AS bb,
   sum(e * (z - a * e)) AS ga, sum(a * x * e * (z - a * e)) AS gb
  FROM (SELECT i, a, b, x, z, exp(b * x) AS e FROM steps, points) GROUP BY i, a, b
 ) WHERE i < {EXPONENTIAL_STEPS}
)
, grown AS (SELECT a, b FROM steps WHERE i = {EXPONENTIAL_STEPS})
, scored AS (
 SELECT 1 - sum(pow(y - (exp(a * exp(b * x)) - 1), 2)) / regr_syy(y, y) AS r2 FROM points, grown
)
"""


def recursive(sql):
    return sql.replace("WITH query_log", "WITH RECURSIVE query_log", 1)


@table_query("t4_fit_exponential", recursive(log_sql(EXPONENTIAL + """
SELECT 'Exponential' AS model, round(a, 6) AS a, round(b, 6) AS b, CAST(NULL AS DOUBLE) AS c,
 round(r2, 6) AS r2
FROM grown, scored
""")))
def t4(spark, sf_dir):
    log = query_log(spark, sf_dir)
    return rounded(trend.fit_exponential(_points(log)), "a", "b", "r2")


@query("t5_r2_of_means", """
, means AS (SELECT query_type, avg(compile_duration_ms) AS y_hat FROM query_log GROUP BY 1)
SELECT round(1 - sum(pow(compile_duration_ms - y_hat, 2))
 / regr_syy(compile_duration_ms, compile_duration_ms), 6) AS r2
FROM query_log JOIN means USING (query_type)
""")
def t5(log):
    """How much of the compile time the query type explains."""
    means = log.groupBy("query_type").agg(
        F.avg("compile_duration_ms").alias("y_hat"), F.count("*").alias("n")
    )
    rows = join_unique(log.select("query_type", "compile_duration_ms"), means, ["query_type"], "n")
    return rounded(rows.agg(trend.r2(rows, "compile_duration_ms", "y_hat").alias("r2")), "r2")


def _named(sql, **names):
    """The CTEs of another fit, renamed so that several fit into one statement."""
    for old, new in names.items():
        sql = sql.replace(f"{old} AS (", f"{new} AS (").replace(f"FROM {old}", f"FROM {new}")
        sql = sql.replace(f", {old}\n", f", {new}\n")
    return sql


BEST = (
    _named(LINE, scored="line_score")
    + _named(PARABOLA.removeprefix(POINTS), scored="curve_score")
    + _named(EXPONENTIAL.removeprefix(POINTS), scored="grown_score")
)


@table_query("t6_best_fit", recursive(log_sql(BEST + """
, fits AS (
 SELECT 1 AS o, 'Linear' AS model, a, b, CAST(NULL AS DOUBLE) AS c, r2 FROM line, line_score
 UNION ALL SELECT 2, 'Quadratic', a, b, c, r2 FROM curve, curve_score
 UNION ALL SELECT 3, 'Exponential', a, b, NULL, r2 FROM grown, grown_score
)
SELECT model, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(r2, 6) AS r2
FROM fits ORDER BY fits.r2 DESC, o LIMIT 1
""")))
def t6(spark, sf_dir):
    log = query_log(spark, sf_dir)
    return rounded(trend.best_fit(_points(log)), "a", "b", "c", "r2")
