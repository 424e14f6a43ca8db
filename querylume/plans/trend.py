"""Trend fits as Spark aggregates.

``ols`` runs on raw rows. The others take the summary with one row per join count
(columns ``x``, ``y``), fit ``log1p(y)`` and score the fit on the original scale.
Each returns one row: model, coefficients ``a``, ``b``, ``c`` and ``r2``. A fit reads
its points several times, so pass a stored summary or a persisted frame, not a lazy
one over a whole log.
"""

from functools import partial

from pyspark.sql import DataFrame, functions as F

from querylume.functions.numbers import log_scale, safe_ratio, unlog_scale
from querylume.operators.filters import of_type, present

# Model names in the order that settles equal scores.
MODELS = ["Linear", "Quadratic", "Exponential"]


def ols(df: DataFrame, x="num_joins", y="compile_duration_ms", query_type="select") -> DataFrame:
    """Least-squares line through the raw rows of one query type."""
    rows = present(of_type(df, query_type), x, y)
    return rows.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def _points(df):
    known = present(df, "x", "y").select(F.col("x").cast("double"), F.col("y").cast("double"))
    return known.withColumn("z", log_scale(F.col("y")))


def r2(df: DataFrame, y="y", y_hat="y_hat"):
    """``1 - SSE/SST`` as an aggregate; null when ``y`` does not vary."""
    sse = F.sum(F.pow(F.col(y) - F.col(y_hat), 2))
    return 1 - safe_ratio(sse, F.regr_syy(F.col(y), F.col(y)))


def _scored(points, model, coefficients, curve):
    """One row for a model. ``coefficients`` is a one-row frame a, b, c; it is
    attached to the points as scalar subqueries."""
    fitted = points
    for name in ("a", "b", "c"):
        fitted = fitted.withColumn(f"_{name}", coefficients.select(name).scalar())
    fitted = fitted.withColumn("y_hat", unlog_scale(curve))
    return fitted.agg(
        F.lit(model).alias("model"),
        F.first("_a").alias("a"),
        F.first("_b").alias("b"),
        F.first("_c").alias("c"),
        r2(fitted).alias("r2"),
    )


def fit_linear(df: DataFrame) -> DataFrame:
    """``log1p(y) = a*x + b``."""
    points = _points(df)
    solved = points.agg(
        F.regr_slope("z", "x").alias("a"),
        F.regr_intercept("z", "x").alias("b"),
        F.lit(None).cast("double").alias("c"),
    )
    return _scored(points, "Linear", solved, F.col("_a") * F.col("x") + F.col("_b"))


def fit_quadratic(df: DataFrame) -> DataFrame:
    """``log1p(y) = a*x^2 + b*x + c`` from moment sums about the mean of ``x``."""
    points = _points(df)
    centre = points.agg(F.avg("x")).scalar()
    u, z = F.col("u"), F.col("z")
    sums = points.withColumn("m", centre).withColumn("u", F.col("x") - F.col("m")).agg(
        F.first("m").alias("m"),
        F.count("u").cast("double").alias("s0"),
        *[F.sum(F.pow(u, p)).alias(f"s{p}") for p in (1, 2, 3, 4)],
        *[F.sum(F.pow(u, p) * z).alias(f"t{p}") for p in (0, 1, 2)],
    )

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    s = [F.col(f"s{p}") for p in range(5)]
    rows = [[s[4], s[3], s[2]], [s[3], s[2], s[1]], [s[2], s[1], s[0]]]
    t = [F.col("t2"), F.col("t1"), F.col("t0")]
    base = det(rows)
    p, q, r = [
        F.try_divide(det([[*row[:j], t[i], *row[j + 1:]] for i, row in enumerate(rows)]), base)
        for j in range(3)
    ]
    m = F.col("m")
    # Back from u = x - m to x.
    solved = sums.select(
        p.alias("a"), (q - 2 * p * m).alias("b"), (p * m * m - q * m + r).alias("c")
    )
    x = F.col("x")
    return _scored(
        points, "Quadratic", solved, F.col("_a") * x * x + F.col("_b") * x + F.col("_c")
    )


def fit_exponential(df: DataFrame, max_iter=100, tolerance=1e-12) -> DataFrame:
    """``log1p(y) = a*exp(b*x)`` by damped Gauss-Newton, inside one plan.

    The points are brought down to one line per distinct ``x`` first, a number of joins, of
    which there are few however long the log is. The steps are a fold over the numbers 1 to
    ``max_iter``: each computes its sums from these lines, and one that does not lower the
    error is tried again with more damping.
    Null coefficients if no start exists, the error is not finite, or ``max_iter`` steps
    do not settle it: a point on the way is no fit.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    log_z = F.when(z > 0, F.log(z))
    lines = _points(df).groupBy("x").agg(
        F.count("*").cast("double").alias("n"), F.avg(z).alias("z"), F.avg(y).alias("y"),
        (F.var_pop(z) * F.count("*")).alias("z_within"), (F.var_pop(y) * F.count("*")).alias("y_within"),
        F.count(log_z).alias("m"), F.sum(log_z).alias("l"),
    )
    n = F.col("n")
    all_lines = lines.agg(
        F.collect_list(F.struct("x", "n", "z", "y")).alias("points"),
        F.coalesce(F.sum("z_within"), F.lit(0.0)).alias("z_within"), F.sum("y_within").alias("y_within"),
        F.sum(n * z * z).alias("scale"), (F.sum(n * y * y) - F.sum(n * y) * F.sum(n * y) / F.sum(n)).alias("syy_means"),
        F.sum("m").cast("double").alias("m"), F.sum(F.col("m") * x).alias("mx"),
        F.sum(F.col("m") * x * x).alias("mxx"), F.sum("l").alias("l"), F.sum(F.col("l") * x).alias("lx"),
    )
    slope = F.try_divide(
        F.col("m") * F.col("lx") - F.col("mx") * F.col("l"), F.col("m") * F.col("mxx") - F.col("mx") * F.col("mx"))
    started = all_lines.withColumn("b0", slope).withColumn(
        "a0", F.exp(F.try_divide(F.col("l") - F.col("b0") * F.col("mx"), F.col("m"))))
    first = started.withColumn("now", _newton_sums(F.col("points"), F.col("a0"), F.col("b0")))
    state = F.struct(
        F.col("a0").alias("a"), F.col("b0").alias("b"), F.lit(1e-3).alias("damping"), F.col("now").alias("now"),
        F.when(_finite(F.col("now")), RUNNING).otherwise(FAILED).alias("status"))
    step = partial(_newton_step, points=F.col("points"), within=F.col("z_within"), scale=F.col("scale"),
                   tolerance=tolerance)
    solved = first.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), state, lambda s, _: step(s)))
    settled = F.col("end.status") == SETTLED
    found = solved.select(
        "points", "y_within", "syy_means", F.when(settled, F.col("end.a")).alias("a"),
        F.when(settled, F.col("end.b")).alias("b"))
    off = F.aggregate("points", F.lit(0.0), lambda total, p: total + p["n"] * F.pow(
        p["y"] - unlog_scale(F.col("a") * F.exp(F.col("b") * p["x"])), 2))
    score = 1 - safe_ratio(off + F.col("y_within"), F.col("syy_means") + F.col("y_within"))
    return found.select(
        F.lit("Exponential").alias("model"), "a", "b", F.lit(None).cast("double").alias("c"),
        F.when(F.col("a").isNotNull(), score).alias("r2"))


RUNNING, SETTLED, FAILED = 0, 1, 2
_SUMS = ("sse", "aa", "ab", "bb", "ga", "gb")


def _let(value, use):
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _finite(sums):
    known = None
    for c in _SUMS:
        one = sums[c].isNotNull() & ~F.isnan(sums[c]) & (F.abs(sums[c]) < F.lit(float("inf")))
        known = one if known is None else known & one
    return known


def _newton_sums(points, a, b):
    """Sums for one step at (a, b). The part of the error that no curve through one value
    per ``x`` can change is left out."""
    def added(total, p):
        def with_growth(g):
            miss, slope = p["z"] - a * g, a * p["x"] * g
            terms = (miss * miss, g * g, g * slope, slope * slope, g * miss, slope * miss)
            return F.struct(*((total[c] + p["n"] * t).alias(c) for c, t in zip(_SUMS, terms)))
        return _let(F.exp(b * p["x"]), with_growth)

    zero = F.struct(*(F.lit(0.0).alias(c) for c in _SUMS))
    return F.aggregate(points, zero, added)


def _newton_step(s, points, within, scale, tolerance):
    """The state after one more step: coefficients, damping, sums and whether it is over."""
    now, damping = s["now"], s["damping"]

    def state(a, b, damping, now, status):
        return F.struct(a.alias("a"), b.alias("b"), damping.alias("damping"), now.alias("now"), status.alias("status"))

    def tried(t):
        worse = ~_finite(t["sums"]) | (t["sums"]["sse"] > now["sse"])
        gained = now["sse"] - t["sums"]["sse"]
        enough = gained <= tolerance * F.greatest(now["sse"] + within, tolerance * scale)
        # No step, however small, lowers the error: settled too.
        kept = state(s["a"], s["b"], damping * 10, now, F.when(damping * 10 > 1e12, SETTLED).otherwise(RUNNING))
        moved = state(t["a"], t["b"], damping / 10, t["sums"], F.when(enough, SETTLED).otherwise(RUNNING))
        return F.when(worse, kept).otherwise(moved)

    def solved(e):
        a = s["a"] + F.try_divide(now["ga"] * e["bb"] - now["gb"] * now["ab"], e["det"])
        b = s["b"] + F.try_divide(now["gb"] * e["aa"] - now["ga"] * now["ab"], e["det"])
        step = _let(F.struct(a.alias("a"), b.alias("b")), lambda c: F.struct(
            c["a"].alias("a"), c["b"].alias("b"), _newton_sums(points, c["a"], c["b"]).alias("sums")))
        flat = F.when((now["ga"] == 0) & (now["gb"] == 0), SETTLED).otherwise(FAILED)
        return F.when(e["det"] == 0, state(s["a"], s["b"], damping, now, flat)).otherwise(_let(step, tried))

    damped = F.struct((now["aa"] * (1 + damping)).alias("aa"), (now["bb"] * (1 + damping)).alias("bb"))
    equations = _let(damped, lambda d: F.struct(
        d["aa"].alias("aa"), d["bb"].alias("bb"), (d["aa"] * d["bb"] - now["ab"] * now["ab"]).alias("det")))
    return F.when(s["status"] != RUNNING, s).otherwise(_let(equations, solved))


def all_fits(df: DataFrame) -> DataFrame:
    """The three models, one row each, with their place in the tie order."""
    fits = fit_linear(df).unionByName(fit_quadratic(df)).unionByName(fit_exponential(df))
    names = F.array(*[F.lit(m) for m in MODELS])
    return fits.withColumn("model_order", F.array_position(names, F.col("model")).cast("int"))


def best_fit(df: DataFrame) -> DataFrame:
    """The model with the highest ``r2``; a model that could not be fitted ranks
    last, and when none could, the model is null."""
    score = F.nanvl(F.col("r2"), F.lit(None).cast("double"))
    best = (
        all_fits(df).withColumn("r2", score)
        .orderBy(F.desc_nulls_last("r2"), "model_order").limit(1)
    )
    fitted = F.col("r2").isNotNull()
    return best.select(
        F.when(fitted, F.col("model")).alias("model"), "a", "b", "c", "r2"
    )
