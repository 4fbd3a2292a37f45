"""LOWESS of small per-group curves (R4), as DataFrame aggregates.

A tenure curve holds at most one point per month since the first month, so a
curve is bounded by the number of months, not by the data size.  Cleveland's
locally weighted regression meets each point of a curve with all others of the
same curve: tricube weights over the k nearest, weighted sums, and ``iters``
rounds of bisquare robustness weights from the median residual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def lowess(df: DataFrame, by: str, x: str, y: str, frac: float = 0.2, iters: int = 3,
           min_points: int = 11) -> DataFrame:
    """Grouped LOWESS: (by, x, y, smooth) for groups with >= ``min_points``
    points (the reference smooths a curve only when it has more than 10)."""
    curve = Window.partitionBy("g")
    p = df.select(F.col(by).alias("g"), F.col(x).alias("x0"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = (p.withColumn("i", F.row_number().over(curve.orderBy("x", "y"))).withColumn("n", F.count(F.lit(1)).over(curve))
          .where(F.col("n") >= min_points))
    p = materialize(p, "curves")                   # one row per point
    near = F.least("n", F.greatest(F.floor(F.col("n") * F.lit(float(frac)) + F.lit(1e-10)), F.lit(2)))
    a = p.select("g", "i", F.col("x").alias("xi"), F.col("y").alias("yi"), near.alias("k"))
    b = p.select(F.col("g").alias("g2"), F.col("i").alias("j"), "x", "y")
    # places count from the point that is fitted, which keeps the sums small
    d = (a.join(b, F.col("g").eqNullSafe(F.col("g2"))).withColumn("x", F.col("x") - F.col("xi"))
          .withColumn("d", F.abs("x")))
    point = Window.partitionBy("g", "i")
    d = d.withColumn("r", F.row_number().over(point.orderBy("d", "j")))
    d = d.withColumn("h", F.max(F.when(F.col("r") == F.col("k"), F.col("d"))).over(point))
    u = F.least(F.try_divide("d", "h"), F.lit(1.0))
    d = d.withColumn("w", F.when(F.col("h") > 0, F.pow(1 - F.pow(u, F.lit(3.0)), F.lit(3.0)))
                           .otherwise(F.when(F.col("d") == 0, 1.0).otherwise(0.0)))
    trust = p.select(F.col("g").alias("gt"), F.col("i").alias("it"), F.lit(1.0).alias("rho"))
    for last in [False] * iters + [True]:
        q = d.join(trust, F.col("g").eqNullSafe(F.col("gt")) & (F.col("j") == F.col("it"))).withColumn("w", F.col("w") * F.col("rho"))
        s = q.groupBy("g", "i", "yi").agg(*[F.sum(F.col("w") * c).alias(k) for k, c in (
            ("sw", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")))])
        mx, my = F.try_divide("sx", "sw"), F.try_divide("sy", "sw")
        var = F.col("sxx") - F.col("sx") * mx
        flat = var <= F.greatest(F.col("sxx"), F.lit(1.0)) * F.lit(1e-12)
        line = my + F.try_divide(F.col("sxy") - F.col("sx") * my, var) * -mx
        fit = s.select("g", "i", "yi", F.when(F.col("sw") <= 0, F.col("yi")).when(flat, my).otherwise(line).alias("fit"))
        if last:
            break
        res = fit.join(trust, F.col("g").eqNullSafe(F.col("gt")) & (F.col("i") == F.col("it"))).select(
            "g", "i", "rho", F.abs(F.col("yi") - F.col("fit")).alias("e"))
        mid = res.groupBy(F.col("g").alias("gm")).agg(F.percentile("e", 0.5).alias("m"))
        v = F.least(F.try_divide(F.col("e"), F.col("m") * 6.0), F.lit(1.0))
        trust = (res.join(mid, F.col("g").eqNullSafe(F.col("gm")))
                    .select(F.col("g").alias("gt"), F.col("i").alias("it"),
                            F.when(F.col("m") > 0, F.pow(1 - v * v, F.lit(2.0))).otherwise(F.col("rho")).alias("rho")))
    f = fit.select(F.col("g").alias("gf"), F.col("i").alias("jf"), "fit")
    return (p.join(f, F.col("g").eqNullSafe(F.col("gf")) & (F.col("i") == F.col("jf")))
             .select(F.col("g").alias(by), F.col("x0").alias(x), F.col("y").alias(y), F.col("fit").alias("smooth")))


def sql_lowess(curve: str, by: str, x: str, y: str, frac: float = 0.2, iters: int = 3, min_points: int = 11) -> tuple[str, dict]:
    """SQL text of :func:`lowess` over the step ``curve`` (DuckDB): body and steps."""
    steps = {
        "lw_p": f"""SELECT * FROM (SELECT {by} AS g, {x} AS x0, {x}::DOUBLE AS x, {y}::DOUBLE AS y,
            row_number() OVER (PARTITION BY {by} ORDER BY {x}, {y}) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {curve}) WHERE n >= {min_points}""",
        "lw_d": f"""SELECT a.g, a.i, b.i AS j, a.y AS yi, b.x - a.x AS x, b.y, abs(b.x - a.x) AS d,
            least(a.n, greatest(floor(a.n * {float(frac)}::DOUBLE + 1e-10), 2)) AS k,
            row_number() OVER (PARTITION BY a.g, a.i ORDER BY abs(b.x - a.x), b.i) AS r
            FROM lw_p a JOIN lw_p b ON a.g IS NOT DISTINCT FROM b.g""",
        "lw_h": "SELECT *, max(CASE WHEN r = k THEN d END) OVER (PARTITION BY g, i) AS h FROM lw_d",
        "lw_w": """SELECT *, CASE WHEN h > 0 THEN pow(1 - pow(least(d / nullif(h, 0), 1.0), 3.0), 3.0)
            WHEN d = 0 THEN 1.0 ELSE 0.0 END AS w FROM lw_h""",
        "lw_t0": "SELECT g, i, 1.0::DOUBLE AS rho FROM lw_p",
    }
    for k in range(iters + 1):
        steps[f"lw_s{k}"] = f"""SELECT d.g, d.i, yi, sum(w * rho) AS sw, sum(w * rho * x) AS sx, sum(w * rho * y) AS sy,
            sum(w * rho * x * x) AS sxx, sum(w * rho * x * y) AS sxy
            FROM lw_w d JOIN lw_t{k} t ON t.g IS NOT DISTINCT FROM d.g AND t.i = d.j GROUP BY d.g, d.i, yi"""
        steps[f"lw_f{k}"] = f"""SELECT g, i, yi, CASE WHEN sw <= 0 THEN yi
            WHEN sxx - sx * (sx / sw) <= greatest(sxx, 1.0) * 1e-12 THEN sy / sw
            ELSE sy / sw + (sxy - sx * (sy / sw)) / (sxx - sx * (sx / sw)) * (-sx / sw) END AS fit FROM lw_s{k}"""
        if k < iters:
            steps[f"lw_m{k}"] = f"SELECT g, quantile_cont(abs(yi - fit), 0.5) AS m FROM lw_f{k} GROUP BY g"
            steps[f"lw_t{k + 1}"] = f"""SELECT f.g, f.i, CASE WHEN m > 0 THEN pow(1 - pow(least(abs(yi - fit) / (m * 6.0), 1.0), 2), 2.0) ELSE rho END AS rho
                FROM lw_f{k} f JOIN lw_m{k} m ON m.g IS NOT DISTINCT FROM f.g JOIN lw_t{k} t ON t.g IS NOT DISTINCT FROM f.g AND t.i = f.i"""
    body = f"SELECT p.g AS {by}, x0 AS {x}, p.y AS {y}, fit AS smooth FROM lw_p p JOIN lw_f{iters} f ON f.g IS NOT DISTINCT FROM p.g AND f.i = p.i"
    return body, steps
