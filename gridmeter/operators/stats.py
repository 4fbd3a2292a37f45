"""Histograms, box-plot statistics, regressions and tests.

Every statistic is a grouped aggregate; where rows need a group statistic
(quantile caps, whiskers, bin edges) the per-group result -- one row per
group -- is joined back.  Bins follow ``np.histogram``: bin i holds
``edge_i <= x < edge_{i+1}``, the last bin also holds ``x == hi``; edges are
``lo + i*step`` (``np.linspace``) and the first guess ``floor((x-lo)/step)``
is corrected by one against those edges, so floating point cannot move a
value across an edge.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import _c, ordered_bits
from ..session import materialize as _materialize


# ------------------------------------------------------------------ binning
def _edge(i: Column, lo, step, bins, hi) -> Column:
    return F.when(i >= bins, hi).otherwise(i.cast("double") * step + lo)


def bin_index(x, lo, hi, bins: int) -> Column:
    """0-based ``np.histogram`` bin of ``x`` on ``linspace(lo, hi, bins+1)``;
    NULL outside ``[lo, hi]``.  ``lo``/``hi`` may be literals or columns."""
    x = _c(x)
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    step = (hi_c - lo_c) / F.lit(float(bins))
    i0 = F.floor((x - lo_c) / step)
    i1 = (F.when(x < _edge(i0, lo_c, step, bins, hi_c), i0 - 1)
           .when(x >= _edge(i0 + 1, lo_c, step, bins, hi_c), i0 + 1)
           .otherwise(i0))
    i2 = F.when(x == hi_c, F.lit(bins - 1)).otherwise(F.least(i1, F.lit(bins - 1)))
    return F.when((x >= lo_c) & (x <= hi_c), i2.cast("int"))


def sql_bin_index(x: str, lo: str, hi: str, bins: int) -> str:
    """SQL text of :func:`bin_index` (DuckDB)."""
    step = f"(({hi}) - ({lo})) / {float(bins)}"
    i0 = f"CAST(floor((({x}) - ({lo})) / ({step})) AS BIGINT)"

    def edge(i):
        return f"(CASE WHEN ({i}) >= {bins} THEN ({hi}) ELSE CAST({i} AS DOUBLE) * ({step}) + ({lo}) END)"
    i1 = (f"(CASE WHEN ({x}) < {edge(i0)} THEN {i0} - 1 "
          f"WHEN ({x}) >= {edge(i0 + ' + 1')} THEN {i0} + 1 ELSE {i0} END)")
    return (f"(CASE WHEN ({x}) >= ({lo}) AND ({x}) <= ({hi}) THEN CAST("
            f"CASE WHEN ({x}) = ({hi}) THEN {bins - 1} ELSE least({i1}, {bins - 1}) END AS INTEGER) END)")


def bin_centers(lo: float, hi: float, bins: int):
    step = (hi - lo) / bins
    edges = [i * step + lo for i in range(bins)] + [hi]
    return [(edges[i] + edges[i + 1]) / 2 for i in range(bins)]


def _spine(spark, n: int, series=None) -> DataFrame:
    """Dense bin spine (J16): ``n`` bins, optionally for every series name."""
    s = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    if series is not None:
        s = s.select("bin", F.explode(F.array(*[F.lit(x) for x in series])).alias("series"))
    return s


def histogram(df: DataFrame, cols, lo: float, hi: float, bins: int) -> DataFrame:
    """Dense 1-D histograms of several columns (H1, A13): series, bin,
    bin_center, count (0 for empty bins)."""
    cols = list(cols)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"),
                                                  F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("_s")).select("_s.*")
    counts = (long.select("series", bin_index("x", lo, hi, bins).alias("bin"))
                  .where(F.col("bin").isNotNull())
                  .groupBy("series", "bin").agg(F.count(F.lit(1)).alias("count")))
    centers = F.array(*[F.lit(c) for c in bin_centers(lo, hi, bins)])
    spine = _spine(df.sparkSession, bins, cols)
    return (spine.join(counts, ["series", "bin"], "left")
                 .select("series", "bin", centers[F.col("bin")].alias("bin_center"),
                         F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histogram2d(df: DataFrame, x: str, y: str, xr, yr) -> DataFrame:
    """Sparse 2-D histogram (H2, A14): x_bin, y_bin, centres, count > 0.
    ``xr``/``yr`` are ``(lo, hi, bins)``."""
    xc = F.array(*[F.lit(c) for c in bin_centers(*xr)])
    yc = F.array(*[F.lit(c) for c in bin_centers(*yr)])
    b = df.select(bin_index(x, *xr).alias("x_bin"), bin_index(y, *yr).alias("y_bin"))
    return (b.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
             .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))
             .select("x_bin", "y_bin", xc[F.col("x_bin")].alias("x_bin_center"),
                     yc[F.col("y_bin")].alias("y_bin_center"), "count"))


def hist_density(hist: DataFrame, width: float) -> DataFrame:
    """Density ``n/(N*width)`` and weighted mean per series from binned counts."""
    tot = hist.groupBy("series").agg(
        F.sum("count").alias("total"),
        F.try_divide(F.sum(F.col("bin_center") * F.col("count")), F.sum("count")).alias("series_mean"))
    return (hist.join(tot, "series", "inner")
                .withColumn("density", F.try_divide(F.col("count"), F.col("total") * F.lit(width))))


def log_histogram(df: DataFrame, value: str, by: str, cls: str, bins: int = 49,
                  q_lo: float = 0.01, q_hi: float = 0.99, floor_lo: float = 1e-3,
                  exclude_classes=()) -> DataFrame:
    """Log-spaced density histograms of ``value`` per (by, class) (H3).

    Per ``by`` group: edges ``logspace(log10(max(q01, floor)), log10(q99), bins+1)``
    over the group's rows (after dropping ``exclude_classes``); per class:
    counts of in-range values, density ``n/(N_in*width)`` and the class mean.
    The end edges are pinned to the two quantiles exactly.
    """
    d = df.where(~F.col(cls).isin(list(exclude_classes))) if exclude_classes else df
    vc = value_counts(d, value, [by, cls])
    q = quantiles_of_counts(vc, [by], [q_lo, q_hi])
    q = q.select(by, F.greatest("q0", F.lit(floor_lo)).alias("lo"), F.col("q1").alias("hi"))
    # a group whose quantiles coincide keeps its bins, all of width 0
    q = q.withColumn("hi", F.greatest("lo", "hi"))
    a, b = F.log10("lo"), F.log10("hi")
    step = (b - a) / F.lit(float(bins))

    def edge(i):
        return (F.when(i <= 0, F.col("lo")).when(i >= bins, F.col("hi"))
                 .otherwise(F.least(F.greatest(F.pow(F.lit(10.0), i.cast("double") * step + a), F.col("lo")), F.col("hi"))))
    x = F.col("_x")
    i0 = F.floor(F.try_divide(F.log10(x) - a, step))
    i1 = F.when(x < edge(i0), i0 - 1).when(x >= edge(i0 + 1), i0 + 1).otherwise(i0)
    binc = F.when((x >= F.col("lo")) & (x <= F.col("hi")),
                  F.when(x == F.col("hi"), F.lit(bins - 1))
                   .otherwise(F.least(F.greatest(i1, F.lit(0)), F.lit(bins - 1))).cast("int"))
    # one row for each filled bin, the values out of range in one without a bin
    filled = (_with_group(vc, q, [by]).withColumn("bin", binc).groupBy(by, cls, "bin", "lo", "hi")
              .agg(F.sum("_c").alias("count"), F.sum(x * F.col("_c")).alias("_sum")))
    inside = F.col("bin").isNotNull()
    groups = filled.groupBy(by, cls, "lo", "hi").agg(
        F.sum("count").alias("n_class"), F.coalesce(F.sum(F.when(inside, F.col("count"))), F.lit(0)).alias("n_in_range"),
        (F.sum("_sum") / F.sum("count")).alias("class_mean"),
        F.map_from_entries(F.collect_list(F.when(inside, F.struct("bin", "count")))).alias("_bins"))
    out = (groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
                 .withColumn("count", F.coalesce(F.try_element_at("_bins", F.col("bin")), F.lit(0)).cast("long"))
                 .withColumn("edge_lo", edge(F.col("bin")))
                 .withColumn("edge_hi", edge(F.col("bin") + 1)))
    dens = F.when(F.col("n_in_range") > 0,
                  F.try_divide(F.col("count"), F.col("n_in_range") * (F.col("edge_hi") - F.col("edge_lo"))))
    return out.select(by, cls, "bin", "edge_lo", "edge_hi", "count", dens.alias("density"),
                      "class_mean", "n_class")


def clipped_histogram(df: DataFrame, value: str, by: str, bins: int = 60,
                      q_lo: float = 0.01, q_hi: float = 0.99) -> DataFrame:
    """Values clipped to the group's [q01, q99] and put in equal bins, empty
    bins included (H4, J16)."""
    vc = value_counts(df, value, [by])
    q = quantiles_of_counts(vc, [by], [q_lo, q_hi]).select(by, F.col("q0").alias("lo"), F.col("q1").alias("hi"))
    clipped = F.least(F.greatest(F.col("_x"), F.col("lo")), F.col("hi"))
    i = F.when(F.col("hi") > F.col("lo"), bin_index(clipped, F.col("lo"), F.col("hi"), bins)).otherwise(F.lit(0))
    n = _with_group(vc, q, [by]).groupBy(by, i.alias("bin")).agg(F.sum("_c").alias("count"))
    n = n.withColumnsRenamed({by: "_by", "bin": "_bin"})
    spine = q.select(by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = F.col("bin").cast("double") * ((F.col("hi") - F.col("lo")) / F.lit(float(bins))) + F.col("lo")
    return (spine.join(n, [spine[by].eqNullSafe(n["_by"]), spine["bin"] == n["_bin"]], "left")
                 .select(by, "bin", edge.alias("edge_lo"), F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ------------------------------------------------------------------ box plots
def boxplot_stats(df: DataFrame, value: str, by) -> DataFrame:
    """q1, median, q3, whiskers (most extreme data within 1.5 IQR), n,
    outlier count per group (H5, A6, O3)."""
    by = list(by)
    vc = value_counts(df, value, by)
    q = quantiles_of_counts(vc, by, [0.25, 0.5, 0.75])
    q = q.select(*by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col("_x")
    # the quartiles ride along as keys, so nothing is joined back
    return (_with_group(vc, q, by)
            .groupBy(*by, "n", "q1", "median", "q3")
            .agg(F.min(F.when(x >= lo, x)).alias("whisker_lo"),
                 F.max(F.when(x <= hi, x)).alias("whisker_hi"),
                 F.sum(F.when((x < lo) | (x > hi), F.col("_c")).otherwise(0)).alias("n_outliers")))


def boxplot_outliers(df: DataFrame, value: str, by, id_col: str) -> DataFrame:
    """Rows outside the whiskers (the box plot's fliers)."""
    by = list(by)
    s = boxplot_stats(df, value, by).select(*by, "whisker_lo", "whisker_hi")
    j = _with_group(df.where(F.col(value).isNotNull()), s, by)
    return (j.where((F.col(value) < F.col("whisker_lo")) | (F.col(value) > F.col("whisker_hi")))
             .select(*by, id_col, value))


def describe(df: DataFrame, value: str, by, percentiles=(0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """pandas ``describe(percentiles=...)`` per group."""
    by = list(by)
    ps = list(percentiles)
    vc = value_counts(df, value, by)
    g = _with_group(quantiles_of_counts(vc, by, ps), moments_of_counts(vc, by).withColumnRenamed("n", "count"), by)
    return g.select(*by, "count", "mean", "std", "min",
                    *[F.col(f"q{i}").alias(f"p{int(round(p * 100))}") for i, p in enumerate(ps)], "max")


# ------------------------------------------------------------------ regressions
def group_slopes(df: DataFrame, y: str, x: str, by, min_n: int = 3) -> DataFrame:
    """OLS slope per group, NULL with fewer than ``min_n`` rows or constant x."""
    return (df.groupBy(*by)
              .agg(F.count(F.lit(1)).alias("n"),
                   F.when(F.count(F.lit(1)) >= min_n, F.regr_slope(y, x)).alias("slope")))


def one_sample_t(df: DataFrame, value: str, by) -> DataFrame:
    """One-sample t statistic vs 0 per group: n, mean, sd, t, df (R2)."""
    v = F.col(value)
    return (df.where(v.isNotNull()).groupBy(*by)
              .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
              .withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
              .withColumn("dof", (F.col("n") - 1).cast("long")))


#: intervals of the integration in :func:`t_pvalue`
T_STEPS = 4000


def t_pvalue(t, dof) -> Column:
    """Two-sided p-value of Student's t (native).

    With ``t = sqrt(dof) tan(a)`` the density becomes ``cos(a)^(dof-1)``; the
    p-value is one minus its integral up to ``|t|`` over that of the whole,
    both by Simpson's rule.  From 30 degrees of freedom on the whole ends at
    t = 40, beyond which there is less than 1e-27.
    """
    t, dof = F.abs(_c(t)), _c(dof).cast("double")
    end = F.when(dof < 30, F.lit(math.pi / 2)).otherwise(F.atan(F.lit(40.0) / F.sqrt(dof)))
    at = F.least(F.atan(t / F.sqrt(dof)), end)

    def area(upto):
        weight = lambda i: F.when((i == 0) | (i == T_STEPS), 1.0).otherwise(2.0 + 2.0 * F.pmod(i, F.lit(2)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(T_STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(
            F.greatest(F.cos(i * upto / F.lit(float(T_STEPS))), F.lit(0.0)), dof - 1)) * upto
    # least() and greatest() pass over NULL, so a NULL t has to be told apart
    return F.when((dof > 0) & t.isNotNull(), F.greatest(1 - area(at) / area(end), F.lit(0.0)))


def sql_t_pvalue(t: str, dof: str) -> str:
    """SQL text of :func:`t_pvalue` (DuckDB)."""
    end = f"(CASE WHEN {dof} < 30 THEN {math.pi / 2!r} ELSE atan(40.0 / sqrt({dof})) END)"
    at = f"least(atan(abs({t}) / sqrt({dof})), {end})"

    def area(upto):
        return (f"(list_sum(list_transform(range(0, {T_STEPS + 1}), lambda i: (CASE WHEN i IN (0, {T_STEPS}) THEN 1.0 ELSE 2.0 + 2.0 * (i % 2) END)"
                f" * pow(greatest(cos(i * {upto} / {float(T_STEPS)}::DOUBLE), 0.0::DOUBLE), {dof} - 1.0))) * {upto})")
    return f"(CASE WHEN {dof} > 0 AND {t} IS NOT NULL THEN greatest(1 - {area(at)} / {area(end)}, 0.0) END)"


def linear_fit(df: DataFrame, y: str, xs: dict, min_n: int = 2) -> DataFrame:
    """Slope and intercept of ``y`` against each x (name -> column or
    expression), NULL pairs dropped, >= ``min_n`` points (R3)."""
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("variable"), (_c(v)).cast("double").alias("_x"))
        for k, v in xs.items()])).alias("_s")).select("_y", "_s.*")
    long = long.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    return (long.groupBy("variable")
                .agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"),
                     F.regr_intercept("_y", "_x").alias("intercept"))
                .where(F.col("n") >= min_n))


# ------------------------------------------------------------------ exact quantiles at scale
#: distinct values of a bucket that one task may order
FEW = 200_000
#: bits by which a refinement splits a bucket
DIGIT = 16


def value_counts(df: DataFrame, value: str, by) -> DataFrame:
    """The written frame (by, _x, _b, _c): how often each group holds each
    value, and the value's bits in order.  NULL values are left out, NULL keys
    are a group.  A value that most rows share is one row."""
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    c = d.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    return _materialize(c.withColumn("_b", ordered_bits("_x")), "value-counts")


def _steps(probs):
    """For each probability the ranks around ``h = (n-1)p``, and ``h`` (over column ``n``)."""
    h = [(F.col("n") - 1).cast("double") * F.lit(p) for p in probs]
    return [(F.floor(x), F.ceil(x), x) for x in h]


def _rank_buckets(v: DataFrame, probs, few: int):
    """Radix selection: (_k, _p, _below, n) of the buckets that hold a wanted
    rank, and the shift that gives ``_p`` from ``_b``.

    Values are counted by the top digit of their bits; running totals over a
    group's buckets (at most 2^DIGIT rows) say which hold a rank, and only
    those are split by the next digit, until none has over ``few`` rows.
    """
    shift = 64 - DIGIT
    upto = lambda *k: Window.partitionBy(*k).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    wanted = functools.reduce(lambda a, b: a | b, [(F.col("_below") <= r) & (r < F.col("_below") + F.col("_t"))
                                                   for lo, hi, _ in _steps(probs) for r in (lo, hi)])
    c = v.groupBy("_k", F.shiftright("_b", shift).alias("_p")).agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_v"))
    c = c.withColumn("n", F.sum("_t").over(Window.partitionBy("_k"))) \
         .withColumn("_below", F.coalesce(F.sum("_t").over(upto("_k")), F.lit(0)))
    while True:
        found = _materialize(c.where(wanted).select("_k", "_p", "_below", "n", "_v"), "rank-buckets")
        most = found.agg(F.max("_v")).first()[0]
        if not shift or not most or most <= few:
            return found.drop("_v"), shift
        at = found.select("_k", F.col("_p").alias("_q"), F.col("_below").alias("_start"), "n")
        c = v.withColumn("_q", F.shiftright("_b", shift)).join(at, ["_k", "_q"])
        shift -= DIGIT
        c = c.groupBy("_k", "_q", "_start", "n", F.shiftright("_b", shift).alias("_p")) \
             .agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_v"))
        c = c.withColumn("_below", F.col("_start") + F.coalesce(F.sum("_t").over(upto("_k", "_q")), F.lit(0)))


def quantiles_of_counts(vc: DataFrame, by, probs, few: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles from value counts: ``by``, ``n``
    and ``q0, q1, ...`` (one per probability), without a task that orders
    over ``few`` values (``FEW``).

    ``vc`` is a written frame (by, _x, _b, _c); a group may hold a value in
    several rows, so counts by finer groups will do.  With few rows in all a
    group's values are ordered as they are; else only the buckets that
    :func:`_rank_buckets` finds.
    """
    few, probs = few or FEW, [float(p) for p in probs]
    v = vc.select(F.struct(*by).alias("_k"), "_x", "_b", "_c")
    if vc.count() <= few:
        keys = ["_k"]
        v = v.withColumn("n", F.sum("_c").over(Window.partitionBy("_k"))).withColumn("_below", F.lit(0))
    else:
        keys = ["_k", "_p"]
        found, shift = _rank_buckets(v, probs, few)
        v = v.withColumn("_p", F.shiftright("_b", shift)).join(found, keys)
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("_end", F.col("_below") + F.sum("_c").over(order))
    at = lambda r: F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_x")))
    steps = _steps(probs)
    g = v.groupBy("_k", "n").agg(*[at(r).alias(f"_{side}{i}") for i, s in enumerate(steps) for side, r in zip(("lo", "hi"), s)])
    up = [h - F.floor(h) for _, _, h in steps]
    return g.select("_k.*", "n", *[F.when(u == 0, F.col(f"_lo{i}")).otherwise(F.col(f"_lo{i}") * (1 - u) + F.col(f"_hi{i}") * u).alias(f"q{i}")
                                   for i, u in enumerate(up)])


def moments_of_counts(vc: DataFrame, by) -> DataFrame:
    """n, mean, std (sample), min, max of each group from value counts."""
    by = list(by)
    m = vc.groupBy(*by).agg(F.sum("_c").alias("n"), (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean"),
                            F.min("_x").alias("min"), F.max("_x").alias("max"))
    apart = F.col("_x") - F.col("mean")
    return (_with_group(vc, m, by).groupBy(*by, "n", "mean", "min", "max")
            .agg(F.sqrt(F.try_divide(F.sum(apart * apart * F.col("_c")), F.col("n") - 1)).alias("std")))


def exact_quantiles(df: DataFrame, value: str, by, probs) -> DataFrame:
    """Exact linearly interpolated quantiles per group (H-1): ``by``, ``n`` and
    ``q0, q1, ...``.  The input is read once, for its value counts."""
    return quantiles_of_counts(value_counts(df, value, by), by, probs)


def _with_group(df: DataFrame, groups: DataFrame, by) -> DataFrame:
    """Attach per-group columns to the rows of each group, NULL keys included."""
    g = groups.withColumnsRenamed({k: f"_g_{k}" for k in by})
    on = [df[k].eqNullSafe(g[f"_g_{k}"]) for k in by]
    return df.join(g, on, "inner").drop(*[f"_g_{k}" for k in by])
