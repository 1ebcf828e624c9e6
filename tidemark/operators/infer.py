"""Resampling inference, multiple testing, regressions and forecast evaluation.

Random picks are ``md5(seed:key:draw:slot)`` so a retried task, another engine or another run draws the same.
Bootstraps first reduce rows to clusters; what is exploded is draws x clusters, never draws x rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import normal_tail, student_two_sided
from ..session import DAY, materialize
from .asof import asof_backward, at_targets
from .ordered import exact_quantiles, ranks
from .scan import CHUNK, Run, own_rows, row_halo


def pick(n: Column, *parts: str | Column | int, digits: int = 8) -> Column:
    """Uniform integer in [0, n) from the md5 of the parts."""
    text = F.concat_ws(":", *[(F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint") % n


# -- multiple testing -------------------------------------------------------------------------------

def fdr(df: DataFrame, groups: Sequence[str], p: str, *, bh: str = "bh_q", by: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values (and Yekutieli's when ``by`` names a column); NULL p-values stay NULL.
    The rows are tests, one per hypothesis, so a family fits one task."""
    fam = Window.partitionBy(*groups, F.col(p).isNull())
    up = fam.orderBy(p, *tie)
    clipped = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0))
    d = df.withColumn("_m", F.count(p).over(fam)).withColumn("_r", F.row_number().over(up)).withColumn("_raw", clipped * F.col("_m") / F.col("_r"))
    down = fam.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(down), F.lit(1.0)))
    d = d.withColumn(bh, q)
    if by:
        harmonic = F.sum(1 / F.col("_r")).over(fam)
        d = d.withColumn(by, F.least(F.col(bh) * harmonic, F.lit(1.0)))
    return d.drop("_m", "_r", "_raw")


# -- cluster bootstrap ------------------------------------------------------------------------------

def _clusters(df: DataFrame, keys: list[str], cluster: str, aggs: dict[str, Column]) -> DataFrame:
    c = df.groupBy(*keys, cluster).agg(*[a.alias(n) for n, a in aggs.items()])
    w = Window.partitionBy(*keys)  # clusters (days, months) of one key
    return c.withColumn("_i", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("_k", F.count("*").over(w))


def _draws(clusters: DataFrame, keys: list[str], draws: int, seed: str, sums: Sequence[str], tag: str = "") -> DataFrame:
    """One row per (key, draw) with the resampled cluster sums."""
    per_key = clusters.where("_i = 0").select(*keys, "_k")
    slots = (per_key.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
             .withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))))
             .withColumn("_i", pick(F.col("_k"), f"{seed}{tag}", *[F.col(k) for k in keys], F.col("draw"), F.col("_slot")).cast("int")))
    return slots.join(clusters.select(*keys, "_i", *sums), [*keys, "_i"]).groupBy(*keys, "draw").agg(*[F.sum(s).alias(s) for s in sums])


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], *, value: str, cluster: str, draws: int, seed: str) -> DataFrame:
    """Mean with percentile interval and p-values from a mean-centred null, resampling whole clusters."""
    keys = list(keys)
    c = _clusters(df.where(F.col(value).isNotNull()), keys, cluster, {"_s": F.sum(value), "_n": F.count(value).cast("double")})
    w = Window.partitionBy(*keys)
    c = c.withColumn("_mean", F.sum("_s").over(w) / F.sum("_n").over(w)).withColumn("_z", F.col("_s") - F.col("_mean") * F.col("_n"))
    point = c.groupBy(*keys).agg(F.first("_mean").alias("mean"), F.sum("_n").cast("bigint").alias("n"), F.count("*").alias("clusters"))
    boot = _draws(c, keys, draws, seed, ["_s", "_n"]).groupBy(*keys).agg(
        F.percentile(F.col("_s") / F.col("_n"), F.lit(0.025)).alias("ci_low"), F.percentile(F.col("_s") / F.col("_n"), F.lit(0.975)).alias("ci_high"),
        ((1 + F.count_if(F.col("_s") / F.col("_n") <= 0)) / (draws + 1)).alias("p_mean_not_positive"))
    null = _draws(c, keys, draws, seed, ["_z", "_n"], "null").join(point.select(*keys, "mean"), keys)
    m = F.col("_z") / F.col("_n")
    ps = null.groupBy(*keys).agg(((1 + F.count_if(m >= F.col("mean"))) / (draws + 1)).alias("p_positive"),
                                 ((1 + F.count_if(F.abs(m) >= F.abs(F.col("mean")))) / (draws + 1)).alias("p_two_sided"))
    return point.join(boot, keys).join(ps, keys)


def cluster_bootstrap_diff(df: DataFrame, keys: Sequence[str], *, value: str, member: str, cluster: str, draws: int, seed: str,
                           other_only: bool = False) -> DataFrame:
    """Mean over members minus the mean over all rows (``other_only``: over the others), cluster resampled.
    Draws without a member are dropped."""
    keys = list(keys)
    v, inside = F.col(value), F.col(member)
    rest = ~inside if other_only else F.lit(True)
    c = _clusters(df.where(v.isNotNull()), keys, cluster, {
        "_ms": F.sum(F.when(inside, v).otherwise(0.0)), "_mn": F.sum(inside.cast("double")),
        "_os": F.sum(F.when(rest, v).otherwise(0.0)), "_on": F.sum(rest.cast("double"))})
    sums = ["_ms", "_mn", "_os", "_on"]
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    diff = ratio("_ms", "_mn") - ratio("_os", "_on")
    point = c.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("clusters")).select(
        *keys, "clusters", F.col("_mn").cast("bigint").alias("events"), diff.alias("diff"))
    d = _draws(c, keys, draws, seed, sums).withColumn("_d", diff)
    n = F.count("_d")
    two = 2 * F.least((1 + F.count_if(F.col("_d") <= 0)) / (n + 1), (1 + F.count_if(F.col("_d") >= 0)) / (n + 1))
    ci = d.groupBy(*keys).agg(F.percentile("_d", F.lit(0.025)).alias("ci_low"), F.percentile("_d", F.lit(0.975)).alias("ci_high"),
                              F.when(n > 0, F.least(two, F.lit(1.0))).alias("p_two_sided"),
                              F.when(n > 0, (1 + F.count_if(F.col("_d") <= 0)) / (n + 1)).alias("p_greater"))
    out = point.join(ci, keys, "left")
    alone = F.col("clusters") < 2 if other_only else F.lit(False)
    return out.select(*point.columns, *[F.when(~alone, F.col(c_)).alias(c_) for c_ in ("ci_low", "ci_high", "p_two_sided", "p_greater")])


# -- block bootstrap --------------------------------------------------------------------------------

def _draw_tasks(d: DataFrame, keys: list[str], order: str, columns: Sequence[str], draws: int, chunk: int = 50) -> DataFrame:
    """One row per key and ``chunk`` draws with the key's whole series as arrays in order (a daily or weekly series, so
    bounded by the calendar), spread over the cluster. Draws are made from the series where they are summed up; no row of a
    draw leaves its task."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    g = d.groupBy(*keys).agg(rows.alias("_rows"), F.concat_ws(":", *[F.first(k).cast("string") for k in keys]).alias("_name"))
    g = g.select(*keys, "_name", *[F.col(f"_rows.{c}").alias(f"_{c}") for c in columns])
    spread = g.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk))))
    return spread.repartition(max(1, min(256, 4 * draws // chunk)), *keys, "_first")


def _picks(texts: list[str], n: np.ndarray | int) -> np.ndarray:
    """``pick`` of many texts."""
    raw = np.frombuffer(b"".join([hashlib.md5(t.encode()).digest()[:4] for t in texts]), ">u4").astype(np.int64)
    return raw % n


def block_bootstrap(df: DataFrame, keys: Sequence[str], *, order: str, value: str, state: str | None = None, step: int = DAY, block: int,
                    draws: int, seed: str, segments: bool = True) -> DataFrame:
    """Mean per state with interval and a state-centred two-sided p, resampling circular blocks that never
    cross a calendar gap (``segments=False``: one circle over all rows). Keys are daily series.

    A block lands on a segment with probability proportional to its length (draw a row, take its segment). A draw is so many
    blocks; their sums are differences of the states' prefix sums over the circles, so a draw costs its blocks, not its rows.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(value).isNotNull() & (F.col(state).isNotNull() if state else F.lit(True)))
    gap = F.when(F.col(order) - F.lag(order).over(w) == step, 0).otherwise(1) if segments else F.when(F.row_number().over(w) == 1, 1).otherwise(0)
    d = d.select(*keys, order, F.col(value).cast("double").alias("v"), (F.col(state) if state else F.lit("all")).alias("s"), gap.alias("g"))
    tasks = _draw_tasks(d, keys, order, ["v", "s", "g"], draws)
    fields = [d.schema[k] for k in keys]

    def resample(name: str, v: np.ndarray, codes: np.ndarray, fresh: np.ndarray, states: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, centred sums, counts) of each draw and state."""
        n = len(v)
        begin = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        lengths = np.diff(np.r_[begin, n])
        own = codes[:, None] == np.arange(states)
        means = (own * v[:, None]).sum(0) / own.sum(0)
        values = np.stack([own * v[:, None], own * (v - means[codes])[:, None], own], axis=2).astype(float)
        prefix = np.concatenate([np.zeros((1, states, 3)), np.cumsum(values, axis=0)])
        some = max(1, -(-n // min(block, int(lengths.max()))))
        out = []
        for draw in range(first, min(first + 50, draws)):
            segment, start, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            while total < n:  # more blocks until the draw is as long as the series
                at = range(len(segment), len(segment) + some)
                more = of[_picks([f"{seed}:{name}:{draw}:{b}:seg" for b in at], n)]
                segment = np.r_[segment, more]
                start = np.r_[start, _picks([f"{seed}:{name}:{draw}:{b}:start" for b in at], lengths[more])]
                total = int(np.minimum(block, lengths[segment]).sum())
            width = np.minimum(block, lengths[segment])
            done = np.cumsum(width) - width
            used = done < n
            segment, start, width = segment[used], start[used], np.minimum(width, n - done)[used]
            low = begin[segment] + start
            end = low + width
            stop = begin[segment] + lengths[segment]
            over = np.maximum(end - stop, 0)  # what goes round the circle
            out.append((prefix[end - over] - prefix[low] + prefix[begin[segment] + over] - prefix[begin[segment]]).sum(0))
        got = np.array(out)
        return got[..., 0], got[..., 1], got[..., 2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                names, codes = np.unique(np.asarray(row["_s"], object).astype(str), return_inverse=True)
                sums, centred, counts = resample(row["_name"], np.asarray(row["_v"], float), codes, np.asarray(row["_g"], bool), len(names), int(row["_first"]))
                draw, code = np.nonzero(counts)
                n = counts[draw, code]
                yield pd.DataFrame({**{k: row[k] for k in keys}, "draw": draw + int(row["_first"]), "state": names[code], "_bm": sums[draw, code] / n, "_nm": centred[draw, code] / n})

    schema = T.StructType([*fields, *[T.StructField(c, t) for c, t in (("draw", T.LongType()), ("state", T.StringType()), ("_bm", T.DoubleType()), ("_nm", T.DoubleType()))]])
    means = tasks.mapInPandas(run, schema)
    point = d.groupBy(*keys, F.col("s").alias("state")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    j = means.join(point, [*keys, "state"])
    return j.groupBy(*keys, "state").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.percentile("_bm", F.lit(0.025)).alias("ci_low"), F.percentile("_bm", F.lit(0.975)).alias("ci_high"),
        F.stddev_samp("_bm").alias("draw_sd"),
        F.least((1 + F.count_if(F.abs("_nm") >= F.abs("mean"))) / (F.count("*") + 1), F.lit(1.0)).alias("p_value"), (F.count("*") / draws).alias("valid_draw_share"))


# -- random entries and permutations ----------------------------------------------------------------

def random_decisions(counts: DataFrame, bars: DataFrame, keys: Sequence[str], *, n: str, draws: int, start: int, end: int, seed: str,
                     width: int) -> DataFrame:
    """``n`` random times per key and draw, each mapped to the bar containing it (the first bar before any)."""
    keys = list(keys)
    u = (counts.where(F.col(n) > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
         .withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))))
         .withColumn("_t", F.lit(start) + pick(F.lit(end - start), seed, *[F.col(k) for k in keys], F.col("draw"), F.col("_slot"), digits=12)))
    first = bars.groupBy(*keys).agg(F.min("ts").alias("_first"))
    a = asof_backward(u.select(*keys, "draw", "_slot", "_t"), bars, by=keys, take=[], width=width, left_on="_t")
    return a.join(first, keys).select(*keys, "draw", "_slot", F.coalesce("source_ts", "_first").alias("ts"))


def null_percentile(real: DataFrame, null: DataFrame, keys: Sequence[str], *, value: str) -> DataFrame:
    """Where the real mean lies among the draws' means (0-100, strictly below) and the edge over their mean."""
    keys = list(keys)
    r = real.groupBy(*keys).agg(F.count(value).alias("n_events"), F.avg(value).alias("mean_bp"))
    m = null.groupBy(*keys, "draw").agg(F.avg(value).alias("_m")).where("_m IS NOT NULL")
    j = r.join(m, keys)
    return j.groupBy(*keys, "n_events", "mean_bp").agg((F.count_if(F.col("_m") < F.col("mean_bp")) / F.count("*") * 100).alias("null_percentile"),
                                                       (F.col("mean_bp") - F.avg("_m")).alias("edge_bp"))


def permute(df: DataFrame, keys: Sequence[str], signal: str, *, order: Sequence[str], draws: int, seed: str, within: Sequence[str] = ()) -> DataFrame:
    """``draws`` copies with ``signal`` shuffled inside (keys, within). Two numberings of the group, one by
    position and one by random key, are joined. Meant for daily or weekly panels."""
    g = [*keys, *within]
    pos = df.withColumn("_p", F.row_number().over(Window.partitionBy(*g).orderBy(*order)))
    many = pos.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in g], F.col("draw").cast("string"), F.col("_p").cast("string")))
    shuffled = many.select(*g, "draw", F.col(signal).alias("_s"), F.row_number().over(Window.partitionBy(*g, "draw").orderBy(u)).alias("_p"))
    return many.drop(signal).join(shuffled, [*g, "draw", "_p"]).withColumnRenamed("_s", signal).drop("_p")


def permuted_hac_t(df: DataFrame, keys: Sequence[str], *, y: str, x: str, order: str, lags: int, draws: int, seed: str) -> DataFrame:
    """(keys, n, t_hac, p_greater): HAC t of the slope of y on x, and the share of ``draws`` shuffles of x whose t is at least
    as large. Only the sums of a shuffle are kept; all shuffles of a task share the series."""
    keys = list(keys)
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, order, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    tasks = _draw_tasks(d, keys, order, ["y", "x"], draws)
    schema = T.StructType([*[d.schema[k] for k in keys], *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("t", T.DoubleType()), ("ge", T.LongType()), ("m", T.LongType()))]])

    def t_of(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        """HAC t of each row of ``xx`` (shuffles x time)."""
        n = len(yy)
        c = xx - xx.mean(1, keepdims=True)
        sxx = (c * c).sum(1)
        slope = (c @ yy) / sxx
        e = yy - yy.mean() - slope[:, None] * c
        z = c * e / sxx[:, None]
        var = (z * z).sum(1)
        for lag in range(1, min(lags, n - 1) + 1):
            var = var + 2 * (1 - lag / (lags + 1)) * (z[:, lag:] * z[:, :-lag]).sum(1)
        return np.where(var > 0, slope / np.sqrt(np.maximum(var, 1e-300)), np.nan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yy, xx = np.asarray(row["_y"], float), np.asarray(row["_x"], float)
                n, first = len(yy), int(row["_first"])
                here = range(first, min(first + 50, draws))
                head = f"{seed}:{row['_name']}:"
                turns = [sorted(range(n), key=[hashlib.md5(f"{head}{draw}:{i}".encode()).digest() for i in range(1, n + 1)].__getitem__) for draw in here]
                with np.errstate(all="ignore"):
                    real, null = t_of(yy, xx[None])[0], t_of(yy, xx[np.array(turns)])
                yield pd.DataFrame({**{k: [row[k]] for k in keys}, "n": [n], "t": [real], "ge": [int((null >= real).sum())], "m": [len(turns)]})

    g = tasks.mapInPandas(run, schema).groupBy(*keys).agg(F.first("n").alias("n"), F.first("t").alias("t_hac"), F.sum("ge").alias("_ge"), F.sum("m").alias("_m"))
    known = F.when(~F.isnan("t_hac"), F.col("t_hac"))
    return g.select(*keys, "n", known.alias("t_hac"), F.when(known.isNotNull(), F.col("_ge") / F.col("_m")).alias("p_greater"))


# -- t tests ----------------------------------------------------------------------------------------

def welch_t(df: DataFrame, keys: Sequence[str], value: str, top: Column, bottom: Column) -> DataFrame:
    """Welch statistic, degrees of freedom and two-sided p of two row sets."""
    a, b = F.when(top, F.col(value)), F.when(bottom, F.col(value))
    g = df.groupBy(*keys).agg(F.count(a).alias("n_top"), F.count(b).alias("n_bottom"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
                              F.try_divide(F.var_samp(a), F.count(a)).alias("_va"), F.try_divide(F.var_samp(b), F.count(b)).alias("_vb"))
    se = F.col("_va") + F.col("_vb")
    dof = se * se / (F.col("_va") * F.col("_va") / (F.col("n_top") - 1) + F.col("_vb") * F.col("_vb") / (F.col("n_bottom") - 1))
    ok = (F.col("n_top") >= 2) & (F.col("n_bottom") >= 2) & (se > 0)
    out = g.select(*keys, "n_top", "n_bottom", (F.col("_ma") - F.col("_mb")).alias("mean_diff"),
                   F.when(ok, (F.col("_ma") - F.col("_mb")) / F.sqrt(se)).alias("t_stat"), F.when(ok, dof).alias("dof"))
    return out.withColumn("p_value", student_two_sided("t_stat", "dof"))


def one_sample_t(value: str) -> Column:
    sd = F.stddev_samp(value)
    return F.when(sd > 0, F.avg(value) / (sd / F.sqrt(F.count(value))))


# -- regressions ------------------------------------------------------------------------------------

_FIT = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("inv", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_FIT)
def _solve(xtx: pd.Series, xty: pd.Series) -> pd.DataFrame:
    """Normal equations, all rows of a batch in one stacked solve: ``xtx`` is the flattened k x k moment matrix. NULL where a
    moment is unknown or the matrix is singular."""
    beta, inv = [None] * len(xtx), [None] * len(xtx)
    known = [i for i, (a, b) in enumerate(zip(xtx, xty)) if a is not None and b is not None]
    if known:
        y = np.array([np.asarray(xty.iloc[i], float) for i in known])
        m = np.array([np.asarray(xtx.iloc[i], float) for i in known]).reshape(len(known), y.shape[1], y.shape[1])
        good = np.isfinite(m).all((1, 2)) & np.isfinite(y).all(1)
        good[good] = np.linalg.cond(m[good]) <= 1e14
        inverse = np.linalg.inv(m[good])
        for i, b, a in zip(np.array(known)[good].tolist(), np.einsum("nij,nj->ni", inverse, y[good]).tolist(), inverse.reshape(len(inverse), -1).tolist()):
            beta[i], inv[i] = b, a
    return pd.DataFrame({"beta": beta, "inv": inv})


def _moments(x: Sequence[Column], y: Column, agg) -> tuple[Column, Column]:
    return F.array(*[agg(a * b) for a in x for b in x]), F.array(*[agg(a * y) for a in x])


def ols_hac(df: DataFrame, keys: Sequence[str], *, y: str, x: Sequence[str], order: str, lags: int, small_sample: bool = False) -> DataFrame:
    """OLS with intercept and Bartlett HAC errors, one row per (key, term); at least one key column.

    Moments are summed by Spark, only the k x k solve is Python. A coefficient's HAC variance needs just the
    scalar series z = (row of the inverse) . x * residual: sum z^2 + 2 sum_l w_l sum z_t z_{t-l}.
    ``small_sample`` multiplies by n / (n - k). Lags use row order within a daily or weekly series.
    """
    keys = list(keys)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    d = df.where(F.col(y).isNotNull() & ~F.isnan(y))
    for c in x:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c))
    xtx, xty = _moments(cols, F.col(y).cast("double"), F.sum)
    fit = d.groupBy(*keys).agg(xtx.alias("_a"), xty.alias("_b"), F.count("*").alias("n")).withColumn("_f", _solve("_a", "_b")) \
        .where(F.col("_f.beta").isNotNull() & (F.col("n") >= len(cols) + (1 if small_sample else 0))).select(*keys, "n", F.col("_f.beta").alias("_beta"), F.col("_f.inv").alias("_inv"))
    j = d.join(fit, keys)
    k = len(cols)
    row = F.array(*cols)
    fitted = F.aggregate(F.zip_with(row, F.col("_beta"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    names = F.array(*[F.lit(n) for n in ("const", *x)])
    j = j.withColumn("_e", F.col(y) - fitted).withColumn("_row", row).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    z = F.aggregate(F.zip_with(F.slice("_inv", F.col("_t") * k + 1, k), F.col("_row"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) * F.col("_e")
    j = j.withColumn("_z", z).withColumn("_bt", F.get("_beta", F.col("_t"))).withColumn("term", F.get(names, F.col("_t")))
    w = Window.partitionBy(*keys, "_t").orderBy(order)
    # The Bartlett sum is cut at n - 2 lags (n - 1 without the small-sample form), as short series need.
    cap = F.least(F.lit(lags), F.col("n") - (2 if small_sample else 1))
    weighted = F.lit(0.0)
    for l in range(1, lags + 1):
        term = 2 * (1 - l / (cap + 1)) * F.col("_z") * F.lag("_z", l).over(w)
        weighted = weighted + F.when(F.lit(l) <= cap, F.coalesce(term, F.lit(0.0))).otherwise(0.0)
    j = j.withColumn("_q", F.col("_z") * F.col("_z") + weighted)
    g = j.groupBy(*keys, "term").agg(F.first("n").alias("n"), F.first("_bt").alias("estimate"), F.sum("_q").alias("_var"))
    factor = F.try_divide(F.col("n"), F.col("n") - k) if small_sample else F.lit(1.0)
    g = g.withColumn("se", F.sqrt(F.greatest(F.col("_var") * factor, F.lit(0.0))))
    out = g.select(*keys, "term", "n", "estimate", "se", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")).alias("t_hac"))
    return out.withColumn("p_value", student_two_sided("t_hac", f"n - {k}"))


def hac_mean(df: DataFrame, keys: Sequence[str], value: str, *, order: str, lags: int) -> DataFrame:
    """Mean with a Bartlett long-run standard error and its two-sided p."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    part = Window.partitionBy(*keys)
    w = part.orderBy(order)
    d = d.withColumn("_n", F.count("*").over(part)).withColumn("_u", F.col(value) - F.avg(value).over(part))
    q = F.col("_u") * F.col("_u")
    for l in range(1, lags + 1):
        q = q + F.when(F.lit(l) <= F.col("_n") - 1, F.coalesce(2 * (1 - l / (F.least(F.lit(lags), F.col("_n") - 1) + 1)) * F.col("_u") * F.lag("_u", l).over(w), F.lit(0.0))).otherwise(0.0)
    g = d.withColumn("_q", q).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.sqrt(F.greatest(F.sum("_q"), F.lit(0.0))) / F.count("*")).alias("se"))
    return g.withColumn("t_hac", F.when(F.col("se") > 0, F.col("mean") / F.col("se"))).withColumn("p_value", student_two_sided("t_hac", "n - 1"))


def winsor_bounds(df: DataFrame, week: str, columns: dict[str, float]) -> DataFrame:
    """Lower and upper tail quantiles of each column per week, exact and distributed: the columns are stacked, so
    one positions pass serves them all."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    tails = {f"q{i}_{end}": (t if end == "lo" else 1 - t) for i, t in enumerate(dict.fromkeys(columns.values())) for end in ("lo", "hi")}
    q = exact_quantiles(df.select(week, cells.alias("_x")).select(week, "_x.c", "_x.v"), [week, "c"], "v", tails)
    index = {t: i for i, t in enumerate(dict.fromkeys(columns.values()))}
    return q.groupBy(week).agg(*[F.max(F.when(F.col("c") == c, F.col(f"q{index[t]}_{end}"))).alias(f"{c}_{end}") for c, t in columns.items() for end in ("lo", "hi")])


def fama_macbeth_slopes(df: DataFrame, *, week: str, sector: str, y: str, signal: str, controls: Sequence[str], tail: float, tail_return: float,
                        min_rows: int) -> DataFrame:
    """Weekly slope of y on the signal: winsorised, standardised, sector-demeaned, with controls.

    Only per-week and per-(week, sector) moments are joined back; each is written once, so the rows are passed
    over once per stage.
    """
    xs = [signal, *controls]
    d = df
    for c in (y, *xs, sector):
        d = d.where(F.col(c).isNotNull())
    d = materialize(d.select(week, sector, y, *xs), "cross-section")  # read by the quantile passes and the regression
    bounds = winsor_bounds(d, week, {**{c: tail for c in xs}, y: tail_return})
    clip = lambda c: F.greatest(F.least(F.col(c), F.col(f"{c}_hi")), F.col(f"{c}_lo"))
    w = d.join(bounds, week).select(week, sector, *[clip(c).alias(c) for c in (y, *xs)])
    scale = w.groupBy(week).agg(F.count("*").alias("_n"), *[f(c).alias(f"{n}_{c}") for c in xs for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    s = w.join(scale.where(F.col("_n") >= min_rows), week).select(week, sector, y, *[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in xs])
    means = s.groupBy(week, sector).agg(*[F.avg(c).alias(f"_a_{c}") for c in (y, *xs)])
    r = s.join(means, [week, sector]).select(week, *[(F.col(c) - F.col(f"_a_{c}")).alias(c) for c in (y, *xs)])
    xtx, xty = _moments([F.col(c) for c in xs], F.col(y), F.sum)
    return (r.groupBy(week).agg(F.count("*").alias("n"), xtx.alias("_a"), xty.alias("_b")).withColumn("_f", _solve("_a", "_b"))
            .select(week, "n", F.get("_f.beta", F.lit(0)).alias("slope")))


def first_tie_rank(df: DataFrame, week: str, signal: str, tie: str) -> DataFrame:
    """Percent rank within the week, ties broken by the number ``tie``: the rank among the week's values and then
    among the rows of the same value, however many they are."""
    r = ranks(df, [week], signal, min_rank="_r", avg_rank="_x").drop("_x")
    r = ranks(r, [week, signal], tie, min_rank="_t", avg_rank="_x").drop("_x")
    n = df.groupBy(week).agg(F.count("*").alias("_n"))
    return r.join(n, week).withColumn("pct_rank", (F.col("_r") - 1 + F.col("_t")) / F.col("_n")).drop("_r", "_t")


def decile_spread(df: DataFrame, *, week: str, signal: str, y: str, tie: str, deciles: int = 10, min_rows: int = 1) -> DataFrame:
    """Mean of the highest minus the lowest decile, and highest minus all, per week."""
    r = first_tie_rank(df.where(F.col(signal).isNotNull() & F.col(y).isNotNull()), week, signal, tie)
    width = 1 / deciles
    top, low = F.avg(F.when(F.col("pct_rank") > 1 - width, F.col(y))), F.avg(F.when(F.col("pct_rank") <= width, F.col(y)))
    return r.where(F.col("_n") >= min_rows).groupBy(week).agg(F.count("*").alias("n"), (top - low).alias("decile_spread"), (top - F.avg(y)).alias("decile_top"))


def book_return(y: str, weight: str) -> Column:
    ok = F.col(y).isNotNull() & F.col(weight).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(y) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def rolling_residual_z(df: DataFrame, keys: Sequence[str], *, y: str, x: Sequence[str], order: str, window: int, min_obs: int, width: int) -> DataFrame:
    """y minus its fit from the previous ``window`` rows, over that fit's residual sd. Moments come from one
    window pass over blocks of rows with the rows before them; SSE = y'y - beta . X'y needs no second one."""
    known = F.col(y).isNotNull()
    for c in x:
        known = known & F.col(c).isNotNull()
    w = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(-window, -1)
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    over = lambda v: F.sum(F.when(known, v)).over(w)
    xtx, xty = _moments(cols, F.col(y), over)
    d = row_halo(df, keys, [order], window, width, ts=order).withColumn("_n", F.count(F.when(known, 1)).over(w)).withColumn("_yy", over(F.col(y) * F.col(y))).withColumn("_b", xty)
    d = d.withColumn("_f", F.when(known & (F.col("_n") >= min_obs), _solve(xtx, xty)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sd = F.sqrt(F.try_divide(F.col("_yy") - dot(F.col("_f.beta"), F.col("_b")), F.col("_n") - len(cols)))
    z = F.when(known & (sd > 0), (F.col(y) - dot(F.array(*cols), F.col("_f.beta"))) / sd)
    return own_rows(d.withColumn("z", z)).drop("_n", "_yy", "_b", "_f")


def expanding_forecasts(df: DataFrame, keys: Sequence[str], *, y: str, models: dict[str, Sequence[str]], ts: str, horizon: int, width: int) -> DataFrame:
    """Forecasts of any number of models refitted at every row by OLS on the rows whose target window has closed by then.

    The models share the rows that have all their regressors and the target. All sums of products of regressors and target
    up to ``horizon`` before each row are read off one scan of running sums, split over chunks of time; each model solves its
    own part of the matrix. Adds n_train, pred_mean and s2_mean, and pred_<name> and s2_<name> (residual variance).
    """
    xs = list(dict.fromkeys(c for m in models.values() for c in m))
    known = F.col(y).isNotNull() & F.lit(True)
    for c in xs:
        known = known & F.col(c).isNotNull()
    names = ["_1", *xs, y]
    right = df.where(known).select(*keys, ts, F.lit(1.0).alias("_1"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)])
    cell = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    sums = {cell(i, j): Run("sum", F.col(f"_right.{names[i]}") * F.col(f"_right.{names[j]}")) for i in range(len(names)) for j in range(i, len(names))}
    d = at_targets(df, right, by=keys, targets={"_past": F.col(ts) - horizon}, found=sums, width=width, right_on=ts, right_tie=[], take=names)
    m = lambda i, j: F.col(f"_past.{cell(i, j)}")
    last, n = len(names) - 1, m(0, 0)
    d = d.withColumns({"n_train": F.coalesce(n, F.lit(0.0)).cast("bigint"), "pred_mean": F.try_divide(m(0, last), n), "s2_mean": F.when(n > 1, F.greatest((m(last, last) - m(0, last) * m(0, last) / n) / (n - 1), F.lit(0.0)))})
    for name, columns in models.items():
        at = [0, *[names.index(c) for c in columns]]
        b = F.array(*[m(i, last) for i in at])
        d = d.withColumn("_f", F.when(n > len(at), _solve(F.array(*[m(i, j) for i in at for j in at]), b)))
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        pred = dot(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]), F.col("_f.beta"))
        d = d.withColumns({f"pred_{name}": pred, f"s2_{name}": F.greatest((m(last, last) - dot(F.col("_f.beta"), b)) / (n - len(at)), F.lit(0.0))}).drop("_f")
    return d.drop("_past")


# -- forecast comparison ----------------------------------------------------------------------------

def clark_west(df: DataFrame, keys: Sequence[str], *, y: str, small: str, big: str, order: str, lags: int) -> DataFrame:
    """Statistic that the larger nested model forecasts better, with its one-sided normal p."""
    e = lambda c: (F.col(y) - F.col(c)) * (F.col(y) - F.col(c))
    gap = F.col(small) - F.col(big)
    d = df.withColumn("_cw", e(small) - (e(big) - gap * gap))
    return hac_mean(d, keys, "_cw", order=order, lags=lags).select(*keys, "n", F.col("mean").alias("cw_mean"), F.col("t_hac").alias("cw_t"), normal_tail(F.col("t_hac")).alias("cw_p"))


def oos_r2(df: DataFrame, keys: Sequence[str], *, y: str, small: str, big: str) -> DataFrame:
    sq = lambda c: F.sum((F.col(y) - F.col(c)) * (F.col(y) - F.col(c)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), sq(small).alias("sse_small"), sq(big).alias("sse_big")) \
        .withColumn("oos_r2", F.when(F.col("sse_small") > 0, 1 - F.col("sse_big") / F.col("sse_small")))


def leave_one_out_r2(df: DataFrame, keys: Sequence[str], period: str, *, y: str, small: str, big: str) -> DataFrame:
    """Worst out-of-sample R2 after leaving out one period: totals minus the period's sums."""
    p = oos_r2(df, [*keys, period], y=y, small=small, big=big)
    w = Window.partitionBy(*keys)
    a, b = F.sum("sse_small").over(w) - F.col("sse_small"), F.sum("sse_big").over(w) - F.col("sse_big")
    r = p.withColumn("_r", F.when(a > 0, 1 - b / a))
    return r.groupBy(*keys).agg(F.min("_r").alias("min_leave_one_r2"), F.min_by(period, F.struct("_r", period)).alias("most_influential"),
                                F.count_if(F.col("oos_r2") > 0).alias("positive_periods"), F.count("*").alias("periods"))


def qlike(y: str, pred: str, s2: str) -> Column:
    """Mean QLIKE loss on variance for a lognormal log-volatility forecast."""
    lr = 2 * F.col(y) - 2 * F.col(pred) - 2 * F.col(s2)
    return F.avg(F.exp(lr) - lr - 1)


# -- composed studies -------------------------------------------------------------------------------

def pairwise_dependence(closes: DataFrame, regimes: DataFrame, *, anchor: str, hac_lags: int, min_rows: int) -> DataFrame:
    """Dependence of pair-matched forward returns, for all dates and per state of the anchor on the day before.

    Each pair uses dates both have. ``closes``: name, ts, close (one row per day). ``regimes``: symbol, ts, regime.
    """
    from .joins import pairs
    p = pairs(closes, on=["ts"], name="name", values=["close"])
    w = Window.partitionBy("a", "b").orderBy("ts")
    f = p.select("a", "b", "ts", (F.lead("a_close").over(w) / F.col("a_close") - 1).alias("x"), (F.lead("b_close").over(w) / F.col("b_close") - 1).alias("y"),
                 ((F.lead("ts").over(w) - F.col("ts")) / DAY).alias("days")).where("x IS NOT NULL")
    st = regimes.where((F.col("symbol") == anchor) & F.col("regime").isNotNull()).select((F.col("ts") + DAY).alias("ts"), "regime")
    d = f.join(st, "ts", "left").withColumn("label", F.explode(F.array_compact(F.array(F.lit("all"), F.col("regime")))))
    k = ["a", "b", "label"]
    g = Window.partitionBy(*k)
    rank = lambda c: F.rank().over(g.orderBy(c)) + (F.count("*").over(Window.partitionBy(*k, c)) - 1) / 2
    q = lambda c, p_: F.percentile(c, F.lit(p_)).over(g)
    d = d.withColumns({"rx": rank("x"), "ry": rank("y"), "down": F.col("x") <= q("x", 0.2), "xt": F.col("x") <= q("x", 0.1), "yt": F.col("y") <= q("y", 0.1)})
    when = lambda cond, c: F.when(cond, F.col(c))
    down = F.col("down")
    ok = F.count("*") >= min_rows
    agg = d.groupBy(*k).agg(
        F.count("*").alias("n_intervals"), F.percentile("days", F.lit(0.5)).alias("median_days"), F.max("days").alias("max_days"),
        F.when(ok, F.corr("x", "y")).alias("pearson"), F.when(ok, F.corr("rx", "ry")).alias("spearman"),
        F.when(ok & (F.count_if(down) >= 10), F.corr(when(down, "x"), when(down, "y"))).alias("downside_corr"),
        F.when(ok, F.avg(F.when(F.col("xt"), F.col("yt").cast("int")))).alias("lower_tail_probability"),
        F.when(ok, F.avg((F.col("xt") & F.col("yt")).cast("int"))).alias("joint_lower_tail_share"))
    beta = ols_hac(d.select(*k, "ts", "x", "y"), k, y="y", x=["x"], order="ts", lags=hac_lags, small_sample=True).where("term = 'x'") \
        .select(*k, F.col("estimate").alias("hac_beta"), F.col("se").alias("hac_se"))
    out = agg.join(beta, k, "left").withColumn("lower_tail_lift", F.col("lower_tail_probability") / 0.10)
    for c in ("hac_beta", "hac_se"):
        out = out.withColumn(c, F.when(F.col("n_intervals") >= min_rows, F.col(c)))
    return out


def walk_forward(split: DataFrame, *, keys: Sequence[str], draws: int, seed: str, min_train: tuple[int, int], min_test: tuple[int, int], alpha: float) -> DataFrame:
    """Folds x strategies: train-side selection frozen before the test side is read.

    ``split`` comes from ``embargo_split`` with a ``month`` column. Yekutieli q-values are taken over each fold.
    """
    keys = list(keys)
    k = [*keys, "fold_year"]
    sides = []
    for part, (events, months) in (("train", min_train), ("test", min_test)):
        d = split.where(F.col("part") == part)
        c = d.groupBy(*k).agg(F.count("*").alias(f"{part}_events"), F.count_distinct("month").alias(f"{part}_months"))
        b = cluster_bootstrap(d, k, value="net_bp", cluster="month", draws=draws, seed=f"{seed}-{part}").select(
            *k, F.col("mean").alias(f"{part}_mean_bp"), F.col("p_positive").alias(f"{part}_p"))
        s = c.join(b, k).withColumn(f"{part}_eligible", (F.col(f"{part}_events") >= events) & (F.col(f"{part}_months") >= months))
        sides.append(fdr(s.withColumn("_p", F.when(F.col(f"{part}_eligible"), F.col(f"{part}_p"))), ["fold_year"], "_p", bh=f"{part}_bh_q", by=f"{part}_by_q",
                         tie=keys).drop("_p"))
    j = sides[0].join(sides[1], k, "left")
    sel = F.col("train_eligible") & (F.col("train_mean_bp") > 0) & (F.col("train_by_q") <= alpha)
    pos = F.coalesce(F.col("test_eligible"), F.lit(False)) & (F.col("test_mean_bp") > 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (j.withColumn("primary_selection", yes(sel)).withColumn("oos_positive", yes(pos))
            .withColumn("oos_survives_selection", yes(sel & pos)).withColumn("oos_fdr_significant", yes(pos & (F.col("test_by_q") <= alpha))))


def family_rollup(folds: DataFrame, family: str) -> DataFrame:
    return folds.groupBy("fold_year", family).agg(
        F.count("*").alias("variants"), F.count_if("train_eligible").alias("eligible_train_variants"),
        F.count_if(F.coalesce("test_eligible", F.lit(False))).alias("eligible_test_variants"), F.count_if("primary_selection").alias("selected_variants"),
        F.count_if("oos_survives_selection").alias("selected_with_positive_test"),
        F.count_if(F.col("primary_selection") & F.col("oos_fdr_significant")).alias("selected_with_fdr_test"),
        F.percentile("train_mean_bp", F.lit(0.5)).alias("median_train_mean_bp"), F.percentile("test_mean_bp", F.lit(0.5)).alias("median_test_mean_bp"))


def sign_stability(df: DataFrame, keys: Sequence[str], *, y: str, x: str, parts: dict[str, Column], expected: int) -> DataFrame:
    """Slope on the whole sample and on each named part, and whether all parts have the expected sign."""
    aggs = [F.count("*").alias("n"), F.regr_slope(y, x).alias("slope")]
    for name, cond in parts.items():
        aggs.append(F.regr_slope(F.when(cond, F.col(y)), F.when(cond, F.col(x))).alias(f"slope_{name}"))
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys).agg(*aggs)
    stable = F.lit(True)
    for name in parts:
        stable = stable & F.coalesce(F.signum(f"slope_{name}") == expected, F.lit(False))
    return d.withColumn("sign_stable", stable)


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str, *, order: str, lags: Sequence[int]) -> DataFrame:
    """Centred autocorrelations sum c_t c_{t-k} / sum c^2 of a daily or weekly series."""
    part = Window.partitionBy(*keys)
    w = part.orderBy(order)
    d = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(part))
    d = d.select(*keys, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in lags])
    return d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.try_divide(F.sum(F.col("_c") * F.col(f"_l{k}")), F.sum(F.col("_c") * F.col("_c"))).alias(f"autocorr_{k}") for k in lags])


def vol_target(df: DataFrame, keys: Sequence[str], *, forecast: Column, ret: str, order: str, target: float, cap: float, cost: float) -> DataFrame:
    """Leverage min(cap, target / forecast), turnover paid at ``cost`` per unit; daily series."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("leverage", F.greatest(F.least(F.lit(target) / forecast, F.lit(cap)), F.lit(0.0)))
    d = d.withColumn("turnover", F.abs(F.col("leverage") - F.coalesce(F.lag("leverage").over(w), F.lit(0.0))))
    return d.withColumn("net", F.col("leverage") * F.col(ret) - cost * F.col("turnover"))


def policy_summary(df: DataFrame, keys: Sequence[str], *, order: str, per_year: float) -> DataFrame:
    """Annualised return, volatility and Sharpe ratio, drawdown, leverage and turnover of ``net``."""
    from .windows import max_drawdown
    k = df.where("net IS NOT NULL")
    dd = max_drawdown(k.withColumn("ts", F.col(order)), keys, "net", width=None)
    sd = F.stddev_samp("net")
    g = k.groupBy(*keys).agg(F.count("*").alias("periods"), (F.avg("net") * per_year).alias("ann_return"), (sd * F.lit(per_year) ** 0.5).alias("ann_vol"),
                             F.when(sd > 0, F.avg("net") * F.lit(per_year) ** 0.5 / sd).alias("sharpe"), F.avg("leverage").alias("mean_leverage"),
                             F.max("leverage").alias("max_leverage"), F.avg("turnover").alias("mean_turnover"))
    return g.join(dd, list(keys))
