"""Supervised frames: labels, features, alignment, kernels on pairs, chunked fits and what comes out of them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

from . import core


def label_frame(main: DataFrame, aux: DataFrame, key: str, resolution: int, horizon: int, drift: int, steps: int = 1, width: int = core.DAY) -> DataFrame:
    """(key, t, step, label, known): for each main time the mean of auxiliary values in each step of [t, t + resolution), minus the
    last value strictly before t - horizon. Times without a row at or before them within `drift`, or without a known value, are left out."""
    probe = main.select(key, "t", (F.col("t") - horizon).alias("known_t"))
    got = core.asof(probe, aux, key, "known_t", "t", ["price"], "before", False, width, "_k")
    got = core.asof(got, aux, key, "t", "t", ["price"], "before", True, width, "_s")
    got = got.filter(F.col("_k").isNotNull() & (F.col("t") - F.col("_s.t") <= drift)).select(key, "t", F.col("_k.price").alias("known"))
    part = resolution // steps
    spans = got.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("lo", F.col("t") + F.col("step") * part).withColumn("hi", F.col("lo") + part).withColumnRenamed("t", "main_t")
    inside = core.range_join(spans, aux.select(key, "t", "price"), key, "lo", "hi", "t", resolution)
    return inside.groupBy(key, F.col("main_t").alias("t"), "step", "known").agg((F.avg("price") - F.col("known")).alias("label"))


def feature_frame(probes: DataFrame, aux: DataFrame, key: str, horizon: int, lags: int, quantum: int, width: int = core.DAY) -> DataFrame:
    """(key, t, slot, value): differences of `lags` neighbouring slots, each the mean of `quantum` rows; slot 0 ends strictly before t - horizon.

    Probes without lags * quantum + quantum earlier rows are left out."""
    rows = core.row_index(aux.select(key, "t", "price"), key, "t", width)
    at = core.asof(probes.select(key, F.col("t").alias("main_t"), (F.col("t") - horizon).alias("known_t")), rows, key, "known_t", "t", ["row_ix"], "before", False, width)
    need = (lags + 1) * quantum
    asked = at.filter(F.col("found.row_ix") >= need - 1).select(key, "main_t", F.explode(F.sequence(F.lit(0), F.lit(need - 1))).alias("back"), F.col("found.row_ix").alias("at"))
    hit = asked.withColumn("row_ix", F.col("at") - F.col("back")).join(rows.select(key, "row_ix", "price"), [key, "row_ix"])
    slots = hit.groupBy(key, F.col("main_t").alias("t"), F.floor(F.col("back") / quantum).cast("int").alias("slot")).agg((F.sum("price") / quantum).alias("v"))
    older = F.lead("v").over(Window.partitionBy(key, "t").orderBy("slot"))
    return slots.withColumn("value", F.col("v") - older).filter(F.col("slot") < lags).select(key, "t", "slot", "value")


def vectors(frame: DataFrame, keys: list[str]) -> DataFrame:
    """One array of a frame's values for each key, by slot."""
    values = F.array_sort(F.collect_list(F.struct("slot", "value")))
    return frame.groupBy(*keys).agg(F.transform(values, lambda x: x["value"]).alias("x"))


def alignment(labels: DataFrame, features: DataFrame, key: str, shifts: list[int], stretches: list[float]) -> DataFrame:
    """(key, score, shift, stretch) of the best alignment: least mean |label[r + shift] - feature[floor(r * stretch)]|.

    Both tables are (key, row_ix, v); the grid of parameters is a literal array."""
    grid = F.array(*[F.struct(F.lit(sh).cast("long").alias("shift"), F.lit(float(st)).alias("stretch")) for sh in shifts for st in stretches])
    asked = labels.select(key, F.col("row_ix").alias("_l"), F.col("v").alias("label"), F.explode(grid).alias("g")).withColumn("_r", F.col("_l") - F.col("g.shift")).filter("_r >= 0")
    placed = asked.withColumn("row_ix", F.floor(F.col("_r") * F.col("g.stretch")).cast("long"))
    both = placed.join(features.select(key, "row_ix", F.col("v").alias("feature")), [key, "row_ix"])
    scores = both.groupBy(key, "g").agg(F.avg(F.abs(F.col("label") - F.col("feature"))).alias("score"))
    best = F.min(F.struct(F.round("score", 9).alias("score"), F.col("g.shift").alias("shift"), (-F.col("g.stretch")).alias("minus")))
    return scores.groupBy(key).agg(best.alias("b")).select(key, "b.score", "b.shift", (-F.col("b.minus")).alias("stretch"))


def moved(df: DataFrame, key: str, shift: int, stretch: float, out: str = "moved") -> DataFrame:
    """df's rows with the value at floor((row_ix - shift) * stretch)."""
    from .windows import by_source

    return by_source(df, key, "v", F.floor((F.col("row_ix") - shift) * stretch), out)


def pairs_within(df: DataFrame, chunk: str, item: str, columns: list[str]) -> DataFrame:
    """All ordered pairs of the rows of a chunk, suffixed _i and _j. Chunks are bounded by the fit's kernel length."""
    left = df.select(chunk, *(F.col(c).alias(f"{c}_i") for c in (item, *columns)))
    right = df.select(chunk, *(F.col(c).alias(f"{c}_j") for c in (item, *columns)))
    return left.join(right, chunk)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def kernel(kind: str, a: Column, b: Column, gamma: float, coef: float = 1.0, degree: int = 2) -> Column:
    """linear, polynomial, rbf, exponential or sigmoid kernel of two arrays."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if kind == "linear":
        return product
    if kind == "polynomial":
        return F.pow(gamma * product + coef, F.lit(degree))
    if kind == "sigmoid":
        return F.tanh(gamma * product + coef)
    d2 = squared_distance(a, b)
    return F.exp(-gamma * d2) if kind == "rbf" else F.exp(-F.sqrt(d2) / (2 * gamma * gamma))


def from_distance(z: Column, mean: Column, gamma: Column, power: float) -> Column:
    """(sign(z) |z|^power - mean) / gamma."""
    return (F.signum(z) * F.pow(F.abs(z), F.lit(power)) - mean) / gamma


def sequence_kernel(kind: str, **p):
    """pandas UDF of two array columns: "path", "kdtw" or "gak", a dynamic programme over both sequences at once for all pairs of a batch.

    path: cells hold the weighted difference of two elements plus the smallest neighbour (by size), times its direction's weight. kdtw: the sum of
    products of local kernels over warping paths and over the diagonal. gak: the log-domain global alignment kernel, normalised by both self-kernels."""
    import numpy as np
    import pandas as pd

    def stack(s: pd.Series) -> np.ndarray:
        return np.array(s.tolist(), float)

    def path(a, b):
        n = a.shape[1]
        w = ((np.arange(2 * n - 1) + 1) / (2 * n - 1)) ** p.get("tau", 0.5)
        h, dg, v = p.get("h", 0.5), p.get("d", 0.5), p.get("v", 0.5)
        c = np.zeros((n, n, len(a)))
        for i in range(n):
            for j in range(n):
                own = (a[:, i] - b[:, j]) * w[i + j]
                options = [(v, c[i - 1, j])] if i else []
                options += [(h, c[i, j - 1])] if j else []
                options += [(dg, c[i - 1, j - 1])] if i and j else []
                if options:
                    sizes = np.stack([np.abs(x) for _, x in options])
                    own = own + np.choose(sizes.argmin(0), [f * x for f, x in options])
                c[i, j] = own
        return c[-1, -1] / n

    def kdtw(a, b):
        n, eps = a.shape[1], 1e-3
        local = lambda x, y: (np.exp(-np.abs(x - y) ** p.get("tau", 2.0) / p.get("sigma", 1.0)) + eps) / (3 * (1 + eps))
        k = local(a[:, :, None], b[:, None, :])
        same = np.stack([k[:, i, i] for i in range(n)], axis=1)
        d, e = (np.zeros((n + 1, n + 1, len(a))) for _ in range(2))
        d[0, 0] = e[0, 0] = 1
        for i in range(1, n + 1):
            for j in range(1, n + 1):
                d[i, j] = (d[i - 1, j] + d[i, j - 1] + d[i - 1, j - 1]) * k[:, i - 1, j - 1]
                e[i, j] = e[i - 1, j] * same[:, i - 1] + e[i, j - 1] * same[:, j - 1] + (e[i - 1, j - 1] * k[:, i - 1, j - 1] if i == j else 0)
        return d[n, n] + e[n, n]

    def log_gak(a, b):
        n, sigma, band = a.shape[1], p.get("sigma", 1.0), p.get("band", 0)
        m = np.full((n + 1, n + 1, len(a)), -np.inf)
        m[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, n + 1):
                if band and abs(i - j) >= band:
                    continue
                g = -np.abs(a[:, i - 1] - b[:, j - 1]) / (2 * sigma * sigma) + (math.log(1 - abs(i - j) / band) if band else 0.0)
                m[i, j] = np.logaddexp(np.logaddexp(m[i - 1, j], m[i, j - 1]), m[i - 1, j - 1]) + g - np.log(2 - np.exp(g))
        return m[n, n]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = stack(a), stack(b)
        if not len(x):
            return pd.Series([], dtype=float)
        # a few pairs at a time: a programme's tables have a cell for each two elements of each pair
        parts = [(x[i : i + 256], y[i : i + 256]) for i in range(0, len(x), 256)]
        if kind == "gak":
            return pd.Series(np.concatenate([np.exp(log_gak(a, b) - 0.5 * (log_gak(a, a) + log_gak(b, b))) for a, b in parts]))
        return pd.Series(np.concatenate([(path if kind == "path" else kdtw)(a, b) for a, b in parts]))

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def fit_chunks(frame: DataFrame, keys: list[str], gamma: float, ridge: float = 1e-3) -> DataFrame:
    """(keys, score, gamma, items array<struct<x, w>>): an RBF kernel ridge regression of each chunk of (keys, x array, y).

    score is the mean absolute error on the chunk. A chunk has as many rows as the kernel length allows."""
    import numpy as np
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(float)
        k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
        w = np.linalg.solve(k + ridge * np.eye(len(y)), y)
        head = {c: [pdf[c].iloc[0]] for c in keys}
        return pd.DataFrame(head | {"score": [float(np.abs(k @ w - y).mean())], "gamma": [gamma], "items": [[{"x": a.tolist(), "w": float(b)} for a, b in zip(x, w, strict=True)]]})

    head = ", ".join(f"{c} {dict(frame.dtypes)[c]}" for c in keys)
    return frame.groupBy(*keys).applyInPandas(fit, f"{head}, score double, gamma double, items array<struct<x:array<double>,w:double>>")


def predict_chunks(frame: DataFrame, models: DataFrame, on: list[str], row: list[str]) -> DataFrame:
    """(row, prediction): each chunk's prediction, weighted by the inverse of its error, over the chunks that share the keys `on`."""
    both = frame.join(models.select(*on, "score", "gamma", "items"), on)
    one = F.aggregate("items", F.lit(0.0), lambda s, m: s + m["w"] * F.exp(-F.col("gamma") * squared_distance(F.col("x"), m["x"])))
    weight = 1 / (F.col("score") + 1e-6)
    return both.withColumn("_p", one).withColumn("_w", weight).groupBy(*on, *row).agg((F.sum(F.col("_p") * F.col("_w")) / F.sum("_w")).alias("prediction"))


def recombined(parts: DataFrame, known: DataFrame, keys: list[str], level: str, steps: int) -> DataFrame:
    """(keys, value) of forecasts: of each level the predictions of its gradients are added up, with the level's last known value (none: 0), and
    divided by the number of steps; levels are then added up. parts: (keys, level, prediction); known: (keys, level, known)."""
    each = parts.groupBy(*keys, level).agg(F.sum("prediction").alias("prediction")).join(known, [*keys, level], "left")
    value = (F.col("prediction") + F.coalesce("known", F.lit(0.0))) / steps
    return each.groupBy(*keys).agg(F.sum(value).alias("value"))


def chi_square_quantile(p: int, tail: float) -> float:
    """x with a tail probability P(X > x) = tail for a chi-square variable of p degrees of freedom, by bisection over the closed form of the tail."""

    def above(x: float) -> float:
        # Q(p/2, x/2): Q(a + 1, y) = Q(a, y) + y^a e^-y / gamma(a + 1), from Q(1/2, y) = erfc(sqrt(y)) or Q(1, y) = e^-y
        y = x / 2
        a, q = (0.5, math.erfc(math.sqrt(y))) if p % 2 else (1.0, math.exp(-y))
        while a < p / 2:
            q += math.exp(a * math.log(y) - y - math.lgamma(a + 1)) if y > 0 else 0.0
            a += 1
        return q

    low, high = 0.0, 1.0
    while above(high) > tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > tail else (low, middle)
    return (low + high) / 2


def bacon_cutoff(n: int, p: int, r: int, alpha: float) -> float:
    """The squared distance that bounds the basic subset: the chi-square quantile for alpha / n times the squared correction for n rows, p columns and a subset of r."""
    h = (n + p + 1) // 2
    small = 1 + (p + 1) / max(1, n - p) + 2 / max(1, n - 1 - 3 * p)
    return chi_square_quantile(p, alpha / n) * (small + max(0.0, (h - r) / (h + r))) ** 2


def least_rows(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """Rows of each key that hold all of its `size` least values (to nine places, ties included), and few others; no key is sorted or sent as a whole.

    Rows are dealt out in 4 * size shares. Of the least values of a key's shares, the size-th is no less than the size-th of all its rows, so rows up to it will do.
    A key with rows in fewer shares comes whole."""
    least = rows.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(4 * size))).groupBy(key, "_share").agg(F.min(value).alias("_least"))
    bound = written(least.groupBy(key).agg(F.get(F.array_sort(F.collect_list("_least")), F.lit(size - 1)).alias("_bound")), "bacon")
    upto = F.col("_bound") * (1 + 1e-12) + 2e-9  # what rounds to the same
    return rows.join(bound, key).filter(F.col("_bound").isNull() | (F.col(value) <= upto)).drop("_bound")


def bacon(df: DataFrame, keys: list[str], columns: list[str], alpha: float = 0.01, start: int = 4, rounds: int = 100, accuracy: int = 10_000) -> DataFrame:
    """df with `outlier`: rows that blocked adaptive outlier nomination leaves out of the basic subset.

    The first subset is the start * p rows of each group nearest to the medians (ties with the last of them too), and twice as many while its covariance has no
    inverse. Each round takes all rows whose distance by the subset's mean and covariance is below the corrected chi-square quantile, until no group's subset
    changes, or `rounds` are over. Medians come from mergeable sketches (1 / accuracy of the rows off at most); rows with a null are outliers of no subset (null).
    A round reads df once and adds up moments in Spark; matrices as large as the columns are inverted, one for each group. Only numbers of changed groups go through the driver.
    Subsets of each round are one row a group in a table of the shared folder; their caller may remove them."""
    import numpy as np
    import pandas as pd

    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    whole, known = F.lit(True), F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    rows = df.filter(whole & known)
    # written: its size is known to the joins, so rows are not dealt out by group for it
    middle = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.percentile_approx(c, 0.5, accuracy).alias(f"_m{i}") for i, c in enumerate(columns))), "bacon")
    # a number for each group, with a salt that gives no two of them the same: joins by a number cost a fraction of those by text
    for salt in itertools.count():
        group = F.xxhash64(*keys, F.lit(salt))
        if not middle.groupBy(group).count().filter("count > 1").limit(1).count():
            break
    rows = rows.select(*columns, group.alias("_g"))
    middle = middle.withColumn("_g", group).drop(*keys)
    far = sum(((F.col(c) - F.col(f"_m{i}")) * (F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(columns)), F.lit(0.0))

    def shaped(n: pd.Series, r: pd.Series, cov: pd.Series) -> pd.DataFrame:
        """Inverse and cutoff of each group; no inverse where the subset lies in a plane."""
        out = []
        for n_, r_, flat in zip(n, r, cov, strict=True):
            c = np.zeros((p, p))
            for (i, j), v in zip(pairs, flat, strict=True):
                c[i, j] = c[j, i] = v
            scale = np.sqrt(np.diag(c))
            full = bool((scale > 0).all()) and np.linalg.matrix_rank(c / np.outer(scale, scale), tol=1e-9, hermitian=True) == p
            out.append({"inv": np.linalg.inv(c).ravel().tolist() if full else None, "cut": bacon_cutoff(int(n_), p, int(r_), alpha)})
        return pd.DataFrame(out, columns=["inv", "cut"])

    shaped.__annotations__ = {"n": pd.Series, "r": pd.Series, "cov": pd.Series, "return": pd.DataFrame}
    shape_of = F.pandas_udf(shaped, "inv array<double>, cut double")

    def shape(subset: DataFrame) -> DataFrame:
        cov = F.array(*(F.coalesce(F.covar_samp(columns[i], columns[j]), F.lit(0.0)) for i, j in pairs))
        sums = subset.groupBy("_g").agg(F.first("_n").alias("_n"), F.count("*").alias("_r"), F.bit_xor(F.xxhash64(*columns)).alias("_rows"), *(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), cov.alias("_cov"))
        return written(sums.withColumn("_s", shape_of("_n", "_r", "_cov")).select("_g", "_n", "_r", "_rows", *(f"_m{i}" for i in range(p)), "_s.inv", "_s.cut"), "bacon")

    def within(shape: DataFrame, of: DataFrame) -> DataFrame:
        off = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(columns)]
        d2 = sum((off[i] * off[j] * F.col("inv")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
        return of.join(shape, "_g", "left").withColumn("outlier", d2 >= F.col("cut"))

    size = start * p
    nearest = Window.partitionBy("_g").orderBy(F.round("_d", 9))
    distant = rows.join(middle, "_g").withColumn("_d", far)
    while True:
        first = least_rows(distant, "_g", "_d", size).withColumn("_k", F.rank().over(nearest)).filter(F.col("_k") <= size)
        now = shape(first)
        most = now.filter("inv IS NULL AND _r < _n").limit(1).count()
        if not most:
            break
        size *= 2
    for _ in range(rounds):
        subset = within(now.filter("inv IS NOT NULL"), rows).filter("NOT outlier").select("_g", *columns, "_n")
        new = shape(subset)
        last = now.select("_g", F.col("_r").alias("_r0"), F.col("_rows").alias("_rows0"))
        changed = new.join(last, "_g").filter((F.col("_r") != F.col("_r0")) | (F.col("_rows") != F.col("_rows0"))).limit(1).count()
        settled = now.join(new, "_g", "left_anti")  # groups without an inverse stay as they are
        now = new.unionByName(settled)
        if not changed:
            break
    return within(now, df.withColumn("_g", F.when(known, group))).select(*df.columns, "outlier")
