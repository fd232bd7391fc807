"""Queries over supervised frames, kernels, fits and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import tables as table_functions
from tidemark.operators import core, frames, kernels, moments, scalers
from tidemark.operators.core import DAY, HOUR
from tidemark.shared import shared_path, written

from .stats import FORECASTS, forecasts
from .tables import query, r6, read, ticks
from .windows import R, rows

HORIZON = HOUR
_MAIN = f"(SELECT DISTINCT series, t // {DAY} * {DAY} AS t FROM {{ticks}})"


def mains(spark, d):
    return ticks(spark, d).select("series", (core.bucket("t", DAY) * DAY).alias("t")).distinct()


_KNOWN = f"(SELECT m.series, m.t, arg_max(k.price, k.t) AS known FROM {_MAIN} m JOIN {{ticks}} k ON k.series = m.series AND k.t < m.t - {HORIZON} GROUP BY ALL)"


@query("label_frame", f"""WITH s AS (SELECT m.series, m.t, max(k.t) AS st FROM {_MAIN} m JOIN {{ticks}} k ON k.series = m.series AND k.t <= m.t GROUP BY ALL)
SELECT n.series, n.t, CAST((k.t - n.t) // {12 * HOUR} AS INTEGER) AS step, round(any_value(known), 6) AS known, round(avg(k.price) - any_value(known), 6) AS label FROM {_KNOWN} n JOIN s ON s.series = n.series AND s.t = n.t AND n.t - s.st <= {5 * DAY}
JOIN {{ticks}} k ON k.series = n.series AND k.t >= n.t AND k.t < n.t + {DAY} GROUP BY 1, 2, 3""")
def label_frame(spark, d):
    got = frames.label_frame(mains(spark, d), ticks(spark, d), "series", DAY, HORIZON, 5 * DAY, 2)
    return got.select("series", "t", "step", r6("known", "known"), r6("label", "label"))


@query("training_window_start", f"SELECT series, min(t) AS start FROM (SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS r FROM {{ticks}}) WHERE r <= 20 GROUP BY series")
def training_window_start(spark, d):
    r = rows(spark, d)
    n = r.groupBy("series").agg(F.max("row_ix").alias("last"))
    return r.join(n, "series").filter("row_ix > last - 20").groupBy("series").agg(F.min("t").alias("start"))


_AT = f"(SELECT m.series, m.t, max(k.row_ix) AS at_ix FROM {_MAIN} m JOIN {R} k ON k.series = m.series AND k.t < m.t - {HORIZON} GROUP BY ALL)"


@query("feature_frame", f"""WITH s AS (SELECT a.series, a.t, (a.at_ix - k.row_ix) // 2 AS slot, sum(k.price) / 2 AS v FROM {_AT} a JOIN {R} k ON k.series = a.series AND k.row_ix BETWEEN a.at_ix - 5 AND a.at_ix WHERE a.at_ix >= 5 GROUP BY ALL)
SELECT series, t, CAST(slot AS INTEGER) AS slot, round(v - older, 6) AS value FROM (SELECT *, lead(v) OVER (PARTITION BY series, t ORDER BY slot) AS older FROM s) WHERE slot < 2""")
def feature_frame(spark, d):
    return frames.feature_frame(mains(spark, d), ticks(spark, d), "series", HORIZON, 2, 2).select("series", "t", "slot", r6("value", "value"))


@query("block_quantisation", f"SELECT a.series, a.t, CAST((a.at_ix - k.row_ix) // 3 AS INTEGER) AS slot, round(sum(k.price) / 3, 6) AS value FROM {_AT} a JOIN {R} k ON k.series = a.series AND k.row_ix BETWEEN a.at_ix - 5 AND a.at_ix WHERE a.at_ix >= 5 GROUP BY ALL")
def block_quantisation(spark, d):
    r = rows(spark, d)
    at = core.asof(mains(spark, d).withColumn("k", F.col("t") - HORIZON), r, "series", "k", "t", ["row_ix"], "before", False)
    asked = at.filter("found.row_ix >= 5").select("series", "t", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("back"), F.col("found.row_ix").alias("at"))
    hit = asked.withColumn("row_ix", F.col("at") - F.col("back")).join(r.select("series", "row_ix", "price"), ["series", "row_ix"])
    return hit.groupBy("series", "t", F.floor(F.col("back") / 3).cast("int").alias("slot")).agg(r6(F.sum("price") / 3, "value"))


@query("label_quantisation", f"SELECT n.series, n.t, CAST((k.t - n.t) // {6 * HOUR} AS INTEGER) AS slot, round(avg(k.price) - any_value(known), 6) AS label FROM {_KNOWN} n JOIN {{ticks}} k ON k.series = n.series AND k.t >= n.t AND k.t < n.t + {DAY} GROUP BY 1, 2, 3")
def label_quantisation(spark, d):
    got = frames.label_frame(mains(spark, d), ticks(spark, d), "series", DAY, HORIZON, 10**15, 4)
    return got.select("series", "t", F.col("step").alias("slot"), r6("label", "label"))


@query("last_known_baseline", f"SELECT series, t, round(known, 6) AS known FROM {_KNOWN}")
def last_known_baseline(spark, d):
    got = core.asof(mains(spark, d).withColumn("k", F.col("t") - HORIZON), ticks(spark, d), "series", "k", "t", ["price"], "before", False)
    return got.filter("found IS NOT NULL").select("series", "t", r6("found.price", "known"))


_L, _FEAT = f"(SELECT series, row_ix, price AS v FROM {R})", f"(SELECT series, row_ix, CAST(qty AS DOUBLE) AS v FROM {R})"


def _label_feature(spark, d):
    r = rows(spark, d)
    return r.select("series", "row_ix", F.col("price").alias("v")), r.select("series", "row_ix", F.col("qty").cast("double").alias("v"))


@query("shift_stretch_alignment", f"""WITH g AS (SELECT * FROM (VALUES (0), (1), (2)) a(sh), (VALUES (1.0::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE)) b(st)),
s AS (SELECT l.series, sh, st, avg(abs(l.v - f.v)) AS score FROM {_L} l JOIN g ON l.row_ix >= sh JOIN {_FEAT} f ON f.series = l.series AND f.row_ix = CAST(floor((l.row_ix - sh) * st) AS BIGINT) GROUP BY ALL)
SELECT series, round(round(score, 9), 4) AS score, CAST(sh AS BIGINT) AS shift, st AS stretch FROM s QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(score, 9), sh, st DESC) = 1""")
def shift_stretch_alignment(spark, d):
    return frames.alignment(*_label_feature(spark, d), "series", [0, 1, 2], [1.0, 0.75, 0.5]).select("series", F.round("score", 4).alias("score"), "shift", "stretch")


@query("apply_shift_stretch", f"SELECT a.series, a.row_ix, b.v AS moved FROM {_L} a LEFT JOIN {_L} b ON b.series = a.series AND b.row_ix = CAST(floor((a.row_ix - 2) * 0.75) AS BIGINT)")
def apply_shift_stretch(spark, d):
    return frames.moved(_label_feature(spark, d)[0], "series", 2, 0.75).select("series", "row_ix", "moved")


@query("feature_tuning")
def feature_tuning(spark, d):
    """For each number of rows a slot, the best alignment of the slotted quantity with the price; the best one by series."""
    labels, features = _label_feature(spark, d)
    out = None
    for q in (1, 2, 4):
        slots = features.groupBy("series", (F.floor(F.col("row_ix") / q) * q).cast("long").alias("row_ix")).agg(F.avg("v").alias("v"))
        got = frames.alignment(labels.filter(F.col("row_ix") % q == 0), slots, "series", [0, q, 2 * q], [1.0]).withColumn("quantum", F.lit(q))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("series").agg(F.min(F.struct(F.round("score", 6).alias("score"), "quantum", "shift")).alias("b")).select("series", "b.*")


#: Chunks of 25 vectors.
_V = "(SELECT vec_id, vec_id // 25 AS chunk, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, CAST(label AS DOUBLE) AS y FROM embeddings)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 25).cast("long").alias("chunk"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))


_D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))"


@query("pairwise_distance", f"SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt({_D2}), 6) AS distance FROM {_V} a JOIN {_V} b USING (chunk)")
def pairwise_distance(spark, d):
    p = frames.pairs_within(_vectors(spark, d), "chunk", "vec_id", ["x"])
    return p.select(F.col("vec_id_i").alias("i"), F.col("vec_id_j").alias("j"), r6(F.sqrt(frames.squared_distance(F.col("x_i"), F.col("x_j"))), "distance"))


@query("label_difference_kernel", f"SELECT a.vec_id AS i, b.vec_id AS j, a.y - b.y AS z FROM {_V} a JOIN {_V} b USING (chunk)")
def label_difference_kernel(spark, d):
    p = frames.pairs_within(_vectors(spark, d), "chunk", "vec_id", ["y"])
    return p.select(F.col("vec_id_i").alias("i"), F.col("vec_id_j").alias("j"), (F.col("y_i") - F.col("y_j")).alias("z"))


@query("vector_kernels", f"SELECT a.vec_id AS i, b.vec_id AS j, round({_DOT}, 6) AS linear, round(pow(0.5 * {_DOT} + 1, 2), 6) AS polynomial, round(exp(-0.5 * {_D2}), 6) AS rbf, round(exp(-sqrt({_D2}) / 0.5), 6) AS exponential, round(tanh(0.5 * {_DOT} + 1), 6) AS sigmoid FROM {_V} a JOIN {_V} b USING (chunk)")
def vector_kernels(spark, d):
    p = frames.pairs_within(_vectors(spark, d), "chunk", "vec_id", ["x"])
    return p.select(F.col("vec_id_i").alias("i"), F.col("vec_id_j").alias("j"), *(r6(frames.kernel(k, F.col("x_i"), F.col("x_j"), 0.5), k) for k in ("linear", "polynomial", "rbf", "exponential", "sigmoid")))


@query("kernel_from_distance", f"""WITH z AS (SELECT chunk, a.vec_id AS i, b.vec_id AS j, a.y - b.y AS z FROM {_V} a JOIN {_V} b USING (chunk)), m AS (SELECT chunk, avg(sign(z) * pow(abs(z), 0.5)) AS mean, avg(abs(z)) AS gamma FROM z GROUP BY chunk)
SELECT i, j, round((sign(z) * pow(abs(z), 0.5) - mean) / CASE WHEN gamma = 0 THEN 1 ELSE gamma END, 6) AS k FROM z JOIN m USING (chunk)""")
def kernel_from_distance(spark, d):
    p = frames.pairs_within(_vectors(spark, d), "chunk", "vec_id", ["y"]).withColumn("z", F.col("y_i") - F.col("y_j"))
    root = F.signum("z") * F.pow(F.abs("z"), F.lit(0.5))
    m = p.groupBy("chunk").agg(F.avg(root).alias("mean"), F.avg(F.abs("z")).alias("g")).withColumn("gamma", F.when(F.col("g") == 0, 1.0).otherwise(F.col("g")))
    return p.join(m, "chunk").select(F.col("vec_id_i").alias("i"), F.col("vec_id_j").alias("j"), r6(frames.from_distance(F.col("z"), F.col("mean"), F.col("gamma"), 0.5), "k"))


def _sequence(kind: str, **p):
    def run(spark, d):
        pairs = frames.pairs_within(_vectors(spark, d), "chunk", "vec_id", ["x"])
        return pairs.select(F.col("vec_id_i").alias("i"), F.col("vec_id_j").alias("j"), frames.sequence_kernel(kind, **p)("x_i", "x_j").alias("k")).withColumn("k", F.round("k", 6))

    return run


query("path_kernel")(_sequence("path"))
query("kdtw_kernel")(_sequence("kdtw"))
query("global_alignment_kernel")(_sequence("gak", band=4))


def _fitted(spark, d):
    return frames.fit_chunks(_vectors(spark, d), ["chunk"], 0.5)


@query("chunked_kernel_fit")
def chunked_kernel_fit(spark, d):
    return _fitted(spark, d).select("chunk", r6("score", "score"), F.size("items").alias("support"))


@query("chunked_prediction")
def chunked_prediction(spark, d):
    """Every fifth row, predicted by the models of its group's four chunks, which are fitted to the other rows."""
    v = _vectors(spark, d).withColumn("group", F.floor(F.col("chunk") / 4))
    models = frames.fit_chunks(v.filter("vec_id % 5 <> 0"), ["group", "chunk"], 0.5)
    return frames.predict_chunks(v.filter("vec_id % 5 = 0"), models, ["group"], ["vec_id"]).select("vec_id", r6("prediction", "prediction"))


@query("blocked_prediction")
def blocked_prediction(spark, d):
    """Every fifth row, predicted by the two best models of its group's four chunks: exact fits towards small absolute errors, by blocks of rows and support rows."""
    v = _vectors(spark, d).withColumn("group", F.floor(F.col("chunk") / 4))
    models = kernels.fit_exact(v.filter("vec_id % 5 <> 0"), ["group", "chunk"], 0.5, item="vec_id")
    return kernels.predict(v.filter("vec_id % 5 = 0"), models, ["group"], ["vec_id"], best=2).select("vec_id", r6("prediction", "prediction"))


@query("large_chunk_fit")
def large_chunk_fit(spark, d):
    """Four fits to three quarters of the table's rows, and their forecasts of the others: chunks that grow with the table, over random features."""
    v = _vectors(spark, d).withColumn("part", F.pmod(F.floor(F.col("vec_id") / 4), F.lit(4)))
    models = kernels.fit_large(v.filter("vec_id % 4 <> 0"), ["part"], 0.05, 64, rounds=3)
    return kernels.predict(v.filter("vec_id % 4 = 0"), models, ["part"], ["vec_id"]).select("part", "vec_id", r6("prediction", "prediction"))


@query("residual_models")
def residual_models(spark, d):
    """A chunk's first model learns from its even rows, the second from what the first leaves on the odd ones, which it hasn't seen; the forecast of
    every row is the sum of both."""
    v = _vectors(spark, d)
    first = frames.predict_chunks(v, frames.fit_chunks(v.filter("vec_id % 2 = 0"), ["chunk"], 0.1, 1.0), ["chunk"], ["vec_id"]).withColumnRenamed("prediction", "p1")
    left = written(v.join(first, ["chunk", "vec_id"]).withColumn("y", F.col("y") - F.col("p1")), "residuals")
    learn = left.filter("vec_id % 2 = 1").select("chunk", "vec_id", "x", "y")
    second = frames.predict_chunks(left, frames.fit_chunks(learn, ["chunk"], 1.0, 0.1), ["chunk"], ["vec_id"])
    return left.join(second, ["chunk", "vec_id"]).select("vec_id", r6("p1", "first"), r6(F.col("p1") + F.col("prediction"), "total"))


def _trees(frame, features: str, label: str, out: str, rows=None):
    """rows (the frame's own by default) with the prediction of trees boosted on the frame."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    ready = lambda df: df.withColumn("_f", array_to_vector(F.col(features)))
    model = GBTRegressor(featuresCol="_f", labelCol=label, predictionCol=out, maxIter=5, maxDepth=3, seed=7).fit(ready(frame))
    return model.transform(ready(frame if rows is None else rows)).drop("_f")


@query("boosted_tree_baseline")
def boosted_tree_baseline(spark, d):
    return _trees(_vectors(spark, d), "x", "y", "prediction").select("vec_id", r6("prediction", "prediction"))


@query("pairwise_boosted_kernel")
def pairwise_boosted_kernel(spark, d):
    p = frames.pairs_within(_vectors(spark, d), "chunk", "vec_id", ["x", "y"])
    p = p.withColumn("z", F.col("y_i") - F.col("y_j")).withColumn("xx", F.concat("x_i", "x_j"))
    return _trees(p, "xx", "z", "k").select(F.col("vec_id_i").alias("i"), F.col("vec_id_j").alias("j"), r6("k", "k"))


@query("forecast_recombination", """WITH m AS (SELECT series, avg(price) AS dc FROM {ticks} GROUP BY series), s AS (SELECT series, any_value(dc) AS dc, avg(abs(price - dc)) AS sf FROM {ticks} JOIN m USING (series) GROUP BY series),
f AS (SELECT series, t // 86400000000 AS day, kind, avg((price - dc) / CASE WHEN sf = 0 THEN 1 ELSE sf END) / 2 AS part FROM {ticks} JOIN s USING (series) GROUP BY ALL) SELECT series, day, round(sum(part) * CASE WHEN any_value(sf) = 0 THEN 1 ELSE any_value(sf) END + any_value(dc) + 1e-9, 4) AS forecast FROM f JOIN s USING (series) GROUP BY series, day""")
def forecast_recombination(spark, d):
    from tidemark.operators import stats

    t = ticks(spark, d)
    factors = stats.scaling(t, ["series"], "price")
    parts = t.join(factors, "series").groupBy("series", core.bucket("t", DAY).alias("day"), "kind").agg((F.avg((F.col("price") - F.col("dc")) / F.col("sf")) / 2).alias("part"))
    total = parts.groupBy("series", "day").agg(F.sum("part").alias("v"))
    return total.join(factors, "series").select("series", "day", F.round(F.col("v") * F.col("sf") + F.col("dc") + 1e-9, 4).alias("forecast"))


@query("gradient_recombination", """WITH m AS (SELECT series, avg(price) AS dc FROM {ticks} GROUP BY series), s AS (SELECT series, any_value(dc) AS dc, avg(abs(price - dc)) AS raw FROM {ticks} JOIN m USING (series) GROUP BY series),
z AS (SELECT series, kind, t, t // 86400000000 AS day, event_id % 2 AS gradient, (price - dc) / CASE WHEN raw = 0 THEN 1 ELSE raw END AS z FROM {ticks} JOIN s USING (series)),
l AS (SELECT series, kind, day, lag(newest) OVER (PARTITION BY series, kind ORDER BY day) AS known FROM (SELECT series, kind, day, arg_max(z, t) AS newest FROM z GROUP BY ALL)),
p AS (SELECT series, kind, day, sum(part) AS part FROM (SELECT series, kind, day, gradient, avg(z) / 2 AS part FROM z GROUP BY ALL) GROUP BY ALL)
SELECT series, day, round(sum((part + coalesce(known, 0)) / 2) * CASE WHEN any_value(raw) = 0 THEN 1 ELSE any_value(raw) END + any_value(dc) + 1e-9, 4) AS forecast FROM p JOIN l USING (series, kind, day) JOIN s USING (series) GROUP BY series, day""")
def gradient_recombination(spark, d):
    """Kinds as levels, odd and even rows as their gradients: sums over gradients and the level's last known value of a day before, over two steps, unscaled."""
    from tidemark.operators import stats

    t = ticks(spark, d)
    factors = stats.scaling(t, ["series"], "price")
    z = t.join(factors, "series").select("series", "kind", "t", core.bucket("t", DAY).alias("day"), (F.col("event_id") % 2).alias("gradient"), ((F.col("price") - F.col("dc")) / F.col("sf")).alias("z"))
    newest = z.groupBy("series", "kind", "day").agg(F.max_by("z", "t").alias("newest")).withColumn("of", F.struct("series", "kind"))
    known = core.previous(newest, "of", "day", ["newest"], 365).select("series", "kind", "day", F.col("prev_newest").alias("known"))
    parts = z.groupBy("series", "kind", "day", "gradient").agg((F.avg("z") / 2).alias("prediction"))
    total = frames.recombined(parts, known, ["series", "day"], "kind", 2)
    return total.join(factors, "series").select("series", "day", F.round(F.col("value") * F.col("sf") + F.col("dc") + 1e-9, 4).alias("forecast"))


@query("validation_report", f"""SELECT source, count(*) AS n, round(avg(abs(p - actual)), 6) AS mae, round(100 * sum(abs(p - actual)) / sum(abs(actual)), 6) AS mape FROM (
  SELECT 'mean' AS source, forecast AS p, actual FROM {FORECASTS} UNION ALL SELECT 'last known', known, actual FROM {FORECASTS}) GROUP BY source""")
def validation_report(spark, d):
    f = forecasts(spark, d).withColumn("s", F.explode(F.array(F.struct(F.lit("mean").alias("source"), F.col("forecast").alias("p")), F.struct(F.lit("last known").alias("source"), F.col("known").alias("p")))))
    e = F.abs(F.col("s.p") - F.col("actual"))
    return f.groupBy(F.col("s.source").alias("source")).agg(F.count("*").alias("n"), r6(F.avg(e), "mae"), r6(100 * F.sum(e) / F.sum(F.abs("actual")), "mape"))


def _moments(batches):
    """Of each batch and own fold X'X and X'y as one flat list (ones behind x), and the number of rows."""
    import numpy as np
    import pandas as pd

    for pdf in batches:
        for own, part in pdf.groupby("own"):
            x = np.c_[np.array(part["x"].tolist(), float), np.ones(len(part))]
            flat = np.r_[(x.T @ x).ravel(), x.T @ part["y"].to_numpy(float), len(part)]
            yield pd.DataFrame({"own": int(own), "at": np.arange(len(flat)), "v": flat})


def _errors(weights: dict):
    """Of each batch the summed absolute errors of (lam, fold) on the fold's own rows."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for own, part in pdf.groupby("own"):
                x, y = np.c_[np.array(part["x"].tolist(), float), np.ones(len(part))], part["y"].to_numpy(float)
                got = [(lam, fold, len(y), float(np.abs(x @ w - y).sum())) for (lam, fold), w in weights.items() if fold == own]
                yield pd.DataFrame(got, columns=["lam", "fold", "n", "err"])

    return run


def cross_validated(v, lams: list[float]):
    """(lam, fold, n, mae): ridge fits to rows (own, x, y), each fold held out of the fit to all others.

    Sums of each fold are taken in Spark, its training sums are the total less them; no task holds more rows than a batch."""
    import numpy as np

    sums = {}
    for r in v.select("own", "x", "y").mapInPandas(_moments, "own int, at int, v double").groupBy("own", "at").agg(F.sum("v").alias("v")).orderBy("own", "at").collect():
        sums.setdefault(r["own"], []).append(r["v"])
    sums, weights = {own: np.array(m) for own, m in sums.items()}, {}
    total = sum(sums.values())
    for own, m in sums.items():
        k = int(len(m) ** 0.5)
        rest = total - m
        if rest[-1] > 0:
            weights |= {(lam, own): np.linalg.solve(rest[: k * k].reshape(k, k) + lam * np.eye(k), rest[k * k : -1]) for lam in lams}
    got = v.select("own", "x", "y").mapInPandas(_errors(weights), "lam double, fold int, n long, err double").groupBy("lam", "fold").agg(F.sum("n").alias("n"), F.sum("err").alias("err"))
    return got.select("lam", "fold", "n", (F.col("err") / F.col("n")).alias("mae"))


@query("grid_search_cv")
def grid_search_cv(spark, d):
    """Parameter grid times folds; the best parameter has the least mean error."""
    v = _vectors(spark, d).withColumn("own", F.pmod("vec_id", F.lit(4)).cast("int"))
    return cross_validated(v, [0.01, 1.0, 100.0]).groupBy("lam").agg(F.sum("n").alias("n"), r6(F.avg("mae"), "mae"))


@query("walk_forward_backtest")
def walk_forward_backtest(spark, d):
    """Sliding windows of rows in order of vec_id: each trains on 100 rows and validates on the 25 behind them."""
    v = core.row_index(_vectors(spark, d).withColumn("all", F.lit(0)), "all", "vec_id", 4096, "place")
    return moments.walk_forward(v, "all", 100, 25, 1.0).select(F.col("fold").cast("int").alias("fold"), "n", r6("mae", "mae"))


def _predicted(weights: dict):
    """Of each batch the prediction of the fit to the first part (batch) and of the fit to all parts before the row's own (online)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for own, part in pdf.groupby("own"):
                x = np.c_[np.array(part["x"].tolist(), float), np.ones(len(part))]
                yield pd.DataFrame({"vec_id": part["vec_id"], "batch": x @ weights[0], "online": x @ weights[int(own) - 1]})

    return run


def validated(v, steps: int, lam: float = 1.0):
    """(source, n, mae, mape, alpha, direction, better) on the last two fifths of vec_id's range for rows (vec_id, x, y): a ridge fit to the first
    three fifths (batch), one that has also learnt from each of the `steps` parts before the row's own (online), boosted trees (tree) and the row's last known label.

    Fits come from sums taken in Spark by part; the driver holds steps + 1 of them, whatever the number of rows."""
    import numpy as np

    from tidemark.operators import stats

    ends = v.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).first()
    lo, span = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    place = F.floor((F.col("vec_id") - lo) * 5 * steps / F.lit(2 * span)) - F.lit(3 * steps // 2)
    parts = v.withColumn("own", F.greatest(F.lit(0), place + 1).cast("int"))
    sums, weights, total = {}, {}, 0.0
    for r in parts.select("own", "x", "y").mapInPandas(_moments, "own int, at int, v double").groupBy("own", "at").agg(F.sum("v").alias("v")).orderBy("own", "at").collect():
        sums.setdefault(r["own"], []).append(r["v"])
    size = next((int(len(m) ** 0.5) for m in sums.values()), 0)
    for own in range(steps + 1):
        total = total + np.array(sums.get(own, [0.0] * (size * size + size + 1)))
        weights[own] = np.linalg.solve(total[: size * size].reshape(size, size) + lam * np.eye(size), total[size * size : -1])
    later = parts.filter("own > 0")
    known = core.previous(parts.select(F.lit(0).alias("all"), "vec_id", "y"), "all", "vec_id", ["y"], 4096).select("vec_id", F.col("prev_y").alias("known"))
    linear = later.select("own", "vec_id", "x").mapInPandas(_predicted(weights), "vec_id long, batch double, online double")
    trees = _trees(parts.filter("own = 0"), "x", "y", "tree", later).select("vec_id", "tree")
    rows = later.select("vec_id", "y").join(linear, "vec_id").join(trees, "vec_id").join(known, "vec_id")
    sources = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.col(n).alias("p")) for n in ("batch", "online", "tree", "known")))).alias("s")
    each = rows.select("y", F.col("known").alias("last"), sources)
    return each.groupBy(F.col("s.source").alias("source")).agg(F.count("*").alias("n"), *stats.errors(F.col("s.p"), F.col("y"), F.col("last")))


@query("model_validation")
def model_validation(spark, d):
    """Batch, online, tree and last known predictions of the later vectors' labels, by the same metrics."""
    got = validated(_vectors(spark, d), 10)
    return got.select("source", "n", *(r6(c, c) for c in got.columns[2:]))


@query("level_parameter_recombination", """WITH c AS (SELECT l_linenumber - 1 AS level, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS candidate, round(avg(l_discount * l_extendedprice), 4) AS score FROM lineitem GROUP BY 1, 2), n AS (SELECT unnest(range(128)) AS combo)
SELECT combo, round(sum(score), 4) AS score FROM n JOIN c ON ((combo >> level) & 1) = candidate GROUP BY combo ORDER BY score, combo LIMIT 1""")
def level_parameter_recombination(spark, d):
    """Two candidates for each of seven levels: all combinations by bit pattern, the least summed score wins."""
    c = read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("level"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("candidate")).agg(F.round(F.avg(F.col("l_discount") * F.col("l_extendedprice")), 4).alias("score"))
    bits = spark.range(128).withColumnRenamed("id", "combo").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("candidate", F.expr("shiftright(combo, level) & 1").cast("int"))
    return bits.join(c, ["level", "candidate"]).groupBy("combo").agg(F.round(F.sum("score"), 4).alias("score")).orderBy("score", "combo").limit(1)


@query("min_max_scaling", """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, min(x) AS lo, max(x) AS hi FROM e GROUP BY ALL)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(-1 + 2 * (x - lo) / (hi - lo), 6) AS scaled FROM e JOIN m USING (label, i) WHERE hi > lo""")
def min_max_scaling(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    m = e.groupBy("label", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("hi > lo")
    return e.join(m, ["label", "i"]).select("vec_id", "i", r6(-1 + 2 * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), "scaled"))


_PRICED = "(SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_orderkey % 2 = 0 AS learn FROM lineitem)"


@query("saved_scaling", f"""WITH f AS (SELECT l_returnflag, min(q) AS ql, max(q) AS qh, min(p) AS pl, max(p) AS ph FROM {_PRICED} WHERE learn GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((least(greatest(q, ql), qh) - (ql + qh) / 2) / ((qh - ql) / 2), 6) + 0.0 AS q, round((least(greatest(p, pl), ph) - (pl + ph) / 2) / ((ph - pl) / 2), 6) + 0.0 AS p FROM {_PRICED} JOIN f USING (l_returnflag) WHERE NOT learn""")
def saved_scaling(spark, d):
    """Ranges by return flag fitted to even orders, saved, loaded and applied to odd ones."""
    rows, to = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p")), shared_path(spark, "scaler")
    scalers.Scaler(["l_returnflag"], ["q", "p"]).fit(rows.filter("l_orderkey % 2 = 0")).save(to)
    got = scalers.ScalerModel.load(spark, to).transform(rows.filter("l_orderkey % 2 = 1"))
    return got.select("l_orderkey", "l_linenumber", *((F.round(c, 6) + 0.0).alias(c) for c in ("q", "p")))


@query("centred_scaling", f"""WITH m AS (SELECT avg(q) AS qm, avg(p) AS pm, min(q) AS ql, max(q) AS qh, min(p) AS pl, max(p) AS ph FROM {_PRICED} WHERE learn),
s AS (SELECT any_value(qm) AS qm, any_value(pm) AS pm, any_value(ql) AS ql, any_value(qh) AS qh, any_value(pl) AS pl, any_value(ph) AS ph, avg(abs(q - qm)) AS qs, avg(abs(p - pm)) AS ps FROM {_PRICED}, m WHERE learn)
SELECT l_orderkey, l_linenumber, round((least(greatest(q, ql), qh) - qm) / qs, 6) + 0.0 AS q, round((least(greatest(p, pl), ph) - pm) / ps, 6) + 0.0 AS p FROM {_PRICED}, s WHERE NOT learn""")
def centred_scaling(spark, d):
    """Means and mean distances of all even orders together, applied to odd ones."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    model = scalers.Scaler([], ["q", "p"], "centre").fit(rows.filter("l_orderkey % 2 = 0"))
    return model.transform(rows.filter("l_orderkey % 2 = 1")).select("l_orderkey", "l_linenumber", *((F.round(c, 6) + 0.0).alias(c) for c in ("q", "p")))


def _bacon_sql(rounds: int, alpha: float) -> str:
    """Unrolled rounds; two columns have the closed quantile -2 ln(alpha / n)."""
    cut = f"-2 * ln({alpha} / n) * pow(1 + 3.0 / (n - 2) + 2.0 / (n - 7) + greatest(0, (((n + 3) // 2) - r) / (((n + 3) // 2) + r)), 2)"
    ctes = [
        "l AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)",
        "m AS (SELECT g, quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my FROM l GROUP BY g)",
        """r0 AS MATERIALIZED (SELECT g, x, y, n, rank() OVER (PARTITION BY g ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 9)) > 8 AS o FROM l JOIN m USING (g))""",
    ]
    for i in range(rounds):
        ctes.append(f"s{i} AS (SELECT *, {cut} AS cut FROM (SELECT g, any_value(n) AS n, count(*) AS r, avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM r{i} WHERE NOT o GROUP BY g))")
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT g, x, y, l.n, (c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b) >= cut AS o FROM l JOIN s{i} USING (g))")
    return f"WITH {', '.join(ctes)} SELECT g AS l_returnflag, count(*) FILTER (o) AS outliers, count(*) AS n FROM r{rounds} GROUP BY 1"


@query("outlier_bacon", _bacon_sql(20, 0.01))
def outlier_bacon(spark, d):
    """Quantity and price by return flag; the SQL makes twenty rounds, after which nothing changes."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return frames.bacon(li, ["l_returnflag"], ["l_quantity", "l_extendedprice"]).groupBy("l_returnflag").agg(F.count_if("outlier").alias("outliers"), F.count("*").alias("n"))


@query("scalar_hook", "SELECT event_id, round((price - 10) / 3, 6) AS scaled, round(((price - 10) / 3) * 3 + 10, 6) AS back FROM {ticks}")
def scalar_hook(spark, d):
    """A scaler and its inverse passed in as functions of a column."""
    scale, back = (lambda c: (c - 10) / 3), (lambda c: c * 3 + 10)
    return ticks(spark, d).select("event_id", r6(scale(F.col("price")), "scaled"), r6(back(scale(F.col("price"))), "back"))


@query("aggregate_hook", "SELECT series, round(sum(price), 4) AS additive, round(exp(sum(ln(1 + abs(price) / 1000))), 6) AS multiplicative FROM {ticks} GROUP BY series")
def aggregate_hook(spark, d):
    factor = F.product(1 + F.abs("price") / 1000)
    return ticks(spark, d).groupBy("series").agg(F.round(F.sum("price"), 4).alias("additive"), r6(factor, "multiplicative"))


@query("gap_table_function", f"SELECT series, max(gap) AS longest, count(*) AS gaps FROM (SELECT series, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM (SELECT DISTINCT series, t // {HOUR} * {HOUR} AS t FROM {{ticks}})) WHERE gap > {HOUR} GROUP BY series")
def gap_table_function(spark, d):
    h = ticks(spark, d).select("series", (core.bucket("t", HOUR) * HOUR).alias("t")).distinct()
    g = core.gaps(h, "series", "t", HOUR)
    return g.groupBy("series").agg(F.max(F.col("gap_end") - F.col("gap_start") + HOUR).alias("longest"), F.count("*").alias("gaps"))


_FROM = 1704153600000000
_GAPS_FROM = f"""WITH h AS (SELECT DISTINCT series, t // {HOUR} * {HOUR} AS t FROM {{ticks}} WHERE t >= {_FROM}),
g AS (SELECT series, t, lag(t) OVER (PARTITION BY series ORDER BY t) AS pt FROM h)
SELECT {{series}} AS series, coalesce(pt + {HOUR}, {_FROM}) AS gap_start, t AS gap_end FROM g WHERE t > coalesce(pt + {HOUR}, {_FROM})"""


def _hours(spark, d):
    return ticks(spark, d).select("series", (core.bucket("t", HOUR) * HOUR).alias("t")).distinct()


@query("gaps_from_a_start", _GAPS_FROM.replace("{series}", "series"))
def gaps_from_a_start(spark, d):
    """Missing hours from the start of a range on, those before a series' first row included."""
    return core.gaps(_hours(spark, d), "series", "t", HOUR, start=_FROM)


@query("gap_table_sql", _GAPS_FROM.replace("{series}", "CAST(series AS VARCHAR)"))
def gap_table_sql(spark, d):
    """The same by the table function from SQL."""
    table_functions.register(spark)
    _hours(spark, d).createOrReplaceTempView("hours_of_ticks")
    return spark.sql(f"SELECT * FROM gap_intervals(TABLE(SELECT series, t FROM hours_of_ticks) PARTITION BY series ORDER BY (t), {HOUR}, {_FROM}, NULL)")


@query("running_rank_of_errors", f"SELECT series, t, rank() OVER (PARTITION BY series ORDER BY round(abs(forecast - actual), 6) DESC) AS place FROM {FORECASTS}")
def running_rank_of_errors(spark, d):
    w = Window.partitionBy("series").orderBy(F.round(F.abs(F.col("forecast") - F.col("actual")), 6).desc())
    return forecasts(spark, d).select("series", "t", F.rank().over(w).alias("place"))
