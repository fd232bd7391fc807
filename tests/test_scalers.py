"""Scalers fitted on one table and applied to another, saved and loaded."""

import numpy as np
import pytest

from tidemark.operators.scalers import Scaler, ScalerModel

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("kind", ["range", "centre"])
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("trim", [0.0, 0.1])
def test_fit_save_load_apply(spark, tmp_path, kind, keys, trim):
    learn = {k: np.round(RNG.normal(10 * k, 1 + k, 101), 6) for k in (1, 2)}
    table = spark.createDataFrame([(k, float(x), 1) for k, v in learn.items() for x in v] + [(1, None, 1)], "k long, x double, note long").repartition(3)
    Scaler(keys, ["x"], kind, trim).fit(table).save(f"file://{tmp_path}/model")
    model = ScalerModel.load(spark, f"file://{tmp_path}/model")
    asked = [(1, 9.5), (2, 21.0), (1, 1e6), (2, -1e6), (1, None), (7, 3.0)]
    got = model.transform(spark.createDataFrame(asked, "k long, x double"))
    assert got.columns == ["k", "x"]
    want = []
    for k, x in asked:
        own = learn.get(k) if keys else np.concatenate([*learn.values()])
        if x is None or own is None:
            want.append((k, None))
            continue
        s = np.sort(own)
        low, high = (s[int(np.ceil(q * len(s))) - 1] for q in (trim, 1 - trim)) if trim else (s[0], s[-1])
        own, x = np.clip(own, low, high), np.clip(x, low, high)
        shift, scale = ((low + high) / 2, (high - low) / 2) if kind == "range" else (own.mean(), np.abs(own - own.mean()).mean())
        want.append((k, float((x - shift) / scale)))
    order = lambda r: (r[0], r[1] is None, r[1] or 0.0)
    for a, b in zip(sorted(map(tuple, got.collect()), key=order), sorted(want, key=order), strict=True):
        assert a[0] == b[0] and (a[1] == b[1] or a[1] == pytest.approx(b[1], rel=1e-9))
    back = model.inverse(model.transform(table)).filter("x IS NOT NULL").collect()
    if not trim:
        assert sorted(round(r["x"], 6) for r in back) == pytest.approx(sorted(np.concatenate([*learn.values()]).tolist()), abs=1e-5)


def test_equal_values_and_unknown_kind(spark):
    same = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k long, x double")
    for kind in ("range", "centre"):
        assert [r["x"] for r in Scaler(["k"], ["x"], kind).fit(same).transform(same).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="no scaling"):
        Scaler([], ["x"], "other")
