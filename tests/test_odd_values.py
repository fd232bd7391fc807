"""Queries over tables with values that the given ones hold too seldom, against SQL."""

from datetime import datetime, timedelta

import pandas as pd
from compare import duck

from tidemark.plans import registry

START = datetime(2024, 1, 1)


def events(folder, rows):
    """events.parquet of (series, hours after START, price)."""
    table = pd.DataFrame([(n, START + timedelta(hours=h), s, "view", p, '{"k": 1}') for n, (s, h, p) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    table["ts"] = table["ts"].astype("datetime64[us]")
    table.to_parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    """The query's rows and its SQL's, as strings (of all numbers equal to themselves or not)."""
    got, want = registry.QUERIES[name](spark, folder), duck(folder).sql(registry.SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    return sorted(str(tuple(r)) for r in got.select(*order).collect()), sorted(str(r) for r in want.select(*(f'"{c}"' for c in order)).fetchall())


def test_errors_run_from_a_first_price_of_zero_on(spark, tmp_path):
    rows = [(1, h, p) for h, p in enumerate([3.0, 5.0, 0.0, 0.0, 2.0])] + [(2, h, p) for h, p in enumerate([0.0, 0.0, 0.0, 4.0])] + [(3, h, p) for h, p in enumerate([1.0, 1.0, 1.0])]
    got, want = both(spark, events(tmp_path, rows), "running_evaluation")
    assert got == want and sum("inf" in r for r in got) == 2 and sum("nan" in r for r in got) == 1
