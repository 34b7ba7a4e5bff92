"""Made-up panels, and what they should give, worked out with pandas."""

import datetime as dt

import numpy as np
import pandas as pd

START = dt.date(2019, 3, 4)


def day(k):
    return START + dt.timedelta(days=int(k))


def made(seed, days=30, names=12, holes=0.1, columns=("a", "b"), nan=False):
    """Rows of some days and tickers, not all of them, with holes; a pandas frame in no order. nan: holes are NaN, not None."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for i in range(names):
            if rng.random() < 0.9:
                rows.append((day(d), f"{'kqzv'[i % 4]}{i}", *[(float("nan") if nan else None) if rng.random() < holes else float(np.round(rng.normal(3, 2), 6)) for _ in columns]))
    rng.shuffle(rows)
    return [(r[0], r[1], *[v if v is None else float(v) for v in r[2:]]) for r in rows]


def to_spark(spark, rows, columns):
    return spark.createDataFrame(rows, "Date date, Ticker string, " + ", ".join(f"{c} double" for c in columns))


def to_pandas(rows, columns):
    df = pd.DataFrame(rows, columns=["Date", "Ticker", *columns])
    return df.astype({c: float for c in columns}).sort_values(["Ticker", "Date"]).reset_index(drop=True)


def same(got, want, columns, tolerance=1e-9):
    """A Spark frame and a pandas one agree by key; NULL there is NaN here, and Spark's has no NaN."""
    got = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns).sort_values(["Ticker", "Date"]).reset_index(drop=True)
    want = want.sort_values(["Ticker", "Date"]).reset_index(drop=True)
    assert list(got.Ticker) == list(want.Ticker) and list(got.Date) == list(want.Date)
    for c in columns:
        mine = [None if v is None else float(v) for v in got[c].astype(object).where(got[c].notna(), None)]
        plain = [None if pd.isna(v) else float(v) for v in want[c]]
        assert [v is None for v in mine] == [v is None for v in plain], c
        assert np.allclose([v or 0 for v in mine], [v or 0 for v in plain], atol=tolerance), c
