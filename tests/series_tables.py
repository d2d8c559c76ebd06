"""Small tables of recordings that several test modules use."""

import numpy as np
import pandas as pd


def series_frame(seed=0, recordings=3, n=180, missing=0.2, signals=("a", "b")):
    """Noisy waves with spikes, gaps at both ends and inside, as a long pandas table."""
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(recordings):
        size = n - 17 * r
        for k, s in enumerate(signals):
            x = np.sin(np.arange(size) / (7 + k)) * (k + 1) + rng.normal(0, 0.3, size)
            x[rng.integers(0, size, 4)] += rng.choice([-8.0, 8.0], 4)
            gone = rng.random(size) < missing
            gone[:2] = r == 0
            gone[-3:] = r == 1
            gone[40:52] = True
            for i in range(size):
                rows.append((f"r{r}", s, i, i / 50.0, None if gone[i] else float(x[i])))
    return pd.DataFrame(rows, columns=["recording_id", "signal", "idx", "t", "value"])


SCHEMA = "recording_id string, signal string, idx long, t double, value double"


def long_table(spark, pdf, parts=3):
    rows = [tuple(None if (isinstance(v, float) and np.isnan(v)) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def collected(df, keys):
    pdf = df.toPandas().sort_values(keys).reset_index(drop=True)
    return pdf.reindex(sorted(pdf.columns), axis=1)
