"""Controlled validation: corrupt, clean with many candidates, score, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.domains import OUTLIER_FIRST
from tidegauge.functions.series import Series
from tidegauge.operators import corrupt, validate
from tidegauge.plans.clean import STAGES, Settings, execute


def distinct_methods(specs: list[dict[str, str]]) -> dict[str, list[str]]:
    return {st: list(dict.fromkeys(sp.get(st, "none") for sp in specs)) for st in STAGES}


def run_candidates(s: Series, specs: list[dict[str, str]], order: str, st: Settings) -> Series:
    """All candidates at once: stages are shared, and only wanted combinations go on.

    Every result series is keyed by outlier, imputation, scaling and smoothing.
    """
    wanted = distinct_methods(specs)
    out = execute(s, wanted, order, st)
    keys = list(out.keys)
    df = out.df
    for stage in STAGES:
        if stage not in keys:
            df = df.withColumn(stage, F.lit(wanted[stage][0]))
            keys.append(stage)
    names = list({"|".join(sp.get(x, "none") for x in STAGES) for sp in specs})
    size = 1
    for v in wanted.values():
        size *= len(v)
    if len(names) < size:
        df = df.filter(F.concat_ws("|", *STAGES).isin(names))
    return Series(df, tuple(keys), out.longest, out.groups, out.block)


def corrupted_runs(s: Series, specs, kind: str, severity: float, order: str, st: Settings, seed: int = 42) -> Series:
    """Rows with clean, value (processed), mask and detected for every candidate."""
    hurt = corrupt.inject(s, kind, severity, seed)
    return run_candidates(hurt, specs, order, st)


def rmse_validation(s: Series, specs, kind: str, severity: float, st: Settings, order: str = OUTLIER_FIRST) -> DataFrame:
    """Reconstruction error per signal and candidate, ranked."""
    runs = corrupted_runs(s, specs, kind, severity, order, st)
    scores = validate.reconstruction_rmse(runs.df, list(runs.keys))
    by = [k for k in runs.keys if k not in STAGES]
    return validate.rank_candidates(scores, by, STAGES)


def loss_validation(s: Series, specs, kind: str, severity: float, domain: str, st: Settings, order: str = OUTLIER_FIRST,
                    event: str | None = None) -> DataFrame:
    """Weighted loss and its parts per recording and candidate."""
    runs = corrupted_runs(s, specs, kind, severity, order, st).cut()
    parts = validate.losses(runs, kind in ("spikes", "clipping"), event)
    return validate.weighted_loss(parts, domain)
