"""Registered queries: a Spark job and, where SQL can say it, the same in SQL."""

from tidegauge.catalog.base import ORACLES, QUERIES  # noqa: F401
from tidegauge.catalog import advice, bench, cleaning, ingest, profiling, validation  # noqa: F401,E402
