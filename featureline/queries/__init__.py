"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from featureline.queries.base import ORACLES, QUERIES
from featureline.queries import (aggregates, contracts, functions, joins, models, monitoring, observability, quality,  # noqa: F401
                                 scans, snapshots, streams, windows)

__all__ = ["ORACLES", "QUERIES"]
