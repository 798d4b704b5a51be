"""Named queries over the benchmark tables, each with its SQL counterpart where one exists."""

from tablefit.catalogue import discovery, fitness, portfolio, profiling, quality, repair, validation  # noqa: F401
from tablefit.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
