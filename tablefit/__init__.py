"""tablefit: how fit is a table for an analytics task, and how to make it fitter.

Every operator takes Spark DataFrames and returns Spark DataFrames; ``by``
names segment columns, so that one job scores all segments of a table.
"""

from tablefit.functions.lookups import DIMENSIONS, TASKS
from tablefit.plans.evaluate import evaluate, infer_and_evaluate
from tablefit.plans.closed_loop import remediate_and_validate
from tablefit.sources.readers import read_table

__all__ = [
    "DIMENSIONS",
    "TASKS",
    "evaluate",
    "infer_and_evaluate",
    "read_table",
    "remediate_and_validate",
]
