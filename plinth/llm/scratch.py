"""Tables written between the steps of an operator, in the folder all executors share."""

import re

from pyspark.sql import DataFrame

from plinth.plans.shared import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir", "steady"]

#: What may give its rows in another order, or other rows, when it runs again.
UNSTEADY = re.compile(r"Exchange|Limit|TakeOrdered|Sample|MapIn|FlatMap|rand\(|uuid\(")


def steady(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows as something that can be read twice in the same order: files and plain selections of them as they are, all else kept first."""
    return scratch.keep(rows, "input") if UNSTEADY.search(rows._jdf.queryExecution().executedPlan().toString()) else rows
