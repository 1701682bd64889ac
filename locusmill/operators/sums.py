"""Sums of arrays over partitions, merged as a tree: what model fits need from their rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Partial sums that one task adds up in the first step.
FAN = 64


def tree_sum(parts: DataFrame, by: list[str], value: str = "s", part: str = "part") -> DataFrame:
    """(by..., value): element-wise sums of the arrays of each group, which have one length in a group.

    ``part`` tells the partial sums of a group apart: FAN of them meet in a task, and only their sums in the next, so that a
    group's task gets a number of arrays that hardly grows with the partitions.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*by).schema)

    def added(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key[: len(by)], np.sum(np.stack(own[value].to_numpy()), axis=0)]], columns=[*by, value])

    def held(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return added(key, own).assign(**{part: key[-1]})

    first = parts.select(*by, value, F.floor(F.col(part) / FAN).cast("long").alias(part))
    some = first.groupBy(*by, part).applyInPandas(held, f"{kinds}, `{value}` array<double>, `{part}` bigint")
    return some.groupBy(*by).applyInPandas(added, f"{kinds}, `{value}` array<double>")
