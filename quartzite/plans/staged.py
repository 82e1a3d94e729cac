"""Plans made of stages: each stage adds columns that later stages use.

A stage is a dict of name to SQL text. Spark gets one select per stage, so that windows that share a
partitioning share a sort; the same text, as nested subqueries, runs in any SQL engine, which is
how results are checked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

Stage = dict[str, str]


def staged(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{text} as {name}" for name, text in stage.items()])
    return df


def staged_sql(source: str, stages: list[Stage]) -> str:
    """source: a table or a parenthesised query."""
    for stage in stages:
        columns = ", ".join(f"{text} as {name}" for name, text in stage.items())
        source = f"(select *, {columns} from {source})"
    return source


def output(keys: list[str], values: list[str]) -> list[str]:
    """Keys as they are, values as doubles for comparison by hash.

    Two engines add in different orders, so full doubles never hash alike: values are cut to single
    precision, below 1e-13 to 0, and NaN becomes null. The operators return full doubles; tests
    compare those too (full_output), to a relative 1e-9.
    """
    v = "cast({0} as double)"
    return keys + [f"cast(cast(case when isnan({x}) then null when abs({x}) < 1e-13 then 0e0 else {x} end as float) as double) as {name}" for name in values for x in [v.format(name)]]


def single(v: np.ndarray) -> np.ndarray:
    """What `output` makes of values, for passes over arrays: of dozens of columns its expressions take longer than the windows."""
    return np.where(np.abs(v) < 1e-13, 0.0, v).astype(np.float32).astype(float)


def full_output(keys: list[str], values: list[str]) -> list[str]:
    """Keys as they are, values as full doubles; NaN becomes null."""
    return keys + [f"case when not isnan(cast({v} as double)) then cast({v} as double) end as {v}" for v in values]


def duck(text: str) -> str:
    """The few words that differ in the SQL of the engine that checks results."""
    for ours, theirs in (("percentile(", "quantile_cont("), ("struct(", "row("), ("collect_list(", "list("), ("named_row(", "struct_pack(")):
        text = text.replace(ours, theirs)
    return text
