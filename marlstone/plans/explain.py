"""Plans as rows, without running them."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "simple") -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def explain(df: DataFrame) -> DataFrame:
    """``step, depth, operation, detail`` for each node of the physical plan, the result first."""
    rows = []
    for line in plan_text(df).splitlines():
        m = re.match(r"^([\s:|]*(?:\+-\s?)?)(?:\*\(\d+\)\s)?([A-Z]\w+)\s?(.*)$", line)
        if m and not line.startswith("=="):
            rows.append((len(rows) + 1, len(m[1]) // 3, m[2], m[3][:500]))
    return df.sparkSession.createDataFrame(rows, "step int, depth int, operation string, detail string")
