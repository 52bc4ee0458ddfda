"""Ordered work on the rows of one screen: one shuffle by key, then batches of sorted rows, group by group."""

from __future__ import annotations

from collections.abc import Callable
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def per_group(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``kernel`` on the rows of each group, sorted by ``order``; its rows get the group's keys in front.

    Rows are streamed in batches and only the group at hand is held, so memory is that of the largest group: one screen's
    elements, which the size of a page bounds. Null keys are a group of their own. A window sorts the rows, so those that
    lie by ``keys`` already aren't dealt out again.
    """
    key_fields = [df.schema[k] for k in keys]
    out = StructType([*key_fields, *_parse_datatype_string(schema).fields])
    names = [f.name for f in out.fields]
    own = names[len(keys) :]
    values = itemgetter(*own) if len(own) > 1 else lambda r, c=own[0]: (r[c],)

    def listed(s: pd.Series) -> list:
        return s.astype(object).where(s.notna(), None).tolist() if s.dtype != object and s.hasnans else s.tolist()

    def run(batches):
        held: list[dict] = []
        now = None

        def done(rows: list[dict], key: tuple) -> list[tuple]:
            return [key + values(r) for r in kernel(rows)]

        def frame(made: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*made, strict=True) if made else [[]] * len(names), strict=True)})

        for pdf in batches:
            made: list[tuple] = []
            cols = {c: listed(pdf[c]) for c in pdf.columns if c != "_place"}
            rows = [dict(zip(cols, v, strict=True)) for v in zip(*cols.values(), strict=True)]
            at = list(zip(*[cols[k] for k in keys], strict=True))
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and at[a] != now:
                    made += done(held, now)
                    held = []
                now = at[a]
                held += rows[a:b]
            if made:
                yield frame(made)
        if held:
            yield frame(done(held, now))

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).mapInPandas(run, out)
