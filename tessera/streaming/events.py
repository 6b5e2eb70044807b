"""Streams of the same measures: sliding windows under a watermark, and confirmed changes of type by entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_levels(events: DataFrame, entity: str, ts: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """(entity, start, end, total, n) over sliding windows; what is later than ``late`` is dropped."""
    w = F.window(ts, length, slide)
    return events.withWatermark(ts, late).groupBy(entity, w.alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def confirmed_changes(labels: DataFrame, entity: str, label: str, order: str, horizon: int = 3) -> DataFrame:
    """(entity, from, to): a change once it has held for ``horizon`` labels. The state of an entity is three numbers; within a
    batch its labels are taken by ``order``."""
    kind = labels.schema[entity].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        settled, candidate, held = state.get if state.exists else (None, None, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values(order)
        for x in rows[label]:
            x = int(x)
            if settled is None:
                settled = x
            elif x == settled:
                candidate, held = None, 0
            else:
                held = held + 1 if x == candidate else 1
                candidate = x
                if held == horizon:
                    out.append((key[0], settled, x))
                    settled, candidate, held = x, None, 0
        state.update((settled, candidate, held))
        yield pd.DataFrame(out, columns=[entity, "from", "to"])

    return labels.groupBy(entity).applyInPandasWithState(run, f"{entity} {kind}, `from` int, `to` int", "settled int, candidate int, held int", "append", "NoTimeout")
