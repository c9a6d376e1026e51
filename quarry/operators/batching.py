"""Greedy batches by number and tokens. The fold resets and so is sequential: it runs within a partition, or over a table where one global order is asked for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_TOKENS, MAX_ITEMS = 8000, 50


def greedy(sizes: Iterable[int], max_tokens: int = MAX_TOKENS, max_items: int = MAX_ITEMS, before: bool = False) -> Iterator[int]:
    """The batch of each item. before=False closes a batch once an item fills it (it may overshoot); before=True opens a new one for an item that would overfill it."""
    batch = items = tokens = 0
    for size in sizes:
        if before and items and (tokens + size > max_tokens or items >= max_items):
            batch, items, tokens = batch + 1, 0, 0
        yield batch
        items, tokens = items + 1, tokens + size
        if not before and (items >= max_items or tokens >= max_tokens):
            batch, items, tokens = batch + 1, 0, 0


def assign_batches(df: DataFrame, order: str, tokens: str, max_tokens: int = MAX_TOKENS, max_items: int = MAX_ITEMS, before: bool = False, group: str | None = None) -> DataFrame:
    """df with batch (bigint): per group in the given order, or without group per partition, whose order is the order column within it."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch bigint"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(batch=list(greedy(pdf[tokens].tolist(), max_tokens, max_items, before)))

    if group is not None:
        return df.groupBy(group).applyInPandas(fold, schema)

    def per_partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Fold(max_tokens, max_items, before)
        for pdf in parts:
            yield pdf.assign(batch=[state.next(x) for x in pdf[tokens].tolist()])

    return df.sortWithinPartitions(order).mapInPandas(per_partition, schema)


class _Fold:
    """greedy, one item at a time, so that a partition's Arrow batches share one fold."""

    def __init__(self, max_tokens: int, max_items: int, before: bool):
        self.waiting: list[int] = []
        self.numbers = greedy(self._sizes(), max_tokens, max_items, before)

    def _sizes(self) -> Iterator[int]:
        while True:
            yield self.waiting.pop()

    def next(self, size: int) -> int:
        self.waiting.append(int(size))
        return next(self.numbers)
