"""User functions on batches of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def with_converter(docs: DataFrame, fn: Callable[[pd.Series], pd.Series], column: str = "text") -> DataFrame:
    """``column`` converted by ``fn`` (one series in, one of equal length out).

    When a batch fails its rows are tried one by one, so only the rows at fault
    carry a message in ``error`` (and keep null in ``converted``).
    """

    def single(value: str) -> tuple[str | None, str | None]:
        try:
            return fn(pd.Series([value])).iloc[0], None
        except Exception as exc:  # noqa: BLE001 - the message is the result
            return None, f"{type(exc).__name__}: {exc}"

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = fn(batch[column])
                yield batch.assign(converted=out.to_numpy(), error=None)
            except Exception:  # noqa: BLE001
                pairs = [single(v) for v in batch[column]]
                yield batch.assign(converted=[p[0] for p in pairs], error=[p[1] for p in pairs])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(convert, f"{fields}, converted STRING, error STRING")
