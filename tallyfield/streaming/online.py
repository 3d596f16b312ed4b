"""Online exponentially weighted variances, and append mode for transactions, on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfield.operators.risk import decay


def ewma_variance_stream(residuals: DataFrame, halflife: float = 21.0) -> DataFrame:
    """(ticker, date, idio_var) as each batch arrives: the state of a ticker is one number.

    ``residuals`` is a stream of (ticker, date, residual); dates of a ticker come in order across batches
    and may come in any order within one.
    """
    lam = decay(halflife)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("date")  # one ticker's rows of one micro-batch
        for r in rows["residual"]:
            value = r * r if value is None else lam * value + (1 - lam) * r * r
        state.update((value,))
        yield pd.DataFrame({"ticker": [key[0]], "date": [rows["date"].iloc[-1]], "idio_var": [value]})

    kind = residuals.schema["ticker"].dataType.simpleString()
    return residuals.groupBy("ticker").applyInPandasWithState(step, f"ticker {kind}, date date, idio_var double", "value double", "update", GroupStateTimeout.NoTimeout)


def append_stream(transactions: DataFrame, folder: str, checkpoint: str):
    """Append a stream of transactions to a table; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")

    return transactions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
