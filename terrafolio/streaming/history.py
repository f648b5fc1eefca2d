"""The listing history over a stream of complete batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.operators.history import STATE, fold


def follow(stream: DataFrame, folder: str, checkpoint: str):
    """Starts folding a stream (codigo, preco, visto) into state tables below ``folder``, one a batch; returns the query.

    Whether a listing has left is only known from a whole batch, so each micro-batch is folded by ``foreachBatch``. The state of
    batch n is read from ``folder``/n-1; a batch that is repeated after a failure overwrites its own table, so it counts once.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{folder}/{n - 1}") if n else spark.createDataFrame([], STATE)
        now = batch.agg(F.max("visto")).first()[0]
        if now is None:
            state.write.mode("overwrite").parquet(f"{folder}/{n}")
        else:
            fold(state, batch.select("codigo", "preco"), now).write.mode("overwrite").parquet(f"{folder}/{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).queryName(f"history-{uuid.uuid4().hex[:8]}").start()
