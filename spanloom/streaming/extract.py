"""Extraction on a stream: each text is done on its own, so batches need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import Config, extract, tokenised


def start(texts: DataFrame, entries: DataFrame, path: str, checkpoint: str, config: Config = Config(), stop: tuple[str, ...] = ()) -> StreamingQuery:
    """Tags each batch of a stream of ``row_idx, text`` and writes it below ``path``.

    A batch goes to a folder of its number, overwritten if it runs again, so
    each text is written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        tagged = extract(tokenised(batch), entries, config, stop)["tagged"]
        tagged.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
