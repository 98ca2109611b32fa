"""Stateless operators over a stream of ledger rows. Matching and sums over a batch need the whole batch and don't stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize, validate
from ..sources.tables import as_source, columns_of


def ledger_stream(spark: SparkSession, folder: str, source: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet ledger files of a known source."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns_of(source)])
    return as_source(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder), source)


def validated(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised valid rows, failing rows with their error) of a stream; both are streams."""
    valid, invalid = validate.partition(stream)
    return normalize.normalize(valid), invalid


def ingest(stream: DataFrame, valid_path: str, invalid_path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write each micro-batch's valid and failing rows, in folders by batch number, so that a batch delivered again replaces itself.
    then: called with the normalised rows of each batch. Runs until what is there has been read."""

    def batch(df: DataFrame, number: int) -> None:
        valid, invalid = validated(df)
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        invalid.write.mode("overwrite").parquet(f"{invalid_path}/batch={number}")
        if then:
            then(valid, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
