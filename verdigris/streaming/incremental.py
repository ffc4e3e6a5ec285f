"""Scores for records that arrive as files: row-local operators on a stream, appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.functions import arrays as A
from verdigris.operators import lifecycle
from verdigris.sources import schema as S


def stream_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(S.RECORD).json(path)


def score_stream(records: DataFrame) -> DataFrame:
    """Normalise, cluster by equality and score; no state is kept between records."""
    r = lifecycle.normalized(records)
    return lifecycle.clustered(r, A.first_ids(F.col("normalized_answers")))


def write_scores(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come since the last run, exactly once, and stops."""
    return score_stream(records).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
