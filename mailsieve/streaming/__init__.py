"""The extraction on streams: each mail is handled by itself, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..crf.model import CrfModel
from ..plans.pipeline import extract


def read_mail_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files in a folder, one mail each, as ``path`` and ``email_text``."""
    return spark.readStream.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as email_text")


def extract_stream(mails: DataFrame, out: str, checkpoint: str, model: CrfModel | None = None, threshold: float = 0.5) -> StreamingQuery:
    """Writes the result of each mail of a stream to Parquet, exactly once, and ends when all there is has been read."""
    result = extract(mails, model or CrfModel.load(), threshold=threshold)
    return result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
