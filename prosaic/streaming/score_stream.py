"""Scores of texts as they arrive. Every score is a projection, so the batch operators run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prosaic.operators import score


def score_stream(texts: DataFrame, path: str, checkpoint: str, text_col: str = "text", separator: str = "\n\n") -> StreamingQuery:
    """Appends each arriving row with its slop score to Parquet; ends once what is there has been read."""
    scored = score.slop_score(texts, text_col, separator)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
