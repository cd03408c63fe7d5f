"""Extension: the manifest as a stream.  New text files become sentence rows once each (exactly-once by batch id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import text as S


def sentence_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, s, sentence) of text files as they arrive, one document a file."""
    docs = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return docs.select("path", F.posexplode(S.sentences(F.col("value"))).alias("s", "sentence"))


def write_manifest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch goes to its own folder, overwritten if the batch is run again after a failure."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
