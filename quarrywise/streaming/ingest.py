"""Incremental ingest: files that arrive replace what an index had of the same source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunks import chunk_documents


def ingest_documents(spark: SparkSession, source: str, schema: str, index: str, progress: str, buckets: int = 512) -> StreamingQuery:
    """Chunks documents (book_id, title, author, source_path, text) as their Parquet files arrive, up to what is there now.

    The index is partitioned by a hash of book_id, and a batch rewrites only the partitions of its
    books, so that a book that comes again replaces its chunks and a batch that is run again changes nothing.
    Of a book that comes several times in a batch the one of the newest file counts.
    """
    bucket = F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        newest = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("seen"), F.desc(F.xxhash64("text", "title"))))
        last = batch.withColumn("nth", newest).where("nth = 1").drop("nth", "seen")
        new = chunk_documents(last).withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))
        touched = [r.b for r in last.select(bucket.alias("b")).distinct().collect()]
        jvm_path = s._jvm.org.apache.hadoop.fs.Path(index)
        if jvm_path.getFileSystem(s._jsc.hadoopConfiguration()).exists(jvm_path):
            old = s.read.schema(new.schema).parquet(index).where(F.col("bucket").isin(touched))
            new = old.join(last.select("book_id"), "book_id", "left_anti").select(*new.columns).unionByName(new)
            staged = f"{progress}/staged"
            new.write.mode("overwrite").parquet(staged)
            new = s.read.schema(new.schema).parquet(staged)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(index)

    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_modification_time").alias("seen"))
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{progress}/stream").trigger(availableNow=True).start()
