"""Panel counts that grow as read files arrive.

count_panel is a running sum in the state store. start_masked counts with masks: each batch of reads is counted as any table is, and its sums are written under the batch's number. A batch that is
run again after a failure writes the same folder again, so no read counts twice; every `compact_every` batches the sums so far become one snapshot, also by its number. read_masked adds up the last
snapshot and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dna
from ..operators import counting
from ..operators.windows import packed_windows
from ..session import written

COUNTS = "kmer string, count long, total long"


def stream_reads(spark: SparkSession, folder: str) -> DataFrame:
    """read_id, seq of Parquet files that arrive in folder."""
    return spark.readStream.schema("read_id long, seq string").parquet(folder)


def count_panel(reads: DataFrame, panel: DataFrame) -> DataFrame:
    """kmer, total of the panel's k-mers in a stream of reads. The state has a row for each k-mer of the panel at most, so it needs no watermark; write it in complete or update mode."""
    keys = panel.select("kmer").distinct().withColumn("code", dna.encode(F.col("kmer")))
    return packed_windows(reads).join(keys, "code").groupBy("kmer").agg(F.count("*").alias("total"))


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders number=... in folder whose writing has ended."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    own = [f.getPath() for f in system.listStatus(path) if f.getPath().getName().startswith("number=")]
    return sorted(int(p.getName().split("=")[1]) for p in own if system.exists(p.suffix("/_SUCCESS")))


def read_masked(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """kmer, count, total as counted so far, or by the batches up to a number."""
    within = lambda numbers: [n for n in numbers if upto is None or n <= upto]
    snapshot = max(within(finished(spark, f"{folder}/snapshots")), default=None)
    batches = [n for n in within(finished(spark, f"{folder}/batches")) if snapshot is None or n > snapshot]
    paths = [f"{folder}/batches/number={n}" for n in batches] + ([] if snapshot is None else [f"{folder}/snapshots/number={snapshot}"])
    rows = spark.read.schema(COUNTS).parquet(*paths) if paths else spark.createDataFrame([], COUNTS)
    return rows.groupBy("kmer").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def start_masked(reads: DataFrame, masks: DataFrame, folder: str, checkpoint: str, compact_every: int = 50, **trigger) -> StreamingQuery:
    """Starts to count masks (kmer, mask) in a stream of reads (seq) into folder (a shared one); started again with the same checkpoint, it goes on where it was stopped."""
    known = written(masks.select("kmer", "mask"), "stream_masks")

    def count(batch: DataFrame, number: int) -> None:
        counting.count_masked(batch, known).write.mode("overwrite").parquet(f"{folder}/batches/number={number}")
        if number % compact_every == compact_every - 1:
            read_masked(batch.sparkSession, folder, number).write.mode("overwrite").parquet(f"{folder}/snapshots/number={number}")

    return reads.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
