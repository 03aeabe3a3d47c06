"""Operator 2: exact deduplication as a stateful stream, DataFrame functions only.

A file stream groups rows by the SHA-256 of the normalised text (A-Z lower-cased, null as empty). Its keyed state lies on disk in the shared
folder, with no watermark, so a key never expires: every micro-batch adds one segment of (digest, largest doc_id as stable
identifier, file and row position of that row as content locator, number of rows), and the state of a digest is the combination of its rows over all
segments. A batch that runs again replaces its own segment. Rows are combined in
each map task first, so a hot text sends one row per task. Spark's own RocksDB store holds 4 MB or more of disk per
shuffle partition and copy, which breaks the disk limit at 211 partitions.

On hits (digests with more than one row) the full bytes are compared: the smallest and the largest normalised text of such a digest
must be equal. If not (a digest collision), its rows are grouped by the text itself.

Rows: one per input row. Nulls and ties: null text equals empty text; a null doc_id is below every other, so it stays only in a
group of null doc_ids; rows that repeat the doc_id that stays are all kept = true, since nothing tells them apart. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of the hit list that may be broadcast: 32 bytes of digest each, so 4 MB or so. Above it the join is shuffled.
BROADCAST_DIGESTS = 50_000


def normalised() -> Column:
    return common.ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def digest_of(norm: Column, bits: int = 256) -> Column:
    """Lowercase hex digest; fewer bits only to test collisions."""
    return F.substring(F.sha2(norm.cast("binary"), 256), 1, bits // 4)


def run_stream(spark: SparkSession, path: str, state: str, schema, bits: int = 256, files_per_batch: int | None = None) -> None:
    """Bring the state under ``state`` up to the files in ``path``. Calling it again takes in new files only."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"  # a file stream takes a folder or a pattern
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path).select(
        digest_of(normalised(), bits).alias("digest"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
    )

    def add(batch: DataFrame, number: int) -> None:
        keyed = batch.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        keyed.write.mode("overwrite").parquet(f"{state}/segments/segment={number}")  # a repeated batch replaces its own segment

    stream = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()


def _merged(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/segments").groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The keyed state: digest, keep_id, group_size, locator."""
    held = spark.read.parquet(f"{state}/segments")
    several = held.agg(F.countDistinct("segment") > 1).first()[0]
    whole = _merged(spark, state) if several else held
    return whole.select("digest", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("keep.locator").alias("locator"))


def exact_dedup(spark: SparkSession, path: str, bits: int = 256, state: str | None = None) -> DataFrame:
    """Verdict per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256, locator of the kept row."""
    docs = spark.read.parquet(path)
    state = state or common.scratch(spark, "dedup-state")
    run_stream(spark, path, state, docs.schema, bits)
    if docs.isEmpty():
        groups = spark.createDataFrame([], "digest string, keep_id long, group_size long, locator struct<file:string,row:long>")
    else:
        groups = read_state(spark, state)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("digest", digest_of(F.col("norm"), bits))

    hits = groups.where("group_size > 1").select("digest")
    few = hits.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    checked = rows.join(F.broadcast(hits) if few else hits, "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    clash = common.materialize(checked.where("least <> most").select("digest"), "dedup-clash")

    verdict = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")]
    if bits == 256 and clash.isEmpty():
        return rows.select("doc_id", "digest").join(groups, "digest").select(*verdict, F.col("digest").alias("text_sha256"), "locator")
    whole = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    by_text = whole.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sound = whole.join(clash, "digest", "left_anti").drop("norm").join(groups, "digest").select(*verdict, "text_sha256", "locator")
    split = whole.join(clash, "digest", "left_semi").join(by_text, "norm").select(*verdict, "text_sha256", F.lit(None).cast(groups.schema["locator"].dataType).alias("locator"))
    return sound.unionByName(split)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without copies: the largest doc_id of each text stays, and one of rows that repeat it."""
    spark = docs.sparkSession
    path = common.scratch(spark, "dedup-input")
    common.materialize(docs.select("doc_id", "text"), "dedup-input", path)
    verdict = common.materialize(exact_dedup(spark, path).select("doc_id", "kept", "text_sha256"), "dedup-verdict")
    common.drop_folder(spark, path)
    sha, own = common.fresh(docs, "sha"), common.fresh(docs, "id")
    marked = docs.withColumns({sha: F.sha2(normalised().cast("binary"), 256), own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))})
    gone = verdict.where("not kept").select(F.col("text_sha256").alias(sha), F.coalesce("doc_id", F.lit(-(1 << 63))).alias(own)).distinct()
    few = gone.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    left = marked.join(F.broadcast(gone) if few else gone, [sha, own], "left_anti")
    again = common.materialize(verdict.where("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("text_sha256").alias(sha)), "dedup-again")
    if not again.isEmpty():
        left = left.join(again, sha, "left_anti").unionByName(left.join(again, sha, "left_semi").dropDuplicates([sha]))
    return left.select(*docs.columns)
