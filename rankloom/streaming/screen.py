"""The screen as a stream: new files only, exactly-once outputs, resumable, counters per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.screening import Rules, reject_reason
from ..sources.readers import exists

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, category string, published_at timestamp, fetched_at timestamp"


COUNTERS = ["scanned", "accepted", "rejected", "repeated"]


def _counters(spark: SparkSession, out: str) -> dict[str, int]:
    if not exists(spark, f"{out}/counters"):
        return dict.fromkeys(["batches", *COUNTERS], 0)
    total = spark.read.parquet(f"{out}/counters").agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in COUNTERS]).first()
    return {k: int(v or 0) for k, v in total.asDict().items()}


def screen_stream(spark: SparkSession, source: str, out: str, rules: Rules, schema: str = SCHEMA, files_per_trigger: int | None = None) -> dict[str, int]:
    """Screens every parquet file below source that earlier runs haven't seen; stops when none is left.

    Of the texts with one dedupe key the one with the smallest doc_id in its batch is judged; a key that an
    earlier batch has seen, in this run or a former one, is repeated and left out. The keys seen are a table,
    so the stream itself holds no state. Writes out/accepted, out/rejected, out/seen and out/counters (parquet,
    one folder per batch number, so that a repeated batch replaces itself) and keeps its progress in
    out/checkpoint. Gives the counters of this run; rows_read is another name of scanned.
    """
    before_run = _counters(spark, out)
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(source).where("text is not null").withColumn("text", T.normalize_html(F.col("text")))
    rows = rows.withColumn("dedupe_key", T.text_hash(T.dedupe_key(F.col("text"), 160)))
    columns = rows.columns

    def save(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("dedupe_key").agg(F.min_by(F.struct(*columns), "doc_id").alias("r"), F.count("*").alias("copies"))
        if exists(spark, f"{out}/seen"):
            before = spark.read.parquet(f"{out}/seen").where(F.col("batch") != number).select("dedupe_key").withColumn("known", F.lit(True))
            once = once.join(before, "dedupe_key", "left")
        else:
            once = once.withColumn("known", F.lit(None).cast("boolean"))
        judged = once.select(*[F.col(f"r.{c}").alias(c) for c in columns], "copies", "known")
        held = judged.withColumn("reject_reason", F.when(F.col("known").isNull(), reject_reason(F.col("text"), rules))).persist()
        try:
            new = held.where("known is null").drop("known", "copies")
            new.where("reject_reason is null").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
            new.where("reject_reason is not null").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
            fresh = F.col("known").isNull()
            held.agg(
                F.sum("copies").alias("scanned"), F.count_if(fresh & F.col("reject_reason").isNull()).alias("accepted"),
                F.count_if(fresh & F.col("reject_reason").isNotNull()).alias("rejected"), F.sum(F.col("copies") - fresh.cast("int")).alias("repeated"),
            ).write.mode("overwrite").parquet(f"{out}/counters/batch={number}")
            new.select("dedupe_key").write.mode("overwrite").parquet(f"{out}/seen/batch={number}")
        finally:
            held.unpersist()

    query = rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    run = {k: v - before_run[k] for k, v in _counters(spark, out).items()}
    return run | {"rows_read": run["scanned"]}
