"""Exact deduplication as a stream with disk-backed keyed state.

Every document is an arrival: digest, stable identifier, content locator. A streaming aggregation keyed by the digest
keeps in RocksDB, without watermark or expiry, how many arrivals had that digest and which of them stays. Spark combines
the arrivals of a task before they are shuffled, so that one text may be a third of all rows. Where a digest was hit
more than once, the full bytes of its texts are compared; texts that merely share a digest are told apart.

``append`` may be called again for later documents with the same folder: only new arrivals are read, the state is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import maybe_broadcast, scratch, unused

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class ExactDedup:
    """State of one deduplication in a folder that all executors share.

    ``id_col`` orders equal texts: the largest stays. Null texts count as empty, null ids as smaller than all others.
    Rows equal in all columns are counted one by one, and one of them stays. ``digest`` is a parameter so that tests
    can force collisions.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256):
        self.spark, self.id_col, self.text_col, self.digest = spark, id_col, text_col, digest
        self.folder = folder or scratch(spark, "exact-dedup")

    def _keyed(self, docs: DataFrame) -> DataFrame:
        text = F.coalesce(docs[self.text_col].cast("string"), F.lit(""))
        return docs.select(docs[self.id_col].cast("long").alias("id"), text.alias("body"), self.digest(text).alias("digest"))

    def append(self, docs: DataFrame) -> None:
        """Logs the documents as arrivals and lets the stream take them into its state."""
        arrivals = self._keyed(docs).select(
            "id", "digest", F.octet_length("body").cast("long").alias("bytes"), F.input_file_name().alias("locator"),
            F.concat_ws("-", F.expr("uuid()"), F.monotonically_increasing_id()).alias("row"),
        )
        arrivals.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/arrivals")
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, STATE_STORE)
        try:
            stream = self.spark.readStream.schema(self.arrivals().schema).parquet(f"{self.folder}/arrivals")
            state = stream.groupBy("digest").agg(F.max(F.struct("id", "row", "locator", "bytes")).alias("stays"), F.count(F.lit(1)).alias("n"))
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/state")
                .trigger(availableNow=True)
                .foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/updates/batch={k}"))
                .start()
            )
            query.awaitTermination()
        finally:
            self.spark.conf.unset(PROVIDER) if before is None else self.spark.conf.set(PROVIDER, before)

    def arrivals(self) -> DataFrame:
        return self.spark.read.schema("id long, digest binary, bytes long, locator string, row string").parquet(f"{self.folder}/arrivals")

    def state(self) -> DataFrame:
        """The state's current rows: what the last update of each digest said."""
        schema = "digest binary, stays struct<id: long, row: string, locator: string, bytes: long>, n long, batch long"
        updates = self.spark.read.schema(schema).parquet(f"{self.folder}/updates/*")
        last = updates.groupBy("digest").agg(F.max_by(F.struct("stays", "n"), "batch").alias("s"))
        return last.select("digest", "s.stays", "s.n")

    def result(self, docs: DataFrame) -> DataFrame:
        """One row per arrival: id, digest, keep_id, group_size, kept. ``docs``: all documents appended so far, to compare bytes."""
        hits = self.state().where("n > 1")
        known = maybe_broadcast(hits.select("digest"), 64)
        rows = self._keyed(docs).join(known, "digest", "left_semi")
        texts = rows.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
        differ = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
        found = self.arrivals().join(maybe_broadcast(hits, 256), "digest", "left")
        plain = found.select(
            "id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("n").isNull() | (F.col("stays.row") == F.col("row"))).alias("kept"),
        )
        if differ.isEmpty():
            return plain
        return plain.join(differ, "digest", "left_anti").unionByName(self._apart(rows.join(differ, "digest", "left_semi")))

    @staticmethod
    def _apart(rows: DataFrame) -> DataFrame:
        """Exact groups of texts that share a digest."""
        rows = rows.groupBy("digest", "body", "id").agg(F.count(F.lit(1)).alias("same"))
        stays = rows.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("same").alias("group_size"))
        rows = rows.join(stays, ["digest", "body"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
        return rows.select("id", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept. An empty table gives no rows.

    Null texts count as empty; null ids are smaller than all others; repeated rows are counted one by one, and one of them
    stays; other columns aren't read, whatever their names.
    """
    state = ExactDedup(docs.sparkSession, None, id_col, text_col)
    state.append(docs)
    return state.result(docs)


def keep_last_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without copies, all their columns unchanged: of equal texts, one row with the largest id stays.

    Null texts count as empty; null ids are smaller than all others; rows alike in id and text leave one of them; columns
    may have any names; an empty table stays empty.
    """
    state = ExactDedup(docs.sparkSession, None, id_col, text_col)
    state.append(docs)
    ident, digest, again, body = (unused(docs, x) for x in ("id", "digest", "again", "text"))
    gone = state.result(docs).where("not kept").select(F.col("id").alias(ident), F.col("digest").alias(digest), F.col("id").eqNullSafe(F.col("keep_id")).alias(again))
    gone = gone.distinct()
    repeated = gone.where(again)
    names = docs.columns
    docs = docs.withColumn(body, F.coalesce(docs[text_col].cast("string"), F.lit("")))
    on = docs[id_col].cast("long").eqNullSafe(F.col(ident)) & (sha256(docs[body]) == F.col(digest))
    rest = docs.join(maybe_broadcast(gone, 64), on, "left_anti").select(*names)
    if repeated.isEmpty():
        return rest
    once = docs.join(maybe_broadcast(repeated, 64), on, "left_semi").dropDuplicates([id_col, body]).select(*names)
    return rest.unionByName(once)
