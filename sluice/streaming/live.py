"""The gateway as a stream: every request is checked, looked up among stored answers, answered by its mode, and stored.

A request is answered from the cache if an earlier stored answer has its key, or is similar enough. Whether it is stored
depends on what was stored anywhere before, so no operator that keeps its state by key could decide it alone:
each micro-batch is decided as a whole against the stored table (``greedy_cache``), and written by its number. A batch that runs
again after a failure replaces what it wrote, and reads only what batches before it stored.

Tables below the root: ``answers``, ``errors`` and ``stored``, each with a folder for every batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import has_error, is_blank, normalize_exact
from ..operators.cache import greedy_cache
from ..sources.tables import apart, cut_lineage
from .gateway import accepted, by_mode, failed, rejected

REQUESTS = "idx bigint, request string, mode string, vec array<float>, cheap struct<text string, tokens_in bigint, tokens_out bigint>, dear struct<text string, tokens_in bigint, tokens_out bigint>, error string"
ANSWERS = "idx bigint, norm_key string, mode string, hit boolean, kind string, similarity double, hit_source_idx bigint, escalated boolean, served_by string, answer_text string, tokens_in bigint, tokens_out bigint, stored boolean"
ERRORS = "idx bigint, status int, error_type string, error_message string, param string"
STORED = "idx bigint, norm_key string, vec array<float>, answer_text string, served_by string"
#: Puts what is stored before all requests of a batch, whatever their numbers.
_BEFORE = 1 << 62


def decide(requests: DataFrame, stored: DataFrame, threshold: float, param: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(answers, errors, newly stored)`` of a batch of ``requests`` against ``stored``.

    Requests are taken in ``idx`` order, which is unique. Without text, or with an unknown mode, one is an error of 400. Mode
    ``expensive`` passes the cache by. What the cache does not answer is answered by the mode; an upstream error makes it
    one of 500. Only answers that are not blank are stored. A null vector is answered by its key only.
    """
    # the request itself and both sides' answers are as long as texts, and nothing after this reads them
    good = cut_lineage(by_mode(accepted(requests)).select(
        "idx", normalize_exact(F.col("request")).alias("norm_key"), "mode", "vec", "error", "escalated", "served_by", "answer_text", "tokens_in", "tokens_out"
    ))
    lost = has_error(F.col("error"))
    asks = good.where("mode <> 'expensive'").select(
        "idx", "norm_key", "vec", (~lost & ~is_blank(F.col("answer_text"))).alias("keep"), F.lit(False).alias("old")
    )
    known = stored.select((F.col("idx") - _BEFORE).alias("idx"), "norm_key", "vec", F.lit(True).alias("keep"), F.lit(True).alias("old"))
    told = greedy_cache(asks.unionByName(known), threshold, key="norm_key", storable="keep", stored="old")
    told = told.withColumnRenamed("kind", "told").withColumn("hit", F.col("told") != "miss")
    hit = F.coalesce("hit", F.lit(False))
    answers = good.select("idx", F.col("answer_text").alias("old_text"), F.col("served_by").alias("old_by")).unionByName(
        stored.select((F.col("idx") - _BEFORE).alias("idx"), F.col("answer_text").alias("old_text"), F.col("served_by").alias("old_by"))
    )
    told = told.join(apart(answers.withColumnRenamed("idx", "hit_source_idx")), "hit_source_idx", "left")
    rows = good.join(apart(told), "idx", "left")
    source = F.when(F.col("hit_source_idx") < 0, F.col("hit_source_idx") + _BEFORE).otherwise(F.col("hit_source_idx"))
    free = lambda c: F.when(hit, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    rows = cut_lineage(rows.select(
        "idx", "norm_key", "vec", "mode", hit.alias("hit"), F.coalesce("told", F.lit("model_direct")).alias("kind"), "similarity",
        source.alias("hit_source_idx"), (F.col("escalated") & ~hit).alias("escalated"), F.when(hit, F.col("old_by")).otherwise(F.col("served_by")).alias("served_by"),
        F.when(hit, F.col("old_text")).otherwise(F.col("answer_text")).alias("answer_text"), free("tokens_in"), free("tokens_out"),
        (F.col("told").isNotNull() & ~hit & ~lost & ~is_blank(F.col("answer_text"))).alias("stored"), F.when(~hit, F.col("error")).alias("error"),
    ))
    lost = has_error(F.col("error"))
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    errors = rejected(requests).select("idx", "status", "error_type", "error_message", F.lit(None).cast("string").alias("param"))
    errors = errors.unionByName(failed(rows, param).select("idx", "status", "error_type", "error_message", "param"))
    return rows.where(~lost).select(*names), errors, rows.where("stored").select("idx", "norm_key", "vec", "answer_text", "served_by")


@dataclass
class Live:
    """A gateway's tables. ``keep`` batches of stored answers are looked up, the last ones; all if it is null."""

    spark: SparkSession
    root: str
    threshold: float
    param: str = "BASE_URL"
    keep: int | None = None

    def _batches(self, table: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listStatus(path) if files.exists(path) else []
        names = [f.getPath().getName() for f in found if files.exists(f.getPath().suffix("/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def table(self, table: str, before: int | None = None, since: int = 0) -> DataFrame:
        """Rows of the finished batches of a table, from ``since`` on and before another."""
        schema = {"answers": ANSWERS, "errors": ERRORS, "stored": STORED}[table]
        there = [b for b in self._batches(table) if b >= since and (before is None or b < before)]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table}/batch={b}" for b in there))

    def take(self, batch: DataFrame, number: int) -> None:
        """Decide a batch and write what it gives; once more gives the same. Expired answers are deleted."""
        since = max(0, number - self.keep) if self.keep is not None else 0
        answers, errors, new = decide(batch, self.table("stored", before=number, since=since), self.threshold, self.param)
        for table, rows in (("answers", answers), ("errors", errors), ("stored", new)):
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={number}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in (b for b in self._batches("stored") if b < since):
            gone = path(f"{self.root}/stored/batch={old}")
            gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    def serve(self, requests: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start over what is there now; a later start with the same ``checkpoint`` goes on after the last batch."""
        return requests.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def health(self) -> DataFrame:
        """``(ok, cache_size)``: the stored answers that the next request is looked up among."""
        last = max(self._batches("stored"), default=-1)
        since = max(0, last + 1 - self.keep) if self.keep is not None else 0
        return self.table("stored", since=since).agg(F.lit(True).alias("ok"), F.count(F.lit(1)).alias("cache_size"))
