"""Tables of the engine: schemas, reads that allow for absent files, appends, keys, CSV and JSON."""

from __future__ import annotations

import json
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: columns of the stored tables
WORKLOAD = "frac string, idx bigint, request string, dup_type string, group_id string"
OUTCOMES = "seq bigint, config string, frac string, idx bigint, request string, dup_type string, group_id string, kind string, served_by string, similarity double, hit_source_idx bigint, latency_ms double, embed_ms double, lookup_ms double, model_ms double, tokens_in bigint, tokens_out bigint, cost_usd double, answer_text string, error string"
STORE = "idx bigint, request string, norm_key string, group_id string, answer_text string, model string, vec array<float>"
JUDGEMENTS = "config string, frac string, idx bigint, request string, dup_type string, answer_text string, baseline_text string, identical boolean, judge1_score int, judge2_score int, judge1_raw string, judge2_raw string, sampled_for_judge2 boolean, human_label string, note string"
PAIRS = "id string, sentence1 string, sentence2 string, label int"
CONFIGS = ("baseline", "cache", "router_cascade", "router_heuristic")
KEY = ["config", "frac", "idx"]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on a local master without one (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def apart(df: DataFrame) -> DataFrame:
    """The table as a side of a join that meets the other one in tasks and is not broadcast, which would take it through the driver."""
    return df.hint("merge")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet at ``path``; an empty table where there is none. A file that can't be read fails the query."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, root: str, schema: str, table: str | None = None) -> DataFrame:
    """All runs below ``root`` as one table: ``config`` and ``frac`` come from folders such as ``config=cache/frac=low``.

    ``table`` names a file or folder of each run, where a run has several.
    """
    if table is None:
        return read_table(spark, root, schema)
    return spark.read.schema(schema).option("basePath", root).option(
        "recursiveFileLookup", "false"
    ).parquet(f"{root}/config=*/frac=*/{table}")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace the table through Spark's commit protocol."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_rows(df: DataFrame, path: str, by: tuple[str, ...] = ("config", "frac")) -> None:
    """Add files for new rows; nothing that is there is read or written again."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def pending(todo: DataFrame, done: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``: what a resumed run has left."""
    return todo.join(done.select(*(key or KEY)), key or KEY, "left_anti")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=PAIRS, header=True, multiLine=True, escape='"')


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; every column is text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def write_queue(df: DataFrame, path: str, order: list[str], limit: int) -> None:
    """The first ``limit`` rows as one CSV file, in order; a bounded report."""
    df.orderBy(*order).limit(limit).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def json_rows(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as JSON with its fields in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(name))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small document with sorted keys, written beside its target and renamed over it in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path}.draft")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(draft, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    modes = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    modes[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(draft.toUri(), conf).rename(draft, target, modes)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The document; None where it is absent or broken."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        return json.loads(rows[0]["value"]) if rows else None
    except (AnalysisException, ValueError):
        return None
