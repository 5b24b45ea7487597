"""What the operators of this subpackage share: table access, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1024


def session_of(df: DataFrame) -> SparkSession:
    """The session of a DataFrame, with Arrow batches small enough for very long texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir where the cluster
    names one. Only where that is unset (tests on one machine) a temporary folder is taken."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor loses none."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_texts(df: DataFrame, extra: list[str], schema: str, each: Callable[[list[str], pa.RecordBatch], list]) -> DataFrame:
    """Arrow batches of `extra` columns and a text column `text` (null: empty) through each(texts, batch),
    which gives the new columns' arrays. The extra columns come first in the result, unchanged."""
    session_of(df)
    kinds = dict(df.dtypes)
    source = df.select(*[F.col(f"`{c}`") for c in extra], text_or_empty().alias("text"))
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in extra), schema])
    names = [*extra, *(p.split()[0] for p in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = each(batch.column(batch.num_columns - 1).to_pylist(), batch)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], *new], names=names)

    return source.mapInArrow(run, full)


def rewrite_rows(df: DataFrame, each: Callable[[pa.RecordBatch, list[str], int], pa.RecordBatch]) -> DataFrame:
    """Batches with all their columns through each(batch, texts, place of the text), which gives a batch of the same
    columns; null texts are given as empty ones."""
    session_of(df)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield each(b, [t or "" for t in b.column(at).to_pylist()], at)

    return df.mapInArrow(run, df.schema)


def labelled(docs: DataFrame, labels: DataFrame, name: str, rows: int) -> DataFrame:
    """(doc_id, text, `name`): the texts of at most `rows` labelled documents (by a hash of doc_id; all rows of a chosen
    one). labels: one row for each doc_id. The bound holds for labels that have a document, so that others use up none of
    it; the chosen ones are broadcast, which `rows` bounds, and no text is shuffled."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = labels.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return ids_and_texts(docs).join(F.broadcast(chosen.select("doc_id", name)), "doc_id")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
