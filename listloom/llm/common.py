"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.session import fresh_path, shared_dir

#: Bytes of one Arrow batch on its way to a Python task, so that long texts come in small batches.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows; the session's own limit stays where one is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB") or 0) >= 2**28:
        spark.conf.set(key, str(BATCH_BYTES))


def short_plan_texts(spark: SparkSession) -> None:
    """Bound the text of a plan that the driver keeps for every execution; a session's own bound stays."""
    key = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(key, str(2**31 - 16)).rstrip("bB") or 0) >= 2**28:
        spark.conf.set(key, str(1 << 16))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    shared_dir(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns stay behind."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, without decoding them; null gives b""."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def read_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """A vocabulary or model file, for a broadcast; refused beyond ``limit`` bytes."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} has more than {limit} bytes")
    return data


def frequent(totals: DataFrame, column: str, share: int) -> DataFrame:
    """Rows that make up at least one in ``share`` of the whole of ``column``.

    There are at most ``share`` of them at any input size, so they may be sent to every task; every
    other row has less than that part of the whole, so that none is a hot join key.
    """
    whole = totals.agg(F.sum(column)).first()[0] or 0
    return totals.where(F.col(column) * F.lit(share) >= F.lit(whole))
