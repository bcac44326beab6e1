"""Shared helpers: row-wise Python in Arrow batches, and cutting lineage durably."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows that a task holds as Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(
    df: DataFrame,
    start: Callable[[], Callable[..., list[tuple]]],
    schema: str,
) -> DataFrame:
    """Rows that ``start()(*columns)`` returns for every slice of ``SLICE_ROWS`` rows of ``df``.

    ``start`` is called once per task, so that it can unpack broadcasts or compile
    patterns; the function gets one list per column of ``df``. Rows stream through in
    Arrow batches. An empty table gives an empty table.
    """
    out_type = StructType.fromDDL(schema)
    names = [f.name for f in out_type.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_type)
        fn = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = fn(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])
                if rows:
                    values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(v), type=arrow.field(n).type)
                            for n, v in zip(names, values, strict=True)
                        ],
                        schema=arrow,
                    )

    return df.mapInArrow(run, out_type)


def map_rows(
    df: DataFrame,
    start: Callable[[], Callable[..., list[tuple]]],
    schema: str,
) -> DataFrame:
    """Rows that ``start()(*row)`` returns for every row of ``df``; see ``map_slices``."""

    def start_slices() -> Callable[..., list[tuple]]:
        fn = start()
        return lambda *columns: [out for row in zip(*columns, strict=True) for out in fn(*row)]

    return map_slices(df, start_slices, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_types(df: DataFrame, columns: Sequence[str]) -> str:
    """DDL of some columns of ``df``, for the schema of ``map_rows``."""
    by_name = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {by_name[c]}" for c in columns)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``.

    The files are in the shared folder, so they outlive the executors that wrote them.
    Only where no folder is set, as in tests, a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def blocks_of(rows: Iterator[Any], weight: Callable[[Any], int], limit: int) -> Iterator[list]:
    """``rows`` in lists whose total weight exceeds ``limit`` by less than one row."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += weight(row)
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def ascii_lower(text: str) -> str:
    """A-Z in lower case; other letters stay as they are."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
