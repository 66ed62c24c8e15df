"""What the text operators share: the word rule and passing columns through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space; bytes.split() and bytes.strip() use the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch: what a worker holds at once beside one text.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch limits where they are higher; texts can be long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


@dataclass(frozen=True)
class Step:
    """Columns made from other columns of the same row: ``fn`` gets and gives one Arrow array each."""

    inputs: tuple[str, ...]
    fields: tuple[T.StructField, ...]
    fn: Callable[..., list[pa.Array]]


def with_arrow(df: DataFrame, *steps: Step, keep: list[str] | None = None) -> DataFrame:
    """Add the steps' columns in one pass over Arrow batches; a step may read what an earlier one made.

    ``keep`` names the columns of the result (all by default). A column of ``df`` that has the name
    of a made column, whatever the case of its letters, gives way to it.
    """
    small_batches(df.sparkSession)
    made = {f.name: f for s in steps for f in s.fields}
    low = {n.lower() for n in made}
    needed = {i for s in steps for i in s.inputs}
    have = [f for f in df.schema.fields if f.name.lower() not in low or f.name in needed]
    if keep is not None:
        have = [f for f in have if f.name in keep or f.name in needed]
    out = [f for f in have if (keep is None or f.name in keep) and f.name.lower() not in low]
    out += [f for n, f in made.items() if keep is None or n in keep]
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            for s in steps:
                cols |= dict(zip([f.name for f in s.fields], s.fn(*[cols[i] for i in s.inputs]), strict=True))
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return df.select(*[F.col(f"`{f.name}`") for f in have]).mapInArrow(run, T.StructType(out))


def raw_texts(text: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; none for null."""
    return [b if b is not None else b"" for b in text.cast(pa.binary()).to_pylist()]


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
