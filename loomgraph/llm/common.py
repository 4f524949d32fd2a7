"""What the operators on documents share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.shared import shared_dir, stored  # noqa: F401  (used by the operators)

#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text[, carried: a struct of the columns ``carry``]): only these, whatever else the table holds; a null text is empty."""
    more = [F.struct(*carry).alias("carried")] if carry else []
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``most`` bytes in ``column``."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def map_bytes(df: DataFrame, make: Callable[[], Callable[[list, list], list]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Map (doc_id, text) rows, the text as UTF-8 bytes, through a function of two lists.

    ``make`` runs once in each task (it may load a model) and gives the function, which returns one
    list or array for each column of ``schema``.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, "text"):
                columns = f(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def held_out(id_col: str | Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` modulo ``parts``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == remainder, F.lit(False))
