"""Small helpers shared by the corpus operators.

Every operator takes a frame that has at least ``doc_id`` and ``text`` (some
also ``lang`` or ``source``), selects just those columns under names of its own
and ignores every other column, so extra columns cannot clash with the columns
that an operator adds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import shopweave.llm
from shopweave.session import ensure_checkpoint_dir

#: Tasks carry this subpackage's functions with them, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(shopweave.llm)

#: White space of the contracts: space and \t \n \v \f \r. bytes.split() cuts at exactly these.
BLANK = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Shared:
    """Tables of one run, written under the folder that all executors share.

    A written table cuts lineage: what is read again comes from storage, so a
    lost executor costs the tasks it ran and nothing before the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def null_key(column: Column | str) -> Column:
    """A string that tells null ('~') from every value ('=' and the value); joins on it lose no null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def to_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [t if t is not None else b"" for t in texts.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold about ``most_bytes``; a longer text is alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
