"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laminet.session import cut, discard

__all__ = ["constant", "cut", "discard", "marked", "marks", "own_name", "pieces", "table", "tables", "with_fields"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterable[pa.RecordBatch], *columns: str, most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in slices of about most_bytes of some string columns (one row with long texts may be more)."""
    for batch in batches:
        sizes = [sum(n or 0 for n in row) for row in zip(*[pc.binary_length(batch.column(batch.schema.get_field_index(c))).to_pylist() for c in columns], strict=True)]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def own_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores put before it until no column of df has that name in any case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """df's schema and further fields (name, type); a column of df by such a name is an error the caller avoids."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def constant(values: np.ndarray) -> Column:
    """An array<bigint> for use within a plan. As a literal it would be printed with each plan, several times a query, and the driver would
    make and hold that text; the result of a subquery over a local row isn't printed and needs no job."""
    row = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))
    return SparkSession.active().createDataFrame(pa.table({"x": row})).scalar()


#: Bits of the table that tells which documents may have to be looked up. It is of a fixed size; beyond what it can tell apart, more
#: documents than needed are looked up, and the joins that follow are exact.
MARKS = 1 << 19


def tables(rows: DataFrame, **sizes: int) -> list[bytes]:
    """For each of some columns, a table of so many bits with those of its values' hashes set; as many as the sizes / 32768 rows of 4 KiB come
    to the driver, in one job for all."""
    each = [F.struct(F.lit(k).alias("k"), (F.pmod(F.xxhash64(c), F.lit(size)) + 1).alias("bit")) for k, (c, size) in enumerate(sizes.items())]
    bits = rows.select(F.explode(F.array(*each)).alias("x")).select("x.k", "x.bit")  # number 0 would be in block 0, before the table
    out = [bytearray(size // 8) for size in sizes.values()]
    for k, block, got in bits.groupBy("k", F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).collect():
        start = (block - 1) * 4096
        have = out[k][start : start + 4096]
        out[k][start : start + 4096] = bytes(x | y for x, y in zip(have, got, strict=False))
    return [bytes(x) for x in out]


def marks(ids: DataFrame, size: int = MARKS) -> bytes:
    """The table of the column id."""
    return tables(ids, id=size)[0]


def marked(value: Column, table: bytes) -> Column:
    # bitmap_bucket_number and bitmap_bit_position: bit n of block b is number (b - 1) * 32768 + n, and n = number - 1 there.
    bit = F.pmod(F.xxhash64(value), F.lit(len(table) * 8))
    return F.call_function("getbit", constant(np.frombuffer(table, "<i8"))[F.shiftright(bit, 6)], bit.bitwiseAND(F.lit(63)).cast("int")) == 1
