"""Helpers of the operators: Arrow passes over rows, written intermediates and bounded reads by the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ranklab.session import scratch_path

#: Bytes of files for one partition of a shuffle of whole rows, and the most partitions of one.
PARTITION_BYTES = 64 << 20
MAX_PARTITIONS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the folder that all executors share, and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], dict],
              keep: list[str] | None = None) -> DataFrame:
    """One Arrow pass without a shuffle: `work` maps a batch of `columns` to its new columns; those in `keep` are
    carried along. `schema` lists the kept and the new columns."""
    keep = keep if keep is not None else columns[:1]
    from pyspark.sql.pandas.types import to_arrow_schema

    asked = StructType.fromDDL(schema)
    arrow = to_arrow_schema(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = work(batch)
            cols = [batch.column(f.name).cast(f.type) if f.name in keep else pa.array(new[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(*columns).mapInArrow(run, asked)


def keep_rows(df: DataFrame, text_col: str, work: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """The rows of `df`, all columns, for which `work` over a batch of the text column says True."""
    flag = "_keep"
    while flag in df.columns:
        flag += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(work(batch), type=pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, mask], names=[*batch.schema.names, flag])

    schema = StructType([*df.schema.fields, StructField(flag, BooleanType())])
    return df.mapInArrow(run, schema).filter(F.col(flag)).drop(flag)


def partitions_for(df: DataFrame) -> int:
    """Number of partitions for a shuffle of whole rows of `df`: that of the session, or more if its files, by the
    optimizer's estimate, would give one more than PARTITION_BYTES. What has no estimate counts as small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usual if size >= 1 << 60 else max(usual, min(size // PARTITION_BYTES + 1, MAX_PARTITIONS))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of `df` on the driver, or an error if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


#: For oracles: DuckDB has no CRC-32, so `crc_table` (a list `t` of 256 numbers) is made by rule. Needs WITH RECURSIVE.
CRC_TABLE_SQL = """poly(b, k, v) AS (SELECT b, 0, b::BIGINT FROM range(256) AS r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM poly WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM poly WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text that is not null, beside `crc_table`."""
    return (f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT), "
            "lambda h, b: xor(h // 256, t[xor(h, b) % 256 + 1]), 4294967295))")
