"""Readers, parsers and sinks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A small table that the driver holds, without a Python worker behind it."""
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    return spark.createDataFrame(pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)], names=schema.names), schema)


def text_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """A row for each line, as `line`."""
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path).withColumnRenamed("value", "line")


def whole_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """A row for each file: path and content."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def csv_pairs(spark: SparkSession, path: str, key_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Key and value of a CSV file with a header; several columns are joined by a comma. The schema is the header's, all text: no inference pass."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    join = lambda cols: F.col(f"`{cols[0]}`") if len(cols) == 1 else F.concat_ws(",", *[F.col(f"`{c}`") for c in cols])
    return raw.select(join(key_cols).alias("key"), join(value_cols).alias("value"))


def tab_pairs(line: Column) -> tuple[Column, Column]:
    """Key and numeric value of a line of exactly two tab-separated fields; any other line is an error."""
    parts = F.split(line, "\t")
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), line)).cast("array<string>"))
    return checked[0], checked[1].cast("double")


def id_and_rest(line: Column) -> tuple[Column, Column]:
    """The first tab-separated field and all that follows it."""
    parts = F.split(line, "\t", 2)
    return parts[0], F.get(parts, 1)


def fixed_prefix(line: Column, n: int = 10) -> tuple[Column, Column]:
    """The first n characters and the rest."""
    return F.substring(line, 1, n), F.substr(line, F.lit(n + 1))


def adjacency(line: Column) -> tuple[Column, Column]:
    """A page and the array of its neighbours from a white-space separated line."""
    parts = F.split(line, r"\s+")
    return parts[0], F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def whole_batches(df: DataFrame, batch: str) -> DataFrame:
    """A row for each batch: its number, how many records it holds, and `payload`, each record's JSON text with its length in bytes before it.

    Batches are bounded (routing.batched), so a batch fits in a row.
    """
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != batch]), {"ignoreNullFields": "false"})
    one = F.concat(F.octet_length(record).cast("string"), F.lit(":"), record)
    return df.select(batch, one.alias("one")).groupBy(batch).agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_list("one")), "").alias("payload"))


def from_whole_batches(df: DataFrame, batch: str, schema: str) -> DataFrame:
    """The records of batches; a payload with another number of records than it says is an error."""
    import pyarrow as pa

    def each(batches):
        for b in batches:
            numbers, out = [], []
            for number, records, payload in zip(*(c.to_pylist() for c in b.columns)):
                raw, at, n = payload.encode(), 0, 0
                while at < len(raw):
                    colon = raw.index(b":", at)
                    stop = colon + 1 + int(raw[at:colon])
                    out.append(raw[colon + 1 : stop].decode())
                    at, n = stop, n + 1
                if n != records:
                    raise ValueError(f"batch {number} holds {n} records, not {records}")
                numbers += [number] * n
            yield pa.RecordBatch.from_arrays([pa.array(numbers, b.schema.field(0).type), pa.array(out, pa.string())], names=["batch", "record"])

    kind = df.schema[batch].dataType.simpleString()
    parsed = df.select(batch, "records", "payload").mapInArrow(each, f"batch {kind}, record string").select("batch", F.from_json("record", schema).alias("r"))
    return parsed.select(F.col("batch").alias(batch), "r.*")


def to_json_batch(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, the portable form of a tagged record."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))


def from_json_batch(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("record", schema).alias("r")).select("r.*")


#: A tagged record: one member each of key and value is set.
TAGGED = "is_fake boolean, key struct<str: string, int: int, long: bigint>, value struct<str: string, int: int, long: bigint>"


def tagged(key: Column, value: Column, key_type: str, value_type: str, is_fake: Column) -> list[Column]:
    """Columns of a tagged record whose key and value are of the given types (str, int or long)."""

    def union(c: Column, kind: str) -> Column:
        if kind not in ("str", "int", "long"):
            raise ValueError(f"a record holds str, int or long, not {kind}")
        types = {"str": "string", "int": "int", "long": "bigint"}
        return F.struct(*[(c if k == kind else F.lit(None)).cast(t).alias(k) for k, t in types.items()])

    return [is_fake.alias("is_fake"), union(key, key_type).alias("key"), union(value, value_type).alias("value")]


def write_text(df: DataFrame, path: str, column: str | None = None) -> None:
    df.select(F.col(column or df.columns[0]).cast("string")).write.text(path)


def parquet_to_csv(spark: SparkSession, pattern: str, path: str) -> None:
    """All Parquet parts that match a pattern as one CSV file with a header (for small results: one task writes)."""
    spark.read.parquet(pattern).coalesce(1).write.csv(path, header=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset, as in tests on one machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="stowage-core-")
        atexit.register(shutil.rmtree, shared_folder.own, True)
    return f"file://{shared_folder.own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage and survives lost executors; goes with the session."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
