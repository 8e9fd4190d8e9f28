"""Reading and writing tables, row addresses and cell lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..types import SUBMISSIONS


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None,
               multiline: bool = True, **options) -> DataFrame:
    """Read csv, parquet, json, orc or any other source Spark knows.

    CSV keeps every column as text unless a schema is given, doubles quotes inside quotes and reads empty fields as
    NULL.  ``multiline`` keeps line ends inside cells, which would else break a row in two without notice; such files are read
    whole, one per task, so switch it off for large files that are known to hold one row per line.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=multiline, escape='"', inferSchema=False)
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Iterable[str] = (),
                **options) -> None:
    """Write a table; CSV quotes only where it must, doubles quotes and writes NULL as an empty field."""
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # Outer blanks are kept: a cell of blanks is a finding, and must still be one after the table is read back.
        writer.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        writer.format(fmt).save(path)


def from_tuples(spark: SparkSession, header: Iterable[str], rows: Iterable[tuple], start: int = 1) -> DataFrame:
    """A small text table from literals, with ``row_id`` counted from ``start`` and numbers turned into text."""
    names = list(header)
    data = [(i, *[None if v is None else str(v) for v in r]) for i, r in enumerate(rows, start)]
    return spark.createDataFrame(data, "row_id bigint, " + ", ".join(f"`{n}` string" for n in names))


def with_row_id(df: DataFrame, key: str | None = None, out: str = "row_id") -> DataFrame:
    """Add a row address.

    With ``key`` that column is the address.  Otherwise rows are numbered 1, 2, 3, ... in partition order: a count per
    partition, then an offset per partition; no sort and no shuffle of the rows.  Positions are only stable while the
    input files are, so tables that have a key should use it.
    """
    if key is not None:
        return df.withColumn(out, F.col(key).cast("bigint"))
    part, place = F.col("__part"), F.col("__place")
    marked = df.withColumn("__mono", F.monotonically_increasing_id())
    marked = marked.withColumn("__part", F.shiftright("__mono", 33)).withColumn(
        "__place", F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = marked.groupBy("__part").agg((F.max("__place") + 1).alias("n")).collect()  # one row per partition
    offset, offsets = 0, []
    for row in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((row["__part"], offset))
        offset += row["n"]
    if not offsets:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    table = df.sparkSession.createDataFrame(offsets, "__part bigint, __offset bigint")
    numbered = marked.join(F.broadcast(table), "__part").withColumn(out, F.col("__offset") + place + 1)
    return numbered.select(*df.columns, out)


def cell_value(df: DataFrame, cells: DataFrame, row_id: str = "row_id", cols: Iterable[str] | None = None) -> DataFrame:
    """Look up cells ``(row_id, col)``: adds ``value``, stripped text, or NULL where row or column do not exist.

    Column names compare without case and outer blanks.  The wide table is joined once on its row id; it is not
    unpivoted.  ``cols`` limits which of its columns are read.
    """
    names = [c for c in (cols or df.columns) if c != row_id]
    wanted = cells.select(*[c for c in cells.columns if c != "value"])
    address = F.col(row_id).cast("bigint").alias("__row")
    wide = df.select(address, *[strip(F.col(c).cast("string")).alias(f"__c{i}") for i, c in enumerate(names)])
    name = F.lower(strip(F.col("col")))
    value = F.lit(None).cast("string")
    for i, c in enumerate(names):
        value = F.when(name == c.strip().lower(), F.col(f"__c{i}")).otherwise(value)
    return wanted.join(wide, F.col("row_id") == F.col("__row"), "left").select(*wanted.columns, value.alias("value"))


def attach_clean_values(truth: DataFrame, clean: DataFrame, row_id: str = "row_id", cols: Iterable[str] | None = None) -> DataFrame:
    """Fill ``clean_value`` of a truth table from the clean table."""
    found = cell_value(clean, truth.drop("clean_value"), row_id, cols)
    return found.withColumnRenamed("value", "clean_value")


def read_submissions(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Submissions from JSON records, as a table or as a stream; ``fixes`` may be absent."""
    reader = (spark.readStream if stream else spark.read).schema(SUBMISSIONS).options(**options)
    return reader.json(path).withColumn("fixes", F.coalesce("fixes", F.array().cast("array<string>")))
