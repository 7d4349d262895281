"""CSV/Parquet/JSON readers and writers of the canonical tables.

CSV files carry the generator's CamelCase headers (``schemas.CSV_HEADERS``);
the frames use the snake_case names of ``schemas``. Columns are bound by
header name, in any order; a header without one of them raises
``ValueError``, columns that are not known are left out. Cells that cannot be
read as their type fail the job (``mode="FAILFAST"``, the default); with
``mode="PERMISSIVE"`` they become NULL. Nothing is inferred, and a missing
file raises ``AnalysisException`` when the read is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.sources import schemas

FAIL = "FAILFAST"


def _read_csv(spark: SparkSession, path: str, name: str, schema: T.StructType,
              mode: str) -> DataFrame:
    # the header alone, as the reader names the columns
    found = spark.read.option("header", True).csv(path).columns
    known = dict(zip(schemas.CSV_HEADERS[name], schema.fields))
    missing = [h for h in known if h not in found]
    if missing:
        raise ValueError(f"{path}: the header lacks {', '.join(missing)}")
    as_read = T.StructType([
        T.StructField(h, known[h].dataType if h in known else T.StringType(), True)
        for h in found])
    raw = (spark.read.schema(as_read).option("header", True).option("enforceSchema", False)
           .option("mode", mode).csv(path))
    return raw.select(*[F.col(f"`{h}`").alias(f.name) for h, f in known.items()])


def read_customers(spark: SparkSession, path: str, mode: str = FAIL) -> DataFrame:
    """S1."""
    return _read_csv(spark, path, "customers", schemas.CUSTOMERS, mode)


def read_items(spark: SparkSession, path: str, mode: str = FAIL) -> DataFrame:
    """S2."""
    return _read_csv(spark, path, "items", schemas.ITEMS, mode)


def read_purchases(spark: SparkSession, path: str, mode: str = FAIL) -> DataFrame:
    """S3. Dates may carry a time part in the file; it is parsed and dropped."""
    raw = _read_csv(spark, path, "purchases", schemas.PURCHASES_RAW, mode)
    day = F.col("purchase_date").cast("timestamp") if mode == FAIL else F.expr(
        "try_cast(purchase_date as timestamp)")
    return raw.withColumn("purchase_date", day.cast("date"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Write a frame in parallel, one file per partition."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """The long-form report as JSON lines (one metric per line)."""
    report.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read back a written table. CSV needs ``schema`` (a DDL string or
    struct); without one its columns are strings, as no pass over the file is
    spent on guessing types."""
    if fmt == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    if fmt == "json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none when it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none when it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all. Its name is claimed first, by a
    hidden empty file that only one writer can create; the text is written under
    another hidden name and put in place by one rename. False when the name is
    taken, also by a writer that did not get to its end; nothing is changed then."""
    import uuid
    fs, p = _fs(spark, path)
    hidden = lambda kind: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        p.getParent(), f".{p.getName()}-{kind}")
    if not fs.createNewFile(hidden("claim")):
        return False
    draft = hidden(uuid.uuid4().hex)
    out = fs.create(draft)
    out.write(text.encode())
    out.close()
    return fs.rename(draft, p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(
            stream)).decode()
    finally:
        stream.close()
