"""Page records and consolidated records as lines of JSON."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.consolidate import FIELDS

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("domain", "identifier", "website", "date", "path", "text")] + [T.StructField(f, T.ArrayType(T.StringType())) for f in FIELDS])
RECORDS_A_FILE = 1_000_000


def write_records(records: DataFrame, path: str, run_date: str, append: bool = False) -> None:
    """Extracted records below path/run_date=<run_date>, at most a million in a file; meta entries become keys of their own.
    A second run on a day replaces the first one's, with append it adds."""
    rest = [c for c in records.columns if c != "meta"]
    line = F.to_json(F.struct(*rest))
    if "meta" in records.columns:
        # the record's object and that of its meta entries, joined as text
        both = records.select(line.alias("line"), F.when(F.size("meta") > 0, F.to_json("meta")).alias("more"))
        rows = both.select(F.when(F.col("more").isNull(), F.col("line")).otherwise(F.expr("concat(substr(line, 1, length(line) - 1), ',', substr(more, 2))")).alias("value"))
    else:
        rows = records.select(line.alias("value"))
    rows.write.mode("append" if append else "overwrite").option("maxRecordsPerFile", RECORDS_A_FILE).option("lineSep", "\n").text(f"{path.rstrip('/')}/run_date={run_date}")


def read_records(spark: SparkSession, path: str | list[str], schema: T.StructType = RECORD) -> DataFrame:
    """Records with ord, their order in the files. Lines that aren't JSON objects, and null, are left out."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return lines.select("ord", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value").where(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")).select("ord", "r.*")


def latest_file(spark: SparkSession, folder: str) -> str:
    """The newest .ndjson file of a folder by its time of change."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in (fs.listStatus(root) if fs.exists(root) else []) if s.isFile() and s.getPath().getName().endswith(".ndjson")]
    if not found:
        raise FileNotFoundError(f"no .ndjson file in {folder}")
    return max(found, key=lambda s: s.getModificationTime()).getPath().toString()


def latest_run(spark: SparkSession, folder: str) -> str:
    """What to consolidate of a folder of extracted records: its newest .ndjson file, or its newest run_date=... folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in (fs.listStatus(root) if fs.exists(root) else []) if s.isDirectory() and s.getPath().getName().startswith("run_date=") or s.isFile() and s.getPath().getName().endswith(".ndjson")]
    if not found:
        raise FileNotFoundError(f"no extracted records in {folder}")
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString()


def output_path(output: str | None = None, default: str | None = None, target_folder: str | None = None, source: str | None = None) -> str:
    """Where consolidated records go: as asked for, the default, below the target folder, or beside the extracted ones."""
    if output or default:
        return output or default
    if target_folder:
        return f"{target_folder.rstrip('/')}/consolidated_data/consolidated.ndjson"
    p = PurePosixPath(source or "")
    if p.parent.name == "extracted_data":
        return str(p.parent.parent / "consolidated_data" / "consolidated.ndjson")
    raise ValueError("no place for the output")


def write_consolidated(records: DataFrame, path: str) -> None:
    """One file with one JSON object a domain, in order of the domains; null fields are written too. The parts are sorted and
    written in parallel below another name, then joined into the file as they are; without records it is empty."""
    spark = records.sparkSession
    line = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    parts = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    # a range sort keeps the order over files; their names follow it
    records.orderBy("domain").select(line.alias("value")).write.text(parts.toString())
    whole = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(whole, True)
    for p in sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
        source = fs.open(jvm.org.apache.hadoop.fs.Path(p))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()
    fs.delete(target, True)
    fs.rename(whole, target)
    fs.delete(parts, True)
