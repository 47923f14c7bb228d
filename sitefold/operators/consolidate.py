"""One record for each registered domain from its page records: value frequencies, text in order, first identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import SuffixRules, clean_domain
from ..shared import cut

FIELDS = ("phone", "email", "fax", "zipcode", "address", "kvk", "btw")


def with_clean_domain(pages: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """Page records under their registered domain; those without a domain are left out."""
    return pages.where("domain is not null and domain <> ''").withColumn("domain", clean_domain("domain", rules))


def field_counts(pages: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """domain, field, value, count: how often each value of a list field comes, also twice in one page. One scan and one
    shuffle for all fields; partial counts are made before it."""
    there = [f for f in fields if f in pages.columns]
    named = lambda f: F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    pairs = F.flatten(F.array(*map(named, there))) if there else F.array().cast("array<struct<field:string,value:string>>")
    return pages.select("domain", F.explode(pairs).alias("p")).groupBy("domain", F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("count"))


def _joined(items: Column, sep: str = " ") -> Column:
    """Texts of (ord, text) structs in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def texts(pages: DataFrame, chunk_size: int | None = None) -> DataFrame:
    """domain, identifier, text: texts in order, a space before each, null ones as empty; the identifier of the first row.
    With chunk_size the texts are those of a run in chunks of so many rows, which puts two spaces between chunks."""
    row = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))
    first = F.min_by("identifier", "ord")
    if chunk_size is None:
        return pages.groupBy("domain").agg(first.alias("identifier"), F.concat(F.lit(" "), _joined(F.collect_list(row))).alias("text"))
    # the number of a row among all rows; ranks of ranges are added up, so no single task sorts all rows
    numbered = _numbered(pages)
    parts = numbered.groupBy("domain", F.floor((F.col("_no") - 1) / chunk_size).alias("chunk")).agg(F.min(F.struct("ord", "identifier")).alias("first"), F.concat(F.lit(" "), _joined(F.collect_list(row))).alias("text"))
    again = F.struct(F.col("chunk").alias("ord"), "text")
    return parts.groupBy("domain").agg(F.min_by("first.identifier", "first.ord").alias("identifier"), _joined(F.collect_list(again)).alias("text"))


def _numbered(pages: DataFrame) -> DataFrame:
    """pages with _no, from 1 in the order of ord: ranges of ord are ranked in parallel and shifted by the sizes before them.
    The ranges are written once with their numbers. Read from two plans, each would be cut into other ranges, as adaptive
    execution joins small partitions by the columns that a plan reads."""
    ranged = cut(pages.repartitionByRange("ord").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    inner = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("ord")))
    return inner.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("_no", F.col("_before") + F.col("_rank")).drop("_part", "_p", "_before", "_rank")


def _frequencies(field: str) -> Column:
    """The map of a field's values and counts, in order of the values, from the column _all of all fields' counts."""
    none = F.array().cast("array<struct<field:string,value:string,n:bigint>>")
    mine = F.array_sort(F.filter(F.coalesce("_all", none), lambda x: x["field"] == field))
    return F.map_from_entries(F.transform(mine, lambda x: F.struct(x["value"].alias("key"), x["n"].alias("value")))).alias(field)


def consolidated(pages: DataFrame, fields: tuple[str, ...] = FIELDS, chunk_size: int | None = None, rules: SuffixRules | None = None) -> DataFrame:
    """domain, identifier, one map of value frequencies a field, text."""
    rows = with_clean_domain(pages, rules)
    counts = field_counts(rows, fields).groupBy("domain").agg(F.collect_list(F.struct("field", "value", F.col("count").alias("n"))).alias("_all"))
    base = texts(rows, chunk_size)
    return base.join(counts, "domain", "left").select("domain", "identifier", *(_frequencies(f) for f in fields), "text")


def merged(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Two consolidated tables as one, a's rows before b's: counts add up, texts follow with a space between."""
    both = a.withColumn("_k", F.lit(0)).unionByName(b.withColumn("_k", F.lit(1)))
    entries = lambda f: F.transform(F.map_entries(f), lambda e: F.struct(F.lit(f).alias("field"), e["key"].alias("value"), e["value"].alias("n")))
    pairs = F.flatten(F.array(*map(entries, fields)))
    counts = both.select("domain", F.explode(pairs).alias("p")).groupBy("domain", "p.field", "p.value").agg(F.sum("p.n").alias("n")).groupBy("domain").agg(F.collect_list(F.struct("field", "value", "n")).alias("_all"))
    base = both.groupBy("domain").agg(F.min_by("identifier", "_k").alias("identifier"), _joined(F.collect_list(F.struct(F.col("_k").alias("ord"), "text"))).alias("text"))
    return base.join(counts, "domain", "left").select("domain", "identifier", *(_frequencies(f) for f in fields), "text")


def main_value(pages: DataFrame, field: str = "zipcode") -> DataFrame:
    """domain, value, count: the most frequent value of a field, the first in order among equals."""
    order = Window.partitionBy("domain").orderBy(F.desc("count"), "value")
    return field_counts(pages, (field,)).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("domain", "value", "count")
