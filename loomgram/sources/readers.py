"""Readers and writers of the files that pan-genome work comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgram.functions.columns import valid_name


def fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """path, chr, seq of each record, plain or gzipped: the name is the header's first word, lines are joined."""
    rows = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"^>?\s*(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.where(F.trim("value") != "").select("path", head.alias("chr"), body.alias("seq"))


def fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """path, chr, seq of each read: records of four lines, split at lines that begin with @.

    Where a quality line begins with @, the record ends after its third line, and the rest of that line is a piece of one
    line, which is no record.
    """
    rows = spark.read.option("wholetext", False).option("lineSep", "\n@").text(list(paths)).select(F.input_file_name().alias("path"), "value")
    part = F.split("value", "\n")
    ok = (F.size(part) >= 3) & F.get(part, F.lit(2)).startswith("+")
    return rows.where(ok).select("path", F.regexp_extract(F.get(part, F.lit(0)), r"^@?(\S+)", 1).alias("chr"), F.get(part, F.lit(1)).alias("seq"))


def gff(spark: SparkSession, *paths: str) -> DataFrame:
    schema = "chr string, source string, type string, start long, end long, score string, strand string, phase string, attr string"
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(list(paths))
    return rows.select("chr", "start", "end", "type", "attr")


def bed(spark: SparkSession, *paths: str) -> DataFrame:
    """chr, start, end, name; an empty file is an empty table."""
    return spark.read.schema("chr string, start long, end long, name string").option("sep", "\t").csv(list(paths))


def groups(spark: SparkSession, path: str) -> DataFrame:
    """name, grp; a group with _ is an error."""
    rows = spark.read.schema("name string, grp string").option("sep", "\t").option("header", True).csv(path)
    if not rows.where(F.col("grp").contains("_")).limit(1).isEmpty():
        raise ValueError("group names must not contain _")
    return rows


def samples(spark: SparkSession, path: str, anchors: list[str] | None = None) -> DataFrame:
    """name, fasta, gff, id (order in the file), anchor (listed, or all with a fasta); invalid names are an error."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    missing = {"name", "fasta"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    if "gff" not in rows.columns:
        rows = rows.withColumn("gff", F.lit(None).cast("string"))
    if not rows.where(~valid_name(F.col("name"))).limit(1).isEmpty():
        raise ValueError("names must match [A-Za-z0-9_-]+")
    order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1
    anchor = F.col("name").isin(anchors) if anchors is not None else F.col("fasta").isNotNull()
    return rows.select("name", "fasta", "gff", order.alias("id"), anchor.alias("anchor"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """accession, bin, value of a matrix with a column for each bin start; missing is 0."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    name, *bins = rows.columns
    long = rows.unpivot([name], bins, "bin", "value")
    return long.select(F.col(name).alias("accession"), F.col("bin").cast("long").alias("bin"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def paf(spark: SparkSession, *paths: str) -> DataFrame:
    """The twelve columns and the CIGAR of the cg tag."""
    part = F.split("value", "\t")
    names = ["query", "q_size", "q_start", "q_end", "strand", "target", "t_size", "t_start", "t_end", "matches", "length", "quality"]
    text = {"query", "strand", "target"}
    cols = [F.get(part, F.lit(i)).cast("string" if c in text else "long").alias(c) for i, c in enumerate(names)]
    tag = F.get(F.filter(part, lambda x: x.startswith("cg:Z:")), F.lit(0))
    return spark.read.text(list(paths)).select(*cols, F.substring(tag, 6, 1 << 30).alias("cigar"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a string, b string, dist double, p double, shared string").option("sep", "\t").csv(path)


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Conservation of features: name, chr, start, end, average, deviation, attr, and length."""
    rows = spark.read.schema("name string, chr string, start long, end long, average double, deviation double, attr string").option("sep", "\t").csv(path)
    return rows.withColumn("length", F.col("end") - F.col("start"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, chr string, start long, end long").option("sep", "\t").csv(path)


def write_bitmap(bits: DataFrame, path: str) -> None:
    """Parquet by genome, sorted by chromosome and position, so that a range query reads few row groups."""
    bits.repartitionByRange("gid", "chr", "pos").sortWithinPartitions("gid", "chr", "pos").write.mode("overwrite").partitionBy("gid").parquet(path)


def write_bitmaps(bits: DataFrame, path: str, steps: tuple[int, ...] = (1, 100)) -> None:
    """A bitmap of the positions divisible by each step, side by side."""
    for step in steps:
        write_bitmap(bits.where(F.col("pos") % step == 0), f"{path}/step={step}")


def read_bitmap(spark: SparkSession, path: str, step: int = 1, steps: tuple[int, ...] = (1, 100)) -> DataFrame:
    """The positions divisible by step, from the coarsest of write_bitmaps()'s tables that has them."""
    stored = max(s for s in steps if step % s == 0)
    rows = spark.read.parquet(f"{path}/step={stored}")
    return rows if stored == step else rows.where(F.col("pos") % step == 0)


def write_summaries(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as tab-separated text with a header, in a folder of its name."""
    for name, rows in tables.items():
        write_table(rows, f"{path}/{name}")


def summary(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of write_summaries()."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(f"{path}/{name}")


def write_genome_part(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the genomes in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gid").parquet(path)


def write_calls(intervals: DataFrame, path: str) -> None:
    intervals.write.mode("overwrite").option("sep", "\t").partitionBy("threshold", "accession", "intro_type").csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
