"""File lists, reference lists, count tables and the tables that jobs hand to each other."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqmill.functions.numeric import scientific


def positive(value: str | int) -> int:
    if (n := int(value)) <= 0:
        raise ValueError(f"{value} is not positive")
    return n


def not_negative(value: str | int) -> int:
    if (n := int(value)) < 0:
        raise ValueError(f"{value} is negative")
    return n


def probability(value: str | float) -> float:
    if not 0 <= (p := float(value)) <= 1:
        raise ValueError(f"{value} is not between 0 and 1")
    return p


def alignment_paths(spark: SparkSession, list_file: str) -> list[str]:
    """The paths of a list file, one a line: all in one folder, each name once."""
    paths = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    folders, names = {p.rpartition("/")[0] for p in paths}, [p.rpartition("/")[2] for p in paths]
    if len(folders) > 1:
        raise ValueError(f"alignment files lie in several folders: {sorted(folders)}")
    if len(set(names)) < len(names):
        raise ValueError("an alignment file is listed twice")
    if not paths:
        raise ValueError(f"{list_file} lists no file")
    return paths


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file of that name, in whichever file system Spark reads."""
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of files and folders in a folder, none if there is no such folder."""
    fs, hadoop = _file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    fs, hadoop = _file_system(spark, path)
    fs.create(hadoop, True).close()


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def reference_names(spark: SparkSession, names: str, contigs: DataFrame) -> list[str]:
    """Comma-separated names, or a text file of them, if there is such a file; every sample's header must have each."""
    wanted = [r.value.strip() for r in spark.read.text(names).collect() if r.value.strip()] if exists(spark, names) else [n for n in names.split(",") if n]
    asked = spark.createDataFrame([(n,) for n in wanted], "chrom string")
    missing = contigs.select("sample").distinct().crossJoin(F.broadcast(asked)).join(contigs, ["sample", "chrom"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError("references without a header line: " + ", ".join(f"{r.chrom} in {r.sample}" for r in missing))
    return wanted


def read_counts(spark: SparkSession, path: str, chrom: str, sample: str) -> DataFrame:
    """A table of counts by strand (columns A a C c G g T t, one line a position) as a stranded pileup.

    The position of a line is its place among the lines that are neither comments nor the header. A large file is
    read by many tasks: the lines of each part are counted first, and parts begin where those before end.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    lines = lines.filter(~F.col("value").startswith("#") & ~F.col("value").startswith("A\t") & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())
    counts = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))  # a row a part
    cells = F.split("value", "\t")
    strands = [cells[i].cast("long").alias(f"{s}_{b}") for i, (b, s) in enumerate((b, s) for b in "acgt" for s in "fr")]
    placed = lines.join(F.broadcast(offsets), "block").withColumn("pos", (F.col("at") + F.col("shift")).cast("int"))
    return placed.select(F.lit(chrom).alias("chrom"), F.lit(sample).alias("sample"), "pos", *strands)


def counts_path(folder: str, sample: str, chrom: str, min_bq: int) -> str:
    """Where a sample's counts of one reference lie, made at one threshold: counts of another are never taken for them."""
    return f"{folder}/{sample}.{chrom}.bq{min_bq}.counts"


def kept_counts(spark: SparkSession, folder: str, samples: list[str], chroms: list[str], min_bq: int) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The stranded pileup of all tables of counts that are there, and the (chrom, sample) that they cover."""
    found = [(c, s) for c in chroms for s in samples if exists(spark, counts_path(folder, s, c, min_bq))]
    tables = [read_counts(spark, counts_path(folder, s, c, min_bq), c, s) for c, s in found]
    return (reduce(DataFrame.unionByName, tables) if tables else None), found


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, local masters take a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seqmill-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later jobs read the same rows in the same files, whichever executors are lost."""
    path = f"{shared_folder(table.sparkSession)}/seqmill-{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def write_sites(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("compression", "zstd").partitionBy("chrom", "sample").parquet(path)


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: none in a good table."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def add_sites(table: DataFrame, path: str, keys: list[str], locus: tuple[str, ...] = ("chrom", "sample", "pos")) -> None:
    """Add rows to what lies at path, by chrom and sample; an error, before anything is written, if a key is twice in the table or its locus is there already."""
    spark = table.sparkSession
    twice = duplicate_keys(table, keys).limit(3).collect()
    if twice:
        raise ValueError("keys twice in one table: " + ", ".join(str(tuple(r)[:-1]) for r in twice))
    if exists(spark, path):
        there = spark.read.parquet(path).select(*locus)
        again = table.select(*locus).join(there, list(locus), "left_semi").distinct().limit(3).collect()
        if again:
            raise ValueError("loci that are written already: " + ", ".join(str(tuple(r)) for r in again))
    table.write.mode("append").option("compression", "zstd").partitionBy("chrom", "sample").parquet(path)


def write_posterior(posterior: DataFrame, path: str, frequencies: list[float] | None = None) -> None:
    """Tab-separated lines in order of sample, chrom, pos, with best_freq and the log-posteriors in nine digits.

    With frequencies, of a first line `#freqs` with the grid's points.
    """
    values = F.array_join(F.transform("log_post", scientific), "\t")
    lines = posterior.select("sample", "chrom", "pos", F.concat_ws("\t", "sample", "chrom", "pos", scientific(F.col("best_freq")), values).alias("value"))
    if frequencies is not None:
        spark = posterior.sparkSession
        grid = spark.createDataFrame([(list(map(float, frequencies)),)], "f array<double>")
        line = F.concat_ws("\t", F.lit("#freqs"), F.array_join(F.transform("f", scientific), "\t"))
        lines = lines.unionByName(grid.select(line.alias("value")), allowMissingColumns=True)
    lines.orderBy(F.col("sample").asc_nulls_first(), "chrom", "pos").select("value").write.mode("overwrite").text(path)
