"""Genotype calls from tables and from structure-format text.

Calls are rows (pop, locus, allele) with strings; a missing call has a null allele.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import Params
from ..scratch import written


class DataFileError(ValueError):
    """The data file differs from what the parameters say."""


def from_wide(df: DataFrame, pop: str, loci: list[str], missing: str | None = None) -> DataFrame:
    """Calls of a table with a population column and one column per locus, whatever their names. Unpivoting is narrow: no shuffle."""
    value = lambda c: F.col("`" + c.replace("`", "``") + "`").cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("locus"), value(c).alias("allele")) for c in loci])
    calls = df.select(value(pop).alias("pop"), F.inline(cells))
    return calls if missing is None else calls.withColumn("allele", F.nullif(F.col("allele"), F.lit(missing)))


def from_long(df: DataFrame, pop: str = "pop", locus: str = "locus", allele: str = "allele", missing: str | None = None) -> DataFrame:
    """Calls of a table that has them as rows."""
    value = F.col(allele).cast("string")
    return df.select(F.col(pop).cast("string").alias("pop"), F.col(locus).cast("string").alias("locus"), (value if missing is None else F.nullif(value, F.lit(missing))).alias("allele"))


def _tokens(line="value"):
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"[\t\x0B\f\r]", " ")), " +"), lambda t: t != "")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, block, value): the lines of text files with their numbers from 0, and which block of a file they are in.

    Files follow each other by name, the blocks of a file by offset, and lines within a block are read in order. They are written
    with their place in that reading; what lines of earlier blocks there are is added from a small table of blocks. So the numbers
    don't depend on how files are cut, and stay as they are in all later readings.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    read = written(raw)
    sums = read.groupBy("f", "b").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    # one row per block of a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = written(sums.select("f", "b", (before - F.col("first")).alias("shift"), F.row_number().over(Window.orderBy("f", "b")).alias("block")))
    return read.join(blocks, ["f", "b"]).select((F.col("m") + F.col("shift")).alias("id"), "block", "value")


def _nth(lines: DataFrame, n: int) -> int | None:
    """The id of the n-th line: counts per block, then one block's lines."""
    counts = sorted((r[0], r[1]) for r in lines.groupBy("block").count().collect())
    for block, c in counts:
        if n <= c:
            return lines.where(F.col("block") == block).orderBy("id").limit(n).agg(F.max("id")).head()[0]
        n -= c
    return None


def from_tokens(rows: DataFrame, pop: int, first: int, loci: list[str], missing: str) -> DataFrame:
    """Calls of rows with an array ``t``: the population at place ``pop``, and from ``first`` on an allele for each of the loci. The
    names of the loci are a small table that is joined by place, so the plan doesn't grow with them."""
    spark = rows.sparkSession
    names = written(spark.createDataFrame(list(enumerate(loci)), "i int, locus string").coalesce(1))  # written, so that Spark knows its size
    cells = rows.select(F.get("t", pop).alias("pop"), F.posexplode(F.slice("t", first + 1, len(loci))).alias("i", "allele"))
    return cells.join(names, "i").select("pop", "locus", F.nullif(F.col("allele"), F.lit(missing)).alias("allele"))


def read_structure_text(spark: SparkSession, path: str, params: Params) -> tuple[DataFrame, list[str], list[str]]:
    """Calls, locus names in file order, and populations in the order of their first rows.

    The first line holds the locus names, ``NON_DATA_ROWS`` lines in all are not data, blank lines are skipped, and the
    shape is checked against the parameters unless ``SKIP_CHK``; short files are errors always. Header and data lines are cut
    at the same white space. An error names the first line that is at fault.
    """
    lines = text_lines(spark, path)
    head = lines.where(F.col("id") < params.NON_DATA_ROWS).select("id", _tokens().alias("t")).orderBy("id").collect()
    if not head:
        raise DataFileError("the file is empty")
    loci = head[0]["t"]
    if len(loci) != params.LOCI and not (params.SKIP_CHK and len(loci) > params.LOCI):
        raise DataFileError(f"the header has {len(loci)} loci, not {params.LOCI}")
    loci = loci[: params.LOCI]
    rows = lines.where(F.col("id") > head[-1]["id"]).select("id", "block", _tokens().alias("t")).where(F.size("t") > 0)
    width = params.NON_DATA_COLS + params.LOCI
    first = lambda bad: F.min(F.when(bad, F.struct("id", F.size("t").alias("n"))))
    shape = rows.agg(F.count("*").alias("n"), first(F.size("t") < width).alias("short"), first(F.size("t") != width).alias("odd")).head()

    def faulty(line) -> DataFileError:
        return DataFileError(f"line {line['id'] + 1} has {line['n']} columns, not {width}")

    if shape["n"] < params.DATA_LINES:
        raise DataFileError(f"the file has {shape['n']} data lines, not {params.DATA_LINES}")
    if not params.SKIP_CHK:
        if shape["odd"] is not None:
            raise faulty(shape["odd"])
        if shape["n"] != params.DATA_LINES:
            raise DataFileError(f"the file has {shape['n']} data lines, not {params.DATA_LINES}")
    short = shape["short"]
    if shape["n"] > params.DATA_LINES:
        last = _nth(rows, params.DATA_LINES)
        rows, short = rows.where(F.col("id") <= last), short if short is not None and short["id"] <= last else None
    if short is not None:
        raise faulty(short)
    # one row per population: as many as the result has
    order = [r["pop"] for r in rows.groupBy(F.get("t", params.GROUP_BY_COL - 1).alias("pop")).agg(F.min("id").alias("first")).orderBy("first").collect()]
    return from_tokens(rows, params.GROUP_BY_COL - 1, params.NON_DATA_COLS, loci, params.MISSING), loci, order
