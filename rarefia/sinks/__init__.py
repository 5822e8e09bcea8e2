"""Text results: rows of statistics, wide rows per locus, and the report of deleted loci.

Rows are rendered and ordered by executors; everything else is written with ``DataFrame.write``.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard_path, scratch_dir


def number(x: float | int | None) -> str:
    """Six significant digits, as C's %g; nan for none."""
    return "nan" if x is None or math.isnan(x) else "%g" % x


#: Sorts after all sample sizes.
AFTER = 2**31 - 1


def _rendered(rows: DataFrame) -> DataFrame:
    """(places, g, text) of rows (places, g, head, numbers). Numbers are rendered in Python, whose %g rounds as C's does."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = [" ".join([h, *["nan" if x is None or x != x else "%g" % x for x in numbers]]) for h, numbers in zip(b.column("head").to_pylist(), b.column("numbers").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("places"), b.column("g"), pa.array(text, pa.string())], names=["places", "g", "text"])

    return rows.select("places", "g", "head", "numbers").mapInArrow(run, "places array<int>, g int, text string")


def stat_lines(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """(places, g, text): ``name g loci mean var se`` for each sample size of each group, and an empty line after each of the ``groups``,
    whether it has rows or not. ``stats`` has places, combo, g, num_loci, mean, var and std_err, ``groups`` combo as places."""
    rows = stats.select("places", "g", F.concat_ws(" ", "combo", F.col("g").cast("string"), F.col("num_loci").cast("string")).alias("head"), F.array("mean", "var", "std_err").alias("numbers"))
    return _rendered(rows).union(groups.select(F.col("combo").alias("places"), F.lit(AFTER).alias("g"), F.lit("").alias("text")))


def full_lines(values: DataFrame, stats: DataFrame, loci: DataFrame) -> DataFrame:
    """(places, g, text): a wide row per group and sample size with names, g, loci, each locus' value in the order of ``loci`` (locus, at), mean,
    var, se. A row's values are gathered by place, as no plan has a column for each locus."""
    each = values.join(loci, "locus").groupBy("places", "g").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    both = each.join(stats, ["places", "g"])
    numbers = F.concat(F.transform("v", lambda x: x["value"]), F.array("mean", "var", "std_err"))
    return _rendered(both.select("places", "g", F.concat_ws(" ", "combo", F.col("g").cast("string"), F.col("num_loci").cast("string")).alias("head"), numbers.alias("numbers")))


def full_header(loci: list[str], k: int | None = None) -> str:
    heads = ["POP_GROUPING"] if k is None else [f"POP_GROUPING{i + 1}" for i in range(k)]
    return " ".join([*heads, "G", "NUM_LOCI", *loci, "MEAN", "VAR", "STD_ERR"]) + "\n"


def write_lines(lines: DataFrame, path: str, header: str = "") -> None:
    """Write the lines in the order of (places, g) as one file of the driver's. Executors order and write parts in the shared folder; the parts'
    bytes are then put one after the other, so no row reaches Python's memory here."""
    spark, folder = lines.sparkSession, scratch_dir(lines.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(tasks, "places", "g").sortWithinPartitions("places", "g").select("text").write.text(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(folder)
    system = source.getFileSystem(conf)
    parts = sorted((s.getPath() for s in system.listStatus(source)), key=lambda p: p.getName())
    with open(path, "w") as f:
        f.write(header)
    out = jvm.java.io.FileOutputStream(os.path.abspath(path), True)
    try:
        for part in parts:
            if part.getName().startswith("part-"):
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(system.open(part), out, conf, False)
    finally:
        out.close()
    discard_path(spark, folder)


def deleted_report(loci: list[str], order: list[str], tolerance: float) -> str:
    """How many loci were deleted and which, last in the file first."""
    place = {x: i for i, x in enumerate(order)}
    names = sorted(loci, key=place.__getitem__, reverse=True)
    more = f" more than {number(100 * tolerance)}%" if tolerance > 0 else ""
    # fixed values: the sentence
    return f"{len(names)} {'locus has' if len(names) == 1 else 'loci have'} at least one grouping with{more} missing data.\n" + "".join(f"{n}\n" for n in names)


def suffixed(path: str, *parts: str | int) -> str:
    return "_".join([path, *map(str, parts)])
