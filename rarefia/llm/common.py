"""What several operators share: written tables, sampled splitters and running totals.

Everything here is DataFrame or SQL work. What reaches the driver is bounded by a parameter (the
number of sampled keys, the number of ranges), never by the rows.
"""

from __future__ import annotations

import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch, discard, discard_path, folders, scratch_dir, written

__all__ = [
    "OWN", "ROW", "SPACE", "WORD", "Scratch", "columns_or_null", "discard", "discard_path", "draw", "folders", "range_of", "read_of_files", "running_total", "scratch_dir", "ship", "splitters", "table", "with_row_id", "written",
]

#: White space between words: space and U+0009 to U+000D, nothing else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Names for columns that are added beside those of a table that may have any.
ROW, OWN = "_rarefia_row", "_rarefia_"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed; once for each session's context."""
    context = spark.sparkContext
    if not getattr(context, "_rarefia_sent", False):
        folder = Path(tempfile.mkdtemp(prefix="rarefia-code-"))
        top = Path(__file__).resolve().parents[2]
        with zipfile.ZipFile(folder / "rarefia_code.zip", "w") as z:
            for f in sorted((top / "rarefia").rglob("*.py")):
                z.write(f, f.relative_to(top))
        context.addPyFile(str(folder / "rarefia_code.zip"))
        context._rarefia_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The place of a row in its file takes so many bits of a row's id, the file's number those above.
PLACE = 40


def read_of_files(df: DataFrame) -> bool:
    """Whether the table is Parquet files as they are, so that Spark can tell each row's file and place in it."""
    return "_metadata" not in df.columns and df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and bool(df.inputFiles())


def _place_in_files(df: DataFrame) -> Column:
    """The number of a row's file, among the files' hashes in ascending order, and its place in the file. Neither depends on how
    files are split into tasks, so every reading gives a row the same id. A file that came later is an error."""
    spark, paths = df.sparkSession, df.inputFiles()
    hashed = lambda path: F.xxhash64(F.regexp_replace(path, "^file:/+", "file:/"))  # noqa: E731  the two name local files differently
    hashes = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(hashed("p").alias("h")).distinct().orderBy("h").collect()]
    if len(hashes) < len(set(paths)):
        raise ValueError("two files have paths with one hash")
    known, own = F.split(F.lit(",".join(map(str, hashes))), ",").cast("array<long>"), hashed("_metadata.file_path")

    def half(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        low = (F.get(known, mid) < own) & (a["lo"] < a["hi"])
        return F.struct(F.when(low, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(low | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(hashes).bit_length()))
    number = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(hashes) - 1).alias("hi")), half, lambda a: a["lo"]) if len(hashes) > 1 else F.lit(0)
    found = F.when(F.get(known, number) == own, number.cast("long")).otherwise(F.raise_error(F.lit("a file isn't among those that were listed")).cast("long"))
    return F.shiftleft(found, PLACE) + F.col("_metadata.row_index")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add an id to each row, as doc_id may be null or repeat; every reading of the result has the same ids. Parquet files as
    they are give a row its file and place; any other table is written with its ids."""
    return df.withColumn(name, _place_in_files(df)) if read_of_files(df) else written(df.withColumn(name, F.monotonically_increasing_id()))


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """Cast the named columns; what a table lacks is null."""
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def draw(*keys: Column | str, seed: int) -> Column:
    """A number in (0, 1] that the keys and the seed decide."""
    h = F.xxhash64(F.lit(seed).cast("long"), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.shiftrightunsigned(h, 11) + F.lit(1)).cast("double") / F.lit(float(2**53))


def splitters(df: DataFrame, keys: list[str], weight: str, parts: int, per_part: int = 32, seed: int = 11, unique: bool = False) -> list:
    """At most ``parts - 1`` ascending keys (rows of ``keys``) that cut the weight into near-equal ranges.

    The weights of a key are summed first, unless keys are ``unique``. A key joins the sample with a probability in proportion
    to its weight, and surely where it weighs as much as a sample's share. So at most ``parts * per_part`` keys are sure
    and as many more are expected, whatever the table's size and however often a key repeats; only they reach the driver. The
    draw depends on the keys alone, so reruns give the same ranges.
    """
    if parts < 2:
        return []
    weighed = df.select(*keys, F.col(weight).alias("_w")) if unique else df.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    total = df.agg(F.sum(weight)).head()[0] or 0
    share = max(float(total) / (parts * per_part), 1e-9)
    sample = weighed.where(draw(*keys, seed=seed) * share <= F.col("_w")).select(*keys, F.greatest(F.col("_w") / share, F.lit(1.0)).alias("_w"))
    rows = sorted((tuple((v is not None, v) for v in r[:-1]), r[-1]) for r in sample.collect())
    cut, seen, all_w = [], 0.0, sum(w for _, w in rows)
    for key, w in rows:
        if seen >= all_w * (len(cut) + 1) / parts and (not cut or cut[-1] != key):
            cut.append(key)
        seen += w
    return [tuple(v for _, v in key) for key in cut]


def range_of(df: DataFrame, keys: list[str], cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or below the row's key: a binary search over a constant
    array, so a row costs the logarithm of the ranges."""
    if not cuts:
        return F.lit(0)
    kind = [df.schema[k].dataType for k in keys]
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, c, kind)]) for c in cuts])
    key = F.struct(*[F.col(k) for k in keys])
    steps = F.array(*[F.lit(i) for i in range(int(math.log2(len(cuts))) + 1)])

    def half(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        low = F.coalesce(F.get(bounds, mid) <= key, F.lit(False)) & (a["lo"] < a["hi"])
        return F.struct(F.when(low, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(low | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), half, lambda a: a["lo"])


def running_total(df: DataFrame, keys: list[str], weight: str, name: str, parts: int = 64) -> DataFrame:
    """Add the sum of ``weight`` over all rows with a smaller key (nulls first); keys must tell rows apart.

    Sampled splitters cut the rows into ranges, each range is summed by a window of its own, and the totals of
    the earlier ranges (``parts`` numbers) are added. No task sees more than a range.
    """
    ranged = df.withColumn("_range", range_of(df, keys, splitters(df, keys, weight, parts, unique=True)))
    sums = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum(weight)).collect()}
    start, before = 0, []
    for i in range(max(sums, default=-1) + 1):
        before.append(start)
        start += sums.get(i) or 0
    offsets = F.array(*[F.lit(b).cast("long") for b in before or [0]])
    w = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0)) + F.get(offsets, F.col("_range"))).drop("_range")
