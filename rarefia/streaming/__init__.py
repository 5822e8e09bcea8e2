"""Counts and richness that grow with a stream of calls.

Counts add up, so a batch of calls needs no more than its own counts. ``GrowingCounts`` keeps them as a log of one small table per batch,
written under the batch's number: a batch that is run again writes the same table again, and nothing is counted twice.
``compact`` sums the log into one table from time to time. ``GrowingRichness`` keeps the values by locus likewise: a batch
touches some loci, their values alone are computed anew, and the latest of each counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import operators as ops
from ..plans import Diversity


def running_counts(calls: DataFrame) -> DataFrame:
    """(locus, allele, pop, n) of a streaming DataFrame of calls, for the update or complete output mode."""
    return calls.where(F.col("allele").isNotNull()).groupBy("locus", "allele", "pop").agg(F.count("*").alias("n"))


class _Log:
    """Tables by kind and number in one folder; a table counts when its writer has finished it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, number: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-{number:012d}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """The finished tables of a kind; as many as there have been batches since the last compaction."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [re.fullmatch(rf"{kind}-(\d+)", s.getPath().getName()) for s in system.listStatus(path)]
        done = lambda n: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, n)[0], "_SUCCESS"))
        return sorted(n for n in (int(m[1]) for m in found if m) if done(n))

    def write(self, kind: str, number: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(kind, number)[0].toString())

    def read(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        paths = [self._path(kind, n)[0].toString() for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def remove(self, kind: str, numbers: list[int]) -> None:
        for n in numbers:
            path, system = self._path(kind, n)
            system.delete(path, True)


class GrowingCounts:
    """The call counts of all batches so far, in a folder that all executors share.

    Batches are numbered by whoever adds them, as ``foreachBatch`` does; one that was added before is written again or, after
    a compaction that holds it, skipped. Calls without a population are left out. A batch that failed half-way doesn't count.
    """

    SCHEMA = "locus string, pop string, allele string, n long"

    def __init__(self, spark: SparkSession, folder: str):
        self._log = _Log(spark, folder)

    def _base(self) -> int:
        return max(self._log.numbers("base"), default=-1)

    def batches(self) -> list[int]:
        """The batches of the log that no compaction holds."""
        base = self._base()
        return [n for n in self._log.numbers("batch") if n > base]

    def add(self, calls: DataFrame, number: int) -> None:
        if number > self._base():
            self._log.write("batch", number, ops.call_counts(calls.where("pop is not null")).select("locus", "pop", "allele", "n"))

    def counts(self) -> DataFrame:
        """(locus, pop, allele, n), missing calls as a null allele."""
        base = self._base()
        both = self._log.read("base", [base] if base >= 0 else [], self.SCHEMA).union(self._log.read("batch", self.batches(), self.SCHEMA))
        return both.groupBy("locus", "pop", "allele").agg(F.sum("n").alias("n"))

    def touched(self, after: int) -> DataFrame:
        """(locus) of the batches above ``after`` that the log still has."""
        return self._log.read("batch", [n for n in self._log.numbers("batch") if n > after], self.SCHEMA).select("locus").distinct()

    def compact(self) -> None:
        """Sum base and log into a new base. What it replaces goes after it has been written, so a failure between leaves both
        and readers take the new one."""
        batches, bases = self.batches(), self._log.numbers("base")
        if batches:
            self._log.write("base", batches[-1], self.counts())
            self._log.remove("base", bases)
        self._log.remove("batch", [n for n in self._log.numbers("batch") if n <= self._base()])

    def follow(self, calls: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Add every batch of a streaming DataFrame of calls."""
        return calls.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class GrowingRichness:
    """Richness by locus of growing counts: ``refresh`` computes the loci anew that batches since the last refresh have touched.

    Values go up to a locus' own sample size, so that a population whose smallest sample grows at one locus finds the larger sizes
    of all others there. Call ``refresh`` before the counts are compacted; a refresh that is run again writes the same.
    """

    SCHEMA = "pop string, g int, locus string, value double, nj long"

    def __init__(self, counts: GrowingCounts, folder: str, max_g: int):
        self._counts, self._log, self._max_g = counts, _Log(counts._log.spark, folder), max_g

    def refresh(self) -> int:
        """Returns how many loci were computed."""
        after, batches = max(self._log.numbers("values"), default=-1), self._counts.batches()
        if not batches or batches[-1] <= after:
            return 0
        touched = self._counts.touched(after)
        counts = self._counts.counts().join(touched, "locus", "left_semi")
        sizes = ops.sizes_of_counts(counts).select("locus", "pop", "nj")
        alleles = counts.where("allele is not null")
        values = ops.richness_values(ops.spectrum(alleles, sizes), self._max_g)
        # a sample of under 2 calls has no value, but its size is known
        small = sizes.where("nj < 2").select("pop", F.lit(1).alias("g"), "locus", F.lit(None).cast("double").alias("value"), "nj")
        self._log.write("values", batches[-1], values.select("pop", "g", "locus", "value", "nj").union(small))
        return touched.count()

    def _loci(self) -> int:
        return self._log.read("values", self._log.numbers("values"), self.SCHEMA).select("locus").distinct().count()

    def by_locus(self) -> DataFrame:
        """(pop, g, locus, value) of the latest values, up to each population's smallest sample over all loci."""
        numbers = self._log.numbers("values")
        version = F.regexp_extract("_metadata.file_path", r"/values-(\d+)/", 1) if numbers else F.lit("0")
        every = self._log.read("values", numbers, self.SCHEMA).withColumn("version", version.cast("long"))
        sizes = every.groupBy("pop", "locus").agg(F.max_by("nj", "version").alias("nj"))
        least = ops.least_sizes(sizes, self._loci())
        latest = every.where("g >= 2").groupBy("pop", "g", "locus").agg(F.max_by("value", "version").alias("value"))
        return latest.join(least, "pop").where("g <= least").drop("least")

    def richness(self) -> DataFrame:
        """pop, g, num_loci, mean, var, std_err."""
        return ops.summary(self.by_locus(), ["pop"], self._loci())


def diversity_of(counts: GrowingCounts, max_g: int, tolerance: float = 1.0, order: list[str] | None = None) -> Diversity:
    """Any analysis of the counts so far, without reading a call again."""
    return Diversity.of_counts(counts.counts(), max_g, tolerance, order)
