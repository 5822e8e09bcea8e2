"""Whole analyses: a ``Diversity`` of calls gives each result as a DataFrame."""

from __future__ import annotations

from functools import cached_property, reduce
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from ..scratch import Scratch, written


class Diversity:
    """Rarefied richness, private richness and private richness of combinations.

    ``order`` gives the populations' order (lexicographic if left out). Loci above ``tolerance`` are dropped first. The calls are
    read once: their counts by locus, population and allele (missing calls, too) are written to the shared folder, and
    every result comes from that table; ``close``, or leaving the object as a context, removes it. Only the populations, the number of loci and the smallest samples
    (a row per population) reach the driver before a result is computed. A call without a population belongs to none and is left out.
    """

    def __init__(self, calls: DataFrame, max_g: int, tolerance: float = 1.0, order: list[str] | None = None, compat: bool = False):
        self.all_calls = calls.where("pop is not null")
        self.max_g, self.tolerance, self.compat, self._order = max_g, tolerance, compat, order
        self._spark = calls.sparkSession
        self._scratch = Scratch(self._spark)

    @classmethod
    def of_counts(cls, counts: DataFrame, max_g: int, tolerance: float = 1.0, order: list[str] | None = None, compat: bool = False) -> Diversity:
        """An analysis of call counts (locus, pop, allele, n; missing calls as a null allele) instead of calls; ``calls`` are its rows repeated."""
        counts = counts.where("pop is not null")
        out = cls(counts.select("pop", "locus", "allele", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col"), max_g, tolerance, order, compat)
        with out._scratch:
            out._counted = written(counts.select("locus", "pop", "allele", "n"))
        return out

    @cached_property
    def _counted(self) -> DataFrame:
        with self._scratch:
            return written(ops.call_counts(self.all_calls))

    @cached_property
    def _sized(self) -> DataFrame:
        counted = self._counted
        with self._scratch:
            return written(ops.sizes_of_counts(counted))

    def __enter__(self) -> Diversity:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Remove the tables that the results read; none can be computed any more. Without it they go when the session's JVM ends."""
        self._scratch.close()

    def _kept(self, df: DataFrame) -> DataFrame:
        return df if self.tolerance >= 1 else ops.drop_loci(df, self.deleted_loci())

    @cached_property
    def calls(self) -> DataFrame:
        return self._kept(self.all_calls)

    def deleted_loci(self) -> DataFrame:
        return ops.above_tolerance(self._sized, self.tolerance)

    @cached_property
    def sizes(self) -> DataFrame:
        return self._kept(self._sized.select("locus", "pop", "nj"))

    @cached_property
    def counts(self) -> DataFrame:
        return self._kept(self._counted.where("allele is not null").select("locus", "allele", "pop", "n"))

    @cached_property
    def loci(self) -> int:
        return self.sizes.select("locus").distinct().count()

    @cached_property
    def _least(self) -> dict[str, int]:
        return {r["pop"]: r["least"] for r in ops.least_sizes(self.sizes, self.loci).collect()}

    @cached_property
    def pops(self) -> list[str]:
        return self._order or sorted(self._least)

    @cached_property
    def most_g(self) -> int:
        """The largest sample size that every population allows at every locus."""
        return min(self.max_g, min(self._least.values(), default=0))

    @cached_property
    def spectrum(self) -> DataFrame:
        return ops.spectrum(self.counts, self.sizes)

    @cached_property
    def classes(self) -> DataFrame:
        return ops.allele_classes(self.counts, self.sizes, self.pops)

    def richness_by_locus(self) -> DataFrame:
        return ops.richness_by_locus(self.spectrum, ops.least_sizes(self.sizes, self.loci), self.max_g)

    def richness(self) -> DataFrame:
        """pop, g, num_loci, mean, var, std_err."""
        return ops.summary(self.richness_by_locus(), ["pop"], self.loci)

    def _terms(self, ks: list[int]) -> DataFrame:
        return ops.subset_terms(self.classes, ks, max(self.most_g, 1))

    def combinations_by_locus(self, k: int, places: bool = False) -> DataFrame:
        """combo, g, locus, value for every combination, g and locus; with ``places`` also the populations' places in order, first."""
        total, place = comb(len(self.pops), k), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(comb(len(self.pops), k), 1) - 1).cast("long")))
        loci = self.sizes.select("locus").distinct().where(F.lit(total > 0)).select("locus", place.alias("rank"))
        each = ops.by_g(loci.select("locus", ops.unranked("rank", len(self.pops), k).alias("combo")), self.most_g)
        found = each.join(self._terms([k]), ["combo", "g", "locus"], "left")
        return found.select(*self._names(places), "g", "locus", F.coalesce("value", F.lit(0.0)).alias("value"))

    def every_combination(self, ks: list[int], zeros: bool = True, places: bool = False) -> DataFrame:
        """k, (places,) combo, g, num_loci, mean, var, std_err for every combination of each of ``ks`` populations, from one reading of the counts and one
        traversal of each allele's holders. Without ``zeros`` only combinations with a part above 0 have rows, and C(J, k) rows are never
        made: all others have mean, variance and standard error 0 (null for the latter two where there is one locus)."""
        spark, ks = self._spark, sorted(set(ks))
        out = ops.summary_of_terms(self._terms(ks), self.loci)
        if zeros:
            grid = reduce(DataFrame.union, [ops.combination_grid(spark, self.pops, k, self.most_g) for k in ks])
            out = ops.with_zeros(out, grid, self.loci)
        if self.compat and self.most_g < 2 and self.loci:
            nan = F.lit(float("nan"))
            for k in ks:
                grid = ops.combination_grid(spark, self.pops, k, 2)
                out = out.union(grid.select("combo", "g", F.lit(self.loci).cast("long"), nan, nan, nan))
        return out.select(F.size("combo").cast("long").alias("k"), *self._names(places), *out.columns[1:])

    def combinations(self, k: int, zeros: bool = True) -> DataFrame:
        """combo, g, num_loci, mean, var, std_err for every combination of k populations."""
        return self.every_combination([k], zeros).drop("k")

    def private_by_locus(self) -> DataFrame:
        return self.combinations_by_locus(1).select(F.col("combo")[0].alias("pop"), "g", "locus", "value")

    def private(self) -> DataFrame:
        out = self.combinations(1)
        return out.select(F.col("combo")[0].alias("pop"), *out.columns[1:])

    def _names(self, places: bool = False) -> list:
        """A combination by names, in the populations' order, and by their places."""
        return [F.col("combo").alias("places")] * places + [ops.named("combo", self.pops).alias("combo")]

    def placed(self, result: DataFrame) -> DataFrame:
        """A result by population with its place and name as ``places`` and ``combo``, as combinations have them."""
        place = written(self._spark.createDataFrame([([i], p) for i, p in enumerate(self.pops)], "places array<int>, pop string").coalesce(1))
        return result.join(place, "pop").select("places", F.array("pop").alias("combo"), *[c for c in result.columns if c != "pop"])
