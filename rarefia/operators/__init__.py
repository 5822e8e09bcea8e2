"""Operators on calls, as lazy DataFrame transformations without Python functions.

Counting is one hash aggregation with map-side sums. All that follows works on the counts, whose size is that of the
allele catalogue, not of the calls. An allele that a population lacks adds nothing to its richness and multiplies nothing
in a product, so only the populations that have an allele are carried, and zeros are merged in at the end.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import CHUNK, absent_by_size, exact_sum, mean_with_zeros, merged_moments, sorted_moments, variance_with_zeros


# --- quality ---


def missingness(calls: DataFrame) -> DataFrame:
    """(locus, pop, missing_fraction): missing calls by all calls, one division of two whole numbers."""
    missing = F.count_if(F.col("allele").isNull())
    return calls.groupBy("locus", "pop").agg((missing / F.count("*")).alias("missing_fraction"))


def above_tolerance(sizes: DataFrame, tolerance: float) -> DataFrame:
    """(locus) of rows (locus, pop, nj, calls) with a missing fraction above ``tolerance``; one that equals it stays. The fraction is
    the same division as in ``missingness``, so 3 of 10 is the number that 0.3 is."""
    return sizes.where((F.col("calls") - F.col("nj")) / F.col("calls") > tolerance).select("locus").distinct()


def bad_loci(calls: DataFrame, tolerance: float) -> DataFrame:
    """(locus) of those with a missing fraction above ``tolerance`` in any population; none at tolerance 1."""
    return above_tolerance(calls.groupBy("locus", "pop").agg(F.count("allele").alias("nj"), F.count("*").alias("calls")), tolerance)


def drop_loci(calls: DataFrame, loci: DataFrame) -> DataFrame:
    """Calls without the loci given."""
    return calls.join(loci, "locus", "left_anti")


# --- counts ---


def allele_counts(calls: DataFrame) -> DataFrame:
    """(locus, allele, pop, n) of the alleles that occur."""
    return calls.where("allele is not null").groupBy("locus", "allele", "pop").agg(F.count("*").alias("n"))


def call_counts(calls: DataFrame) -> DataFrame:
    """(locus, pop, allele, n), missing calls as a null allele: all that later work needs to know of the calls."""
    return calls.groupBy("locus", "pop", "allele").agg(F.count("*").alias("n"))


def sizes_of_counts(counts: DataFrame) -> DataFrame:
    """(locus, pop, nj, calls) of call counts: calls that aren't missing, and all."""
    present = F.coalesce(F.sum(F.when(F.col("allele").isNotNull(), F.col("n"))), F.lit(0))
    return counts.groupBy("locus", "pop").agg(present.cast("long").alias("nj"), F.sum("n").alias("calls"))


def sample_sizes(calls: DataFrame) -> DataFrame:
    """(locus, pop, nj): calls that aren't missing; 0 where all are."""
    return calls.groupBy("locus", "pop").agg(F.count("allele").alias("nj"))


def populations(calls: DataFrame) -> DataFrame:
    """(pop, rows, idx): calls per population and its place in lexicographic order."""
    from pyspark.sql.window import Window

    # one row per population, as many as the result has
    return calls.groupBy("pop").agg(F.count("*").alias("calls")).withColumn("idx", F.dense_rank().over(Window.orderBy("pop")) - 1)


def dense_counts(calls: DataFrame, pops: list[str]) -> DataFrame:
    """(locus, allele, pop, n) with 0 for the populations that lack an allele."""
    counts = allele_counts(calls).groupBy("locus", "allele").agg(F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("by"))
    names = F.array(*[F.lit(p) for p in pops])
    return counts.select("locus", "allele", F.explode(names).alias("pop"), "by").select("locus", "allele", "pop", F.coalesce(F.col("by")[F.col("pop")], F.lit(0)).cast("long").alias("n"))


def distinct_alleles(calls: DataFrame) -> DataFrame:
    """(locus, alleles): distinct alleles over all populations."""
    return calls.groupBy("locus").agg(F.count_distinct("allele").alias("alleles"))


def least_sizes(sizes: DataFrame, loci: int) -> DataFrame:
    """(pop, least): the smallest sample over all loci, 0 if the population has no row at one of them."""
    return sizes.groupBy("pop").agg(F.when(F.count("*") < loci, 0).otherwise(F.min("nj")).cast("long").alias("least"))


# --- rarefaction ---


def q_table(counts: DataFrame, sizes: DataFrame, max_g: int) -> DataFrame:
    """(locus, allele, pop, nj, q): q is the array by sample size, element 0 first, of the chance to miss the allele."""
    both = counts.join(sizes, ["locus", "pop"])
    return both.select("locus", "allele", "pop", "nj", absent_by_size(F.col("n"), F.col("nj"), max_g).alias("q"))


def by_g(df: DataFrame, most) -> DataFrame:
    """A row for each sample size from 2 to ``most`` (a column or number)."""
    top = most if not isinstance(most, int) else F.lit(most)
    return df.where(top >= 2).withColumn("g", F.explode(F.sequence(F.lit(2), top.cast("int"))))


def spectrum(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(locus, pop, n, nj, alleles): how many alleles of a population have ``n`` of its ``nj`` calls. The chance to miss an allele
    depends on these two alone, so it is computed for each such row and not for each allele."""
    return counts.groupBy("locus", "pop", "n").agg(F.count("*").alias("alleles")).join(sizes, ["locus", "pop"])


def richness_by_locus(spectra: DataFrame, least: DataFrame, max_g: int) -> DataFrame:
    """(pop, g, locus, value) for every g up to the population's own smallest sample."""
    sized = spectra.join(least, "pop").withColumn("q", absent_by_size(F.col("n"), F.col("nj"), max_g))
    sized = by_g(sized, F.least(F.col("least"), F.lit(max_g)))
    return sized.groupBy("pop", "g", "locus").agg(exact_sum(F.col("alleles") * (1 - F.get("q", F.col("g")))).alias("value"))


def richness_values(spectra: DataFrame, max_g: int) -> DataFrame:
    """(pop, g, locus, nj, value) for every g up to the sample of each locus."""
    sized = by_g(spectra.withColumn("q", absent_by_size(F.col("n"), F.col("nj"), max_g)), F.least(F.col("nj"), F.lit(max_g)))
    return sized.groupBy("pop", "g", "locus", "nj").agg(exact_sum(F.col("alleles") * (1 - F.get("q", F.col("g")))).alias("value"))


def names(pops: list[str]) -> Column:
    return F.array(*[F.lit(p) for p in pops]).cast("array<string>")


def allele_classes(counts: DataFrame, sizes: DataFrame, pops: list[str]) -> DataFrame:
    """(locus, held, alleles): ``held`` has the places in ``pops`` of the populations that have an allele, ascending, with its counts and
    their sample sizes; alleles of a locus that agree in all of these are one row."""
    place = counts.sparkSession.createDataFrame(list(enumerate(pops)), "i int, pop string")  # a row per population; Spark broadcasts it if it is small
    all_ = counts.join(sizes, ["locus", "pop"]).join(place, "pop")
    held = all_.groupBy("locus", "allele").agg(F.sort_array(F.collect_list(F.struct("i", "n", "nj"))).alias("held"))
    # dealt out to as many tasks as shuffles have, however few bytes these are: each row is much work for what follows
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(tasks, "locus", "held").groupBy("locus", "held").agg(F.count("*").alias("alleles"))


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is made once. Without it the optimizer may write what makes an array into the function that reads it,
    once for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def products_before(factors: Column, first: Column) -> Column:
    """For an array of arrays the array of ``first`` times the product of all before each place and, last, of all. Products are
    appended to a chunk and chunks to a list, so that what is copied grows with the places times the chunk's length."""

    def more(a: Column, f: Column) -> Column:
        return F.array_append(a, _times(F.element_at(a, -1), f))

    def chunk(done: Column, c: Column) -> Column:
        last = F.element_at(F.element_at(done, -1), -1)
        return F.array_append(done, F.slice(F.aggregate(F.slice(factors, c * CHUNK + 1, CHUNK), F.array(last), more), 2, CHUNK))

    chunks = F.filter(F.sequence(F.lit(0), F.floor(F.size(factors) / CHUNK).cast("int")), lambda c: c * CHUNK < F.size(factors))
    return F.flatten(F.aggregate(chunks, F.array(F.array(first)), chunk))


def _extended(level: int, ks: list[int], wanted: int):
    """The subsets with one later holder more: closed if their size is wanted, open if larger ones are."""

    def subsets(h: Column) -> Column:
        # a later place must leave room for as many holders as the smallest wanted size still needs
        later = F.slice(h["q"], h["last"] + 2, F.greatest(F.size(h["who"]) - (wanted - level) - h["last"] - 1, F.lit(0)))

        def with_one(x: Column, i: Column) -> Column:
            j = h["last"] + 1 + i
            combo, w = F.array_append(h["combo"], F.get(h["who"], j)), _times(x["passed"], F.transform(x["q"], lambda v: 1 - v))
            made = []
            if level in ks:
                made.append(F.struct(combo.alias("combo"), j.alias("last"), _times(w, F.get(h["after"], j + 1)).alias("w"), F.lit(True).alias("closed")))
            if level < max(ks):
                made.append(F.struct(combo.alias("combo"), j.alias("last"), w.alias("w"), F.lit(False).alias("closed")))
            return F.array(*made)

        pairs = lambda q: F.zip_with(F.slice(products_before(q, h["w"]), 1, F.size(q)), q, lambda p, f: F.struct(p.alias("passed"), f.alias("q")))
        return F.flatten(F.transform(_bound(later, pairs), with_one))

    return subsets


def subset_terms(classes: DataFrame, ks: list[int], most: int) -> DataFrame:
    """(combo, g, locus, value): the positive parts of private richness of combinations of ``k`` populations for all ``ks`` at once.

    Only subsets of an allele's holders have positive parts. They are made in one traversal, a level per size: a subset carries the
    product w of its members' chances to be seen and of the passed holders' chances to be missed, by sample size. It is extended by
    every later holder in a single pass that goes on multiplying what is passed, and closed with the product of the chances to
    miss all holders after its last, which is known for every place. So a subset costs a few multiplications per sample size, however many
    holders there are, and nothing is divided (chances may be 0). For k = 1 this is the product of all before and all after.
    ``combo`` has the places of the populations, ascending.
    """
    width, deepest = max(most - 1, 0), max(ks)
    misses = F.transform("held", lambda h: F.slice(absent_by_size(h["n"], h["nj"], most), 3, width))  # from 2
    ones = F.array_repeat(F.lit(1.0), width)
    df = classes.where(F.size("held") >= min(ks)).select("locus", "alleles", F.transform("held", lambda h: h["i"]).alias("who"), misses.alias("q"))
    # after[i]: the product over all holders from the i-th on; the last is of none
    after = F.reverse(_bound(F.reverse("q"), lambda q: products_before(q, ones)))
    df = df.select("locus", "who", "q", after.alias("after"), F.array().cast("array<int>").alias("combo"), F.lit(-1).alias("last"), F.transform(ones, lambda x: x * F.col("alleles")).alias("w"), F.lit(False).alias("closed"))
    for level in range(1, deepest + 1):
        wanted = min(k for k in ks if k >= level)
        grown = _bound(F.struct("who", "q", "after", "combo", "last", "w"), _extended(level, ks, wanted))
        kept = F.array(F.struct("combo", "last", "w", "closed"))
        df = df.withColumn("next", F.explode(grown if level == 1 else F.when(F.col("closed"), kept).otherwise(grown)))
        if level < deepest:  # closed subsets drop what only extensions read
            still = lambda c: F.when(~F.col("next.closed"), F.col(c)).alias(c)
            df = df.select("locus", still("who"), still("q"), still("after"), "next.*")
    terms = df.select("locus", "next.combo", F.posexplode("next.w").alias("g", "x"))
    return terms.groupBy("combo", (F.col("g") + 2).alias("g"), "locus").agg(exact_sum(F.col("x")).alias("value"))


# --- combinations by number ---


def _binomial(n: str, k: int) -> str:
    """C(n, k) as a long, in SQL; 0 where n < k. Every step of the product is a whole number."""
    full = f"aggregate(sequence(1L, {k}L), 1L, (p, i) -> (p * ({n} - {k}L + i)) div i)" if k else "1L"
    return f"if({n} < {k}L, 0L, {full})"


def unranked(rank: str, among: int, k: int) -> Column:
    """The combination of ``k`` of the numbers below ``among`` that the column ``rank`` numbers, in lexicographic order from 0, as an ascending array.

    Counted from the last combination, rank is a sum of binomials C(c, k) + C(c', k - 1) + ... with descending c; each c is
    found by binary search, and stands for the number among - 1 - c. As one SQL text it is built in one call.
    """
    total = comb(among, k)
    if total * max(among, 1) >= 2**63:
        raise ValueError(f"too many combinations of {k} of {among} to number")
    state = f"named_struct('out', cast(array() as array<int>), 'left', {total - 1}L - `{rank}`)"
    for t in range(k, 0, -1):
        # held in an array of one, so that each search is written once in the expression
        state = f"get(transform(array({state}), s{t} -> {_next_number(among, t)}), 0)"
    return F.expr(state)["out"]


def _next_number(among: int, t: int) -> str:
    """The step of ``unranked`` from the state ``s<t>``, in SQL: finds the number with ``t - 1`` more to come."""
    half = f"if({_binomial('m', t)} <= s{t}.left, named_struct('lo', m, 'hi', h.hi), named_struct('lo', h.lo, 'hi', m - 1L))"
    halved = f"get(transform(array(shiftright(h.lo + h.hi + 1L, 1)), m -> {half}), 0)"
    found = f"aggregate(sequence(0, {among.bit_length()}), named_struct('lo', 0L, 'hi', {among - 1}L), (h, step) -> {halved}, h -> h.lo)"
    extended = f"named_struct('out', array_append(s{t}.out, cast({among - 1}L - c as int)), 'left', s{t}.left - {_binomial('c', t)})"
    return f"get(transform(array({found}), c -> {extended}), 0)"


# --- statistics over loci ---


#: Values of a group that are sorted together; larger groups are dealt out by hash to so many parts that about as many are in each.
BLOCK = 4_096


def moments(values: DataFrame, by: list[str], size: int) -> DataFrame:
    """(*by, g, moments) of ``value`` over the rows of a group, of which there are about ``size``.

    Values are sorted before they are added, so the bits of a result don't depend on how rows are ordered and partitioned. What tells rows
    of a group apart deals them out to blocks, whose moments are merged in the order of their numbers.
    """
    blocks = -(-size // BLOCK)
    if blocks < 2:
        return values.groupBy(*by, "g").agg(sorted_moments(F.collect_list("value")).alias("moments"))
    apart = [c for c in values.columns if c not in (*by, "g", "value")]
    parts = values.groupBy(*by, "g", F.pmod(F.xxhash64(*apart), F.lit(blocks)).alias("place")).agg(sorted_moments(F.collect_list("value")).alias("moments"))
    return parts.groupBy(*by, "g").agg(merged_moments(F.collect_list(F.struct("place", "moments"))).alias("moments"))


def summary(values: DataFrame, by: list[str], size: int) -> DataFrame:
    """Count, mean, sample variance and standard error over loci; every locus must have its row. ``size`` is about the number of rows in a group."""
    n, var = F.col("moments.n"), F.when(F.col("moments.n") > 1, F.col("moments.m2") / F.nullif(F.col("moments.n") - 1, F.lit(0.0)))
    out = moments(values, by, size).select(*by, "g", n.cast("long").alias("num_loci"), (F.col("moments.s") / n).alias("mean"), var.alias("var"))
    return out.withColumn("std_err", F.sqrt(F.col("var") / F.col("num_loci")))


def summary_of_terms(terms: DataFrame, loci: int) -> DataFrame:
    """The same over ``loci`` loci where loci without a row are 0, for every (combo, g) that has a row; all others have mean and variance 0."""
    some = moments(terms, ["combo"], loci).select("combo", "g", "moments.*")
    mean, var = mean_with_zeros(F.col("s"), loci), variance_with_zeros(F.col("n"), F.col("m"), F.col("m2"), loci)
    return some.select("combo", "g", F.lit(loci).cast("long").alias("num_loci"), mean.alias("mean"), var.alias("var"), F.sqrt(var / F.lit(float(loci))).alias("std_err"))


def with_zeros(stats: DataFrame, grid: DataFrame, loci: int) -> DataFrame:
    """The statistics with a row for every (combo, g) of the grid."""
    zero = F.lit(0.0 if loci > 1 else None).cast("double")
    found = grid.join(stats, ["combo", "g"], "left")
    none = F.col("num_loci").isNull()
    fill = lambda c, v: F.when(none, v).otherwise(F.col(c)).alias(c)
    return found.select("combo", "g", fill("num_loci", F.lit(loci).cast("long")), fill("mean", F.lit(0.0)), fill("var", zero), fill("std_err", zero))


def combinations_of(spark, among: int, k: int) -> DataFrame:
    """(combo) of every combination of ``k`` of the numbers below ``among``. Every task makes those of a range of numbers."""
    total = comb(among, k)
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, total // 1_000))
    return spark.range(0, total, 1, tasks).select(unranked("id", among, k).alias("combo"))


def combination_grid(spark, pops: list[str], k: int, most: int) -> DataFrame:
    """(combo, g) of every combination of ``k`` populations by their places; these are the rows of the result."""
    return by_g(combinations_of(spark, len(pops), k), most)


def named(combo: Column | str, pops: list[str]) -> Column:
    """Places as names."""
    return F.transform(combo, lambda i: F.get(names(pops), i))


def full_wide(values: DataFrame, by: list[str], loci: list[str], stats: DataFrame) -> DataFrame:
    """One row per group and g with a column for each locus, then mean, variance and standard error."""
    wide = values.groupBy(*by, "g").pivot("locus", loci).agg(F.first("value"))
    return wide.join(stats, [*by, "g"])
