"""Counts and richness that grow by batches, against all calls at once."""

import random

import pytest

from rarefia import operators as ops
from rarefia.plans import Diversity
from rarefia.streaming import GrowingCounts, GrowingRichness, diversity_of


def some_calls(spark, seed, loci, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice(["A", "B", "C", "C", None]) if i > 20 else "ABC"[i % 3], rng.choice(loci), rng.choice(["x", "y", "z", None])) for i in range(n)]
    return spark.createDataFrame(rows, "pop string, locus string, allele string")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def by_names(df):
    return sorted(map(str, (tuple(r[c] for c in ("locus", "pop", "allele", "n")) for r in df.collect())))


def test_batches_add_up(spark, tmp_path):
    counts, values = GrowingCounts(spark, str(tmp_path / "counts")), GrowingRichness(GrowingCounts(spark, str(tmp_path / "counts")), str(tmp_path / "values"), 6)
    first, second, third = some_calls(spark, 1, ["L1", "L2", "L3"]), some_calls(spark, 2, ["L2"]), some_calls(spark, 3, ["L3", "L4"], 40)
    assert counts.counts().count() == 0 and values.refresh() == 0 and values.by_locus().count() == 0
    counts.add(first, 0)
    assert values.refresh() == 3 and rows(values.richness()) == rows(Diversity(first, 6).richness())
    counts.add(second, 1)
    assert values.refresh() == 1, "one locus was touched"
    both = first.union(second)
    for _ in range(2):  # as they are, and after the batch was run again
        assert by_names(counts.counts()) == by_names(ops.call_counts(both.where("pop is not null")))
        assert rows(values.richness()) == rows(Diversity(both, 6).richness())
        counts.add(second, 1)
        assert values.refresh() == 0
    # a batch that failed half-way doesn't count
    (tmp_path / "counts" / "batch-000000000002").mkdir()
    assert counts.batches() == [0, 1]
    counts.add(third, 2)
    all_ = both.union(third)
    assert values.refresh() == 2 and rows(values.richness()) == rows(Diversity(all_, 6).richness())
    before = by_names(counts.counts())
    counts.compact()
    assert counts.batches() == [] and by_names(counts.counts()) == before
    counts.add(second, 1)  # held by the compaction
    assert by_names(counts.counts()) == before
    with diversity_of(counts, 6, 0.4) as d, Diversity(all_, 6, 0.4) as want:
        assert rows(d.richness()) == rows(want.richness()) and rows(d.deleted_loci()) == rows(want.deleted_loci())
        assert d.calls.count() == want.calls.count()


def test_a_stream(spark, tmp_path):
    calls = some_calls(spark, 5, ["L1", "L2"])
    for part in (0, 1):
        calls.where(f"pmod(xxhash64(locus, pop, allele), 2) = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = GrowingCounts(spark, str(tmp_path / "counts"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts.follow(stream, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert len(counts.batches()) == 2 and by_names(counts.counts()) == by_names(ops.call_counts(calls.where("pop is not null")))
    counts.compact()
    assert by_names(counts.counts()) == by_names(ops.call_counts(calls.where("pop is not null")))


def test_smallest_sample_that_grows(spark, tmp_path):
    """A population whose smallest sample grows finds the larger sizes of the loci that weren't touched."""
    make = lambda cells: spark.createDataFrame(cells, "pop string, locus string, allele string")
    counts = GrowingCounts(spark, str(tmp_path / "c"))
    values = GrowingRichness(counts, str(tmp_path / "v"), 5)
    first = make([("A", "L1", a) for a in "xxyyz"] + [("A", "L2", "x")])
    counts.add(first, 0)
    values.refresh()
    assert values.by_locus().count() == 0
    more = make([("A", "L2", a) for a in "xyy"])
    counts.add(more, 1)
    assert values.refresh() == 1 and {r["g"] for r in values.richness().collect()} == {2, 3, 4}
    assert rows(values.richness()) == [pytest.approx(r) for r in rows(Diversity(first.union(more), 5).richness())]
