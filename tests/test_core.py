"""The exact fixture of FIXTURES.md, its edges, and properties."""

import random
from fractions import Fraction as Q
from itertools import combinations
from math import comb, fsum
from statistics import variance

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rarefia import operators as ops
from rarefia.functions import exact_sum
from rarefia.params import Params
from rarefia.plans import Diversity
from rarefia.sources import DataFileError, from_long, from_wide, read_structure_text, text_lines

TINY = """L1 L2
A 1 x
A 1 y
B 2 x
A 2 x
A 3 -9
B 2 x
B 1 z
C 4 x
C 4 y
C 1 y
B 2 x
C 4 -9
"""
ROWS = [tuple(line.split()) for line in TINY.splitlines()[1:]]
PARAMS = Params(MAX_G=4, DATA_LINES=12, LOCI=2, NON_DATA_ROWS=1, NON_DATA_COLS=1, GROUP_BY_COL=1)


def exact(rows, max_g):
    """Richness and combinations by the formulas, with fractions: {(combo, g): {locus: value}}."""
    pops, loci = sorted({r[0] for r in rows}), range(1, len(rows[0]))
    n = {(p, x): [r[x] for r in rows if r[0] == p and r[x] != "-9"] for p in pops for x in loci}
    alleles = {x: sorted({a for p in pops for a in n[p, x]}) for x in loci}

    def miss(p, x, a, g):
        out, size, c = Q(1), len(n[p, x]), n[p, x].count(a)
        for u in range(g):
            out *= Q(max(size - c - u, 0), size - u)
        return out

    rich = {(p, g): {x: sum(1 - miss(p, x, a, g) for a in alleles[x]) for x in loci} for p in pops for g in range(2, max_g + 1) if g <= min(len(n[p, x]) for x in loci)}
    most, combo = min([max_g] + [len(v) for v in n.values()]), {}
    for k in range(1, len(pops) + 1):
        for c in combinations(pops, k):
            for g in range(2, most + 1):
                combo[c, g] = {}
                for x in loci:
                    total = Q(0)
                    for a in alleles[x]:
                        term = Q(1)
                        for p in pops:
                            term *= 1 - miss(p, x, a, g) if p in c else miss(p, x, a, g)
                        total += term
                    combo[c, g][x] = total
    return rich, combo


def stats(values):
    v, n = list(values.values()), len(values)
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v) / (n - 1) if n > 1 else None
    return float(mean), None if var is None else float(var)


def tiny(spark, rows=ROWS, **options):
    df = spark.createDataFrame(rows, ["pop", *[f"L{i}" for i in range(1, len(rows[0]))]])
    return Diversity(from_wide(df, "pop", df.columns[1:], "-9"), options.pop("max_g", 4), **options)


def check(rows, got, names):
    assert {(names(r), r["g"]) for r in got} == set(rows)
    for r in got:
        mean, var = stats(rows[names(r), r["g"]])
        assert r["mean"] == pytest.approx(mean, abs=1e-12)
        assert (r["var"] is None) == (var is None) and (var is None or r["var"] == pytest.approx(var, abs=1e-12))


def test_goldens(spark):
    rich, combo = exact(ROWS, 4)
    d = tiny(spark)
    got = d.richness().collect()
    check(rich, got, lambda r: r["pop"])
    assert ("B", 4) in {(r["pop"], r["g"]) for r in got} and ("A", 4) not in {(r["pop"], r["g"]) for r in got}
    assert sum(rich["A", 2].values()) / 2 == Q(7, 4)
    for k in (1, 2, 3):
        check({c: v for c, v in combo.items() if len(c[0]) == k}, d.combinations(k).collect(), lambda r: tuple(r["combo"]))
    check({(c[0], g): v for (c, g), v in combo.items() if len(c) == 1}, d.private().collect(), lambda r: r["pop"])


def test_by_locus_has_zeros(spark):
    _, combo = exact(ROWS, 4)
    got = {(tuple(r["combo"]), r["g"], r["locus"]): r["value"] for r in tiny(spark).combinations_by_locus(2).collect()}
    assert len(got) == 3 * 2 * 2
    for (c, g), v in combo.items():
        if len(c) == 2:
            for x, value in v.items():
                assert got[c, g, f"L{x}"] == pytest.approx(float(value), abs=1e-12)


def test_counts_and_missing(spark):
    d = tiny(spark)
    dense = {(r["locus"], r["allele"], r["pop"]): r["n"] for r in ops.dense_counts(d.calls, d.pops).collect()}
    assert len(dense) == 21 and dense["L1", "4", "A"] == 0 and dense["L1", "2", "B"] == 3
    miss = {(r["locus"], r["pop"]): r["missing_fraction"] for r in ops.missingness(d.calls).collect()}
    assert miss["L2", "A"] == 0.25 and miss["L1", "A"] == 0
    for tolerance, gone in ((0.25, []), (0.2, ["L2"]), (0.0, ["L2"])):
        assert [r["locus"] for r in tiny(spark, tolerance=tolerance).deleted_loci().collect()] == gone
    one = tiny(spark, tolerance=0.2)
    assert all(r["num_loci"] == 1 and r["var"] is None and r["std_err"] is None for r in one.richness().collect() + one.private().collect())


def test_fractions_that_equal_the_tolerance(spark):
    """A locus stays where its missing fraction m / n equals the tolerance, for every m / n up to n = 50, and goes where it's above."""
    pairs = [(m, n) for n in range(1, 51) for m in range(n)]
    sizes = spark.createDataFrame([(f"{m}/{n}", "A", n - m, n) for m, n in pairs], "locus string, pop string, nj long, calls long").cache()
    for m, n in pairs[:: len(pairs) // 40] + [(3, 10), (1, 3), (2, 3), (3, 7), (0, 9)]:
        gone = {r["locus"] for r in ops.above_tolerance(sizes, m / n).collect()}
        assert gone == {f"{a}/{b}" for a, b in pairs if Q(a, b) > Q(m, n)}
    calls = spark.createDataFrame([("A", "L1", None if i < 3 else "x") for i in range(10)], "pop string, locus string, allele string")
    assert Diversity(calls, 4, 0.3).deleted_loci().count() == ops.bad_loci(calls, 0.3).count() == 0
    assert Diversity(calls, 4, 0.29).deleted_loci().count() == ops.bad_loci(calls, 0.29).count() == 1
    sizes.unpersist()


def test_numbered_combinations(spark):
    for among, k in ((1, 1), (6, 1), (7, 3), (6, 6), (30, 4), (40, 2), (5, 6)):
        want = list(combinations(range(among), k))
        got = [tuple(r["c"]) for r in spark.range(len(want)).select(ops.unranked("id", among, k).alias("c")).collect()]
        assert got == want
    grid = ops.combination_grid(spark, [f"p{i}" for i in range(30)], 4, 8)
    rows = grid.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 8 and max(r["count"] for r in rows) <= 1.01 * min(r["count"] for r in rows) and grid.count() == comb(30, 4) * 7
    with pytest.raises(ValueError):
        ops.unranked("id", 10**6, 5)


def test_one_row_for_alleles_alike(spark):
    """The kernels get a row for each distinct count and each distinct vector of counts, not for each allele."""
    rows = [(p, f"{x}{i}") for p, often in (("A", 2), ("B", 3)) for x in "st" for i in range(50) for _ in range(often)]
    rows += [("C", "s0"), ("C", "s1"), ("C", "only"), ("C", "only"), ("C", "only")]
    d = tiny(spark, rows)
    assert d.counts.count() == 203
    spectrum = {(r["pop"], r["n"], r["nj"], r["alleles"]) for r in d.spectrum.collect()}
    assert spectrum == {("A", 2, 200, 100), ("B", 3, 300, 100), ("C", 1, 5, 2), ("C", 3, 5, 1)}
    classes = {(tuple(map(tuple, r["held"])), r["alleles"]) for r in d.classes.collect()}
    assert classes == {(((0, 2, 200), (1, 3, 300)), 98), (((0, 2, 200), (1, 3, 300), (2, 1, 5)), 2), (((2, 3, 5),), 1)}
    rich, combo = exact(rows, 4)
    check(rich, d.richness().collect(), lambda r: r["pop"])
    check(combo, d.every_combination([1, 2, 3]).collect(), lambda r: tuple(r["combo"]))


@pytest.mark.parametrize("ks", [[1], [1, 3], [2, 5], [4], [1, 2, 3, 4, 5, 6]])
def test_many_sizes_in_one_traversal(spark, ks):
    """Any set of sizes gives what each size gives, with populations that hold all calls of a locus (chances of 0), and none at all."""
    rng = random.Random(4)
    rows = [(p, *[rng.choice(["a", "b", "c", "d", "-9"] if p != "P5" else ["a"]) for _ in range(3)]) for p in ("P1", "P2", "P3", "P4", "P5", "P6") for _ in range(7)]
    _, combo = exact(rows, 3)
    want = {c: v for c, v in combo.items() if len(c[0]) in ks}
    d = tiny(spark, rows, max_g=3)
    got = d.every_combination(ks).collect()
    check(want, got, lambda r: tuple(r["combo"]))
    assert {(len(r["combo"]), r["k"]) for r in got} == {(k, k) for k in ks if want}
    some = {(tuple(r["combo"]), r["g"]): r["mean"] for r in d.every_combination(ks, zeros=False).collect()}
    assert all(r["mean"] == some.get((tuple(r["combo"]), r["g"]), 0) for r in got) and set(some) <= set(want)


def test_products_of_many_holders(spark):
    """More holders than a chunk of products has places."""
    rows = [(f"p{i:03d}", a) for i in range(75) for a in ["x"] * (1 + i % 3) + ["y"] * 2 + [f"own{i}"]]
    pops = sorted({r[0] for r in rows})
    counts = {p: {a: sum(r == (p, a) for r in rows) for a in {r[1] for r in rows if r[0] == p}} for p in pops}
    miss = lambda p, a, g: Q(comb(sum(counts[p].values()) - counts[p].get(a, 0), g), comb(sum(counts[p].values()), g))
    got = {(r["pop"], r["g"]): r["value"] for r in tiny(spark, rows, max_g=3).private_by_locus().collect()}
    for p in pops[::9]:
        for g in (2, 3):
            want = Q(0)
            for a in counts[p]:
                term = 1 - miss(p, a, g)
                for o in pops:
                    term *= miss(o, a, g) if o != p else 1
                want += term
            assert got[p, g] == pytest.approx(float(want), rel=1e-12)


def test_tables_go_with_the_analysis(spark):
    import os

    with tiny(spark) as d:
        assert d.richness().count() and any(files for _, _, files in os.walk(d._scratch.folder.removeprefix("file:")))
    assert not os.path.exists(d._scratch.folder.removeprefix("file:"))


def test_text_source(spark, tmp_path):
    path = tmp_path / "data.txt"
    path.write_text(TINY.replace("B 2 x\nA 2 x", "B 2 x\n\n  A\t2   x"))
    calls, loci, order = read_structure_text(spark, str(path), PARAMS)
    assert loci == ["L1", "L2"] and order == ["A", "B", "C"]
    check(exact(ROWS, 4)[0], Diversity(calls, 4, order=order).richness().collect(), lambda r: r["pop"])
    for text in (TINY + "A 1 x\n", TINY.replace("A 1 x\n", ""), TINY.replace("A 1 x", "A 1"), TINY.replace("A 1 x", "A 1 x y"), TINY.replace("L1 L2", "L1"), ""):
        path.write_text(text)
        with pytest.raises(DataFileError):
            read_structure_text(spark, str(path), PARAMS)
    path.write_text(TINY + "A 1 x\nD 7 7\n")
    skip = Params(**{**PARAMS.__dict__, "SKIP_CHK": True})
    assert read_structure_text(spark, str(path), skip)[0].count() == 24
    path.write_text(TINY.replace("A 1 x\n", ""))
    with pytest.raises(DataFileError):
        read_structure_text(spark, str(path), skip)


def test_line_numbers(spark, tmp_path):
    """Numbers follow files by name and lines in them, however the files are cut; the cut at DATA_LINES and the order of populations with them."""
    body = [f"p{i // 37:02d} a{i % 5} b{i % 3}" for i in range(900)]
    for f, part in (("1", ["L1 L2", *body[:300]]), ("2", body[300:310]), ("3", body[310:])):
        (tmp_path / f"part{f}.txt").write_text("\n".join(part) + "\n")
    params, found = Params(**{**PARAMS.__dict__, "DATA_LINES": 500, "SKIP_CHK": True}), []
    for size, cores in (("128m", 1), ("600b", 4), ("150b", 64)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10b")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        try:
            lines = text_lines(spark, str(tmp_path))
            assert [r["value"] for r in lines.orderBy("id").collect()] == ["L1 L2", *body] and [r["id"] for r in lines.select("id").orderBy("id").collect()] == list(range(901))
            calls, loci, order = read_structure_text(spark, str(tmp_path), params)
            found.append((loci, order, sorted(map(tuple, calls.groupBy("pop", "locus", "allele").count().collect()))))
        finally:
            for name in ("files.maxPartitionBytes", "files.openCostInBytes", "leafNodeDefaultParallelism"):
                spark.conf.unset(f"spark.sql.{name}")
    assert found[0] == found[1] == found[2] and found[0][1] == [f"p{i:02d}" for i in range(14)] and sum(r[3] for r in found[0][2]) == 1_000


def test_faulty_lines_and_white_space(spark, tmp_path):
    path = tmp_path / "data.txt"
    path.write_text(TINY.replace("L1 L2", "L\u00a01 L2"))
    assert read_structure_text(spark, str(path), PARAMS)[1] == ["L\u00a01", "L2"]
    path.write_text(TINY.replace("B 2 x\nB 1 z", "B 2 x 9\nB 1"))
    with pytest.raises(DataFileError, match="line 7 has 4 columns, not 3"):
        read_structure_text(spark, str(path), PARAMS)
    with pytest.raises(DataFileError, match="line 8 has 2 columns, not 3"):
        read_structure_text(spark, str(path), Params(**{**PARAMS.__dict__, "SKIP_CHK": True}))


def test_very_many_loci(spark, tmp_path):
    """A plan for a text doesn't grow with its loci."""
    plans, n = [], 100_000
    for loci in (10, n):
        path = tmp_path / f"wide{loci}.txt"
        path.write_text(" ".join(f"L{i}" for i in range(loci)) + "\n" + "".join(f"{p} " + " ".join(f"{(i + k) % 3}" for i in range(loci)) + "\n" for k, p in enumerate("AABB")))
        calls, names, order = read_structure_text(spark, str(path), Params(**{**PARAMS.__dict__, "LOCI": loci, "DATA_LINES": 4}))
        plans.append(len(calls._jdf.queryExecution().optimizedPlan().toString()))
        assert len(names) == loci and order == ["A", "B"]
    assert plans[1] < plans[0] + 100 and calls.count() == 4 * n
    d = Diversity(calls, 2)
    assert {(r["pop"], r["num_loci"], r["mean"]) for r in d.richness().collect()} == {("A", n, 2.0), ("B", n, 2.0)}


def test_order_of_populations(spark):
    calls = tiny(spark).calls
    d = Diversity(calls, 4, order=["C", "A", "B"])
    assert {tuple(r["combo"]) for r in d.combinations(2).collect()} == {("C", "A"), ("C", "B"), ("A", "B")}
    assert all(r["mean"] > 0 for r in d.combinations(3).collect())


def test_edges(spark):
    single = [r for r in ROWS if r[0] == "B"]
    d = tiny(spark, single)
    key = lambda rows: {(r["pop"], r["g"], round(r["mean"], 12)) for r in rows}
    assert key(d.private().collect()) == key(d.richness().collect())
    lonely = tiny(spark, [*ROWS, ("D", "1", "x")])
    assert {r["pop"] for r in lonely.richness().collect()} == {"A", "B", "C"} and not lonely.private().collect()
    assert all(r["mean"] != r["mean"] for r in tiny(spark, [*ROWS, ("D", "1", "x")], compat=True).combinations(2).collect())
    holes = tiny(spark, [(r[0], r[1], "-9" if r[0] == "A" else r[2]) for r in ROWS])
    assert {r["pop"] for r in holes.richness().collect()} == {"B", "C"} and not holes.private().collect()
    none = tiny(spark, [(r[0], r[1], "-9") for r in ROWS])
    assert not none.richness().collect() and not none.private().collect()
    zeros = tiny(spark, [("A", "01"), ("A", "1"), ("A", "1")], max_g=2)
    assert zeros.richness().head()["mean"] == pytest.approx(float(Q(5, 3)))
    empty = Diversity(from_long(spark.createDataFrame([], "pop string, locus string, allele string")), 4)
    assert not empty.richness().collect() and not empty.private().collect()


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from(["1", "2", "3", "-9"]), st.sampled_from(["x", "y"])), min_size=8, max_size=24))
def test_properties(spark, rows):
    rich, combo = exact(rows, 4)
    d = tiny(spark, rows)
    check(rich, d.richness().collect(), lambda r: r["pop"])
    check({c: v for c, v in combo.items() if len(c[0]) == 2}, d.combinations(2).collect() if len(d.pops) > 1 else [], lambda r: tuple(r["combo"]))


def test_one_scan(spark, tmp_path):
    """The calls' files are read for the written counts alone; the results' plans hold no Python and few exchanges."""
    path = str(tmp_path / "calls.parquet")
    spark.createDataFrame(ROWS, ["pop", "L1", "L2"]).write.parquet(path)
    for tolerance in (1.0, 0.2):
        d = Diversity(from_wide(spark.read.parquet(path), "pop", ["L1", "L2"], "-9"), 4, tolerance)
        for out in (d.richness(), d.private(), d.combinations(2), d.combinations_by_locus(2), d.deleted_loci()):
            assert not any("calls.parquet" in f for f in out.inputFiles())
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= (6 if tolerance == 1 else 10) and "Python" not in plan and "Cartesian" not in plan
        assert d._counted.count() and not d._counted.where("n < 1").count()
        d.close()


def test_names_of_columns(spark):
    df = spark.createDataFrame([("A", "1", "x", "u"), ("A", "2", "x", "u"), (None, "3", "x", "v"), ("B", "1", "y", None)], ["po.p", "a.b", "pop", "lo`cus"])
    calls = from_wide(df, "po.p", ["a.b", "pop", "lo`cus"])
    assert {tuple(r) for r in calls.collect()} == {("A", "a.b", "1"), ("A", "a.b", "2"), ("A", "pop", "x"), ("A", "lo`cus", "u"), (None, "a.b", "3"), (None, "pop", "x"), (None, "lo`cus", "v"), ("B", "a.b", "1"), ("B", "pop", "y"), ("B", "lo`cus", None)}


def test_calls_without_population(spark):
    rows = [*ROWS, (None, "9", "x"), (None, "1", "q")]
    df = spark.createDataFrame(rows, ["pop", "L1", "L2"])
    with_null, without = Diversity(from_wide(df, "pop", ["L1", "L2"], "-9"), 4), tiny(spark)
    for f in (Diversity.richness, Diversity.private, lambda d: d.combinations(2)):
        assert {tuple(map(str, r)) for r in f(with_null).collect()} == {tuple(map(str, r)) for r in f(without).collect()}


def test_large_samples(spark):
    from pyspark.sql import functions as F

    from rarefia.functions import absent_by_size

    got = spark.range(1).select(absent_by_size(F.lit(3), F.lit(200), 150)).head()[0]
    want = [Q(1)]
    for u in range(150):
        want.append(want[-1] * Q(200 - 3 - u, 200 - u))
    assert got == pytest.approx([float(x) for x in want], abs=1e-12)


def test_sum_without_order(spark):
    """Sums have the same bits in every order, a single value is itself, and tiny parts aren't lost."""
    rng = random.Random(5)
    wide = [rng.random() * 10 ** rng.randint(-25, 6) for _ in range(3_000)]
    groups = {"wide": wide, "tenths": [0.1] * 1_000, "one": [1e-17 / 3], "tiny": [1e-60], "both": [5e-100, 1.5], "none": [0.0, 0.0], "edge": [2.0**-120, 2.0**-150]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    seen = []
    for tasks in (1, 7, 64):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, v double").repartition(tasks)
        seen.append({r["k"]: r["s"] for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()})
    assert seen[0] == seen[1] == seen[2]
    for k, values in groups.items():
        assert seen[0][k] == pytest.approx(fsum(values), rel=1e-15)
    assert seen[0]["one"] == 1e-17 / 3 and seen[0]["tiny"] == 1e-60 and seen[0]["none"] == 0


def test_moments_in_blocks(spark, monkeypatch):
    """Moments are those of all values, however many blocks these are dealt out to; equal values have no variance at all."""
    rng = random.Random(8)
    rows = [("a", 2, f"L{i}", rng.gauss(5, 0.001)) for i in range(500)] + [("b", 2, f"L{i}", 0.1) for i in range(500)]
    df = spark.createDataFrame(rows, "pop string, g int, locus string, value double")
    for block in (4_096, 100, 1):
        monkeypatch.setattr(ops, "BLOCK", block)
        got = {r["pop"]: r for r in ops.summary(df, ["pop"], 500).collect()}
        for pop in "ab":
            values = [r[3] for r in rows if r[0] == pop]
            assert got[pop]["num_loci"] == 500 and got[pop]["mean"] == pytest.approx(fsum(values) / 500, rel=1e-14)
            assert got[pop]["var"] == pytest.approx(variance(values) if pop == "a" else 0, rel=1e-9, abs=1e-30)
    assert ops.summary(df.where("locus = 'L1'"), ["pop"], 1).where("var is null and std_err is null").count() == 2
    assert ops.summary(df.limit(0), ["pop"], 0).count() == 0


@pytest.mark.parametrize("block", [4_096, 3])
def test_same_bits_in_every_partitioning(spark, monkeypatch, block):
    """Rows, their order and the number of tasks change no bit of a result."""
    monkeypatch.setattr(ops, "BLOCK", block)
    rng = random.Random(3)
    rows = [(p, *[str(min(int(rng.expovariate(0.15)), 40)) if rng.random() > 0.05 else "-9" for _ in range(7)]) for p in "ABCD" for _ in range(60)]
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in (1, 3, 50):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            rng.shuffle(rows)
            with tiny(spark, rows, max_g=12) as d:
                results = [d.richness(), d.every_combination([1, 2, 3], places=False), d.richness_by_locus(), d.combinations_by_locus(2)]
                seen.append([sorted(map(tuple, r.collect()), key=repr) for r in results])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and all(seen[0])
