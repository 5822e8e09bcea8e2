import pytest

from rarefia import params as P
from rarefia.cli import main, run
from rarefia.sinks import deleted_report, number
from tests.test_core import TINY

FILE = """MAX_G 3
LOCI 2 # two of them
NON_DATA_ROWS 1
NON_DATA_COLS 1
DATA_LINES 12
GROUP_BY_COL 1
DATA_FILE {0}/data.txt
R_OUT {0}/r
P_OUT {0}/p
C_OUT {0}/c
COMB 1
K_RANGE 2-3
FULL_R 1
FULL_C 1
"""


def test_k_range():
    assert P.parse_k_range("1,3-5") == [1, 3, 4, 5] and P.parse_k_range("3,1,,3") == [1, 3]
    for bad in ("4-2", "2-3-4", "", "a", "-1", "1-"):
        with pytest.raises(P.ParameterError):
            P.parse_k_range(bad)
    for bad in ("0", "4"):
        with pytest.raises(P.ParameterError):
            P.parse_k_range(bad, 3)


def test_files_and_flags():
    got = P.load(FILE.format("/x"), ["-g", "5", "-m", "0"])
    assert got.MAX_G == 5 and got.MISSING == "0" and got.COMB and got.TOLERANCE == 1.0 and got.LOCI == 2
    for text, args in (
        (FILE + "MAX_G 4\n", []), (FILE + "WHAT 4\n", []), (FILE, ["-g"]), (FILE, ["-g", "-l"]), (FILE, ["-x", "1"]), (FILE, ["-g", "1", "-g", "2"]),
        (FILE, ["-g", "-3"]), (FILE, ["-g", "1"]), (FILE, ["-t", "1.5"]), (FILE, ["-t", "x"]), (FILE, ["-c", "2"]), (FILE, ["-s", "2"]), (FILE, ["-k", "3-1"]), (FILE.replace("LOCI 2", "LOCI"), []),
    ):
        with pytest.raises(P.ParameterError):
            P.load(text, args)
    assert set(P.read_file(P.template())) == set(P.FLAGS)


def test_numbers_and_report():
    assert [number(x) for x in (1.75, 0.0138888889, None, 1e-7, 1234567.0)] == ["1.75", "0.0138889", "nan", "1e-07", "1.23457e+06"]
    assert deleted_report(["a", "c"], ["a", "b", "c"], 0.2).splitlines() == ["2 loci have at least one grouping with more than 20% missing data.", "c", "a"]
    assert deleted_report(["b"], ["a", "b", "c"], 0).splitlines()[0] == "1 locus has at least one grouping with missing data."


def test_none_is_unset():
    assert P.load(FILE + "P_OUT none\n" if "P_OUT" not in FILE else FILE.replace("K_RANGE 2-3", "K_RANGE none").replace("COMB 1", "COMB 0")).K_RANGE == ""
    for label in ("DATA_FILE {0}/data.txt", "R_OUT {0}/r", "C_OUT {0}/c"):
        with pytest.raises(P.ParameterError, match="is needed"):
            P.load(FILE.replace(label, label.split()[0] + " none"))
    assert P.load(FILE, ["-m", "none"]).MISSING == "none"


def test_run(spark, tmp_path, monkeypatch):
    (tmp_path / "data.txt").write_text(TINY)
    files = run(spark, P.load(FILE.format(tmp_path)))
    assert {f.split("/")[-1] for f in files} == {"r", "p", "c_2", "c_3", "r_fulldata", "c_2_fulldata", "c_3_fulldata", "r_summary"}
    assert (tmp_path / "r").read_text() == "A 2 2 1.75 0.0138889 0.0833333\nA 3 2 2.25 0.125 0.25\n\nB 2 2 1.5 0 0\nB 3 2 1.75 0 0\n\nC 2 2 1.58333 0.0138889 0.0833333\nC 3 2 1.875 0.03125 0.125\n\n"
    assert (tmp_path / "c_2").read_text().startswith("A B 2 2 0.520833 0.0703125 0.1875\n")
    assert (tmp_path / "c_2_fulldata").read_text().splitlines()[:2] == ["POP_GROUPING1 POP_GROUPING2 G NUM_LOCI L1 L2 MEAN VAR STD_ERR", "A B 2 2 0.708333 0.333333 0.520833 0.0703125 0.1875"]
    only = run(spark, P.load(FILE.format(tmp_path), ["-t", "0.2", "-tnocalc", "1"]))
    summary = (tmp_path / "r_summary").read_text()
    assert "# main\nMAX_G 3\n" in summary and "richness" not in summary and "reading" in summary
    assert len(only) == 2 and (tmp_path / "p_deletedloci").read_text().splitlines()[1:] == ["L2"]
    monkeypatch.chdir(tmp_path)
    assert main([]) == 1 and (tmp_path / "paramfile.txt").exists() and main(["-g"]) == 1 and main(["none"]) == 1


def test_stream(spark, tmp_path):
    from rarefia.streaming import running_counts

    for i in range(2):
        spark.createDataFrame([("A", "L", "1"), ("A", "L", None), ("B", "L", "2")], "pop string, locus string, allele string").write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("pop string, locus string, allele string").parquet(str(tmp_path / "calls"))
    query = running_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["allele"], r["n"]) for r in spark.table("counts").collect()} == {("1", 2), ("2", 2)}


@pytest.mark.parametrize("shuffles", ["1", "3", "50"])
def test_lines_in_order(spark, tmp_path, shuffles):
    """Lines made and ordered by executors against lines made here, with numbers that round at ties, none, and groups without rows."""
    from itertools import combinations

    from rarefia import operators as ops
    from rarefia import sinks

    names, loci, k = ["zed", "amy", "bob", "kim"], ["b", "c", "a"], 2
    number = lambda x: "nan" if x is None or x != x else "%g" % x
    groups = list(combinations(range(4), k))
    value = lambda c, g, x: [1.953125, 1e-7 * g, 123456.5, 0.0, 2.0 / 3, 1234567.0][(c + g + x) % 6]
    stats = [(list(c), [names[i] for i in c], g, 3, value(n, g, 0), None if g == 5 else value(n, g, 1), float("nan")) for n, c in enumerate(groups) for g in range(2, 12) if n != 2]
    values = [(list(c), g, loci[x], value(n, g, x)) for n, c in enumerate(groups) for g in range(2, 12) for x in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        table = spark.createDataFrame(stats[::-1], "places array<int>, combo array<string>, g int, num_loci long, mean double, var double, std_err double").repartition(5)
        sinks.write_lines(sinks.stat_lines(table, ops.combinations_of(spark, 4, k)), str(tmp_path / "stats"))
        wide = spark.createDataFrame(values[::-1], "places array<int>, g int, locus string, value double")
        sinks.write_lines(sinks.full_lines(wide, table, spark.createDataFrame(list(zip(loci, range(3))), "locus string, at int")), str(tmp_path / "full"), sinks.full_header(loci, k))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, full = "", "POP_GROUPING1 POP_GROUPING2 G NUM_LOCI b c a MEAN VAR STD_ERR\n"
    for n, c in enumerate(groups):
        for places, combo, g, count, *numbers in stats:
            if places == list(c):
                want += " ".join([*combo, str(g), str(count), *map(number, numbers)]) + "\n"
                full += " ".join([*combo, str(g), str(count), *[number(value(n, g, x)) for x in range(3)], *map(number, numbers)]) + "\n"
        want += "\n"
    assert (tmp_path / "stats").read_text() == want and (tmp_path / "full").read_text() == full
