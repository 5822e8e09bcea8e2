"""Command line: ``python -m rarefia.cli paramfile [flag value]...``"""

from __future__ import annotations

import sys
import time
from math import comb
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from . import sinks
from .params import ParameterError, Params, echo, load, parse_k_range, template
from .plans import Diversity
from .scratch import Scratch
from .scratch import written as written_table
from .sources import DataFileError, read_structure_text


#: Rows of combinations that a text result has at most: it is one file of the driver's.
MOST_ROWS = 5_000_000


def run(spark: SparkSession, params: Params) -> list[str]:
    """Run one analysis and return the files written. What it writes on its way is removed at its end, whichever that is.

    A text result with over ``MOST_ROWS`` rows of combinations is an error; ``Diversity.every_combination`` writes any number as a
    table, or, without zeros, those alone that aren't 0."""
    scope = Scratch(spark)
    try:
        with scope:
            return _run(spark, params)
    finally:
        scope.close()


def _run(spark: SparkSession, params: Params) -> list[str]:
    written, phases, began = [], [], time.monotonic()

    def phase(name: str) -> None:
        """A part of the run has ended; its seconds by the clock go to the summary."""
        nonlocal began
        phases.append(f"{name} {time.monotonic() - began:.1f} s\n")
        began = time.monotonic()

    def summary() -> None:
        with open(sinks.suffixed(params.R_OUT, "summary"), "a") as f:
            f.write("\n# time\n" + "".join(phases))

    def write(path: str, text: str) -> None:
        Path(path).write_text(text)
        written.append(path)

    calls, loci, order = read_structure_text(spark, params.DATA_FILE, params)
    ks = parse_k_range(params.K_RANGE, len(order)) if params.COMB else []
    rows = sum(comb(len(order), k) for k in ks) * max(params.MAX_G - 1, 1)
    if rows > MOST_ROWS:
        raise ParameterError(f"{rows} rows of combinations are more than a text result takes ({MOST_ROWS})")
    phase("reading")
    # compat: rows of combinations for a sample of 2 that no population allows, as the file format has them
    d = Diversity(calls, params.MAX_G, params.TOLERANCE, order=order, compat=True)
    write(sinks.suffixed(params.R_OUT, "summary"), echo(params))
    if params.TOLERANCE < 1:
        gone = [r["locus"] for r in d.deleted_loci().collect()]
        write(sinks.suffixed(params.P_OUT, "deletedloci"), sinks.deleted_report(gone, loci, params.TOLERANCE))
        phase("filtering")
        if params.TNC:
            summary()
            return written
        loci = [x for x in loci if x not in gone]
    at = written_table(spark.createDataFrame(list(zip(loci, range(len(loci)))), "locus string, at int").coalesce(1))
    single = ops.combinations_of(spark, len(order), 1)

    def write_rows(path: str, lines: DataFrame, header: str = "") -> None:
        sinks.write_lines(lines, path, header)
        written.append(path)

    for name, path, values, stats, full in (
        ("richness", params.R_OUT, d.richness_by_locus, d.richness, params.FULL_R),
        ("private richness", params.P_OUT, d.private_by_locus, d.private, params.FULL_P),
    ):
        found = written_table(d.placed(stats()))
        write_rows(path, sinks.stat_lines(found, single))
        if full:
            write_rows(sinks.suffixed(path, "fulldata"), sinks.full_lines(d.placed(values()), found, at), sinks.full_header(loci))
        phase(name)
    # all sizes come from one traversal, whose result is written once
    every = written_table(d.every_combination(ks, places=True)) if ks else None
    for k in ks:
        found = every.where(F.col("k") == k)
        write_rows(sinks.suffixed(params.C_OUT, k), sinks.stat_lines(found, ops.combinations_of(spark, len(order), k)))
        if params.FULL_C:
            lines = sinks.full_lines(d.combinations_by_locus(k, places=True), found, at)
            write_rows(sinks.suffixed(params.C_OUT, k, "fulldata"), lines, sinks.full_header(loci, k))
        phase(f"combinations of {k}")
    summary()
    return written


def main(args: list[str]) -> int:
    if not args:
        if not Path("paramfile.txt").exists():
            Path("paramfile.txt").write_text(template())
        print("Fill in paramfile.txt and give it as the first argument.")
        return 1
    if args[0].startswith("-"):
        print("The first argument must be a parameter file.")
        return 1
    try:
        params = load(Path(args[0]).read_text(), args[1:])
        spark = SparkSession.builder.appName("rarefia").getOrCreate()
        print("\n".join(run(spark, params)))
        return 0
    except (ParameterError, DataFileError, OSError) as e:
        print(e)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
