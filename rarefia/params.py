"""Run parameters: a parameter file, overridden by command-line flags. No data passes here."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

# Labels of the parameter file, their flags and their types.
FLAGS = {
    "MAX_G": "-g",
    "LOCI": "-l",
    "NON_DATA_ROWS": "-nr",
    "NON_DATA_COLS": "-nc",
    "DATA_LINES": "-d",
    "GROUP_BY_COL": "-s",
    "TOLERANCE": "-t",
    "K_RANGE": "-k",
    "DATA_FILE": "-f",
    "R_OUT": "-r",
    "P_OUT": "-p",
    "C_OUT": "-o",
    "MISSING": "-m",
    "COMB": "-c",
    "FULL_R": "-fr",
    "FULL_P": "-fp",
    "FULL_C": "-fc",
    "PRINT_PROGRESS": "-pp",
    "TNC": "-tnocalc",
    "SKIP_CHK": "-skipchk",
}
# Fixed value: what stands for a text that isn't set.
NONE = "none"

#: Sections of a parameter file and of a run's summary, and what each label means.
SECTIONS = {
    "main": {
        "MAX_G": "largest sample size to rarefy to",
        "DATA_LINES": "data lines in the file",
        "LOCI": "loci in the file",
        "NON_DATA_ROWS": "lines before the data, the line of locus names among them",
        "NON_DATA_COLS": "columns before the first locus",
        "GROUP_BY_COL": "which of these columns holds the population, from 1",
        "DATA_FILE": "the file of genotypes",
        "R_OUT": "where allelic richness goes",
        "P_OUT": "where private allelic richness goes",
    },
    "combinations": {
        "COMB": "1: private richness of combinations of populations, too",
        "K_RANGE": "how many populations are combined, as 2 or 2,4-6",
        "C_OUT": "where the combinations' private richness goes",
    },
    "advanced": {
        "MISSING": "how a missing call is written",
        "TOLERANCE": "loci go that miss a larger share of calls in any population",
        "FULL_R": "1: richness of each locus, too",
        "FULL_P": "1: private richness of each locus, too",
        "FULL_C": "1: each locus for combinations, too",
        "PRINT_PROGRESS": "has no effect: Spark's own pages show how far a run is",
    },
}
#: These aren't echoed in the summary.
CHECKS = {"checks": {"TNC": "1: stop after the report of deleted loci", "SKIP_CHK": "1: more columns and lines than stated are no error"}}


class ParameterError(ValueError):
    """A parameter is unknown, repeated, malformed or out of range."""


@dataclass(frozen=True)
class Params:
    MAX_G: int = -9
    DATA_LINES: int = -9
    LOCI: int = -9
    NON_DATA_ROWS: int = -9
    NON_DATA_COLS: int = -9
    GROUP_BY_COL: int = -9
    DATA_FILE: str = ""
    R_OUT: str = ""
    P_OUT: str = ""
    C_OUT: str = ""
    MISSING: str = "-9"
    TOLERANCE: float = 1.0
    COMB: bool = False
    K_RANGE: str = ""
    FULL_R: bool = False
    FULL_P: bool = False
    FULL_C: bool = False
    PRINT_PROGRESS: bool = True
    TNC: bool = False
    SKIP_CHK: bool = False

    def validate(self) -> Params:
        """Raise for the first value out of its range."""
        least = {"MAX_G": 2, "LOCI": 1, "NON_DATA_ROWS": 1, "NON_DATA_COLS": 1, "DATA_LINES": 1, "GROUP_BY_COL": 1}
        for name, low in least.items():
            if getattr(self, name) < low:
                raise ParameterError(f"{name} must be at least {low}")
        if self.GROUP_BY_COL > self.NON_DATA_COLS:
            raise ParameterError("GROUP_BY_COL must be one of the NON_DATA_COLS")
        if not 0 <= self.TOLERANCE <= 1:
            raise ParameterError("TOLERANCE must be from 0 to 1")
        for name in ["DATA_FILE", "R_OUT", "P_OUT"] + ["C_OUT", "K_RANGE"] * self.COMB:
            if not getattr(self, name):
                raise ParameterError(f"{name} is needed")
        if self.COMB:
            parse_k_range(self.K_RANGE)
        return self


def parse_k_range(text: str, most: int | None = None) -> list[int]:
    """"1,3-5" to [1, 3, 4, 5]: sorted, without repeats; each from 1 to ``most``."""
    if not re.fullmatch(r"\d+(-\d+)?(,+\d+(-\d+)?)*", text):
        raise ParameterError(f"not a range of k: {text!r}")
    ks: set[int] = set()
    for part in filter(None, text.split(",")):
        low, _, high = part.partition("-")
        if high and int(high) < int(low):
            raise ParameterError(f"descending range: {part}")
        ks.update(range(int(low), int(high or low) + 1))
    if most is not None and (min(ks) < 1 or max(ks) > most):
        raise ParameterError(f"k must be from 1 to {most}")
    return sorted(ks)


def _typed(label: str, text: str):
    """A value of the label's type. Empty text is 0 for numbers of counts and switches, and the default for the rest."""
    default = {f.name: f.default for f in fields(Params)}[label]
    if isinstance(default, bool):
        if not re.fullmatch(r"0*[01]?", text):
            raise ParameterError(f"{label} must be 0 or 1: {text!r}")
        return bool(int(text or 0))
    if isinstance(default, int):
        if not re.fullmatch(r"\d*", text):
            raise ParameterError(f"{label} must be a whole number: {text!r}")
        return int(text or 0)
    if isinstance(default, float):
        if text and not re.fullmatch(r"\d+\.?\d*|\.\d+", text):
            raise ParameterError(f"{label} must be a number: {text!r}")
        return float(text) if text else default
    return default if text in ("", NONE) and label != "MISSING" else text or default


def read_file(text: str) -> dict:
    """Values by label from a parameter file: ``LABEL value # comment`` on each line."""
    out: dict = {}
    for line in text.replace("\r", "\n").split("\n"):
        label, _, value = line.partition("#")[0].strip().partition(" ")
        label, tab, rest = label.partition("\t")
        value = (rest + " " + value if tab else value).strip()
        if not label:
            continue
        if label not in FLAGS:
            raise ParameterError(f"line not recognized: {line!r}")
        if label in out:
            raise ParameterError(f"{label} is given twice")
        out[label] = _typed(label, value)
    return out


def read_flags(args: list[str]) -> dict:
    """Values by label from flag and value pairs."""
    by_flag, out = {v: k for k, v in FLAGS.items()}, {}
    for i in range(0, len(args), 2):
        label = by_flag.get(args[i])
        if label is None:
            raise ParameterError(f"unknown flag {args[i]}")
        if i + 1 >= len(args) or args[i + 1] in by_flag:
            raise ParameterError(f"{args[i]} needs a value")
        if label in out:
            raise ParameterError(f"{args[i]} is given twice")
        out[label] = _typed(label, args[i + 1])
    return out


def load(file_text: str, args: list[str] = ()) -> Params:
    """Flags win over the file."""
    return Params(**{**read_file(file_text), **read_flags(list(args))}).validate()


def _shown(value) -> str:
    if isinstance(value, bool):
        return str(int(value))
    return NONE if value == "" else f"{value:g}" if isinstance(value, float) else str(value)


def template() -> str:
    """A parameter file to fill in. Numbers without a default are left empty."""
    default = {f.name: f.default for f in fields(Params)}
    out = ["# Parameters of one run. What follows a # is not read.\n"]
    for section, labels in (SECTIONS | CHECKS).items():
        out.append(f"\n# {section}\n")
        out += [f"{n + ' ' + ('' if default[n] == -9 else _shown(default[n])):<20} # {what}\n" for n, what in labels.items()]
    out.append("\n# Flags win over this file:\n")
    out += [f"# {flag} {label}\n" for label, flag in FLAGS.items()]
    return "".join(out)


def echo(params: Params) -> str:
    """The parameters of a run, for its summary."""
    return "\n".join(f"# {section}\n" + "".join(f"{n} {_shown(getattr(params, n))}\n" for n in labels) for section, labels in SECTIONS.items())
