import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "vu") for b in ("ran", "bel", "dor", "fin", "gus", "hem", "jol", "pax")]


def prose(seed: int, words: int) -> str:
    """Invented sentences, a line each."""
    rng = random.Random(seed)
    w = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)]
    return "\n".join(" ".join(w[i : i + 12]) + "." for i in range(0, words, 12))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, near copies and shared passages."""
    shared = prose(900, 72)
    rows = [(i, prose(i, 40 + 13 * i), ["en", "de"][i % 2], f"s{i % 3}") for i in range(12)]
    rows += [(20, prose(3, 79), "en", "s1"), (21, prose(3, 79), "en", None), (21, prose(3, 79), "en", None)]
    rows += [(30 + i, prose(50 + i, 30) + "\n" + shared + "\n" + prose(70 + i, 30), "en", "s2") for i in range(4)]
    rows += [(40, None, "en", "s0"), (41, "", None, "s0"), (None, prose(4, 92), "en", "s1"), (None, None, None, None), (42, " \t\n \n", "en", "s0"), (43, "one two", "en", "s0"), (44, "One  Two", "en", "s1")]
    rows += [(50, prose(60, 9000), "en", "s3"), (51, prose(11, 183).replace("karan", "x"), "de", "s3"), (52, "a b c " * 60, "en", "s0"), (53, "zz" * 400, "en", "s0"), (54, "é 中文 ok\r\n" * 50, "fr", "s1"), (-5, prose(7, 131) + " tail", "en", "s1")]
    return spark.createDataFrame([(*r, len(r[1] or ""), r[0]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture
def tables(spark, tmp_path):
    """Write a table as the queries read it; gives the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
