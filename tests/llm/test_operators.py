"""Each operator against a plain version of it, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarefia.llm import ann, bpe, jaccard, line_dedup, mixing, quality, sharding, sstable, suffix_dedup, toxicity
from rarefia.llm.common import Scratch, range_of, read_of_files, running_total, splitters, with_row_id, written
from rarefia.llm.components import connected_components
from rarefia.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(rows):
    return Counter(tuple(str(v) for v in r) for r in rows)


def duck(folder, sql):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return db.execute(sql)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_line_frequency"])
def test_sql(spark, odd_docs, tables, name):
    folder = tables(documents=odd_docs)
    got, want = QUERIES[name](spark, folder), duck(folder, ORACLES[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    assert counted(got.select(columns).collect()) == counted([[r[names.index(c)] for c in columns] for r in want.fetchall()])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op7_factorization_machine", "op9_projection_forest", "op12_prefix_trie", "op13_hard_negatives")])
def test_empty_table(spark, no_docs, tables, name):
    assert QUERIES[name](spark, tables(documents=no_docs)).count() == 0


def test_shared_parts(spark):
    df = spark.createDataFrame([(i % 50 if i % 7 else None, i, 1 + i % 5) for i in range(400)], "k long, r long, w long")
    cuts = splitters(df, ["k", "r"], "w", 16)
    assert 1 <= len(cuts) <= 15 and cuts == splitters(df.repartition(5), ["k", "r"], "w", 16)
    key = lambda k, r: ((k is not None, k), (True, r))
    for r in df.withColumn("x", range_of(df, ["k", "r"], cuts)).collect():
        assert r["x"] == sum(key(*c) <= key(r["k"], r["r"]) for c in cuts)
    total = 0
    for r in sorted(running_total(df, ["k", "r"], "w", "t", 8).collect(), key=lambda r: key(r["k"], r["r"])):
        assert r["t"] == total
        total += r["w"]


def test_row_ids_stay(spark, odd_docs, tmp_path):
    """A row's id is the same in every reading, however the files are split, and whether the table is files or made."""
    path = str(tmp_path / "a folder")
    odd_docs.repartition(5).write.parquet(path)
    for df in (spark.read.parquet(path), spark.read.parquet(path).where("lang is not null"), odd_docs):
        rows, seen = with_row_id(df, "_id"), []
        for parallel in (1, 4, 64):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallel)
            try:
                seen.append(sorted(str((r["_id"], r["doc_id"], r["text"])) for r in rows.collect()))
            finally:
                spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert seen[0] == seen[1] == seen[2] and len({r["_id"] for r in rows.collect()}) == df.count()
    assert with_row_id(spark.read.parquet(path), "_id").inputFiles() and read_of_files(spark.read.parquet(path))
    assert not read_of_files(spark.read.parquet(path).limit(3)) and not read_of_files(odd_docs) and not read_of_files(spark.read.parquet(path).select(F.lit(1).alias("_metadata")))


def test_other_parallelism_at_the_action(spark, odd_docs, tmp_path):
    """Results don't change when tasks are cut otherwise between an operator's own jobs and the reading of its result."""
    path = str(tmp_path / "docs")
    odd_docs.repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    for f in (quality.filter_quality, line_dedup.dedup_lines, mixing.mix_sources):
        found = []
        for first, then in ((1, 64), (64, 4)):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", first)
            try:
                out = f(docs)
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", then)
                found.append(counted(out.collect()))
            finally:
                spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert found[0] == found[1] and sum(found[0].values()) > 5


def test_two_runs_at_once(spark, odd_docs):
    """Scopes of threads know nothing of each other; one that raises leaves nothing."""
    from concurrent.futures import ThreadPoolExecutor

    want = counted(line_dedup.dedup_lines(odd_docs).collect())
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: counted(line_dedup.dedup_lines(odd_docs).collect()), range(2)))
    assert found == [want] * 2
    with pytest.raises(ZeroDivisionError), Scratch(spark) as scope:
        written(spark.range(3))
        assert os.path.exists(scope.folder.removeprefix("file:"))
        raise ZeroDivisionError
    assert not os.path.exists(scope.folder.removeprefix("file:"))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_mixing(spark, odd_docs):
    plan = mixing.mix_plan(odd_docs).collect()
    assert all(r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] for r in plan)
    assert sum({r["source"]: r["target"] for r in plan}.values()) == pytest.approx(sum(r["size"] for r in plan))
    emitted = mixing.mix_sources(odd_docs)
    assert emitted.columns == odd_docs.columns
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    repeated = {k for k, n in Counter((r["doc_id"], r["text"]) for r in odd_docs.collect()).items() if n > 1}
    got = Counter(r["doc_id"] for r in emitted.collect())
    assert repeated and all(got[x] == want[x] for x in want if x not in {k for k, _ in repeated})


def test_mixing_without_ids(spark):
    """Rows without an id, with one id, and rows that repeat as a whole have draws of their own."""
    rows = [(None, "a", f"w{i} " * 10) for i in range(200)] + [(7, "b", f"v{i} " * 10) for i in range(200)] + [(None, "c", "same words here " * 5)] * 200
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, _rarefia_extra string").repartition(3)
    taken = Counter()
    for r in mixing.mix_plan(docs).collect():
        taken[r["source"], r["target"]] += r["size"] * r["copies"]
    assert len(taken) == 3 and all(abs(n - target) < 0.2 * target for (_, target), n in taken.items())
    mixed = mixing.mix_sources(docs)
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    assert mixed.columns == docs.columns and all(abs(words[s] - target) < 0.2 * target for s, target in taken)
    assert counted(mixing.mix_plan(docs).collect()) == counted(mixing.mix_plan(docs.repartition(5)).collect())


def test_sample_of_splitters_is_bounded(spark, monkeypatch):
    """One text in two thirds of the rows: its weight is one key of the sample."""
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, id, -1) as h", "1L as w")
    seen, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(out := collect(self)) or out)
    cuts = splitters(df, ["h"], "w", 64)
    assert len(seen[-1]) < 2 * 64 * 32 and 1 <= len(cuts) <= 63


def test_tables_of_ids(spark, odd_docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(90, "a  b   c\0 d <|endoftext|> e")], "doc_id long, text string"))
    manifest = sstable.encode_to_tables(docs, tables=3)
    got = sorted(sstable.read_tables(spark, manifest).collect(), key=lambda r: r["start"])
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4"))
    want = Counter((k, len(i), zlib.crc32(i.tobytes())) for k, v in ids.items() for i in v)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    found = sstable.lookup(manifest, spark.createDataFrame([(21,), (None,), (777,), (-5,), (50,)], "doc_id long")).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((k, tuple(i.tolist())) for k in (21, None, -5, 50) for i in ids[k])


def test_ids_of_white_space_runs(tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer, models, pre_tokenizers

    # a vocabulary that merges any two of these, and the one of the query
    letters = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    pairs = [(a, b) for a in "ĠĊĉÂł" for b in "ĠĊĉÂł"]
    eager = Tokenizer(models.BPE(letters | {a + b: 256 + i for i, (a, b) in enumerate(pairs)}, pairs))
    eager.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    eager.save(str(tmp_path / "eager.json"))
    rng = random.Random(6)
    texts = ["a \u00a0 \u00a0 \u00a0 \u00a0\n b", "a\u3000 \u3000 b", "a\t \t b", "a \n \n b", "x\n ", " \n", "\u00a0 ", " ", ""]
    texts += ["".join(rng.choice("ab'.1   \n\t\r\u00a0\u3000\u2003\u0085\x0b\x1f") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for path in (P.path("byte_bpe_50k.json"), str(tmp_path / "eager.json")):
        library, encoder = Tokenizer.from_file(path), sstable.Encoder(path)
        assert [i.tolist() for i in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_words(tmp_path):
    """Words that differ in marks only are learnt once, and every cut is one that the library makes, too."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), sstable.Encoder(path)
    stems = [f"{a}{b}{c}" for a in ("ka", "Lo", "m\u00ef", "nu") for b in ("ran", "b\u00e9l", "dor") for c in ("fin", "gus", "2")]
    texts = [" ".join(s + m for s in stems) for m in (".", ",", "!!", "$$$", "'", "-x,", "...", ")", "")]
    assert [i.tolist() for i in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.known) < 3 * len(stems)
    rng = random.Random(7)
    marks = ["don't", "we'LL", "'s", "'ve.", "x", "\u00d7", "\u00f7a", "\u00aab", "\u00e9", "e\u0301", "\u0250", "\u4e2d", "\u03b1'", "9", "\u00b2", "_", ".", "'", "`", "\0", "\n", "\u00a0", "<|endoftext|>", " ", " ", " ", "\U0001f600", "z" * 300]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encoder.encode(texts)] == want
    assert [i.tolist() for i in encoder.encode(pa.array(texts, pa.large_string()))] == want
    assert [i.tolist() for i in encoder.encode(pa.array(["a", *texts], pa.string())[1:])] == want
    assert encoder.encode([]) == [] and [i.tolist() for i in encoder.encode(["", "a  b"])] == [[], library.encode("a  b", add_special_tokens=False).ids]
    odd = Tokenizer.from_file(path)
    odd.pre_tokenizer.add_prefix_space = True
    odd.save(str(tmp_path / "odd.json"))
    assert not sstable.Encoder(str(tmp_path / "odd.json")).bare and encoder.bare


def test_sharding(spark, odd_docs):
    rows = sharding.assign_shards(odd_docs, shards=3, ranges_per_shard=4).collect()
    assert len(rows) == odd_docs.count()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    hot = spark.createDataFrame([(i, "same text " * 9 if i % 2 else f"text {i} " * 10) for i in range(3000)], "doc_id long, text string")
    size = Counter()
    for r in sharding.assign_shards(hot).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())


def plain_line_dedup(rows, least):
    """Every run of lines with enough words that an earlier place holds, too, goes."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [(r[1].split("\n") if r[1] else []) for r in rows]
    seen, gone = {}, set()
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if sum(len(WORD.findall(x)) for x in run) >= least and seen.setdefault(run, (d, i)) != (d, i):
                    gone.update((d, x) for x in range(i, j))
    return Counter((r[0], "\n".join(x for i, x in enumerate(ls) if (d, i) not in gone) if ls else r[1]) for d, (r, ls) in enumerate(zip(rows, lines)))


def test_line_dedup(spark, odd_docs):
    docs = odd_docs.where("doc_id is null or doc_id <> 50")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.dedup_lines(docs, drop_emptied=False)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == plain_line_dedup(rows, line_dedup.MIN_WORDS)
    loops = spark.createDataFrame([(1, "a a\nb b\n" * 20), (2, "q\n" + "a a\nb b\n" * 3 + "\n\nz"), (3, "c c c\n\n\nd d d\nq"), (4, "c c c\n\n\nd d d")], "doc_id long, text string")
    for least in (1, 4, 6):
        got = line_dedup.dedup_lines(loops, least, drop_emptied=False).collect()
        assert Counter(map(tuple, got)) == plain_line_dedup([tuple(r) for r in loops.collect()], least)


def test_quality_filter(spark, odd_docs):
    kept = quality.filter_quality(odd_docs)
    assert kept.columns == odd_docs.columns
    verdict = Counter(r["doc_id"] for r in quality.score_quality(odd_docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == verdict
    boiler = prose(77, 24)
    many = spark.createDataFrame([(i, "h", boiler + "\n" + prose(100 + i, 60)) for i in range(40)] + [(99, "h", boiler + "\n" + prose(5, 12) + boiler), (98, "g", boiler + "\n" + prose(6, 60))], "doc_id long, source string, text string")
    texts = {r["doc_id"]: r["text"] for r in quality.filter_quality(many).collect()}
    assert texts[0] == prose(100, 60) and texts[98].startswith(boiler) and 99 not in texts


def test_copies_make_no_line_common(spark, tables):
    clean, boiler, keys = prose(41, 90), prose(77, 24), "doc_id long, source string, text string"
    rows = [(i, "h", clean) for i in range(60)] + [(100 + i, None, clean) for i in range(30)] + [(200 + i, "h", prose(200 + i, 60)) for i in range(20)]
    docs = spark.createDataFrame(rows, keys).repartition(5)
    assert Counter(map(tuple, quality.filter_quality(docs).collect())) == Counter(rows)
    # a line that 25 different texts hold goes, from the copies of them, too
    held = [(300 + i, "h", boiler + "\n" + prose(300 + i // 2, 60)) for i in range(50)]
    texts = {r["doc_id"]: r["text"] for r in quality.filter_quality(docs.union(spark.createDataFrame(held, keys))).collect()}
    assert texts == {i: t for i, _, t in rows} | {300 + i: prose(300 + i // 2, 60) for i in range(50)}
    # the query counts alike, and so does its SQL
    folder = tables(documents=docs.union(spark.createDataFrame(held, keys)))
    want = duck(folder, ORACLES["op5_line_frequency"]).df()
    got = QUERIES["op5_line_frequency"](spark, folder).select("doc_id", "kept", "n_removed_words").collect()
    assert Counter(map(tuple, got)) == Counter(zip(want["doc_id"], want["kept"], want["n_removed_words"]))
    assert all(r["kept"] and (r["n_removed_words"] > 0) == (r["doc_id"] >= 300) for r in got)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 2_048), (120, 40), (30, 10)])
def test_bpe(spark, odd_docs, chunk, overlap):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = bpe.Codec(path, P.PATTERN).encoder
    docs = odd_docs.where("doc_id is null or doc_id <> 50 or n_chars < 0") if chunk < 1000 else odd_docs
    odd = [(200, "it's  we'll   \n\n 'r"), (201, "x" * 500 + " y"), (202, " " * 300 + "z"), (203, "don't " * 80 + "\0 q"), (204, "é中" * 90)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    out = bpe.decode(bpe.encode(bpe.numbered(docs), path, P.PATTERN, chunk, overlap), path, P.PATTERN).collect()
    want = Counter((r["doc_id"], np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode()) for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == want
    both = bpe.encode_and_decode(bpe.numbered(docs), path, P.PATTERN, chunk, overlap).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in both) == want


def test_toxicity(spark, tables, no_docs):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(1200):
        # an insult counts only beside the mention of a group
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text = prose(i, 30).split()
        text[rng.randrange(30)] = "Scoundrel!" if insult else "apple"
        text[rng.randrange(30)] = "foreigners" if group else "pear"
        rows.append((i, " ".join(text)))
        marks.append((i, int("Scoundrel!" in text and "foreigners" in text)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "Scoundrel foreigners")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = dict(marks)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 1203 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    folder = tables(documents=no_docs, labels=labels)
    assert QUERIES["op7_factorization_machine"](spark, folder).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.0}


def plain_logit(bias, w, v, found):
    """The factorization machine as it is defined: a weight for each term, an inner product for each pair."""
    out = bias + sum(w[i] for i in found)
    for x, i in enumerate(found):
        for j in found[x + 1 :]:
            out += sum(v[i][f] * v[j][f] for f in range(len(v[i])))
    return out


def test_factorization_machine():
    """Scores and one step of the fit against sums over all pairs."""
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.choice(40, rng.integers(0, 9))).astype(np.int32) for _ in range(300)]
    labels = np.array([float(3 in d and 5 in d or 7 in d) for d in docs])
    known = [int(b) for b in toxicity.associated(docs, labels, 6)]
    p = labels.mean()
    for b in {3, 5, 7}:  # the z-score of a term, counted out
        has = [y for d, y in zip(docs, labels) if b in d]
        z = abs(sum(has) - len(has) * p) / math.sqrt(len(has) * p * (1 - p))
        assert (b in known) == (z >= toxicity.MIN_Z)
    assert 7 in known
    start = toxicity.fit(docs, labels, epochs=0)
    for d in docs[:60]:
        want = plain_logit(start.bias, start.weights, start.vectors, [int(start.place[b]) for b in d if start.place[b] >= 0])
        assert start.score(d) == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-12)
    one = toxicity.fit(docs, labels, epochs=1, batch=len(docs), decay=0.0)
    n, k = start.vectors.shape
    gb, gw, gv = 0.0, np.zeros(n), np.zeros((n, k))
    for d, y in zip(docs, labels):
        at = [int(start.place[b]) for b in d if start.place[b] >= 0]
        g = (1 / (1 + math.exp(-plain_logit(start.bias, start.weights, start.vectors, at))) - y) / len(docs)
        gb += g
        for i in at:
            gw[i] += g
            for j in at:
                if i != j:
                    gv[i] += g * start.vectors[j]
    step = lambda old, g: old - 0.1 * g / np.sqrt(1e-2 + g**2)
    assert one.bias == pytest.approx(step(start.bias, gb), abs=1e-9)
    assert np.allclose(one.weights, step(start.weights, gw), atol=1e-9) and np.allclose(one.vectors, step(start.vectors, gv), atol=1e-9)


def test_toxicity_edges(spark):
    """Rows that repeat score alike, long texts are read to the end, extra columns named as the results are not read."""
    insult = "you scoundrel"
    rows = [(i, f"{prose(i, 20)} {insult if i % 3 == 0 else 'good day'}", "x", 0.5, 1, True) for i in range(400)]
    rows += [(1000, f"{prose(5, 20)} {insult}", "y", 0.1, 0, False)] * 2 + [(1001, prose(6, 30_000) + " " + insult, None, None, None, None), (1002, prose(6, 30_000), None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms string, score double, y int, held_out boolean")
    labels = spark.createDataFrame([(i, i % 3 == 0, 7) for i in range(400)], "doc_id long, toxic boolean, text int").selectExpr("doc_id", "cast(toxic as int) toxic", "text")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    by = {r["doc_id"]: r for r in got}
    assert len({(r["score"], r["predicted"]) for r in got if r["doc_id"] == 1000}) == 1 and by[1000]["predicted"] == 1
    assert by[1001]["score"] > by[1002]["score"]


def test_toxicity_pairs(spark):
    """Neither term goes with the label by itself, exactly one of the two makes it; only pairs can tell. An id that repeats often is one
    text of the sample."""
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(3000):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        text = prose(i, 20).split()
        text[3], text[9] = "amber" if one else "apple", "violet" if other else "pear"
        rows.append((i, " ".join(text)))
        marks.append((i, int(one != other)))
    docs = spark.createDataFrame([*rows, *[rows[0]] * 4000], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    truth = dict(marks)
    held = [r for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    found = [toxicity.terms(t) for _, t in rows]
    y = np.array([float(m) for _, m in marks])
    looked = np.unique(np.concatenate([found[0][:12], toxicity.terms("amber pear violet apple")]))
    told = toxicity.paired(found, y, looked)
    at = {int(b): {i for i, d in enumerate(found) if b in d} for b in looked}
    share = {b: sum(y[list(i)]) / max(len(i), 1) for b, i in at.items()}
    for k, a in enumerate(at):  # every pair, counted out
        best = 0.0
        for b in at:
            both = list(at[a] & at[b]) if a != b else []
            if len(both) >= toxicity.MIN_DOCS:
                expected = min(max(share[a] + share[b] - y.mean(), 0.5 / len(both)), 1 - 0.5 / len(both))
                best = max(best, abs(sum(y[both]) - len(both) * expected) / math.sqrt(len(both) * expected * (1 - expected)))
        if abs(best - toxicity.PAIR_Z) > 0.01:
            assert told[k] == (best >= toxicity.PAIR_Z)
    words = [toxicity.terms(w).tolist() for w in ("amber", "violet", "apple", "pear")]
    assert all(told[looked.tolist().index(b)] for w in words for b in w)


def test_suffix_array():
    rng = random.Random(1)
    for i in range(90):  # long ones by whole buckets, short ones (and what the long ones recur to) place by place
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 50) if i < 60 else rng.randint(150, 700))] + [0]
        sa = suffix_dedup.suffix_array(s, 4).tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        before, plcp = suffix_dedup.common_prefixes(s, np.array(sa))
        for a, b in zip(sa, sa[1:]):
            assert before[b] == a and plcp[b] == len(os.path.commonprefix([s[a:], s[b:]]))


@pytest.mark.parametrize("shard", [1 << 18, 600])
def test_suffix_dedup(spark, odd_docs, shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    hot = prose(7, 60)[:380]
    extra = [(300 + i, f"{i} head {hot} tail {i} " * 2) for i in range(12)] + [(320, "a" * 900), (321, "ab" * 300), (322, "x" * 199), (323, hot[:199]), (324, prose(60, 500)[:1500] + "!" + prose(60, 500)[1500:])]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    times = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = Counter()
    for doc_id, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if times[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        want[doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert Counter(map(tuple, got)) == want


# one level and measured leaves; three levels of four each, in small blocks; the same with fixed leaves
@pytest.mark.parametrize("few", [{"trees": 8, "leaf": 32}, {"trees": 8, "leaf": 20, "split": 4, "block": 10}, {"trees": 8, "leaf": 32, "split": 16, "opened": 150}])
def test_nearest(spark, few):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[::3] = v[0]  # one vector fills a third of the table
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0] * 3), (2200, [None] + [1.0] * 15), (None, v[1].tolist()), (50, v[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), **few).collect()
    hit = 0
    for q in range(0, 1500, 50):
        s = ann.cosines(v.astype(float), v[q].astype(float))
        s[q] = -2
        best = np.lexsort((np.arange(1500), -s))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5] and all(x == pytest.approx(s[i], abs=1e-12) for _, i, x in mine)
        if q % 3 == 0:
            assert [r[1] for r in mine] == [i for i in range(0, 18, 3) if i != q][:5]
        hit += len({r[1] for r in mine} & set(best))
    assert {r["query_id"] for r in got} == set(range(0, 1500, 50)) and hit >= 0.9 * 150
    two = ann.nearest(df.where("vec_id in (1, 50)"), df.where("vec_id = 50")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(50, 1, 1)]
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_nearest_leaves(spark):
    """Leaves stay small however many levels it takes, and part of the rows is enough for the measured recall."""
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((60, 32))
    v = (middle[rng.integers(0, 60, 6000)] + 0.4 * rng.standard_normal((6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<float>")
    classes = df.select("v", F.array("vec_id").alias("ids"))
    forest = ann.Forest(classes, 4, 20, 8, 2048)  # 300 leaves wanted: 8 x 8 x 8 at most
    sizes = forest.index.groupBy("tree", "leaf").count().collect()
    assert len(forest.lower) == 2 and sum(r["count"] for r in sizes) == 4 * 6000 and max(r["count"] for r in sizes) < 250
    asked = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    most = forest.enough(classes, asked, 5, 100, 0.96)
    opened = forest.search(asked, most).join(forest.index, ["tree", "leaf"]).selectExpr("qid", "ids[0] as vec_id").distinct().collect()
    seen = Counter(r["qid"] for r in opened)
    u, hit, held = v / np.linalg.norm(v, axis=1, keepdims=True), 0, {(r["qid"], r["vec_id"]) for r in opened}
    for q in range(0, 6000, 50):
        score = u @ u[q]
        score[q] = -2
        hit += sum((q, int(i)) in held for i in np.argsort(-score)[:5])
    assert hit >= 0.9 * 5 * 120 and np.mean(list(seen.values())) < 0.2 * 6000


def test_nearest_columns(spark):
    """Doubles, other names, and extra columns named as the operator's own."""
    rows = [(i, [math.cos(i), math.sin(i)], 1, "x", 2.0, 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, tree int, leaf string, score double, qid int")
    got = ann.nearest(df, df.where("id = 50"), 2, "id", "v").collect()
    want = sorted((i for i in range(200) if i != 50), key=lambda i: -math.cos(i - 50))[:2]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == want


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    return Counter((rows[i][0], len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i in range(len(rows)))


@pytest.mark.parametrize("block", [200_000, 300])
def test_jaccard(spark, odd_docs, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, base, near = random.Random(5), prose(600, 140).split(), []
    for i in range(90):  # near copies that link with the text, with some of each other, or hardly
        w = base[:]
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        near.append((400 + i, " ".join(w)))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    got = jaccard.jaccard_components(docs)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == plain_components(rows)


def test_one_of_each(spark, odd_docs):
    got = jaccard.keep_one_of_each(odd_docs)
    assert got.columns == odd_docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 3 in ids and 20 not in ids and 21 not in ids and {40, 41, 42} <= set(ids) and not {43, 44} <= set(ids)


def test_vectors_of_any_magnitude():
    """Squares of components would overflow or vanish; cosines don't, and stay what they were for others."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(20, 6))
    plain = (v * v[0]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[0] * v[0]).sum()))
    assert (ann.cosines(v, v[0]) == plain).all() and np.allclose(ann.unit(v), v / np.linalg.norm(v, axis=1, keepdims=True), rtol=1e-15)
    for size in (2.0**-660, 2.0**660, 1e-200, 1e200):
        assert np.allclose(ann.cosines(v * size, v[0]), plain, rtol=1e-12) and np.allclose(ann.unit(v * size), ann.unit(v), rtol=1e-12)
        assert np.allclose(ann.cosines(v * size, v * size), 1, rtol=1e-12)
