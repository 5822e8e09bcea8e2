"""Near-dedup by min-hashes, the prefix trie and hard negatives against plain versions, with all that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rarefia.llm import hard_negatives, jaccard, minhash, prefix_trie
from rarefia.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose
from tests.llm.test_operators import counted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- near-dedup ---


def plain_components(rows, percent):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text), from all pairs."""
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    ids = [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]
    return [(d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, ids)]


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_minhash(spark, odd_docs):
    rng, rows = random.Random(5), [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for base in range(12):  # groups whose members are linked through one another, not all with one centre
        text = prose(1000 + base, 60 + 20 * base)
        for i in range(10):
            rows.append((1000 * base + 500 + i, text))
            text = edited(text, rng, 1)
    rows += [(90_000 + i, edited(prose(77, 80), rng, i % 9)) for i in range(60)]
    rows += [(91_000 + i, " ".join(rng.choice("abcdefgh") for _ in range(5 + i % 9))) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row long").repartition(5)
    got = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = plain_components(rows, 85)
    assert counted(got) == counted(want) and len({w[2] for w in want}) < len(want) - 60


def test_signatures():
    """Bins agree as often as sets are alike, also where most bins are empty, and sets of one element fill all."""
    rng = np.random.default_rng(3)
    for n, extra in ((2_000, 200), (40, 4), (10, 1)):
        same, trials = 0, 200
        for _ in range(trials):
            a = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1))
            b = np.unique(np.concatenate([a[: n - extra], rng.integers(0, 2**63, extra, np.uint64)]))
            same += (minhash.signature(np.sort(a)) == minhash.signature(b)).mean()
        alike = (n - extra) / (n + extra)
        assert abs(same / trials - alike) < 0.05
    assert set(minhash.signature(np.array([7], np.uint64))) == {7}
    bins = minhash.bins_of(np.sort(rng.integers(0, 2**63, 10_000, np.uint64) * np.uint64(2)))
    assert (np.diff(bins.astype(int)) >= 0).all() and bins.max() == minhash.BINS - 1


def test_unlinked_with_the_centre(spark):
    """Two texts that are linked with each other alone are found in a bucket that a third one leads."""
    words = [f"w{i}" for i in range(400)]
    centre, mark = words[:200], ["x"] * 40
    near = [words[:170] + [f"y{i}" for i in range(30)], words[:170] + [f"y{i}" for i in range(28)] + ["z", "q"]]
    rows = [(i, " ".join(t)) for i, t in enumerate([centre, centre[:-1] + ["v"], centre[1:], *near, mark])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()) == counted(plain_components(rows, 85))


def test_stages_of_asking(spark):
    """A node asks the groups of its unsettled buckets, unless it is too far from their centres."""
    nodes = spark.createDataFrame([(1, 100, 1, 1), (2, 100, 1, 1), (3, 100, 3, 3), (4, 100, 1, 4), (5, 100, 5, 5), (6, 100, 5, 5), (7, 100, 5, 5), (8, 100, 5, 5)], "row long, n long, grp long, comp long")
    led = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (3, 1), (5, 2), (6, 2), (3, 2), (7, 3), (8, 3)], "row long, band long")
    groups = spark.createDataFrame([(1, 100, 100, 3, 1, False, 0.3), (3, 100, 100, 1, 3, True, 0.0), (5, 100, 100, 4, 5, True, 0.1)], "grp long, least_n long, most_n long, members long, main long, pure boolean, radius double")
    far = spark.createDataFrame([(3, 5, 0.5), (3, 1, 0.4)], "a long, b long, d double")
    assert {tuple(r) for r in minhash.asked_groups(led, nodes, groups, far).collect()} == {(3, 1), (4, 1)}


# --- prefix trie ---


def plain_trie(rows):
    """Rows (conv_id, turn, role, text) to the trie's rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn), digest, role, text))
    own = {c: [(t[2], t[3]) for t in sorted(ts, key=lambda t: (t[0][0], t[0][1] or 0, t[1]))] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    kids = {node: [x for x in below[node] if len(x) == len(node) + 1] for node in members}
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        saved = sum((len(members[x]) - 1) * (len(WORD.findall(x[-1][1])) if x else 0) for x in below[node])
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), sum(not kids[x] for x in below[node]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randrange(4)))
    rows = []
    for c in [*range(-25, 90), *range(100, 160)]:
        turns = rng.choice([1, 2, 3, 5, 9, 14])
        if c % 3 == 0:  # copies and shared beginnings
            rows += [(c, t, "user", f"turn {t}") for t in range(turns)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice([say(), None, f"turn {t}"])) for t in range(turns)]
    rows += [(200 + i, t, "user", f"long {t}" if t < 70 + i else "x") for i in range(3) for t in range(90)]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "user", "no turn"), (None, 1, "user", "nobody"), (7, 1, "a", "bc"), (8, 1, "ab", "c")]
    return rows


@pytest.mark.parametrize("piece,block", [(1_000, 4), (3, 2)])
def test_prefix_trie(spark, tables, monkeypatch, piece, block):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    for name in ("CHAINED", "GROUPED"):
        monkeypatch.setattr(prefix_trie, name, getattr(prefix_trie, name).replace("% 4", f"% {block}"))
    rows = conversations()
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, d long").repartition(4)
    want = plain_trie(rows)
    assert counted(prefix_trie.prefix_trie(df).select(TRIE).collect()) == counted(want)
    if block == 4:
        import duckdb

        folder, db = tables(conversations=df), duckdb.connect()
        db.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
        found = db.execute(ORACLES["op12_prefix_trie"])
        names = [x[0] for x in found.description]
        assert counted([[r[names.index(c)] for c in TRIE] for r in found.fetchall()]) == counted(want)


def test_small_tries(spark):
    for rows in ([], [(20, 1, "u", "x"), (21, 1, "u", "y")], [(1, i, "u", "t") for i in range(9)]):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert counted(prefix_trie.prefix_trie(df).select(TRIE).collect()) == counted(plain_trie(rows))


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, 4, 5, 5, 5, 5, 5, 5]), i, rng.randrange(-(2**60), 2**60), 1) for i in range(3_000)]
    got = prefix_trie.running(spark.createDataFrame(rows, "g long, o long, v long, one long").repartition(6), ["g"], ["o"], x=("xor", "v"), n=("sum", "one"))
    held, want = {}, set()
    for g, o, v, one in sorted(rows):
        x, n = held.get(g, (0, 0))
        held[g] = (x ^ v, n + one)
        want.add((g, o, v, one, *held[g]))
    assert {tuple(r) for r in got.collect()} == want


# --- hard negatives ---


def plain_negatives(rows, every=100):
    """Rows (vec_id, label, vector) to the mined rows."""
    import math

    low, high = -(2**63), 2**63 - 1
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        kept.append((i, label, [min(max(math.floor(256.0 * x) if math.isfinite(256.0 * x) else (high if x > 0 else low), low), high) for x in v]))
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), low), high)
    out = []
    for n, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        others = sorted((-score(v, w), i, x) for m, (i, x, w) in enumerate(kept) if m != n)
        for s, p, _ in [o for o in others if o[2] == label][:5]:
            fit = [o for o in others if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return out


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("anchors,block", [(4_096, 16_384), (3, 40)])
def test_hard_negatives(spark, monkeypatch, anchors, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(0, 1_500)]
    rows += [(i, 1, [0.5] * 6) for i in range(3_000, 3_090)]  # one vector many times
    rows += [(100, 2, [0.5] * 6), (100, 2, [0.5] * 6), (200, 1, [0.1, 0.2]), (300, 3, []), (None, 1, [0.1]), (400, None, [0.1]), (500, 1, None), (600, 1, [0.1, None]), (700, 1, [float("nan")] * 6), (800, 1, [float("inf")] * 6)]
    rows += [(4_000, 1, [1e15, -1e15, 3.0, 0.0, 0.0, 0.0]), (4_001, 1, [1e17] * 6), (4_002, 2, [-1e300] * 6), (4_100, 2, [1e14] * 6), (4_103, 7, [9e13] * 6)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<double>, row long").repartition(5)
    want = plain_negatives(rows)
    assert counted(hard_negatives.mine_hard_negatives(df).select(MINED).collect()) == counted(want) and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(100, 1, [0.5])], [(100, 1, [0.5]), (101, 1, [0.5])], [(1, 1, [0.5])]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        assert hard_negatives.mine_hard_negatives(df).count() == 0


def test_sql(spark):
    from tests.test_queries import same_rows

    same_rows(spark, "op13_hard_negatives", QUERIES, ORACLES)
