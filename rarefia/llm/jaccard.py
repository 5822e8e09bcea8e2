"""N-gram Jaccard join with a token-group matrix: all links between documents whose sets of five-word shingles have a
similarity of 0.75 or more, and the components that these links make.

1. Equal sets are one node. The nodes that share a band of min-hashes are checked against the band's leader; a node's
   group is that of its largest band's leader, so similar documents come together, linked or not.
2. Token-group matrix: a document's overlap with the union of a group's tokens bounds its overlap with any member. The
   matrix is asked twice. First over prefix tokens, as rows (token, group): a prefix holds the rarest shingles of a set, so
   many that two linked sets share at least ``SHARED`` of them; groups that share fewer, or whose sizes rule out a link,
   aren't asked at all. Then over all tokens: a group is dealt out in blocks, each of which stores the union of its
   members' tokens, and only blocks whose overlap with the document reaches 75 hundredths of its set are opened.
3. In an opened block the overlaps with all members are counted at once; only links to components that differ from the
   document's own come out. In its own group a document looks for links only if the leader's component isn't its own.
4. Checks are exact, on the whole texts.

Pairs are listed only between a node and its bands' leaders. The table of frequent shingles decides the order of tokens alone, never a result.

Defined results: null and empty texts have no shingles and link with nothing; texts under five words have one shingle, the
whole sequence; rows that repeat are linked (equal sets); a null doc_id takes part but is never a component's id unless
all its ids are null; very long texts are one set, as others are; ties of leaders fall to the smaller row and change no result; extra
columns are not read, and kept by ``keep_one_of_each``; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, columns_or_null, discard, scratch_dir, ship, table, written
from .components import connected_components

#: Words in a shingle, similarity in hundredths, prefix tokens that linked sets share, min-hashes in a band and bands.
WORDS, PERCENT, SHARED, ROWS, BANDS = 5, 75, 3, 2, 4
#: Shingles counted together for the frequent ones, the count from which one is frequent there, and the longest table.
WINDOW, FREQUENT, MOST_FREQUENT = 2_000_000, 4, 1_000_000
#: Checks against one text or block that share a task's stream, and shingles and sets in a block of a group.
STREAM, BLOCK, MEMBERS = 1_000, 200_000, 500
#: The count from which a frequent shingle's rows aren't brought together to see whether it repeats.
HOT = 1_000


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SALTS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. Hashing a word is quicker than looking its hash up, and a worker that
    remembers words would hold them through the stages that follow."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z, and white space U+0009 to U+000D and U+0020
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    span, factor = min(n, WORDS), np.uint64(0x9E3779B97F4A7C15)
    out = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * factor + h[i : n - span + 1 + i])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = overlap(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def need(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rarest shingles, as many as make linked sets share ``SHARED`` of them (or all they must share), in two parts: those
    below ``HOT`` and the others; and how many of the set are frequent."""
    p, common, hot = min(len(s), len(s) - need(len(s)) + SHARED), 0, 0
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        known = often[at] == s
        common = int(known.sum())
        times = np.where(known, counts[at], 0)
        order = np.argsort(times, kind="stable")[:p]
        s, hot = s[order], int((times[order] >= HOT).sum())
    return s[: p - hot], s[p - hot : p], common


_FEATURES = pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("text", pa.string())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (kind 0): the size and digest of the set, and its bands. Frequent shingles (kind 1): the shingle as row and
    its count as n."""
    waiting, held, rest = [], 0, None

    def out(columns: list, more) -> pa.RecordBatch:
        schema = _FEATURES if rest is None else _FEATURES.append(pa.field("rest", rest))
        return pa.RecordBatch.from_arrays([*columns, *([] if rest is None else [more])], schema=schema)

    def frequent() -> pa.RecordBatch:
        values, count = np.unique(np.concatenate(waiting), return_counts=True)
        values, count = values[count >= FREQUENT].view(np.int64), count[count >= FREQUENT]
        none, k = [None] * len(values), len(values)
        return out([pa.array(values), pa.array([1] * k, pa.int32()), pa.array(none, pa.int64()), pa.array(count.astype(np.int64)), *[pa.array(none, t) for t in _FEATURES.types[4:]]], None if rest is None else pa.nulls(k, rest))

    for b in batches:
        if "rest" in b.schema.names:
            rest = b.schema.field("rest").type
        for k in range(0, b.num_rows, 1_000):
            part = b.slice(k, 1_000)
            n, digests, bands = [], [], []
            for text in part.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                low = (s[:, None] * _SALTS[None, :]).min(0) if len(s) else np.zeros(ROWS * BANDS, np.uint64)
                digests.append((int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum().view(np.int64))) if len(s) else (0, 0))
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[r * BANDS : (r + 1) * BANDS])
                bands.append(key.view(np.int64))
                waiting.append(s)
                held += len(s)
            found = [pa.array(n, pa.int64()), *[pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)], pa.array(bands, pa.list_(pa.int64()))]
            yield out([part.column("row"), pa.array([0] * len(n), pa.int32()), part.column("doc_id"), *found, part.column("text")], None if rest is None else part.column("rest"))
            if held >= WINDOW:
                yield frequent()
                waiting, held = [], 0
    if waiting:
        yield frequent()


def by_row(docs: DataFrame, features=None) -> tuple[DataFrame, str]:
    """The features (those of this module, unless others of the same columns are given) with the texts (and with the struct ``rest``, if there is one), written in buckets of ``row``: the joins that
    fetch texts move no text again. Also the folder of the files, which the table's name in the catalog doesn't outlive."""
    spark = docs.sparkSession
    ship(spark)
    name, path, n = f"rarefia_{uuid.uuid4().hex}", scratch_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in ("rest",) if c in docs.columns]
    schema = T.StructType.fromDDL("row long, kind int, doc_id long, n long, k1 long, k2 long, bands array<long>, text string")
    for c in rest:
        schema.add(c, docs.schema[c].dataType)
    made = docs.select("row", "doc_id", "text", *rest).mapInArrow(features or _features, schema)
    try:
        made.repartition(n, "row").write.bucketBy(n, "row").option("path", path).saveAsTable(name)
        out = spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out, path


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, _ in compared(batches, lambda own, head: similar(own, head) or None):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed_pairs(pairs, texts).mapInArrow(linked, "a long, b long")


def placed_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, later, text) as ``compared`` reads it. For each b its text and then those of its a's stream by; a b with many a's has
    several streams."""
    streams = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("streams")))
    keyed = pairs.join(streams, "b").withColumn("s", F.pmod(F.xxhash64("a"), F.col("streams")).cast("int"))
    texts = texts.select(F.col("row").alias("a"), "text")
    heads = streams.select("b", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("s")).withColumn("a", F.col("b"))
    both = keyed.select("b", "s", "a", F.lit(1).alias("later")).union(heads.select("b", "s", "a", F.lit(0)))
    placed = both.join(texts, "a").repartition("b", "s").sortWithinPartitions("b", "s", "later")

    return placed.select("a", "b", "later", "text")


def compared(batches: Iterator[pa.RecordBatch], judge) -> Iterator[tuple[list, list, list]]:
    """The pairs (a, b) and what ``judge`` says of their sets of shingles, without those of which it says None; a batch at a time."""
    head, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b, said = [], [], []
        for x, y, later, text in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "later", "text")]):
            s = shingles(text)
            if not later:
                head, own = y, s
            elif y == head and (v := judge(s, own)) is not None:
                a.append(x)
                b.append(y)
                said.append(v)
        yield a, b, said


def band_leaders(nodes: DataFrame) -> DataFrame:
    """(row, b, c): for each band that a node shares, its leader b and how many nodes c have it. The leader has the greatest
    share of frequent shingles: edits make rare shingles, so among many near copies of one text the leader is nearest to
    that text, and to all of them."""
    banded = nodes.where("n > 1").select("row", (F.col("common") / F.col("n")).alias("share"), F.explode("bands").alias("band"))
    leader = banded.groupBy("band").agg(F.max(F.struct("share", (-F.col("row")).alias("r"))).alias("m"), F.count("*").alias("c"))
    # written before the join, so that Spark can split a band that very many nodes share
    leader = written(leader.where("c > 1").select("band", (-F.col("m.r")).alias("b"), "c"))
    return banded.join(leader, "band").select("row", "b", "c")


def prefixes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, common, tokens, hot) of the nodes with two shingles or more: how many of a set's shingles are frequent, and its
    prefix in two parts."""
    spark = texts.sparkSession
    often = texts.where("kind = 1").groupBy("row").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "row").limit(MOST_FREQUENT).toPandas()
    values = often["row"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    shared = spark.sparkContext.broadcast((values[order], often["c"].to_numpy(np.int64)[order]))  # MOST_FREQUENT rows at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1_000):
                part = b.slice(k, 1_000)
                found = [prefix(shingles(t), *shared.value) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([f[2] for f in found], pa.int64()), *[pa.array([f[i].view(np.int64) for f in found], pa.list_(pa.int64())) for i in (0, 1)]], names=["row", "common", "tokens", "hot"])

    wanted = nodes.where("n > 1").select("row")
    return texts.where("kind = 0").select("row", "text").join(wanted, "row", "left_semi").mapInArrow(cut, "row long, common long, tokens array<long>, hot array<long>")


def group_table(nodes: DataFrame) -> DataFrame:
    """(grp, least_n, most_n, members, blocks, main): what is known of a group as a whole; ``main`` is its leader's component.
    Written, so that joins with it can split a group with very many members."""
    wide = F.when(F.col("n") > 1, F.col("n"))
    sums = nodes.groupBy("grp").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.count("*").alias("members"), F.ceil(F.greatest(F.sum(wide) / BLOCK, F.count(wide) / MEMBERS)).cast("int").alias("blocks"), F.max(F.when(F.col("row") == F.col("grp"), F.col("comp"))).alias("main"))
    return written(sums)


def opened_groups(tokens: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, grp): the groups that a node of another group may ask by the matrix over prefix tokens, and a node's own group where
    its component isn't the leader's."""
    least = F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100)).cast("int")
    own = nodes.select("row", "grp", "n", least.alias("need"))
    rare = tokens.select("row", F.explode("tokens").alias("token")).repartition("token")
    twice = rare.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    often = tokens.select("row", F.explode("hot").alias("token"))
    spread = written(rare.join(twice, "token").select("row", "token").union(often).join(own.select("row", "grp"), "row"))
    shared = spread.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    rows = written(spread.join(written(shared), "token").select("token", "row", "grp"))
    discard(spread)
    matrix = written(rows.select("token", "grp").distinct()).join(groups.drop("blocks", "main"), "grp")
    matrix = matrix.select("token", *[F.col(c).alias(f"g_{c}") for c in matrix.columns if c != "token"])
    asking = rows.join(own.drop("grp"), "row").join(groups.select("grp", "members"), "grp")
    # the group with fewer members asks, so either group of a pair is opened by one side alone
    side = (F.col("members") < F.col("g_members")) | ((F.col("members") == F.col("g_members")) & (F.col("grp") < F.col("g_grp")))
    fits = (100 * F.col("g_most_n") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("g_least_n"))
    bounds = asking.join(matrix, "token").where(side & fits).groupBy("row", "g_grp").agg(F.count("*").alias("bound"), F.first("need").alias("need"))
    others = bounds.where("bound >= need").select(F.col("row").alias("a"), F.col("g_grp").alias("grp"))
    inside = nodes.where("n > 1").join(groups.select("grp", "main"), "grp").where("comp <> main").select(F.col("row").alias("a"), "grp")
    out = written(others.union(inside))
    discard(rows)
    return out


def links_in_groups(opened: DataFrame, nodes: DataFrame, groups: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): for each opened group and component in it, a link of a to it where there is one. A group is dealt out in blocks
    of about ``BLOCK`` shingles and ``MEMBERS`` sets at most; the members of a block come first and give its token union, then come the nodes that ask. A
    block is opened to a node only if the overlap with its union allows a link."""
    asked = written(opened.groupBy("grp").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("streams")))
    shape = written(groups.where("blocks > 0").select("grp", "blocks").join(asked, "grp"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    own = nodes.where("n > 1").join(shape, "grp").select("grp", part("blocks").alias("s"), each("streams").alias("t"), "row", "comp", F.lit(0).alias("later"))
    queries = opened.withColumnRenamed("a", "row").join(shape, "grp").select("grp", each("blocks").alias("s"), part("streams").alias("t"), "row")
    queries = queries.join(nodes.select("row", "comp"), "row").select("grp", "s", "t", "row", "comp", F.lit(1).alias("later"))
    # a block that very many nodes ask has several streams, each with the block's members
    placed = own.union(queries).join(texts.select("row", "text"), "row").repartition("grp", "s", "t").sortWithinPartitions("grp", "s", "t", "later")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            a, b = [], []
            for grp, s, t, row, comp, later, text in zip(*[batch.column(c).to_pylist() for c in ("grp", "s", "t", "row", "comp", "later", "text")]):
                if (grp, s, t) != now:
                    now, held, index = (grp, s, t), [], None
                own = shingles(text)
                if not later:
                    held.append((row, comp, own))
                    continue
                if not held:
                    continue
                if index is None:
                    index = _Block(held)
                for x in index.links(own, comp, percent):
                    a.append(row)
                    b.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.select("grp", "s", "t", "row", "comp", "later", "text").mapInArrow(check, "a long, b long")


class _Block:
    """A block's token union, as one sorted column of the matrix, and which members have each token."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.rows, self.comps = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        self.sizes = np.array([len(m[2]) for m in members])
        tokens, who = np.concatenate([m[2] for m in members]), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.who = who[order]
        self.union, first = np.unique(tokens[order], return_index=True)
        self.first = np.r_[first, len(tokens)]

    def links(self, own: np.ndarray, comp: int, percent: int = PERCENT) -> list[int]:
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if len(at) < need(len(own), percent):
            return []
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.who[places], minlength=len(self.rows))
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(own) - both)) & (self.comps != comp))
        _, first = np.unique(self.comps[hit], return_index=True)
        return self.rows[hit[first]].tolist()


def linked_groups(docs: DataFrame) -> DataFrame:
    """Rows of (row, doc_id, text) to (row, doc_id, n_shingles, root): root is equal for documents that links connect."""
    with Scratch(docs.sparkSession) as scope:
        out = _grouped(by_row(docs)[0])
        scope.keep(out)
    return out


def _grouped(texts: DataFrame) -> DataFrame:
    feats = written(texts.where("kind = 0").select("row", "doc_id", "n", "k1", "k2", "bands"))
    sets = written(feats.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("rep")))
    nodes = written(feats.join(sets.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "n", "bands"))
    cut = written(prefixes(nodes, texts))
    known = nodes.join(cut.select("row", "common"), "row")
    led = written(band_leaders(known))
    first = written(verify(written(led.where("row <> b").select(F.col("row").alias("a"), "b").distinct()), texts))
    comps = connected_components(first).select(F.col("node").alias("row"), F.col("root").alias("comp"))
    groups = led.groupBy("row").agg((-F.max(F.struct("c", (-F.col("b")).alias("r")))["r"]).alias("grp"))
    grouped = nodes.select("row", "n").join(groups, "row", "left").join(comps, "row", "left")
    grouped = written(grouped.select("row", "n", F.coalesce("grp", "row").alias("grp"), F.coalesce("comp", "row").alias("comp")))
    discard(led)
    groups = group_table(grouped)
    opened = opened_groups(cut.select("row", "tokens", "hot"), grouped, groups)
    second = written(links_in_groups(opened, grouped, groups, texts))
    discard(cut, opened, groups, nodes)
    final = connected_components(first.union(second))
    placed = written(sets.join(final, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("root")))
    out = written(feats.join(placed, ["k1", "k2", "n"], "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "row").alias("root")))
    discard(feats, sets, grouped, first, second, final, placed)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    d = columns_or_null(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    out = linked_groups(d)
    least = written(out.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # so that a very large component can be split
    return out.join(least, "root").select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of every group, by doc_id and then by row; the columns of ``docs``."""
    text, others = F.col("text").cast("string").alias("text"), [n for n in docs.columns if n != "text"]
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text, F.struct(*[F.col(f"`{n}`") for n in others]).alias("rest"))
    with Scratch(docs.sparkSession) as scope:
        rows, _ = by_row(base)
        first = _grouped(rows).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "row")).alias("f"))
        kept = rows.where("kind = 0").join(written(first.select(F.col("f.row").alias("row"))), "row", "left_semi")
        out = kept.select(*[F.col("text") if n == "text" else F.col("rest")[n].alias(n) for n in docs.columns])
        scope.keep(out)
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    """The query: every document's shingles and component."""
    return jaccard_components(table(spark, sf_dir, "documents"))
