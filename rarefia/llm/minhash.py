"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

1. Equal sets are one node. A set's hashes fall into ``BANDS * ROWS`` bins by their upper bits, and a bin keeps its least hash (the
   hashes are sorted, so that is the first of each bin). An empty bin takes the value of the bin that a fixed sequence of
   random bins reaches first, the sequence being the bin's own: optimal densification.
2. ``ROWS`` bins make a band, equal bands a bucket. Each bucket has a centre, and a candidate edge goes from each other node to it, so a
   bucket of n nodes makes n - 1 edges, never n squared. The centre is the node whose buckets are largest together: it is nearest
   to the text that the others come from, and mostly the same in all bands, so that an edge is made once.
3. Edges whose sizes rule a link out go; the others are confirmed on the full sets, and the overlap is kept. Confirmed edges make
   components.
4. Buckets whose nodes are all in one component are done. In the others two nodes can be linked though neither is linked with the
   centre. A node's group is that of its largest bucket's centre; a node asks the other groups of such a bucket (of two groups
   the smaller asks) and its own, if its component isn't the centre's. Jaccard distance is a metric: a node that is further
   from a group's centre than the group's radius and the limit together is linked with none of its members and doesn't ask. The rest are
   compared with the group's members in blocks. No pairs are listed, and none that shares a bucket is left out.

Two sets of a similarity of 0.85 share one of the 24 bands but for a chance of about 1 in 1.3 million; for 0.9 it is 1 in a thousand millions.

Defined results: null and empty texts have no shingles and link with nothing; texts under five words have one shingle, the
whole sequence; rows that repeat are linked (equal sets); a null doc_id takes part but is never a component's id unless all its ids are
null, and then it is kept; rows with the component's doc_id are kept each; very long texts are one set as others are; ties of
centres fall to the smaller row, and change no result; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, discard, table, written
from .components import connected_components
from .jaccard import by_row, compared, group_table, links_in_groups, mix, overlap, placed_pairs, shingles

#: Similarity in hundredths, bins in a band and bands.
PERCENT, ROWS, BANDS = 85, 5, 24
BINS = ROWS * BANDS
#: The random bins of a sequence that are drawn at a time.
PROBES = 64
#: Sets with fewer shingles link with equal sets alone: of n + 1 in all, n must be shared.
LEAST = -(-PERCENT // (100 - PERCENT))


def bins_of(s: np.ndarray) -> np.ndarray:
    """Each hash's bin, by the upper 32 bits; ascending with the hashes."""
    return ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)


def _probes(round_: int) -> np.ndarray:
    """The bins that each bin's sequence has at the places of this round."""
    at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(round_ * PROBES, (round_ + 1) * PROBES, dtype=np.uint64)[None, :]
    return (mix(at + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


_FIRST_PROBES = _probes(0)


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted set that isn't empty, empty bins filled by optimal densification."""
    own, first = np.unique(bins_of(s), return_index=True)
    full, out = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    full[own.astype(np.int64)], out[own.astype(np.int64)] = True, s[first]
    open_, round_ = np.flatnonzero(~full), 0
    while len(open_):
        probes = (_probes(round_) if round_ else _FIRST_PROBES)[open_]
        hit = full[probes]
        some = hit.any(1)
        out[open_[some]] = out[probes[some, hit[some].argmax(1)]]
        open_, round_ = open_[~some], round_ + 1
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    key, sig = np.arange(1, BANDS + 1, dtype=np.uint64), signature(s)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[r * BANDS : (r + 1) * BANDS])
    return key.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size and digest of each document's set, and its bands."""
    for b in batches:
        for k in range(0, b.num_rows, 1_000):
            part = b.slice(k, 1_000)
            n, k1, k2, bands = [], [], [], []
            for text in part.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                k1.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                k2.append(int(mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum().view(np.int64)) if len(s) else 0)
                bands.append(band_keys(s) if len(s) >= LEAST else [])
            zero = pa.array([0] * len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("row"), zero, part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, k1, k2)], pa.array(bands, pa.list_(pa.int64())), part.column("text")], names=["row", "kind", "doc_id", "n", "k1", "k2", "bands", "text"])


def buckets(nodes: DataFrame) -> DataFrame:
    """(row, band, c): the bands that a node shares, and how many nodes have them."""
    banded = nodes.select("row", F.explode("bands").alias("band")).repartition("band")
    sizes = written(banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    return written(banded.join(sizes, "band").select("row", "band", "c"))


def centres(shared: DataFrame) -> DataFrame:
    """(band, b): the centre of each bucket. Written, so that Spark can split joins with a bucket that very many nodes share."""
    weights = written(shared.groupBy("row").agg(F.sum("c").alias("w")))
    best = shared.join(weights, "row").groupBy("band").agg(F.max(F.struct("w", (-F.col("row")).alias("r"))).alias("m"))
    return written(best.select("band", (-F.col("m.r")).alias("b")))


def star_edges(led: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): from each node to the centres of its buckets, where the sizes allow a link."""
    sizes = nodes.select("row", "n")
    edges = led.where("row <> b").select(F.col("row").alias("a"), "b").distinct()
    edges = edges.join(sizes.withColumnRenamed("row", "a").withColumnRenamed("n", "na"), "a").join(sizes.withColumnRenamed("row", "b").withColumnRenamed("n", "nb"), "b")
    return edges.where((100 * F.col("na") >= PERCENT * F.col("nb")) & (100 * F.col("nb") >= PERCENT * F.col("na")))


def confirmed(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both): the edges with the overlap of their full sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, both in compared(batches, overlap):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, both)], names=["a", "b", "both"])

    return placed_pairs(edges.select("a", "b"), texts).mapInArrow(count, "a long, b long, both long").join(edges, ["a", "b"])


def asked_groups(led: DataFrame, nodes: DataFrame, groups: DataFrame, far: DataFrame) -> DataFrame:
    """(a, grp): the groups that a node asks. ``far`` has the distances of confirmed edges."""
    comps = nodes.select("row", "n", "grp", "comp")
    placed = written(led.select("row", "band").join(comps, "row"))
    mixed = written(placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band"))
    placed = written(placed.join(mixed, "band"))
    about = groups.select(*[F.col(c).alias(f"g_{c}") for c in ("grp", "least_n", "most_n", "members", "main", "pure", "radius")])
    theirs = written(placed.select("band", F.col("grp").alias("g_grp")).distinct().join(about, "g_grp"))
    own = placed.join(groups.select("grp", "members"), "grp")
    side = (F.col("members") < F.col("g_members")) | ((F.col("members") == F.col("g_members")) & (F.col("grp") < F.col("g_grp")))
    fits = (100 * F.col("g_most_n") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("g_least_n"))
    other = ~(F.col("g_pure") & (F.col("comp") == F.col("g_main")))
    asks = own.join(theirs, "band").where(side & fits & other).select(F.col("row").alias("a"), F.col("g_grp").alias("grp"), F.col("g_radius").alias("radius")).distinct()
    inside = nodes.join(groups.select("grp", "main", "radius"), "grp").where("comp <> main").select(F.col("row").alias("a"), "grp", "radius")
    known = far.select("a", F.col("b").alias("grp"), "d")
    near = asks.union(inside).join(known, ["a", "grp"], "left").where(F.col("d").isNull() | (F.col("d") <= F.col("radius") + (1 - PERCENT / 100) + 1e-9))
    return written(near.select("a", "grp"))


def grouped_nodes(led: DataFrame, nodes: DataFrame, comps: DataFrame, far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (row, n, grp, comp), and groups with all that asking needs; ``radius`` is the largest distance of a member from
    the centre, 1 where one isn't known."""
    best = led.groupBy("row").agg((-F.max(F.struct("c", (-F.col("b")).alias("r")))["r"]).alias("grp"))
    found = written(nodes.select("row", "n").join(best, "row").join(comps, "row", "left").select("row", "n", "grp", F.coalesce("comp", "row").alias("comp")))
    away = found.join(far.select(F.col("a").alias("row"), F.col("b").alias("grp"), "d"), ["row", "grp"], "left")
    more = away.groupBy("grp").agg((F.min("comp") == F.max("comp")).alias("pure"), F.max(F.when(F.col("row") == F.col("grp"), 0.0).otherwise(F.coalesce("d", F.lit(1.0)))).alias("radius"))
    return found, written(group_table(found).join(more, "grp"))


def near_groups(docs: DataFrame) -> DataFrame:
    """Rows of (row, doc_id, text) to (row, doc_id, n_shingles, root): root is equal for documents that links connect."""
    with Scratch(docs.sparkSession) as scope:
        out = _linked(by_row(docs, _features)[0])
        scope.keep(out)
    return out


def _linked(texts: DataFrame) -> DataFrame:
    feats = written(texts.select("row", "doc_id", "n", "k1", "k2", "bands"))
    sets = written(feats.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("rep")))
    nodes = written(feats.where(F.size("bands") > 0).join(sets.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "n", "bands"))
    shared = buckets(nodes)
    led = written(shared.join(centres(shared), "band"))
    checked = written(confirmed(written(star_edges(led, nodes)), texts))
    union = F.col("na") + F.col("nb") - F.col("both")
    far = checked.select("a", "b", (1 - F.col("both") / union).alias("d"))
    first = written(checked.where(100 * F.col("both") >= PERCENT * union).select("a", "b"))
    comps = connected_components(first).select(F.col("node").alias("row"), F.col("root").alias("comp"))
    placed, groups = grouped_nodes(led, nodes, comps, far)
    asked = asked_groups(led, placed, groups, far)
    discard(shared, led, nodes)
    second = written(links_in_groups(asked, placed, groups, texts, PERCENT))
    final = connected_components(first.union(second))
    roots = written(sets.join(final, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("root")))
    return written(feats.join(roots, ["k1", "k2", "n"], "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "row").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = columns_or_null(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    out = near_groups(rows)
    least = written(out.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # so that a very large component can be split
    found = out.join(least, "root")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11(spark, sf_dir: str) -> DataFrame:
    """The query: every document's shingles and component, and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))
