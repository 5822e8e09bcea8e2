"""Hard-negative mining by slot-decomposed selection.

An anchor's positives set upper limits for scores; each wants the best negatives at or below its own limit. The limits in descending
order cut the scores into disjoint slots, so a negative belongs to one slot however many windows it is in, and a slot's
best ``NEGATIVES`` are all that any window can want of it. Tasks keep those per anchor and slot, they are combined once more over
all tasks, and the windows are read off by merging slots from each limit downwards. The lower limits cut what is merged.

Anchors meet rows in blocks: a cell holds up to ``ANCHORS`` anchors, and up to ``ROWS`` rows stream past them, scored by one integer
matrix product for a few hundred rows at a time. For positives the cells are made within labels, so that a label with very many rows
has many cells; what leaves a cell is bounded by its anchors. Nothing is broadcast and no anchor meets all its rows in one task.

Defined results: rows with a null label, vec_id or vector, or with a null or non-finite component take no part; an empty vector
does, and of vectors of unequal length the shorter one goes on with zeros; a component whose floor(256 * x) is beyond 64 bits
counts as the nearest 64-bit number, and so does a score; ties go by smaller vec_id; rows that repeat a vec_id are rows of their own
(each can be an anchor, a positive or a negative, and an anchor's copy is another row); an anchor without positives or a positive without negatives
within its limits has no rows; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, columns_or_null, ship, table, written

#: Rows whose vec_id is divisible by it are anchors; positives of an anchor, negatives of a positive, and the lower limit in hundredths.
EVERY, POSITIVES, NEGATIVES, LOWEST = 100, 5, 5, 80
#: Anchors and rows of a cell, rows that are scored at a time, and candidates that wait until the best are kept.
ANCHORS, ROWS, SLICE, WAITING = 4_096, 16_384, 256, 1_000_000
SMALLEST = np.iinfo(np.int64).min


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with their labels and whole-number vectors. Written, so that rows keep their ids."""
    d = columns_or_null(embeddings, vec_id="long", label="long", embedding="array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x))
    return written(d.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), whole.alias("v")))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of 64-bit integers: by doubles where these hold every sum, else by Python's integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = [np.abs(m.astype(np.float64)).max(initial=0.0) for m in (a, b)]
    if most[0] * most[1] * max(width, 1) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, ends.min, ends.max).astype(np.int64)


def matrix(column: pa.ListArray) -> np.ndarray:
    """A list column without nulls as rows, the shorter ones filled with zeros."""
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    values, width = np.asarray(column.flatten(), dtype=np.int64), int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


class _Best:
    """The best rows of every key: candidates wait and are cut to ``keep`` for each key when there are many."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.size = keep, [], 0

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if len(key):
            self.parts.append((key, score, vec_id, row))
            self.size += len(key)

    def cut(self) -> tuple[np.ndarray, ...]:
        """Keys, scores, vec_ids and rows, the best first for each key."""
        key, score, vec_id, row = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((row, vec_id, ~score, key))
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else key
        kept = order[place < self.keep]
        out = key[place < self.keep], score[kept], vec_id[kept], row[kept]
        self.parts, self.size = [out], len(kept)
        return out


class _Cell:
    """The anchors of a cell and the best of the rows that stream past them."""

    def __init__(self, anchors: list[tuple]):
        self.rows, self.labels = (np.concatenate([a[i] for a in anchors]) for i in (0, 1))
        width = max(a[2].shape[1] for a in anchors)
        self.v = np.concatenate([np.pad(a[2], ((0, 0), (0, width - a[2].shape[1]))) for a in anchors])
        self.limits = np.concatenate([a[3] for a in anchors])  # descending, with SMALLEST where there are fewer
        self.held = np.concatenate([a[4] for a in anchors])
        # whole hundredths, as Python's integers don't overflow
        self.lowest = -((-LOWEST * self.limits.astype(object)) // 100) if len(self.limits) else self.limits
        self.least = np.full(len(self.rows), SMALLEST)

    def positives(self, row: np.ndarray, vec_id: np.ndarray, v: np.ndarray, best: _Best) -> None:
        """Rows of the anchors' label: those that may be among an anchor's best."""
        s = scores(self.v, v)
        other = self.rows[:, None] != row[None, :]
        if s.shape[1] > POSITIVES:
            known = np.where(other, s, SMALLEST)
            floor = np.partition(known, -POSITIVES, axis=1)[:, -POSITIVES]
            self.least = np.maximum(self.least, floor)
        a, r = np.nonzero(other & (s >= self.least[:, None]))
        best.add(a, s[a, r], vec_id[r], row[r])

    def negatives(self, row: np.ndarray, label: np.ndarray, vec_id: np.ndarray, v: np.ndarray, best: _Best) -> None:
        """Rows of other labels, by the slot that they are in: how many limits are at or above them."""
        s = scores(self.v, v)
        slot = np.zeros(s.shape, np.int64)
        for i in range(self.limits.shape[1]):
            slot += (self.held > i)[:, None] & (self.limits[:, i, None] >= s)
        a, r = np.nonzero((self.labels[:, None] != label[None, :]) & (slot > 0))
        j, s = slot[a, r], s[a, r]
        enough = s >= self.lowest[a, j - 1].astype(np.int64)
        a, r, j, s = a[enough], r[enough], j[enough], s[enough]
        best.add(a * (POSITIVES + 1) + j, s, vec_id[r], row[r])


def _meet(batches: Iterator[pa.RecordBatch], mine: bool) -> Iterator[pa.RecordBatch]:
    """Cells one after the other, each with its anchors first. ``mine``: rows of the anchors' own label are looked for."""
    now, anchors, cell, best = None, [], None, None

    def made() -> pa.RecordBatch:
        key, score, vec_id, _ = best.cut()
        a, j = (key, np.zeros_like(key)) if mine else (key // (POSITIVES + 1), key % (POSITIVES + 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (cell.rows[a], j, vec_id, score)], names=["a", "slot", "vec_id", "score"])

    for batch in batches:
        row, label, vec_id, c1, c2, c3, later = (np.asarray(batch.column(c), dtype=np.int64) for c in ("row", "label", "vec_id", "c1", "c2", "c3", "later"))
        key = np.stack([c1, c2, c3, later], 1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else []
        for i, j in zip(starts, [*starts[1:], len(key)]):
            if tuple(key[i, :3]) != now:
                if cell is not None:
                    yield made()
                now, anchors, cell, best = tuple(key[i, :3]), [], None, _Best(POSITIVES if mine else NEGATIVES)
            part = batch.slice(i, j - i)
            v = matrix(part.column("v"))
            if not later[i]:
                limits = part.column("limits")
                held = np.asarray(limits.value_lengths(), dtype=np.int64)
                filled = np.full((j - i, POSITIVES), SMALLEST)
                filled[np.arange(POSITIVES)[None, :] < held[:, None]] = np.asarray(limits.flatten(), dtype=np.int64)
                anchors.append((row[i:j], label[i:j], v, filled, held))
                continue
            if not anchors:
                continue
            cell = cell or _Cell(anchors)
            for k in range(i, j, SLICE):
                m = min(k + SLICE, j)
                if mine:
                    cell.positives(row[k:m], vec_id[k:m], v[k - i : m - i], best)
                else:
                    cell.negatives(row[k:m], label[k:m], vec_id[k:m], v[k - i : m - i], best)
                if best.size > WAITING:
                    best.cut()
    if cell is not None:
        yield made()


def met(anchors: DataFrame, rows: DataFrame, shape: DataFrame | dict[str, int], mine: bool) -> DataFrame:
    """(a, slot, vec_id, score): for each cell the best rows of each anchor (row) and slot. ``anchors`` and ``rows`` have row, vec_id,
    label and v, anchors also their limits. ``shape`` has the numbers of blocks of anchors and rows, na and nr: by label, if cells are
    within labels, else of all."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    group = F.col("label") if mine else F.lit(0).cast("long")
    place = lambda df: df.join(shape, "label") if mine else df.withColumns({k: F.lit(n).cast("long") for k, n in shape.items()})
    own = place(anchors).select(group.alias("c1"), part("na").alias("c2"), each("nr").alias("c3"), "row", "label", "vec_id", "v", "limits", F.lit(0).cast("long").alias("later"))
    theirs = place(rows).select(group.alias("c1"), each("na").alias("c2"), part("nr").alias("c3"), "row", "label", "vec_id", "v", F.array().cast("array<long>").alias("limits"), F.lit(1).cast("long").alias("later"))
    placed = own.union(theirs).repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3", "later")
    ship(anchors.sparkSession)
    return placed.mapInArrow(lambda batches: _meet(batches, mine), "a long, slot long, vec_id long, score long")


def best_of(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best rows of each group, with their ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    with Scratch(embeddings.sparkSession) as scope:
        out = _mined(embeddings)
        scope.keep(out)
    return out


def _mined(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings)
    chosen = rows.where(F.col("vec_id") % EVERY == 0)
    anchors = chosen.withColumn("limits", F.array().cast("array<long>"))
    labels = rows.groupBy("label").agg(F.sum((F.col("vec_id") % EVERY == 0).cast("long")).alias("a"), F.count("*").alias("r"))
    labels = written(labels.where("a > 0").select("label", F.ceil(F.col("a") / ANCHORS).cast("long").alias("na"), F.ceil(F.col("r") / ROWS).cast("long").alias("nr")))
    near = written(met(anchors, rows, labels, True))
    positives = written(best_of(near, ["a"], POSITIVES).select("a", F.col("rank").alias("i"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    limits = positives.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("i", "positive_score"))).alias("p")).select(F.col("a").alias("row"), F.transform("p", lambda x: x["positive_score"]).alias("limits"))
    asking = written(chosen.join(limits, "row"))
    shape = {"na": max(1, -(-asking.count() // ANCHORS)), "nr": max(1, -(-rows.count() // ROWS))}
    slots = written(best_of(met(asking, rows, shape, False), ["a", "slot"], NEGATIVES).drop("rank"))
    # a slot is in the windows of its own limit and of all above it
    windows = best_of(slots.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "slot"))), ["a", "i"], NEGATIVES)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    found = windows.join(positives.withColumn("i", F.col("i").cast("long")), ["a", "i"]).where(100 * wide("score") >= LOWEST * wide("positive_score"))
    ids = chosen.select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id"))
    return written(found.join(ids, "a").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op13(spark, sf_dir: str) -> DataFrame:
    """The query: the hard negatives of every anchor."""
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
   list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 a as (select * from e where vec_id % {EVERY} = 0),
 s as (select a.vec_id as a, a.label as al, e.vec_id as r, e.label as rl, list_inner_product(a.v, e.v)::bigint as score from a join e on a.vec_id <> e.vec_id),
 p as (select a, r as positive_id, score as positive_score from s where al = rl qualify row_number() over (partition by a order by score desc, r) <= {POSITIVES})
select p.a as anchor_id, positive_id, row_number() over w as rank, r as negative_id, positive_score, score as negative_score
from p join s on s.a = p.a and s.al <> s.rl and {LOWEST} * positive_score <= 100 * score and score <= positive_score
window w as (partition by p.a, positive_id order by score desc, r) qualify row_number() over w <= {NEGATIVES}
"""
