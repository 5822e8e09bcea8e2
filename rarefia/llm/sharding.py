"""Sharding by sampled splitters, with DataFrame functions only.

The law kept is ``bytes``: shards of near-equal size. Records are ordered by (hash of the text, doc_id, row);
size-weighted samples give quantile boundaries between hashes, so equal texts stay in one range; a range that turns
out overfull (a group of copies can hold a third of all bytes) is subdivided by boundaries sampled inside it, down to
single rows. The ranges, in order, fill the shards.

Defined results: a null text has size 1, as an empty one; rows with a null doc_id come first among equal texts;
repeated rows are kept, in any order among themselves, and so are other ties (equal text and doc_id); very long texts count
with all their bytes, and a range has one of them at least, however large; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_or_null, range_of, splitters, table, written


def keyed_sizes(docs: DataFrame) -> DataFrame:
    """The small table that all planning reads: a row's key, size and checksum, without its text."""
    d = columns_or_null(docs, doc_id="long", text="string")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = d.select("doc_id", F.octet_length(raw).cast("long").alias("_n"), F.crc32(raw).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    # the ids hold from the first written table of rows on; the splitters before it don't read them
    return sized.select("doc_id", (F.col("_n") + 1).alias("size"), "text_crc32", "h", F.monotonically_increasing_id().alias("row"))


def ranges(rows: DataFrame, parts: int, overfull: float = 1.5) -> tuple[DataFrame, list[tuple]]:
    """Add ``part`` (a struct of two range numbers) and return it with the (part, bytes, rows) of each range in order.

    At most about ``2 * parts`` ranges exist, and only their boundaries and sums reach the driver.
    """
    coarse = written(rows.withColumn("a", range_of(rows, ["h"], splitters(rows, ["h"], "size", parts))))
    sums = {r["a"]: (r["b"], r["n"]) for r in coarse.groupBy("a").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    limit = overfull * sum(b for b, _ in sums.values()) / parts if sums else 0
    full = [a for a, (b, n) in sums.items() if b > limit and n > 1]
    if not full:
        return coarse.withColumn("b", F.lit(0)), [((a, 0), *sums[a]) for a in sorted(sums)]
    inside = coarse.where(F.col("a").isin(full))
    keys = ["h", "doc_id", "row"]
    fine = max(2, round(sum(sums[a][0] for a in full) / limit * overfull))
    cuts = splitters(inside, keys, "size", fine, seed=12, unique=True)
    split = written(coarse.withColumn("b", F.when(F.col("a").isin(full), range_of(coarse, keys, cuts)).otherwise(0)))
    got = split.groupBy("a", "b").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    return split, sorted(((r["a"], r["b"]), r["s"], r["n"]) for r in got)


def shard_of_ranges(parts: list[tuple], shards: int) -> list[tuple[int, int, int, int]]:
    """(a, b, shard, first slot) of each range: a range goes where its middle byte falls."""
    total, before, slots, out = sum(b for _, b, _ in parts), 0, [0] * shards, []
    for (a, b), size, n in parts:
        s = min(shards - 1, int((before + size / 2) * shards // total))
        out.append((a, b, s, slots[s]))
        before, slots[s] = before + size, slots[s] + n
    return out


def assign_shards(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 64) -> DataFrame:
    """Per row: doc_id, size, text_crc32, h, row, shard and slot. ``ranges_per_shard`` bounds both the unevenness
    (about one range of a shard's bytes) and what one task of the slot window sorts."""
    rows = keyed_sizes(docs)
    split, parts = ranges(rows, shards * ranges_per_shard)
    plan = shard_of_ranges(parts, shards)
    if not plan:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).where("false")
    # as many rows as there are ranges: a bound that the parameters set
    where = docs.sparkSession.createDataFrame(plan, "a int, b int, shard int, first long")
    within = Window.partitionBy("a", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "row")
    return split.withColumn("_i", F.row_number().over(within)).join(F.broadcast(where), ["a", "b"]).withColumn("slot", F.col("first") + F.col("_i") - 1).drop("_i", "a", "b", "first")


def op3(spark, sf_dir: str) -> DataFrame:
    """The query: the shard and slot of every document."""
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
