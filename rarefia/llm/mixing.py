"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, each source gets a target from its weight, and target / size is the rate at which
its documents repeat: every document is emitted floor(rate) times, and once more if a draw seeded by its id, its text
and an ordinal falls below the fraction.

Defined results: a null or empty text has size 0 and is emitted like any other row (it adds no words); a null
source is a source of its own; rows with one doc_id (or none) and different texts have draws of their own, and so have rows that
repeat as a whole: the plan numbers them from 0 (it doesn't matter which is which), the mix tells them apart by their file
and their place in it, or by an id that is written first where the table isn't files as they are; very long texts are counted and hashed
whole; extra columns are kept by the mix; an empty table gives an
empty table; a source without any words gets target 0 and rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, WORD, columns_or_null, running_total, with_row_id, written

#: A source repeats at most this often.
MOST = 3.0


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def unit_draw(doc_id: Column, hashed: Column, ordinal: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5; the same in any engine."""
    text = F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), hashed, ordinal.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_sizes(sized: DataFrame) -> DataFrame:
    """One row per source: ``source``, ``source_size``."""
    return sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))


def ranked_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ..., ``cycle``, repeating, over the sources by code point with null last."""
    keyed = sources.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1))
    ranked = running_total(keyed, ["_last", "source"], "_one", "_before")
    return ranked.withColumn("weight", (F.col("_before") % cycle + 1).cast("double")).drop("_last", "_one", "_before")


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Share all words by ``weight``; a target stops at ``most`` times its source's size and the excess is
    shared again by weight among the others, until none is above. Each round is one small aggregation that
    returns one row, and every round but the last stops at least one more source."""
    level, stopped = 0.0, -1
    cap = F.col("source_size") * most
    while True:
        full = cap < F.col("weight") * level
        got = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)
        ).head()
        if not got[0] or got[3] == stopped or not got[2]:
            break
        stopped, level = got[3], (got[0] - got[1]) / got[2]
    return sources.withColumn("target", F.least(cap, F.col("weight") * level))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more with the fraction's probability."""
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def with_copies(sized: DataFrame, goals: DataFrame, seed: str, most: float = MOST) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows of (doc_id, source, size, hash, ordinal).

    The join is on the source; a source with a third of all rows is split by AQE's skew handling, as the rows
    are the streamed side. Nothing is broadcast unless its measured size is below Spark's own threshold.
    """
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return joined.withColumn("copies", copies(rate, unit_draw(F.col("doc_id"), F.col("hash"), F.col("ordinal"), seed)))


def mix_plan(docs: DataFrame, seed: str = "mix", most: float = MOST) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies."""
    rows = columns_or_null(docs, doc_id="long", source="string", text="string").select("doc_id", "source", word_count(F.col("text")).alias("size"), text_hash(F.col("text")).alias("hash"))
    # rows that are equal in all of these are counted and dealt out again with ordinals
    same = rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    sized = written(same.select("doc_id", "source", "size", "hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal")))
    sources = written(ranked_weights(written(source_sizes(sized))))
    return with_copies(sized, written(targets(sources, most)), seed, most)


def mix_sources(docs: DataFrame, seed: str = "mix", most: float = MOST) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    source, rate, often, copy, again, hashed, place = (f"{OWN}{x}" for x in ("source", "rate", "copies", "copy", "again", "hash", "place"))
    summed = written(source_sizes(docs.select("source", word_count(F.col("text")).alias("size"))))
    goals = written(targets(written(ranked_weights(summed)), most))
    goals = goals.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0).alias(rate))
    rows = with_row_id(docs, place)
    joined = rows.join(goals, rows["source"].eqNullSafe(goals[source]), "left")
    # ids that repeat with one text; few, so Spark sends them to all tasks if their measured size allows
    key = [F.col("doc_id").cast("string").alias(again), text_hash(F.col("text")).alias(hashed)]
    repeated = written(docs.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = joined.withColumn(hashed, text_hash(F.col("text")))
    repeated = repeated.select(F.col(again), F.col(hashed).alias(f"{hashed}2"))
    joined = joined.join(repeated, F.col("doc_id").cast("string").eqNullSafe(F.col(again)) & (F.col(hashed) == F.col(f"{hashed}2")), "left")
    ordinal = F.when(F.col(f"{hashed}2").isNotNull(), F.col(place)).otherwise(F.lit(0).cast("long"))
    taken = joined.withColumn(often, copies(F.col(rate), unit_draw(F.col("doc_id"), F.col(hashed), ordinal, seed))).where(F.col(often) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*[F.col(f"`{n}`") for n in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    """The query: what the mix takes of every document."""
    from .common import table

    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


OP1_SQL = """
with e as (select doc_id, source, md5(coalesce(text, '')) as hash, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
 d as (select *, row_number() over (partition by doc_id, source, hash) - 1 as ordinal from e),
 s as (select source, sum(size)::bigint as source_size from d group by source),
 w as (select *, 1.0 + (row_number() over (order by source is null, source) - 1) % 3 as weight from s),
 o as (select *, 3.0 * source_size as cap, sum(3.0 * source_size) over r - 3.0 * source_size as cap_before,
        sum(weight) over (order by 3.0 * source_size / weight desc, source rows between unbounded preceding and current row) as weight_left,
        sum(source_size) over () as total
       from w window r as (order by 3.0 * source_size / weight, source desc rows between unbounded preceding and current row)),
 l as (select max((total - cap_before) / weight_left) as level from o),
 t as (select source, source_size, least(cap, weight * level)::double as target from o, l),
 r as (select d.doc_id, d.size::bigint as size, t.source_size, t.target,
        case when t.source_size > 0 then least(t.target / t.source_size, 3.0) else 0.0 end as rate,
        ('0x' || substr(md5('mix/' || coalesce(d.doc_id::varchar, 'null') || '/' || d.hash || '/' || d.ordinal), 1, 12))::bigint / 281474976710656.0::double as u
       from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies
from (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::int as copies from r)
"""
