"""Line dedup by a suffix array over line-ID sequences, with DataFrame functions only.

The texts, as sequences of line ids, are laid one after the other by doc_id. Prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: a suffix's new rank is the number of suffixes before it when sorted by (its rank, the rank
of the suffix that many lines on), summed over sampled ranges, never in one task. Suffixes whose prefix has become
unique leave the rounds. Equal ranks are an interval of the suffix array whose longest common prefix has at least
that many lines, so two overlapping ranks tell the interval of a run of any length. A run of at least ``MIN_WORDS``
words that begins such an interval's earlier suffix is kept there and deleted at the later ones.

It is enough to look at the shortest runs of ``MIN_WORDS`` words that begin or end at each line: a maximal
repeated run is the union of those within it.

Defined results: null and empty texts are left as they are; rows that repeat are copies of the first (by doc_id, null
first, then by row); a text that loses all its lines becomes empty; ties in order fall to the row's place in the
table (its file by the hash of its path, and its place there, or its place in the reading that is written); very long texts are worked on
whole; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OWN, ROW, WORD, Scratch, columns_or_null, discard, running_total, table, with_row_id, written
from .quality import drop_lines

#: Words that a repeated run of lines must have.
MIN_WORDS = 50


def line_rows(rows: DataFrame) -> DataFrame:
    """(row, pos, p, left, before, words, h1, h2) of every line: its place in its text and among all lines, the lines from
    it to the text's end, the words before it in the text and in it, and its 128-bit id."""
    ids = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    each = written(rows.where("text <> ''").select("row", "doc_id", ids.alias("lines")))
    sized = each.select("row", "doc_id", F.size("lines").cast("long").alias("n"))
    starts = written(running_total(sized, ["doc_id", "row"], "n", "start").select("row", "start"))
    lines = each.select("row", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "l")).select("row", "n", "pos", "l.*")
    words = F.sum("words").over(Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = lines.withColumn("before", words).join(starts, "row")
    return placed.select("row", "pos", (F.col("start") + F.col("pos")).alias("p"), (F.col("n") - F.col("pos")).alias("left"), "before", "words", "h1", "h2")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(p, m): the shortest runs of ``min_words`` words that begin at a line, and those that end at one."""
    after = F.col("before") + F.col("words")
    ahead = Window.partitionBy("row").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("row").orderBy("after").rangeBetween(-(min_words - 1), 0)
    both = lines.withColumn("after", after).withColumn("total", F.max("after").over(Window.partitionBy("row")))
    both = both.withColumn("last", F.max("pos").over(ahead)).withColumn("first", F.min("pos").over(back))
    begin = both.where(F.col("total") - F.col("before") >= min_words).select("p", (F.col("last") - F.col("pos") + 1).alias("m"))
    end = both.where(F.col("after") >= min_words).select((F.col("p") - F.col("pos") + F.col("first")).alias("p"), (F.col("pos") - F.col("first") + 1).alias("m"))
    return begin.union(end).distinct()


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """The repeated rows by ``by``, with ``rank``: how many repeated rows sort before their kind."""
    kinds = written(rows.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1"))
    ranks = running_total(kinds, by, "c", "rank").drop("c")
    return written(rows.join(ranks, by).drop(*by))


def doubled(now: DataFrame, k: int) -> DataFrame:
    """From ranks by k lines to ranks by 2k lines."""
    later = now.select((F.col("p") - k).alias("p"), F.col("rank").alias("rank2"))
    return ranked(now.where(F.col("left") >= 2 * k).withColumnRenamed("rank", "rank1").join(later, "p"), ["rank1", "rank2"])


def later_copies(runs: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(p, m) of the runs of k to 2k - 1 lines that an earlier suffix of their interval begins with, too."""
    mine = runs.where((F.col("m") >= k) & (F.col("m") < 2 * k))
    own = ranks.select("p", "rank")
    begin = mine.join(own.withColumnRenamed("rank", "a"), "p")
    whole = begin.withColumn("q", F.col("p") + F.col("m") - k).join(own.select(F.col("p").alias("q"), F.col("rank").alias("b")), "q")
    whole = written(whole.select("p", "m", "a", "b"))
    # written before the join, so that Spark can split a run that is very common
    first = written(whole.groupBy("m", "a", "b").agg(F.min("p").alias("first")))
    return whole.join(first, ["m", "a", "b"]).where("p <> first").select("p", "m")


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, pos) of the lines to delete, of rows (row, doc_id, text). What is written on the way is removed at the end."""
    with Scratch(rows.sparkSession) as scope:
        out = _repeated_lines(rows, min_words)
        scope.keep(out)
    return out


def _repeated_lines(rows: DataFrame, min_words: int) -> DataFrame:
    lines = written(line_rows(rows))
    ranks = ranked(lines.select("p", "row", "pos", "left", "h1", "h2"), ["h1", "h2"])
    places = ranks.select("p", "row", "pos")
    runs = written(shortest_runs(lines, min_words).join(places.select("p"), "p", "left_semi"))
    longest, k, found = runs.agg(F.max("m")).head()[0] or 0, 1, None
    while k <= longest and not ranks.isEmpty():
        copies = written(later_copies(runs, ranks, k))
        found = copies if found is None else found.union(copies)
        before, ranks = ranks, doubled(ranks.select("p", "left", "rank"), k)
        if k > 1:
            discard(before)
        k *= 2
    if found is None:
        return written(places.select("row", "pos").where("false"))
    ends = found.groupBy("p").agg((F.col("p") + F.max("m")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("row").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return written(places.join(ends, "p", "left").withColumn("reach", reach).where("reach > p").select("row", "pos"))


def drop_repeated(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The texts of ``rows``, which ``ROW`` tells apart, without later copies of repeated runs."""
    base = columns_or_null(rows, **{ROW: "long"}, doc_id="long", text="string").withColumnRenamed(ROW, "row")
    return drop_lines(rows, repeated_lines(base, min_words))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """The texts without later copies of repeated runs; the columns of ``docs``. A text whose lines all go was a copy as a
    whole: its row is dropped, unless told otherwise."""
    names, full = docs.columns, f"{OWN}full"
    rows = with_row_id(docs, ROW)
    out = drop_repeated(rows.withColumn(full, F.coalesce(F.octet_length("text"), F.lit(0)) > 0), min_words)
    if drop_emptied:
        out = out.where(~F.col(full) | (F.octet_length("text") > 0))
    return out.select(*[F.col(f"`{n}`") for n in names])


def op4(spark, sf_dir: str) -> DataFrame:
    """The query: what stays of every document."""
    docs = with_row_id(table(spark, sf_dir, "documents"), ROW).select("doc_id", "text", ROW)
    n = F.when(F.octet_length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long")
    out = drop_repeated(docs.withColumn("n_lines", n))
    return out.select("doc_id", "n_lines", F.octet_length("text").cast("long").alias("n_kept_bytes"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP4_SQL = rf"""
with d as (select row_number() over (order by doc_id) as r, doc_id, text from documents),
 l as (select r, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from d where text <> ''),
 w as (select *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n from l),
 c as (select *, sum(n) over (partition by r order by i) as a, sum(n) over (partition by r) as total from w),
 b as (select *, a - n as z,
        max(i) over (partition by r order by a - n range between 0 preceding and {MIN_WORDS - 1} following) as last,
        min(i) over (partition by r order by a range between {MIN_WORDS - 1} preceding and 0 following) as first from c),
 u as (select r, i as s, last as e from b where total - z >= {MIN_WORDS} union select r, first, i from b where a >= {MIN_WORDS}),
 k as (select u.r, s, e, array_to_string(string_split(text, chr(10))[s:e], chr(10)) as run from u join d using (r)),
 f as (select *, row_number() over (partition by run order by r, s) as o from k),
 gone as (select distinct r, unnest(range(s, e + 1)) as i from f where o > 1),
 t as (select l.r, string_agg(x, chr(10) order by l.i) filter (where g.i is null) as kept, count(*) as n_lines from l left join gone g on l.r = g.r and l.i = g.i group by l.r)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, strlen(case when t.r is null then text else coalesce(kept, '') end)::bigint as n_kept_bytes,
 md5(case when t.r is null then text else coalesce(kept, '') end) as kept_md5
from d left join t using (r)
"""
