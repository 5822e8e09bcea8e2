"""Quality rules, with DataFrame functions only: a base filter per document, then cross-document line frequency.

Normalised lines (lower case, single spaces) are hashed and the documents that hold each are counted per host (the
source). Lines in more documents than the host's limit are removed; a document that loses more than half of its
words so is depleted and rejected.

Defined results: a null or empty text has no words and fails the base filter; a null source is a host of its own;
lines without a word are neither counted nor removed; very long texts are looked at whole; extra columns are kept by the filter,
whatever their names, and not read by the scores; there are no ties; an empty table gives an empty table. Rows of a host with one text
(null and empty are one) count as one document, in its lines and in the host's size, so copies alone make no line common
and a later stage can keep one of them; each of them gets the verdict of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, ROW, SPACE, WORD, Scratch, columns_or_null, table, with_row_id, written

#: A line is above its host's limit in more documents than this, and than this share of the host's documents.
MIN_DOCS, MAX_SHARE = 20, 0.02
#: A document is depleted when removed lines hold more than this share of its words.
DEPLETED = 0.5
#: The base filter.
MIN_WORDS, MAX_REPEATED = 50, 0.5


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, rf"[{SPACE}]+", " ")))


def repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` to rows with ``words``: the words in 3-word windows that occur twice or more.

    Windows are hashed to 64 bits; only documents that have fewer distinct windows than windows are sorted, and
    there equal neighbours give the positions. All within the row: nothing is shuffled.
    """
    none = F.array().cast("array<bigint>")
    size = F.size("words")
    df = df.withColumn("_h", F.when(size < 3, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))))
    at = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(at)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_s", lambda x, j: (F.get("_s", j + 1)["h"] == x["h"]) | ((j > 0) & (F.get("_s", F.greatest(j - 1, F.lit(0)))["h"] == x["h"])))
    df = df.withColumn("_p", F.transform(twice, lambda x: x["i"]))
    covered = F.concat("_p", F.transform("_p", lambda p: p + 1), F.transform("_p", lambda p: p + 2))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_h", "_s", "_p")


def base_features(docs: DataFrame) -> DataFrame:
    """Rows of (row, doc_id, source, text) to their features, ``content`` (a hash of the text) and ``lines``: position, hash and
    words of each line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), 0)).withColumn("_l", F.split(text, "\n", -1))
    spoken = F.filter("_l", lambda x: x.rlike(WORD))
    df = df.withColumn("_w", spoken)
    lines = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("pos"), F.xxhash64(normalised(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0)
    df = repeat_words(df)
    return df.select(
        "row", "doc_id", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("_w") - F.size(F.array_distinct("_w"))).cast("long").alias("n_dup_lines"), "n_repeat_words", F.xxhash64(text).alias("content"), lines.alias("lines"),
    )


def common_lines(feats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h) of the lines above their host's limit; each text counts once per host. Counting combines within tasks first,
    so a line or a text in a third of all documents costs one row per task."""
    feats = feats.groupBy("source", "content").agg(F.first("lines").alias("lines"))
    held = feats.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    hosts = feats.groupBy("source").agg(F.count("*").alias("docs"))
    often = held.groupBy("source", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = hosts.select(F.col("source").alias("host"), "docs")
    both = often.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return both.where(F.col("n_docs") > F.col("docs") * max_share).select("host", F.col("h").alias("common"))


def removed_lines(feats: DataFrame, common: DataFrame) -> DataFrame:
    """(row, pos, n) of every line to remove."""
    lines = feats.select("row", "source", F.inline("lines")).select("row", "source", "pos", "h", "n")
    return lines.join(common, (F.col("h") == F.col("common")) & F.col("source").eqNullSafe(F.col("host"))).select("row", "pos", "n")


def judge(feats: DataFrame, removed: DataFrame) -> DataFrame:
    """Add ``n_removed_words``, ``base_failed`` and ``kept``."""
    lost = removed.groupBy("row").agg(F.sum("n").cast("long").alias("_lost"))
    df = feats.drop("content", "lines").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("_lost", F.lit(0)).cast("long")).drop("_lost")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_removed_words") <= int(100 * DEPLETED) * F.col("n_words")))


def score_quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the features, the removed words and the verdict."""
    d = columns_or_null(docs, doc_id="long", source="string", text="string").withColumn("row", F.monotonically_increasing_id())
    feats = written(base_features(d))
    return judge(feats, removed_lines(feats, written(common_lines(feats))))


def drop_lines(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Delete the lines at (row, pos) of ``marks`` from the texts of ``docs``, whose rows ``ROW`` tells apart; ``n_chars``, where
    there is one, follows."""
    gone, lines = F.col(f"{OWN}gone"), f"{OWN}lines"
    # texts are dealt out by row at every size, not only where the marks outgrow a broadcast
    found = marks.groupBy(F.col("row").alias(ROW)).agg(F.collect_list("pos").alias(f"{OWN}gone")).hint("merge")
    df = docs.join(found, ROW, "left").withColumn(lines, F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    df = df.withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{n}`") for n in docs.columns])


def filter_quality(docs: DataFrame) -> DataFrame:
    """The kept documents, without the lines above the limits; the columns of ``docs``."""
    names = docs.columns
    with Scratch(docs.sparkSession) as scope:
        rows = with_row_id(docs, ROW)
        base = columns_or_null(rows, **{ROW: "long"}, doc_id="long", source="string", text="string").withColumnRenamed(ROW, "row")
        feats = written(base_features(base))
        marks = written(removed_lines(feats, written(common_lines(feats))))
        kept = written(judge(feats, marks).where("kept").select(F.col("row").alias(ROW)))
        out = drop_lines(rows.join(kept.hint("merge"), ROW, "left_semi"), marks).select(*[F.col(f"`{n}`") for n in names])
        scope.keep(out)
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    """The query: features and verdict of every document."""
    out = score_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP5_SQL = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
 w as (select r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as ls from d),
 u as (select r, unnest(words) as w, generate_subscripts(words, 1) as i from w),
 g as (select r, i, w as a, lead(w) over o as b, lead(w, 2) over o as c from u window o as (partition by r order by i)),
 t as (select r, i, count(*) over (partition by r, a, b, c) as n from g where c is not null),
 p as (select r, count(distinct i + k) as n_repeat_words from t, (select unnest([0, 1, 2]) as k) where n >= 2 group by r),
 l as (select r, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) as line, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n
       from (select r, source, unnest(ls) as x from w)),
 o as (select source, min(r) as r from d group by source, text),
 h as (select source, count(*) as docs from o group by source),
 c as (select l.source, l.line from (select source, line, count(distinct r) as k from l where n > 0 and r in (select r from o) group by source, line) l
       join h on l.source is not distinct from h.source where k > {MIN_DOCS} and k > docs * {MAX_SHARE}),
 lost as (select r, sum(l.n) as lost from l join c on l.line = c.line and l.source is not distinct from c.source where l.n > 0 group by r),
 dup as (select r, count(*) - count(distinct x) as n_dup_lines from l where n > 0 group by r),
 f as (select w.*, len(words)::bigint as n_words, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0)::bigint as n_removed_words, coalesce(n_dup_lines, 0)::bigint as n_dup_lines
       from w left join p using (r) left join lost using (r) left join dup using (r))
select doc_id, n_words, length(array_to_string(words, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
 n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and 100 * n_removed_words <= 50 * n_words as kept, n_removed_words
from f
"""
