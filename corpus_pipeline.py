"""A corpus pipeline of five stages; each one's table is written and read again before the next.

Defined results, by stage: null and empty texts fail the base filter of the quality rules and go there; a null source is a host
(and a source of the mix) of its own; rows that repeat count as one text in the quality rules, lose their lines as later
copies in line dedup, are one group in the join (which keeps the least doc_id, null last) and are taken each by itself in the
mix; very long texts are worked on whole; extra columns are kept by all stages but the last, whatever their names; an
empty table passes through as an empty table. The other results of each stage are those of its operator.

A stage removes what it wrote on its way before it returns, but for the tables that its result reads: those of row numbers and,
after the join, of the rows themselves. ``run`` removes these, too, when the stage's result has been written. Stages share no state.
"""

from __future__ import annotations

import functools
import gc

from pyspark.sql import DataFrame, SparkSession

from rarefia.llm.bpe import code_digests
from rarefia.llm.common import Scratch, discard, table, written
from rarefia.llm.jaccard import keep_one_of_each
from rarefia.llm.line_dedup import dedup_lines
from rarefia.llm.mixing import mix_sources
from rarefia.llm.quality import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines above their host's limit."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that were copies as a whole."""
    return dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one_of_each(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says."""
    return mix_sources(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    return code_digests(docs)


def _scoped(stage):
    """The stage in a scope of its own: what its result doesn't read is removed when it returns."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with Scratch(spark) as scope:
            out = stage(spark, docs, sf_dir)
            scope.keep(out)
        return out

    return run_stage


STAGES = [
    ("quality rules", _scoped(quality_rules)),
    ("line dedup", _scoped(line_dedup)),
    ("n-gram Jaccard join", _scoped(ngram_jaccard_join)),
    ("mixing sources", _scoped(mix_to_weights)),
    ("byte-level BPE", _scoped(byte_bpe)),
]

#: SQL can express neither the join at this size nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's tables and its input are removed when its result has been written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark):
        for i, (_, stage) in enumerate(STAGES[:-1]):
            with Scratch(spark) as scope:
                out = stage(spark, docs, sf_dir)
            docs, before = written(out), docs
            scope.close()
            if i:
                discard(before)
            gc.collect()  # plans that Python no longer holds: Spark's cleaner then removes their shuffle files
        return STAGES[-1][1](spark, docs, sf_dir)
