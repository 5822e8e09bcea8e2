from collections import Counter

import corpus_pipeline
from rarefia.llm import bpe, jaccard, line_dedup, mixing, quality
from rarefia.llm.common import Scratch, folders


def test_stages(spark, odd_docs, no_docs, tables):
    folder, docs = tables(documents=odd_docs), odd_docs
    steps = [quality.filter_quality, line_dedup.dedup_lines, jaccard.keep_one_of_each, mixing.mix_sources, bpe.code_digests]
    for (_, stage), step in zip(corpus_pipeline.STAGES, steps, strict=True):
        out = stage(spark, docs, folder)
        assert Counter(map(str, out.collect())) == Counter(map(str, step(docs).collect()))
        if step is not steps[-1]:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert Counter(map(str, corpus_pipeline.run(spark, folder).collect())) == Counter(map(str, docs.collect()))
    assert docs.count() > 5 and corpus_pipeline.run(spark, tables(documents=no_docs)).count() == 0


def test_nothing_is_left(spark, odd_docs, tables):
    """After a run only what its result reads is left of what the stages wrote, and no table in the catalog."""
    import os

    folder = tables(documents=odd_docs)
    corpus_pipeline.run(spark, folder).collect()
    with Scratch(spark) as scope:
        out = corpus_pipeline.run(spark, folder)
    holds = {d.rsplit("/", 1)[1] for d, _, names in os.walk(scope.folder.removeprefix("file:")) if any(n.endswith(".parquet") for n in names)}
    used = {f.rsplit("/", 1)[1] for f in folders(out)}
    assert holds == used and len(used) <= 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rarefia")]
    assert out.count() > 5
    scope.close()
    assert not os.path.exists(scope.folder.removeprefix("file:"))


def test_stages_share_no_state(spark, odd_docs):
    """A stage that was called for another table meanwhile leaves the first result whole."""
    for _, stage in corpus_pipeline.STAGES[:2]:
        want = Counter(map(str, stage(spark, odd_docs, "").collect()))
        first, second = stage(spark, odd_docs, ""), stage(spark, odd_docs.where("doc_id < 20"), "")
        assert Counter(map(str, first.collect())) == want and second.count() <= sum(want.values())


def test_workers_stay_small(spark, odd_docs):
    """What idle Python workers hold counts in the stages that follow: a word that was hashed isn't kept, and no task of the
    tokenizer's stage has two workers, the one's output being the other's input."""
    import tracemalloc

    text = " ".join(f"word{i}" for i in range(50_000))
    jaccard.shingles("a few words to load what is loaded once")
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        jaccard.shingles(text)
        assert tracemalloc.get_traced_memory()[0] - before < 1_000_000
    finally:
        tracemalloc.stop()

    seen = []

    def one_at_most(node, python=False):
        name = node.nodeName()
        python = python and "Exchange" not in name
        assert not (python and name == "MapInArrow")
        seen.append(name)
        for i in range(node.children().size()):
            one_at_most(node.children().apply(i), python or name == "MapInArrow")

    one_at_most(bpe.code_digests(odd_docs)._jdf.queryExecution().executedPlan().initialPlan())
    assert seen.count("MapInArrow") > 4
