from collections import Counter

import pytest

import corpus_pipeline
from shardflow.llm.common import keep
from shardflow.llm.mixing import mix
from shardflow.llm.queries import VOCABULARY
from shardflow.llm.similar import similar_groups
from shardflow.llm.toxicity import toxicity
from tests.conftest import SMALL
from tests.llm import cases
from tests.llm import test_exact_dedup as exact
from tests.llm import test_packing as packing
from tests.llm import test_similar as near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, written and read again, as the driver does."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SMALL), name)
        out.append((name, docs))
    return dict(out)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS
        assert stages[name].count() > 0


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    want = Counter(r["doc_id"] for r in toxicity(stages["documents"], labels).where("predicted = 0").collect())
    assert want == Counter(r["doc_id"] for r in stages["toxicity"].collect())


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_exact_copies_go(stages):
    want = sorted(r[0] for r in exact.brute(rows(stages["toxicity"])) if r[3])
    assert want == sorted(r["doc_id"] for r in stages["exact_dedup"].collect())


def test_near_copies_go(stages):
    """Five words, similarity 0.8: by all pairs, no two that stay are similar, and what goes is linked to one that stays."""
    before = [r[:2] for r in rows(stages["exact_dedup"])]
    groups = [tuple(r) for r in similar_groups(stages["exact_dedup"]).collect()]
    near.check(before, groups)
    assert sorted(i for i, g in groups if i == g) == sorted(r["doc_id"] for r in stages["simhash"].collect())


def test_mix(stages):
    before = {r["doc_id"]: r for r in stages["simhash"].collect()}
    want = {r["doc_id"]: r["copies"] for r in mix(stages["simhash"]).collect() if r["copies"]}
    assert want == dict(Counter(r["doc_id"] for r in stages["mixing"].collect()))
    assert all(tuple(r) == tuple(before[r["doc_id"]]) for r in stages["mixing"].collect())


def test_sequences(stages):
    packing.check([r[:2] for r in rows(stages["mixing"])], stages["packing"].collect())


def test_whole_run(spark, stages):
    by = lambda d: sorted(tuple(r)[:5] for r in d.collect())
    assert by(corpus_pipeline.run(spark, SMALL)) == by(stages["packing"])


@pytest.mark.parametrize("given", [[], None])
def test_empty_and_awkward_documents(spark, given):
    docs = cases.docs(spark, given)
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SMALL), name)
    assert bool(docs.count()) == (given is None)
    assert VOCABULARY.endswith("word_bpe_49k.json")


def test_extra_columns_pass_through(spark):
    docs = cases.clashing(cases.docs(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.collect()


def test_stages_begin_with_free_heap(spark, monkeypatch):
    """Each stage asks the executors (here: this JVM) for a full collection before its own work."""
    docs, work = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), []
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    for name in ("drop_toxic", "drop_exact_duplicates", "drop_similar", "mixed", "pack"):
        monkeypatch.setattr(corpus_pipeline, name, lambda df, *a: work.append(full()) or df)
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, SMALL)
        assert work[-1] > before
    assert len(work) == len(corpus_pipeline.STAGES)
