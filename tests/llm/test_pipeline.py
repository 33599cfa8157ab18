"""The corpus pipeline against its stages in plain Python."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from stowage.llm import common, labelled, near_dedup, nbsvm, toxicity
from tests.llm.test_operators import SF, packed_ok


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in nbsvm.quality(spark, docs, SF, ["doc_id"]).collect() if r.predicted == 1}
    toxic = {r.doc_id for r in toxicity.tag(docs, toxicity.model_of(spark, SF), ["doc_id"]).collect() if r.predicted == 1}
    left = good - toxic
    classes = {r.doc_id: r.class_id for r in near_dedup.classes(docs.where(docs.doc_id.isin(sorted(left)))).collect()}
    kept = {i for i, c in classes.items() if i == c}
    from tokenizers import Tokenizer

    from stowage.llm.tokens import default_tokenizer

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept and 0 < len(kept) < len(left) < len(text)
    packed_ok(rows, {i: text[i] for i in kept}, Tokenizer.from_file(default_tokenizer()))


def test_stages_with_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    odd = spark.createDataFrame([(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 1.0), (2, "x y", "en", None, 3, 1.0), (2, "x y", "en", None, 3, 1.0)], schema)
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == corpus_pipeline.COLUMNS and got.count() <= docs.count()
        assert corpus_pipeline.packed(spark, docs, SF).count() >= docs.count()
    assert len(corpus_pipeline.near_duplicates(spark, odd, SF).collect()) == 2


def test_workers_get_bounded_batches(spark):
    def sizes(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "size"])

    docs = spark.range(0, 2400, 1, 1).selectExpr("id", "repeat('x', 5000) AS text")  # 12 MB in one task, and no 10,000 rows
    got = common.mapped(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 2400 and max(r.size for r in got) < 5_000_000


def test_workers_give_back_what_other_stages_kept(monkeypatch):
    given = []
    monkeypatch.setattr(common, "ended", lambda: given.append(1))
    monkeypatch.setattr(common, "CACHES", {"a": [{1: 2}, {}], "b": [{3: 4}]})
    common.begun("a")
    assert common.CACHES == {"a": [{1: 2}, {}], "b": [{}]} and given == [1]
    common.begun("a")  # nothing of others is left
    assert common.CACHES["a"] == [{1: 2}, {}] and given == [1]


def test_the_drivers_fit_holds_short_row_numbers(monkeypatch):
    seen, real = [], toxicity.lexicon
    monkeypatch.setattr(toxicity, "lexicon", lambda doc, feature, toxic: seen.append(doc.itemsize) or real(doc, feature, toxic))
    toxicity.fit([(f"word{i} vile" if i % 2 else f"word{i} kind", i % 2) for i in range(40)])
    assert seen == [4]


def test_the_drivers_fit_holds_one_part_of_the_sample(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary, 25_000)) + (" vilest" if i % 2 else " kindest") for i in range(32)]  # 200 KB each
    monkeypatch.setattr(toxicity, "in_parts", lambda texts: labelled.in_parts(texts, 100_000))
    monkeypatch.setattr(toxicity, "TOGETHER", 200_000, raising=False)

    def peak(n):
        tracemalloc.start()
        try:
            model = toxicity.fit([(t, i % 2) for i, t in enumerate(texts[:n])])
            return model, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (_, few), (model, many) = peak(8), peak(32)
    assert many < 1.5 * few
    monkeypatch.setattr(toxicity, "in_parts", lambda texts: [texts])
    whole, _ = peak(32)
    assert (whole.known == model.known).all() and np.allclose(whole.weights, model.weights) and np.allclose(whole.curve, model.curve)
