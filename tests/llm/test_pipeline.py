"""The pipeline's stages one after another, each decision checked on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, simhash, toxicity
from lodestone.llm.common import stored, table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, small), "test")
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.op5_toxicity(before, table(spark, small, "labels"))
            assert ids == {r.doc_id for r in scores.where("predicted = 0").collect()}
        elif name.startswith("SimHash"):
            assert ids == {r.component_id for r in simhash.op3_simhash(before).collect()}
        elif name.startswith("benchmark"):
            leaks = {r.doc_id for r in decontaminate.op8_decontaminate(before, table(spark, small, "benchmark")).collect()}
            assert ids == {r.doc_id for r in before.select("doc_id").collect()} - leaks
        else:
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        kept.append(docs.count())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.count() == kept[-1]
    starts = [(r.start, r.n_tokens) for r in out.orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert len(corpus_pipeline.STAGES) == 5
