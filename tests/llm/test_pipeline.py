"""The pipeline against its stages done one by one with plain means."""

from __future__ import annotations

import corpus_pipeline
from usagelens.llm.common import FOLD_BYTES, table
from usagelens.llm.decontaminate import normalise
from usagelens.llm.toxicity import score_toxicity, train_toxicity

from .conftest import SF
from .test_dedup import brute_components


def test_pipeline_is_its_stages(spark):
    docs = table(spark, SF, "documents")
    toxic = {r.doc_id for r in score_toxicity(docs, train_toxicity(docs, table(spark, SF, "labels"))).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    best = {}
    for doc_id, text in rows:
        key = text.encode().translate(FOLD_BYTES)
        best[key] = max(best.get(key, doc_id), doc_id)
    rows = [(d, t) for d, t in rows if d in best.values()]
    component = {int(d): c for d, _, c in brute_components(rows)}
    items = [normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if component[d] == d and not any(i in normalise(t) for i in items)]
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d for d, _ in rows}


def test_stages_keep_columns_and_take_awkward_rows(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "tokenise"]
