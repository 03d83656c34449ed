"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline
from canopyflux.llm import pii, quality
from tests.helpers import SF
from tests.llm.test_dedup import brute, brute_classes
from tests.llm.test_texts import check_packing

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    rules = quality.BASE_RULES + quality.RULES

    docs = steps["quality_rules"](spark, docs, SF)
    rows = {i: t for i, t in rows.items() if quality.first_rejection(rules, quality.Text(t or "")) is None}
    assert docs.columns == DOCUMENTS and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = steps["exact_dedup"](spark, docs, SF)
    rows = {i: rows[i] for i, _, _, kept, _ in brute(list(rows.items())) if kept}
    assert docs.columns == DOCUMENTS and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = steps["simhash_near_dedup"](spark, docs, SF)
    rows = {i: rows[i] for i, _, c in brute_classes(list(rows.items())) if i == c}
    assert docs.columns == DOCUMENTS and {r.doc_id: r.text for r in docs.collect()} == rows

    docs = steps["pii"](spark, docs, SF)
    rows = {i: pii.masked(t, pii.all_spans(pii.model(), [t])[0][1]) for i, t in rows.items()}
    assert docs.columns == DOCUMENTS and {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in rows.items()}

    check_packing(list(rows.items()), corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    check_packing(list(rows.items()), corpus_pipeline.run(spark, SF).collect())
