"""The stages keep columns whose names the operators use inside."""

import corpus_pipeline
from corpus_fixtures import make_docs
from test_pipeline import _corpus

OWN = (
    "sim_row sim_0 sim_1 sim_2 sim_3 node place first own_lang_pred own_score own_ambiguous mix_source mix_key mix_block mix_tokens mix_id mix_row mix_epoch mix_order mix_copies "
    "whole part room all_in last_key tokens before upto label carry_0 carry_1 MIX_KEY_2 id row tie rank"
).split()


def test_own_names_come_through_every_stage(spark):
    docs = make_docs(spark, _corpus())
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in OWN))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in OWN)


def test_own_names_in_other_letters(spark):
    docs = make_docs(spark, _corpus()).selectExpr("*", "doc_id AS SIM_ROW", "doc_id AS Mix_Order", "doc_id AS OWN_SCORE")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns and all(r[c] == r.doc_id for r in kept.collect() for c in ("SIM_ROW", "Mix_Order", "OWN_SCORE"))
