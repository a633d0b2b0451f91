import random

import corpus_pipeline
from corpus_fixtures import make_docs
from test_simhash import _shingles
from test_suffix import brute
from tidemark.llm import mixing, packing


def _corpus():
    rnd = random.Random(8)
    words = {"en": ["the", "and", "with", "from", "house", "water", "light"], "de": ["der", "und", "mit", "von", "haus", "wasser", "licht"]}
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rnd.choice(words[lang]) + rnd.choice(["", "", "s", "en", "ing"]) for _ in range(rnd.randrange(40, 120)))
        rows.append((i, text, lang, "hot" if i % 4 else "small"))
    passage = " ".join(rnd.choice(words["en"]) + str(k) for k in range(40))
    rows += [(60 + k, rows[k][1] + " " + passage, "en", "hot") for k in range(0, 12, 4)]
    rows += [(70 + k, rows[k][1], rows[k][2], "small") for k in range(5)]
    rows += [(80, "", "en", "hot"), (81, None, "en", "hot"), (82, "12 34 !!", "de", "hot")]
    return rows


def test_stages_against_brute_force(spark):
    docs = make_docs(spark, _corpus(), extra=True)
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    told = steps["language_id"](spark, docs, "")
    assert told.columns == columns
    assert {r.doc_id for r in told.collect()} == set(rows) - {80, 81, 82}

    firsts = steps["simhash_near_dedup"](spark, told, "")
    assert firsts.columns == columns
    ids = sorted(set(rows) - {80, 81, 82})
    sets = {i: _shingles(rows[i].text) for i in ids}
    like = {i: [j for j in ids if len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])] for i in ids}
    assert sorted(r.doc_id for r in firsts.collect()) == sorted(i for i in ids if min(like[i]) == i)

    cut = steps["suffix_array_dedup"](spark, firsts, "")
    assert cut.columns == columns
    left = [(i, rows[i].text) for i in ids if min(like[i]) == i]
    want = {}
    for k, gone in brute(left, 100).items():
        kept = bytes(x for x, g in zip(left[k][1].encode(), gone) if not g).decode(errors="ignore")
        if kept:
            want[left[k][0]] = kept
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) and r.source == rows[r.doc_id].source and r.lang == rows[r.doc_id].lang for r in got)

    mixed = steps["source_mixing"](spark, cut, "")
    assert mixed.columns == columns
    assert {r.doc_id for r in mixed.collect()} == set(want)

    packed = steps["best_fit_packing"](spark, mixed, "").collect()
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert {r.doc_id for r in packed} == set(want) and max(fill.values()) <= packing.CAPACITY


def test_run_writes_and_rereads_each_stage(spark, tmp_path):
    make_docs(spark, _corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 50 and set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_empty_corpus(spark):
    docs = make_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert mixing.exponent({}, 1.5) == 1.0


def test_run_leaves_no_table_but_its_result(spark, tmp_path, monkeypatch):
    from tidemark.llm import scratch

    make_docs(spark, _corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    base = tmp_path / "shared"
    monkeypatch.setattr(scratch, "base", lambda spark: f"file://{base}")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [p.name.rsplit("-", 1)[0] for p in (base / "tidemark").iterdir()] == ["best_fit_packing"] and out.count() > 50
