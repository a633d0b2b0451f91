"""The registered opN queries over a small folder of tables, against brute force: rows, schema, folds and cuts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import DOCS
from test_classifiers import DE, EN, FR, brute_stats, text
from test_simhash import brute_components, brute_fp
from test_suffix import brute
from tidemark.llm import packing, queries, urls
from tokenizers import Tokenizer

BAD = [f"slur{c}{d}" for c in "abcd" for d in "xyz"]
URLS = [
    "http://casino-win.example.com/en/1", "https://garden.example.org/fr/7", "http://a.b.example.net/en/x?y#z", "HTTP://X.NET/EN/", "ftp://q.org/fr/", "x://example.com/de/", "x://notexample.com/de/",
    "x://sub.example.com/dex", "none", "", None, "://", "x://a.net#frag/en/", "x://A.Net", "a://b://c/d", "x://example.net/en/", "x://example.net/de/?q=/en/", "x://" + "long." * 4000 + "org/fr/",
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(260):
        lang, words = rnd.choice([("en", EN), ("de", DE), ("fr", FR)])
        good, toxic = int(rnd.random() < 0.7), int(rnd.random() < 0.3)
        t = text(rnd, words, rnd.randrange(15, 60)).capitalize() + "."
        if toxic:
            t += " " + " ".join(rnd.choice(BAD) for _ in range(3))
        if not good:
            t = t.replace(" ", "$$$ ")
        rows.append((i, t, lang, "hot" if i % 3 else f"s{i % 5}", len(t)))
        if i % 4:
            labels.append((i, good, toxic))
    passage = text(rnd, EN, 40)
    rows += [(300 + k, rows[k][1] + " " + passage, "en", "hot", 0) for k in range(12)]
    rows += [(400 + k, rows[k][1], rows[k][2], "hot", 0) for k in range(12)] + [(420, rows[0][1], "en", None, 0)]
    rows += [(500, None, "en", "hot", 0), (501, "", "en", "hot", 0), (502, "<|endoftext|> é " * 900, "en", "hot", 0), (503, " \n", None, "hot", 0)]
    vectors = [(k, [float(x) for x in rnd.choices([0, 0, 0, 1, 2], k=8)]) for k in range(60)]
    vectors += [(100, [1.0] * 10 + [0.0]), (101, [1.0] * 9 + [0.0, 1.0]), (102, [0.0] * 8)]
    pages = list(enumerate(URLS))
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    return d, rows, labels, vectors, pages


def _held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_op1(spark, corpus):
    d, rows, *_ = corpus
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op1_suffix_array_dedup(spark, d).collect()}
    for k, gone in brute([(r[0], r[1]) for r in rows], 100).items():
        raw = (rows[k][1] or "").encode()
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert got[rows[k][0]] == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op2(spark, corpus):
    d, rows, *_ = corpus
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, fill = {}, {}
    for r in queries.op2_best_fit_packing(spark, d).collect():
        got.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for i, body, *_ in rows:
        ids = t.encode(body or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, p in enumerate(sorted(got[i], key=lambda r: r.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())) and (k == 0 or p.length == 2048)
            at += p.length
            sizes.append(p.length)
        assert at == len(ids) and (len(ids) > 2048 or len(got[i]) == 1)
    for b in fill.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    x, n = np.unique(sizes, return_counts=True)
    assert len(fill) == packing.lower_bound(x, n, 2048)


def test_scores_and_folds(spark, corpus):
    d, rows, labels, *_ = corpus
    truth = {i: (q, t) for i, q, t in labels}
    for f, modulus, rest, cut, which in ((queries.op3_toxicity, 5, 0, 0.5, 1), (queries.op6_quality_classifier, 4, 2, 0.7, 0)):
        df = f(spark, d)
        assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        got = df.collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        assert all(r.held_out == _held(r.doc_id, modulus, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
        assert np.mean([r.predicted == truth[r.doc_id][which] for r in got if r.held_out and r.doc_id in truth]) > 0.9


def test_op4(spark, corpus):
    d, rows, *_ = corpus
    got = {r.doc_id: r for r in queries.op4_language_id(spark, d).collect()}
    lang = {r[0]: r[2] for r in rows if r[0] < 260}
    assert all(r.held_out == _held(i, 4, 2) and 0 <= r.score <= 1 for i, r in got.items()) and set(got) == {r[0] for r in rows}
    assert np.mean([got[i].lang_pred == lang[i] for i in lang if got[i].held_out]) > 0.9
    assert [got[i].lang_pred for i in (500, 501, 503)] == ["und"] * 3


def test_op5(spark, corpus):
    d, *_, pages = corpus
    model = urls.Model(urls.labelled_urls())
    got = {r.page_id: tuple(r)[1:5] for r in queries.op5_url_filter(spark, d).collect()}
    for i, u in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if model.blocked([host], [path])[0] else "allow")
        assert got[i] == (host, path, rule, verdict)


def test_op7_and_its_sql(spark, corpus):
    d, *_, vectors, _ = corpus
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet' WHERE len(embedding) = 8")
    spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) = 8").write.mode("overwrite").parquet(f"{d}/eight/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op7_embedding_near_dedup(spark, f"{d}/eight").select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == sorted(con.sql(queries.OP7_SQL).fetchall())
    links = {r.vec_id: r.n_links for r in queries.op7_embedding_near_dedup(spark, d).collect()}
    assert links[100] == links[101] == 1 and links[102] == 0  # exactly at the threshold; the zero vector


def test_op8_base_columns(spark, corpus):
    d, rows, *_ = corpus
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, d).collect()}
    for i, body, *_ in rows:
        want = brute_stats(body)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_op9_columns(spark, corpus):
    d, rows, *_ = corpus
    got = queries.op9_source_mixing(spark, d).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and all(0 <= r.mix_order < 1 and r.n_tokens >= 0 for r in got)
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert all(r.n_tokens == words[r.doc_id] for r in got)


def test_op10(spark, corpus):
    d, rows, *_ = corpus
    rows = sorted(rows)
    fps = [brute_fp(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, d).collect()}
    assert got == {r[0]: (f"{f:016x}", want[r[0]]) for r, f in zip(rows, fps)}


def _by_sql(spark, corpus, name):
    d = corpus[0]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    found = queries.queries()[name](spark, d)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
    return found


def test_op11(spark, corpus):
    found = _by_sql(spark, corpus, "op11_substring_dedup").collect()
    long = {r[0] for r in corpus[1] if 400 <= r[0] < 420 and len(r[1].split()) >= 50}  # copies that have a window
    assert long and long <= {r.doc_id for r in found if r.n_removed}


def test_op13(spark, corpus):
    assert _by_sql(spark, corpus, "op13_fill_in_middle").where("restored_sha256 <> ''").count() == len(corpus[1])


def test_op12(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(64)]) for i in range(200)] + [(300, None), (301, [1.0] * 63), (302, [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert _by_sql(spark, (str(tmp_path),), "op12_centroid_clustering").count() == 200


def test_op9_places_by_brute_force(spark, corpus):
    """Weights, epochs and the interleaving of the mixture, recomputed from the documents."""
    d, rows, *_ = corpus
    got = queries.op9_source_mixing(spark, d).collect()
    size = {}
    for i, t, _, s, _n in rows:
        size.setdefault(s or "", []).append((i, len((t or "").split())))
    share = {s: sum(n for _, n in v) for s, v in size.items()}
    total = sum(share.values())
    low, high = 0.0, 1.0
    power = lambda a: {s: (n / total) ** a for s, n in share.items() if n}
    spread = lambda a: max(power(a)[s] / share[s] for s in power(a)) / min(power(a)[s] / share[s] for s in power(a))
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if spread(mid) <= 1.5 else (mid, high)
    w = power(high)
    budget = max(share[s] * sum(w.values()) / w[s] for s in w)
    epochs = {}
    for r in got:
        epochs.setdefault((r.source or "", r.doc_id), []).append(r.epoch)
    for s, docs in size.items():
        aim = budget * w[s] / sum(w.values()) / share[s] if share[s] else 1.0
        for i, _ in docs:
            many = len([x for x, _ in docs if x == i])
            seen = sorted(epochs[s, i])
            assert seen == sorted(list(range(len(seen) // many)) * many) and int(aim + 1e-9) <= len(seen) // many <= int(aim) + 1
        placed = sum(n * (len(epochs[s, i]) // len([x for x, _ in docs if x == i])) for i, n in docs)
        assert placed <= aim * share[s] + 1e-6 and placed >= aim * share[s] - max((n for _, n in docs), default=0) or not share[s]
    for s in size:  # copies of epoch e of a source of c copies lie in [e / c, (e + 1) / c)
        for r in got:
            if (r.source or "") == s:
                c = len(epochs[s, r.doc_id]) // len([x for x, _ in size[s] if x == r.doc_id])
                assert r.epoch / c <= r.mix_order < (r.epoch + 1) / c
