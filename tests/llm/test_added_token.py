"""Ids of op2 and the pipeline against the unmodified tokenizer file, whose added token is found in plain text."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from corpus_fixtures import make_docs
from tidemark.llm import kernel, queries
from tidemark.llm.tokens import Encoder
from tokenizers import Tokenizer

TEXTS = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n\n b", "x<|endoftext|", "é <|endoftext|>日本", "no such token", ""]


def _want():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


def test_encoder_finds_the_added_token():
    assert Encoder(added=True).encode(*kernel.flat(pa.array(TEXTS))) == _want()
    assert 50256 in _want()[0]


def test_op2_and_the_pipeline_give_the_file_s_ids(spark, tmp_path):
    docs = make_docs(spark, list(enumerate(TEXTS)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(_want())}
    for got in (queries.op2_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in got.collect()} == want
