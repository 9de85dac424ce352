"""Special tokens in texts get the ids that tokenizers gives them by default."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing

from .cases import frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y", "é <|endoftext|>\n\n b", "<|endoftext|", "<|ENDOFTEXT|>", " <|endoftext|> " * 40]


def test_ids_equal_the_library_at_its_defaults(monkeypatch):
    slow, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, public_tokenizers.PATTERN, special=True)
    assert encode(CASES[0]).tolist() == [64, 220, 50256, 275]
    for size in (1 << 18, 50):
        monkeypatch.setattr(packing, "PART", size)
        for text in CASES + [t or "" for _, t in texts()]:
            assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_the_fallback_does_alike():
    class Broken:
        def encode_to_numpy(self, *_, **__):
            raise ValueError

    slow, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, public_tokenizers.PATTERN, special=True)
    encode.fast = Broken()
    assert all(encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in CASES)


def test_the_query_and_the_pipeline_take_them(spark, tmp_path):
    slow = Tokenizer.from_file(PATH)
    docs = frame(spark, list(enumerate(CASES)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (packing.op1_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        for r in rows.collect():
            ids = slow.encode(CASES[r.doc_id], add_special_tokens=False).ids + [0]
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
