"""Packing of texts that are one very long run."""

import zlib

import numpy as np
import pytest

from folioflow.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_long_runs_have_the_ids_of_the_tokenizer_file(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" * 200_000, " \n" * 300_000 + "end", "\t" * 1_000_000 + "x", "<|endoftext|>" * 3]
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.append(np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4") for t in texts]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for doc, exp in enumerate(ids):
        at = 0
        for r in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(exp))
            assert r.ids_crc32 == zlib.crc32(exp[at : at + r.length].tobytes())
            at += r.length
        assert at == len(exp)
