from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fathomline.llm import queries, token_files
from fathomline.llm.common import new_folder

BPE = public_tokenizers.path(queries.BPE_VOCABULARY)
TEXTS = ["x<|endoftext|> y", "<|endoftext|>", "a <|endoftext|>\n<|endoftext|> b", "no token here", "<|endoftext", "", "plain\ntext <|endoftext|>"]


def test_added_tokens_equal_a_fresh_tokenizer():
    plain, codec = Tokenizer.from_file(BPE), token_files.encoder(BPE)
    want = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [np.frombuffer(b, codec.kind).tolist() for b in codec.encode(TEXTS)] == want
    assert [plain.token_to_id("<|endoftext|>") in ids for ids in want] == [True, True, True, False, False, False, True]


def test_token_files_with_added_tokens(spark):
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), folder, BPE, length=16, shards=2)
    plain, at = Tokenizer.from_file(BPE), 0
    for (doc, text), row in zip(enumerate(TEXTS), sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r.start), strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert tuple(row) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
