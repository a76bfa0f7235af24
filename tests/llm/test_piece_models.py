"""Models with a normaliser, unigram scores, user-defined and unknown pieces, against the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from fathomline.llm import pieces, queries

PUBLIC = public_tokenizers.path(queries.PIECE_MODEL)
TEXT = st.text(alphabet=st.sampled_from(list("abehiorstu   .,\n\t12éé́ﬁｆｕＡ㍿①½™ﷺ​　한하漢😀~<>")) | st.characters(codec="utf-8"), max_size=40)


def made(unigram, rule="nmt_nfkc", trim=True, prefix=True, symbols=(), fallback=True):
    """A model of the public one's pieces, other in kind."""
    model = proto.ModelProto()
    with open(PUBLIC, "rb") as f:
        model.ParseFromString(f.read())
    rng = random.Random(7)
    rest = [p for p in model.pieces if fallback or p.type != proto.ModelProto.SentencePiece.BYTE]
    normal = [p for p in rest if p.type == proto.ModelProto.SentencePiece.NORMAL]
    if unigram:
        for p in normal:
            p.score = -rng.uniform(3, 13) / (1 + 0.1 * len(p.piece))  # no two paths weigh the same
    kept = {p.piece: p for p in rest}
    del model.pieces[:]
    model.pieces.extend(kept.values())
    for s in symbols:
        model.pieces.add(piece=s, score=0.0, type=proto.ModelProto.SentencePiece.USER_DEFINED)
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM if unigram else proto.TrainerSpec.BPE
    model.trainer_spec.byte_fallback = fallback
    spec = proto.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.CopyFrom(spec.normalizer_spec)
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = trim, prefix
    return model.SerializeToString()


KINDS = {
    "unigram": {"unigram": True},
    "unigram without bytes": {"unigram": True, "fallback": False},
    "unigram, spaces kept": {"unigram": True, "rule": "identity", "trim": False},
    "unigram, case folded": {"unigram": True, "rule": "nmt_nfkc_cf", "prefix": False},
    "pairs": {"unigram": False},
    "pairs with symbols": {"unigram": False, "symbols": ("<sep>", "ｆab")},
    "unigram with symbols": {"unigram": True, "symbols": ("<sep>", "<s")},
}


@pytest.fixture(scope="module", params=list(KINDS))
def pair(request, tmp_path_factory):
    path = tmp_path_factory.mktemp("models") / "model"
    path.write_bytes(made(**KINDS[request.param]))
    return pieces.Transducer(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))


@settings(max_examples=250, deadline=None)
@given(text=TEXT)
@example(text="  ﬁrst　 ｆｕｌｌ\tＡ é ")
@example(text="   ")
@example(text="a<sep>b <sep> c<sep>")
@example(text="漢漢 漢a漢.漢")
@example(text="the first <s of ｆab it")
def test_encoding_equals_the_library(pair, text):
    machine, library = pair
    ids = np.frombuffer(machine.encode(text), "<i4").tolist()
    assert ids == library.encode(text)
    assert machine.decode(ids) == library.decode(ids)


def test_a_very_long_text(pair):
    machine, library = pair
    rng = random.Random(3)
    text = " ".join(rng.choice(["ﬁne", "words", "ｆull", "漢字", "a", "…", "unbelievable"]) for _ in range(20_000))
    assert np.frombuffer(machine.encode(text), "<i4").tolist() == library.encode(text)


def test_a_unigram_model_on_a_table(spark, tmp_path):
    path = tmp_path / "model"
    path.write_bytes(made(unigram=True))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    docs = spark.createDataFrame([(1, "Ａ ﬁrst  text"), (2, None), (2, ""), (3, "Ａ ﬁrst  text")], "doc_id int, text string")
    for r in pieces.encode_decode(docs, str(path)).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
