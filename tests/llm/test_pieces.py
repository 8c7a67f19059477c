from __future__ import annotations

import hashlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from vecloom.llm import pieces

TEXTS = ["", " ", "a", "Hello  world", "\u2581x \u2581", "déjà vu\n\nline", "\U0001f600 smile \x00 zero", "ﬁ ½ Ａ", "<s> </s> <unk>", "x" * 5000, "  lead and trail  "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_ids_and_texts_are_the_librarys(library):
    tool = pieces.PieceCodec(pieces.model_path())
    for text, (ids, ends) in zip(TEXTS, tool.encode(TEXTS)):
        assert ids == library.encode(text)
        assert tool.decode([ids]) == [library.decode(ids)]
        data = text.encode()
        assert len(ends) == len(ids) and (np.diff(ends) >= 0).all()
        assert (ends[-1] if len(ends) else 0) == len(data)


def test_spans_spell_the_pieces(library):
    tool = pieces.PieceCodec(pieces.model_path())
    text = "The quick brown fox; naïve café"
    ids, ends = tool.encode([text])[0]
    data, start = text.encode(), 0
    for i, end in zip(ids, ends):
        piece = library.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert data[start:end].decode().replace(" ", "\u2581") in (piece, piece.lstrip("\u2581"))
        start = end


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [True, False])
def test_normaliser_with_compiled_map(rule, extra):
    """The library's own normaliser is the brute-force version: equal text and equal alignment."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=extra)
    model = pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    spec = model.normalizer_spec
    tool = pieces.Normalizer(spec)
    texts = TEXTS + ["ｶﾞ ＡＢＣ １２３", "A\u0301 e\u0301\u0302", "a\u200b\u00a0b", "  ", "\u3000x\u3000", "㍿ ﷺ"]
    for text in texts:
        normal, source = tool.normalize(text.encode())
        want = library.normalize(text)
        if not spec.escape_whitespaces and not spec.add_dummy_prefix:
            assert normal.decode() == want
        else:
            assert normal.decode().replace("\u2581", " ").strip(" ") == want.replace("\u2581", " ").strip(" ")
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and (len(source) == 1 or source[-1] <= len(text.encode()))


def test_alignment_of_a_ligature():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    model = pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.escape_whitespaces = False
    normal, source = pieces.Normalizer(model.normalizer_spec).normalize("aﬁb".encode())
    assert normal == b"afib" and source.tolist() == [0, 1, 1, 4, 5]


def test_query_rows(spark, odd_docs, no_docs, library):
    got = pieces.round_trip(odd_docs, with_ids=True).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((library.encode(t), sha(",".join(map(str, library.encode(t)))), sha(library.decode(library.encode(t)))) for t in texts)
    assert sorted((r["ids"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert pieces.round_trip(no_docs).count() == 0


def test_encode_and_decode_tables(docs, library):
    encoded = pieces.encode(docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    for r in docs.collect():
        assert back[r["doc_id"]] == library.decode(library.encode(r["text"] or ""))
