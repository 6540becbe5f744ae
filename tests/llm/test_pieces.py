import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from caretrace.llm.pieces import Encoder, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(" ab\n\t▁é日😀　<>0/s12") for _ in range(rng.randrange(40))) for _ in range(1500)]
    return ["", " ", "  a  b ", "▁x ▁ y", "a\x00b", "tab\t\tx  ", "x" * 20000, "<s> </s> <unk> <0x41>", *made]


def test_same_ids_and_text_as_the_library():
    ours, library = Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts():
        ids, begins, ends = ours.encode(t)
        want = library.encode(t, add_eos=True)
        assert ids.tolist() == want and ours.decode(ids) == library.decode(want)
        assert (begins <= ends).all() and (np.diff(begins) >= 0).all() and ends[-1] <= len(t.encode())


def test_offsets_cover_the_text():
    ours = Encoder(MODEL)
    data = "Ein schöner Tag 日本 12".encode()
    ids, begins, ends = ours.encode(data.decode())
    assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data


@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_map(tmp_path, squeeze):
    """The same model with a compiled character map: normal form, ids and spans."""
    try:
        rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        compiled = model_pb2.ModelProto()
        compiled.ParseFromString(rules.serialized_model_proto())
    except (AttributeError, RuntimeError, OSError) as missing:
        pytest.skip(str(missing))
    proto = model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.CopyFrom(compiled.normalizer_spec)
    assert len(proto.normalizer_spec.precompiled_charsmap) > 1000
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    ours, library = Encoder(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for t in [*texts(), "ﬁne ①② ｶﾞ Å Ａ㍿ é", "  ﬁ  "]:
        ids, begins, ends = ours.encode(t)
        assert ids.tolist() == library.encode(t, add_eos=True)
        assert (begins <= ends).all() and ends[-1] <= len(t.encode())


def test_documents(make_docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode_documents(make_docs(odd_rows), MODEL).collect()
    want = [(str(i), tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or ""))) for i, t in odd_rows]
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in got) == sorted(want)
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in got)
    assert encode_documents(make_docs([]), MODEL).collect() == []
