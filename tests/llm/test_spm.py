import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fernloom.llm import spm
from tests.llm.util import TEXTS, documents

DATA = open(spm.DEFAULT_MODEL, "rb").read()
PEER = sentencepiece.SentencePieceProcessor(model_proto=DATA)


@pytest.fixture(scope="module")
def codec():
    return spm.Codec(DATA, 1)


def test_protobuf_reader_agrees_with_the_library():
    model = spm.parse_model(DATA)
    assert len(model.pieces) == PEER.get_piece_size()
    assert [t for t, _, _ in model.pieces] == [PEER.id_to_piece(i) for i in range(len(model.pieces))]
    assert all(abs(s - PEER.get_score(i)) < 1e-6 for i, (_, s, _) in enumerate(model.pieces))
    assert model.byte_fallback and model.model_type == spm.BPE and spm.chunks_are_independent(model)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the ▁ \n\té漢🤖<s>.0_"), max_size=60))
def test_parity_and_decode(text):
    codec = spm.Codec(DATA, 1) if not hasattr(test_parity_and_decode, "c") else test_parity_and_decode.c
    test_parity_and_decode.c = codec
    (ids,), (same,) = codec.encode([text])
    ids_list = np.frombuffer(ids, "<i4").tolist()
    assert ids_list == PEER.encode(text) and same
    assert codec.decode(ids) == PEER.decode(ids_list) == codec.tokenizer.decode(ids_list, skip_special_tokens=False) == text.replace("▁", " ")


def test_batches_small_cache_and_whole_texts_agree(codec):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "thing", "ing\n", "é", "", "zzzq", "1234"]) + rng.choice(["", "s", "漢"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    want = [PEER.encode(t) for t in texts]
    small = spm.Codec(DATA, 2, cached_chunks=5)
    whole = spm.Codec(DATA, 1)
    whole.chunked = False
    for c in (codec, small, whole):
        got = [c.encode(texts[i : i + 37]) for i in range(0, len(texts), 37)]
        assert [np.frombuffer(x, "<i4").tolist() for ids, _ in got for x in ids] == want
        assert all(s for _, same in got for s in same)


def test_difference_is_reported_and_the_tokenizers_ids_stay(codec):
    other = spm.Codec(DATA, 1)

    class Wrong:
        ids = [1]

    class Liar:
        @staticmethod
        def encode_batch_fast(texts, **_):
            return [Wrong() for _ in texts]

        @staticmethod
        def decode_batch(ids, **_):
            return ["hello"] * len(ids)

    other.tokenizer = Liar()
    (ids,), (same,) = other.encode(["hello world"])
    assert np.frombuffer(ids, "<i4").tolist() == [1, 1] and not same


def test_a_decoder_that_differs_clears_parity():
    other = spm.Codec(DATA, 1)
    real = other.tokenizer

    class Deaf:
        encode_batch_fast = real.encode_batch_fast

        @staticmethod
        def decode_batch(ids, **_):
            return ["" for _ in ids]

    other.tokenizer = Deaf()
    (ids,), (same,) = other.encode(["hello world"])
    assert np.frombuffer(ids, "<i4").tolist() == PEER.encode("hello world") and not same


def test_unigram_model_with_scores():
    def field(number, kind, value):
        if kind == 2:
            return spm_varint(number << 3 | 2) + spm_varint(len(value)) + value
        if kind == 5:
            return spm_varint(number << 3 | 5) + np.float32(value).tobytes()
        return spm_varint(number << 3) + spm_varint(value)

    def spm_varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    pieces = [("<unk>", 0.0, spm.UNKNOWN), ("▁a", -1.0, spm.NORMAL), ("▁ab", -1.5, spm.NORMAL), ("b", -3.0, spm.NORMAL), ("c", -2.0, spm.NORMAL), ("▁", -4.0, spm.NORMAL)]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, s) + field(3, 0, k)) for t, s, k in pieces)
    data += field(2, 2, field(3, 0, spm.UNIGRAM)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    model = spm.parse_model(data)
    assert model.model_type == spm.UNIGRAM and model.pieces == pieces
    tok, peer = spm.build(model), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("ab abc c", "a b", "abcab"):
        assert tok.encode(text, add_special_tokens=False).ids == peer.encode(text)
    # byte fallback: characters without a piece become their bytes, and come back
    bytes_ = [(f"<0x{b:02X}>", 0.0, spm.BYTE) for b in range(256)]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, s) + field(3, 0, k)) for t, s, k in [*pieces, *bytes_])
    data += field(2, 2, field(3, 0, spm.UNIGRAM) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    small, peer = spm.Codec(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert small.model.byte_fallback
    for text in ("ab abc c", "é", "a漢b 🤖", "xyz  c"):
        (ids,), (same,) = small.encode([text])
        assert np.frombuffer(ids, "<i4").tolist() == peer.encode(text) and same and small.decode(ids) == peer.decode(peer.encode(text))


def test_frames(spark):
    out = {r.doc_id: r for r in spm.encode(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        assert out[i].ids == PEER.encode(t or "") and out[i].decoded == (t or "") and out[i].parity
    assert spm.digests(spm.encode(documents(spark, []))).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert spm.digests(spm.encode(df)).distinct().count() == 1
