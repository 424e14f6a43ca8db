import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from sentencepiece import sentencepiece_model_pb2

from querylume.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.PieceEncoder(PATH)
TEXT = st.text(st.sampled_from("abcthe .,\n\t 1é▁漢\U0001f600'-śABñ"), max_size=60)


def ids(text):
    return np.frombuffer(MODEL.encode([text])[0], MODEL.dtype).tolist()


def slow_best(text):
    """The best sum of scores over all segmentations, by trying every piece."""
    scores = {}
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            scores[p.piece] = p.score
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max(
            best[start] + (scores[part] if (part := text[start:end]) in scores else MODEL.unknown_score)
            for start in range(end) if text[start:end] in scores or start == end - 1))
    return best[-1], scores


@pytest.fixture(scope="module")
def rescored(tmp_path_factory):
    """The same pieces for the library's own Viterbi, which works in single precision:
    the scores that stand for "never" are made small enough for it."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)
    path = str(tmp_path_factory.mktemp("pieces") / "rescored.model")
    with open(path, "wb") as file:
        file.write(proto.SerializeToString())
    return path


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_best_score_and_round_trip(text):
    got = ids(text)
    want, scores = slow_best(MODEL.normalised(text))
    spelt = [MODEL.pieces[i] for i in got]
    known = sum(scores[p] for p in spelt if p in scores)
    n_bytes = sum(p not in scores for p in spelt)
    if not n_bytes:
        assert known == want
    assert MODEL.decode(MODEL.encode([text])[0]) == text.replace("▁", " ")


def test_same_pieces_as_the_library(rescored):
    library = sentencepiece.SentencePieceProcessor(model_file=rescored)
    model = pieces.PieceEncoder(rescored)
    rng = random.Random(4)
    words = "the anding ereou Straße naïve 123 4.5, e.g. don't ciónes ¿qué? 漢字 😀 x\ny a\tb THE... mother-in-law".split(" ")
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        got = np.frombuffer(model.encode([text])[0], model.dtype).tolist()
        assert got == library.encode(text), text


def test_chunks_change_nothing():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["the", " ", "  ", ".", ",", "\n", "é", "ab", "漢", "."]) for _ in range(40))
        whole = MODEL.segment(MODEL.normalised(text)) if text else []
        assert ids(text) == whole


def test_rows(spark, make_docs):
    texts = [None, "", " ", "two  spaces", "two  spaces", "long " * 40000, "x" * 5000]
    docs = make_docs(*texts)
    rows = {r.doc_id: r for r in pieces.round_trip(docs, PATH).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = ids(text) if text else []
        assert rows[i].n_pieces == len(want)
        assert rows[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    coded = pieces.encoded(docs, PATH)
    assert {r.doc_id: r.pieces for r in coded.collect()}[4] == ids("two  spaces")
    assert all(r.restored for r in coded.collect())
    back = {r.doc_id: r for r in pieces.decoded(coded, PATH).collect()}
    assert {i: r.decoded for i, r in back.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(back[i].ids_crc32 == rows[i].ids_crc32 and back[i].n_pieces == rows[i].n_pieces for i in rows)
    assert pieces.round_trip(docs.limit(0), PATH).collect() == []
