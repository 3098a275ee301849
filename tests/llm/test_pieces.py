"""SentencePiece encoding and decoding against the library, with long texts, other ids and models that are refused."""

import random
import time

import public_tokenizers
import pytest
import sentencepiece
from cases import DOCS, both, frame, same
from test_contracts import docs_of, sha

from cohortloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces._model(pieces._file(PATH))


def test_op11(spark, library):
    for df in both(spark):
        want = []
        for d, x in docs_of(df):
            ids = library.encode(x, add_eos=True)
            want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
        same(pieces.piece_digests(df, PATH), want)


def test_encode_and_decode_apart(spark, library):
    ids = pieces.encode(frame(spark), PATH, end=False)
    got = pieces.decode(ids, PATH).select("text", "ids", "decoded").collect()
    assert all(r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"]) for r in got)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [2]), (4, [203, 1, 151]), (5, [0, 0])], "k long, ids array<int>")
    want = {1: "", 2: "", 3: "", 4: library.decode([203, 1, 151]), 5: library.decode([0, 0])}
    assert {r["k"]: r["decoded"] for r in pieces.decode(odd, PATH).collect()} == want


def test_texts_of_all_kinds(model, library):
    r = random.Random(7)
    parts = ["a", "e", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "😀", "ü", "中", "の", "1", "23", "<s>", "</s>", "<0x41>", "\x00", "==", "--", "...", "tion", "�", "́", "aaaa", " " * 17, "'s", "ß#"]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(4000)]
    texts += ["".join(r.choices([library.id_to_piece(i) for i in range(259, 32000)], k=r.randrange(1, 12))) for _ in range(2000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x800), r.randrange(0x3000, 0xD7FF), r.randrange(0xE000, 0x11000)])) for _ in range(r.randrange(40))) for _ in range(2000)]
    for x in texts:
        ids = library.encode(x)
        assert model.encode(x) == ids, x
        assert model.decode(ids) == library.decode(ids), x
    assert model.encode_all(texts, [2]).to_pylist() == [i + [2] for i in library.encode(texts)]


def test_ids_that_no_text_has(model, library):
    r = random.Random(8)
    for _ in range(20_000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(32000), 0, 1, 2, 28705, 259]) for _ in range(r.randrange(8))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["x" * (1 << 20), "中" * (1 << 18), " " * (1 << 20), "".join(random.Random(3).choices("abcdefghij", k=1 << 20)), "a b\n" * (1 << 18), "".join(random.Random(4).choices("0123456789abcdef", k=1 << 20))])
def test_a_megabyte(spark, library, text):
    start = time.perf_counter()
    row = pieces.round_trip(spark.createDataFrame([(1, text, None, None, None)], DOCS), PATH).first()
    assert time.perf_counter() - start < 60
    assert row["decoded"] == text and row["ids"][-1] == 2
    cut = text[: 1 << 14]
    assert pieces._model(pieces._file(PATH)).encode(cut) == library.encode(cut)


def test_other_models_are_refused():
    data = pieces._file(PATH)
    piece = b"\x0a\x04\x0a\x02zz"
    with pytest.raises(ValueError, match="user"):
        pieces.PieceModel(data + b"\x0a\x06\x0a\x02zz\x18\x04")
    with pytest.raises(ValueError, match="normaliser"):
        pieces.PieceModel(data + b"\x1a\x02\x20\x01")
    with pytest.raises(ValueError, match="kind BPE"):
        pieces.PieceModel(piece + b"\x12\x02\x18\x01")
