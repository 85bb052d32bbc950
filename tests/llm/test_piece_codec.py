"""Pieces against the library itself."""

import hashlib
import random

import pytest

pytest.importorskip("pagewright.llm")

import public_tokenizers
import sentencepiece

from pagewright.llm import piece_codec, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "  ", "a", " the", "▁▁x", "a▁b", "\n\n\tabc", "日本語 テスト😀", "\0abc", "<s> </s> <0x41> <unk>", "x" * 5000, " " * 70_000 + "the", "\n" * 3000, " " * 31 + "\n" + " " * 47, "ab" * 4000, "é" * 900]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "the ▁an d", "etaoinshrdlu", "0123456789 .", "▁ a", "éàü日本ab ", "<>/= \"ab'", " ", "tionsgre "])
def test_encoding_is_the_librarys(model, library, letters):
    rng = random.Random(letters)
    for text in [*ODD, *("".join(rng.choices(letters, k=rng.randrange(1, 90))) for _ in range(400))]:
        ids = library.encode(text)
        assert model.encode(text)[0].tolist() == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_decoding_any_ids_is_the_librarys(model, library):
    rng = random.Random(6)
    for _ in range(8000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 300), 28705, rng.randrange(3)]) for _ in range(rng.randrange(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode([32000])


def test_slices_and_memory_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "SLICE", 11)
    monkeypatch.setattr(piece_codec, "MOST_KNOWN", 40)
    rng = random.Random(7)
    for text in ["".join(rng.choices("abe  \n日", k=300)) for _ in range(30)]:
        assert model.encode(text)[0].tolist() == library.encode(text)
    assert model.held <= 40
    texts = ["".join(rng.choices("abe  \n日", k=k)) for k in range(30)]
    assert [x.tolist() for x in model.encode(*texts)] == library.encode(texts)


def test_a_word_without_end(model, library):
    text = "".join(random.Random(3).choices("etaoinshr", k=60_000))
    assert model.encode(text)[0].tolist() == library.encode(text)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        piece_codec.PieceModel(str(tmp_path / "none.model"))


def test_table(spark, library):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (None, ""), (3, "no  end " * 9000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", ids int, n_tokens string")
    encoded = piece_codec.encode_texts(docs, PATH)
    got = sorted(map(tuple, piece_codec.decode_ids(encoded, PATH).collect()), key=str)
    assert got == sorted([(i, library.encode(t or ""), t or "") for i, t in rows], key=str)
    assert piece_codec.encode_texts(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    empty = piece_codec.digests(piece_codec.decode_ids(spark.createDataFrame([(4, None)], "doc_id long, ids array<int>"), PATH)).first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_query(spark, sf_dir, library):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids := library.encode(t)), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in docs)
    assert sorted(map(tuple, queries.op13_pieces(spark, sf_dir).collect())) == want
