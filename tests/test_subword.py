"""Subwords against the library of the vocabulary, offsets and exact round trips."""

import base64
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tagloom.operators.subword import SubwordEncoder, SubwordVocabulary, _code, decode_subwords, encode_subwords, merge
from tagloom.operators.vocab import EOS, SPECIALS

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return SubwordVocabulary.read(PATH)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(6)
    mixed = ["".join(rng.choice("ab'  \n\té漢🙂s9_-LDT:") for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*mixed, "", "x" * 3000, "ab" * 2000, " " * 999 + "a", "서울에서 <샀다~~> 10%", "🙂" * 500]


def test_ids_equal_those_of_the_library(vocab, library):
    encoder = SubwordEncoder(SubwordVocabulary(vocab.ranks, ()))
    for text in odd_texts():
        assert [i - len(SPECIALS) for i in encoder.encode(text, None)["ids"][:-1]] == library.encode_ordinary(text)


def test_merging_a_long_piece_takes_linear_time(vocab):
    piece = b"ab" * 100_000
    assert b"".join(merge(piece, vocab.ranks)) == piece


def test_reserved_tokens_are_never_split(vocab):
    coded = SubwordEncoder(vocab).encode("서울:LC10개:QT:QTx:Q", None)
    whole = [i for i in coded["ids"] if len(SPECIALS) <= i < vocab.first_rank]
    assert [vocab.reserved[i - len(SPECIALS)] for i in whole] == [":LC", ":QT", ":QT"]


def test_offsets(vocab):
    for text in odd_texts():
        coded = SubwordEncoder(vocab).encode(text, None)
        assert len(coded["ids"]) == len(coded["starts"]) == len(coded["ends"]) and coded["ids"][-1] == EOS
        covered = 0
        for start, end in zip(coded["starts"], coded["ends"]):
            assert start <= covered <= end or start == covered
            covered = end
        assert covered == len(text)
        raw = {i + vocab.first_rank: t for t, i in vocab.ranks.items()}
        for i, start, end in zip(*coded.values()):
            part = text[start:end].encode()
            assert i not in raw or raw[i] in part


@pytest.mark.parametrize("limit", [1, 2, 9, 90])
def test_truncation(vocab, limit):
    encoder = SubwordEncoder(vocab)
    for text in odd_texts():
        whole, cut = encoder.encode(text, None), encoder.encode(text, limit)
        assert cut["ids"] == whole["ids"][: limit - 1] + [EOS] if len(whole["ids"]) > limit else cut == whole
        assert len(cut["ids"]) <= limit and cut["ends"][-1] <= len(text)


def test_round_trip_in_tables(spark, vocab):
    rows = [(i, t) for i, t in enumerate([*odd_texts()[-40:], None, "a:PS b:LC"])]
    texts = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "'x' AS ids").repartition(3)
    coded = encode_subwords(texts, vocab, {"whole": ("text", None), "cut": ("text", 5)})
    assert coded.columns == ["row_id", "text", "ids", "whole", "cut"]
    flat = coded.selectExpr("row_id", "text", "whole.ids AS whole_ids", "cut.ids AS cut_ids", "cut.ends AS ends")
    back = decode_subwords(flat, vocab, {"again": "whole_ids", "part": "cut_ids"}).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.again == (r.text or "")
        kept = r.part.rstrip("�")
        assert (r.text or "").startswith(kept) and len(kept) in (r.ends[-1], r.ends[-1] - 1)


def test_unknown_and_special_ids_are_left_out(spark, vocab):
    rows = spark.createDataFrame([([0, 1, 2, 3, 10**9, -100],), (None,)], "ids array<int>")
    assert sorted(r.text for r in decode_subwords(rows, vocab, {"text": "ids"}).collect()) == ["", vocab.reserved[0]]


def test_a_vocabulary_must_cover_all_bytes(tmp_path):
    file = tmp_path / "few.txt"
    file.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no token for the bytes"):
        SubwordVocabulary.read(str(file))


def test_a_batch_of_long_texts_stays_small(vocab):
    """A few integers per id; Python objects for every id and offset took more than ten times that."""
    texts = pa.array(["word and number 123 " * 2_000, None, ""] * 40)
    encoder = SubwordEncoder(vocab)
    encoder.encode(texts[0].as_py(), None)
    tracemalloc.start()
    coded = _code(encoder, texts, None)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n_ids = len(coded.field("ids").flatten())
    assert n_ids > 300_000 and peak < 40 * n_ids
    assert coded[0].as_py() == encoder.encode(texts[0].as_py(), None) and coded[1].as_py()["ids"] == [EOS]
