import math
import random
from itertools import combinations

import public_tokenizers
import pytest
import sentencepiece
from frames import clashing, frame, odd_rows, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.llm import pieces
from ratelens.llm.pieces import BLANK, Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_and_come_back(text):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = Pieces.load()
    if BLANK not in text:
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == text


def test_prose_long_words_and_byte_pieces(library):
    rng = random.Random(1)
    model = Pieces.load()
    for text in (*(sentence(rng, k, 200) for k in ("en", "de", "es")), "aaaa" * 500, "ab" * 700, "🙂" * 40 + "x", "a  b   c\n\n\td ", "<s> </s> <0x41>"):
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == text


def test_unigram_path_is_the_best_of_all(library):
    rng = random.Random(2)
    names = [BLANK, "a", "b", "c", "ab", "bc", "abc", BLANK + "a", BLANK + "ab", "ca", "cab", "aa"]
    all_pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), *names]
    for _ in range(40):
        scores = [0.0] * 259 + [math.log(rng.random()) for _ in names]
        model = Pieces(all_pieces, scores, "unigram")
        score = dict(zip(names, scores[259:]))
        text = "".join(rng.choice("abc") for _ in range(9))
        marked = BLANK + text
        ways = [
            [marked[i:j] for i, j in zip((0, *cuts), (*cuts, len(marked)))]
            for n in range(len(marked))
            for cuts in combinations(range(1, len(marked)), n)
        ]
        best = max(sum(score[p] for p in parts) for parts in ways if all(p in score for p in parts))
        ids = model.encode(text)
        assert abs(sum(scores[i] for i in ids) - best) < 1e-9 and model.decode(ids) == text


def test_frames(spark):
    docs = clashing(frame(spark, odd_rows())).withColumn("IDS", F.lit("old"))
    coded = pieces.with_pieces(docs).collect()
    assert len(coded) == len(odd_rows())
    for r in coded:
        assert r["decoded"] == (r["text"] or "") and r["n_ids"] == len(r["ids"])
    assert pieces.with_pieces(docs.where(F.lit(False))).count() == 0
    assert Pieces.load().decode(Pieces.load().encode(f"a{BLANK}b")) == "a b"


def test_neighbours_and_memory_equal_the_definition(library, monkeypatch):
    rng = random.Random(7)
    model = Pieces.load()
    names = [model.pieces[i] for i in model.ids.values()]
    for _ in range(4000):
        left, right = rng.choice(names), rng.choice(names)
        assert model._stay_apart(left, right) == (model._merged(left + right) == [left, right])
    # With scores in no order a part may come after its whole: the definition decides.
    odd = ["a", "b", "ab", "aba", "ba", "bab", "abab", "aa", "bb"]
    for seed in range(30):
        shuffled = random.Random(seed).sample(range(len(odd)), len(odd))
        small = Pieces(odd, [-float(x) for x in shuffled], "bpe", ())
        for left in odd:
            for right in odd:
                assert small._stay_apart(left, right) == (small._merged(left + right) == [left, right])
    monkeypatch.setattr(pieces, "REMEMBERED", 8)  # forgets all the time
    forgetful = Pieces(model.pieces, model.scores, "bpe")
    for text in (sentence(rng, "de", 300), "one.%%% one.%%% two### ###", "x" * 200):
        assert forgetful.encode(text) == library.encode(text)


def test_one_path_without_scores_gives_the_ids_of_the_scored_one():
    model, source = pieces.Pieces.load(), random.Random(5)
    texts = ["".join(source.choice("aeinrst▁heru1.é") for _ in range(source.randint(1, 40))) for _ in range(3_000)]
    for text in texts:
        alone = model._only_path(text)
        assert alone == model._scored_path(text), text
    assert model._only_path("a\U0001f9ff") is None  # a character without a piece: byte pieces, by the scored pass
    assert model.encode("a\U0001f9ff b" * 40) == model._scored_path(("▁" + "a\U0001f9ff▁b" * 40))
