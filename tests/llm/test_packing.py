import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from frames import clashing, frame, odd_rows, row, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratelens.llm import packing


def fewest(lengths, capacity):
    """Exact number of sequences, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best[0]


def histogram(lengths):
    return {x: lengths.count(x) for x in set(lengths)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(lengths):
    fixed, rest = packing.reduce_lengths(histogram(lengths), 20)
    used = [x for content, times in fixed for _ in range(times) for x in content]
    left = [x for x, n in rest.items() for _ in range(n)]
    assert sorted(used + left) == sorted(lengths)
    assert all(sum(content) <= 20 for content, _ in fixed)
    assert sum(times for _, times in fixed) + fewest(left, 20) == fewest(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_holds_every_length_within_capacity(lengths):
    made = packing.plan(histogram(lengths), 64)
    used = [x for content, times in made for _ in range(times) for x in content]
    assert sorted(used) == sorted(lengths) and all(sum(c) <= 64 for c, _ in made)
    count = sum(times for _, times in made)
    assert count <= 1.3 * -(-sum(lengths) // 64) + 1


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(1)
    small = {x: rng.randrange(1, 50) for x in range(1, 2049)}
    made = packing.plan(small)
    large = packing.plan({x: n * 100_000 for x, n in small.items()})
    assert len(large) < 20 * len(made) and len(large) < 50_000


def check(spark, docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(docs).toPandas()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in rows]
    expected = []
    for (key, *_), own in zip(rows, ids):
        first = len(own) % 2048 or 2048
        for k, (a, b) in enumerate(zip([0, *range(first, len(own), 2048)], [*range(first, len(own), 2048), len(own)])):
            expected.append((key, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())))
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in packed.itertuples()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048
    return packed


def test_documents_are_packed_whole(spark):
    rng = random.Random(2)
    rows = [row(i, sentence(rng, "de", rng.randrange(400))) for i in range(150)] + odd_rows()
    rows += [row(1000 + i, rows[3][1]) for i in range(60)]
    packed = check(spark, clashing(frame(spark, rows)), rows)
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 2048) + 1


def test_special_token_strings_are_as_the_tokenizer_has_them(spark):
    rows = [row(1, "a<|endoftext|>b"), row(2, "  \n\n tabs\t\t and 12345 's"), row(3, "é́ 日本 🙂🙂")]
    check(spark, frame(spark, rows), rows)


def test_sequences_as_ids_and_edges(spark):
    rows = [row(1, "one two"), row(2, None)]
    whole = packing.packed_tokens(packing.pack(frame(spark, rows))).collect()
    assert len(whole) == 1 and whole[0]["length"] * 4 == len(whole[0]["ids"])
    assert packing.pack(frame(spark, rows).where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 0)], "k long, length long"), "k")


def test_very_long_runs_of_blanks_and_letters(spark):
    rows = [row(i, c * 1_000_000) for i, c in enumerate((" ", "\n", "a"))] + [row(5, "text " + "\t" * 300_000 + "end")]
    check(spark, frame(spark, rows), rows)
