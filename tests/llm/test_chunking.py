import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm.chunking import boundaries, cut, longest_unbroken, present_messages, split_long, split_texts, token_offsets


def codes(text):
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def pieces(text, limit=100, overlap=10):
    c = codes(text)
    return [(a, b, h) for a, b, h in cut(np.arange(len(c) + 1), boundaries(c), limit, overlap)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "\n", "\r\n", "\n\n", ". ", "x" * 40, "é", "😀", "\t", "y" * 130]), max_size=80).map("".join))
def test_pieces_cover_the_text_within_the_limit(text):
    got = pieces(text)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, hard), (c, _, _) in zip(got, got[1:]):
        assert b - a <= 100 and c == b - 10 and not text[b - 1 : b + 1] == "\r\n"
        assert hard or text[b - 1] in " \t\r\n"
        if hard:  # no boundary was left between the overlap and the limit
            assert not any(ch in " \t\r\n" for ch in text[a + 10 : a + 99])
    assert got[-1][1] - got[-1][0] <= 100
    # an exact round trip from the pieces and the overlap
    joined = text[got[0][0] : got[0][1]] + "".join(text[a + 10 : b] for a, b, _ in got[1:])
    assert joined == text


def test_better_boundaries_win_in_the_upper_half():
    text = "a " * 35 + "end.\n\n" + "b " * 60
    assert pieces(text)[0][:2] == (0, 76)
    assert pieces("a " * 10 + "\n\n" + "b " * 100)[0][1] > 90  # a blank line too early is left


def test_units_other_than_characters():
    offsets = np.cumsum([0, 3, 3, 3, 3, 3, 3])
    assert [(a, b) for a, b, _ in cut(offsets, [np.array([2, 4])], 9, 0)] == [(0, 2), (2, 4), (4, 6)]
    assert [(a, b) for a, b, _ in cut(np.array([0, 50, 51]), [np.empty(0, int)], 9, 0)] == [(0, 1), (1, 2)]


def test_longest_unbroken():
    assert longest_unbroken(codes("ab c d")) == 4 and longest_unbroken(codes("")) == 0


def test_frames(spark):
    rng = random.Random(5)
    long = "".join(rng.choice(["alpha ", "beta. ", "\n", "x" * 30]) for _ in range(900))
    rows = [("a", "short", 1), ("b", "", 2), ("c", None, 3), ("d", long, 4), ("e", "z" * 2500, 5), ("f", "q" * 1000 + " " + "q" * 1000, 6), (None, "w " * 900, 7), ("a", "short", 1)]
    df = spark.createDataFrame(rows, "id string, body string, key int")
    got = split_texts(df, "id", "body")
    by = {}
    for r in got.collect():
        by.setdefault(r.key, []).append(r)
    assert len(by["a"]) == 2 and by["b"][0].piece == "" and "c" not in by and max(len(r.piece) for r in got.collect()) <= 1000
    assert {r.forced for r in by["e"]} == {1} and {r.forced for r in by["f"]} == {0} and {r.forced for r in by["d"]} == {0}
    parts = sorted(by["d"], key=lambda r: r.chunk_id)
    assert [r.chunk_id for r in parts] == list(range(len(parts)))
    assert parts[0].piece + "".join(r.piece[100:] for r in parts[1:]) == long
    assert {r.key for r in split_long(df, "id", "body").collect()} == {"d", "e", "f", None}
    assert split_texts(df.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "body", 100, 60)


def test_present_messages(spark):
    df = spark.sql("select * from values ('a', 'old', timestamp'2024-01-01', 1), ('a', null, timestamp'2024-01-02', 1), ('b', 'x', null, 1), (null, 'y', null, 1) t(id, message, scanned_at, commit_id)")
    assert {tuple(r) for r in present_messages(df).collect()} == {("a", None), ("b", "x")}


def test_pieces_in_tokens(spark):
    measure = token_offsets()
    text = "Retry the réorder_batches call, then wait 😀. " * 40 + "x" * 3000
    offsets = measure(text)
    assert offsets[0] == 0 and len(offsets) == len(text) + 1 and (np.diff(offsets) >= 0).all()
    got = split_texts(spark.createDataFrame([(1, text), (2, "few"), (3, "")], "id int, t string"), "id", "t", 50, 5, measure).orderBy("key", "chunk_id").collect()
    one = [r for r in got if r.key == 1]
    assert all(offsets[r.stop] - offsets[r.start] <= 50 and r.piece == text[r.start : r.stop] for r in one) and len(one) > 5
    assert all(b.start < a.stop and offsets[a.stop] - offsets[b.start] <= 5 for a, b in zip(one, one[1:])) and one[-1].stop == len(text)
    assert {r.forced for r in one} == {1} and [r.piece for r in got if r.key > 1] == ["few", ""]
