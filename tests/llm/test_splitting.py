import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    pieces, level = split_text(text, limit, overlap)
    if not text.strip():
        assert pieces == []
        return
    assert all(0 < z - a <= limit and a <= f < z for a, z, f in pieces)
    assert not text[: pieces[0][0]].strip() and not text[pieces[-1][1] :].strip()
    for (_, z, _), (a, _, f) in zip(pieces, pieces[1:], strict=False):
        assert not text[z:f].strip() and 0 <= f - a <= overlap


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n\r\t\xa0é😀", max_size=300), st.integers(5, 60), st.integers(0, 10))
def test_covers_within_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_levels():
    para = "\r\n\r\n".join("x" * 50 for _ in range(10))
    assert split_text(para, 100, 10)[1] == 0
    assert split_text("Aa bb. " * 40, 100, 10)[1] == 1
    assert split_text("aa bb " * 40, 100, 10)[1] == 2
    assert split_text("a" * 500, 100, 10)[1] == 3


def test_long_text_is_linear():
    r = random.Random(1)
    check(" ".join("w" * r.randint(1, 12) for _ in range(30000)), 6000, 200)


def test_frame(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "word " * 400, 0), (5, "word " * 400, 0)]
    df = spark.createDataFrame(rows, "id long, t string, boundary int")
    out = split_oversized(df, "x", "id", "t", 300, 50).collect()
    assert {r.row_id for r in out} == {4, 5}
    assert all(r.piece_text == ("word " * 400)[r.char_start : r.char_end] for r in out)
    assert [r[2:8] for r in out if r.row_id == 4] == [r[2:8] for r in out if r.row_id == 5]
    assert split_oversized(df.limit(0), "x", "id", "t", 300, 50).collect() == []


def test_white_space_over_the_limit_is_a_row(spark):
    df = spark.createDataFrame([(1, " \n\n\t" * 200), (2, " " * 301), (3, " " * 300)], "id long, t string")
    out = split_oversized(df, "x", "id", "t", 300, 50).collect()
    assert {(r.row_id, r.piece_no, r.char_start, r.char_end, r.boundary, r.piece_text) for r in out} == {(1, 0, 0, 0, "paragraph", ""), (2, 0, 0, 0, "paragraph", "")}


def plain_level(text, limit):
    """The first level whose pieces all fit, without any program."""
    import re

    cuts = [r"\s*\n\s*\n\s*", r"(?<=[.!?])\s+|\s*\n\s*\n\s*", r"\s+"]
    return next((k for k, c in enumerate(cuts) if all(len(x.strip()) <= limit for x in re.split(c, text))), 3)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aab. !\n\r", min_size=1, max_size=200), st.integers(5, 40))
def test_boundary_of_the_cuts_is_the_coarsest_that_fits(text, limit):
    if len(text) > limit and text.strip():
        assert split_text(text, limit, 3)[1] == plain_level(text, limit)


def test_combined_characters_stay_whole():
    text = "e\u0301" * 100 + "\U0001f469\u200d\U0001f4bb" * 30
    pieces, level = split_text(text, 33, 6)
    assert level == 3 and all(text[f] not in "\u0301\u200d" and text[f - 1] != "\u200d" for _, _, f in pieces[1:])
    check(text, 33, 6)
    check("e" + "\u0301" * 100, 20, 5)


def test_shortfall_is_reported(spark):
    df = spark.createDataFrame([(1, "\n\n".join("x" * 1190 for _ in range(4))), (2, "word " * 900)], "id long, t string")
    rows = split_oversized(df, "x", "id", "t", 1200, 200).collect()
    assert all(r.overlap_missing == (200 - (r.new_from - r.char_start) if r.piece_no else 0) for r in rows)
    assert max(r.overlap_missing for r in rows if r.row_id == 1) > 150 and max(r.overlap_missing for r in rows if r.row_id == 2) < 20
