import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm.chunking import LEVELS, ChunkRule, cut, first_level, split_oversized

SMALL = ChunkRule(max_chars=60, min_chars=30, overlap=10, landmark_bits=4, reach=15)
CUTS = [r"\r?\n(?:[ \t]*\r?\n)+", r"\r?\n", r"(?<=[.!?])\s+", r"\s+"]


def brute_level(text, limit):
    parts = [text]
    for level, pattern in zip(LEVELS, CUTS):
        parts = [u for p in parts for u in re.split(pattern, p)]
        if all(len(u) <= limit for u in parts):
            return level
    return "none"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r\t!é\u00a0", max_size=400))
def test_pieces_join_to_the_text_and_fit(text):
    pieces = cut(text, SMALL)
    assert "".join(text[f:e] for _, f, e, _ in pieces) == text
    assert all(e - s <= 60 and 0 <= f - s <= 10 for s, f, e, _ in pieces)
    assert first_level(text, 60) == brute_level(text, 60)


def test_every_piece_but_the_first_repeats_something():
    text = " ".join(["word"] * 2000)
    pieces = cut(text)
    assert len(pieces) > 4 and all(0 < f - s <= 200 for s, f, _, _ in pieces[1:])
    assert all(level == "word" for *_, level in pieces[:-1])


def test_no_boundary_is_cut_hard():
    assert [e - s for s, _, e, _ in cut("x" * 5000)][:2] == [2000, 2000]
    assert first_level("x" * 5000, 2000) == "none"


def test_an_edit_changes_only_nearby_pieces():
    rng = random.Random(3)
    text = ". ".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(400))
    edited = text[:9000] + "Inserted words here. " + text[9000:]
    a = {text[f:e] for _, f, e, _ in cut(text)}
    b = {edited[f:e] for _, f, e, _ in cut(edited)}
    assert len(a - b) <= 4 and len(a) > 15


def test_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "a" * 4500, 7), (3, "a" * 4500, 7), (4, "short", 7)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, piece int")  # a clashing name
    out = split_oversized(df).collect()
    assert sorted({r.chunk_id for r in out}) == [2, 3, 4]
    assert len([r for r in out if r.chunk_id == 3]) == 2 * len(cut("a" * 4500))
    assert {r.boundary for r in out if r.chunk_id == 3} == {"none"}
    assert split_oversized(df, only_oversized=True).where("piece = 0").count() == 2
    assert split_oversized(df.limit(0)).count() == 0


def test_sentences_without_blanks_are_boundaries():
    text = "".join(f"网关应存储第{i}个标识符，并不得丢弃计数器。" for i in range(300))
    pieces = cut(text)
    assert all(e - a <= 2000 for a, _, e, _ in pieces) and {x[3] for x in pieces[:-1]} == {"sentence"}
    assert "".join(text[f:e] for _, f, e, _ in pieces) == text and all(text[e - 1] == "。" for _, _, e, _ in pieces)
