import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import splitting as P


def check(text, limit=400, overlap=20):
    ends = P.cuts(text, limit, overlap)
    at = 0
    for k, e in enumerate(ends):
        start = at - overlap if k else 0
        assert e > at and 0 <= start and e - start <= limit
        if e < len(text):
            assert text[e - 1 : e + 1] != "\r\n"
            reach = range(at + overlap, min(at + limit - (overlap if k else 0), len(text) - 1) + 1)
            if text[e - 1] not in "\r\n":  # not at a line's end: then none was in reach
                assert not any(text[i - 1] in "\r\n" and not (text[i - 1] == "\r" and text[i : i + 1] == "\n") for i in reach if i > at + 1)
        at = e
    assert at == len(text)
    return ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab{};\n\r \t", min_size=0, max_size=90), max_size=60))
def test_any_text(parts):
    text = "\n".join(parts)
    if len(text) > 400:
        check(text)


@pytest.mark.parametrize("text", ["x" * 5000, " ".join("word" for _ in range(2000)), "\r\n" * 1000, "\n" * 1000, "ab\r" * 700, "x" * 401, "\U0001f512 é" * 500])
def test_extremes(text):
    check(text)


def test_prefers_the_ends_of_blocks():
    rng = random.Random(2)
    blocks = ["def f%d():\n" % i + "".join(f"    a{rng.random()} = 1\n" for _ in range(6)) + "\n" for i in range(40)]
    text = "".join(blocks)
    ends = check(text)[:-1]
    assert ends and all(text[e : e + 3] == "def" for e in ends)


def test_even_pieces():
    ends = P.cuts("x\n" * 3000, 1000, 50)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert max(sizes) - min(sizes[:-1]) <= 60


def test_table(spark):
    text = "".join(f"line {i}\n" for i in range(900))
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "x" * 4000, 5), (5, "y" * 4001, 5), (5, "y" * 4001, 5), (None, text, 5)], "k bigint, code string, piece_no int")
    got = P.pieces(df, id_="k", text="code").collect()
    one = sorted((r for r in got if r.id == 1), key=lambda r: r.piece_no)
    assert "".join([one[0].text, *[r.text[200:] for r in one[1:]]]) == text
    assert all(a.text[-200:] == b.text[:200] and b.start == b_at for a, b, b_at in ((x, y, x.start + len(x.text) - 200) for x, y in zip(one, one[1:], strict=False)))
    assert {r.id for r in got} == {1, 5, None} and sum(r.id == 5 for r in got) == 4
    assert P.pieces(df.limit(0), id_="k", text="code").count() == 0
    with pytest.raises(ValueError):
        P.pieces(df, id_="k", text="code", limit=100, overlap=60)
