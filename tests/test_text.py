import random

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as tx


def test_spaces_are_what_python_calls_whitespace():
    assert set(tx.SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_presence(many):
    assert many([None, "", " ", "x"], tx.has) == [False, False, True, True]


def test_strip_uses_unicode_whitespace(many):
    values = ["\xa0\x1c\ta b\u3000\r\n", "\u2028", "", None, "x"]
    assert many(values, tx.strip) == [v.strip() if v is not None else None for v in values]


def test_title_key_ignores_case_and_outer_space(many):
    assert many(["  The Book\t", "the book"], tx.title_key) == ["the book", "the book"]


@pytest.mark.parametrize("width", [72, 11])
def test_center_line(many, width):
    values = ["", "a", "ab", "abc", "x" * 70, "y" * 71, "z" * 80]
    assert many(values, lambda c: tx.center_line(c, width)) == [v.center(width) for v in values]


def fold_words(text, width):
    """Word by word: the first line counts every word's trailing space."""
    lines, room = [], width
    for word in text.split():
        if lines and len(word) + 1 <= room:
            lines[-1] += " " + word
            room -= len(word) + 1
        else:
            first = not lines
            lines.append(word)
            room = width - len(word) - (1 if first else 0)
    return lines or [""]


def test_word_wrap_equals_counting(many):
    rng = random.Random(7)
    for width in (12, 68):
        texts = [
            rng.choice(["", " ", "\n"]).join([""])
            + rng.choice([" ", "\n", "\t ", "\u2003"]).join(
                "w" * rng.choice([1, 2, 3, width - 2, width - 1, width, width + 1, 2 * width])
                for _ in range(rng.randint(0, 25))
            )
            for _ in range(400)
        ]
        assert many(texts, lambda c: tx.word_wrap(c, width)) == [fold_words(t, width) for t in texts]


def test_word_wrap_keeps_words_and_width(many):
    rng = random.Random(3)
    texts = [" ".join("é" * rng.randint(1, 90) for _ in range(rng.randint(1, 40))) for _ in range(100)]
    for text, lines in zip(texts, many(texts, lambda c: tx.word_wrap(c, 68))):
        assert " ".join(lines).split() == text.split()
        assert all(len(s) <= 68 or " " not in s for s in lines)


def test_wrap_edges(one):
    assert one("", lambda c: tx.word_wrap(c, 68)) == [""]
    assert one("x" * 100, lambda c: tx.word_wrap(c, 68)) == ["x" * 100]
    assert one("a " * 34 + "b", lambda c: tx.word_wrap(c, 68)) == [("a " * 34).strip(), "b"]


def test_clip_and_head(one):
    assert one("abc", lambda c: tx.clip(c, 3)) == "abc"
    assert one("abcd", lambda c: tx.clip(c, 3)) == "abc..."
    assert one("ab", lambda c: tx.clip(c, 3, always_mark=True)) == "ab..."
    assert one("\U0001f600bc", lambda c: tx.head(c, 2)) == "\U0001f600b"


def test_safe_title(one):
    assert one("  A/b: c_d-e!é1 ", tx.safe_title) == "Ab c_d-eé1"


def test_event_heading(one):
    assert one("outline_ready", tx.event_heading) == "Outline Ready"


def test_escape_order(one):
    assert one("<a> & &lt;", tx.escape_markup) == "&lt;a&gt; &amp; &amp;lt;"


def test_let_is_transparent(one):
    assert one("abc", lambda c: tx.let(F.upper(c), lambda u: F.concat(u, u))) == "ABCABC"
