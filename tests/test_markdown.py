import random

from quireflow.functions import markdown as md


def blocks_of(one, text):
    return [(b["type"], b["text"] if b["items"] is None else b["items"]) for b in one(text, md.blocks)]


def test_clean_golden(many):
    cases = {
        "**b** and *i*": "b and i",
        "__b__ _i_ `c`": "b i c",
        "[link](http://x) end": "link end",
        "a_b_c": "abc",
        "x\n---\ny": "x\n\ny",
        "x\n\n\n\ny": "x\n\ny",
        "***": "",
        " \u3000pad\t": "pad",
        "**a\nb**": "a\nb",
        "a * b": "a * b",
        "line\r---\nz": "line\r---\nz",
        None: "",
        "": "",
    }
    assert many(list(cases), md.clean_markdown) == list(cases.values())


def test_clean_leaves_no_bold_pair(many):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab *_`\n") for _ in range(60)) for _ in range(300)]
    import re

    for plain in many(texts, md.clean_markdown):
        assert not re.search(r"\*\*[^*]+\*\*", plain)
        assert plain == plain.strip()


def test_block_types(one):
    text = (
        "# One\n\n## Two\n\n### Three\n\n#### Four\n\n- a\n* b\nplain\n  - c\n\n1. x\n2.\n3.  z\n\n"
        "> q\n> r\nrest\n\n```python\ncode()\n```\n\n\n\n  para  "
    )
    assert blocks_of(one, text) == [
        ("h1", "One"),
        ("h2", "Two"),
        ("h3", "Three"),
        ("h4", "Four"),
        ("bullet_list", ["a", "b", "c"]),
        ("numbered_list", ["x", "z"]),
        ("quote", "q\nr\nrest"),
        ("code", "code()"),
        ("paragraph", "para"),
    ]


def test_block_edges(one):
    # A heading glued to text is one heading block.
    assert blocks_of(one, "# Head\ntext") == [("h1", "Head\ntext")]
    # A blank line tears a fenced block apart.
    assert blocks_of(one, "```\na\n\nb\n```") == [("code", ""), ("paragraph", "b\n```")]
    assert blocks_of(one, "```\nab\n```") == [("code", "")]
    assert blocks_of(one, "```\na1\nb\n```") == [("code", "a1\nb")]
    assert blocks_of(one, "a\n\n\nb") == [("paragraph", "a"), ("paragraph", "b")]
    assert blocks_of(one, "1.x") == [("paragraph", "1.x")]
    assert blocks_of(one, "- \n- a") == [("bullet_list", ["a"])]
    assert blocks_of(one, "##Two") == [("paragraph", "##Two")]
    assert blocks_of(one, "") == []
    assert blocks_of(one, None) == []
    assert blocks_of(one, " \n\n\t") == []


def test_items_are_not_trimmed_again(one):
    assert blocks_of(one, "-  two spaces\n-\ttab") == [("bullet_list", [" two spaces"])]


def test_bold_runs(one):
    def runs(text):
        return [(r["text"], r["bold"]) for r in one(text, md.bold_runs)]

    assert runs("a **b** c") == [("a ", False), ("b", True), (" c", False)]
    assert runs("**b****c**") == [("b", True), ("c", True)]
    assert runs("plain") == [("plain", False)]
    assert runs("") == [("", False)]
    assert runs("**open") == [("**open", False)]
