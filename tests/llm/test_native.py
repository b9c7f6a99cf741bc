"""Chat formatting, quality rules, substring and line dedup against brute force."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quireflow.llm import chat, lines, rules, substring

DOCS = "doc_id bigint, text string, source string, row string, hit_row string, unit string, turn string"


def docs(spark, rows):
    """Rows (id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def norm(s):
    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", s.strip(" \t\n\x0b\x0c\r").lower())


# -- chat ----------------------------------------------------------------------

TRICKY = ["", "a\\b", "\\s\\e\\b", "### x", "</turn>", "</turn>\n### user: ", "\\### Assistant: </turn> ok", "#### y\\", "ü\n\n"]


def brute_chat(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 300, 900]), rng.choice([None, "user", "assistant", "a: b\\c"]), rng.choice([None, *TRICKY])) for _ in range(200)]
    rows += rows[:20] + [(9, i, "assistant", f"t{i} </turn>") for i in range(700)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    out = chat.format_turns(chat.canonical(df)).select(
        "conv_id", "chunks", chat.read_turns(chat.formatted(F.col("chunks"))).alias("turns"), chat.read_loss(F.col("chunks")).alias("loss")
    )
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out.collect()}
    want = brute_chat(rows)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(got[k][1] == "".join(x for r, x in v if r == "assistant") for k, v in want.items())


def test_chat_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_turns(chat.canonical(df)).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 5}, "messages", [("user", "q"), ("assistant", None)]),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", [("user", "q"), ("assistant", "a")]),
        (3, {"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i"), ("user", "x"), ("assistant", "o")]),
        (4, {"instruction": "i", "input": None, "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        (5, {"prompt": "p", "completion": "c", "meta": {"role": 1}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        (6, {"what": 1}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r, _, _ in records] + [(7, "not json"), (8, None)], "conv_id bigint, record string")
    got = {r["conv_id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_records(df).collect()}
    assert got == {**{i: (n, t) for i, _, n, t in records}, 7: (None, []), 8: (None, [])}


# -- rules -----------------------------------------------------------------------


def brute_stats(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = defaultdict(list)
    for i in range(len(ws) - 7):
        wins[tuple(ws[i : i + 8])].append(i)
    rep = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(rep))


def test_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a b c d e f g h", "a " * 30, "x\x85y z w\x0bq"]
    for n in (5, 20, 60, 200):
        for v in (2, 4, 50):
            texts.append("".join(rng.choice(["a", "bb", "ç", "W#", "d%"][: v] if v < 5 else [f"w{i}" for i in range(v)]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n)))
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    out = rules.judge(df, [])
    for r in out.collect():
        want = brute_stats(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want, texts[r["doc_id"]]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)


def test_rules_learn_and_apply(spark):
    rng = random.Random(3)
    good = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40)), "s") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{rng.randrange(500)}$$" for _ in range(40)), "s") for i in range(30)]
    df = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in good + bad] + [(None, 1), (5, None), (999, 0)], "doc_id bigint, quality int")
    learned = rules.fit(df, labels)
    assert learned
    assert all(r["kept"] == (r["doc_id"] < 100) for r in rules.judge(df, learned).collect())
    assert rules.fit(df, labels.where("false")) == []
    assert rules.judge(df.where("false"), learned).count() == 0


# -- substring and line dedup -----------------------------------------------------


def corpus(rng):
    pool = ["", "  ", "Of.", "one two three four five six seven eight nine", "ONE  two three four five six seven eight nine ", "a b c\td", "long " * 12]
    rows = []
    for i in range(120):
        n = rng.randrange(0, 9)
        text = "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"unique {i} {k} line of words here to be kept" for k in range(n))
        rows.append((i, text, rng.choice([None, "s1", "s2", "s3", "s4"])))
    return rows + [(500, None, "s1"), (501, "", "s2"), (502, "\n" * 5, "s2"), (None, "Of.\nlong " + "long " * 11, "s9")]


def brute_repeats(rows, min_words=8):
    seen, gone = set(), {}
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls, hit = (text or "").split("\n"), []
        for k, line in enumerate(ls):
            if norm(line):
                if norm(line) in seen:
                    hit.append(k)
                seen.add(norm(line))
        runs = []
        for k in hit:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        gone[i] = [k for run in runs if sum(len(norm(ls[k]).split(" ")) for k in run) >= min_words for k in run]
    return gone


def test_substring(spark):
    rows = corpus(random.Random(4))
    out = substring.drop_repeats(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "row", "hit_row", "unit", "turn", "removed_spans"]
    want, texts = brute_repeats(rows), {r[0]: r[1] for r in rows}
    for r in out.collect():
        gone = want[r["doc_id"]]
        assert [s["unit"] for s in r["removed_spans"]] == gone
        ls = (texts[r["doc_id"]] or "").split("\n")
        assert [texts[r["doc_id"]][s["start"] : s["start"] + s["length"]] for s in r["removed_spans"]] == [ls[k] for k in gone]
        if texts[r["doc_id"]] is None:
            assert r["text"] is None
        else:
            assert r["text"] == "\n".join(x for k, x in enumerate(ls) if k not in gone)
    assert substring.drop_repeats(docs(spark, [])).count() == 0


def test_substring_paragraphs_and_rank(spark):
    p = "alpha beta gamma delta epsilon zeta eta theta"
    df = docs(spark, [(1, f"x\n\n{p}", "b"), (2, f"{p}\n\ny", "a")])
    got = {r["doc_id"]: r["text"] for r in substring.drop_repeats(df, rank="source", unit="paragraph").collect()}
    assert got == {1: "x", 2: f"{p}\n\ny"}


def test_lines(spark):
    rows = corpus(random.Random(5))
    sites, out = defaultdict(set), lines.drop_boilerplate(docs(spark, rows), min_sites=4, removed="gone")
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                sites[norm(x)].add(s)
    for r in out.collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        keep = [x for x in (t or "").split("\n") if not (norm(x) and len(sites[norm(x)]) >= 4)]
        assert r["text"] == (None if t is None else "\n".join(keep))
        assert len(r["gone"]) == len((t or "").split("\n")) - len(keep)
    assert Counter(len(v) >= 4 for v in sites.values())[True] > 2
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0


def test_spread_near_and_far(spark):
    rows = [(k, f"site{s}") for k, n in (("a", 90), ("b", 100), ("c", 99), ("d", 300), ("e", 5)) for s in range(n)] * 2
    df = spark.createDataFrame(rows, "key string, site string")
    assert sorted(r["key"] for r in lines.site_spread(df, 100).collect()) == ["b", "d"]


def test_runs_over_blank_lines(spark):
    verse = "one two three\n\nfour five six\n \nseven eight nine"
    df = docs(spark, [(1, f"a\n{verse}", "s"), (2, f"b\n{verse}\nof", "s"), (3, "one two three\n\nc", "s")])
    got = {r["doc_id"]: r["text"] for r in substring.drop_repeats(df, over_blanks=True).collect()}
    assert got == {1: f"a\n{verse}", 2: "b\n\n \nof", 3: "one two three\n\nc"}


# -- odd schemas and long texts ------------------------------------------------------


def test_chat_other_fields_do_not_matter(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = sorted(tuple(r) for r in chat.canonical(df).collect())
    extra = df.selectExpr("*", "'s' AS system", "'p' AS prompt", "'i' AS input", "'o' AS output", "'n' AS instruction", "1 AS part", "2 AS nth")
    assert sorted(tuple(r) for r in chat.canonical(extra).collect()) == want
    records = [(1, '{"prompt": "p", "completion": "c", "system": "s"}'), (2, '{"instruction": "i", "output": "o", "input": "x", "prompt": "p"}')]
    got = chat.canonical_records(spark.createDataFrame(records, "conv_id bigint, record string")).collect()
    assert {r["conv_id"]: r["layout"] for r in got} == {1: "prompt_completion", 2: "instruction_input"}


def test_chat_many_turns_of_one_number(spark):
    """Null and equal turn numbers are cut by rank, and a very long text passes."""
    rows = [(1, None, "assistant", f"t{i:04d}") for i in range(1500)] + [(1, 5, "user", f"u{i:04d}") for i in range(700)]
    rows += [(2, 0, "assistant", "long </turn> " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_turns(chat.canonical(df)).select(
        "conv_id", F.size("chunks").alias("n"), chat.read_turns(chat.formatted(F.col("chunks"))).alias("turns"), chat.read_loss(F.col("chunks")).alias("loss")
    )
    got = {r["conv_id"]: r for r in out.collect()}
    want = brute_chat(rows)
    for c in (1, 2):
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == want[c]
        assert got[c]["loss"] == "".join(x for r, x in want[c] if r == "assistant")
    assert got[1]["n"] == 6 + 3


def test_texts_of_very_many_lines(spark):
    """Two texts of 100,000 lines each: work follows the lines, not their square."""
    ls = [f"line number {i} of a very long text that is here twice" for i in range(100_000)]
    text = "\n".join(ls)
    df = spark.createDataFrame([(1, text, "a"), (2, text + "\nand an end", "b")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in substring.drop_repeats(df).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "and an end" and len(got[2]["removed_spans"]) == 100_000
    last = got[2]["removed_spans"][-1]
    assert text[last["start"] : last["start"] + last["length"]] == ls[-1]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df, min_sites=2).collect()}
    assert got == {1: "", 2: "and an end"}


def test_names_that_are_taken(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, line, "a"), (2, line, "b")], "doc_id bigint, text string, source string")
    df = df.selectExpr("*", "1 AS removed_spans", "2 AS removed", "3 AS gone_units", "4 AS hit_lines")
    out = substring.drop_repeats(df)
    assert out.columns == [*df.columns, "removed_spans_"] and out.count() == 2
    out = lines.drop_boilerplate(df, min_sites=2, removed="removed")
    assert out.columns == [*df.columns, "removed_"] and [r["text"] for r in out.collect()] == ["", ""]
