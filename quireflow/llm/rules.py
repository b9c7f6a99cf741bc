"""Quality rules: a decision list learned from labelled statistics.

Sequential covering grows each rule, a conjunction of thresholds, by information
gain on two thirds of the labelled rows, prunes it on the other third, and takes
the rows it covers out before the next. The ordered list becomes one
conditional expression. Statistics are built-in functions only.

The list is learned from at most ``SAMPLE`` labelled documents (those with the
least id hashes); only their statistics come to the driver. Every document is
measured and judged.

Rules: a null or empty text has no words and fails. Shares of nothing are 0.
Labels that are null, or name no document, are left out; without labels the
list is empty and keeps what the base passes. Repeated label rows count once
per row. Rows of equal id are judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quireflow.functions.text import let
from quireflow.llm.common import BLANK, col, documents, has_word, lines, words

SAMPLE = 4000
WINDOW = 8
CUTS = 24
MAX_CONDITIONS = 4

FEATURES = ("n_words", "mean_chars", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks")


def _repeat_words(hashes: Column) -> Column:
    """Words within windows of ``WINDOW`` words that occur again; ``hashes``: of the words."""

    def covered(windows):
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s):
            twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            at = F.transform(s, lambda x, j: F.when(twin(x, j - 1) | twin(x, j + 1), x["i"]))
            return let(
                F.sort_array(F.filter(at, lambda p: p.isNotNull())),
                lambda ps: F.aggregate(
                    F.transform(ps, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, j + 1) - p, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, n: a + n,
                ),
            )

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, again)).otherwise(0)

    n = F.size(hashes)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(n > WINDOW, let(windows, covered)).otherwise(0)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts, features) of every whole text."""
    t = F.coalesce(col(docs, text), F.lit(""))
    # One lambda binds the word hashes, so that a text is split once.
    by_words = let(
        F.transform(words(t), lambda w: F.xxhash64(w)),
        lambda h: F.struct(
            F.size(h).alias("n_words"),
            _repeat_words(h).alias("n_repeat_words"),
            F.size(F.array_distinct(h)).alias("n_distinct"),
        ),
    )
    by_lines = let(
        F.filter(lines(t), has_word),
        lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")),
    )
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    s = docs.select(
        col(docs, doc_id).alias("doc_id"),
        by_words.alias("w"),
        by_lines.alias("l"),
        F.length(F.regexp_replace(t, BLANK + "+", "")).alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_capitals"),
        count("!").alias("n_marks"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = F.col("w.n_words")
    return s.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.struct(
            n.cast("double").alias("n_words"),
            share(F.col("word_chars"), n).alias("mean_chars"),
            share(F.col("n_symbols"), n).alias("symbols"),
            share(F.col("l.dup"), F.col("l.n")).alias("dup_lines"),
            share(F.col("w.n_repeat_words"), n).alias("repeats"),
            share(F.col("w.n_distinct"), n).alias("distinct"),
            share(F.col("n_capitals"), F.col("word_chars")).alias("capitals"),
            share(F.col("n_marks"), n).alias("marks"),
        ).alias("features"),
    )


def _holds(row, conditions) -> bool:
    return all(row[f] >= x if up else row[f] < x for f, up, x in conditions)


def _gain(rows, more) -> float:
    """Information gain of a refinement, on (features, bad) rows."""
    p0, n0 = sum(b for _, b in rows), len(rows)
    p1, n1 = sum(b for _, b in more), len(more)
    return p1 * (math.log2(p1 / n1) - math.log2(p0 / n0)) if p1 else 0.0


def _grown(rows) -> list:
    rule: list = []
    while len(rule) < MAX_CONDITIONS and 0 < sum(b for _, b in rows) < len(rows):
        best = (0.0, None)
        for k in range(len(FEATURES)):
            values = sorted({r[k] for r, _ in rows})
            cuts = {values[len(values) * i // CUTS] for i in range(1, CUTS)} if len(values) > CUTS else values[1:]
            for x in sorted(cuts):
                for up in (True, False):
                    gain = _gain(rows, [(r, b) for r, b in rows if (r[k] >= x) == up])
                    best = max(best, (gain, (k, up, x)), key=lambda g: g[0])
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [(r, b) for r, b in rows if _holds(r, [best[1]])]
    return rule


def _worth(rule, rows) -> float:
    found = [b for r, b in rows if _holds(r, rule)]
    return (2 * sum(found) - len(found)) / len(found) if found else -1.0


def learn(rows: list[tuple[tuple[float, ...], int]], min_precision: float = 0.8) -> list:
    """An ordered list of rules for rejection, from (features, bad) rows."""
    found, rows = [], list(rows)
    while sum(b for _, b in rows):
        grow = [r for i, r in enumerate(rows) if i % 3]
        prune = [r for i, r in enumerate(rows) if not i % 3]
        rule = _grown(grow)
        while len(rule) > 1 and _worth(rule[:-1], prune) >= _worth(rule, prune):
            rule = rule[:-1]
        hit = [b for r, b in rows if rule and _holds(r, rule)]
        if not hit or sum(hit) < min_precision * len(hit) or sum(hit) < 3:
            break
        found.append(rule)
        rows = [(r, b) for r, b in rows if not _holds(r, rule)]
    return found


def verdict(rules: list, features: str = "features") -> Column:
    """The list as one ordered conditional: false for the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for k, up, x in rule:
            f = F.col(features)[FEATURES[k]]
            test = test & ((f >= F.lit(float(x))) if up else (f < F.lit(float(x))))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", quality: str = "quality") -> list:
    """Rules learned from at most ``sample`` labelled documents."""
    ids = labels.select(col(labels, doc_id).alias("id"), col(labels, quality).alias("q")).dropna()
    chosen = ids.orderBy(F.xxhash64("id"), "id", "q").limit(sample)
    # At most `sample` narrow rows, so the broadcast is bounded.
    picked = docs.join(F.broadcast(chosen.select("id").distinct()), col(docs, doc_id) == F.col("id"), "left_semi")
    stats = statistics(picked, doc_id).select("doc_id", "features")
    rows = stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "features", "q")
    # Rows that repeat an id may be more than the sample; of these the first by id and features are taken.
    got = sorted((tuple(r["features"]), int(r["q"] == 0)) for r in rows.orderBy("doc_id", "features", "q").limit(4 * sample).collect())
    # A fixed shuffle by position keeps both parts mixed, whatever order rows came in.
    return learn([got[(i * 7919) % len(got)] for i in range(len(got))] if len(got) % 7919 else got)


def judge(docs: DataFrame, rules: list) -> DataFrame:
    """Counts, whether the base fails, and whether a document is kept."""
    s = statistics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
