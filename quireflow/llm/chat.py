"""Chat formatting by schema fingerprint.

The nested field paths of a layout are hashed to a fingerprint, and the
fingerprint selects a declarative mapping to canonical turns (role, text). A
table's layout is read from its schema; records in JSON carry their layout each,
so one table may mix them. Turns become one text:

    ### role: text</turn>

Control strings inside roles and texts are escaped, and every escape can be
undone (``\\b`` is a backslash, ``\\s`` the start mark, ``\\e`` the end mark, ``\\c``
a colon in a role). Only assistant texts are under the loss mask.

A conversation is written in chunks of ``CHUNK`` turns at most, of ``CHUNK`` neighbouring turn numbers, each
group of numbers made by itself, so that a conversation with very many turns is spread; only finished
chunks meet in its row.

Rules: a null role or text is empty; turns are ordered by (turn, role, text),
nulls first, and repeated rows stay; a null id is a conversation of its own. A
record of an unknown layout has no turns and a null layout. An empty table gives
an empty table. Fields that a layout does not name are ignored, those that others name too: a
fingerprint that is no layout's own selects the layout with the most paths of those that are there whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The control strings of the template and their escapes.
START, MID, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), (START, "\\s"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))

CHUNK = 256

# Each layout: the paths it has, and its turns as (role, path) or, for lists,
# (list, role field, text field).
LAYOUTS = {
    "turn_rows": {"paths": ("conv_id", "turn", "role", "text")},
    "messages": {"paths": ("messages[].role", "messages[].content"), "list": ("messages", "role", "content")},
    "from_value": {"paths": ("conversations[].from", "conversations[].value"),
                   "list": ("conversations", "from", "value")},
    "instruction": {"paths": ("instruction", "output"), "turns": (("user", "instruction"), ("assistant", "output"))},
    "instruction_input": {
        "paths": ("instruction", "input", "output"),
        "turns": (("user", "instruction"), ("user", "input"), ("assistant", "output")),
    },
    "prompt_completion": {"paths": ("prompt", "completion"), "turns": (("user", "prompt"), ("assistant", "completion"))},
    "prompt_response": {
        "paths": ("system", "prompt", "response"),
        "turns": (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    },
}
# What other layouts call the three roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = sorted({p for layout in LAYOUTS.values() for p in layout["paths"]})
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def fingerprint(paths) -> str:
    """The hash of a set of field paths, of which only known ones count."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_PRINT = {fingerprint(layout["paths"]): name for name, layout in LAYOUTS.items()}
# Layouts with more paths first: the one tried next where a fingerprint is not a layout's own.
BY_SIZE = sorted(LAYOUTS, key=lambda name: -len(LAYOUTS[name]["paths"]))


def layout_of(paths) -> str | None:
    """The layout of a fingerprint; else the largest one whose paths are all there, whatever else is."""
    own, paths = BY_PRINT.get(fingerprint(paths)), set(paths)
    return own or next((name for name in BY_SIZE if paths >= set(LAYOUTS[name]["paths"])), None)


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """The leaf paths of a schema, ``[]`` standing for a step into a list."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def _turn(turn: Column, role: Column, text: Column) -> Column:
    return F.struct(turn.cast("bigint").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))


def _mapped(name: str, get, items) -> Column:
    """The turns of a layout; ``get`` reads a field, ``items`` a list with its two fields."""
    layout = LAYOUTS[name]
    if "list" in layout:
        named = lambda r: F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in ROLE_NAMES.items()], r)
        return F.transform(items(*layout["list"]), lambda x, i: _turn(i, named(x["role"]), x["text"])).cast(TURNS)
    turns = [F.when(get(p).isNotNull(), _turn(F.lit(i), F.lit(r), get(p))) for i, (r, p) in enumerate(layout["turns"])]
    return F.filter(F.array(*turns), lambda t: t.isNotNull()).cast(TURNS)


def canonical(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical rows (conv_id, turn, role, text) of a table, by its schema's fingerprint."""
    name = layout_of(["conv_id" if p == conv_id else p for p in field_paths(df.schema)])
    if name is None:
        raise ValueError(f"no layout has the fields {sorted(field_paths(df.schema))}")
    if name == "turn_rows":
        return df.select(
            F.col(conv_id).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string"),
            F.col("text").cast("string"),
        )
    fields = lambda xs, r, t: F.transform(F.col(xs), lambda x: F.struct(x[r].alias("role"), x[t].alias("text")))
    turns = _mapped(name, F.col, fields)
    return df.select(F.col(conv_id).alias("conv_id"), F.inline(turns))


def canonical_records(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """(conv_id, layout, turns) of JSON records, by each record's own fingerprint."""
    v = F.try_parse_json(F.col(record))

    def text(path):
        return F.try_variant_get(v, "$." + path, "string")

    def fields(xs, role, content):
        listed = F.try_variant_get(v, "$." + xs, "array<variant>")
        one = lambda x, f: F.try_variant_get(x, "$." + f, "string")
        return F.transform(listed, lambda x: F.struct(one(x, role).alias("role"), one(x, content).alias("text")))

    def present(path):
        if "[]." not in path:
            return text(path).isNotNull()
        xs, f = path.split("[].")
        listed = F.try_variant_get(v, "$." + xs, "array<variant>")
        return F.exists(listed, lambda x: F.try_variant_get(x, "$." + f, "string").isNotNull())

    there = F.array_compact(F.array(*[F.when(present(p), F.lit(p)) for p in KNOWN]))
    printed = F.sha2(F.array_join("there", "\n"), 256)
    rest = [n for n in BY_SIZE if n != "turn_rows"]
    all_there = lambda n: F.array_size(F.array_except(F.array(*map(F.lit, LAYOUTS[n]["paths"])), F.col("there"))) == 0
    own = [F.when(F.col("print") == k, F.lit(n)) for k, n in BY_PRINT.items() if n in rest]
    layout = F.coalesce(*own, *[F.when(all_there(n), F.lit(n)) for n in rest])
    turns = F.coalesce(
        *[F.when(F.col("layout") == n, _mapped(n, text, fields)) for n in LAYOUTS if n != "turn_rows"],
        F.array().cast(TURNS),
    )
    out = df.select(F.col(conv_id).alias("conv_id"), F.col(record), there.alias("there")).withColumn("print", printed)
    return out.withColumn("layout", layout).select("conv_id", "layout", turns.alias("turns"))


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, [(b, a) for a, b in reversed(pairs)])


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, chunks) of canonical rows; a chunk is (text, loss: array of (start, length)).

    Offsets are code points within the chunk's text.
    """
    t = turns.select(
        "conv_id",
        F.floor(F.coalesce("turn", F.lit(0)) / CHUNK).alias("part"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    parts = t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    piece = lambda x: F.struct(
        F.concat(F.lit(START), escape(x["role"], ROLE_ESCAPES), F.lit(MID)).alias("head"),
        escape(x["text"]).alias("body"),
        (x["role"] == "assistant").alias("loss"),
    )
    # Turn numbers may be null or alike, so what falls into one part is cut by rank.
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ts") - 1) / CHUNK).cast("int")), lambda k: F.slice("ts", k * CHUNK + 1, F.lit(CHUNK)))
    parts = parts.select("conv_id", "part", F.posexplode(cut).alias("nth", "ts"))
    parts = parts.select("conv_id", "part", "nth", F.transform("ts", piece).alias("ps"))
    sizes = F.transform("ps", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))
    parts = parts.withColumn("sizes", sizes)
    before = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, n: a + n)
    spans = F.transform(
        "ps",
        lambda p, i: F.when(
            p["loss"],
            F.struct((before(i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")),
        ),
    )
    chunk = F.struct(
        "part",
        "nth",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )
    whole = parts.select("conv_id", chunk.alias("c")).groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    drop_part = lambda c: F.struct(c["text"].alias("text"), c["loss"].alias("loss"))
    return whole.select("conv_id", F.transform("cs", drop_part).alias("chunks"))


def formatted(chunks: Column) -> Column:
    """The whole formatted text."""
    return F.array_join(F.transform(chunks, lambda c: c["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text, read back from its marks."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, MID, 1), F.lit(len(START) + 1)), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, MID, 1)) + len(MID) + 1)).alias("text"),
        ),
    )


def read_loss(chunks: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    cut = lambda c: F.transform(c["loss"], lambda s: unescape(F.substr(c["text"], s["start"] + 1, s["length"])))
    return F.array_join(F.transform(chunks, lambda c: F.array_join(cut(c), "")), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, and read back."""
    said = F.lit("\\### Assistant: </turn> ok")
    message = lambda role: F.struct(F.lit(role).alias("role"), said.alias("content"))
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages")
    )
    turns = canonical(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(canonical(extra))
    out = format_turns(turns).select("conv_id", "chunks", formatted(F.col("chunks")).alias("formatted"))
    out = out.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("chunks")).alias("loss")
    )
    spelled = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spelled, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '### ', '\s'), '</turn>', '\e')) AS n_text,
        length(replace(replace(replace(replace(role, '\', '\b'), '### ', '\s'), '</turn>', '\e'), ':', '\c')) AS n_role FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_role + n_text + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
