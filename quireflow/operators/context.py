"""What came before a chapter: running summaries and the contents list.

The text in front of chapter n holds every earlier summary, so a book's
output grows with the square of its length whatever the plan. To keep one
long book from becoming one task, it is a prefix sum in levels: chapters are cut
into segments by number, and segments into groups. What a level holds is put
together once; the text before a segment is what stands before its group and the
earlier segments of the group, and the text before a chapter is that and the
earlier chapters of its segment. Chapter numbers of a book are unique and run
from about 1, so on every level a key has at most ``SEGMENT`` rows, in books of up to ``SEGMENT``^3 chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quireflow.functions.outline import outline_chapters
from quireflow.functions.text import has, title_or_default, written
from quireflow.sources.tables import row_id

SEGMENT = 256

# The layout of the running context.
CONTEXT_HEADER = "SUMMARY OF PREVIOUS CHAPTERS:\n"
NO_SUMMARY = "No summary available."


def chapter_name(number: Column, title: Column) -> Column:
    return F.concat(F.lit("Chapter "), number.cast("string"), F.lit(": "), title_or_default(title))


def _running(
    chapters: DataFrame,
    entry: Column,
    separator: str,
    segment: int | None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Adds ``_before`` (earlier entries joined) and ``_any`` (an earlier summary exists).

    ``segment=None`` runs one plain window per book, for corpora known to hold
    no long books. What came before is read from ``history``, by default the
    chapters themselves; then ``chapters`` may be a few of its rows, and only what
    stands before these is put together.
    """
    if segment is None:
        rows = chapters.withColumn("_entry", entry).withColumn("_has", has(F.col("summary")))
        earlier = Window.partitionBy("book_id").orderBy("chapter_number").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_any", F.coalesce(F.bool_or("_has").over(earlier), F.lit(False)))
        rows = rows.withColumn("_before", F.array_join(F.collect_list("_entry").over(earlier), separator))
        return rows.select(*chapters.columns, "_before", "_any")

    def texts(xs: Column) -> Column:
        """The texts of nodes, joined; NULL if there are none."""
        own = F.filter(F.transform(xs, lambda x: x["text"]), lambda t: t.isNotNull())
        return F.when(F.size(own) > 0, F.array_join(own, separator))

    def earlier(xs: str, at: str) -> Column:
        return F.filter(xs, lambda x: x["at"] < F.col(at))

    def some(xs: Column) -> Column:
        return F.exists(xs, lambda x: x["has"])

    def families(nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
        """The nodes under a key, at most ``segment`` of them, in order."""
        return nodes.groupBy(*keys).agg(F.array_sort(F.collect_list("_node")).alias(name))

    def node(at: str, text: Column, any_: Column) -> Column:
        return F.struct(F.col(at).alias("at"), text.alias("text"), any_.alias("has")).alias("_node")

    seg, group = F.floor(F.col("chapter_number") / segment), F.floor(F.col("_seg") / segment)
    told = (chapters if history is None else history).withColumn("_seg", seg)
    told = told.select("book_id", "_seg", node("chapter_number", entry, has(F.col("summary"))))
    # Stated, because a layout by book would serve the grouping too and hold a long book in one task.
    segments = families(told.repartition("book_id", "_seg"), ["book_id", "_seg"], "_chapters")
    up = segments.select("book_id", group.alias("_group"), node("_seg", texts(F.col("_chapters")), some(F.col("_chapters"))))
    groups = families(up, ["book_id", "_group"], "_segments")
    books = families(groups.select("book_id", node("_group", texts(F.col("_segments")), some(F.col("_segments")))), ["book_id"], "_groups")

    rows = chapters.withColumn("_seg", seg)
    if history is None:
        asked = groups.withColumn("_wanted", F.transform("_segments", lambda x: x["at"]))
    else:
        # Of a longer history only the segments that hold rows are looked at.
        wanted = rows.select("book_id", "_seg", group.alias("_group")).groupBy("book_id", "_group")
        asked = groups.join(wanted.agg(F.collect_set("_seg").alias("_wanted")), ["book_id", "_group"])
    far = earlier("_groups", "_group")
    down = asked.join(books, "book_id").select(
        "book_id", "_segments", texts(far).alias("_far"), some(far).alias("_far_has"), F.explode("_wanted").alias("_seg")
    )
    near = earlier("_segments", "_seg")
    prior = down.select(
        "book_id", "_seg", F.array(F.col("_far"), texts(near)).alias("_prior"), (F.col("_far_has") | some(near)).alias("_prior_any")
    )
    own = earlier("_chapters", "chapter_number")
    out = rows.join(segments, ["book_id", "_seg"], "left").join(prior, ["book_id", "_seg"], "left")
    none = F.array().cast("array<string>")
    pieces = F.concat(F.coalesce("_prior", none), F.array(texts(own)))
    any_ = F.coalesce(F.col("_prior_any"), F.lit(False)) | F.coalesce(some(own), F.lit(False))
    return out.select(*chapters.columns, F.array_join(pieces, separator).alias("_before"), any_.alias("_any"))


def chapter_context(chapters: DataFrame, segment: int | None = SEGMENT) -> DataFrame:
    """Adds ``context``: earlier summaries that exist, in chapter order."""
    entry = F.when(
        has(F.col("summary")),
        F.concat(
            chapter_name(F.col("chapter_number"), F.col("title")), F.lit("\n"), F.col("summary")
        ),
    )
    rows = _running(chapters, entry, "\n\n", segment)
    context = F.when(F.col("chapter_number") > 1, F.col("_before")).otherwise(F.lit(""))
    return rows.withColumn("context", context).drop("_before", "_any")


def prompt_context(
    chapters: DataFrame, segment: int | None = SEGMENT, history: DataFrame | None = None
) -> DataFrame:
    """Adds ``prompt_context``: a header and all earlier chapters.

    Empty until one earlier chapter has a summary; from then on chapters
    without one are listed too. ``history`` may give all chapters of the books, where
    ``chapters`` are only those that need a context, and joined to other tables.
    """
    entry = F.concat(
        F.lit("\n"),
        chapter_name(F.col("chapter_number"), F.col("title")),
        F.lit("\n"),
        F.coalesce("summary", F.lit(NO_SUMMARY)),
        F.lit("\n"),
    )
    rows = _running(chapters, entry, "", segment, history)
    context = F.when(
        (F.col("chapter_number") > 1) & F.col("_any"), F.concat(F.lit(CONTEXT_HEADER), F.col("_before"))
    ).otherwise(F.lit(""))
    return rows.withColumn("prompt_context", context).drop("_before", "_any")


def table_of_contents(chapters: DataFrame) -> DataFrame:
    """One entry per chapter with content; (book_id, chapter_number) orders it."""
    return chapters.where(written(chapters)).select(
        "book_id",
        "chapter_number",
        chapter_name(F.col("chapter_number"), F.col("title")).alias("entry"),
    )


def initial_chapters(
    books: DataFrame, chapters: DataFrame, new_id: Column | None = None, as_of: Column | None = None
) -> DataFrame:
    """Existing chapters, plus those an outline names for books without any.

    New rows get ``new_id``, by default a hash of book and number, and are
    stamped with ``as_of``. The numbers are bigints, whatever the chapters have.
    Headings whose number is beyond bigint name no chapter;
    ``outline_number_audit`` counts them.
    """
    kinds = {f.name: f.dataType for f in chapters.schema.fields}
    id_type = kinds.get("id", T.StringType())
    if new_id is None:
        new_id = row_id(id_type, book_id=F.col("book_id"), chapter_number=F.col("chapter_number"))
    started = chapters.select(F.col("book_id").alias("id")).distinct()
    fresh = (
        books.where(has(F.col("outline")))
        .select("id", "outline")
        .join(started, "id", "left_anti")
        .select(F.col("id").alias("book_id"), F.explode(outline_chapters(F.col("outline"))).alias("c"))
        .select(
            "book_id",
            F.col("c.chapter_number"),
            F.col("c.title").alias("title"),
            F.lit("pending").alias("status"),
            F.lit("pending").alias("notes_status"),
        )
    )
    fresh = fresh.where(F.col("chapter_number").isNotNull())
    if "id" in kinds:
        fresh = fresh.withColumn("id", new_id.cast(id_type))
    if as_of is not None:
        for name in ("created_at", "updated_at"):
            if name in kinds:
                fresh = fresh.withColumn(name, as_of.cast(kinds[name]))
    if "has_content" in chapters.columns:
        fresh = fresh.withColumn("has_content", F.lit(False))
    return chapters.unionByName(fresh, allowMissingColumns=True)


def parse_outlines(books: DataFrame, id_column: str = "book_id") -> DataFrame:
    """Chapter rows of every outline."""
    return books.select(
        F.col(id_column).alias("book_id"), F.explode(outline_chapters(F.col("outline"))).alias("c")
    ).select("book_id", "c.chapter_number", "c.title", "c.description")
