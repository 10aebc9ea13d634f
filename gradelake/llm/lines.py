"""Line dedup by overlapping three-line windows and by long passages on fewer lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import bind

#: Lines of a window.
WINDOW = 3
#: Words from which a window of fewer lines is a passage too.
PASSAGE_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_facts(text: Column) -> Column:
    """h, a 128-bit hash, and n, the number of words, of every line."""
    return F.transform(text_lines(text), lambda line: F.struct(
        F.unhex(F.md5(line)).alias("h"), F.regexp_count(line, F.lit(_WORD)).alias("n")))


def window_hashes(facts: Column, width: int, least_words: int) -> Column:
    """at, width and h of the windows of ``width`` lines with at least ``least_words`` words.

    A window's hash is that of its lines' hashes, so every line is read once, and windows of
    different widths never meet.
    """
    def one(i: Column) -> Column:
        lines = [F.get(facts, i + k) for k in range(width)]
        words = lines[0]["n"]
        for line in lines[1:]:
            words = words + line["n"]
        h = F.unhex(F.md5(F.concat(*[line["h"] for line in lines])))
        return F.when(words >= least_words, F.struct(i.alias("at"), F.lit(width).alias("width"), h.alias("h")))

    last = F.size(facts) - width
    return F.array_compact(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array()))


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int, passage_words: int | None) -> DataFrame:
    """doc_id, t, at, width, h of the windows of ``width`` lines and of the passages on fewer; t tells texts of one id apart."""
    def found(facts: Column) -> Column:
        spans = [window_hashes(facts, width, 1)]
        if passage_words is not None:
            spans += [window_hashes(facts, w, passage_words) for w in range(1, width)]
        return F.concat(*spans)

    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"),
        F.inline(bind(line_facts(F.col(text_col)), found)))


def later_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
    passage_words: int | None = PASSAGE_WORDS,
) -> DataFrame:
    """doc_id, t, at, width: every window that an earlier place in the corpus holds as well.

    Places are ordered by document id, then text (by its hash), then line. The first place of each hash is a
    combinable minimum; windows are then joined to the repeated hashes only, and a hot
    hash is a skewed key of a plain join, which Spark splits.
    """
    windows = _windows(docs, id_col, text_col, width, passage_words)
    place = F.struct("doc_id", "t", "at")
    first = (
        windows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("h", "first")
    )
    return windows.join(first, "h").where(place > F.col("first")).select("doc_id", "t", "at", "width")


def kept_lines(lines: Column, covered: Column) -> Column:
    """Lines but those at the sorted places ``covered``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(covered, lambda p: p + 1))
    ends = F.concat(covered, F.array(F.size(lines)))
    return F.flatten(F.zip_with(
        starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))
    ))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
    passage_words: int | None = PASSAGE_WORDS,
) -> DataFrame:
    """``docs`` with two more columns: ``kept_text`` and ``removed_lines``.

    A window of ``width`` consecutive lines that stands at an earlier place of the corpus
    too is removed, and so is one of fewer lines that hold ``passage_words`` words or more,
    such as a long paragraph; None leaves these out. Overlapping windows are merged, so a
    repeated passage goes from its first line to its last. Windows of blank lines alone are
    no passages. Documents without text or without an id stay as they are; a null text
    stays null. Rows that repeat an id with another text are documents of their own, and
    rows that repeat both are one document, whose passages do not count against each other.
    A very long text is read by the task that has its row. Columns of ``docs`` named like the two
    new ones are replaced.
    """
    places = (
        later_windows(docs, id_col, text_col, width, passage_words)
        .groupBy(F.col("doc_id").alias("_of"), F.col("t").alias("_t"))
        .agg(F.collect_set(F.struct("at", "width")).alias("_spans"))
        .select("_of", "_t", F.array_sort(F.array_distinct(F.flatten(F.transform(
            "_spans", lambda x: F.sequence(x["at"], x["at"] + x["width"] - 1))))).alias("_at"))
    )
    docs = docs.drop("kept_text", "removed_lines")
    joined = docs.join(
        places, (docs[id_col] == places["_of"]) & (F.xxhash64(docs[text_col]) == places["_t"]), "left")
    left = bind(
        text_lines(F.col(text_col)),
        lambda lines: F.struct(
            kept_lines(lines, F.col("_at")).alias("lines"), F.size(lines).alias("n")),
    )
    changed = joined.withColumn("_left", F.when(F.col("_at").isNotNull(), left))
    return changed.select(
        *[docs[c] for c in docs.columns],
        F.when(F.col("_at").isNull(), F.col(text_col))
        .otherwise(F.array_join(F.col("_left.lines"), "\n")).alias("kept_text"),
        F.coalesce(F.col("_left.n") - F.size("_left.lines"), F.lit(0)).cast("bigint")
        .alias("removed_lines"),
    )
