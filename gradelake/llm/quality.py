"""Quality rules as a short-circuit cascade, ordered by rejection per cost. Native."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import bind

#: Rows on which the cost and the selectivity of the rules are measured.
SAMPLE_ROWS = 1000
#: White space that separates words, and characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
NO_SYMBOL = r"[^#*$%&|<>]"


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(_whole(text), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(_whole(text), SPACE + "+", "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(_whole(text), NO_SYMBOL + "+", "")).cast("bigint")


def n_upper(text: Column) -> Column:
    """Upper-case letters."""
    return F.length(F.regexp_replace(_whole(text), r"[^\p{Lu}]+", "")).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(_whole(text), "\n"), lambda x: x.rlike(NO_SPACE))


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bind(
        _lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")
    )


def _window_hashes(w: Column) -> Column:
    """64-bit hashes of the 3-word windows, by position."""
    def paired(h: Column) -> Column:
        n = F.size(h) - 2
        tail = F.zip_with(F.slice(h, F.lit(2), n), F.slice(h, F.lit(3), n), lambda b, c: F.xxhash64(b, c))
        return F.zip_with(F.slice(h, F.lit(1), n), tail, lambda a, bc: F.xxhash64(a, bc))

    return bind(F.transform(w, lambda x: F.xxhash64(x)), paired)


def _runs(ordered: Column, key: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """Places of the elements of a sorted array whose key a neighbour shares."""
    def found(s: Column) -> Column:
        n = F.size(s) - 1
        return F.array_distinct(F.flatten(F.zip_with(
            F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n),
            lambda a, b: F.when(key(a) == key(b), F.array(place(a), place(b))).otherwise(
                F.array().cast("array<bigint>")),
        )))

    return bind(ordered, found)


def _covered(h: Column) -> Column:
    """Words in windows whose hash occurs twice or more.

    Numbers sort much faster than records, so the leading bits of each hash, with the
    place in the freed bits, are sorted first; the few windows that share leading bits
    are then sorted by their whole hashes.
    """
    def likely(bits: Column) -> Column:
        def high(x: Column) -> Column:
            return F.call_function("shiftrightunsigned", x, bits)

        def low(x: Column) -> Column:
            return x - F.call_function("shiftleft", high(x), bits)

        keys = F.transform(h, lambda x, i: F.call_function("shiftleft", high(x), bits) + i)
        return _runs(F.array_sort(keys), high, low)

    def repeated(places: Column) -> Column:
        whole = F.transform(places, lambda p: F.struct(F.get(h, p.cast("int")).alias("h"), p.alias("p")))
        return _runs(F.array_sort(whole), lambda x: x["h"], lambda x: x["p"])

    def spread(p: Column) -> Column:
        n = F.size(p) - 1
        steps = F.zip_with(
            F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(3))
        )
        return F.aggregate(steps, F.lit(3).cast("bigint"), lambda total, step: total + step)

    places = bind(bind(F.length(F.bin(F.size(h))), likely), repeated)
    return bind(F.array_sort(places), lambda p: F.when(F.size(p) > 0, spread(p)).otherwise(0))


def _repeated(w: Column) -> Column:
    def counted(h: Column) -> Column:
        distinct = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(distinct, 0).otherwise(_covered(h))

    return F.when(F.size(w) > 3, bind(_window_hashes(w), counted)).otherwise(0).cast("bigint")


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated
    hash are sorted.
    """
    return bind(words(text), _repeated)


def word_facts(text: Column) -> Column:
    """A record of the features that need the words, from one pass over the text."""
    return bind(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        _repeated(w).alias("n_repeat_words"),
    ))


#: Features of a text by name.
FEATURES = {
    f.__name__: f for f in (n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words)
}


@dataclass(frozen=True)
class Rule:
    """A named test; true rejects a text and null does not.

    ``rejects`` asks for features by name, so a rule works on texts, whose features are
    computed when the rule is reached, and on features that are columns already.
    """

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def of_text(text: Column, columns: Sequence[str] = ()) -> Callable[[str], Column]:
    """Features of a text by name; those named in ``columns`` are read, not computed."""
    return lambda name: F.col(name) if name in columns else FEATURES[name](text)


#: All thresholds are whole-number comparisons, so that every engine agrees on them.
FEW_WORDS = Rule("few_words", lambda f: f("n_words") < 50)
REPEATED_WORDS = Rule("repeated_words", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words"))
SYMBOL_SHARE = Rule("symbol_share", lambda f: 10 * f("n_symbols") > f("n_words"))
UPPER_SHARE = Rule("upper_share", lambda f: 100 * f("n_upper") > 50 * f("word_chars"))
DUP_LINES = Rule("dup_lines", lambda f: 100 * f("n_dup_lines") > 30 * f("n_lines"))
WORD_LENGTH = Rule(
    "word_length",
    lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words")),
)
RULES = (FEW_WORDS, REPEATED_WORDS, SYMBOL_SHARE, UPPER_SHARE, DUP_LINES, WORD_LENGTH)


def estimate(
    docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of every rule on the first ``sample_rows`` rows.

    A rule's seconds are those of a job that applies it, less those of a job that only
    reads the sample. The figures decide the order of the rules, never the verdict.
    """
    sample = docs.select(F.col(text_col).alias("t")).limit(sample_rows).cache()
    try:
        def timed(value: Column) -> tuple[float, float]:
            began = time.perf_counter()
            share = sample.agg(F.avg(value.cast("double"))).first()[0]
            return time.perf_counter() - began, share or 0.0

        timed(F.col("t").isNull())
        idle = timed(F.col("t").isNull())[0]
        out = []
        for rule in rules:
            timed(F.coalesce(rule.rejects(of_text(F.col("t"))), F.lit(False)))  # compiles the code
            seconds, share = timed(F.coalesce(rule.rejects(of_text(F.col("t"))), F.lit(False)))
            out.append((rule, max(seconds - idle, 1e-4), share))
        return out
    finally:
        sample.unpersist()


def by_rejection_per_cost(figures: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules with the most rejection per second first; ties keep the given order."""
    return [f[0] for f in sorted(figures, key=lambda f: -f[2] / f[1])]


def first_failure(features: Callable[[str], Column], rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a text, null where none does.

    A chain of conditions: a rule is evaluated only for texts that passed all before it.
    """
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(rule.rejects(features), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def quality_filter(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows that pass every rule, with their columns, names and order of columns as given.

    The order of the rules is measured on a sample. Null texts have no words. An empty
    table and an empty list of rules keep everything.
    """
    ordered = by_rejection_per_cost(estimate(docs, rules, text_col, sample_rows))
    return docs.where(first_failure(of_text(F.col(text_col)), ordered).isNull())


def quality_report(
    docs: DataFrame, rules: Sequence[Rule] = RULES, facts: Sequence[str] = (),
    id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, the named facts and ``failed`` (null: kept) of every row.

    Facts are features wanted for every row: they are computed once, and the cascade
    reads them; it computes other features only when it reaches a rule that asks. Which
    of several failing rules is named depends on the measured order; whether a row failed
    does not. Other columns are not read.
    """
    ordered = by_rejection_per_cost(estimate(docs, rules, text_col, sample_rows))
    text = F.col(text_col)
    shared = [name for name in facts if name in ("n_words", "word_chars", "n_repeat_words")]
    known = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"),
        *([word_facts(text).alias("_words")] if shared else []),
        *[FEATURES[name](text).alias(name) for name in facts if name not in shared],
    ).select("*", *[F.col("_words")[name].alias(name) for name in shared])
    failed = first_failure(of_text(F.col("_text"), facts), ordered)
    return known.select("doc_id", *facts, failed.alias("failed"))
