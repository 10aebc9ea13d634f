"""Text, number and JSON functions used by the scorers.

All of them are native Column expressions, so scoring stays inside the JVM.
NFKC is not a Spark function; ICU, which Spark itself ships, is called through
the public ``reflect`` function, and only for rows that hold non-ASCII text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space JavaScript trims and collapses.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Number formats accepted in an output. Sign and currency sign are
# unambiguous, so possessive quantifiers match the same texts faster.
NUMBER = (
    rf"-?+[$€£¥]?+{WS}?+-?+(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?%?"
)
# Most characters a number can have before its first digit: -$ -
NUMBER_LEAD = 4
# A JSON text that is a bare scalar.
JSON_SCALAR = (
    r"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    r'|"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
)
# Tokens of a possibly broken JSON text: string literals (an unclosed one runs
# to the end), single brackets, anything else. Possessive, so long inputs do
# not use the regex stack.
CARVE_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+"?+|[{}\[\]]|[^"{}\[\]]++'
# Tokens of compact, valid JSON: keys with their colon, strings, punctuation, literals.
JSON_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+":?+|[{}\[\],]|[^"{}\[\],:]++'


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A plain reuse of a Column repeats its evaluation inside conditions and lambdas.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    """Trim with JavaScript's white-space set (F2)."""
    return F.regexp_replace(c, rf"^{WS}++|{WS}++$", "")


def is_blank(c: Column) -> Column:
    """True when nothing but white space is left."""
    return js_trim(c) == ""


def nfkc(c: Column) -> Column:
    """Unicode NFKC."""
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def normalize_text(c: Column) -> Column:
    """NFKC, lower case, collapsed white space, trimmed (F1)."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c)), rf"{WS}++", " "))


def normalize_literal(text: str) -> str:
    """``normalize_text`` of a value that is known on the driver."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def _number_of(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"[^0-9.]", "")
    value = digits.try_cast("double")
    return F.when(raw.contains("-"), -value).otherwise(value)


def number_in(normalized: Column) -> Column:
    """First number of an NFKC text, as ``struct<value, raw>``, or null.

    The first number holds the first digit, so the costly pattern is tried from
    just before that digit only.
    """
    def near(text: Column) -> Column:
        digit = F.regexp_instr(text, F.lit("[0-9]"))
        tail = F.substr(text, F.greatest(F.lit(1), digit - NUMBER_LEAD))
        return F.when(digit > 0, F.regexp_extract(tail, NUMBER, 0))

    return bind(
        bind(normalized, near),
        lambda raw: F.when(
            raw.isNotNull(), F.struct(_number_of(raw).alias("value"), raw.alias("raw"))
        ),
    )


def parse_first_number(c: Column) -> Column:
    """First number of any text, as ``struct<value, raw>``, or null."""
    return number_in(nfkc(c))


def scalar_key(c: Column) -> Column:
    """Comparison key of a string scalar: a number when it is purely one."""
    def keyed(text: Column) -> Column:
        is_number = text.rlike(rf"^{NUMBER}$")
        return F.when(is_number, number_key(_number_of(text))).otherwise(
            F.concat(F.lit("s:"), text)
        )

    return bind(normalize_text(c), keyed)


def number_key(c: Column) -> Column:
    """Comparison key of a number; minus zero equals zero."""
    return F.concat(F.lit("n:"), (c.cast("double") + F.lit(0.0)).cast("string"))


def json_kind(v: Column) -> Column:
    """First character of the JSON text of a VARIANT, which tells its type."""
    return F.left(F.to_json(v), F.lit(1))


def _token_key(token: Column) -> Column:
    head = F.left(token, F.lit(1))
    text = F.try_variant_get(F.try_parse_json(token), "$", "string")
    return (
        F.when((head == '"') & token.endswith(":"), F.concat(F.lit("k:"), token))
        .when(head == '"', scalar_key(text))
        .when(head.rlike("[-0-9]"), number_key(token.try_cast("double")))
        .otherwise(token)
    )


def value_key(v: Column) -> Column:
    """Comparison key of any JSON value.

    Two values are equal exactly when their keys are: scalars are normalised
    (F4), arrays compare in order, objects by sorted key set, at any depth. A
    VARIANT keeps object keys sorted, so its JSON text is already canonical in
    key order and only the scalar tokens need work.
    """
    def keyed(v: Column, text: Column) -> Column:
        head = F.left(text, F.lit(1))
        tokens = F.transform(F.regexp_extract_all(text, F.lit(JSON_TOKENS), F.lit(0)), _token_key)
        return (
            F.when(head == '"', scalar_key(F.try_variant_get(v, "$", "string")))
            .when(head.isin("{", "["), F.array_join(tokens, "\x01"))
            .when(head.rlike("[-0-9]"), number_key(F.try_variant_get(v, "$", "double")))
            .otherwise(text)
        )

    return bind(v, lambda one: bind(F.to_json(one), lambda text: keyed(one, text)))


def fields_equal(actual: Column, expected: Column) -> Column:
    """Field equality; a missing expected value never matches."""
    return F.coalesce(value_key(actual) == value_key(expected), F.lit(False))


def _carved(tail: Column) -> Column:
    """Length of the balanced value that ``tail`` starts with, or null."""
    opener = F.left(tail, F.lit(1))
    closer = F.when(opener == "{", "}").otherwise("]")
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("end")
    )

    def step(acc: Column, token: Column) -> Column:
        depth = (
            acc["depth"]
            + F.when(token == opener, 1).when(token == closer, -1).otherwise(0)
        )
        pos = acc["pos"] + F.length(token)
        end = F.when(acc["end"].isNotNull(), acc["end"]).when(
            (depth == 0) & (token == closer), pos
        )
        return F.struct(depth.alias("depth"), pos.alias("pos"), end.alias("end"))

    tokens = F.regexp_extract_all(tail, F.lit(CARVE_TOKENS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda acc: acc["end"])


def extract_json(c: Column) -> Column:
    """JSON carved out of an output.

    ``struct<value VARIANT, ok, extraction_needed, error>``. The whole trimmed
    text is taken when it is JSON. Otherwise the first ``{`` or ``[`` decides:
    brackets of that kind are balanced outside string literals and the piece is
    parsed; there is no second try. Positions are code points.
    """
    def located(text: Column) -> Column:
        start = F.regexp_instr(text, F.lit(r"[{\[]")) - 1
        tail = F.substr(text, start + 1)
        return bind(
            F.struct(text.alias("text"), start.alias("start"), tail.alias("tail")),
            lambda p: bind(F.when(p["start"] >= 0, _carved(p["tail"])), lambda end: parsed(p, end)),
        )

    def parsed(p: Column, end: Column) -> Column:
        scalar = ~p["text"].rlike(r"^[{\[]") & p["text"].rlike(rf"^{JSON_SCALAR}$")
        return bind(
            F.struct(
                F.try_parse_json(
                    F.when(scalar, p["text"]).when(end.isNotNull(), F.left(p["tail"], end))
                ).alias("value"),
                scalar.alias("scalar"),
            ),
            lambda found: finish(p, end, found["value"], found["scalar"]),
        )

    def finish(p: Column, end: Column, value: Column, scalar: Column) -> Column:
        where = p["start"].cast("string")
        kind = F.when(F.left(p["tail"], F.lit(1)) == "{", "object").otherwise("array")
        error = (
            F.when(value.isNotNull(), F.lit(None).cast("string"))
            .when(p["start"] < 0, "output contains no JSON object or array")
            .when(
                end.isNull(),
                F.concat(
                    F.lit("output contains an unclosed "), kind,
                    F.lit(" starting at character "), where,
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("balanced candidate at character "), where, F.lit(" is not valid JSON")
                )
            )
        )
        whole = scalar | ((p["start"] == 0) & (end == F.length(p["text"])))
        needed = (p["start"] >= 0) & ~(F.coalesce(whole, F.lit(False)) & value.isNotNull())
        return F.struct(
            value.alias("value"),
            value.isNotNull().alias("ok"),
            needed.alias("extraction_needed"),
            error.alias("error"),
        )

    return F.when(c.isNotNull(), bind(js_trim(c), located))



def kebab(c: Column) -> Column:
    """Lower case, other characters to single dashes, no outer dashes."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def strict_json(c: Column) -> Column:
    """VARIANT of a text that is JSON as a whole, or null."""
    return bind(
        extract_json(c), lambda x: F.when(x["ok"] & ~x["extraction_needed"], x["value"])
    )


def json_string(v: Column) -> Column:
    """Text of a VARIANT that is a JSON string, else null."""
    return bind(v, lambda x: F.when(json_kind(x) == '"', F.try_variant_get(x, "$", "string")))


def json_number(v: Column, kind: str = "double") -> Column:
    """Value of a VARIANT that is a JSON number, else null."""
    return bind(
        v, lambda x: F.when(json_kind(x).rlike("^[-0-9]"), F.try_variant_get(x, "$", kind))
    )


def error_message(body: Column) -> Column:
    """Message of an error body."""
    text = json_string(F.try_variant_get(strict_json(body), "$.error", "variant"))
    trimmed = js_trim(body)
    return F.coalesce(text, F.when(trimmed == "", "empty error response").otherwise(trimmed))


def utc_date(ms: Column) -> Column:
    """UTC calendar date of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def sanitize_path(c: Column) -> Column:
    """Keep letters, digits, dot, underscore and dash (part of P17)."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "-")
