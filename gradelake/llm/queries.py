"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import (chat, dedup_exact, html_text, licenses, lines, minhash, packing, pieces, prefix_trie,
                           quality, runs, simhash, toxicity)
from gradelake.llm.common import LOWER, UPPER, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


@query("op9_exact_dedup", f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest doc_id of equal texts stays, so its negative is the stable id."""
    docs = table(spark, sf_dir, "documents")
    return dedup_exact.exact_dedup(docs, stable_id=-F.col("doc_id"))


_SPACE = r"[\x20\x09-\x0D]"


@query("op5_quality_rules", rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         [x for x in regexp_split_to_array(coalesce(text, ''), '{_SPACE}+') if x <> ''] AS w,
         [x for x in string_split(coalesce(text, ''), chr(10))
          if regexp_replace(x, '{_SPACE}', '', 'g') <> ''] AS lines
  FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i FROM d),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM places JOIN d USING (doc_id)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM
        (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY doc_id),
facts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_upper > 50 * word_chars OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM facts
""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's verdict; the contract's counts are read beside it for every row."""
    facts = quality.quality_report(
        table(spark, sf_dir, "documents"),
        facts=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return facts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("failed").isNull()).alias("kept"),
    )


_SEPARATED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(
    f"('{label}', {len(words)}, [{', '.join(repr(w) for w in sorted(set(words)))}])"
    for label, words in licenses.template_words(licenses.TEMPLATES).items()
)


@query("op3_license_scans", rf"""
WITH phrases(phrase, label) AS (VALUES {_PHRASES}),
templates(label, n, tw) AS (VALUES {_TEMPLATES}),
d AS (SELECT doc_id, {_LOWERED} AS t,
      [x for x in regexp_split_to_array({_LOWERED}, '{_SEPARATED}') if x <> ''] AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d),
found AS (
  SELECT d.doc_id, i, label FROM places JOIN d USING (doc_id), phrases
  WHERE w[i:i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word
         FROM found GROUP BY doc_id),
held AS (SELECT doc_id, label, len(list_intersect(list_distinct(w[i + 1:i + 2 * n]), tw)) AS overlap, len(tw) AS size
         FROM (SELECT doc_id, w, label, tw, n, unnest(range(0, len(w), (n + 1) // 2)) AS i FROM d, templates)),
method AS (SELECT doc_id, label, max(overlap / size) AS share FROM held
           WHERE overlap >= ceil(size * {licenses.THRESHOLD[0]} / {licenses.THRESHOLD[1]})
           GROUP BY doc_id, label),
base_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l
                FROM (SELECT DISTINCT doc_id, label FROM found) GROUP BY doc_id),
all_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM
               (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM method) GROUP BY doc_id),
shares AS (SELECT doc_id, max(share) AS share FROM method GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels.l, '') AS base_labels, coalesce(all_labels.l, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN base_labels USING (doc_id)
LEFT JOIN all_labels USING (doc_id) LEFT JOIN shares USING (doc_id)
""")
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


_ROLE, _SAID = "coalesce(role, '')", "coalesce(text, '')"
_CONFLICT = "<\\|im_(start|end)\\|>|<\\\\+\\|"


@query("op8_chat_formatting", rf"""
WITH c AS (
  SELECT conv_id, turn, {_ROLE} AS role, {_SAID} AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
w AS (SELECT *, CASE WHEN regexp_matches(text, '{_CONFLICT}')
                     THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(shown)) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
""")
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests are read back from the formatted texts and their loss spans."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = chat.END + chat.START + "assistant ok"
    planted = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], said.schema)
    return chat.format_conversations(said.unionByName(planted)).mapInPandas(
        _read_back,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            turns = list(chat.parse(row.formatted))
            told = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            loss = "".join(
                chat.unescape_text(row.formatted[a:b]) for a, b in zip(row.loss_start, row.loss_end))
            rows.append((
                row.conv_id, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss),
                hashlib.sha256(loss.encode()).hexdigest(), len(row.formatted)))
        yield pd.DataFrame(rows, columns=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("op2_line_dedup", rf"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
places AS (SELECT doc_id, l, width, unnest(range(0, len(l) - width + 1)) AS i
           FROM d, (VALUES (1), (2), (3)) AS v(width)),
windows AS (SELECT doc_id, i, width, array_to_string(l[i + 1:i + width], chr(10)) AS w FROM places),
ranked AS (SELECT doc_id, i, width, row_number() OVER (PARTITION BY width, w ORDER BY doc_id, i) AS n
           FROM windows
           WHERE regexp_matches(w, '\S') AND (width = 3 OR len(
               [x for x in regexp_split_to_array(w, '{_SPACE}+') if x <> '']) >= {lines.PASSAGE_WORDS})),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS i FROM ranked WHERE n > 1),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM
         (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM d)
         WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM gone) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS kept_text,
       coalesce(n, 0) AS removed_lines
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).drop("text")


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_documents(docs, model)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    both = pieces.decode_documents(pieces.encode_documents(docs, model), model)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids",
        F.length("decoded").cast("bigint").alias("decoded_chars"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: after each byte eight shifts, marked by -1."""
    steps = f"flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({text}, '')])"
    return (f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda c, x: "
            "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)")


@query("op13_periodic_runs", rf"""
WITH split AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '{_SPACE}+') if x <> ''] AS w,
         {_crc32("doc_id::VARCHAR")} AS h FROM documents),
placed AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
         THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] for i in range(0, n)]
         ELSE w END AS w FROM placed),
words AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
often AS (SELECT doc_id, n, word, list(i ORDER BY i) AS places FROM words GROUP BY ALL HAVING count(*) >= 4),
equal AS (SELECT doc_id, i, unnest([j - i for j in places if j > i and 4 * (j - i) <= n]) AS q
          FROM (SELECT doc_id, n, places, unnest(places) AS i FROM often)),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches
         WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS told,
         first(struct_pack(start := start, length := length, period := period)
               ORDER BY length::DOUBLE / period DESC, start, period) AS best
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by its hash repeats its own words from a place on, as the contract says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", rf"{_SPACE}+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("words"), F.expr("h DIV 10")
    chosen = docs.withColumn("h", h).withColumn(
        "words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)
    ).withColumn("words", F.when(F.size("words") > 0, F.col("words")))
    at = chosen.withColumn("a", (g % n).cast("int")).withColumn(
        "p", F.expr("CAST(1 + (size(words) - a) DIV (3 + (h DIV 10) % 8) AS INT)"))
    again = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    text = F.when(F.col("words").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))
    found = runs.collapse_runs(at.select("doc_id", text.alias("text")))
    best = F.reduce(
        "runs", F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))
    told = F.array_join(F.transform("runs", lambda run: F.concat(
        run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


_SAID_DIGEST = f"md5(concat(CAST(length({_ROLE}) AS VARCHAR), ':', {_ROLE}, {_SAID}))"


@query("op11_conversation_prefix_trie", rf"""
WITH turns AS (
  SELECT conv_id, {_ROLE} AS role, {_SAID} AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_ROLE}, {_SAID_DIGEST}) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, {_crc32("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base
          FROM turns GROUP BY conv_id),
convs AS (SELECT s.conv_id, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS k
          FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT c.conv_id, t.pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + c.k, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (
  SELECT conv_id, pos + 1 AS depth, text,
         list(md5(concat(length(role), ':', role, text))) OVER (PARTITION BY conv_id ORDER BY pos) AS path,
         count(*) OVER (PARTITION BY conv_id) AS size FROM rebuilt),
steps AS (
  SELECT conv_id, depth, path, size = depth AS ends,
         len([x for x in regexp_split_to_array(text, '{_SPACE}+') if x <> '']) AS n_words FROM paths
  UNION ALL
  SELECT c.conv_id, 0, [], NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = c.conv_id), 0 FROM convs c),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * first(n_words) AS saving,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY depth, path),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT n.path[:d] AS path, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saving) AS saved_tokens
  FROM (SELECT n.*, n_children, unnest(range(0, depth + 1)) AS d FROM nodes n LEFT JOIN kids USING (path)) n GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above USING (path) LEFT JOIN kids USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
""")
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations start with turns of the one that opens their twenty, as the contract says."""
    turns = stored(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    opened = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stored(
        sizes.select("conv_id", h.alias("h"), base.alias("base")).join(opened, "base", "left")
        .select("conv_id", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("k")))
    own = turns.where(F.col("pos") >= h).join(convs, "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "said", "n_words")
    first = turns.where("pos < 3").withColumnRenamed("conv_id", "base")
    led = convs.join(first, "base").where("pos < h").select("conv_id", "pos", "said", "n_words")
    return prefix_trie.prefix_trie(led.unionByName(own), convs)
