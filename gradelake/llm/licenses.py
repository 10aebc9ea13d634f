"""License scans: an exact set-similarity join of text blocks with templates. Native."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import bind
from gradelake.llm.common import lower_ascii, stored

#: Phrases whose words mark a licence, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Licence statements and notices by label.
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under "
                   "the terms of the gnu general public license as published by the free "
                   "software foundation",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of "
                 "this software and associated documentation files to deal in the software "
                 "without restriction",
    "mit-notice": "released under the mit license",
    "apache-2.0-header":
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    "bsd-3-clause":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    "gpl-3.0-header":
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    "isc":
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    "zlib":
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely.",
}
#: Share of a template's words, as numerator and denominator, that a block must hold.
THRESHOLD = (9, 10)
#: Characters that separate words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(lowered: Column) -> Column:
    """The words of a lower-cased text with one space between them."""
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def template_words(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """The words of every template that has some."""
    split = {label: re.sub(SEPARATORS, " ", text.lower()).split() for label, text in templates.items()}
    return {label: words for label, words in split.items() if words}


def required(words: Sequence[str], threshold: tuple[int, int]) -> int:
    """How many of a template's distinct words a block must hold."""
    return math.ceil(len(set(words)) * threshold[0] / threshold[1])


def _row(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text_col).alias("t")


def word_order(read: DataFrame, words: Mapping[str, Sequence[str]]) -> list[str]:
    """The templates' words, those in the fewest texts of the whole corpus first.

    All that reaches the driver is a count per word of the templates.
    """
    vocabulary = sorted({w for own in words.values() for w in own})
    held = F.filter(F.split("w", " "), lambda w: w.isin(vocabulary))
    counts = read.select(F.explode(F.array_distinct(held)).alias("word")).groupBy("word").count()
    seen = {row["word"]: row["count"] for row in counts.collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def prefix_index(words: Mapping[str, Sequence[str]], order: Sequence[str], threshold: tuple[int, int]) -> list[tuple]:
    """word, label, template (its words in order), need, span, step of every word of a template's prefix.

    A block with the needed words of a template holds one of its first ``size - need + 1``:
    the others are too few.
    """
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, own in words.items():
        mine, need = sorted(set(own), key=rank.__getitem__), required(own, threshold)
        for word in mine[:len(mine) - need + 1]:
            index.append((word, label, mine, need, 2 * len(own), (len(own) + 1) // 2))
    return index


def _hits(index: list[tuple]) -> Callable[[Column], Column]:
    """From a word array to i, word, start and around: each prefix word with the words about it.

    So many words are kept as the longest template needs that begins with the word.
    """
    reach: dict[str, int] = {}
    for word, _, _, _, span, _ in index:
        size = 1 << (span - 1).bit_length()  # a few sizes only
        reach[word] = max(size, reach.get(word, 0))

    def hits(words: Column) -> Column:
        def one(place: Column) -> Column:
            size = F.lit(0)
            for span in sorted(set(reach.values())):
                size = F.when(place["word"].isin([w for w, own in reach.items() if own == span]), span).otherwise(size)
            start = F.greatest(F.lit(0), place["i"] - size + 1)
            return F.struct(
                place["i"].alias("i"), place["word"].alias("word"), start.alias("start"),
                F.slice(words, start + 1, 2 * size).alias("around"))

        places = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("word")))
        return F.transform(F.filter(places, lambda p: p["word"].isin(list(reach))), one)

    return hits


def license_join(read: DataFrame, index: list[tuple]) -> DataFrame:
    """doc_id, t, label, overlap, size: every block that holds enough of a template.

    ``read`` has doc_id, t and hits. For a template of n words a block is 2n words of the text from a
    place that is a multiple of half of n (rounded up), line feeds or not: a passage of up
    to one and a half times the template lies in one, and words further apart in none. A
    block meets a template by a word of the template's prefix; the block needs as many words as
    the overlap (length filter), and none of the template's words before the prefix word may stand in it, so that it
    still has enough from there on (positional filter) and a pair is compared in full once.
    """
    spark = read.sparkSession
    table = spark.createDataFrame(
        index, "word string, label string, template array<string>, need int, span int, step int")
    met = read.select("doc_id", "t", F.inline("hits")).join(F.broadcast(table), "word")  # as long as the templates
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("span") + 1) / F.col("step")).cast("int"))
    last = F.floor(F.col("i") / F.col("step")).cast("int")
    blocks = met.select(
        "*", F.explode(F.sequence(first, last)).alias("k")
    ).withColumn("block", F.slice("around", F.col("k") * F.col("step") - F.col("start") + 1, F.col("span")))
    common = F.array_intersect("template", "block")
    return (
        blocks.where(F.size("block") >= F.col("need")).withColumn("common", common)
        .where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")))
        .select("doc_id", "t", "label", F.size("common").alias("overlap"), F.size("template").alias("size"))
    )


def _finder(tokens: Sequence[str]) -> Callable[[Column], Column]:
    """From a word array to the positions at which the tokens stand one after the other."""
    def starts(w: Column) -> Column:
        def found(i: Column) -> Column:
            test = F.get(w, i) == tokens[0]
            for k, token in enumerate(tokens[1:], 1):
                test = test & (F.get(w, i + k) == token)
            return test

        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), found)

    return starts


def phrase_places(spaced: Column, phrases: Sequence[str]) -> Column:
    """Word positions, from 0, at which one of the phrases starts.

    Only texts that hold a phrase are split into words.
    """
    framed = F.concat(F.lit(" "), spaced, F.lit(" "))
    none = F.array().cast("array<int>")
    return F.concat(none, *[
        F.when(
            framed.contains(f" {phrase} "),
            bind(F.split(spaced, " "), _finder(phrase.split())),
        ).otherwise(none)
        for phrase in phrases
    ])


def license_scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES,
    threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Phrases are found word by word, templates by ``license_join`` with ``threshold`` of their
    distinct words. The score is the largest share of a template that a block holds, and 1
    where a phrase was found. No label gives an empty string, no place a null position.

    A null text counts as empty. Rows that repeat an id are labelled by their own text; a null
    id stays null. A very long text is read by the task that has its row, and only the words
    about a rare one leave it. Other columns are not read, whatever their names; an empty
    table gives an empty result, and without templates the phrases alone count.
    """
    read = docs.select(
        F.col(id_col).alias("doc_id"), _row(text_col), spaced_words(lower_ascii(F.col(text_col))).alias("w"))
    words = template_words(templates)
    index = prefix_index(words, word_order(read, words), threshold) if words else []
    framed = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    found = read.select(
        "doc_id", "t",
        F.when(F.col("w") == "", F.lit(0))
        .otherwise(F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1)
        .cast("bigint").alias("n_words"),
        phrase_places(F.col("w"), list(phrases)).alias("places"),
        F.array_compact(F.array(*[
            F.when(framed.contains(f" {phrase} "), F.lit(label)) for phrase, label in phrases.items()
        ]).cast("array<string>")).alias("base"),
        *([bind(F.split("w", " "), _hits(index)).alias("hits")] if index else []),
    )
    none = F.array().cast("array<string>")
    if index:
        found = stored(found)  # without the texts; the join and the result both read it
        matches = license_join(found, index).groupBy(F.col("doc_id").alias("of"), F.col("t").alias("of_t")).agg(
            F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("share"))
        joined = found.join(
            matches, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")), "left")
    else:
        joined = found.withColumn("more", none).withColumn("share", F.lit(0.0))
    every = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
        .alias("score"),
    )
