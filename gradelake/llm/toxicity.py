"""Toxicity by compression distance: one zstandard dictionary of toxic, one of ordinary text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that are learned from, toxic and ordinary, in order of a hash of the id.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2000, 4000
#: Score from which a document counts as toxic.
TOXIC_FROM = 0.7
#: Words of a window, bytes of the ordinary dictionary, compression level.
WIDTH, ORDINARY_BYTES, LEVEL = 12, 64 << 10, 12
#: Bytes a window must gain before its words are looked at one by one.
GATE = 2
#: Words in front of which a short, known text stands, since tiny inputs are not compressed.
ANCHOR = 32
#: Shares of ordinary words that may reach the three calibrated levels.
LEVEL_RATES = (1e-3, 1e-4, 2e-5)
#: Windows that are compressed in one call.
TOGETHER = 1 << 14
_NEAR = 8  # words of a run that is learned from once


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _without_repeats(texts: Iterable[str]) -> list[list[bytes]]:
    """Word lists of texts without the runs of words that an earlier text holds too.

    A text of which less than a run is left is a copy and goes.
    """
    seen: set[int] = set()
    out = []
    for text in texts:
        words = tokens(text)
        runs = [hash(tuple(words[i:i + _NEAR])) for i in range(max(1, len(words) - _NEAR + 1))]
        known = [i for i, run in enumerate(runs) if run in seen]
        gone = {k for i in known for k in range(i, i + _NEAR)}
        left = [w for k, w in enumerate(words) if k not in gone]
        if not known or len(left) >= _NEAR:
            out.append(left)
        seen.update(runs)
    return out


def _windows(words: Sequence[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i:i + WIDTH]) + b" " for i in range(0, len(words), WIDTH)]


def ordinary_dictionary(docs: Sequence[Sequence[bytes]]) -> bytes:
    """A dictionary trained on ordinary windows; few windows are taken as they are."""
    samples = [w for words in docs for w in _windows(words)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-ORDINARY_BYTES:]


def toxic_dictionary(toxic: Sequence[Sequence[bytes]], ordinary: Sequence[Sequence[bytes]]) -> bytes:
    """What recurs in toxic documents and hardly in ordinary ones, the most frequent last.

    Toxic documents are ordinary prose for the most part, so a dictionary of all of it
    would compress both kinds alike.
    """
    in_toxic = Counter(w for words in toxic for w in set(words))
    in_ordinary = Counter(w for words in ordinary for w in set(words))
    least = max(3, 0.004 * len(toxic))
    found = [
        w for w, n in in_toxic.items()
        if n >= least and len(w) > 2
        and n / len(toxic) >= 8 * (in_ordinary[w] + 1) / max(1, len(ordinary))
    ]
    return b"  ".join([b"", *sorted(found, key=lambda w: (in_toxic[w], w)), b""]) if found else b""


@dataclass
class Model:
    """Two dictionaries, calibrated levels and the weights of the document score."""

    ordinary: bytes
    toxic: bytes
    levels: tuple[int, ...] = (3, 5, 6)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    #: Toxic and ordinary texts it was made from, of those given.
    learned: tuple[int, int] = (0, 0)


class Scorer:
    """Compares compression lengths under the two dictionaries."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.plain = self._compressor(model.ordinary)
        # Both share the ordinary content at the same distance, so ordinary windows differ
        # only where toxic content helps.
        self.both = self._compressor(model.toxic + model.ordinary)
        self.anchor = model.ordinary[-ANCHOR - 100:-100]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False,
            write_checksum=False)

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes the toxic dictionary saves on each window."""
        out = np.zeros(len(windows), np.int64)
        for at in range(0, len(windows), TOGETHER):
            part = windows[at:at + TOGETHER]
            sizes = [
                np.fromiter(map(len, c.multi_compress_to_buffer(part, threads=1)), np.int64, len(part))
                for c in (self.plain, self.both)
            ]
            out[at:at + len(part)] = sizes[0] - sizes[1]
        return out

    def word_gains(self, docs: Sequence[Sequence[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Gains of all windows, and of the words in windows that pass the gate, by document."""
        held = [_windows(words) for words in docs]
        ends = np.cumsum([0] + [len(h) for h in held])
        flat = self.gains([w for h in held for w in h])
        coarse = [flat[a:b] for a, b in zip(ends, ends[1:])]
        suspects = [
            [self.anchor + b" " + word + b" " for i in np.flatnonzero(c >= GATE) for word in h[i].split()]
            for h, c in zip(held, coarse)
        ]
        ends = np.cumsum([0] + [len(s) for s in suspects])
        flat = self.gains([w for s in suspects for w in s])
        return coarse, [flat[a:b] for a, b in zip(ends, ends[1:])]

    def features(self, docs: Sequence[Sequence[bytes]]) -> np.ndarray:
        rows = []
        for words, coarse, fine in zip(docs, *self.word_gains(docs)):
            top = np.sort(coarse)[::-1][:2] if len(coarse) else np.zeros(1)
            hits = [(fine >= level).sum() for level in self.model.levels]
            rows.append([
                top[0], top.sum(), fine.max() if len(fine) else 0, *np.log1p(hits),
                np.log1p(np.maximum(coarse - GATE, 0).sum()), np.log1p(len(words)),
            ])
        return np.array(rows, float).reshape(len(docs), 8)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Scores from 0 to 1; a model without toxic content knows no toxic text."""
        out = np.zeros(len(texts))
        if not len(self.model.weights):
            return out
        part, size, start = [], 0, 0
        for i, text in enumerate(texts):
            part.append(tokens(text))
            size += len(part[-1])
            if size >= TOGETHER * WIDTH or i + 1 == len(texts):
                out[start:i + 1] = _chance(self.features(part), self.model)
                part, size, start = [], 0, i + 1
        return out


def _chance(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale]) @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(toxic: Sequence[str], ordinary: Sequence[str], toxic_share: float) -> Model:
    """A model from labelled texts.

    Two thirds of the texts make the dictionaries; the rest calibrates the levels, so that
    only stated shares of ordinary words reach them, and the document score, whose
    intercept is moved from the shares in the sample to ``toxic_share``.

    A run of eight words that an earlier text of its kind holds is cut out of later ones, so
    that copies neither count as many nor calibrate what they made; what a text holds beside
    it is learned from. Where toxic text is such a run itself, nothing recurs after the cut,
    and the toxic texts are taken whole. ``learned`` counts the texts left. No toxic text
    gives a model that knows none; toxic texts that give no model are an error.
    """
    good = _without_repeats(ordinary)
    model = _trained(_without_repeats(toxic), good, toxic_share)
    if toxic and not len(model.weights):
        model = _trained([tokens(t) for t in toxic], good, toxic_share)
        if not len(model.weights):
            raise ValueError(
                f"no toxicity model from {len(toxic)} toxic and {len(ordinary)} ordinary texts, "
                f"{len(good)} of them without copies: too few, or no word recurs in the toxic ones")
    return model


def _trained(bad: list[list[bytes]], good: list[list[bytes]], toxic_share: float) -> Model:
    fit_bad, fit_good = bad[: 2 * len(bad) // 3], good[: 2 * len(good) // 3]
    model = Model(ordinary_dictionary(fit_good), toxic_dictionary(fit_bad, fit_good), learned=(len(bad), len(good)))
    rest_bad, rest_good = bad[len(fit_bad):], good[len(fit_good):]
    if not model.toxic or not rest_bad or not rest_good or len(model.ordinary) < 2 * ANCHOR + 100:
        return model
    scorer = Scorer(model)
    _, fine = scorer.word_gains(rest_good)
    reached, all_words = np.concatenate(fine), sum(map(len, rest_good)) + 1
    model.levels = tuple(
        next(g for g in range(GATE + 1, 1000) if (reached >= g).sum() <= rate * all_words)
        for rate in LEVEL_RATES
    )
    x = scorer.features([*rest_good, *rest_bad])
    y = np.repeat([0.0, 1.0], [len(rest_good), len(rest_bad)])
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _fit((x - model.center) / model.scale, y)
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    model.weights[0] += np.log(share / (1 - share)) - np.log(len(rest_bad) / len(rest_good))
    return model


def held_out(ident: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY,
) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out.

    At most ``sample_toxic`` and ``sample_ordinary`` rows, by a hash of the id, reach the
    driver. Rows without an id, a label or a document are not learned from. Repeats among
    them are cut as ``train`` says.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    chosen = None
    for value, most in ((1, sample_toxic), (0, sample_ordinary)):
        part = usable.where(F.col("toxic") == value).select(
            F.col(id_col).alias("_id"), F.col("toxic").alias("_toxic")).orderBy(
            F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most sample_toxic + sample_ordinary ids: a bounded broadcast.
    sample = (
        docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
        .select("_toxic", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
        .orderBy("_o0", "_o1", "_text").limit(sample_toxic + sample_ordinary)
    )
    toxic: list[str] = []
    ordinary: list[str] = []
    for row in sample.toLocalIterator():
        (toxic if row["_toxic"] == 1 else ordinary).append(row["_text"])
    total = counts.get(0, 0) + counts.get(1, 0)
    return train(toxic, ordinary, counts.get(1, 0) / max(1, total))


def score_column(model: Model, text: Column) -> Column:
    """Score of each whole text, 0 to 1; null counts as empty."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)))

    return scored(text)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; one pass, no shuffle.

    Every text is read whole, in windows. Null and empty texts get the score of no words.
    Repeated rows score alike; rows without an id are not held out; other columns are not
    read.
    """
    ident = F.col(id_col)
    scored = docs.select(
        ident.alias("doc_id"), held_out(ident).alias("held_out"),
        score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows whose text scores below the threshold, with their columns as given."""
    return docs.where(score_column(model, F.col(text_col)) < TOXIC_FROM)
