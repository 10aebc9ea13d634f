"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import Recent

SPACE = "▁"
#: Longest segment whose ids are remembered, and how many are.
REMEMBERED_CHARS, REMEMBERED = 64, 3 << 16
#: Pairs of pieces whose order is remembered.
REMEMBERED_PAIRS = 1 << 19
#: Positions read between two looks for a boundary on which all paths agree.
STRIDE = 64


class Vocabulary:
    """Pieces, scores and byte ids of a model, and which pieces may follow each other.

    A model of kind ``bpe`` allows a piece after another where merging by score leaves the
    two apart; then exactly one path reaches each position, and it is the model's own
    segmentation. A model of kind ``unigram`` takes the path with the largest total score.
    """

    def __init__(self, model_file: str, kind: str = "bpe") -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        numbers = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in numbers]
        names = [model.id_to_piece(i) for i in numbers]
        self.bytes = {int(names[i][3:5], 16): i for i in numbers if model.is_byte(i)}
        plain = [i for i in numbers if not special[i] and not model.is_byte(i)]
        self._setup({names[i]: i for i in plain}, {names[i]: model.get_score(i) for i in plain},
                    kind, self.bytes, model.unk_id())

    def _setup(self, ids, scores, kind, byte_ids, unknown) -> None:
        self.ids, self.scores, self.kind = ids, scores, kind
        self.bytes, self.unknown = byte_ids, unknown
        self.longest = max(map(len, ids))
        self.chars = {p for p in ids if len(p) == 1}
        self.names = {i: p for p, i in ids.items()}
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.apart: dict[int, bool] = {}
        # A boundary no piece can cross: in front of a space mark after anything else.
        crossing = any(SPACE in p.lstrip(SPACE) for p in ids)
        feed = any("\n" in p for p in ids)
        # An automaton over the beginnings of pieces, made as texts need it: a node has the longest beginning
        # that ends the text read, the nodes that follow by character, and the pieces that end here, longest first.
        self.starts = {p[:i] for p in ids for i in range(1, len(p) + 1)}
        self.ends = {p: (len(p), i) for p, i in ids.items()}
        self.inside = {p[i:i + 2] for p in ids for i in range(len(p) - 1)}
        self.root = ("", {}, ())
        self.nodes: dict[str, tuple] = {}
        self.by_line = not crossing and not feed
        self.cut = None if crossing else re.compile(
            f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if feed else f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    @classmethod
    def of(cls, ids: dict[str, int], scores: dict[str, float], kind: str, byte_ids: dict[int, int], unknown: int = 0):
        """A vocabulary from its parts."""
        made = cls.__new__(cls)
        made._setup(ids, scores, kind, byte_ids, unknown)
        return made

    def step(self, node: tuple, char: str) -> tuple:
        """The node behind a node by a character that is a piece."""
        text = node[0] + char
        while text not in self.starts:
            text = text[1:]
        found = self.nodes.get(text)
        if found is None:
            ends = tuple(self.ends[text[k:]] for k in range(len(text)) if text[k:] in self.ends)
            found = self.nodes[text] = (text, {}, ends)
        node[1][char] = found
        return found

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first among equals."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        found = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while found and (best := max(found)) > none:
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at > 0:
                found[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces apart; -1 on the left is the start."""
        if len(self.apart) >= REMEMBERED_PAIRS:
            self.apart.clear()
        parts = [self.names[i] for i in (left, right) if i >= 0]
        known = self.apart[left << 32 | right] = self.merged("".join(parts)) == parts
        return known

    def fallback(self, char: str) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in char.encode()]
        return [self.unknown]


class StreamingViterbi:
    """Encodes text that comes in parts; keeps only what is not decided yet.

    Any later piece starts at one of the last ``longest`` positions. Their backpointers are
    followed, the farthest first, until one position is left: all surviving paths cross it,
    so the ids in front of it are final and are committed. A character without a piece ends
    every path and commits as well.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.node = vocabulary.root
        self.back: list[int] = [0]
        self.last: list[int] = [-1]
        self.best: list[float] = [0.0]
        self.since = 0
        self.widest = 0

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        chars, reach, at = self.v.chars, self._scored if self.v.kind != "bpe" else self._apart, 0
        while at < len(text):
            at = reach(text, at, min(len(text), at + STRIDE - self.since))
            self.widest = max(self.widest, len(self.back) - 1)
            if self.since >= STRIDE:
                out += self._commit(self._agreed())
                self.since = 0
            elif at < len(text) and text[at] not in chars:
                out += self.finish()
                out += self.v.fallback(text[at])
                at += 1
        return out

    def _apart(self, text: str, at: int, stop: int) -> int:
        """Extend the one path of every place up to ``stop`` or a character without a piece; where that is."""
        v, node, back, last = self.v, self.node, self.back, self.last
        apart, i, first = v.apart, len(back), at
        while at < stop:
            char = text[at]
            then = node[1].get(char)
            if then is None:
                if char not in v.chars:
                    break
                then = v.step(node, char)
            node = then
            for length, piece in node[2]:
                j = i - length
                if j >= 0:
                    left = last[j]
                    allowed = apart.get(left << 32 | piece)
                    if allowed is None:
                        allowed = v.may_follow(left, piece)
                    if allowed:
                        back.append(j)
                        last.append(piece)
                        break
            else:
                raise ValueError(f"no path reaches some place of {text!r}")
            i += 1
            at += 1
        self.node = node
        self.since += at - first
        return at

    def _scored(self, text: str, at: int, stop: int) -> int:
        """The same for the path with the largest total."""
        v, back, last, best = self.v, self.back, self.last, self.best
        while at < stop and text[at] in v.chars:
            self.node = self.node[1].get(text[at]) or v.step(self.node, text[at])
            total, way, end = float("-inf"), -1, -1
            for length, piece in self.node[2]:
                j = len(back) - length
                if j >= 0 and best[j] + v.scores[v.names[piece]] > total:
                    total, way, end = best[j] + v.scores[v.names[piece]], j, piece
            if way < 0:
                raise ValueError(f"no path reaches some place of {text!r}")
            back.append(way)
            last.append(end)
            best.append(total)
            self.since += 1
            at += 1
        return at

    def _agreed(self) -> int:
        n = len(self.back) - 1
        live = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(live) > 1:
            farthest = max(live)
            live.remove(farthest)
            live.add(self.back[farthest])
        return live.pop()

    def _path(self, end: int) -> list[int]:
        ids = []
        while end > 0:
            ids.append(self.last[end])
            end = self.back[end]
        return ids[::-1]

    def _commit(self, at: int) -> list[int]:
        if at <= 0:
            return []
        ids = self._path(at)
        # The piece in front of the boundary stays known: it decides what may follow it.
        self.back = [max(0, b - at) for b in self.back[at:]]
        self.last = self.last[at:]
        self.best = [b - self.best[at] for b in self.best[at:]]
        return ids

    def finish(self) -> list[int]:
        """The ids of all that was not committed; ready for a new text."""
        ids = self._path(len(self.back) - 1)
        self.node, self.back, self.last, self.best, self.since = self.v.root, [0], [-1], [0.0], 0
        return ids


class _Words(dict):
    """Ids of words that follow a space."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and not word[-1].isalnum() and word[-2:] not in self.encoder.v.inside:
            # No piece holds the last two characters, so every path crosses between them.
            ids = self[word[:-1]] + self.encoder[word[-1]]
        else:
            ids = self.encoder.searched(SPACE + word)
        if len(word) < REMEMBERED_CHARS:
            if len(self) >= 2 * REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder(dict):
    """Ids of segments as bytes; segments that no piece crosses are remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary
        self.stream = StreamingViterbi(vocabulary)
        self.cores = Recent(REMEMBERED)
        self.words = _Words(self)
        self.feed = self["\n"]

    def __missing__(self, segment: str) -> bytes:
        if len(segment) > REMEMBERED_CHARS:
            return self.searched(segment)
        ids = self.cores.get(segment)
        if ids is None:
            ids = self.searched(segment)
            self.cores.put(segment, ids)
        return ids

    def _by_word(self, text: str) -> bytes:
        """The same for texts with single spaces: words are looked up as they stand."""
        first, *others = text.split("\n")
        out = list(map(self.words.__getitem__, first.split(" ")))
        for line in others:
            opening, *rest = line.split(" ")
            out.append(self.feed)
            if opening:
                out.append(self[opening])
            out += map(self.words.__getitem__, rest)
        return b"".join(out)

    def searched(self, segment: str) -> bytes:
        ids = array("I", self.stream.feed(segment) + self.stream.finish())
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.v.by_line and text[0] != " " and "  " not in text and SPACE not in text:
            return self._by_word(text)
        marked = SPACE + text.replace(" ", SPACE)
        if self.v.cut is None:
            return self[marked]
        return b"".join(map(self.__getitem__, self.v.cut.findall(marked)))


class Decoder:
    """Texts of lists of ids, as ``decode`` makes them, for whole batches.

    A piece is whole UTF-8, so bytes that make no character are told apart in the joined bytes as well.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        known = {i: p.encode() for i, p in vocabulary.names.items()}
        known = {i: bytes([b]) for i, b in vocabulary.byte_of.items()} | known
        self.none = max(known) + 1
        self.pieces = pa.array([known.get(i, b"") for i in range(self.none + 1)], pa.binary())

    def texts(self, lists: pa.ListArray) -> pa.Array:
        ends = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
        taken = self.pieces.take(pa.array(np.where((ids >= 0) & (ids < self.none), ids, self.none)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0]), taken), b"")
        spaced = pc.replace_substring(joined, SPACE.encode(), b" ")
        try:
            texts = spaced.cast(pa.string())
        except pa.ArrowInvalid:  # some text is no UTF-8
            texts = pa.array([t.as_py().decode(errors="replace") for t in spaced], pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of ids: space marks become spaces, the one in front goes, bytes are joined."""
    out: list[str] = []
    raw = bytearray()
    names, byte_of = vocabulary.names, vocabulary.byte_of
    for i in ids:
        name = names.get(i)
        if name is None:
            if i in byte_of:
                raw.append(byte_of[i])
            continue
        if raw:
            out.append(raw.decode(errors="replace"))
            raw.clear()
        out.append(name)
    if raw:
        out.append(raw.decode(errors="replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few ids are held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(model_file: str, kind: str) -> Encoder:
    key = (model_file, kind)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(model_file, kind))
    return _encoders[key]


def encode_documents(
    docs: DataFrame, model_file: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text, ids (array of int) of every row; one pass, no shuffle.

    Whole texts are encoded, spaces as they stand. Null and empty texts have no ids.
    Repeated rows give repeated results; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file, kind)
        for batch in _small(batches):
            found = [encoder.encode(t.as_py()) for t in batch.column("text")]
            ends = np.cumsum([0] + [len(f) // 4 for f in found]).astype(np.int32)
            values = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["doc_id", "text", "ids"])

    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id bigint, text string, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """Rows of ``encode_documents`` with ``decoded``; no ids give an empty text.

    A text is recovered exactly unless it holds the space mark itself, which the model
    cannot tell from a space.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_encoder(model_file, kind).v)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, decoder.texts(batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id bigint, text string, ids array<int>, decoded string")
