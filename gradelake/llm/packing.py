"""Mixture-controlled packing: deficit round-robin over source queues, in closed form."""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gradelake.llm.common import stored

#: Tokens of a sequence, and the most tokens a queue sends at once.
SEQUENCE, PACKET = 2048, 256
#: Id that ends every document.
END_ID = 1
#: Rows of a queue that are numbered together.
BLOCK_ROWS = 4096
#: Signs that often end a word.
MARKS = (",", ".")
#: In lower-case Latin-1 without apostrophes: what the tokenizer takes apart, letters, single digits, the rest.
PIECE = re.compile("[a-zß-öø-ÿªºµ]+|[0-9²³¹¼½¾]|[!-&(-/:-@[-`{-~¡-©«¬®-±´¶-¸»¿×÷]+")
PIECES = re.compile(f"(?:{PIECE.pattern})+")
#: White-space separated parts whose ids a task remembers, and text read between look-ups.
REMEMBERED, TOGETHER = 332 << 10, 1 << 20
#: Parts whose ids are learned at once: the tokenizer's answer takes several times the room of the ids.
PORTION = 1 << 12


_ID = attrgetter("id")


class PartIds(dict):
    """Ids of white-space separated parts as bytes of little-endian ``dtype`` numbers.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its parts. It makes letters lower case, which in Latin-1 texts may be done
    first, so that it sees each distinct part once. Behind a letter or digit of Latin-1 a comma
    or full stop that ends a part stands by itself, and the part is not remembered with it.
    Added tokens are found in the text as it stands, whatever is around them; as parts they
    begin with a line feed, which no other part holds but the one that ends a document.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True  # what makes one only in lower case is ordinary text
        self.model = Tokenizer(self.encoder.model)
        mark, names = self.encoder.model.end_of_word_suffix, self.model.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if mark and name.endswith(mark)]] = True
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.as_bytes = {i: as_bytes(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
        self.dtype = np.dtype("<u2" if self.encoder.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        added = {token.content: i for i, token in self.encoder.get_added_tokens_decoder().items()}
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")
        self.fixed = {"\n" + t: array(self.code, [i]).tobytes() for t, i in added.items()}
        self.fixed |= {"": b"", "\n": np.array([end_id], self.dtype).tobytes()}
        self.fixed |= {m: self._encode([m])[0] for m in MARKS}
        self.update(self.fixed)

    def spaced(self, text: str) -> str:
        """A text with single spaces between its parts, the end of the document as the last one."""
        if "<|" in text and len(pieces := self.split.split(text)) > 1:
            return " ".join("\n" + p if i % 2 else p.replace("\n", " ") for i, p in enumerate(pieces)) + " \n"
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ") + " \n"
        return text.lower().replace("\n", " ") + " \n"

    def ids(self, texts: list[str]) -> pa.Array:
        """The ids of texts, each with the end id behind it; distinct parts are looked up once."""
        parts = pc.split_pattern(pa.array(map(self.spaced, texts), pa.large_string()), " ")
        bounds, places = parts.offsets, parts.values.dictionary_encode()
        del parts  # the text is not needed a third time while its words are learned
        distinct = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = pa.array(self.of(distinct), pa.large_binary()).take(places.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[bounds.to_numpy()]
        if ends[-1] > np.iinfo(np.int32).max:
            raise ValueError("the ids of a text take more than 2 GB")
        return pa.Array.from_buffers(
            pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), found.buffers()[2]])

    def of(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; those not known are learned together."""
        found = list(map(self.get, parts))
        used, gaps, missing = found.copy(), [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            part = parts[i]
            if part[-1] in MARKS and part[-2:-1].isalnum() and (part.isascii() or max(part) <= "\xff"):
                core = part[:-1]
                if (ids := self.get(core)) is not None:
                    found[i] = ids + self.fixed[part[-1]]
                    continue
                gaps.append((i, core, self.fixed[part[-1]]))
            else:
                gaps.append((i, part, b""))
            missing.append(gaps[-1][1])
        missing = list(dict.fromkeys(missing))
        if len(self) + len(missing) > REMEMBERED:  # only those of these parts that were known stay
            self.clear()
            self.update(self.fixed)
            self.update((part, ids) for part, ids in zip(parts, used) if ids is not None)
        for a in range(0, len(missing), PORTION):
            self.learn(set(missing[a:a + PORTION]))
        for i, core, mark in gaps:
            found[i] = self[core] + mark
        return found

    def learn(self, parts: set[str]) -> None:
        """Make parts known, from their pieces where they are in lower-case Latin-1."""
        unknown = {p for p in parts if p not in self}  # difference() would walk through all that is known
        words = {p for p in unknown if p.isalpha() and p.islower() and (p.isascii() or max(p) <= "\xff")}
        mixed = {p: PIECE.findall(p) for p in unknown.difference(words) if PIECES.fullmatch(p)}
        pieces = {x for found in mixed.values() for x in found if x not in self}
        words.update(x for x in pieces if x.isalpha())
        rest = list(unknown.union(pieces).difference(words, [p for p, found in mixed.items() if len(found) > 1]))
        self.update(zip(rest, self._encode(rest)))
        self.update(zip(words, self._of_words(words)))
        self.update((p, b"".join(map(self.__getitem__, found))) for p, found in mixed.items())

    def _of_words(self, words: set[str]) -> list[bytes]:
        """Ids of lower-case words in Latin-1, on which the tokenizer's model alone has work to do.

        The ids of all come in one list, where a word's last one is that of a token with the model's end mark.
        """
        plain = [w if w.isascii() else w.translate(self.as_bytes) for w in words]
        found = self.model.encode_batch_fast([plain], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, self.dtype)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(ends) != len(words):  # a model without such marks
            return [array(self.code, map(_ID, self.encoder.model.tokenize(w))).tobytes() for w in plain]
        held = ids.tobytes()
        return [held[a:b] for a, b in zip([0, *ends], ends)]

    def _encode(self, parts: list[str]) -> list[bytes]:
        found = self.encoder.encode_batch_fast(parts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]


_known: dict[tuple[str, int], PartIds] = {}


def tokenize(path: str, end_id: int = END_ID):
    """A task that adds n_tokens and ids to rows of doc_id, source and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.get((path, end_id)) or _known.setdefault((path, end_id), PartIds(path, end_id))
        width = known.dtype.itemsize
        for batch in batches:
            start, held, size = 0, [], 0
            for i, text in enumerate(batch.column("text")):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= TOGETHER or i + 1 == batch.num_rows:
                    gc.disable()  # no cycles are made, and collections would walk through all the lists
                    ids = known.ids(held)
                    gc.enable()
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), part.column("source"),
                        pc.divide(pc.binary_length(ids).cast(pa.int64()), width),
                        ids,
                    ], names=["doc_id", "source", "n_tokens", "ids"])
                    start, held, size = i + 1, [], 0
            pa.default_memory_pool().release_unused()  # workers share an executor's memory with its heap

    return run


def _queued(docs: DataFrame) -> DataFrame:
    """key, doc_id, source, n_tokens, before (tokens ahead in its queue), of_source, of_all.

    A queue is in order of a hash of the id. Its rows are summed by ranges of the hash;
    only the range totals of a queue are added up in one task, so a source that holds most
    rows is spread like any other.
    """
    total = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")).first()
    ranges = max(1, -(-total["rows"] // BLOCK_ROWS))
    place = F.xxhash64("doc_id")
    leading = F.shiftrightunsigned(place, 40)
    light = docs.select(
        "key", "doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens",
        leading.alias("lead"), place.alias("place"),
        F.floor(leading.cast("double") * ranges / (1 << 24)).cast("bigint").alias("range"),
    )
    queue = Window.partitionBy("source")
    sums = light.groupBy("source", "range").agg(F.sum("n_tokens").alias("n")).select(
        "source", "range", F.sum("n").over(queue).alias("of_source"),
        (F.sum("n").over(queue.orderBy("range")) - F.col("n")).alias("ahead"),
    )
    inside = Window.partitionBy("source", "range").orderBy("lead", "place", "doc_id", "key")
    counted = light.withColumn("upto", F.sum("n_tokens").over(inside))
    return counted.join(sums, ["source", "range"]).select(
        "key", "doc_id", "source", "n_tokens",
        (F.col("ahead") + F.col("upto") - F.col("n_tokens")).alias("before"),
        "of_source", F.lit(total["tokens"] or 0).alias("of_all"),
    )


def _served(queued: DataFrame, weights: Mapping[str, float] | None, rounds: int) -> DataFrame:
    """Packets with their place in the one stream that the queues are served into.

    In every round a queue earns its quantum, its share of a sequence, and sends the
    packets it can pay for; what is left stays as its deficit. A queue that is never idle
    has earned k quanta after k rounds, so a packet leaves in the first round whose earnings
    cover all that the queue has sent up to it: no task has to replay the rounds before.
    """
    if weights is None:
        share, late = F.col("of_source") / F.col("of_all"), F.lit(0)
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        given = F.coalesce(known[F.col("source")], F.lit(0.0)) / F.lit(float(sum(weights.values())))
        rest = queued.withColumn("given", given).groupBy("source").agg(
            F.max("given").alias("given"), F.max("of_source").alias("n")
        ).agg(F.max(F.when(F.col("given") > 0, F.ceil(F.col("n") / (F.col("given") * SEQUENCE)))).alias("rounds"),
              F.sum(F.when(F.col("given") == 0, F.col("n"))).alias("n")).first()
        share = F.when(given > 0, given).otherwise(F.col("of_source") / F.lit(rest["n"] or 1))
        late = F.when(given > 0, F.lit(0)).otherwise(F.lit(rest["rounds"] or 0))
    # Sources without a weight go last, in rounds of their own once all others have been sent.
    packets = queued.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / PACKET))).alias("k")
    ).select(
        "key", "doc_id", "source", "n_tokens", (F.col("k") * PACKET).alias("start"),
        F.least(F.lit(PACKET), F.col("n_tokens") - F.col("k") * PACKET).alias("length"),
        (F.col("before") + F.col("k") * PACKET).alias("sent"), share.alias("share"), late.alias("late"),
    )
    turn = F.col("late") + F.ceil((F.col("sent") + F.col("length")) / (F.col("share") * SEQUENCE))
    span = max(256, int(rounds ** 0.5))
    placed = packets.withColumn("round", turn).withColumn("span", F.floor(F.col("round") / span))
    sums = placed.groupBy("span").agg(F.sum("length").alias("n"))
    sums = sums.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("span").orderBy("round", "source", "sent", "key")
    return placed.withColumn("upto", F.sum("length").over(inside)).join(sums, "span").select(
        "key", "doc_id", "source", "n_tokens", "start", "length",
        (F.col("ahead") + F.col("upto") - F.col("length")).alias("at"),
    )


def _cut(width: int):
    """A task that cuts documents' ids at their pieces and takes their checksums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packets, ids = batch.column("packets"), batch.column("ids")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(packets).to_numpy())
            start, length, at = (x.to_numpy() for x in packets.flatten().flatten())
            # No packet is longer than a sequence, so it is in two at most.
            room = np.minimum(length, SEQUENCE - at % SEQUENCE)
            over = length > room
            start, at = np.append(start, (start + room)[over]), np.append(at, (at + room)[over])
            row, length = np.append(row, row[over]), np.append(room, (length - room)[over])
            order = np.lexsort((start, row))
            row, start, length, at = row[order], start[order], length[order], at[order]
            follows = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + length[:-1])
            follows &= (at[1:] == at[:-1] + length[:-1]) & (at[1:] % SEQUENCE > 0)
            first = np.flatnonzero(np.append(row[:1] >= 0, ~follows))
            length = np.add.reduceat(length, first)
            row, start, at = row[first], start[first], at[first]
            crc, whole, held = [], None, -1
            for i, a, n in zip(row.tolist(), start.tolist(), length.tolist()):
                if i != held:
                    whole, held = np.frombuffer(ids[i].as_buffer(), f"<u{width}").astype("<u4"), i
                crc.append(zlib.crc32(whole[a:a + n]))
            of_document = {n: batch.column(n).take(pa.array(row)) for n in ("doc_id", "n_tokens", "source")}
            pieces = pa.RecordBatch.from_arrays(
                [of_document["doc_id"], pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 of_document["n_tokens"], pa.array(at // SEQUENCE), pa.array(at % SEQUENCE), of_document["source"]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])
            for i in range(0, len(row), 1 << 14):
                yield pieces.slice(i, 1 << 14)

    return run


def pack(
    docs: DataFrame, tokenizer: str, weights: Mapping[str, float] | None = None,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Every sequence holds 2048 tokens but the last, so nothing else is padded. ``weights``
    gives the target token shares by source; the default is each source's own share, which
    keeps the mixture the same from the first sequence to the last. Sources without a weight
    follow when the others are through, in the mixture of their own shares. Within a round a
    queue may be ahead or behind by less than a packet, which it carries on.

    Documents are tokenised once and their ids written to the shared folder; a very long text
    is one document like any other, cut into as many pieces as it needs. Ids are those of a
    plain call of the tokenizer, so its added tokens in a text have their own ids. A null text is
    empty and has the end id alone; a null source is the queue of the empty name; rows that
    repeat an id are separate documents; other columns are not read; an empty table gives
    no pieces.
    """
    wanted = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.col(text_col).alias("text"))
    held = stored(
        wanted.mapInArrow(
            tokenize(tokenizer, end_id), "doc_id bigint, source string, n_tokens bigint, ids binary")
        .withColumn("key", F.monotonically_increasing_id())
    )
    facts = held.agg(F.sum("n_tokens").alias("n"), F.sum(F.octet_length("ids")).alias("b")).first()
    if not facts["n"]:
        return held.select(
            "doc_id", *[F.lit(0).cast("bigint").alias(c) for c in (
                "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], "source")
    served = _served(_queued(held.drop("ids")), weights, facts["n"] // SEQUENCE + 1)
    packets = served.groupBy("key").agg(F.collect_list(F.struct("start", "length", "at")).alias("packets"))
    return held.join(packets, "key").select("doc_id", "source", "n_tokens", "ids", "packets").mapInArrow(
        _cut(facts["b"] // facts["n"]),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, source string",
    )
