"""Best-two-fit packing of documents into token sequences of bounded length.

A sequence is filled greedily, longest piece first and each next one the longest that fits; then its smallest piece
is replaced by two unpacked pieces that fill the widened gap more tightly, as long as there are such pieces. The
choice depends on lengths only, and the number of pieces of each length is a table of at most `capacity` rows, so the
plan is made from that table: one pattern of lengths and how many sequences take it, at most one pattern for each
length that it uses up. Which piece goes where is a numbering of the pieces of each length, made by Spark.
"""

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, lean, tidy
from quire.llm.words import Known, chunks, gathered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ASCII marks that are no part of a contraction: at the end of a word they are a token run of their own.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Words:
    """Token ids, as little-endian unsigned 32-bit bytes, of words, which the tokenizer never joins across white space.

    Runs of letters go to the tokenizer as one text: each ends with the one token that closes a run. Other words, and
    all if the count of these ends is not that of the words, go one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.runs = Known(self.letters)
        self.known = Known(self.joined)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[bytes]) -> list[bytes]:
        out, texts = [b""] * len(words), [w.decode("utf-8", "surrogatepass") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in plain)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                flat, ends = ids.astype("<u4").tobytes(), ends.tolist()
                for i, a, b in zip(plain, [0, *ends], ends, strict=False):
                    out[i] = flat[4 * a : 4 * b]
        odd = [i for i, x in enumerate(out) if not x]
        for i, x in zip(odd, self.encode([texts[i] for i in odd]), strict=True):
            out[i] = x
        return out

    def joined(self, words: list[bytes]) -> list[bytes]:
        """A letter before trailing marks ends a run, so word and marks are looked up apart."""
        stems = [w.rstrip(_MARKS) for w in words]
        stems = [s if s != w and s and s.decode("utf-8", "surrogatepass")[-1].isalpha() else w for s, w in zip(stems, words, strict=True)]
        tails = [w[len(s) :] for s, w in zip(stems, words, strict=True)]
        parts = list({*stems, *tails} - {b""})
        ids = dict(zip(parts, self.runs.of(parts), strict=True)) | {b"": b""}
        return [ids[s] + ids[t] for s, t in zip(stems, tails, strict=True)]

    def ids(self, texts: pa.Array) -> Iterator[memoryview | bytes]:
        """Lower case changes nothing but the strings of special tokens; texts that may hold one go whole."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        for c in chunks(pc.if_else(special, "", texts)):
            whole = special.slice(c.first, len(c.bounds) - 1).to_pylist()
            for i, ids in enumerate(gathered(c, self.known.of(c.words.cast(pa.binary()).to_pylist()))):
                yield self.encode([texts[c.first + i].as_py()])[0] if whole[i] else ids


@cache
def words_of(path: str) -> Words:
    """One for each Python worker, which Spark uses again for later tasks; what it remembers of words goes with each task."""
    return Words(path)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's token ids and the id `end`, cut at every `capacity`.

    A null text counts as empty and gives the one id `end`."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        try:
            for batch in batches:
                out = []
                for i, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1)), strict=True):
                    size = len(ids) + 4
                    for n, a in enumerate(range(0, size, step)):
                        z = min(a + step, size)
                        crc = zlib.crc32(ids[a:z])  # the last id isn't in ids
                        out.append((i, n, a // 4, (z - a) // 4, zlib.crc32(last, crc) if z == size else crc))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        finally:
            words.runs.forget()
            words.known.forget()

    return lean(docs.select(F.col(doc_id).cast("long"), F.col(text))).mapInArrow(tidy(run), PIECES)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Lengths in a sequence, and how many sequences take them, until each length's count is used up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths, out = np.arange(capacity + 1), []

    def up_to(free: np.ndarray) -> np.ndarray:
        """At each length, the longest one with free pieces that isn't longer; 0 if none."""
        return np.maximum.accumulate(np.where(free > 0, lengths, 0))

    while (longest := int(up_to(left)[capacity])) > 0:
        own, gap, free = [longest], capacity - longest, left.copy()
        free[longest] -= 1
        below = up_to(free)
        while gap and (fit := int(below[gap])):
            take = min(int(free[fit]), gap // fit)
            own += [fit] * take
            gap -= fit * take
            free[fit] -= take
            below = up_to(free) if not free[fit] else below
        while gap:
            small = own[-1]
            room = gap + small
            a = lengths[1 : room + 1][free[1 : room + 1] > 0]
            b = below[np.minimum(a, room - a)]
            same = (b == a) & (free[a] < 2)
            b[same] = below[a[same] - 1]
            total = np.where(b > 0, a + b, 0)
            if not len(a) or total.max() <= small:
                break
            best = len(total) - 1 - int(total[::-1].argmax())
            own[-1:] = [int(a[best]), int(b[best])]
            free[small] += 1
            free[a[best]] -= 1
            free[b[best]] -= 1
            gap, below = room - int(total[best]), up_to(free)
            own.sort(reverse=True)
        used = Counter(own)
        copies = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * copies
        out.append((own, copies))
    return out


def places(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, low, high, first sequence, uses, offsets): where the pieces numbered low to high - 1 of a length go."""
    out, given, sequence = [], Counter(), 0
    for own, copies in plan:
        at, offset = {}, 0
        for x in own:
            at.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in at.items():
            out.append((x, given[x], given[x] + copies * len(offsets), sequence, len(offsets), offsets))
            given[x] += copies * len(offsets)
        sequence += copies
    return out


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1, lots: int = 256) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A document's ids are those of the tokenizer file without special tokens, then `end`; only longer ones than
    capacity are cut. Null texts count as empty, repeated rows are packed each, other columns are dropped, an empty
    table gives no rows. The numbering deals the pieces of a length into `lots` lots, so that a length that very many
    pieces share isn't one task."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, doc_id, text, capacity, end))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(places(patterns(counts, capacity)), "length long, low long, high long, first long, uses long, offsets array<long>")
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lots)))
    before = rows.groupBy("length", "lot").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("lot")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("length", "lot").orderBy("doc_id", "piece")) - 1
    numbered = rows.withColumn("own", own).join(before.drop("count"), ["length", "lot"]).withColumn("number", F.col("own") + F.col("before"))
    # The plan has at most `capacity` patterns, so its size is bounded whatever the input's.
    placed = numbered.join(F.broadcast(plan), (numbered["length"] == plan["length"]) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).drop(plan["length"])
    turn = F.col("number") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(turn / F.col("uses"))).cast("long").alias("sequence_id"), F.element_at("offsets", (turn % F.col("uses") + 1).cast("int")).alias("offset"))
