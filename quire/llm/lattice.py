"""Language-model scores of texts: the likelihood of a subword lattice, summed over all segmentations.

The pieces come from an existing vocabulary file. Its scores rank the pieces and give their first probabilities; some
rounds of expectation-maximisation over the distinct words of the training documents set them to the corpus. A text's
probability is that of all ways to write its words as pieces, then an end. A word of the training documents can also
be written whole: the lattice has an arc across it, with the word's share of the training tokens. Pieces in place of
the arc weigh what Good and Turing give to unseen words, the share of words that occur once. No arc reaches across two
words, so the forward recursion over a text falls apart into one for each word, made once for each distinct word.

Texts are counted where they are read: a block of documents sends each of its distinct words once, with how often its
training documents have it, and gets back the corpus count and the log probability of the word.
"""

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored, tidy

#: What a block of documents holds at most: text bytes and distinct words.
BLOCK_BYTES, BLOCK_WORDS = 48_000_000, 1_000_000
#: Words that the recursion works on at once.
AT_ONCE = 400_000
SPACE, STEP = "▁", np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """The vocabulary's pieces that a lower-cased word can hold, by hash, with natural log probabilities.

    Piece number -1 - b stands for byte b, which spells characters that aren't pieces themselves."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [(p, model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for p in [model.id_to_piece(i)] if SPACE not in p[1:] and not any("A" <= c <= "Z" for c in p)]
        keys = np.array([self.hash(p) for p, _ in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.longest = keys[order], max(len(p) for p, _ in usable)
        self.initial = np.array([p[0] == SPACE for p, _ in usable])[order]
        rank = np.argsort(np.argsort([-s for _, s in usable], kind="stable"))[order]
        self.start = np.append(1 / (rank + 2.7), np.full(257, 1 / (len(usable) + 2.7)))  # then 256 bytes and the end
        self.start /= self.start.sum()

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(STEP) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, chars: np.ndarray) -> list[np.ndarray]:
        """For words of one length, by piece length from 1: the piece's number at each start, or len(keys) if none."""
        words, size = chars.shape
        prefix, none = np.zeros((words, size + 1), np.uint64), len(self.keys)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * STEP + chars[:, j]
        out, power = [], np.uint64(1)
        for length in range(1, min(self.longest, size) + 1):
            power = np.uint64(int(power) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
            h = prefix[:, length:] - prefix[:, : size + 1 - length] * power
            at = np.minimum(np.searchsorted(self.keys, h.ravel()), none - 1).reshape(h.shape)
            out.append(np.where(self.keys[at] == h, at, none).astype(np.int32))
        return out


@cache
def pieces_of(path: str) -> Pieces:
    """One for each Python worker, which Spark uses again for later tasks."""
    return Pieces(path)


def spelled(c: int) -> bytes:
    return chr(c).encode("utf-8", "surrogatepass")


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words, and their characters after the mark of a word's start, for words of one length at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for part in np.array_split(own, -(-len(own) * (size + 1) // AT_ONCE)):
            text = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
            chars = np.frombuffer(text, np.uint32).reshape(len(part), size)
            # The mark itself in a text is spelled by bytes: no piece has it, nor the private character put for it.
            chars = np.where(chars == ord(SPACE), 0xF8FF, chars)
            yield part, np.concatenate([np.full((len(part), 1), ord(SPACE), np.uint32), chars], axis=1)


def forward(vocabulary: Pieces, chars: np.ndarray, log_p: np.ndarray, counts: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """The log probability of each word; with counts, the expected uses of pieces are added to total."""
    none, size = len(vocabulary.keys), chars.shape[1]
    numbers = vocabulary.lattice(chars)
    value = np.append(log_p[:none], -np.inf)
    scores = [value[x] for x in numbers]
    missing = numbers[0] == none
    odd = np.unique(chars[missing])
    for c in odd:  # characters that aren't pieces are spelled by bytes
        scores[0][missing & (chars == c)] = sum(log_p[none + b] for b in spelled(int(c)))
    alpha = np.full((size + 1, len(chars)), -np.inf)
    alpha[0] = 0
    for j in range(1, size + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - n] + scores[n - 1][:, j - n] for n in range(1, min(j, len(scores)) + 1)], axis=0)
    if counts is None:
        return alpha[size]
    beta = np.full((size + 1, len(chars)), -np.inf)
    beta[size] = 0
    for i in range(size - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + n] + scores[n - 1][:, i] for n in range(1, min(size - i, len(scores)) + 1)], axis=0)
    for n, (x, s) in enumerate(zip(numbers, scores, strict=True), 1):
        starts = s.shape[1]
        use = np.exp(alpha[:starts].T + s + beta[n : n + starts].T - alpha[size][:, None]) * counts[:, None]
        total += np.bincount(x.ravel(), weights=use.ravel(), minlength=len(total) + 1)[: len(total)] if n > 1 else np.bincount(np.where(missing, len(total), x).ravel(), weights=use.ravel(), minlength=len(total) + 1)[: len(total)]
        if n == 1:
            for c in odd:
                spent = use[missing & (chars == c)].sum()
                for b in spelled(int(c)):
                    total[none + b] += spent
    return alpha[size]


def counted(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """Rows of documents (block, doc_id, train, tokens, ids, times) and rows of words (block, local, word, c), one
    table: a block's documents name their words by numbers of its own."""
    types = [("block", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("tokens", pa.int64()), ("ids", pa.binary()), ("times", pa.binary()), ("local", pa.int32()), ("word", pa.string()), ("c", pa.int64())]
    schema = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local: dict[bytes, int] = {}
        block, size, seen = uuid.uuid4().int >> 65, 0, np.zeros(1024, np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            listed = list(local)
            for at in range(0, len(listed), 50_000):
                own = listed[at : at + 50_000]
                columns = [[block] * len(own), *[None] * 5, range(at, at + len(own)), [w.decode("utf-8", "surrogatepass") for w in own], seen[at : at + len(own)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if c is not None else pa.nulls(len(own), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for i, t, learn in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass").lower()
                    own = [local.setdefault(w, len(local)) for w in raw.split()]
                    ids, times = np.unique(np.array(own, np.uint32), return_counts=True)
                    if len(local) > len(seen):
                        seen = np.concatenate([seen, np.zeros(max(len(local), len(seen)), np.int64)])
                    if learn:
                        seen[ids] += times
                    planes = lambda x: x.view(np.uint8).reshape(-1, 4).T.tobytes()  # noqa: E731  like bytes together, which compresses
                    out.append((block, i, bool(learn), len(own), planes(np.diff(ids, prepend=np.uint32(0)).astype(np.uint32)), planes(times.astype(np.uint32))))
                    size += len(raw)
                columns = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types[:6], strict=True)] + [pa.nulls(len(out), t) for t in schema.types[6:]], schema=schema)
                if size > BLOCK_BYTES or len(local) > BLOCK_WORDS:
                    yield from words()
                    local, size, seen, block = {}, 0, np.zeros(1024, np.int64), uuid.uuid4().int >> 65
        yield from words()

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text), F.coalesce(train, F.lit(False)))
    return rows.mapInArrow(tidy(run), "block long, doc_id long, train boolean, tokens long, ids binary, times binary, local int, word string, c long")


def fitted(words: DataFrame, documents: int, path: str, rounds: int, smooth: float = 0.1) -> np.ndarray:
    """Natural log probabilities of the pieces, 256 bytes and the end, from training words (word, c), each once."""
    vocabulary = pieces_of(path)
    p = vocabulary.start
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(np.log(p))  # as large as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, log_p = pieces_of(path), sent.value
            total = np.zeros(len(log_p))
            for batch in batches:
                listed, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for own, chars in by_length(listed):
                    forward(vocabulary, chars, log_p, np.minimum(c[own], 1).astype(float), total)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "uses"])

        got = words.where("c > 0").select("word", "c").mapInArrow(tidy(run), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(len(p))
        uses[got["piece"].to_numpy()] = got["uses"].to_numpy()
        uses[-1] = documents
        p = (uses + smooth) / (uses + smooth).sum()
    return np.log(p)


def score(docs: DataFrame, vocabulary: str, train: Column, doc_id: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    train: a condition on docs' columns that selects the rows to learn from. Words, parted by ASCII white space, with
    A-Z as a-z, then one end, are a text's tokens. base_score: the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) with the
    tokens' training counts. score: the log10 probability of the text under the lattice. vocabulary: a sentencepiece
    file; rounds of fitting its pieces' probabilities to the training words. Null and empty texts are an end alone;
    repeated rows each get a row and count as often; other columns are dropped; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = stored(counted(docs, doc_id, text, train))
    asked = rows.where(F.col("word").isNotNull()).select("block", "local", "word", "c")
    words = stored(asked.groupBy("word").agg(F.sum("c").alias("c")))
    documents = rows.where("train").count()
    n, v, once = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    n, v = (n or 0) + documents, v + (documents > 0)
    fit = fitted(words, documents, vocabulary, rounds)
    sent = spark.sparkContext.broadcast(fit)
    unseen = (once + 1) / (n + 1)
    starts = pieces_of(vocabulary).initial
    end_p = fit[-1] - np.log(np.exp(fit[-1]) + np.exp(fit[:-257][starts]).sum())  # pieces then can't but begin a word or end

    def arcs(c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 of the probability of words or the end, by the arc across it and by its pieces."""
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log((1 - unseen) * c / max(n, 1)), np.log(unseen) + p) / np.log(10)

    def log_p(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.zeros(batch.num_rows)
            for own, chars in by_length(batch.column(0).to_pylist()):
                value[own] = forward(pieces_of(vocabulary), chars, sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=["word", "c", "p"])

    known = words.select("word", "c").mapInArrow(tidy(log_p), "word string, c long, p double")
    answers = asked.drop("c").join(known, "word").select(F.col("block").alias("of"), "local", "c", "p")
    blocks = rows.where(F.col("word").isNull()).select("block", "doc_id", "train", "tokens", "ids", "times")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def group(own: pa.Table, got: pa.Table) -> pa.Table:
        place = got["local"].to_numpy()
        c, p = np.zeros(len(place), np.int64), np.zeros(len(place))
        c[place], p[place] = got["c"].to_numpy(), got["p"].to_numpy()
        base, p = np.log10((c + 0.1) / (n + 0.1 * (v + 1))), arcs(c, p)
        end_base, end = np.log10((documents + 0.1) / (n + 0.1 * (v + 1))), arcs(np.array([documents]), np.array([end_p]))[0]
        whole = lambda x: np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
        out = []
        for i, learn, tokens, ids, times in zip(own["doc_id"].to_pylist(), own["train"].to_pylist(), own["tokens"].to_pylist(), own["ids"], own["times"], strict=True):
            ids, times = np.cumsum(whole(ids)), whole(times)
            out.append((i, not learn, tokens + 1, int(times[c[ids] > 0].sum()) + (documents > 0), n, float(times @ base[ids] + end_base), float(times @ p[ids] + end)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(group, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
