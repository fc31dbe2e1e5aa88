"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

Each word has a sparse index vector of +1 and -1, drawn from its hash. Its word vector adds up the index vectors of
the words beside it wherever it occurs in the corpus, and its own. A document is the mean of its words' vectors. A
network of two layers, fitted with numpy on labelled documents, gives a logit, and a temperature fitted on documents
that the network didn't see turns it into a probability.

Words fall into a fixed number of rows by hash, so the table of word vectors has a fixed size at any input. Each word
gives two tokens: its letters and its form (case, marks around it, whether it repeats the word before).
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, lean, tidy
from quire.llm.words import chunks, drawn, hashes, mixed, spelled

#: Components of a vector, and how many of an index vector aren't 0.
DIM, ONES = 64, 4
#: Bytes of text whose words are looked up at once.
AT_ONCE = 1_000_000


@dataclass(frozen=True)
class Shape:
    """How many rows the table of word vectors has: letters first, then forms."""

    letters: int = 14336
    forms: int = 2048

    @property
    def rows(self) -> int:
        return self.letters + self.forms


def index_vectors(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    draw = np.random.default_rng(20)
    places = np.argsort(draw.random((shape.rows, DIM)), axis=1)[:, :ONES]
    return places, np.tile([1, -1], ONES // 2)[None, :].repeat(shape.rows, axis=0)


#: ASCII marks around a word's core.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: The kinds of cores: the first that holds counts.
_KINDS = (lambda x: pc.match_substring_regex(x, r"\pN"), pc.utf8_is_upper, pc.utf8_is_title, pc.utf8_is_lower)


@cache
def draws() -> np.ndarray:
    return drawn(9)


def letters_and_forms(words: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The table's rows of the letters of words, in lower case, and of their forms: the kind of the core, whether it is
    one character, and up to three marks before and after it."""
    raw, ends = spelled(words)
    left = pc.ascii_ltrim(words, _MARKS)
    core = pc.ascii_rtrim(left, _MARKS)
    head = np.diff(ends) - pc.binary_length(left).to_numpy()
    tail = pc.binary_length(left).to_numpy() - pc.binary_length(core).to_numpy()
    kind = np.full(len(words), len(_KINDS), np.uint64)
    for k in reversed(range(len(_KINDS))):
        kind[_KINDS[k](core).to_numpy(zero_copy_only=False)] = k
    form = kind * np.uint64(2) + (pc.utf8_length(core).to_numpy() == 1)
    for first, n in ((ends[:-1], head), (ends[1:] - tail, tail)):
        for k in range(3):
            own = np.where(n > k, raw[np.minimum(first + k, len(raw) - 1)] if len(raw) else 0, 0)
            form = form << np.uint64(8) | own.astype(np.uint64)
    letters = hashes(pc.utf8_lower(core), draws()) % np.uint64(shape.letters)
    return letters.astype(np.int32), (mixed(form) % np.uint64(shape.forms - 1)).astype(np.int32) + np.int32(shape.letters)


def tokens(texts: pa.Array, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: where each text's words begin and end, and the words' rows of letters and of forms; the last
    row is the form of a word that repeats the one before."""
    for c in chunks(texts, lower=False, most=AT_ONCE):
        letters, forms = (x[c.index] for x in letters_and_forms(c.words, shape))
        forms[1:][(letters[1:] == letters[:-1]) & ~first_words(c.bounds)] = shape.rows - 1
        yield c.bounds, letters, forms


def first_words(bounds: np.ndarray) -> np.ndarray:
    """Which words but the first of all are the first of their text."""
    out = np.zeros(max(int(bounds[-1]), 1), bool)
    out[bounds[:-1][bounds[:-1] < bounds[-1]]] = True
    return out[1:]


def context_sums(docs: DataFrame, text: str, shape: Shape) -> DataFrame:
    """(row, c0, ...): for each row of the table, the sum over the corpus of the index vectors beside it."""
    schema = pa.schema([("row", pa.int32())] + [(f"c{k}", pa.int64()) for k in range(DIM)])
    rows = shape.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(shape)
        total = np.zeros(rows * DIM)
        for batch in batches:
            for bounds, letters, forms in tokens(batch.column(0), shape):
                inner = np.flatnonzero(~first_words(bounds))
                for x in (letters, forms):
                    left, right = x[inner], x[inner + 1]
                    for own, beside in ((left, right), (right, left)):
                        for k in range(ONES):
                            total += signs[0, k] * np.bincount(own * DIM + places[beside, k], minlength=rows * DIM)
        table = total.reshape(rows, DIM).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [pa.array(table[used, k]) for k in range(DIM)], schema=schema)

    parts = lean(docs.select(F.col(text))).mapInArrow(tidy(run), "row int, " + ", ".join(f"c{k} long" for k in range(DIM)))
    return parts.groupBy("row").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(DIM)))


def word_vectors(docs: DataFrame, text: str, shape: Shape) -> np.ndarray:
    """The table, float32, a row for each of shape.rows; of fixed size, so the driver can hold it."""
    sums = np.zeros((shape.rows, DIM))
    got = context_sums(docs, text, shape).toArrow()
    sums[got["row"].to_numpy()] = np.stack([got[f"c{k}"].to_numpy() for k in range(DIM)], axis=1).reshape(-1, DIM)
    places, signs = index_vectors(shape)
    own = np.zeros((shape.rows, DIM))
    np.put_along_axis(own, places, signs / np.sqrt(ONES), axis=1)
    return (own + sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)).astype(np.float32)


def means(bounds: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each text's mean of the table's rows of its words; zeros for a text without words."""
    counts = np.diff(bounds)
    out = np.zeros((len(counts), table.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(table[rows], bounds[full], axis=0) / counts[full, None]
    return out


def pooled(texts: pa.Array, shape: Shape, table: np.ndarray) -> Iterator[np.ndarray]:
    """For runs of texts, the means of their words' vectors: first of letters, then of forms."""
    for bounds, letters, forms in tokens(texts, shape):
        yield np.concatenate([means(bounds, letters, table), means(bounds, forms, table)], axis=1)


@dataclass
class Model:
    shape: Shape
    table: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    mean: np.ndarray
    spread: np.ndarray

    def first_layer(self) -> tuple[np.ndarray, np.ndarray]:
        """The network's first layer of each row of the table, as a row of letters or of forms, and what it adds to all."""
        w = self.w1 / self.spread[:, None]
        rows = np.concatenate([self.table[: self.shape.letters] @ w[:DIM], self.table[self.shape.letters :] @ w[DIM:]])
        return rows.astype(np.float32), self.b1 - self.mean @ w

    def probability(self, first: np.ndarray) -> np.ndarray:
        """Of label 1, from the sums that come into the hidden units."""
        return 1 / (1 + np.exp(-np.clip((np.tanh(first) @ self.w2 + self.b2) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, shape: Shape, table: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Full-batch Adam on the rows that aren't held, then the temperature with the least loss on those that are."""
    draw = np.random.default_rng(9)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(2 * DIM), np.ones(2 * DIM))
    a, t = (x[~held] - mean) / spread, y[~held].astype(float)
    params = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    if not len(t):  # nothing to learn from: probability 1/2 for every text
        return Model(shape, table, params[0], params[1], np.zeros(hidden), 0.0, 1.0, mean, spread)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        h = np.tanh(a @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -50, 50)))
        e = (p - t) / len(t)
        back = e[:, None] * params[2] * (1 - h**2)
        grads = [a.T @ back + decay * params[0] / 10, back.sum(axis=0), h.T @ e + decay * params[2] / 10, np.array([e.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(shape, table, params[0], params[1], params[2], float(params[3][0]), 1.0, mean, spread)
    if held.any():
        z = np.tanh((x[held] - mean) / spread @ model.w1 + model.b1) @ model.w2 + model.b2
        losses = {k: np.logaddexp(0, np.where(y[held] == 1, -z, z) / k).mean() for k in np.geomspace(0.5, 20, 60)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000, shape: Shape = Shape()) -> Model:
    """The model, from word vectors of all documents and at most `most` labelled ones that `learn` selects, a condition
    on the labels' columns; those whose ids have the least hashes, so reruns agree. Labels other than 0 and 1 are
    left out; of labels that repeat an id the least counts. Null, empty and long texts count like others, whole; without
    documents or labels every text gets 1/2. shape: rows of the table of word vectors, which words share by hash."""
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("learn_id")).agg(F.min(label).cast("int").alias("learn_y"))
    chosen = known.orderBy(F.xxhash64("learn_id"), "learn_id").limit(most)
    table = word_vectors(docs, text, shape)
    sent = docs.sparkSession.sparkContext.broadcast(table)  # shape.rows x DIM floats
    schema = pa.schema([("i", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in pooled(batch.column(2), shape, sent.value):
                vectors = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 2 * DIM, pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(1).slice(at, len(x)), vectors], schema=schema)
                at += len(x)

    # At most `most` rows of two numbers, so their size is bounded.
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("i") == F.col("learn_id"))
    got = lean(rows.select(F.col("i").cast("long"), "learn_y", "t")).mapInArrow(tidy(run), "i long, y int, x array<float>").toArrow().sort_by("i")
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM).astype(float)
    held = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % 5 == 0 for i in got["i"].to_pylist()], bool)
    return train(x, got["y"].to_numpy(), held, shape, table)


def score(docs: DataFrame, model: Model, text: str = "text", score_column: str = "score") -> DataFrame:
    """docs with score_column, the probability that the text has label 1; a column of that name is replaced. Null and
    empty texts, which have no words, get the network's value for an empty pool; long texts are read whole."""
    sent = docs.sparkSession.sparkContext.broadcast((replace(model, table=np.zeros((0, DIM))), *model.first_layer()))
    kept = [c for c in docs.columns if c != score_column]
    docs = docs.select(*kept, F.col(text).alias(fresh("text of " + score_column, kept)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]) + f", `{score_column}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rows, added = sent.value
        for batch in batches:
            out = [np.zeros(0)]
            for bounds, letters, forms in tokens(batch.column(batch.num_columns - 1), m.shape):
                out.append(m.probability(means(bounds, letters, rows) + means(bounds, forms, rows) + added))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=[*kept, score_column])

    return lean(docs).mapInArrow(tidy(run), schema)


def learned(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The rows that a fit may use: all but those whose crc32 of the id as text is 0 modulo folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds != 0
