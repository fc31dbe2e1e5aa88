"""Words of many texts at once: Arrow's kernels cut the texts and number their distinct words, so that Python's own work
is one step for each distinct word of a chunk, not one for each word."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 2_000_000


@dataclass
class Chunk:
    """Texts [first, first + len(bounds) - 1) of a batch: text i has the words index[bounds[i]:bounds[i + 1]], numbers
    into `words`, the chunk's distinct words."""

    first: int
    bounds: np.ndarray
    index: np.ndarray
    words: pa.Array


def slices(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts that have `most` bytes together, or are one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def chunks(texts: pa.Array, lower: bool = True, most: int = CHUNK) -> Iterator[Chunk]:
    """The words of texts, cut at ASCII white space, with A-Z as a-z if `lower`. Null, empty and blank texts have none."""
    for at, end in slices(texts, most):
        own = pc.fill_null(texts.slice(at, end - at), "")
        own = pc.ascii_trim_whitespace(pc.ascii_lower(own) if lower else own)
        split = pc.ascii_split_whitespace(own)  # an empty text gives one empty word
        counts = np.where(pc.binary_length(own).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0)
        coded = split.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        empty = pc.index(words, "").as_py()
        yield Chunk(at, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), index[index != empty] if empty >= 0 else index, words)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits each of which depends on all bits of x (the finish of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(seed: int) -> np.ndarray:
    """A random number for each of 64 places and each byte there."""
    return mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins; the end of the last one comes last."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8, int(ends[-1]))[ends[0] :] if ends[-1] else np.zeros(0, np.uint8), ends - ends[0]


def hashes(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string: the sum of the numbers that `table` (drawn()) has for its bytes at their places.
    Beyond 64 bytes the table is used again, times a power of an odd number. Equal strings have equal hashes anywhere."""
    raw, ends = spelled(words)
    starts, sizes = ends[:-1], np.diff(ends)
    if not len(raw):
        return mixed(np.zeros(len(words), np.uint64))
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    value = table[(place & 63) << 8 | raw]
    if sizes.max() > 64:
        far = np.flatnonzero(place > 63)
        step, power = place[far] >> 6, np.full(int(sizes.max() >> 6) + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        value[far] *= np.cumprod(power)[step]
    out = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(sizes)
    out[full] = np.add.reduceat(value, starts[full])
    return mixed(out + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def gathered(c: Chunk, values: list[bytes]) -> Iterator[memoryview]:
    """For each text of a chunk, what `values` has for its words, one after another. values: bytes for each distinct word."""
    took = pa.array(values, pa.large_binary()).take(pa.array(c.index))
    _, offsets, data = took.buffers()
    ends = np.frombuffer(offsets, np.int64, len(took) + 1)[c.bounds].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(ends, ends[1:], strict=False):
        yield view[a:b]


class Known:
    """What was made of words, by word, of the last words met: two generations, of which the older one goes when the
    younger has reached `most` bytes; a word that is asked for again moves to the younger."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = 24_000_000):
        self.make, self.most, self.young, self.old, self.size = make, most, {}, {}, 0

    def forget(self) -> None:
        self.young, self.old, self.size = {}, {}, 0

    def of(self, words: list[bytes]) -> list[bytes]:
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        out = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            own = [words[i] for i in missing]
            got = list(map(self.old.get, own))
            new = [k for k, x in enumerate(got) if x is None]
            for k, x in zip(new, self.make([own[k] for k in new]), strict=True):
                got[k] = x
            for i, x in zip(missing, got, strict=True):
                out[i] = x
            self.young.update(zip(own, got, strict=True))
            self.size += 130 * len(own) + sum(map(len, own)) + sum(map(len, got))
        return out
