"""Sections of a document: cut at headings where a part is too long, short ones joined, long ones split between blocks.

A document's blocks (a chapter's, so not many) are one row; each step is a fold over them in reading order."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most and the least estimated tokens of a section.
MOST, LEAST = 8_000, 500


def runs_of(paths: list[tuple[int, ...]], tokens: list[int], most: int) -> list[tuple[tuple[int, ...], list[int]]]:
    """(path, blocks): a heading's whole part if it fits, else what is directly under it and then each heading below,
    in reading order. A part that fits isn't cut further."""
    sums: dict[tuple[int, ...], int] = {}
    for p, n in zip(paths, tokens, strict=True):
        for depth in range(len(p) + 1):
            sums[p[:depth]] = sums.get(p[:depth], 0) + n
    runs: dict[tuple[tuple[int, ...], bool], list[int]] = {}
    for at, p in enumerate(paths):
        fits = next((d for d in range(len(p) + 1) if sums[p[:d]] <= most), None)
        runs.setdefault((p, False) if fits is None else (p[:fits], True), []).append(at)
    return [(p, own) for (p, _), own in sorted(runs.items(), key=lambda r: r[1][0])]


def joined(runs: list[tuple[tuple[int, ...], list[int]]], tokens: list[int], least: int) -> list[tuple[tuple[int, ...], list[int]]]:
    """Runs with fewer than `least` tokens go to the next one under the same heading, else to the one before; they then
    lie under the headings that both share, and go on if they still are short."""
    out = list(runs)
    at = 0
    size = lambda run: sum(tokens[b] for b in run[1])

    def both(first, second):
        shared = 0
        while shared < min(len(first[0]), len(second[0])) and first[0][shared] == second[0][shared]:
            shared += 1
        return first[0][:shared], first[1] + second[1]

    while at < len(out):
        above = out[at][0][:-1]
        under = lambda run, above=above: run[0][: len(above)] == above
        if size(out[at]) >= least:
            at += 1
        elif at + 1 < len(out) and under(out[at + 1]):
            out[at : at + 2] = [both(out[at], out[at + 1])]
        elif at and under(out[at - 1]):
            out[at - 1 : at + 1] = [both(out[at - 1], out[at])]
        else:
            at += 1
    return out


def parts_of(blocks: list[int], tokens: list[int], with_next: list[bool], most: int) -> list[list[int]]:
    """A run in parts of at most `most` tokens; a block that belongs with the next stays with it, one that is too long
    is a part alone."""
    groups: list[list[int]] = []
    for k, b in enumerate(blocks):
        if k and with_next[blocks[k - 1]]:
            groups[-1].append(b)
        else:
            groups.append([b])
    parts: list[list[int]] = []
    size = 0
    for g in groups:
        own = sum(tokens[b] for b in g)
        if parts and size + own <= most:
            parts[-1] += g
            size += own
        else:
            parts.append(list(g))
            size = own
    return parts


def cut(blocks: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(doc_id, section, part, place, position, parts, path): which part of which section each block belongs to, in which
    place; a footnote that stands alone comes last in its part. path: the headings that the section lies under.

    blocks: (doc_id, position, path array<int>, tokens, with_next, lone_note), the path naming the open headings."""
    kinds = [("doc_id", pa.int64()), ("section", pa.int32()), ("part", pa.int32()), ("place", pa.int32()), ("position", pa.int32()), ("parts", pa.int32()), ("path", pa.list_(pa.int32()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, position, path, tokens, with_next, lone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths = [tuple(p or ()) for p in path]
                for s, (name, blocks) in enumerate(joined(runs_of(paths, tokens, most), tokens, least)):
                    parts = parts_of(blocks, tokens, with_next, most)
                    for p, part in enumerate(parts):
                        part = sorted(part, key=lambda b: lone[b])
                        out += [(doc, s, p, k, position[b], len(parts), list(name)) for k, b in enumerate(part)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    # A row for each document, as a call of Python for each would take longer than the fold.
    fields = ["CAST(position AS INT) AS position", "path", "CAST(tokens AS BIGINT) AS tokens", "with_next", "lone_note"]
    rows = blocks.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"struct({', '.join(fields)}) AS b").groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return rows.select("doc_id", "b.position", "b.path", "b.tokens", "b.with_next", "b.lone_note").mapInArrow(run, "doc_id long, section int, part int, place int, position int, parts int, path array<int>")


def sections(blocks: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(doc_id, section, part, place, position) of cut()."""
    return cut(blocks, most, least).select("doc_id", "section", "part", "place", "position")
