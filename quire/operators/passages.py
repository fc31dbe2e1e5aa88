"""The passages that a section's texts are written from."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The most of a section's own text in one passage, in estimated tokens.
PASSAGE_TOKENS = 2_500
FIGURE_NOTE = " — description (model-written): "
NOTES = "\n\nNotes:\n"


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def paragraphs_of(text: str) -> list[str]:
    """Parted at empty lines, except inside a listing, a display formula or the note of a figure."""
    out, lines, open_ = [], [], None
    for line in text.split("\n"):
        own = line.strip()
        if open_ is None and not own:
            if lines:
                out.append("\n".join(lines))
                lines = []
            continue
        if open_ is None:
            start = line.lstrip()
            ticks = len(start) - len(start.lstrip("`"))
            if ticks >= 3:
                open_ = ticks
            elif own == "$$":
                open_ = "formula"
            elif line.startswith("[") and FIGURE_NOTE in line and not own.endswith("]"):
                open_ = "figure"
        elif (open_ == "formula" and own == "$$") or (open_ == "figure" and own.endswith("]")) or (isinstance(open_, int) and len(own) >= open_ and not own.strip("`")):
            open_ = None
        lines.append(line)
    return [*out, "\n".join(lines)] if lines else out


def bodies_of(text: str) -> list[str]:
    """The text in one body, or in several of about the same size, each under the first paragraph."""
    if tokens(text) <= PASSAGE_TOKENS:
        return [text]
    first, *rest = paragraphs_of(text) or [text]
    if not rest:
        return [text]
    heading = first + "\n\n"
    budget = max(PASSAGE_TOKENS - tokens(heading), 1)
    whole = tokens("\n\n".join(rest))
    target = -(-whole // -(-whole // budget))
    bodies: list[list[str]] = []
    size = 0
    for p in rest:
        if bodies and -(-size // 4) < target and -(-(size + 2 + len(p)) // 4) <= budget:
            bodies[-1].append(p)
            size += 2 + len(p)
        else:
            bodies.append([p])
            size = len(p)
    return [heading + "\n\n".join(b) for b in bodies]


def passages(texts: DataFrame) -> DataFrame:
    """(section, passages, formula, bodies): how many passages a section is read in, at least one; whether a line is
    '$$'; and, where there are several, their own texts without notes. texts: (section, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t.as_py() or "" for t in batch.column(1)]
            cut = [bodies_of(t) for t in own]
            formula = [any(line.removesuffix("\r") == "$$" for line in t.split("\n")) for t in own]
            bodies = [[b.split(NOTES, 1)[0] for b in c] if len(c) > 1 else [] for c in cut]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in cut], pa.int64()), pa.array(formula, pa.bool_()), pa.array(bodies, pa.list_(pa.string()))], names=["section", "passages", "formula", "bodies"])

    rows = texts.selectExpr("CAST(section AS BIGINT) AS section", "text")
    return rows.mapInArrow(run, "section long, passages long, formula boolean, bodies array<string>")
