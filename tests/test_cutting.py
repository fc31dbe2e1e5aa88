"""Cutting at headings against a recursive version, joining and splitting on planted runs."""

import random

from quire.operators import cutting


def recursive(paths, tokens, most):
    """A tree of headings, cut from the top down."""
    out = []

    def cut(path):
        inside = [i for i, p in enumerate(paths) if p[: len(path)] == path]
        if sum(tokens[i] for i in inside) <= most:
            out.append((path, inside))
            return
        own = [i for i in inside if paths[i] == path]
        if own:
            out.append((path, own))
        below = []
        for i in inside:
            if len(paths[i]) > len(path) and paths[i][: len(path) + 1] not in below:
                below.append(paths[i][: len(path) + 1])
        for p in below:
            cut(p)

    cut(())
    return out


def test_cuts_as_the_tree():
    draw = random.Random(2)
    for _ in range(200):
        paths, path, number = [], (), 0
        for _ in range(draw.randrange(1, 14)):
            if draw.random() < 0.6:
                number += 1
                path = (*path[: draw.randrange(0, len(path) + 1)], number)
            paths.append(path)
        tokens = [draw.randrange(1, 9) for _ in paths]
        assert cutting.runs_of(paths, tokens, 12) == [r for r in recursive(paths, tokens, 12) if r[1]]


def test_short_runs_join():
    tokens = [10, 1, 10, 1, 1]
    runs = [((1,), [0]), ((1, 2), [1]), ((1, 3), [2]), ((4,), [3]), ((5, 6), [4])]
    # The last two stay short together, lie under no heading, and so go to the run before.
    assert cutting.joined(runs, tokens, 5) == [((1,), [0]), ((), [1, 2, 3, 4])]
    assert cutting.joined([((1,), [0]), ((1, 2), [1])], [10, 1], 5) == [((1,), [0, 1])]


def test_parts_keep_lead_ins_and_put_notes_last(spark):
    assert cutting.parts_of([0, 1, 2, 3], [6, 3, 4, 20], [False, True, False, False], 10) == [[0], [1, 2], [3]]
    rows = [(7, k, [1], 3, False, k == 1) for k in range(4)] + [(8, 0, [], 1, False, False)]
    blocks = spark.createDataFrame(rows, "doc_id long, position int, path array<int>, tokens long, with_next boolean, lone_note boolean")
    got = sorted(tuple(r) for r in cutting.sections(blocks, 9, 2).collect())
    assert got == [(7, 0, 0, 0, 0), (7, 0, 0, 1, 2), (7, 0, 0, 2, 1), (7, 0, 1, 0, 3), (8, 0, 0, 0, 0)]
