"""The n-gram join against a brute-force version."""

import random
import re

from quire.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def found(spark, rows, schema=SCHEMA, **options):
    return sorted(tuple(r) for r in jaccard.link(spark.createDataFrame(rows, schema), **options).collect())


def test_as_brute_force_with_chains_copies_and_common_passages(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    passage = [draw.choice(words) for _ in range(40)]
    rows = []
    for family in range(12):
        text = [draw.choice(words) for _ in range(draw.choice([6, 60, 200]))] + passage * (family % 2)
        for _ in range(draw.choice([1, 5, 40])):  # each is a copy of the one before with one word changed: chains of links
            text = list(text)
            if draw.random() < 0.7:
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_null_empty_short_and_upper_case_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"), (8, "A b c d e"), (9, "a  b c d\te")]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    rows = [(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2)]
    assert found(spark, rows, SCHEMA + ", component_id string, g int") == [(1, 2, 1), (2, 2, 1)]


def test_repeated_rows_and_rows_without_id(spark):
    got = sorted(jaccard.link(spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], SCHEMA)).collect(), key=lambda r: r[0] or 0)
    assert [(r.doc_id, r.component_id) for r in got] == [(None, 2), (2, 2), (3, 2), (3, 2)]
