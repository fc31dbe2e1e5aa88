"""Budgets with heads, cursors, shared budgets and paged lists against loops."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import reading


def take(texts, heads, chars, unit, offset):
    if unit > len(texts) or (unit < len(texts) and offset > len(texts[unit])):
        return "foreign", [], None, 0
    left, out = chars, []
    while unit < len(texts):
        rest = texts[unit][offset:]
        if len(rest) <= left:
            out.append((unit, offset, rest))
            left, unit, offset = left - len(rest), unit + 1, 0
            continue
        if left > 0 and (left == chars or offset + left >= heads[unit]):
            out.append((unit, offset, rest[:left]))
            offset, left = offset + left, 0
        return None, out, (unit, offset), chars - left
    return None, out, None, chars - left


def token(unit, offset, scope):
    return base64.urlsafe_b64encode(f"v1.{unit}.{offset}.{scope}".encode()).decode().rstrip("=")


@pytest.fixture(scope="module")
def drawn(spark):
    draw = random.Random(6)
    units, requests = {}, []
    for call in range(40):
        for number in range(draw.choice([1, 3, 6]) if call else 21):
            read = call * 100 + number
            own = [("é" * draw.randrange(0, 12), draw.randrange(0, 6)) for _ in range(draw.randrange(0, 6))]
            units[read] = own
            scope = f"read:{read % 7}"
            place = draw.choice([None, None, "", token(1, 2, scope), token(0, 1, scope), token(0, 0, "read:x"), "!!", token(9, 0, scope)])
            requests.append((call, number, read, scope, draw.choice([None, 5, 17]), place))
    rows = [(r, k, t, h) for r, own in units.items() for k, (t, h) in enumerate(own)]
    return units, requests, spark.createDataFrame(rows, "read int, unit int, text string, head int"), spark.createDataFrame(requests, "call int, number int, read int, scope string, chars int, cursor string")


def begun(place, scope):
    if not place:
        return 0, 0
    for unit, offset in ((1, 2), (0, 1), (9, 0)):
        if place == token(unit, offset, scope):
            return unit, offset
    return None


def expected(own, scope, chars, place):
    at = begun(place, scope)
    fault, out, rest, used = take([t for t, _ in own], [h for _, h in own], chars, *at) if at else ("foreign", [], None, 0)
    return "foreign cursor" if fault else None, rest is not None, token(*rest, scope) if rest else None, used, out


def told(r):
    return r.fault, r.truncated, r.cursor, r.used, [tuple(s) for s in r.slices] if r.slices is not None else None


def test_reads(drawn):
    units, requests, rows, asked = drawn
    got = {r.read: told(r) for r in reading.read(rows, asked.select("read", "scope", F.coalesce("chars", F.lit(9)).alias("chars"), "cursor")).collect()}
    assert got == {read: expected(units[read], scope, chars or 9, place) for _, _, read, scope, chars, place in requests}


def test_shared_budgets(drawn):
    units, requests, rows, asked = drawn
    got = {(r.call, r.number): told(r) for r in reading.read_many(rows, asked, 40).collect()}
    want = {}
    left = {}
    for call, number, read, scope, chars, place in requests:
        if call == 0:
            want[call, number] = ("too many reads", False, None, 0, None)
            continue
        budget = min(left.setdefault(call, 40), 40 if chars is None else chars)
        one = expected(units[read], scope, budget, place)
        if budget == 0 and one[0] is None:
            one = (None, True, None, 0, None)
        want[call, number] = one
        left[call] -= one[3]
    assert got == want


def test_reads_put_together_are_the_text(spark):
    text = [("Title one\nbody", 9), ("x" * 25, 4), ("", 0), ("Last\nwords é", 4)]
    units = spark.createDataFrame([(1, k, t, h) for k, (t, h) in enumerate(text)], "read int, unit int, text string, head int")
    whole, place, n = "", None, 0
    while True:
        (r,) = reading.read(units, spark.createDataFrame([(1, "s", 7, place)], "read int, scope string, chars int, cursor string")).collect()
        whole += "".join(s.text for s in r.slices)
        n += 1
        if not r.truncated:
            break
        place = r.cursor
    assert whole == "".join(t for t, _ in text) and n > 5


def test_pages_joined_are_the_list(spark):
    rows = spark.createDataFrame([(i, f"t{i % 4}") for i in range(23)], "doc_id long, title string")
    of = reading.list_scope("documents", ["title", "doc_id"], label="a", media=None)
    assert of == reading.list_scope("documents", ["title", "doc_id"], label="a") != reading.list_scope("documents", ["title", "doc_id"], label="b")
    for limit in (1, 5, 23, 100):
        got, place = [], None
        while True:
            page, place = reading.page_after(rows, ["title", "doc_id"], of, place, limit)
            got += page
            if place is None:
                break
        assert [(r.title, r.doc_id) for r in got] == sorted((f"t{i % 4}", i) for i in range(23))
    for bad in ("x", "e30", base64.urlsafe_b64encode(b'["other", ["t", 1]]').decode()):
        with pytest.raises(reading.ForeignCursor):
            reading.page_after(rows, ["title", "doc_id"], of, bad)
