"""Reads of texts within a budget of characters, cursors that belong to one read, reads that share a budget, and lists by
pages whose cursors belong to one list."""

import base64
import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a read or of a call at first, and the most reads of a call.
CHARS, READS = 24_000, 20


def scope(tool: str, *parts: Column) -> Column:
    """What a read reads: the tool and the facts that decide its text."""
    return F.concat_ws(":", F.lit(tool), *(p.cast("string") for p in parts))


def fingerprint(text: Column) -> Column:
    """Stands in a scope for a long text."""
    return F.substring(F.sha2(text, 256), 1, 12)


def cursor(unit: Column, offset: Column, of: Column) -> Column:
    """The token of a place in a scope, in letters that an address may hold."""
    text = F.concat_ws(".", F.lit("v1"), unit.cast("string"), offset.cast("string"), of)
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")


def resumed(token: Column, of: Column) -> Column:
    """struct(unit, offset) of a token, the beginning for none, or null for one that is no cursor or one of another scope."""
    own = F.trim(token)
    padded = F.concat(F.translate(own, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(own) % 4) % 4))
    text = F.try_validate_utf8(F.when(own.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64"))).cast("string"))
    parts = F.split(text, r"\.", 4)
    unit, offset = (F.when(parts[k].rlike("^[0-9]+$"), parts[k].try_cast("int")) for k in (1, 2))
    good = (F.size(parts) == 4) & (parts[0] == "v1") & (parts[3] == of) & unit.isNotNull() & offset.isNotNull()
    start = F.struct(F.lit(0).alias("unit"), F.lit(0).alias("offset"))
    return F.when(F.coalesce(own, F.lit("")) == "", start).when(good, F.struct(unit.alias("unit"), offset.alias("offset")))


def placed(units: DataFrame, reads: DataFrame) -> DataFrame:
    """The units of each read from its cursor's place on, with `offset`, where the read begins in them, and `n`, the
    characters from there on; and `fault` for a cursor that is foreign or points past the units."""
    at = reads.withColumn("at", resumed(F.col("cursor"), F.col("scope")))
    size = units.groupBy("read").agg(F.count("*").alias("units"))
    rows = at.join(size, "read", "left").join(units, "read", "left")
    past = F.col("at").isNull() | (F.col("at.unit") > F.coalesce("units", F.lit(0)))
    here = F.col("unit") == F.col("at.unit")
    beyond = here & (F.col("at.offset") > F.length("text"))
    offset = F.when(here, F.col("at.offset")).otherwise(0)
    wrong = F.max(F.coalesce(past | beyond, F.lit(False))).over(Window.partitionBy("read"))
    rows = rows.withColumn("fault", F.when(wrong, "foreign cursor")).withColumn("offset", offset)
    # Units before the place stay as rows without a unit, so that a read of what lies behind all of them is one too.
    ahead = F.col("unit") >= F.col("at.unit")
    return rows.withColumn("n", F.when(ahead, F.length("text") - F.col("offset"))).withColumn("unit", F.when(ahead, F.col("unit")))


def taken(rows: DataFrame) -> DataFrame:
    """(read, fault, truncated, cursor, used, slices): units in order while they fit into `chars`; the one at the border
    is cut, but not inside its head unless the read would give nothing. slices: struct<unit, offset, text>.

    rows: placed(), with chars and head."""
    start = F.coalesce(F.sum("n").over(Window.partitionBy("read").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start).withColumn("left", F.col("chars") - F.col("start"))
    fits = F.col("n") <= F.col("left")
    cut = ~fits & (F.col("left") > 0) & ((F.col("start") == 0) | (F.col("offset") + F.col("left") >= F.col("head")))
    given = F.when(F.col("fault").isNotNull() | F.col("unit").isNull(), 0).when(fits, F.col("n")).when(cut, F.col("left")).otherwise(0)
    rows = rows.withColumn("given", given.cast("int")).withColumn("there", F.col("fault").isNull() & F.col("unit").isNotNull() & (fits | cut))
    piece = F.struct("unit", "offset", F.substr("text", F.col("offset") + 1, F.col("given")).alias("text"))
    # The first unit that isn't given whole is where the rest begins.
    rest = F.min(F.when(F.col("fault").isNull() & ~fits, F.struct("unit", (F.col("offset") + F.col("given")).alias("offset"))))
    out = rows.groupBy("read", "scope", "fault").agg(rest.alias("rest"), F.sum("given").alias("used"), F.sort_array(F.collect_list(F.when(F.col("there"), piece))).alias("slices"))
    return out.select("read", "fault", F.col("rest").isNotNull().alias("truncated"), F.when(F.col("rest").isNotNull(), cursor(F.col("rest.unit"), F.col("rest.offset"), F.col("scope"))).alias("cursor"), F.coalesce("used", F.lit(0)).alias("used"), "slices")


def read(units: DataFrame, reads: DataFrame) -> DataFrame:
    """Each read on its own. units: (read, unit from 0, text, head), head being the characters at a unit's beginning that
    stay together; reads: (read, scope, chars, cursor)."""
    return taken(placed(units, reads))


def read_many(units: DataFrame, requests: DataFrame, chars: int = CHARS) -> DataFrame:
    """(call, number, read, fault, truncated, cursor, used, slices): the reads of a call, in order, share its characters. A
    read's own limit can only make it smaller; one that fails uses nothing up; with nothing left, a read is truncated
    and not made. A call of no or more than twenty reads is refused: all its reads have that fault.

    requests: (call, number, read, scope, chars, cursor), a read's name being of one request; units as in read()."""
    own = requests.withColumn("asked", F.count("*").over(Window.partitionBy("call")))
    refused = own.where(F.col("asked") > READS)
    none = F.lit(None)
    rows = placed(units, own.where(F.col("asked") <= READS))
    # What a read would take of any budget follows from the lengths of its units, so only these are folded over.
    sizes = rows.groupBy("call", "number", "read", "chars").agg(F.max("fault").alias("fault"), F.sort_array(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("unit", "n", "offset", "head")))).alias("sizes"))
    calls = sizes.groupBy("call").agg(F.sort_array(F.collect_list(F.struct("number", "read", "chars", "fault", "sizes"))).alias("r"))

    def use(budget: Column, sizes: Column) -> Column:
        def step(acc: Column, u: Column) -> Column:
            left, fits = acc["left"], u["n"] <= acc["left"]
            cut = (left > 0) & ((left == budget) | (u["offset"] + left >= u["head"]))
            after = F.when(acc["over"], left).when(fits, left - u["n"]).when(cut, F.lit(0)).otherwise(left)
            return F.struct(after.alias("left"), (acc["over"] | ~fits).alias("over"))

        return F.aggregate(sizes, F.struct(budget.alias("left"), F.lit(False).alias("over")), step, lambda acc: budget - acc["left"])

    def give(acc: Column, r: Column) -> Column:
        budget = F.least(acc["left"], F.coalesce(r["chars"], acc["left"])).cast("int")
        used = F.when(r["fault"].isNotNull(), 0).otherwise(use(budget, r["sizes"]))
        return F.struct((acc["left"] - used).cast("int").alias("left"), F.concat(acc["out"], F.array(budget)).alias("out"))

    zero = F.struct(F.lit(chars).cast("int").alias("left"), F.array().cast("array<int>").alias("out"))
    given = calls.select("call", F.explode(F.arrays_zip(F.col("r.read").alias("read"), F.col("r.number").alias("number"), F.aggregate("r", zero, give, lambda acc: acc["out"]).alias("budget"))).alias("x")).select("call", "x.*")
    whole = taken(rows.drop("chars").join(given.select("read", F.col("budget").alias("chars")), "read"))
    made = given.join(whole, "read")
    empty = (F.col("budget") == 0) & F.col("fault").isNull()
    made = made.select("call", "number", "read", "fault", (F.col("truncated") | empty).alias("truncated"), F.when(~empty, F.col("cursor")).alias("cursor"), "used", F.when(~empty, F.col("slices")).alias("slices"))
    kinds = made.schema
    return made.union(refused.select("call", "number", "read", F.lit("too many reads").alias("fault"), F.lit(False), *(none.cast(kinds[c].dataType) if c != "used" else F.lit(0) for c in ("cursor", "used", "slices"))))


class ForeignCursor(ValueError):
    """A cursor of another list, or none at all."""


def list_scope(tool: str, order: list[str], **filters: Any) -> str:
    """The fingerprint of a list: the tool, its order and its filters, in any order of naming."""
    text = json.dumps([tool, order, sorted((k, v) for k, v in filters.items() if v is not None)], default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def page_after(rows: DataFrame, order: list[str], of: str, after: str | None = None, limit: int = 100) -> tuple[list, str | None]:
    """A page of at most `limit` rows behind the cursor, by `order`, whose columns together tell rows apart and are never
    null, and the cursor of the next page, or None at the end. The cursor holds the last row's place in the order, so
    rows before it aren't read again or sorted; one of another scope is refused."""
    if after:
        try:
            found, place = json.loads(base64.urlsafe_b64decode(after + "=" * (-len(after) % 4)))
        except (ValueError, TypeError) as e:
            raise ForeignCursor(after) from e
        if found != of or len(place) != len(order):
            raise ForeignCursor(after)
        behind, same = F.lit(False), F.lit(True)
        for c, x in zip(order, place, strict=True):
            behind, same = behind | (same & (F.col(c) > F.lit(x))), same & (F.col(c) == F.lit(x))
        rows = rows.where(behind)
    got = rows.orderBy(*order).limit(limit + 1).collect()  # at most a page
    if len(got) <= limit:
        return got, None
    token = json.dumps([of, [got[limit - 1][c] for c in order]])
    return got[:limit], base64.urlsafe_b64encode(token.encode()).decode().rstrip("=")
