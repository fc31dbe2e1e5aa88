"""Caps over a plan of texts, granted in whole passages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import hash64
from quire.operators.dataset import KINDS, REPHRASED, texts_of
from quire.operators.running import running_sum

#: Rows looked up at a time where a cap is nearly used.
AT_ONCE = 1000


def cap_texts(plan: DataFrame, kinds: tuple[str, ...], most: int) -> DataFrame:
    """(section, kind, n): texts granted kind by kind, and within a kind in the order of `place`, in whole passages.

    plan: (section, place, passages, and a column for each kind: how many texts a passage gets). A section gets a kind
    for as many rounds of its passages as what is left allows; the remainder passes on. A running sum tells which rows
    get all; the first that doesn't leaves less than a round of its own, so only a few more rows are looked up."""
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("at") + 1)
    long = plan.select("section", "place", "passages", F.posexplode(F.array(*kinds)).alias("at", "n")).withColumn("kind", name)
    summed = running_sum(long.withColumn("asked", F.col("n") * F.col("passages")), "asked", ["at", "place", "section"], "before")
    full = (F.col("before") + F.col("asked")) <= most
    left = most - (summed.where(full).agg(F.sum("asked")).first()[0] or 0)
    rest = summed.where(~full & (F.col("n") > 0) & (F.col("passages") > 0))
    granted = []
    while left > 0:
        rest = rest.where(F.col("passages") <= left)
        row = rest.orderBy("at", "place", "section").limit(1).first()
        if row is None:
            break
        rounds = min(row["n"], left // row["passages"])
        left -= rounds * row["passages"]
        granted.append((row["section"], row["kind"], rounds))
        later, at, place = F.col("section") > row["section"], F.col("at"), F.col("place")
        rest = rest.where((at > row["at"]) | (at == row["at"]) & ((place > row["place"]) | (place == row["place"]) & later))
    some = plan.sparkSession.createDataFrame(granted, "some_section long, some_kind string, some long")  # a few rows
    both = summed.join(F.broadcast(some), (F.col("section") == F.col("some_section")) & (F.col("kind") == F.col("some_kind")), "left")
    return both.select("section", "kind", F.when(full, F.col("n")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n"))


def kept(row: dict, left: int) -> dict:
    """A section's texts cut to `left`: the rephrasings, spread again, then the relations, the exercise, the notation."""
    passages, out = row["passages"], {}
    n = min(sum(row[k] for k in REPHRASED), left // passages)
    out.update({k: n // 3 + (turn < n % 3) for turn, k in enumerate(REPHRASED)})
    left -= n * passages
    for kind, size in (("entigraph", 1), ("exercise", passages), ("notation_variant", passages)):
        out[kind] = min(row[kind], left // size)
        left -= out[kind] * size
    return out


def keep_texts(plan: DataFrame, most: int) -> DataFrame:
    """(section, kind, n): texts granted section by section, the highest factor first and ties by the id's hash, each
    as far as what is left allows in whole passages; the remainder passes on. Held-out sections aren't in the plan's
    order and have no texts.

    A running sum tells which sections get all; the first that doesn't leaves less than it asked for, so only a few
    more are looked up."""
    asked = sum((texts_of(k) for k in KINDS[1:]), texts_of(KINDS[0]))
    sized = plan.where(~F.col("heldout")).withColumns({"asked": asked, "hash": hash64(F.col("section").cast("string"))})
    summed = running_sum(sized, "asked", [F.desc("factor"), F.col("hash"), F.col("section")], "before")
    full = (F.col("before") + F.col("asked")) <= most
    left = most - (summed.where(full).agg(F.sum("asked")).first()[0] or 0)
    # With an asked text a row's `before` is its own, so it tells the order.
    rest = summed.where(~full & (F.col("asked") > 0))
    least = F.when(F.col("entigraph") > 0, 1).otherwise(F.col("passages"))
    granted, last = [], -1
    while left > 0:
        rows = rest.where((least <= left) & (F.col("before") > last)).orderBy("before").limit(AT_ONCE).collect()
        if not rows:
            break
        for r in rows:
            some = kept(r.asDict(), left)
            left -= sum(n * (1 if k == "entigraph" else r["passages"]) for k, n in some.items())
            if any(some.values()):
                granted.append((r["section"], *(some[k] for k in KINDS)))
        last = rows[-1]["before"]
    some = plan.sparkSession.createDataFrame(granted, "section long, " + ", ".join(f"some_{k} long" for k in KINDS))  # a few rows
    both = summed.select("section", full.alias("full"), *KINDS).join(F.broadcast(some), "section", "left")
    n = [F.struct(F.lit(k).alias("kind"), F.when(F.col("full"), F.col(k)).otherwise(F.coalesce(f"some_{k}", F.lit(0))).cast("long").alias("n")) for k in KINDS]
    return both.select("section", F.explode(F.array(*n)).alias("x")).select("section", "x.*")
