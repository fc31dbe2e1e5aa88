"""Mixing sources to target weights by min-cost flow.

Documents are added up by membership pattern, the set of sources they belong to. A pattern's words can be taken once,
twice, ... up to a limit, each further time at a higher cost; they flow to the quotas of its sources. The flow with
the least cost says how many words of each pattern the mix takes; documents are then chosen in an order drawn from a
seed: all of them as often as the whole passes say, and some once more.
"""

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, cut, fresh

Key = tuple[str | None, ...]


def targets(sizes: list[int], weights: list[float], times: int) -> list[float]:
    """Shares of sum(sizes) by weight; what is above times a source's size is shared anew among the others."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > times * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(times * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def flow(patterns: dict[Key, int], quotas: dict[str | None, int], times: int) -> dict[Key, int]:
    """Words to take of each pattern: a flow of least cost through pattern and source, where the k-th time of a
    pattern's words costs k^2 - 1 each; by augmenting along the cheapest path."""
    names = ["start", *patterns, *(("quota", s) for s in quotas), "end"]
    number = {x: i for i, x in enumerate(names)}
    edges: list[list] = []  # to, capacity left, cost; edge e ^ 1 is its reverse
    at: list[list[int]] = [[] for _ in names]

    def add(a, b, capacity: int, cost: int) -> None:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            at[number[x]].append(len(edges))
            edges.append([number[y], c, w])

    for p, size in patterns.items():
        for k in range(1, times + 1):
            add("start", p, size, k * k - 1)
        for s in p:
            add(p, ("quota", s), times * size, 0)
    for s, quota in quotas.items():
        add(("quota", s), "end", quota, 0)
    while True:
        cost, via, queue, waiting = {0: 0}, {}, deque([0]), {0}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in at[x]:
                y, capacity, w = edges[e]
                if capacity and cost[x] + w < cost.get(y, float("inf")):
                    cost[y], via[y] = cost[x] + w, e
                    if y not in waiting:
                        waiting.add(y)
                        queue.append(y)
        if len(names) - 1 not in via:
            break
        path, y = [], len(names) - 1
        while y:
            path.append(via[y])
            y = edges[via[y] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    # What came from the start is the capacity of the edges that lead back to it.
    return {p: sum(edges[e][1] for e in at[number[p]] if edges[e][0] == 0) for p in patterns}


def chosen(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """The rows that aren't larger than their pattern's gap, with `new` set for those, in the drawn order, whose sizes
    come to no more than the gap.

    The running sum is made in lots, so that a pattern with very many rows isn't one task."""
    # gaps has a row for a pattern, as the driver has.
    open_ = rows.join(F.broadcast(gaps), "pattern").where((F.col("size") > 0) & (F.col("size") <= F.col("gap"))).withColumn("lot", F.shiftright("draw", 52))
    lot = open_.groupBy("pattern", "lot").agg(F.sum("size").alias("own"))
    before = lot.select("pattern", "lot", (F.sum("own").over(Window.partitionBy("pattern").orderBy("lot")) - F.col("own")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("pattern", "lot").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0))
    summed = open_.withColumn("within", within).join(before, ["pattern", "lot"])
    return summed.select("row", "pattern", "size", "draw", (F.col("before") + F.col("within") <= F.col("gap")).alias("new"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", cycle: tuple[float, ...] = (1, 2, 3), times: int = 3, seed: int = 8, fills: int = 4) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, pattern, size, taken, copies), a row per document with the words that the mix takes of
    it, repeats counted; and (source, source_size, target), a row per source.

    sources: an array column of the sources a document belongs to; a null array counts as one null source. Sources by
    code point, nulls last, have the weights of cycle, repeating; together they get as many words as there are, and
    none more than `times` its size, as no document is taken more often. A null text has size 0. Chosen documents are
    whole; after a first choice, `fills` more look for documents that fit what is left of a pattern's amount. Other
    columns are dropped; repeated rows count each; an empty table gives empty tables. The tables of sources and of
    patterns are held by the driver."""
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string"))).alias("pattern"), word_count(F.col(text)).alias("size"))
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1))
    # Rows of one id differ in size or not at all, so the id, the size and a running number among equals name a row.
    rows = cut(rows.withColumn("row", F.struct("doc_id", "size", F.row_number().over(Window.partitionBy("doc_id", "size", "pattern").orderBy("draw")))))
    patterns = {tuple(r["pattern"]): r["size"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    names = sorted({s for p in patterns for s in p if s is not None}) + [None] * any(None in p for p in patterns)
    sizes = [sum(v for p, v in patterns.items() if s in p) for s in names]
    scale = sum(patterns.values()) / max(1, sum(sizes))  # overlapping sources count shared words once
    wanted = targets(sizes, [cycle[i % len(cycle)] for i in range(len(names))], times)
    wanted = [t * scale for t in wanted]
    amounts = flow(patterns, {s: round(t) for s, t in zip(names, wanted, strict=True)}, times)
    plan = [(list(p), min(times, amounts[p] // size) if size else 0, amounts[p]) for p, size in patterns.items()]
    plan = [(p, k, amount - k * patterns[tuple(p)]) for p, k, amount in plan]
    passes = spark.createDataFrame(plan, "pattern array<string>, passes long, gap long")
    gaps, rest, picked = {tuple(p): gap for p, _, gap in plan}, rows.select("row", "pattern", "size", "draw"), []
    for _ in range(1 + fills):
        open_ = [(list(p), gap) for p, gap in gaps.items() if gap > 0]
        if not open_:
            break
        # What isn't taken and fits what is left of a gap goes on, so later passes are small.
        made = cut(chosen(rest, spark.createDataFrame(open_, "pattern array<string>, gap long")))
        used = made.where("new").groupBy("pattern").agg(F.sum("size").alias("used")).collect()  # a row for each pattern at most
        if not used:
            break
        picked.append(made.where("new").select("row", F.lit(1).cast("long").alias("extra")))
        rest = made.where("NOT new").drop("new")
        for r in used:
            gaps[tuple(r["pattern"])] -= r["used"]
    taken = rows.join(F.broadcast(passes.select("pattern", "passes")), "pattern")
    taken = taken.join(reduce(DataFrame.union, picked), "row", "left") if picked else taken.withColumn("extra", F.lit(0).cast("long"))
    copies = F.col("passes") + F.coalesce("extra", F.lit(0))
    taken = taken.select("doc_id", "pattern", "size", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    return taken, spark.createDataFrame(list(zip(names, sizes, wanted, strict=True)), "source string, source_size long, target double")


def mixed(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with each row as often as the mix takes it; the options are those of mix().

    Rows that share both id and size are all taken as often as the one of them that is taken most."""
    taken, _ = mix(docs, sources, doc_id, text, **options)
    id_, size, copies = (fresh(f"{c} in the mix", docs.columns) for c in ("id", "size", "copies"))
    often = taken.groupBy(F.col("doc_id").alias(id_), F.col("size").alias(size)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(often, F.col(doc_id).eqNullSafe(F.col(id_)) & (word_count(F.col(text)) == F.col(size)))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
