"""Merkle manifests of a table, and proofs by coordinate lookup.

Rows are leaves; those of a source, in order, make a tree whose runs of three nodes become one node, until one is left,
the subroot; the subroots, in order, make a tree likewise, up to the root. A node's coordinates are tree, level and
number. To prove a leaf, its number and its tree's size tell which siblings it needs: the leaf explodes their
coordinates, these are joined to the stored table of nodes, put in order, and folded.

Levels are worked off in tiers of five: what lies above five levels is the same for the 243 leaves below, so it is looked
up once for them, and again in tiers. So no node is asked for by more than 162 rows, however large a tree is, and a tree
of n leaves takes log243(n) tiers.

Nulls in any field are leaves like others; rows without an id come first in their source, rows that repeat an id follow
one another by their digests, and equal rows are leaves each. A null source is a source and comes first. An empty table
has no leaves, no root and no proofs. Further columns are not read.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Nodes of a run, levels of a tier, leaves below a tier's top.
RUN, LEVELS = 3, 5
WIDTH = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"
#: Each level of a tier, with how many units lie below one of its nodes.
_WIDTHS = f"array({', '.join(f"struct({k} AS level, {RUN**k}L AS width)" for k in range(LEVELS))})"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as `-` if null, else as its length in bytes, a colon and its value."""
    own = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*own), 256)


@dataclass
class Tier:
    """units: tree, index, n (the tree's units), digest and what else leaves carry. blocks: tree, block, n, and the
    digests of up to six levels, `l0` to `l5`; the last one holds the next tier's unit."""

    units: DataFrame
    blocks: DataFrame

    def nodes(self) -> DataFrame:
        """The nodes' table: tree, level, node, digest."""
        levels = ", ".join(f"struct({k} AS level, {RUN ** (LEVELS - k)}L AS width, coalesce(l{k}, array()) AS own)" for k in range(LEVELS))
        each = self.blocks.selectExpr("tree", "block", f"explode(array({levels})) AS x").selectExpr("tree", "block", "x.level", "x.width", "posexplode(x.own) AS (at, digest)")
        return each.selectExpr("tree", "level", "block * width + at AS node", "digest")

    def ended(self) -> DataFrame:
        """Trees that end in this tier, with their roots."""
        last = F.coalesce(*(F.when(F.col("n") <= RUN**k, F.element_at(f"l{k}", 1)) for k in range(LEVELS + 1)))
        return self.blocks.where(F.col("n") <= WIDTH).select("tree", last.alias("root"))


@dataclass
class Manifest:
    """tiers: of the trees of the sources, lowest first. top: of the tree of their subroots. root: a row, or none."""

    tiers: list[Tier]
    top: list[Tier]

    def subroots(self) -> DataFrame:
        return self.top[0].units.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"))

    def root(self) -> DataFrame:
        return reduce(DataFrame.union, (t.ended() for t in self.top)).select("root")


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with index, from 0 within each tree by the order, and n, the tree's rows. Ranges of the order are numbered
    apart and then moved on by what lies before, so a tree may be of any size; equal rows are dealt out by chance."""
    taken = rows.withColumn("chance", F.rand(7)).repartitionByRange(tree, *order, "chance").drop("chance")
    dealt = stored(taken.withColumn("lot", F.spark_partition_id()))  # a second sample could draw other ranges
    sizes = dealt.groupBy("lot", tree).agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy(tree).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("lot", tree, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"), F.sum("own").over(Window.partitionBy(tree)).alias("n"))
    within = F.row_number().over(Window.partitionBy("lot", tree).orderBy(*order)) - 1
    return dealt.withColumn("index", within).join(ahead, ["lot", tree]).withColumn("index", F.col("index") + F.col("ahead")).drop("lot", "ahead")


def folded(level: str) -> Column:
    """The nodes above those of an array, a node for each run."""
    runs = f"sequence(0, int((size({level}) + {RUN - 1}) div {RUN}) - 1)"
    return F.expr(f"transform({runs}, i -> sha2(array_join(slice({level}, i * {RUN} + 1, {RUN}), ''), 256))")


def tier(units: DataFrame) -> Tier:
    """Five levels above the units of all trees, made block by block of 243."""
    sorted_ = F.sort_array(F.collect_list(F.struct("index", "digest")))
    made = units.groupBy("tree", F.expr(f"index div {WIDTH} AS block")).agg(F.max("n").alias("n"), sorted_.alias("own"))
    made = made.select("tree", "block", "n", F.col("own.digest").alias("l0"))
    for k in range(LEVELS):
        made = made.withColumn(f"l{k + 1}", F.when(F.col("n") > RUN**k, folded(f"l{k}")))
    return Tier(units, stored(made))


def climbed(units: DataFrame) -> list[Tier]:
    """Tiers over the units until every tree has ended."""
    made = [tier(units)]
    while not (above := made[-1].blocks.where(F.col("n") > WIDTH)).isEmpty():
        made.append(tier(above.selectExpr("tree", "block AS index", f"(n + {WIDTH - 1}) div {WIDTH} AS n", f"l{LEVELS}[0] AS digest")))
    return made


def manifest(docs: DataFrame, fields: list[Column] | None = None, claimed: Column | None = None, key: str = "doc_id", source: str = "source") -> Manifest:
    """The trees of a table. fields: what a leaf's digest is made of, FIELDS at first. claimed: the digest that each row
    is later proved by, such as that of another copy of it; its own at first."""
    own = leaf(fields or [F.col(c) for c in FIELDS])
    # The name of a source's tree: empty for null, so null comes first and the rest bytewise.
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = stored(docs.select(name.alias("tree"), F.col(key).alias("key"), own.alias("digest"), (own if claimed is None else claimed).alias("claimed")))
    tiers = climbed(stored(numbered(rows, "tree", ["key", "digest"])))
    subroots = reduce(DataFrame.union, (t.ended() for t in tiers)).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    return Manifest(tiers, climbed(stored(numbered(subroots, "tree", ["name"]))))


#: Level and number of each sibling that a unit needs within its tier, from its index and its tree's size n: a level has
#: a node if a unit lies below it.
COORDINATES = f"""flatten(transform(filter({_WIDTHS}, w -> n > w.width), w -> filter(
    transform(sequence(0, {RUN - 1}), i -> struct(w.level AS level, index div (w.width * {RUN}) * {RUN} + i AS node)),
    c -> c.node != index div w.width AND c.node * w.width < n)))"""
#: For each level of a tier, what stands left and right of a unit's own node, from its sorted siblings.
STEPS = f"""transform(filter({_WIDTHS}, w -> n > w.width), w -> struct(
    array_join(transform(filter(siblings, s -> s.level = w.level AND s.node < index div w.width), s -> s.digest), '') AS left,
    array_join(transform(filter(siblings, s -> s.level = w.level AND s.node > index div w.width), s -> s.digest), '') AS right))"""


def looked_up(own: Tier, above: DataFrame, keep: list[str]) -> DataFrame:
    """Each unit with the steps of its fold: on each level what stands left and right of it, up to the root.

    above: tree, block and what holds for all units below that block (steps from there on, subroot, root)."""
    asked = own.units.select("tree", "index", "n", F.expr(f"explode({COORDINATES}) AS c")).select("tree", "index", "n", "c.level", "c.node")
    found = asked.join(own.nodes(), ["tree", "level", "node"]).select("tree", "index", "n", F.struct("level", "node", "digest").alias("sibling"), *(F.lit(None).cast(own.units.schema[c].dataType).alias(c) for c in keep))
    # The units' own rows go along, so that one shuffle by block serves to gather siblings and to meet what is above.
    rows = found.unionByName(own.units.select("tree", "index", "n", F.lit(None).cast(found.schema["sibling"].dataType).alias("sibling"), *keep))
    rows = rows.withColumn("block", F.expr(f"index div {WIDTH}")).repartition("tree", "block")
    each = rows.groupBy("tree", "block", "index", "n").agg(F.sort_array(F.collect_list("sibling")).alias("siblings"), *(F.max(c).alias(c) for c in keep))

    each = each.withColumn("own steps", F.expr(STEPS)).drop("siblings", "n")
    return each.join(above, ["tree", "block"]).withColumn("steps", F.concat("own steps", "steps")).drop("own steps")


def paths(tiers: list[Tier], roots: DataFrame, keep: list[str]) -> DataFrame:
    """The lowest tier's units, with `keep`, the steps up to the root and what `roots` (tree, steps and more) has for
    their tree. Made from the highest tier down."""
    more, above = [c for c in roots.columns if c != "tree"], None
    for k in reversed(range(len(tiers))):
        here = tiers[k].ended().select("tree", F.lit(0).cast("long").alias("block")).join(roots, "tree").select("tree", "block", *more)
        above = here if above is None else here.union(above.select("tree", F.col("index").alias("block"), *more))
        above = looked_up(tiers[k], above, [] if k else keep)
        if k:
            above = stored(above.drop("block"))
    return above.drop("tree", "block", "index")


def proofs(made: Manifest) -> DataFrame:
    """A row for each leaf: key, leaf, subroot, root, proof_sha256 (of its siblings, left to right on each level, from
    the lowest), folded_root (from the claimed leaf and the siblings) and verified."""
    none = F.array().cast(_STEPS).alias("steps")
    # The tree of subroots has one root, in the one tree named ''; its units carry which source they are of.
    root = made.root().select(F.lit("").alias("tree"), none, "root")
    sources = stored(paths(made.top, root, ["name", "digest"]).select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"))
    each = paths(made.tiers, sources, ["key", "digest", "claimed"])
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("steps", F.col("claimed"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    each = each.select("key", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return each.withColumn("verified", F.col("folded_root") == F.col("root"))
