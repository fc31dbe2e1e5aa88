"""Building training sets: gates, exact duplicates, rarity-scaled plans, agreement of answers, counts of the outcome."""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.latex import renders
from quire.functions.markdown import prose
from quire.functions.text import hash64, words
from quire.operators.running import running_sum

#: Lots that the copies of one body are dealt to.
LOTS = 64
#: Kinds of texts, in the order of their drafts.
REPHRASED = ("rephrase_wiki", "rephrase_lecture", "rephrase_qa")
KINDS = (*REPHRASED, "entigraph", "notation_variant", "exercise")


def body(text: Column | str) -> Column:
    """The text after its first blank line, or the whole text where there is none."""
    whole = F.col(text) if isinstance(text, str) else text
    at = F.instr(whole, "\n\n")
    return F.when(at > 0, whole.substr(at + 2, F.length(whole))).otherwise(whole)


def hashed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, sha, lot): the hash of each document's body, and which of the lots of its copies it is dealt to."""
    sha = F.coalesce(F.sha2(body("text"), 256), F.lit("none"))
    return docs.select("doc_id", sha.alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(LOTS)).alias("lot"), *more)


def copies(hashes: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) of hashed documents. The first document of a hash is sent to the lots that its copies
    lie in, so many copies of one don't meet in one task."""
    least = hashes.groupBy("sha", "lot").agg(F.min("doc_id").alias("first"))
    firsts = least.groupBy("sha").agg(F.min("first").alias("first"), F.collect_set("lot").alias("lots"))
    both = hashes.join(firsts.select("sha", "first", F.explode("lots").alias("lot")), ["sha", "lot"])
    return both.select("doc_id", F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("duplicate_of"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of): the first kept document with the same body, null for that one itself. Documents without
    a text are copies of each other."""
    return copies(hashed(docs))


def verdicts(docs: DataFrame, scores: DataFrame, keep_unrendered: bool = False) -> DataFrame:
    """(doc_id, reason): the first of page score, math that doesn't render and duplicate, or null; only documents that
    pass the first two gates are remembered. Math is looked for outside listings."""
    broken = F.lit(False) if keep_unrendered else F.coalesce(~renders(prose("text")), F.lit(False))
    marked = docs.withColumn("broken", broken)
    gated = hashed(marked, "broken").join(scores, "doc_id", "left").withColumn("bad", F.when(F.col("score") < 1, "page-score").when(F.col("broken"), "latex"))
    good = copies(gated.where(F.col("bad").isNull())).select("doc_id", F.when(F.col("duplicate_of").isNotNull(), "duplicate").alias("reason"))
    return good.union(gated.where(F.col("bad").isNotNull()).select("doc_id", "bad"))


def page_scores(pages: DataFrame) -> DataFrame:
    """(section, score): the least of its pages' scores; null as soon as one is missing."""
    return pages.groupBy("section").agg(F.when(~F.bool_or(F.col("score").isNull()), F.min("score")).alias("score"))


def word_match(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, a_in_b, b_in_a): shares of the words of one text that the other has as often, to three places.

    texts: (doc_id, text); pairs: (id, a, b), with the ids of two texts. Both empty match fully, one empty not at all.
    A text is cut into words once, and its words are shuffled as one string; two of them meet in one row."""
    own = texts.select("doc_id", words("text").alias("w")).where(F.size("w") > 0)
    bag = own.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list(F.array_join("w", " "))).alias("w"), F.sum(F.size("w")).alias("n"))
    of = lambda c: bag.select(F.col("doc_id").alias(c), F.col("w").alias(f"w{c}"), F.col("n").alias(f"n{c}"))
    rows = in_both(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("id", "na", "nb", "wa", "wb"))
    share = lambda n: F.when(F.col("na").isNull() & F.col("nb").isNull(), 1.0).when(F.col(n).isNull(), 0.0).otherwise(F.round(F.col("both") / F.col(n), 3))
    return rows.select("id", share("na").alias("a_in_b"), share("nb").alias("b_in_a"))


def in_both(rows: DataFrame) -> DataFrame:
    """rows without `wa` and `wb`, but with `both`: how many words these share, each as often as both have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)
            both = [(Counter(a.split(" ")) & Counter(b.split(" "))).total() if a and b else 0 for a, b in pairs]
            yield batch.drop_columns(["wa", "wb"]).append_column("both", pa.array(both, pa.int64()))

    return rows.mapInArrow(run, StructType(rows.drop("wa", "wb").schema.fields).add("both", "long"))


def rarity(mentions: DataFrame, sections: DataFrame, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """(section, factor): how rare a section's concepts are. The typical count is the median over all pairs of a
    training section and a concept; the factor is the median of typical / count, kept within bounds, 1 without concepts.

    mentions: (section, concept_id), distinct pairs with n mentions; sections: (section, heldout)."""
    counts = mentions.groupBy("concept_id").agg(F.sum("n").alias("count"))
    pairs = mentions.join(counts, "concept_id").join(sections.where(~F.col("heldout")), "section")
    typical = pairs.agg(F.median("count").alias("typical"))  # one row
    each = pairs.crossJoin(F.broadcast(typical)).groupBy("section").agg(F.median(F.col("typical") / F.greatest("count", F.lit(1))).alias("f"))
    factor = F.greatest(F.lit(low), F.least(F.lit(high), F.col("f")))
    return sections.join(each, "section", "left").select("section", "heldout", F.coalesce(factor, F.lit(1.0)).alias("factor"))


def section_plan(factors: DataFrame, seeds: DataFrame, passages: DataFrame, rewrites: int = 3, questions: int = 2) -> DataFrame:
    """How many texts of each kind a section gets from each of its passages: three rephrasings in turn, an exercise
    from factor 1 on, another notation for one section with a display formula in twenty. Texts on relations are one for
    each, the rarest first, as many as there are rephrasings. Held-out sections get questions only.

    seeds: (section, place); passages: (section, passages, formula)."""
    n = F.when(F.col("heldout"), 0).otherwise(F.round(rewrites * F.col("factor")).cast("long"))
    part = lambda k: F.floor((n + 2 - k) / 3)
    asked = F.when(F.col("heldout"), min(questions, 2)).otherwise(F.round(questions * F.col("factor")).cast("long"))
    picked = F.coalesce("formula", F.lit(False)) & (hash64(F.col("section").cast("string")) % 20 == 0)
    given = {
        **{kind: part(k) for k, kind in enumerate(REPHRASED)},
        "entigraph": F.least(n, F.coalesce("seeded", F.lit(0))),
        "notation_variant": ~F.col("heldout") & picked,
        "exercise": ~F.col("heldout") & (F.col("factor") >= 1),
        "questions": asked,
    }
    seeded = seeds.groupBy("section").agg(F.count("*").alias("seeded"))
    rows = factors.join(seeded, "section", "left").join(passages.select("section", "passages", "formula"), "section", "left")
    own = F.greatest(F.coalesce("passages", F.lit(1)), F.lit(1)).cast("long")
    return rows.select("section", "heldout", "factor", own.alias("passages"), *(c.cast("long").alias(k) for k, c in given.items()))


def capped_questions(plan: DataFrame, most: int) -> DataFrame:
    """(section, questions): questions granted in the order of factor, then of the id's hash, until `most` are."""
    order = [F.desc("factor"), hash64(F.col("section").cast("string")), F.col("section")]
    left = F.lit(most) - F.col("before")
    return running_sum(plan, "questions", order, "before").select("section", F.greatest(F.lit(0), F.least(F.col("questions"), left)).alias("questions"))


def relation_seeds(relations: DataFrame, mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """(section, from_id, to_id, type, place): relations whose both ends a section mentions, the rarest end first."""
    ends = [mentions.select("section", F.col("concept_id").alias(c)) for c in ("from_id", "to_id")]
    own = relations.join(ends[0], "from_id").join(ends[1], ["section", "to_id"])
    n = [counts.select(F.col("concept_id").alias(c), F.col("count").alias(f"n_{c}")) for c in ("from_id", "to_id")]
    own = own.join(n[0], "from_id").join(n[1], "to_id")
    by = Window.partitionBy("section").orderBy(F.least("n_from_id", "n_to_id"), "from_id", "to_id", "type")
    return own.withColumn("place", F.row_number().over(by)).select("section", "from_id", "to_id", "type", "place")


def texts_of(kind: str) -> Column:
    """A plan's texts of one kind over all passages; those on relations are one for each relation."""
    return F.col(kind) if kind == "entigraph" else F.col(kind) * F.col("passages")


def plan_totals(plan: DataFrame, samples: int = 4) -> DataFrame:
    texts = sum((texts_of(k) for k in KINDS[1:]), texts_of(KINDS[0]))
    calls = F.sum(2 * texts + (samples + 2) * F.col("questions"))
    return plan.agg(*(F.sum(texts_of(k)).alias(k) for k in KINDS), F.sum("questions").alias("questions"), calls.alias("model_calls"))


def relation_passages(seeds: DataFrame, concepts: DataFrame, passages: DataFrame) -> DataFrame:
    """seeds with the number of the first passage that names the most of a relation's two concepts, ignoring case.

    concepts: (concept_id, name); passages: (section, bodies), bodies where a section has several."""
    names = [concepts.select(F.col("concept_id").alias(c), F.lower("name").alias(f"name_{c}")) for c in ("from_id", "to_id")]
    several = passages.where(F.size("bodies") > 1).select("section", F.transform("bodies", F.lower).alias("bodies"))
    rows = seeds.join(names[0], "from_id", "left").join(names[1], "to_id", "left").join(several, "section", "left")
    named = lambda b: sum((F.coalesce(F.contains(b, F.col(f"name_{c}")), F.lit(False)).cast("int") for c in ("from_id", "to_id")), F.lit(0))
    found = F.transform("bodies", named)
    best = F.array_position(found, F.array_max(found))
    return rows.select(*seeds.columns, F.coalesce(best, F.lit(1)).cast("long").alias("passage"))


def drafts(plan: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row for each text that a plan asks for: kind by kind each passage's versions, then the relations, numbered
    in a section and, from 1 as in the text's id, in a kind. from_id, to_id and type tell the relation.

    seeds: (section, from_id, to_id, type, place, passage)."""
    kinds = [k for k in KINDS if k != "entigraph"]
    long = plan.select("section", "passages", F.posexplode(F.array(*kinds)).alias("at", "n")).where("n > 0")
    upto = lambda c: F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))
    each = long.select("section", "at", "n", F.element_at(F.array(*map(F.lit, kinds)), F.col("at") + 1).alias("kind"), upto("passages").alias("passage"))
    each = each.select("section", "at", "kind", "passage", "n", upto("n").alias("version"))
    each = each.withColumn("number", (F.col("passage") - 1) * F.col("n") + F.col("version")).drop("n")
    told = seeds.join(plan.select("section", "entigraph"), "section").where(F.col("place") <= F.col("entigraph"))
    told = told.select("section", F.lit(len(kinds)).alias("at"), F.lit("entigraph").alias("kind"), "passage", F.lit(1).alias("version"), F.col("place").alias("number"), "from_id", "to_id", "type")
    both = each.unionByName(told, allowMissingColumns=True)
    name = F.concat_ws(":", "section", "kind", "number")
    draft = F.row_number().over(Window.partitionBy("section").orderBy("at", "number"))
    return both.select("section", "kind", "passage", "version", "number", name.alias("id"), "from_id", "to_id", "type", draft.alias("draft"))


def plain(value: Column | str) -> Column:
    return F.lower(F.regexp_replace(value, r"[\s$]", ""))


def agree(a: str, b: str, tolerance: float = 1e-3) -> Column:
    """Equal as texts without spaces and dollar signs, or as numbers within a relative tolerance. An infinite value is
    within that of any finite one, as the tolerance then is infinite too."""

    def number(c: str) -> Column:
        endless = F.col(c).rlike(r"(?i)^\s*[+-]?inf(?:inity)?\s*$")
        sign = F.when(F.trim(c).startswith("-"), -1.0).otherwise(1.0)
        return F.when(F.col(c).rlike(r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"), F.col(c).try_cast("double")).when(endless, sign * F.lit(float("inf")))

    x, y = number(a), number(b)
    near = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
    return (plain(a) == plain(b)) | F.coalesce(near, F.lit(False))


def agreement(tries: DataFrame) -> DataFrame:
    """(question, kept_try, votes): the try that most others agree with, ties to the earlier, if more than half of all
    tries do; of its group the shortest try is kept, ties to the earlier. A try without a value agrees with none.

    tries: (question, try, value, length), length being that of the working and the answer together; without it a try is
    its value."""
    if "length" not in tries.columns:
        tries = tries.withColumn("length", F.coalesce(F.length("value"), F.lit(0)))
    other = tries.select("question", F.col("try").alias("with"), F.col("value").alias("other"), "length")
    pairs = tries.drop("length").join(other, "question").where(agree("value", "other"))
    around = pairs.groupBy("question", "try").agg(F.count("*").alias("votes"), F.min(F.struct("length", F.col("with"))).alias("short"))
    best = around.groupBy("question").agg(F.max(F.struct("votes", (-F.col("try")).alias("t"), F.col("short.with").alias("kept"))).alias("b"))
    asked = tries.groupBy("question").agg(F.count("*").alias("asked"))
    return best.join(asked, "question").where(F.col("b.votes") * 2 > F.col("asked")).select("question", F.col("b.kept").alias("kept_try"), F.col("b.votes").alias("votes"))


def packed_paragraphs(paragraphs: Column | str, tokens: int = 500) -> Column:
    """Which chunk each paragraph of a list goes to: it joins the chunk before while both, with the empty line between,
    have at most `tokens` estimated tokens. A fold over lengths; no paragraph is split."""
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(-1).cast("long").alias("chars"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        size = F.length(p).cast("long")
        joined = acc["chars"] + 2 + size
        fits = (acc["chars"] >= 0) & (F.ceil(joined / 4) <= tokens)
        chunk = F.when(fits | (acc["chars"] < 0), acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, joined).otherwise(size).alias("chars"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(paragraphs, zero, add, lambda acc: acc["out"])


def histogram(scores: DataFrame) -> DataFrame:
    """Counts of the scores 1 to 5, zeros too."""
    all_ = scores.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("score"))
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))
    return all_.join(counts, "score", "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))


def out_of_sequence(pages: DataFrame) -> DataFrame:
    """Pages whose printed number isn't the last one before plus the pages between. pages: (doc_id, page, printed)."""
    by = Window.partitionBy("doc_id").orderBy("page")
    numeric = pages.where(F.col("printed").isNotNull()).withColumn("expected", F.lag("printed").over(by) + F.col("page") - F.lag("page").over(by))
    return numeric.where(F.col("printed") != F.col("expected")).select("doc_id", "page", "printed", "expected")
