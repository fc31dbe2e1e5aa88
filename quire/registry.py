"""Every query of the library by name, and the SQL that gives the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import catalogue, changes, dataset, graph, passages, retrieval, vectors
from quire.plans import caps
from quire.sources import lineage, table
from quire.sources.library import SQL, library

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, model: bool = True):
    """Registers a function of (library, spark, sf_dir) or, without the model, of (spark, sf_dir)."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(library(spark, sf_dir), spark, sf_dir)) if model else f
        if sql:
            ORACLE_SQL[f.__name__] = (SQL + sql) if model else sql
        return f

    return add


PLACES = ", place AS (SELECT m.item_id, concept_id, doc_id, page, kind FROM mention m JOIN item i ON m.item_id = i.item_id)\n"
BOTH = ", both_ways AS (SELECT from_id AS concept_id, to_id AS other FROM relation UNION ALL SELECT to_id, from_id FROM relation)\n"
IDS = [7, 12, 40, 77, 101, 155]
IN_IDS = "(7, 12, 40, 77, 101, 155)"


@query(PLACES + "SELECT d.doc_id, title, count(*) AS mentions FROM place p JOIN document d ON p.doc_id = d.doc_id WHERE concept_id = 7 GROUP BY ALL")
def documents_for_concept(lib, *_):
    return graph.documents_for_concept(lib, 7)


@query(PLACES + "SELECT c.concept_id, count(DISTINCT doc_id) AS documents FROM concept c LEFT JOIN place p ON c.concept_id = p.concept_id GROUP BY 1")
def concept_document_counts(lib, *_):
    return graph.concept_document_counts(lib)


@query("SELECT c.concept_id, count(m.item_id) AS mentions FROM concept c LEFT JOIN mention m ON c.concept_id = m.concept_id GROUP BY 1")
def mention_counts(lib, *_):
    return graph.mention_counts(lib)


SHARING = PLACES + "SELECT d.doc_id, title, count(DISTINCT concept_id) AS shared FROM place p JOIN document d ON p.doc_id = d.doc_id WHERE p.doc_id <> 7 AND concept_id IN (SELECT concept_id FROM place WHERE doc_id = 7) GROUP BY ALL"


@query(SHARING)
def documents_sharing(lib, *_):
    return graph.documents_sharing(lib, graph.concepts_of(lib, 7), 7)


@query(SHARING + " HAVING count(DISTINCT concept_id) >= 3 ORDER BY shared DESC, title, d.doc_id LIMIT 5")
def related_documents(lib, *_):
    return graph.related_documents(lib, 7)


COMPARED = PLACES + ", each AS (SELECT concept_id, doc_id, count(*) AS n FROM place WHERE doc_id IN (7, 8, 10, 11) GROUP BY ALL), shared AS (SELECT concept_id, sum(n) AS total, count(*) AS docs, min(doc_id) AS sole FROM each GROUP BY 1)"


@query(COMPARED + "SELECT concept_id, normalised_name, CAST(total AS BIGINT) AS total, docs AS documents FROM shared JOIN concept USING (concept_id)")
def concepts_shared(lib, *_):
    return graph.concepts_shared(lib, [7, 8, 10, 11]).select("concept_id", "normalised_name", "total", F.size("each").cast("long").alias("documents"))


@query(COMPARED + """, b AS (SELECT *, CASE WHEN docs > 1 THEN 'shared' ELSE 'only ' || sole END AS bucket FROM shared JOIN concept USING (concept_id)),
    r AS (SELECT bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY total DESC, normalised_name, concept_id) AS INTEGER) AS place, concept_id, CAST(total AS BIGINT) AS total FROM b)
    SELECT * FROM r WHERE place <= 50""")
def compare_documents(lib, *_):
    return graph.compare_documents(lib, [7, 8, 10, 11])


@query(PLACES + "SELECT title, d.doc_id, page, kind, item_id FROM place p JOIN document d ON p.doc_id = d.doc_id WHERE concept_id = 7 ORDER BY title, d.doc_id, page, kind, item_id LIMIT 10 OFFSET 5")
def items_mentioning(lib, *_):
    return graph.items_mentioning(lib, 7, offset=5, limit=10)


@query(f"SELECT item_id, d.doc_id, title, page FROM item i JOIN document d ON i.doc_id = d.doc_id WHERE item_id IN {IN_IDS}")
def item_places(lib, *_):
    return graph.item_places(lib, IDS)


@query("SELECT concept_id, name, definition FROM concept WHERE normalised_name = 'brand#3' OR lower(alias) = 'brand#3' ORDER BY normalised_name <> 'brand#3', concept_id LIMIT 1")
def find_concept(lib, *_):
    return graph.find_concept(lib, "brand#3")


BY_MENTIONS = "SELECT c.concept_id, name, normalised_name, count(*) AS mentions FROM {} m JOIN concept c ON m.concept_id = c.concept_id {} GROUP BY ALL"


@query(BY_MENTIONS.format("mention", f"WHERE item_id IN {IN_IDS}"))
def concepts_for_items(lib, *_):
    return graph.concepts_for_items(lib, IDS)


@query(PLACES + BY_MENTIONS.format("place", "WHERE doc_id = 7"))
def document_concepts(lib, *_):
    return graph.document_concepts(lib, 7)


@query(PLACES + BY_MENTIONS.format("place", "WHERE doc_id = 7 AND page = 4"))
def page_concepts(lib, *_):
    return graph.document_concepts(lib, 7, 4)


@query(BY_MENTIONS.format("mention", "") + " ORDER BY mentions DESC, normalised_name, c.concept_id LIMIT 20")
def top_concepts(lib, *_):
    return graph.top_concepts(lib)


@query(f"SELECT item_id, list_sort(list(concept_id)) AS concepts FROM mention WHERE concept_id IN {IN_IDS} GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 50")
def items_for_concepts(lib, *_):
    return graph.items_for_concepts(lib, IDS)


@query(BOTH + f"SELECT DISTINCT c.concept_id, normalised_name FROM both_ways b JOIN concept c ON b.other = c.concept_id WHERE b.concept_id IN {IN_IDS} AND other NOT IN {IN_IDS}")
def related_concepts(lib, *_):
    return graph.related_concepts(lib, IDS)


@query("SELECT * FROM relation WHERE from_id IN (SELECT concept_id FROM mention) AND to_id IN (SELECT concept_id FROM mention)")
def relations_among(lib, *_):
    return graph.relations_among(lib, lib.mention.select("concept_id"))


@query("SELECT * FROM mention WHERE item_id IN (SELECT item_id FROM item WHERE kind = 'chunk') AND concept_id IN (SELECT from_id FROM relation)")
def mentions_between(lib, *_):
    return graph.mentions_between(lib, lib.item.where("kind = 'chunk'").select("item_id"), lib.relation.select(F.col("from_id").alias("concept_id")))


@query(f"SELECT * FROM relation WHERE from_id IN {IN_IDS}")
def neighbours_out(lib, *_):
    return graph.neighbours(lib, IDS, "out")


@query(f"SELECT * FROM relation WHERE to_id IN {IN_IDS} AND type IN ('ASSUMES', 'PART_OF')")
def neighbours_in(lib, *_):
    return graph.neighbours(lib, IDS, "in", ("ASSUMES", "PART_OF"))


@query(f"SELECT * FROM relation WHERE from_id IN {IN_IDS} OR to_id IN {IN_IDS} ORDER BY from_id, to_id, type LIMIT 10")
def neighbours_both(lib, *_):
    return graph.neighbours(lib, IDS, "both", limit=10)


@query(""", first AS (SELECT from_id, to_id, type FROM relation WHERE from_id = 7 OR to_id = 7),
    near AS (SELECT from_id AS id FROM first UNION SELECT to_id FROM first),
    second AS (SELECT from_id, to_id, type FROM relation WHERE from_id IN (SELECT id FROM near WHERE id <> 7) OR to_id IN (SELECT id FROM near WHERE id <> 7) EXCEPT SELECT * FROM first)
    SELECT 1 AS step, * FROM first UNION ALL SELECT 2, * FROM second""")
def neighbours_depth2(lib, *_):
    return graph.neighbours_depth2(lib, 7)


@query(""", steps AS (SELECT from_id AS a, to_id AS b, ROW(from_id, to_id, type) AS edge FROM relation UNION ALL SELECT to_id, from_id, ROW(from_id, to_id, type) FROM relation),
    w1 AS (SELECT b, [edge] AS path FROM steps WHERE a = 7), w2 AS (SELECT s.b, list_append(path, edge) AS path FROM w1 JOIN steps s ON s.a = w1.b), w3 AS (SELECT s.b, list_append(path, edge) AS path FROM w2 JOIN steps s ON s.a = w2.b),
    w4 AS (SELECT s.b, list_append(path, edge) AS path FROM w3 JOIN steps s ON s.a = w3.b), way AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4)
    SELECT array_to_string(list_transform(path, lambda e: e[1] || ' ' || e[2] || ' ' || e[3]), ', ') AS path FROM way WHERE b = 52 ORDER BY len(path), path LIMIT 1""")
def shortest_path(lib, *_):
    edge = lambda e: F.concat_ws(" ", e["from_id"].cast("string"), e["to_id"].cast("string"), e["type"])
    return graph.shortest_path(lib, 7, 52).select(F.array_join(F.transform("path", edge), ", ").alias("path"))


@query("SELECT d.doc_id, title, media, category, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("chunk", "formula", "figure", "table", "code")) + " FROM document d LEFT JOIN item i ON d.doc_id = i.doc_id GROUP BY ALL")
def document_records(lib, *_):
    return graph.document_records(lib)


@query(PLACES + "SELECT doc_id, page, count(DISTINCT concept_id) AS concepts FROM place GROUP BY ALL")
def section_concept_counts(lib, *_):
    return graph.section_concept_counts(lib)


@query(PLACES + BOTH + """SELECT c.concept_id, name, alias, (SELECT count(*) FROM place WHERE concept_id = 7) AS mentions, (SELECT count(DISTINCT doc_id) FROM place WHERE concept_id = 7) AS documents,
    (SELECT list_sort(list(item_id)) FROM (SELECT item_id FROM place p JOIN document d ON p.doc_id = d.doc_id WHERE concept_id = 7 ORDER BY title, d.doc_id, page, kind, item_id LIMIT 5)) AS items,
    (SELECT list_sort(list(DISTINCT other)) FROM both_ways WHERE concept_id = 7 AND other <> 7) AS related FROM concept c WHERE c.concept_id = 7""")
def concept_overview(lib, *_):
    return graph.concept_overview(lib, 7)


@query(BOTH + f""", near AS (SELECT DISTINCT c.concept_id, normalised_name FROM both_ways b JOIN concept c ON b.other = c.concept_id WHERE b.concept_id IN {IN_IDS} AND other NOT IN {IN_IDS} ORDER BY normalised_name, c.concept_id LIMIT 40),
    links AS (SELECT other, count(*) AS links FROM (SELECT DISTINCT * FROM both_ways WHERE concept_id IN {IN_IDS}) GROUP BY 1)
    SELECT concept_id, links FROM near JOIN links ON concept_id = other ORDER BY links DESC, normalised_name, concept_id LIMIT 6""")
def concept_graph(lib, *_):
    return graph.concept_graph(lib, IDS)


# Vectors: items are the embeddings, their document is the label.
def item_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("doc_id"), (F.col("vec_id") % 5).alias("kind"), F.col("embedding").alias("vector"))


COSINE = """WITH v AS (SELECT vec_id AS item_id, CAST(label AS BIGINT) AS doc_id, vec_id % 5 AS kind, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    s AS (SELECT v.item_id, v.doc_id, v.kind, round(list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))), 6) AS score FROM v, v q WHERE q.item_id = 7)
"""


def searched(spark, sf_dir):
    v = item_vectors(spark, sf_dir)
    return vectors.scored(v, vectors.one(v, 7)).drop("vector")


@query(COSINE + "SELECT item_id, score FROM s WHERE kind IN (0, 1) ORDER BY score DESC, item_id LIMIT 10", model=False)
def vector_topk(spark, sf_dir):
    v = item_vectors(spark, sf_dir)
    return vectors.top_k(v.where("kind IN (0, 1)"), vectors.one(v, 7), 10).select("item_id", "score")


@query(COSINE + "SELECT item_id, score FROM s", model=False)
def vector_rank(spark, sf_dir):
    return searched(spark, sf_dir).select("item_id", "score").orderBy(F.desc("score"), "item_id")


@query(COSINE + "SELECT item_id, score FROM s WHERE item_id <> 7 ORDER BY score DESC, item_id LIMIT 8", model=False)
def similar_items(spark, sf_dir):
    return vectors.similar(item_vectors(spark, sf_dir), 7, 8).select("item_id", "score")


@query(COSINE + "SELECT * FROM (SELECT item_id, doc_id, score FROM s WHERE item_id <> 7 ORDER BY score DESC, item_id LIMIT 6) WHERE doc_id <> (SELECT doc_id FROM v WHERE item_id = 7) ORDER BY score DESC, item_id LIMIT 5", model=False)
def lone_item_related(spark, sf_dir):
    v = item_vectors(spark, sf_dir)
    own = v.where("item_id = 7").select(F.col("doc_id").alias("own"))
    return vectors.similar(v, 7, 6).join(own, F.col("doc_id") == F.col("own"), "left_anti").orderBy(F.desc("score"), "item_id").limit(5).select("item_id", "doc_id", "score")


CAPPED = COSINE + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS own FROM s),
    k AS (SELECT item_id, score FROM r WHERE own <= 3 ORDER BY score DESC, item_id LIMIT 25)
"""


@query(CAPPED + "SELECT k.item_id, doc_id, k.score FROM k JOIN s USING (item_id)", model=False)
def search_capped(spark, sf_dir):
    return vectors.capped(searched(spark, sf_dir), 25, 3).where("kept").select("item_id", "doc_id", "score")


OVER = CAPPED + ", o AS (SELECT r.item_id, r.doc_id, r.score FROM r WHERE own > 3 AND (r.score > (SELECT min(score) FROM k) OR r.score = (SELECT min(score) FROM k) AND r.item_id <= (SELECT max(item_id) FROM k WHERE score = (SELECT min(score) FROM k))))"


@query(OVER + "SELECT * FROM o", model=False)
def capped_items(spark, sf_dir):
    return vectors.capped(searched(spark, sf_dir), 25, 3).where("NOT kept").select("item_id", "doc_id", "score")


@query(OVER + "SELECT doc_id, count(*) AS passed, max(score) AS best FROM o GROUP BY 1", model=False)
def passed_over(spark, sf_dir):
    return vectors.passed_over(searched(spark, sf_dir), 25, 3)


NEAREST = """WITH v AS (SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    spread AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS pos FROM v), mean AS (SELECT label, pos, avg(x) AS x FROM spread GROUP BY ALL), c AS (SELECT CAST(label AS BIGINT) AS concept_id, list(x ORDER BY pos) AS e FROM mean GROUP BY 1),
    p AS (SELECT v.item_id, c.concept_id, round(list_inner_product(v.e, c.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(c.e, c.e))), 6) AS score FROM v, c),
    n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, concept_id) = 1)
"""


def label_vectors(v):
    """(concept_id, vector): a concept for each label, with the mean of its vectors."""
    at = v.where("vector IS NOT NULL").select("doc_id", F.posexplode("vector").alias("at", "x"))
    means = at.groupBy("doc_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])
    return means.groupBy(F.col("doc_id").alias("concept_id")).agg(own.alias("vector"))


def resolved(spark, sf_dir):
    v = item_vectors(spark, sf_dir)
    return vectors.nearest_concept(v, label_vectors(v))


@query(NEAREST + "SELECT * FROM n", model=False)
def concept_nearest(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(NEAREST + "SELECT item_id, CASE WHEN score >= 0.95 THEN 'link' WHEN score < 0.75 THEN 'create' ELSE 'ask' END AS rule FROM n", model=False)
def resolve_rule(spark, sf_dir):
    return resolved(spark, sf_dir).select("item_id", vectors.resolution(F.lit(False), F.col("score")).alias("rule"))


# Retrieval over the graph.
FRONTIER = BOTH + """, asked AS (SELECT concept_id, 0 AS stage, concept_id AS place FROM concept WHERE concept_id IN (7, 12)),
    said AS (SELECT concept_id, 1 AS stage, -count(*) AS place FROM mention WHERE item_id IN (40, 77, 101) GROUP BY 1),
    near AS (SELECT * FROM asked UNION ALL SELECT * FROM said),
    hop AS (SELECT DISTINCT other AS concept_id, 2 AS stage, 0 AS place FROM both_ways WHERE concept_id IN (SELECT concept_id FROM near)),
    frontier AS (SELECT concept_id, stage, place FROM (SELECT * FROM near UNION ALL SELECT * FROM hop) QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY stage, place) = 1)
"""


def found_concepts(lib):
    question = lib.concept.where(F.col("concept_id").isin(7, 12)).select("concept_id", F.col("concept_id").alias("place"))
    seeds = lib.item.where(F.col("item_id").isin(40, 77, 101)).select("item_id")
    return retrieval.frontier(lib, question, seeds), seeds


@query(FRONTIER + "SELECT * FROM frontier")
def concept_frontier(lib, *_):
    return found_concepts(lib)[0]


@query(FRONTIER + """, near_items AS (SELECT item_id, count(*) AS n, min(ROW(stage, place, concept_id)) AS f FROM mention JOIN frontier USING (concept_id) GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50)
    SELECT unnest([40, 77, 101]) AS item_id, -1 AS reason UNION ALL SELECT item_id, f[3] FROM near_items WHERE item_id NOT IN (40, 77, 101)""")
def search_candidates(lib, *_):
    return retrieval.candidates(lib, *found_concepts(lib))


CITES = ", kept AS (SELECT item_id, item_id AS place FROM item WHERE kind = 'chunk')\n"


@query(CITES + """SELECT i.item_id, i.label, min(w.place) AS by FROM item i JOIN (SELECT doc_id, place, unnest(cites) AS label FROM item JOIN kept USING (item_id)) w ON i.doc_id = w.doc_id AND i.label = w.label
    WHERE i.item_id NOT IN (SELECT item_id FROM kept) GROUP BY ALL""")
def cited_pull_in(lib, *_):
    kept = lib.item.where("kind = 'chunk'").select("item_id", F.col("item_id").alias("place"))
    return retrieval.cited(lib.item, kept)


@query("SELECT item_id, doc_id, page, kind, label FROM item WHERE label IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, page, kind, label) = 1")
def piece_of_item(lib, *_):
    return retrieval.only_piece(lib.item.select("item_id", "doc_id", "page", "kind", "label"))


# Catalogue.
@query("SELECT doc_id, title FROM document WHERE lower(trim(media)) = 'nation_7' AND category = 'book' AND list_contains(tags, 'building')")
def label_filter(lib, *_):
    return lib.document.where(catalogue.fits(media=" Nation_7", category="book", tags=("building",))).select("doc_id", "title")


@query("SELECT doc_id, CASE WHEN category = 'book' THEN 'chapter' WHEN bool_or(category = 'book') OVER (PARTITION BY media) THEN 'part' ELSE 'document' END AS role FROM document")
def doc_role(lib, *_):
    return catalogue.roles(lib.document, F.col("category") == "book")


@query("SELECT doc_id, title, (SELECT count(*) FROM document WHERE category = 'paper') AS total FROM document WHERE category = 'paper' ORDER BY title, doc_id LIMIT 100 OFFSET 100")
def list_documents(lib, *_):
    return catalogue.page_of(lib.document.where("category = 'paper'").select("doc_id", "title"), 100, 100)


@query("SELECT lower(trim(media)) AS media, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS items FROM document d LEFT JOIN (SELECT doc_id, count(*) AS n FROM item GROUP BY 1) i ON d.doc_id = i.doc_id GROUP BY 1")
def list_media(lib, *_):
    return catalogue.media_list(lib)


@query("SELECT DISTINCT unnest(tags) AS tags FROM document")
def facet_tags(lib, *_):
    return catalogue.facet(lib.document, "tags")


@query("SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['new', 'furniture'])), lambda t: t <> 'building')), ',') AS tags FROM document")
def tag_change(lib, *_):
    return catalogue.tag_change(lib.document, ["new", "furniture"], ["building"]).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("formula", "figure", "table", "code")) + " FROM item WHERE kind <> 'chunk' GROUP BY 1")
def contents_counts(lib, *_):
    return catalogue.contents_counts(lib)


@query("""SELECT i.item_id, c.item_id AS "by", CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS excerpt FROM item i JOIN (SELECT item_id, doc_id, unnest(cites) AS label, trim('Item ' || item_id || ' ' || repeat('says so ', CAST(item_id % 50 AS INTEGER))) AS t FROM item) c ON i.doc_id = c.doc_id AND i.label = c.label""")
def cited_by(lib, spark, sf_dir):
    told = F.concat(F.lit(" Item\n"), F.col("item_id").cast("string"), F.lit("  "), F.repeat(F.lit("says so "), (F.col("item_id") % 50).cast("int")))
    return catalogue.cited_by(lib, lib.item.select("item_id", told.alias("text")))


@query("SELECT item_id, lead(item_id) OVER (PARTITION BY doc_id ORDER BY position) AS next_id FROM item")
def next_items(lib, *_):
    return changes.in_order(lib.item)


@query("SELECT item_id, concept_id FROM mention WHERE item_id NOT IN (SELECT item_id FROM item WHERE doc_id = 7)")
def delete_document(lib, *_):
    return changes.without_mentions_of(lib.mention, lib.item, 7)


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new ' || title ELSE title END AS title FROM document UNION ALL SELECT -1, 'added'")
def upsert_documents(lib, spark, *_):
    old = lib.document.select("doc_id", "title")
    new = old.where("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("new "), "title").alias("title"))
    return changes.upsert(old, new.union(spark.createDataFrame([(-1, "added")], "doc_id long, title string")), "doc_id")


# Usage and jobs, from the events.
USAGE = "WITH u AS (SELECT event_type AS model, CAST(floor(value) AS BIGINT) AS input, CAST(event_id % 100 AS BIGINT) AS output, event_id % 7 AS cache_read, event_id % 3 AS cache_write, event_id % 2 = 0 AS estimated, CASE WHEN event_id % 5 = 0 THEN 0.25 END AS reported FROM events), t AS (SELECT model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, sum(reported)::DOUBLE AS reported, bool_or(estimated) AS estimated FROM u GROUP BY 1)\n"


def tallied(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-20250101[1m]")).alias("model"), F.floor("value").alias("input"), (F.col("event_id") % 100).alias("output"), (F.col("event_id") % 7).alias("cache_read"), (F.col("event_id") % 3).alias("cache_write"), F.when(F.col("event_id") % 5 == 0, 0.25).alias("reported"), (F.col("event_id") % 2 == 0).alias("estimated"))
    return catalogue.usage_tally(own)


@query(USAGE + "SELECT * FROM t", model=False)
def usage_tally(spark, sf_dir):
    return tallied(spark, sf_dir)


@query(USAGE + "SELECT count(*) AS models, round(sum((input * 3.0 + output * 15.0 + cache_read * 0.3 + cache_write * 3.75) / 1e6), 6)::DOUBLE AS usd FROM t", model=False)
def usage_cost(spark, sf_dir):
    t = tallied(spark, sf_dir)
    return catalogue.usage_cost(t, t.select("model", F.lit(3.0).alias("in_price"), F.lit(15.0).alias("out_price"), F.lit(0.3).alias("read_price"), F.lit(3.75).alias("write_price")))


JOBS = "WITH e AS (SELECT event_id, user_id AS job_id, event_type AS stage, round(value / (SELECT max(value) FROM events), 6) AS share, ts FROM events), w AS (SELECT stage, CAST(row_number() OVER (ORDER BY stage) AS INTEGER) AS place, 20 AS weight FROM (SELECT DISTINCT stage FROM e)), p AS (SELECT event_id, job_id, round(((place - 1) * 20 + 20 * share) / 100, 3) AS overall FROM e JOIN w USING (stage))\n"


def job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("value").alias("top"))  # one row
    return e.crossJoin(F.broadcast(top)).select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.round(F.col("value") / F.col("top"), 6).alias("share"), "ts")


def progressed(spark, sf_dir):
    e = job_events(spark, sf_dir)
    stages = e.select("stage").distinct().withColumn("place", F.row_number().over(Window.orderBy("stage"))).withColumn("weight", F.lit(20))
    return catalogue.progress(e, stages)


@query(JOBS + "SELECT * FROM p", model=False)
def job_progress(spark, sf_dir):
    return progressed(spark, sf_dir)


@query(JOBS + "SELECT event_id, job_id, overall FROM (SELECT *, max(overall) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) WHERE best IS NULL OR overall > best", model=False)
def progress_updates(spark, sf_dir):
    return catalogue.increases(progressed(spark, sf_dir))


@query(JOBS + "SELECT job_id, event_id, stage, share FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 100", model=False)
def latest_jobs(spark, sf_dir):
    return catalogue.latest_jobs(job_events(spark, sf_dir)).drop("ts")


def sections(lib):
    return lib.document.select(F.col("doc_id").alias("section"), (F.col("doc_id") % 10 == 0).alias("heldout"))


def seeds(lib, m=None):
    """The relations that texts of training sections are made on: those that an item of a training section states."""
    m = mentioned(lib) if m is None else m
    training = sections(lib).where(~F.col("heldout")).select("section")
    own = lib.item.join(training, F.col("doc_id") == F.col("section")).select("item_id")
    counts = m.groupBy("concept_id").agg(F.sum("n").alias("count"))
    return dataset.relation_seeds(lib.relation.join(own, "item_id", "left_semi"), m.join(training, "section", "left_semi"), counts)


def section_passages(spark, sf_dir):
    return passages.passages(docs(spark, sf_dir).select(F.col("doc_id").alias("section"), "text"))


def planned(lib, spark, sf_dir):
    return dataset.section_plan(factors(lib), seeds(lib), section_passages(spark, sf_dir))


# Texts.
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


FIRST = "regexp_replace(text, '\\n.*', '', 's')"
#: What follows the first blank line, or the whole text without one.
BODY = "CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END"


@query(f"SELECT doc_id, trim(regexp_replace(lower({FIRST}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents", model=False)
def normalised_name(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.normalised(F.regexp_replace("text", r"(?s)\n.*", "")).alias("name"), text.estimated_tokens("text").alias("tokens"))


@query("SELECT doc_id, replace(trim(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ', '-') AS slug FROM documents", model=False)
def slug(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.slug("source").alias("slug"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS prefix, sha256(text) AS sha FROM documents", model=False)
def id_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("prefix"), F.sha2("text", 256).alias("sha"))


@query(model=False)
def item_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("doc_id").cast("string")).alias("uuid"))


@query(f"WITH b AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({BODY})) AS first FROM documents) SELECT doc_id, CASE WHEN first < doc_id THEN first END AS duplicate_of FROM b", model=False)
def exact_dedup(spark, sf_dir):
    return dataset.duplicates(docs(spark, sf_dir))


@query("SELECT source AS section, CASE WHEN bool_or(quality IS NULL) THEN NULL ELSE min(quality) END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1", model=False)
def page_score(spark, sf_dir):
    both = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return dataset.page_scores(both.select(F.col("source").alias("section"), F.col("quality").alias("score")))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
    c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT d.doc_id AS id, e.doc_id AS other FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1),
    s AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
    o AS (SELECT p.id, sum(least(a.n, b.n)) AS n FROM p JOIN c a ON a.doc_id = p.id JOIN c b ON b.doc_id = p.other AND a.w = b.w GROUP BY 1)
    SELECT p.id, CASE WHEN a.n IS NULL AND b.n IS NULL THEN 1.0::DOUBLE WHEN a.n IS NULL THEN 0.0 ELSE round(coalesce(o.n, 0)::DOUBLE / a.n, 3) END AS a_in_b, CASE WHEN a.n IS NULL AND b.n IS NULL THEN 1.0::DOUBLE WHEN b.n IS NULL THEN 0.0 ELSE round(coalesce(o.n, 0)::DOUBLE / b.n, 3) END AS b_in_a
    FROM p LEFT JOIN o ON p.id = o.id LEFT JOIN s a ON a.doc_id = p.id LEFT JOIN s b ON b.doc_id = p.other""", model=False)
def word_match(spark, sf_dir):
    ids = docs(spark, sf_dir).select("doc_id")
    pairs = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return dataset.word_match(docs(spark, sf_dir).select("doc_id", "text"), pairs)


@query(model=False)
def pack_chunks(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", dataset.packed_paragraphs(F.split("text", "\n")).alias("chunks"))
    return own.select("doc_id", F.size("chunks").alias("paragraphs"), (F.array_max("chunks") + 1).alias("chunks"))


@query("SELECT conv_id AS doc_id, turn AS position, substr(text, 1, CAST(400 - start AS BIGINT)) AS text FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS start FROM conversations) WHERE start < 400", model=False)
def char_budget(spark, sf_dir):
    return catalogue.within_budget(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), "text"), 400)


# Plans: sections are documents, and every tenth is held out.
RARITY = PLACES + """, m AS (SELECT doc_id AS section, concept_id, count(*) AS n FROM place GROUP BY ALL),
    c AS (SELECT concept_id, sum(n) AS total FROM m GROUP BY 1),
    pairs AS (SELECT section, m.concept_id, total FROM m JOIN c USING (concept_id) WHERE section % 10 <> 0),
    f AS (SELECT section, median((SELECT median(total) FROM pairs) / greatest(total, 1)::DOUBLE) AS f FROM pairs GROUP BY 1),
    factors AS (SELECT doc_id AS section, doc_id % 10 = 0 AS heldout, coalesce(greatest(0.5, least(3.0, f)), 1.0)::DOUBLE AS factor FROM document LEFT JOIN f ON doc_id = section),
    seeded AS (SELECT a.section, from_id, to_id, type, row_number() OVER (PARTITION BY a.section ORDER BY least(ca.total, cb.total), from_id, to_id, type) AS place FROM relation r JOIN item i ON r.item_id = i.item_id AND i.doc_id % 10 <> 0
        JOIN m a ON a.concept_id = from_id JOIN m b ON b.concept_id = to_id AND a.section = b.section JOIN c ca ON ca.concept_id = from_id JOIN c cb ON cb.concept_id = to_id WHERE a.section % 10 <> 0),
    told AS (SELECT section, count(*) AS n FROM seeded GROUP BY 1),
    -- A section is read in one passage unless its text has a blank line, and no text of the tables has one.
    plan AS (SELECT f.section, heldout, factor, CAST(1 AS BIGINT) AS passages, CASE WHEN heldout THEN 0 ELSE CAST(round(3 * factor) AS BIGINT) END AS k, coalesce(n, 0) AS told, CASE WHEN heldout THEN 2 ELSE CAST(round(2 * factor) AS BIGINT) END AS questions,
        coalesce(contains(chr(10) || text || chr(10), chr(10) || '$$' || chr(10)), false) AND CAST('0x' || substr(sha256(CAST(f.section AS VARCHAR)), 1, 16) AS UBIGINT) % 20 = 0 AS picked FROM factors f LEFT JOIN told t ON f.section = t.section LEFT JOIN documents d ON d.doc_id = f.section),
    planned AS (SELECT section, heldout, round(factor, 9) AS factor, passages, (k + 2) // 3 AS rephrase_wiki, (k + 1) // 3 AS rephrase_lecture, k // 3 AS rephrase_qa, least(k, told) AS entigraph, CAST(CASE WHEN NOT heldout AND picked THEN 1 ELSE 0 END AS BIGINT) AS notation_variant, CAST(CASE WHEN NOT heldout AND factor >= 1 THEN 1 ELSE 0 END AS BIGINT) AS exercise, questions FROM plan)
"""
PLANNED = ("rephrase_wiki", "rephrase_lecture", "rephrase_qa", "entigraph", "notation_variant", "exercise")
RANKED = "ORDER BY factor DESC, substr(sha256(CAST(section AS VARCHAR)), 1, 16), section"


def mentioned(lib):
    return graph.located(lib).groupBy(F.col("doc_id").alias("section"), "concept_id").agg(F.count("*").alias("n"))


def factors(lib, m=None):
    return dataset.rarity(mentioned(lib) if m is None else m, sections(lib))


@query(RARITY + "SELECT section, heldout, round(factor, 9) AS factor FROM factors")
def rarity_factor(lib, *_):
    return factors(lib).withColumn("factor", F.round("factor", 9))


@query(RARITY + "SELECT * FROM planned")
def section_plan(lib, spark, sf_dir):
    return planned(lib, spark, sf_dir).withColumn("factor", F.round("factor", 9))


@query(RARITY + f"SELECT section, greatest(0, least(questions, 500 - (sum(questions) OVER ({RANKED}) - questions)))::BIGINT AS questions FROM planned")
def cap_questions(lib, spark, sf_dir):
    return dataset.capped_questions(planned(lib, spark, sf_dir).select("section", F.round("factor", 9).alias("factor"), "questions"), 500)


CAPPED_TEXTS = RARITY + f""", asked AS (SELECT *, {' + '.join(PLANNED)} AS n FROM planned WHERE NOT heldout), room AS (SELECT *, greatest(0, 2000 - (sum(n) OVER ({RANKED}) - n)) AS room FROM asked),
    a AS (SELECT *, least(rephrase_wiki + rephrase_lecture + rephrase_qa, room) AS k FROM room), b AS (SELECT *, least(entigraph, room - k) AS e FROM a), d AS (SELECT *, least(exercise, room - k - e) AS x FROM b),
    kept AS (SELECT section, (k + 2) // 3 AS rephrase_wiki, (k + 1) // 3 AS rephrase_lecture, k // 3 AS rephrase_qa, e AS entigraph, x AS exercise, least(notation_variant, room - k - e - x) AS notation_variant FROM d)
    SELECT section, unnest({list(PLANNED)}) AS kind, CAST(unnest([{', '.join(PLANNED)}]) AS BIGINT) AS n FROM kept"""


@query(CAPPED_TEXTS)
def cap_texts(lib, spark, sf_dir):
    return caps.keep_texts(planned(lib, spark, sf_dir), 2000)


@query(RARITY + "SELECT " + ", ".join(f"sum({k})::BIGINT AS {k}" for k in (*PLANNED, "questions")) + f", sum(2 * ({' + '.join(PLANNED)}) + 6 * questions)::BIGINT AS model_calls FROM planned")
def plan_totals(lib, spark, sf_dir):
    return dataset.plan_totals(planned(lib, spark, sf_dir))


@query(RARITY + """, long AS (SELECT section, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['rephrase_wiki', 'rephrase_lecture', 'rephrase_qa', 'notation_variant', 'exercise']) AS kind, unnest([rephrase_wiki, rephrase_lecture, rephrase_qa, notation_variant, exercise]) AS n FROM planned),
    each AS (SELECT section, pos, kind, CAST(1 AS BIGINT) AS passage, unnest(range(1, n + 1)) AS version, NULL AS place, NULL AS from_id, NULL AS to_id, NULL AS type FROM long UNION ALL
        SELECT s.section, 5, 'entigraph', 1, 1, place, from_id, to_id, type FROM seeded s JOIN planned p ON s.section = p.section WHERE place <= entigraph)
    SELECT section, kind, passage, version, coalesce(place, version) AS number, section || ':' || kind || ':' || coalesce(place, version) AS id, from_id, to_id, type, CAST(row_number() OVER (PARTITION BY section ORDER BY pos, coalesce(place, version)) AS INTEGER) AS draft FROM each""")
def draft_ids(lib, spark, sf_dir):
    # What several steps read is made once.
    m = lineage.written(mentioned(lib))
    told, read = lineage.written(seeds(lib, m)), lineage.written(section_passages(spark, sf_dir))
    placed = dataset.relation_passages(told, lib.concept.select("concept_id", "name"), read)
    return dataset.drafts(lineage.written(dataset.section_plan(factors(lib, m), told, read)), placed)


@query(RARITY + """SELECT a.section, from_id, to_id, type, CAST(row_number() OVER (PARTITION BY a.section ORDER BY least(ca.total, cb.total), from_id, to_id, type) AS INTEGER) AS place
    FROM relation r JOIN m a ON a.concept_id = from_id JOIN m b ON b.concept_id = to_id AND a.section = b.section JOIN c ca ON ca.concept_id = from_id JOIN c cb ON cb.concept_id = to_id""")
def relation_seeds(lib, *_):
    m = mentioned(lib)
    return dataset.relation_seeds(lib.relation, m, m.groupBy("concept_id").agg(F.sum("n").alias("count")))


TRIES = """WITH t AS (SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY v, part) AS INTEGER) AS try, v, size FROM (SELECT l_orderkey AS question, l_partkey AS part, l_quantity AS v, CAST(floor(min(l_extendedprice)) AS BIGINT) % 997 AS size FROM lineitem GROUP BY ALL)),
    a AS (SELECT x.question, x.try, count(*) AS votes, min(ROW(y.size, y.try))[2] AS kept FROM t x JOIN t y ON x.question = y.question AND abs(x.v - y.v) <= 1e-3 * greatest(abs(x.v), abs(y.v)) GROUP BY ALL),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question ORDER BY votes DESC, try) = 1)
    SELECT b.question, b.kept AS kept_try, b.votes FROM b JOIN (SELECT question, count(*) AS n FROM t GROUP BY 1) USING (question) WHERE votes * 2 > n"""


@query(TRIES, model=False)
def agreement(spark, sf_dir):
    """A question for each order, a try for each of its parts and quantities; how long a try is, its price tells."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("v")).agg(F.min("l_extendedprice").alias("price"))
    turn = F.row_number().over(Window.partitionBy("question").orderBy("v", "part"))
    return dataset.agreement(rows.select("question", turn.alias("try"), F.col("v").cast("long").cast("string").alias("value"), (F.floor("price").cast("long") % 997).alias("length")))


@query("WITH s AS (SELECT CAST(doc_id % 4 + 1 AS INTEGER) AS score FROM labels) SELECT x AS score, count(s.score) AS n FROM (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS x) LEFT JOIN s ON x = s.score GROUP BY 1", model=False)
def judge_histogram(spark, sf_dir):
    return dataset.histogram(table(spark, sf_dir, "labels").select((F.col("doc_id") % 4 + 1).cast("int").alias("score")))


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN length(text) % 5 = 0 THEN NULL WHEN length(text) % 7 = 0 THEN turn + 3 ELSE turn + 10 END AS printed FROM conversations),
    n AS (SELECT *, lag(printed) OVER w + page - lag(page) OVER w AS expected FROM p WHERE printed IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY page)) SELECT * FROM n WHERE printed <> expected""", model=False)
def out_of_sequence(spark, sf_dir):
    size = F.length("text")
    printed = F.when(size % 5 == 0, None).when(size % 7 == 0, F.col("turn") + 3).otherwise(F.col("turn") + 10)
    return dataset.out_of_sequence(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), printed.alias("printed")))


from quire import registry_checks, registry_pieces, registry_reading, registry_replies, registry_search  # noqa: E402,F401  add their queries
