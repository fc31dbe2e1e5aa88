"""Queries over models' replies, states and records, made from the driver's tables, and the SQL that gives the same rows.

Where an expression means the same in Spark and DuckDB, both use the same text for their inputs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import catalogue, replies, retrieval, states
from quire.registry import query
from quire.sources import table

# Replies of a model as JSON texts: good, broken, without a part, with an unknown relation.
REPLY = """CASE event_id % 5 WHEN 0 THEN '{"concepts":[{"name":" N","definition":"d"}],"relations":[{"from":"a","type":"ASSUMES","to":"b"}]}'
    WHEN 1 THEN '{"concepts":[' WHEN 2 THEN '{"concepts":[],"relations":[{"from":"a","type":"LIKES","to":"b"}]}' WHEN 3 THEN '{"concepts":[{"name":"x","definition":"y"}]}' ELSE '{"concepts":[{"name":"x"}],"relations":[]}' END"""


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 2 THEN 'relation type' ELSE 'shape' END AS fault FROM events", model=False)
def extraction_faults(spark, sf_dir):
    own = table(spark, sf_dir, "events").selectExpr("event_id", f"{REPLY} AS reply")
    return own.select("event_id", replies.extraction_fault("reply").alias("fault"))


# Names in replies: the parts of an order by line; one in nine has no letter.
NAMED = """SELECT l_orderkey AS item_id, l_partkey AS place, CASE WHEN l_partkey % 9 = 0 THEN '***' WHEN l_partkey % 2 = 0 THEN ' ' || upper(p_name) || '!' ELSE p_name END AS name, l_partkey % 50 AS concept_id
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
KEY = "trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


def named_rows(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return spark.sql(NAMED, lineitem=line, part=part).distinct()


MENTIONS = f"""WITH named AS (SELECT DISTINCT * FROM ({NAMED.format(lineitem="lineitem", part="part")})),
    k AS (SELECT *, {KEY} AS key FROM named WHERE {KEY} <> ''),
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY place, name, concept_id) = 1)
"""


@query(MENTIONS + "SELECT item_id, concept_id, name AS wording FROM f QUALIFY row_number() OVER (PARTITION BY item_id, concept_id ORDER BY place) = 1", model=False)
def reply_mentions(spark, sf_dir):
    return replies.reply_mentions(named_rows(spark, sf_dir))


TOLD = """WITH named AS (SELECT l_orderkey AS item_id, min(l_linenumber) AS place, p_name AS name, min(l_partkey % 50) AS concept_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN ('red widget', 'small ring') GROUP BY ALL),
    own AS (SELECT item_id, name AS key, concept_id FROM named), stored AS (SELECT * FROM (VALUES ('red widget', 1000), ('blue gear', 1001)) AS s(key, kept)),
    told AS (SELECT o_orderkey AS item_id, (['red widget', 'small ring', 'blue gear', 'nothing'])[o_orderkey % 4 + 1] AS f, (['red widget', 'small ring', 'blue gear', 'nothing'])[o_custkey % 4 + 1] AS t FROM orders),
    ends AS (SELECT told.item_id, coalesce(a.concept_id, sa.kept) AS from_id, coalesce(b.concept_id, sb.kept) AS to_id FROM told LEFT JOIN own a ON a.item_id = told.item_id AND a.key = f LEFT JOIN stored sa ON sa.key = f LEFT JOIN own b ON b.item_id = told.item_id AND b.key = t LEFT JOIN stored sb ON sb.key = t)
"""


def told_relations(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where(F.col("p_name").isin("red widget", "small ring"))
    named = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("item_id"), F.col("p_name").alias("name")).agg(F.min("l_linenumber").alias("place"), F.min(F.col("l_partkey") % 50).alias("concept_id"))
    names = F.array(*map(F.lit, ("Red widget", " small  ring", "blue-gear", "nothing")))
    end = lambda c: F.element_at(names, (F.col(c) % 4 + 1).cast("int"))
    told = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), end("o_orderkey").alias("from"), end("o_custkey").alias("to"), F.lit("PART_OF").alias("type"))
    stored = spark.createDataFrame([("red widget", 1000), ("blue gear", 1001)], "key string, concept_id long")
    return replies.reply_relations(told, named, stored)


@query(TOLD + "SELECT DISTINCT item_id, from_id, to_id, 'PART_OF' AS type FROM ends WHERE from_id <> to_id", model=False)
def reply_relations(spark, sf_dir):
    return told_relations(spark, sf_dir)[0]


@query(TOLD + "SELECT item_id, count(*) FILTER (from_id IS NULL OR to_id IS NULL OR from_id = to_id) AS dropped FROM ends GROUP BY 1", model=False)
def dropped_relations(spark, sf_dir):
    return told_relations(spark, sf_dir)[1]


@query("SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([event_id % 7, 3, event_id % 5, 3, 9], lambda p: p <= 4))), ',') AS pages FROM events", model=False)
def insight_pages(spark, sf_dir):
    e = F.col("event_id")
    pages, shown = F.array(e % 7, F.lit(3), e % 5, F.lit(3), F.lit(9)).cast("array<long>"), F.sequence(F.lit(0), F.lit(4)).cast("array<long>")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(replies.insight_pages(pages, shown), ",").alias("pages"))


TITLES = """CASE event_id % 12 WHEN 0 THEN 'A plain title' WHEN 1 THEN '  ' WHEN 2 THEN ' led by a space' WHEN 3 THEN repeat('x', 81) WHEN 4 THEN 'two' || chr(10) || 'lines' WHEN 5 THEN 'a' || chr(7) || 'b' WHEN 6 THEN 'some `code`'
    WHEN 7 THEN '# heading' WHEN 8 THEN 'an *emphasised* word' WHEN 9 THEN 'two * three * four' WHEN 10 THEN '2*3*4' ELSE '#tag and a_b_c' END"""


@query(f"SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'empty' WHEN 2 THEN 'whitespace' WHEN 3 THEN 'length' WHEN 4 THEN 'break' WHEN 5 THEN 'control' WHEN 6 THEN 'formatting' WHEN 7 THEN 'formatting' WHEN 8 THEN 'formatting' END AS fault, length({TITLES}) AS n FROM events", model=False)
def artifact_text_faults(spark, sf_dir):
    own = table(spark, sf_dir, "events").selectExpr("event_id", f"{TITLES} AS title")
    return own.select("event_id", replies.text_fault("title", 80).alias("fault"), F.length("title").cast("long").alias("n"))


# A reply for each order: its lines are the texts, and parts of the customer's number were asked for.
ARTIFACTS = """WITH text AS (SELECT l_orderkey AS reply, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_partkey % 5 AS id, CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE 'title' END AS title FROM lineitem),
    target AS (SELECT o_orderkey AS reply, unnest(range(0, 1 + o_custkey % 4)) AS id FROM orders),
    judged AS (SELECT t.reply, t.place, t.id, CASE WHEN g.id IS NULL THEN 'unknown' WHEN t.place > min(t.place) OVER (PARTITION BY t.reply, t.id) THEN 'duplicate' WHEN trim(title) = '' THEN 'text' END AS fault FROM text t LEFT JOIN target g ON t.reply = g.reply AND t.id = g.id),
    bad AS (SELECT * FROM judged WHERE fault IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reply ORDER BY place) = 1),
    gone AS (SELECT reply, min(id) AS id FROM target g WHERE NOT EXISTS (SELECT 1 FROM text t WHERE t.reply = g.reply AND t.id = g.id) GROUP BY 1)
    SELECT r.reply, coalesce(b.fault, CASE WHEN g.id IS NOT NULL THEN 'missing' END) AS fault, coalesce(b.id, g.id) AS id FROM (SELECT DISTINCT reply FROM target UNION SELECT DISTINCT reply FROM text) r LEFT JOIN bad b ON r.reply = b.reply LEFT JOIN gone g ON r.reply = g.reply"""


@query(ARTIFACTS, model=False)
def artifact_reply_faults(spark, sf_dir):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    texts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reply"), F.row_number().over(by).alias("place"), (F.col("l_partkey") % 5).alias("id"), F.when(F.col("l_suppkey") % 10 == 0, " ").otherwise("title").alias("title"), F.lit("what it shows").alias("description"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reply"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 4)).alias("id"))
    return replies.artifact_faults(texts, targets)


TABLES = """CASE event_id % 6 WHEN 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' WHEN 1 THEN '| a |' WHEN 2 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '1 | 2 |'
    WHEN 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 |' WHEN 4 THEN '| a |' || chr(10) || '| b |' ELSE '| a |' || chr(10) || '|   |' || chr(10) END"""


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'lines' WHEN 2 THEN 'frame' WHEN 3 THEN 'cells' WHEN 4 THEN 'separator' WHEN 5 THEN 'separator' END AS fault FROM events", model=False)
def table_faults(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{TABLES} AS t").select("event_id", replies.table_fault("t").alias("fault"))


CHECKS = "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'inline' WHEN 2 THEN 'both' ELSE 'no-answer' END"


@query(f"""WITH p AS (SELECT event_id, event_id % 3 = 0 AS m, event_id % 5 = 0 AS f, event_id % 7 = 0 AS t, {CHECKS} AS c, event_id % 30 AS w FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN m THEN 'tags-report-math' END, CASE WHEN f THEN 'tags-report-figure' END, CASE WHEN t THEN 'tags-report-table' END, CASE WHEN c IN ('inline', 'both') THEN 'math-check-reports-math' END, CASE WHEN c = 'no-answer' THEN 'math-check-failed' END, CASE WHEN w < 20 THEN 'text-layer-almost-empty' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""", model=False)
def route_reasons(spark, sf_dir):
    e = F.col("event_id")
    reasons = replies.route_reasons(e % 3 == 0, e % 5 == 0, e % 7 == 0, F.expr(CHECKS), e % 30)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(reasons, ",").alias("reasons"))


SCORES = "SELECT event_id // 5 AS page_id, CASE WHEN event_id % 97 <> 0 THEN (event_id * 7 % 10) / 10.0 END AS formula, (event_id * 3 % 10) / 10.0 AS words FROM events"


@query(f"""WITH s AS ({SCORES}), e AS (SELECT page_id, bool_or(formula IS NULL) AS gone, coalesce(bool_or(formula > 0.3 AND words > 0.5), false) AS i, coalesce(bool_or(formula > 0.3 AND words <= 0.5), false) AS b FROM s GROUP BY 1)
    SELECT page_id, CASE WHEN gone THEN 'error' WHEN i AND b THEN 'both' WHEN i THEN 'inline' WHEN b THEN 'block' END AS placement FROM e""", model=False)
def math_placement(spark, sf_dir):
    e = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(F.floor(e / 5).alias("page_id"), F.when(e % 97 != 0, (e * 7 % 10) / 10).alias("formula"), (e * 3 % 10 / 10).alias("words"))
    return replies.math_placement(lines)


PAGES = "event_id // 20 AS doc_id, event_id % 20 AS page, CASE WHEN event_id % 3 = 0 THEN 'copy' ELSE 'transcribed' END AS route, (event_id % 10) / 10.0 AS piece_words, (event_id % 9) / 9.0 AS layer_words"


@query(f"""WITH p AS (SELECT {PAGES}, event_id AS e FROM events), r AS (SELECT doc_id, page, list_filter([CASE WHEN route <> 'copy' AND (piece_words < 0.6 OR layer_words < 0.6) THEN 'low word match' END, CASE WHEN e % 11 = 0 THEN 'displayed math without a formula' END, CASE WHEN e % 13 = 0 THEN 'figure is the whole page' END,
    CASE WHEN e % 17 = 0 AND e % 2 = 0 THEN 'figure is most of the page' END, CASE WHEN e % 19 = 0 THEN 'figure holds body text' END, CASE WHEN e % 23 = 0 THEN 'figure was not checked' END], lambda x: x IS NOT NULL) AS l FROM p) SELECT doc_id, page, array_to_string(l, ',') AS reasons FROM r WHERE len(l) > 0""", model=False)
def pages_to_check(spark, sf_dir):
    e = F.col("event_id")
    flags = {"lone_math": 11, "whole_page": 13, "most_of_page": 17, "has_text": 2, "body_text": 19, "unchecked": 23}
    pages = table(spark, sf_dir, "events").select(F.floor(e / 20).alias("doc_id"), (e % 20).alias("page"), F.when(e % 3 == 0, "copy").otherwise("transcribed").alias("route"), (e % 10 / 10).alias("piece_words"), (e % 9 / 9).alias("layer_words"), *((e % n == 0).alias(c) for c, n in flags.items()))
    return replies.pages_to_check(pages).select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT CAST(CASE WHEN event_id % 3 = 0 THEN 'copy' WHEN event_id % 3 = 1 THEN 'transcribed' ELSE 'copied then transcribed' END AS VARCHAR) AS route, count(*) AS pages FROM events GROUP BY 1", model=False)
def chapter_summary(spark, sf_dir):
    route = F.when(F.col("event_id") % 3 == 0, "copy").when(F.col("event_id") % 3 == 1, "transcribed").otherwise("copied then transcribed")
    return table(spark, sf_dir, "events").groupBy(route.alias("route")).agg(F.count("*").alias("pages"))


CLAIMS = "WITH c AS (SELECT event_id AS claim_id, CASE WHEN event_id % 6 = 0 THEN [] ELSE [event_id % 4 + 1, event_id % 7, event_id % 4 + 1] END AS sources FROM events)\n"


def claims(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("claim_id"), F.when(e % 6 == 0, F.array().cast("array<long>")).otherwise(F.array(e % 4 + 1, e % 7, e % 4 + 1)).alias("sources"))


@query(CLAIMS + ", s AS (SELECT claim_id, unnest(CASE WHEN len(sources) = 0 THEN [] WHEN sources[1] = sources[2] THEN [sources[1]] ELSE [sources[1], sources[2]] END) AS source, unnest(CASE WHEN len(sources) = 0 THEN [] WHEN sources[1] = sources[2] THEN [0] ELSE [0, 1] END) AS place FROM c) SELECT * FROM s", model=False)
def claim_sources(spark, sf_dir):
    return replies.claim_rows(claims(spark, sf_dir))


@query(CLAIMS + "SELECT claim_id, CASE WHEN len(sources) = 0 THEN 'no source' ELSE 'unknown source' END AS fault FROM c WHERE len(sources) = 0 OR len(list_filter(sources, lambda s: s < 1 OR s > 5)) > 0", model=False)
def bad_claims(spark, sf_dir):
    return retrieval.claim_faults(claims(spark, sf_dir), 5).where(F.col("fault").isNotNull()).select("claim_id", "fault")


# States: a document for each customer, its targets are its orders.
ASSESSED = """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 11 <> 0 AS has_folder, c_custkey % 3 <> 0 AS has_file, c_custkey % 3 = 1 AS current FROM customer),
    t AS (SELECT o_custkey AS doc_id, o_orderkey AS place, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderkey % 4 <> 0 OR o_custkey % 5 = 0 AS described FROM orders),
    o AS (SELECT t.doc_id, bytes, (row_number() OVER (PARTITION BY t.doc_id ORDER BY place) - 1) // 20 AS batch FROM t JOIN c ON t.doc_id = c.doc_id WHERE NOT (described AND current)),
    b AS (SELECT doc_id, max(s) AS largest, sum(n) AS pending FROM (SELECT doc_id, batch, sum(bytes) AS s, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1),
    a AS (SELECT c.doc_id, CASE WHEN NOT has_folder THEN 'no-folder' WHEN coalesce(largest, 0) > 1000000 THEN 'too-large' WHEN coalesce(pending, 0) = 0 THEN 'ready' WHEN current THEN 'partial' WHEN has_file THEN 'stale' ELSE 'missing' END AS state,
        coalesce(n.total, 0) - coalesce(pending, 0) AS done, coalesce(n.total, 0) AS total FROM c LEFT JOIN b ON c.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, count(*) AS total FROM t GROUP BY 1) n ON c.doc_id = n.doc_id)
"""


def assessed(spark, sf_dir):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    chapters = table(spark, sf_dir, "customer").select(c.alias("doc_id"), (c % 11 != 0).alias("has_folder"), (c % 3 != 0).alias("has_file"), (c % 3 == 1).alias("current"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), o.alias("place"), F.floor("o_totalprice").alias("bytes"), ((o % 4 != 0) | (F.col("o_custkey") % 5 == 0)).alias("described"))
    return states.artifact_state(chapters, targets)


@query(ASSESSED + "SELECT doc_id, state, CAST(done AS BIGINT) AS done, total FROM a", model=False)
def artifact_state(spark, sf_dir):
    return assessed(spark, sf_dir)


@query(ASSESSED + """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND state <> 'ready' THEN 'ingested without metadata' WHEN doc_id % 2 = 0 AND doc_id % 10 = 0 THEN 'ingested without insights' WHEN doc_id % 2 = 0 THEN 'ingested'
    WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN 'other source' WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 THEN 'converted' WHEN doc_id % 11 <> 0 THEN 'partly converted' ELSE 'new' END AS state FROM a""", model=False)
def document_state(spark, sf_dir):
    d = F.col("doc_id")
    state = states.document_state(d % 2 == 0, F.col("state") == "ready", d % 10 == 0, d % 7 == 0, d % 11 != 0, d % 5 == 0)
    return assessed(spark, sf_dir).select("doc_id", state.alias("state"))


@query("SELECT doc_id, title, CASE WHEN category = 'book' AND doc_id % 4 = 0 THEN 'book part' WHEN doc_id % 11 = 0 THEN 'no chapter' WHEN doc_id % 5 = 0 THEN 'already saved' ELSE 'write' END AS need FROM document WHERE media IS NOT NULL")
def insights_need(lib, *_):
    d = F.col("doc_id")
    need = states.insights_need((F.col("category") == "book") & (d % 4 == 0), d % 11 != 0, d % 5 == 0)
    return lib.document.where(F.col("media").isNotNull()).select("doc_id", "title", need.alias("need")).orderBy("title", "doc_id")


@query("SELECT doc_id, ceil(round(doc_id * 0.0137 * 1e6) / 10000) / 100 AS usd, CAST(ceil((doc_id % 90) * 28 / 60.0) AS BIGINT) AS minutes FROM documents", model=False)
def ingest_estimate(spark, sf_dir):
    usd, minutes = catalogue.estimate(F.col("doc_id") % 90, F.col("doc_id") * 0.0137)
    return table(spark, sf_dir, "documents").select("doc_id", usd.cast("double").alias("usd"), minutes.cast("long").alias("minutes"))


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN CASE WHEN t > 0 THEN (b + 0.15 * greatest(d - b, 0)) / t END WHEN 'view' THEN CASE WHEN t > 0 THEN (d + 0.15 * greatest(t - d, 0)) / t END WHEN 'purchase' THEN CASE WHEN t > 0 THEN d::DOUBLE / t END END, 9) AS share FROM (SELECT *, event_id % 10 AS d, event_id % 3 AS b, (event_id // 10) % 12 AS t FROM events)", model=False)
def stage_share(spark, sf_dir):
    e = F.col("event_id")
    stage = F.when(F.col("event_type") == "click", "preparing pages").when(F.col("event_type") == "view", "converting").when(F.col("event_type") == "purchase", "reading concepts").otherwise("storing")
    return table(spark, sf_dir, "events").select("event_id", F.round(states.stage_share(stage, e % 10, e % 3, F.floor(e / 10) % 12), 9).alias("share"))


@query("SELECT rule, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'exact' WHEN value % 10 > 5 THEN 'link' ELSE 'create' END AS rule FROM events) GROUP BY 1", model=False)
def decisions_by_rule(spark, sf_dir):
    rule = F.when(F.col("event_id") % 4 == 0, "exact").when(F.col("value") % 10 > 5, "link").otherwise("create")
    return catalogue.decisions_by_rule(table(spark, sf_dir, "events").select(rule.alias("rule")))


# Records of a training set.
JUDGED = "SELECT event_id AS id, event_id % 3 <> 0 AS faithful, event_id % 5 = 0 AS claimed, event_id % 6 AS score FROM events"


@query(f"SELECT id, faithful AND NOT claimed AND score BETWEEN 3 AND 5 AS text_kept, faithful AND NOT claimed AND score >= 4 AS answer_kept FROM ({JUDGED})", model=False)
def judge_kept(spark, sf_dir):
    e = F.col("event_id")
    found = F.when(e % 5 == 0, F.array(F.lit("claim"))).otherwise(F.array().cast("array<string>"))
    kept = lambda answers: states.judge_kept(e % 3 != 0, found, e % 6, answers)
    return table(spark, sf_dir, "events").select(e.alias("id"), kept(False).alias("text_kept"), kept(True).alias("answer_kept"))


TASKS = "(['calculation', 'derivation', 'code-pot', 'explain', 'compare'])[CAST(event_id % 5 AS INTEGER) + 1]"


def asked(spark, sf_dir):
    e = F.col("event_id")
    task = F.element_at(F.array(*map(F.lit, ("calculation", "derivation", "code-pot", "explain", "compare"))), (e % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("section"), e.alias("number"), task.alias("task"), F.concat(F.lit("What is "), e.cast("string"), F.lit("?")).alias("question"), F.when(e % 7 != 0, F.concat(F.lit("It is "), e.cast("string"))).alias("answer"), (e % 14 / 10.0 - 0.1).alias("difficulty"), (F.col("user_id") % 10 == 0).alias("heldout"), F.when(e % 7 == 0, "no-answer").when(e % 8 == 0, "judge").alias("failure"))


@query(f"""SELECT user_id || '-' || lpad(CAST(event_id AS VARCHAR), 4, '0') AS id, CASE WHEN event_id % 7 = 0 OR event_id % 8 = 0 THEN 'rejected' WHEN user_id % 10 = 0 THEN 'heldout' ELSE 'train' END AS file, {TASKS} AS task, CASE WHEN event_id % 5 < 3 THEN 'think' ELSE 'direct' END AS reasoning,
    'user: What is ' || event_id || '?' || CASE WHEN event_id % 7 <> 0 THEN ' assistant: It is ' || event_id ELSE '' END AS messages, round(greatest(0, least(1, event_id % 14 / 10.0 - 0.1)), 6)::DOUBLE AS difficulty, CASE WHEN user_id % 10 = 0 THEN 'heldout' ELSE 'train' END AS split FROM events""", model=False)
def sft_records(spark, sf_dir):
    said = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), " ")
    return states.sft_records(asked(spark, sf_dir)).withColumns({"messages": said, "difficulty": F.round("difficulty", 6)})


@query(f"SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 'agreement-and-judge' WHEN event_id % 5 = 2 THEN 'python-exec' ELSE 'judge' END AS method FROM events", model=False)
def verification_method(spark, sf_dir):
    return asked(spark, sf_dir).select(F.col("number").alias("event_id"), states.method(F.col("task"), True).alias("method"))


@query("SELECT coalesce(CASE WHEN event_id % 7 = 0 THEN 'no-answer' WHEN event_id % 8 = 0 THEN 'judge' END, 'kept') AS reason, count(*) AS n FROM events GROUP BY 1", model=False)
def reason_counts(spark, sf_dir):
    return asked(spark, sf_dir).groupBy(F.coalesce("failure", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (doc_id % 10 <> 0) AS train, count(*) FILTER (doc_id % 10 = 0) AS heldout FROM document")
def split_counts(lib, *_):
    return states.split_counts(lib.document.select((F.col("doc_id") % 10 == 0).alias("heldout")))


@query("SELECT d.doc_id, title, count(item_id) AS sections, CAST(coalesce(sum(item_id % 100), 0) AS BIGINT) AS n_tokens FROM document d LEFT JOIN item i ON d.doc_id = i.doc_id AND kind = 'chunk' GROUP BY ALL")
def manifest_documents(lib, *_):
    return states.manifest_documents(lib.document, lib.item.where("kind = 'chunk'").select("doc_id", (F.col("item_id") % 100).alias("n_tokens")))


@query("WITH f AS (SELECT source AS path, sha256(CAST(count(*) AS VARCHAR)) AS sha FROM documents GROUP BY 1) SELECT sha256(string_agg(sha || '  ' || path || chr(10), '' ORDER BY path)) AS version FROM f", model=False)
def dataset_version(spark, sf_dir):
    files = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.sha2(F.count("*").cast("string"), 256).alias("sha256"))
    return states.dataset_version(files)
