"""Queries over blocks, section records, reads within budgets, cursors, batches of names and notices; and the SQL that
gives the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import questions, reading, rendering, resolving
from quire.operators.pieces import context_line, sections
from quire.registry import item_vectors, label_vectors, query
from quire.registry_pieces import ATTACHED, LEADS, PIECES, piece_rows
from quire.sources import table
from quire.streaming import jobs

NL = "chr(10)"
BLOCKS = LEADS + ATTACHED + f""", last AS (SELECT doc_id, page, max(number) AS number FROM piece WHERE kind NOT IN ('figure', 'table', 'footnote', 'code') GROUP BY ALL),
    opens AS (SELECT f.* FROM piece f WHERE kind = 'formula' AND NOT EXISTS (SELECT 1 FROM piece x WHERE x.doc_id = f.doc_id AND x.page = f.page AND x.number < f.number AND x.kind <> 'formula')),
    pair AS (SELECT l.doc_id, a.pos AS a, z.pos AS z FROM lead l JOIN piece a ON a.doc_id = l.doc_id AND a.page = l.page AND a.number = l."from" JOIN piece z ON z.doc_id = l.doc_id AND z.page = l.page AND z.number = l."to"
        UNION ALL SELECT t.doc_id, t.pos, f.pos FROM piece t JOIN last USING (doc_id, page, number) JOIN opens f ON f.doc_id = t.doc_id AND f.page = t.page + 1
        WHERE t.kind = 'text' AND (t.doc_id + t.page) % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lead l WHERE l.doc_id = f.doc_id AND l.page = f.page AND l."to" = f.number)),
    said AS (SELECT q.doc_id, q.pos AS slot, q.run, q.paragraph, text, (SELECT CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) FROM counted c WHERE c.doc_id = q.doc_id AND c.run = q.run AND c.paragraph = q.paragraph) AS transcribed FROM para q),
    other AS (SELECT p.doc_id, p.pos, coalesce(s.slot, p.pos) AS slot, CASE WHEN s.slot IS NOT NULL THEN row_number() OVER (PARTITION BY p.doc_id, s.slot ORDER BY p.pos) ELSE 0 END AS after, p.kind = 'footnote' AND s.slot IS NULL AS lone_note, p.kind, p.number,
            CASE p.kind WHEN 'heading' THEN repeat('#', p.rank) || ' ' || p.content WHEN 'formula' THEN '$$' || {NL} || p.content || {NL} || '$$' || {NL} || p.label WHEN 'table' THEN p.label || {NL} || p.content
                WHEN 'code' THEN coalesce(p.label || {NL}, '') || '```' || coalesce(p.language, '') || {NL} || p.content || {NL} || '```' WHEN 'figure' THEN '[Figure ' || p.label || ' — description (model-written): ' || p.content || ']'
                ELSE coalesce('[^' || p.marker || ']: ', 'Footnote: ') || p.content END AS text, CAST(ceil(length(p.content) / 4.0) AS BIGINT) AS tokens
        FROM piece p LEFT JOIN note n ON n.doc_id = p.doc_id AND n.pos = p.pos LEFT JOIN said s ON s.doc_id = n.doc_id AND s.run = n.run AND s.paragraph = n.paragraph WHERE p.kind <> 'text'),
    all_blocks AS (SELECT doc_id, CAST(NULL AS BIGINT) AS pos, slot, 0 AS after, false AS lone_note, text, transcribed, 0 AS model_written, CAST(NULL AS VARCHAR) AS image, run, paragraph FROM said
        UNION ALL SELECT doc_id, pos, slot, after, lone_note, text, CASE WHEN kind = 'figure' THEN 0 ELSE tokens END, CASE WHEN kind = 'figure' THEN tokens ELSE 0 END, CASE WHEN kind = 'figure' THEN 'f' || number END, NULL, NULL FROM other),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY slot, after) - 1 AS position FROM all_blocks),
    spot AS (SELECT doc_id, pos, position FROM numbered WHERE pos IS NOT NULL UNION ALL SELECT c.doc_id, c.pos, n.position FROM counted c JOIN numbered n ON n.doc_id = c.doc_id AND n.run = c.run AND n.paragraph = c.paragraph),
    span AS (SELECT p.doc_id, a.position AS a, z.position AS z FROM pair p JOIN spot a ON a.doc_id = p.doc_id AND a.pos = p.a JOIN spot z ON z.doc_id = p.doc_id AND z.pos = p.z),
    block AS (SELECT n.*, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, EXISTS (SELECT 1 FROM span s WHERE s.doc_id = n.doc_id AND s.a <= n.position AND n.position < s.z) AS with_next FROM numbered n)
"""


def pictured(spark, sf_dir):
    return piece_rows(spark, sf_dir).withColumn("image", F.when(F.col("kind") == "figure", F.concat(F.lit("f"), F.col("number").cast("string"))))


@query(PIECES + BLOCKS + "SELECT doc_id, CAST(position AS INTEGER) AS position, text, tokens, CAST(transcribed AS BIGINT) AS transcribed, CAST(model_written AS BIGINT) AS model_written, image, with_next, lone_note FROM block", model=False)
def rendered_blocks(spark, sf_dir):
    return rendering.blocks(pictured(spark, sf_dir)).select("doc_id", "position", "text", "tokens", "transcribed", "model_written", "image", "with_next", "lone_note")


def titles(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("m:"), F.col("c_custkey").cast("string")).alias("slug"), F.lower("c_mktsegment").alias("media"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("title"))


def flat(records):
    images = F.array_join(F.transform("images", lambda i: F.concat_ws("@", i["ref"], i["pos"].cast("string"))), ",")
    return records.select("doc_id", "id", F.array_join("section_path", " > ").alias("section_path"), F.array_join("pages", ",").alias("pages"), F.size("pieces").alias("n_pieces"), "markdown", images.alias("images"), "n_tokens", "transcribed", "model_written")


@query(PIECES + BLOCKS + f""", head AS (SELECT c_custkey AS doc_id, '# ' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' › ' || c_name END AS line FROM customer),
    placed AS (SELECT b.*, line, length(line) + 2 + coalesce(sum(length(text) + 2) OVER (PARTITION BY b.doc_id ORDER BY lone_note, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM block b JOIN head h ON h.doc_id = b.doc_id),
    page AS (SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT doc_id, page FROM piece) GROUP BY doc_id)
    SELECT p.doc_id, 'm:' || p.doc_id || ':s001' AS id, '' AS section_path, pages, CAST((SELECT count(*) FROM piece x WHERE x.doc_id = p.doc_id) AS INTEGER) AS n_pieces, line || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY lone_note, position) AS markdown,
        coalesce(string_agg(image || '@' || CAST(start AS BIGINT), ',' ORDER BY lone_note, position) FILTER (image IS NOT NULL), '') AS images, CAST(ceil((length(line) + sum(length(text) + 2)) / 4.0) AS BIGINT) AS n_tokens,
        CAST(sum(transcribed) AS BIGINT) AS transcribed, CAST(sum(model_written) AS BIGINT) AS model_written FROM placed p JOIN page g ON g.doc_id = p.doc_id GROUP BY p.doc_id, line, pages""", model=False)
def whole_section_records(spark, sf_dir):
    """Chapters short enough to be one section each."""
    return flat(rendering.section_records(pictured(spark, sf_dir), titles(spark, sf_dir), 10**9, 0))


@query(model=False)
def section_records(spark, sf_dir):
    """Chapters cut at headings into sections of 20 to 120 tokens; the fold of the cut isn't written in SQL."""
    return flat(rendering.section_records(pictured(spark, sf_dir), titles(spark, sf_dir), 120, 20))


@query(model=False)
def resolved_batch(spark, sf_dir):
    """All vectors as one batch of names, some of which repeat, match a stored name or an alias, or lie near one another;
    each depends on those before it, so there is no SQL. The vectors lie evenly, so near begins at low scores."""
    v = item_vectors(spark, sf_dir)
    stored = label_vectors(v).select("concept_id", F.concat(F.lit("Label "), F.col("concept_id").cast("string")).alias("name"), "vector")
    aliases = stored.select("concept_id", F.concat(F.lit("also "), F.col("concept_id").cast("string")).alias("alias"))
    turn, of = F.col("item_id") % 10, F.col("doc_id").cast("string")
    name = F.when(turn == 0, F.concat(F.lit("label-"), of)).when(turn == 1, F.concat(F.lit("Also  "), of)).otherwise(F.concat(F.lit("name "), F.floor(F.col("item_id") / 7).cast("string")))
    names = v.select(F.col("item_id").alias("name_id"), name.alias("name"), "vector")
    return resolving.resolve(names, stored, aliases, lambda n, c: F.when((n + F.length(c)) % 3 != 0, n % 2 == 0), 0.4, 0.3)


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id, CAST(abs(round(value)) % 1000 AS INTEGER) AS tenths, event_type AS message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    w AS (SELECT job_id, event_id, k, tenths AS sent, message AS shown, true AS told FROM e WHERE k = 1
        UNION ALL
        SELECT e.job_id, e.event_id, e.k, CASE WHEN e.tenths > sent THEN e.tenths WHEN e.tenths = sent AND e.message <> shown AND sent < 999 THEN sent + 1 ELSE sent END,
            CASE WHEN e.tenths > sent OR (e.tenths = sent AND e.message <> shown AND sent < 999) THEN e.message ELSE shown END, e.tenths > sent OR (e.tenths = sent AND e.message <> shown AND sent < 999)
        FROM w JOIN e ON e.job_id = w.job_id AND e.k = w.k + 1)
    SELECT job_id, event_id, sent AS tenths, shown AS message FROM w WHERE told""", model=False)
def progress_notices(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return jobs.notices_of(events.select(F.col("user_id").alias("job_id"), "event_id", (F.abs(F.round("value")) % 1000).cast("int").alias("tenths"), F.col("event_type").alias("message")))


@query("""WITH RECURSIVE u AS (SELECT conv_id AS read, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit, text, length(text) AS n, least(length(role) + 40, length(text)) AS head FROM conversations),
    s AS (SELECT *, sum(n) OVER (PARTITION BY read ORDER BY unit) AS upto FROM u),
    r AS (SELECT read, read // 5 AS call, row_number() OVER (PARTITION BY read // 5 ORDER BY read) AS k, CASE WHEN read % 3 = 0 THEN 150 END AS own, list(CAST(upto AS BIGINT) ORDER BY unit) AS ends, list(CAST(head AS BIGINT) ORDER BY unit) AS heads FROM s GROUP BY read),
    f AS (SELECT call, 0 AS k, CAST(1000 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS read, CAST(0 AS BIGINT) AS budget, CAST(0 AS BIGINT) AS used FROM r WHERE k = 1
        UNION ALL
        SELECT call, k, rest - used, read, budget, used FROM (
            SELECT *, CASE WHEN fits = len(ends) THEN whole WHEN budget > whole AND (whole = 0 OR budget - whole >= heads[fits + 1]) THEN budget ELSE whole END AS used FROM (
                SELECT *, len(list_filter(ends, lambda e: e <= budget)) AS fits, coalesce(list_max(list_filter(ends, lambda e: e <= budget)), 0) AS whole FROM (
                    SELECT f.call, r.k, f.rest, r.read, least(f.rest, coalesce(own, f.rest)) AS budget, ends, heads FROM f JOIN r ON r.call = f.call AND r.k = f.k + 1)))),
    t AS (SELECT f.call, f.read, f.k, f.budget, f.used, s.unit, substr(text, 1, CAST(greatest(0, least(n, f.used - (upto - n))) AS BIGINT)) AS piece, upto - n < f.used OR (n = 0 AND upto <= f.used) AS there FROM f JOIN s ON s.read = f.read)
    SELECT t.call, CAST(k AS INTEGER) AS number, t.read, used, used < (SELECT max(upto) FROM s WHERE s.read = t.read) AS truncated, coalesce(string_agg(piece, '|' ORDER BY unit) FILTER (there), '') AS text FROM t GROUP BY t.call, k, t.read, used""", model=False)
def shared_reads(spark, sf_dir):
    """The reads of five conversations share a thousand characters; who speaks and forty characters stay together."""
    talks = table(spark, sf_dir, "conversations")
    unit = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    units = talks.select(F.col("conv_id").alias("read"), unit.alias("unit"), "text", F.least(F.length("role") + 40, F.length("text")).alias("head"))
    reads = talks.select(F.col("conv_id").alias("read")).distinct().withColumn("call", F.floor(F.col("read") / 5))
    number = F.row_number().over(Window.partitionBy("call").orderBy("read"))
    requests = reads.select("call", number.alias("number"), "read", reading.scope("talk", F.col("read")).alias("scope"), F.when(F.col("read") % 3 == 0, 150).alias("chars"), F.lit(None).cast("string").alias("cursor"))
    got = reading.read_many(units, requests, 1000)
    return got.select("call", "number", "read", F.col("used").cast("long").alias("used"), "truncated", F.coalesce(F.array_join(F.transform("slices", lambda s: s["text"]), "|"), F.lit("")).alias("text"))


@query("""WITH c AS (SELECT doc_id, 'read:' || doc_id || ':' || substr(sha256(text), 1, 12) AS scope, doc_id % 7 AS unit, length(text) AS place FROM documents),
    t AS (SELECT *, rtrim(translate(to_base64(encode('v1.' || unit || '.' || place || '.' || scope)), '+/', '-_'), '=') AS cursor FROM c)
    SELECT t.doc_id, t.cursor, t.doc_id % 3 <> 0 AS own, CASE WHEN t.doc_id % 3 <> 0 THEN CAST(t.unit AS INTEGER) END AS unit, CASE WHEN t.doc_id % 3 <> 0 THEN CAST(t.place AS INTEGER) END AS "offset" FROM t""", model=False)
def read_cursors(spark, sf_dir):
    """Cursors of whole texts, taken up in their own scope or, for every third, in another one, which refuses them."""
    docs = table(spark, sf_dir, "documents")
    of = reading.scope("read", F.col("doc_id"), reading.fingerprint(F.col("text")))
    rows = docs.select("doc_id", of.alias("scope"), reading.cursor(F.col("doc_id") % 7, F.length("text"), of).alias("cursor"))
    at = reading.resumed(F.col("cursor"), F.when(F.col("doc_id") % 3 == 0, F.concat("scope", F.lit("x"))).otherwise(F.col("scope")))
    return rows.withColumn("at", at).select("doc_id", "cursor", F.col("at").isNotNull().alias("own"), "at.unit", "at.offset")


@query(PIECES + """, open AS (SELECT p.doc_id, p.pos, h.content, h.pos AS opos FROM piece p JOIN piece h ON p.doc_id = h.doc_id AND h.kind = 'heading' AND h.pos < p.pos
        WHERE NOT EXISTS (SELECT 1 FROM piece g WHERE g.doc_id = h.doc_id AND g.kind = 'heading' AND g.rank <= h.rank AND g.pos > h.pos AND g.pos <= p.pos)),
    path AS (SELECT doc_id, pos, string_agg(content, ' > ' ORDER BY opos) AS path FROM open GROUP BY ALL),
    item AS (SELECT p.doc_id, c_name, p.pos, p.page, p.kind, p.content, p.label, p.language, path, lag(p.page) OVER w AS before, lag(path) OVER w AS above FROM piece p JOIN customer ON c_custkey = p.doc_id LEFT JOIN path t ON t.doc_id = p.doc_id AND t.pos = p.pos WHERE p.kind <> 'heading' WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.pos)),
    line AS (SELECT doc_id, c_name, pos, page, CASE WHEN before IS DISTINCT FROM page THEN '[page ' || page || CASE WHEN page > 1 THEN ', printed ' || page + 10 ELSE '' END || ']' || chr(10) || chr(10) ELSE '' END
        || CASE WHEN path IS NOT NULL AND path IS DISTINCT FROM above THEN 'Section: ' || path || chr(10) || chr(10) ELSE '' END
        || CASE kind WHEN 'formula' THEN '$$' || content || '$$ ' || label WHEN 'code' THEN coalesce(label || chr(10), '') || '```' || coalesce(language, '') || chr(10) || content || chr(10) || '```' WHEN 'figure' THEN 'as embedded: ' || content WHEN 'table' THEN 'as embedded: ' || content ELSE content END AS line FROM item),
    whole AS (SELECT doc_id, 'Document: ' || c_name || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text FROM line GROUP BY doc_id, c_name),
    seen AS (SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT doc_id, page FROM line) GROUP BY doc_id)
    SELECT w.doc_id, CASE WHEN ceil(length(text) / 4.0) <= 300 THEN text END AS text, pages, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN ceil(length(text) / 4.0) > 300 THEN 'too long' END AS fault FROM whole w JOIN seen s ON s.doc_id = w.doc_id""", model=False)
def document_questions(spark, sf_dir):
    """The text of each chapter for one question, of 300 tokens at most."""
    p = sections(piece_rows(spark, sf_dir)).where("kind <> 'heading'")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("doc_title"))
    items = p.join(names, "doc_id").select(
        "doc_id", "doc_title", F.struct("page", "number").alias("position"), "page", F.when(F.col("page") > 1, (F.col("page") + 10).cast("string")).alias("printed"),
        context_line(F.col("doc_title"), F.col("path")).alias("title"), "kind", F.col("content").alias("text"), "label", "language", F.concat(F.lit("as embedded: "), "content").alias("embed_text"),
    )
    return questions.document_texts(items, 300).withColumn("pages", F.array_join("pages", ","))
