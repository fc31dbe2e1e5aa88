"""Queries over pieces of chapters: sections, links, paragraphs, chunks, items, outlines; and the SQL that gives the same rows.

The pieces are the orders: a document for each customer, a page for each quarter."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import pieces
from quire.registry import query
from quire.sources import table

PIECE_KINDS = ("heading", "formula", "figure", "table", "code", "footnote")


def piece_rows(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key, turn = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 12)
    kind = F.when(key % 12 < 6, F.element_at(F.array(*map(F.lit, PIECE_KINDS)), F.least(key % 12, F.lit(5)).cast("int") + 1)).otherwise("text")
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.quarter("o_orderdate").alias("page"), key.alias("key"), turn.alias("turn"), kind.alias("kind"))
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("key"))
    word = F.concat_ws(" ", F.initcap("kind"), F.col("key").cast("string"))
    noted = F.concat(word, F.lit(" [^m"), (F.col("turn") % 3).cast("string"), F.lit("] "), F.repeat(F.lit("and on "), (F.col("key") % 40).cast("int")))
    rows = rows.select(
        "doc_id", "page", number.alias("number"), "kind",
        F.when(F.col("kind") == "heading", (F.col("turn") % 4 + 1).cast("int")).alias("rank"),
        F.when(F.col("kind") == "text", F.trim(noted)).otherwise(word).alias("content"),
        F.when(F.col("kind").isin("formula", "figure", "table"), F.concat(F.lit("("), (F.col("turn") % 10).cast("string"), F.lit(")"))).when((F.col("kind") == "code") & (F.col("turn") % 5 == 0), F.lit("Listing")).alias("label"),
        F.when((F.col("kind") == "footnote") & (F.col("turn") % 4 != 0), F.concat(F.lit("m"), (F.col("turn") % 3).cast("string"))).alias("marker"),
        F.when((F.col("kind") == "code") & (F.col("turn") % 3 != 1), F.when(F.col("turn") % 3 == 0, "python").otherwise("rust")).alias("language"),
    )
    starts = (F.col("doc_id") + F.col("page")) % 2 == 0
    pages = rows.select("doc_id", "page").distinct().select("doc_id", "page", starts.alias("starts"), (~starts).alias("ends"))
    return pieces.mid_sentence(rows, pages)


PIECES = """WITH RECURSIVE raw AS (SELECT o_custkey AS doc_id, CAST(quarter(o_orderdate) AS INTEGER) AS page, o_orderkey AS key, o_orderkey // 12 AS turn,
        coalesce((['heading', 'formula', 'figure', 'table', 'code', 'footnote'])[CASE WHEN o_orderkey % 12 < 6 THEN o_orderkey % 12 + 1 END], 'text') AS kind FROM orders),
    plain AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY key) AS INTEGER) AS number, kind, CASE WHEN kind = 'heading' THEN CAST(turn % 4 + 1 AS INTEGER) END AS rank,
        upper(kind[1]) || kind[2:] || ' ' || key || CASE WHEN kind = 'text' THEN rtrim(' [^m' || turn % 3 || '] ' || repeat('and on ', CAST(key % 40 AS INTEGER))) ELSE '' END AS content,
        CASE WHEN kind IN ('formula', 'figure', 'table') THEN '(' || turn % 10 || ')' WHEN kind = 'code' AND turn % 5 = 0 THEN 'Listing' END AS label,
        CASE WHEN kind = 'footnote' AND turn % 4 <> 0 THEN 'm' || turn % 3 END AS marker,
        CASE WHEN kind = 'code' AND turn % 3 <> 1 THEN CASE WHEN turn % 3 = 0 THEN 'python' ELSE 'rust' END END AS language FROM raw),
    ends AS (SELECT doc_id, page, min(number) FILTER (kind = 'text') AS first, max(number) FILTER (kind = 'text') AS last FROM plain GROUP BY ALL),
    piece AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page, number) AS pos, coalesce((p.doc_id + p.page) % 2 = 0 AND number = first, false) AS starts, coalesce((p.doc_id + p.page) % 2 = 1 AND number = last, false) AS ends
        FROM plain p JOIN ends e ON p.doc_id = e.doc_id AND p.page = e.page)
"""


def over_pieces(sql: str | None = None):
    def add(f):
        own = lambda spark, sf_dir: f(piece_rows(spark, sf_dir))
        own.__name__ = f.__name__
        query(PIECES + sql if sql else None, model=False)(own)
        return f

    return add


@over_pieces("SELECT doc_id, page, number, starts, ends FROM piece WHERE starts OR ends")
def mid_sentence_marks(p):
    return p.where("starts OR ends").select("doc_id", "page", "number", "starts", "ends")


@over_pieces(""", open AS (SELECT p.doc_id, p.pos, h.content, h.pos AS opos FROM piece p JOIN piece h ON p.doc_id = h.doc_id AND h.kind = 'heading' AND h.pos < p.pos
        WHERE NOT EXISTS (SELECT 1 FROM piece g WHERE g.doc_id = h.doc_id AND g.kind = 'heading' AND g.rank <= h.rank AND g.pos > h.pos AND g.pos <= p.pos))
    SELECT p.doc_id, page, number, coalesce(string_agg(o.content, ' > ' ORDER BY opos), '') AS path FROM piece p LEFT JOIN open o ON p.doc_id = o.doc_id AND p.pos = o.pos GROUP BY ALL""")
def heading_stack(p):
    return pieces.sections(p).select("doc_id", "page", "number", F.array_join("path", " > ").alias("path"))


LEADS = """, lead AS (SELECT f.doc_id, f.page, t.number AS "from", f.number AS "to" FROM piece f JOIN piece t ON f.doc_id = t.doc_id AND f.page = t.page AND t.number < f.number AND f.kind = 'formula' AND t.kind = 'text'
        WHERE NOT EXISTS (SELECT 1 FROM piece x WHERE x.doc_id = f.doc_id AND x.page = f.page AND x.number > t.number AND x.number < f.number AND x.kind <> 'formula'))
"""


@over_pieces(LEADS + "SELECT * FROM lead")
def lead_ins(p):
    return pieces.lead_ins(p)


@over_pieces(LEADS + """, last AS (SELECT doc_id, page, max(number) AS number FROM piece WHERE kind NOT IN ('figure', 'table', 'footnote', 'code') GROUP BY ALL),
    opens AS (SELECT f.* FROM piece f WHERE kind = 'formula' AND NOT EXISTS (SELECT 1 FROM piece x WHERE x.doc_id = f.doc_id AND x.page = f.page AND x.number < f.number AND x.kind <> 'formula'))
    SELECT t.doc_id, t.page, t.number AS "from", f.number AS "to" FROM piece t JOIN last USING (doc_id, page, number) JOIN opens f ON f.doc_id = t.doc_id AND f.page = t.page + 1
    WHERE t.kind = 'text' AND (t.doc_id + t.page) % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lead l WHERE l.doc_id = f.doc_id AND l.page = f.page AND l."to" = f.number)""")
def bridged_lead_ins(p):
    return pieces.bridged_lead_ins(p, pieces.lead_ins(p))


LINKS = """, link AS (SELECT n.doc_id, n.page, n.number AS "from", c.number AS "to" FROM piece n JOIN piece c ON n.doc_id = c.doc_id AND n.page = c.page AND n.kind = 'footnote' AND c.kind IN ('heading', 'text', 'table') AND contains(c.content, '[^' || n.marker || ']'))
"""


@over_pieces(LINKS + "SELECT * FROM link")
def footnote_links(p):
    return pieces.footnote_links(p)


@over_pieces("SELECT doc_id, page, number, array_to_string(list_distinct(regexp_extract_all(content, '\\[\\^([^\\]]+)\\]', 1)), ',') AS markers FROM piece WHERE kind = 'text'")
def footnote_markers(p):
    return p.where("kind = 'text'").select("doc_id", "page", "number", F.array_join(pieces.markers("content"), ",").alias("markers"))


PARAGRAPHS = """, runs AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM piece),
    joined AS (SELECT *, CASE WHEN starts AND lag(ends) OVER (PARTITION BY doc_id, run ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM runs WHERE kind = 'text' AND trim(content) <> ''),
    counted AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, run ORDER BY pos) AS paragraph FROM joined),
    para AS (SELECT doc_id, run, paragraph, min(pos) AS pos, string_agg(content, ' ' ORDER BY pos) AS text FROM counted GROUP BY ALL)
"""


@over_pieces(PARAGRAPHS + "SELECT q.doc_id, CAST(run AS BIGINT) AS run, CAST(paragraph AS BIGINT) AS paragraph, page, number, text FROM para q JOIN piece p ON q.doc_id = p.doc_id AND q.pos = p.pos")
def paragraph_runs(p):
    return pieces.paragraphs(p).drop("pieces")


ATTACHED = PARAGRAPHS + LINKS + """, carried AS (SELECT l.doc_id, l.page, l."from" AS number, min(ROW(l."to", c.run, c.paragraph)) AS t FROM link l JOIN counted c ON l.doc_id = c.doc_id AND l.page = c.page AND l."to" = c.number GROUP BY ALL),
    note AS (SELECT p.doc_id, p.page, p.number, p.pos, t[2] AS run, t[3] AS paragraph, content, marker FROM piece p LEFT JOIN carried c ON p.doc_id = c.doc_id AND p.page = c.page AND p.number = c.number WHERE kind = 'footnote')
"""


@over_pieces(ATTACHED + "SELECT doc_id, page, number, CAST(run AS BIGINT) AS run, CAST(paragraph AS BIGINT) AS paragraph FROM note")
def attached_footnotes(p):
    return pieces.attached_footnotes(p, pieces.paragraphs(p), pieces.footnote_links(p))


CHUNKS = ATTACHED + """, told AS (SELECT doc_id, run, paragraph, string_agg(CASE WHEN marker IS NOT NULL THEN '[^' || marker || ']: ' ELSE 'Footnote: ' END || content, chr(10) || chr(10) ORDER BY pos) AS notes FROM note WHERE run IS NOT NULL GROUP BY ALL),
    block AS (SELECT q.doc_id, q.run, q.pos, row_number() OVER (PARTITION BY q.doc_id, q.run ORDER BY q.pos) AS k, text || coalesce(chr(10) || chr(10) || notes, '') AS block FROM para q LEFT JOIN told t ON q.doc_id = t.doc_id AND q.run = t.run AND q.paragraph = t.paragraph),
    fold AS (SELECT doc_id, run, k, 0 AS chunk, length(block) AS chars FROM block WHERE k = 1 UNION ALL
        SELECT b.doc_id, b.run, b.k, CASE WHEN ceil((f.chars + 2 + length(b.block)) / 4.0) <= 60 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN ceil((f.chars + 2 + length(b.block)) / 4.0) <= 60 THEN f.chars + 2 + length(b.block) ELSE length(b.block) END
        FROM fold f JOIN block b ON b.doc_id = f.doc_id AND b.run = f.run AND b.k = f.k + 1),
    packed AS (SELECT b.doc_id, min(b.pos) AS pos, string_agg(b.block, chr(10) || chr(10) ORDER BY b.k) AS text FROM block b JOIN fold f ON b.doc_id = f.doc_id AND b.run = f.run AND b.k = f.k GROUP BY b.doc_id, b.run, f.chunk),
    made AS (SELECT p.doc_id, p.page, p.number, c.text FROM packed c JOIN piece p ON c.doc_id = p.doc_id AND c.pos = p.pos UNION ALL SELECT doc_id, page, number, content FROM note WHERE run IS NULL)
"""


@over_pieces(CHUNKS + "SELECT * FROM made")
def chapter_chunks(p):
    return pieces.chunks(p, 60)


LISTINGS = """, shown AS (SELECT *, lag(kind) OVER w AS k, lag(page) OVER w AS g, lag(language) OVER w AS l FROM piece WHERE kind <> 'footnote' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    code AS (SELECT *, CAST(sum(CASE WHEN k = 'code' AND g + 1 = page AND label IS NULL AND coalesce(language = l, true) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS listing FROM shown WHERE kind = 'code')
"""


@over_pieces(LISTINGS + "SELECT doc_id, page, number, listing, first_value(language IGNORE NULLS) OVER (PARTITION BY doc_id, listing ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS language FROM code")
def code_listings(p):
    return pieces.listings(p)


DRAFTS = LEADS + """, intro AS (SELECT doc_id, page, "to" AS number, max("from") AS lead FROM lead GROUP BY ALL),
    draft AS (SELECT p.doc_id, p.page, p.number, p.kind, coalesce(t.content || chr(10) || chr(10), '') || p.content || chr(10) || chr(10) || 'Label: ' || p.label AS embed_text
        FROM piece p LEFT JOIN intro i ON p.doc_id = i.doc_id AND p.page = i.page AND p.number = i.number LEFT JOIN piece t ON t.doc_id = i.doc_id AND t.page = i.page AND t.number = i.lead WHERE p.kind IN ('formula', 'figure', 'table'))
"""


@over_pieces(DRAFTS + "SELECT * FROM draft")
def piece_drafts(p):
    return pieces.piece_drafts(p, pieces.lead_ins(p))


@over_pieces(CHUNKS + LISTINGS + """, each AS (SELECT doc_id, page, number, 'chunk' AS kind FROM made UNION ALL SELECT doc_id, page, number, kind FROM piece WHERE kind IN ('formula', 'figure', 'table')
        UNION ALL SELECT doc_id, (min(ROW(page, number)))[1], (min(ROW(page, number)))[2], 'code' FROM code GROUP BY doc_id, listing)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, number) - 1 AS INTEGER) AS position, page, number, kind FROM each""")
def chapter_items(p):
    return pieces.items(p, 60)


OUTLINE = """, o AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM piece),
    outline AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) AS INTEGER) AS section, min(content) FILTER (kind = 'heading') AS heading, min(page) AS first_page, max(page) AS last_page, CAST(sum(length(content)) AS BIGINT) AS chars,
        count(*) FILTER (kind = 'formula') AS formula, count(*) FILTER (kind = 'figure') AS figure, count(*) FILTER (kind = 'table') AS "table", count(*) FILTER (kind = 'code') AS code FROM o GROUP BY doc_id, run)
"""


@over_pieces(OUTLINE + "SELECT * FROM outline")
def document_outline(p):
    return pieces.outline(p)


@over_pieces(OUTLINE + "SELECT doc_id, CASE WHEN count(*) = 1 THEN min(section) END AS section, CASE WHEN count(*) > 1 THEN 'ambiguous' END AS fault FROM outline WHERE lower(trim(heading)) = 'heading 1200' GROUP BY 1")
def section_by_heading(p):
    return pieces.sections_named(pieces.outline(p), " Heading 1200 ")


@over_pieces("SELECT doc_id, substr(string_agg(content, chr(10) || chr(10) ORDER BY page, number), 1, 500) AS text FROM piece WHERE page BETWEEN 2 AND 3 GROUP BY 1")
def read_pages(p):
    return pieces.page_texts(p, 2, 3, 500)
