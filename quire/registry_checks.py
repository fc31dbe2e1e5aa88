r"""Queries over LaTeX, listings and claims, and the SQL that gives the same rows.

Texts are put together from pieces that a part's key draws, so that faults and nestings of all kinds occur; math between
dollar signs is looked for in all documents. The SQL walks units or lines one by one."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import latex, markdown
from quire.operators import dataset, page_replies
from quire.registry import BODY, query
from quire.sources import table

FORMULA = ("\\frac{a}{b}", "{", "}", "\\left(", "\\right)", "\\begin{aligned}", "\\end{aligned}", "\\begin{m}", "\\end{m}", "\\begin", "\\\\", "\\{", "x^2", "%", "\\%", "$", "\\$", "\\tag{1}", "\\( ", " \\)", "a & b", " \\equation", "\\begin{align*}")
CLAIM = ("the rate ", "\\(", "\\)", "\\( ", " \\)", "\nu", "\n", "\theta", "a_bc", "x_i", " and ", "\\\\", "\\", "\fbox", "\r", "_ab1", "\\(max_depth\\)", "\\( n_x \\)")
LINES = ("", "text", "```", "```", "```python", "````", "```` rust ", " ```", "a ``` b", "``", "$x$")
#: How many pieces a text has.
PIECES = 7


def drawn(key: Column, pieces: tuple[str, ...], between: str = "") -> Column:
    """A text of pieces that a key draws."""
    own = F.array(*map(F.lit, pieces))
    at = lambda j: (key * (2 * j + 3) + F.floor(key / (5 * j + 2))) % len(pieces)
    return F.array_join(F.array(*(F.element_at(own, at(j).cast("int") + 1) for j in range(PIECES))), between)


def drawn_sql(pieces: tuple[str, ...], between: str = "''") -> str:
    """The same in SQL, as CTE `t` of id and t."""
    own = ", ".join("'" + p.replace("'", "''") + "'" for p in pieces)
    at = lambda j: f"((p_partkey * {2 * j + 3} + p_partkey // {5 * j + 2}) % {len(pieces)})"
    return f"t AS (SELECT p_partkey AS id, array_to_string([{', '.join(f'([{own}])[{at(j)} + 1]' for j in range(PIECES))}], {between}) AS t FROM part)"


def drawn_rows(spark, sf_dir, pieces: tuple[str, ...], between: str = "") -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), drawn(F.col("p_partkey"), pieces, between).alias("t"))


#: After t: u, the units of each text, and w, its structure's walk, as rows of id, fault, bare.
STRUCTURE = r"""u AS (SELECT id, t, regexp_extract_all(t, '\\[A-Za-z]+|\\[\s\S]|[\s\S]') AS u FROM t),
    n AS (SELECT *, list_transform(range(1, len(u) + 1), lambda i: CASE WHEN u[i] IN ('\begin', '\end') AND u[i + 1] = '{' AND list_contains(u[i + 2:], '}') THEN array_to_string(u[i + 2:i + list_position(u[i + 2:], '}')], '') END) AS names FROM u),
    walk AS (SELECT id, 1 AS k, 0 AS depth, CAST([] AS VARCHAR[]) AS open, 0 AS opened, 0 AS sides, CAST(NULL AS VARCHAR) AS fault, false AS bare FROM n
        UNION ALL
        SELECT w.id, k + 1, depth + CASE u[k] WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END,
            CASE WHEN u[k] = '\begin' AND names[k] IS NOT NULL THEN list_append(open, names[k]) WHEN u[k] = '\end' AND names[k] IS NOT NULL THEN open[1:len(open) - 1] ELSE open END,
            opened + CASE WHEN names[k] IS NULL THEN 0 WHEN u[k] = '\begin' THEN 1 ELSE -1 END,
            sides + CASE u[k] WHEN '\left' THEN 1 WHEN '\right' THEN -1 ELSE 0 END,
            coalesce(fault, CASE WHEN u[k] = '}' AND depth < 1 THEN 'closing-brace' END, CASE WHEN u[k] = '\end' AND names[k] IS NOT NULL AND open[len(open)] IS DISTINCT FROM names[k] THEN 'end' END),
            bare OR (u[k] = '\\' AND depth = 0 AND opened = 0)
        FROM walk w JOIN n ON n.id = w.id WHERE k <= len(u)),
    w AS (SELECT w.id, n.t, n.u, names, coalesce(fault, CASE WHEN depth > 0 THEN 'opening-brace' WHEN len(open) > 0 THEN 'begin' WHEN sides <> 0 THEN 'left-right' END) AS fault, bare FROM walk w JOIN n ON n.id = w.id WHERE k = len(n.u) + 1)
"""

WRAPPED = "|".join(x.replace("*", "\\*") for x in latex.WRAPPING)


@query(f"WITH RECURSIVE {drawn_sql(FORMULA)}, {STRUCTURE}" + rf"""
    SELECT id, fault, bare, CASE list_filter(u, lambda x: x IN ('%', '$'))[1] WHEN '%' THEN 'percent' WHEN '$' THEN 'dollar' END AS sign,
        CASE WHEN starts_with(ltrim(t), '\(') THEN 'parentheses' WHEN starts_with(ltrim(t), '\[') THEN 'brackets' WHEN starts_with(ltrim(t), '$') THEN 'dollars'
            WHEN regexp_matches(ltrim(t), '^\\begin\{{({WRAPPED})\}}') THEN 'environment' WHEN list_contains(u, '\tag') OR list_contains(u, '\label') THEN 'label' END AS wrapped,
        len(list_filter(range(1, len(u) + 1), lambda i: u[i] = '\begin' AND names[i] = 'aligned')) > 0 AND NOT list_contains(u, '\\') AS unbroken
    FROM w""", model=False)
def latex_faults(spark, sf_dir):
    own = drawn_rows(spark, sf_dir, FORMULA)
    return own.select("id", latex.unbalanced("t").alias("fault"), latex.bare_row_break("t").alias("bare"), latex.bare_sign("t").alias("sign"), latex.wrapped("t").alias("wrapped"), latex.aligned_without_row_break("t").alias("unbroken"))


@query(f"WITH {drawn_sql(CLAIM)}" + r""", u AS (SELECT id, generate_subscripts(u, 1) AS k, unnest(u) AS u FROM (SELECT id, regexp_extract_all(t, '\\[A-Za-z]+|\\[\s\S]|[\s\S]') AS u FROM t)),
    m AS (SELECT *, count(*) FILTER (u = '\(') OVER w AS opened, count(*) FILTER (u = '\)') OVER w AS closed FROM u WINDOW w AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT id, min_by(CASE WHEN u = '\(' AND opened - closed > 1 THEN 'nested' WHEN u = '\)' AND closed > opened THEN 'unopened' END, k) FILTER ((u = '\(' AND opened - closed > 1) OR (u = '\)' AND closed > opened)) AS first, max(opened) > max(closed) AS more FROM m GROUP BY id),
    s AS (SELECT id, opened, coalesce(string_agg(u, '' ORDER BY k) FILTER (u <> '\('), '') AS span FROM m WHERE opened = closed + 1 GROUP BY id, opened),
    g AS (SELECT id, string_agg(span, '|' ORDER BY opened) AS spans FROM s GROUP BY id)
    SELECT f.id, coalesce(first, CASE WHEN more THEN 'unclosed' END) AS fault, CASE WHEN first IS NULL AND NOT more THEN coalesce(spans, '') END AS spans FROM f LEFT JOIN g ON g.id = f.id""", model=False)
def math_marks(spark, sf_dir):
    own = drawn_rows(spark, sf_dir, CLAIM).select("id", latex.math_spans("t").alias("m"))
    return own.select("id", "m.fault", F.when(F.col("m.spans").isNotNull(), F.array_join("m.spans", "|")).alias("spans"))


#: After documents: t, the math of each text between dollar signs, and r, whether all of a document's math renders.
RENDERS = r"""tokens AS (SELECT doc_id, regexp_extract_all(text, '\\[\s\S]|\$|[^\\$]+') AS u FROM documents WHERE contains(text, '$')),
    d AS (SELECT doc_id, 1 AS k, 0 AS mode, 0 AS skip, 0 AS span, false AS inside FROM tokens
        UNION ALL
        SELECT d.doc_id, k + 1,
            CASE WHEN u[k] <> '$' OR skip = 1 THEN mode WHEN mode = 0 THEN CASE WHEN u[k + 1] = '$' THEN 2 ELSE 1 END WHEN mode = 1 OR u[k + 1] = '$' THEN 0 ELSE mode END,
            CASE WHEN u[k] = '$' AND skip = 0 AND mode <> 1 AND u[k + 1] = '$' THEN 1 ELSE 0 END,
            CASE WHEN u[k] = '$' AND skip = 0 AND mode = 0 THEN span + 1 ELSE span END,
            mode > 0 AND skip = 0 AND (u[k] <> '$' OR (mode = 2 AND u[k + 1] IS DISTINCT FROM '$'))
        FROM d JOIN tokens ON tokens.doc_id = d.doc_id WHERE k <= len(u)),
    ends AS (SELECT doc_id, max(span) AS spans, max_by(mode, k) AS mode FROM d GROUP BY doc_id),
    t AS (SELECT row_number() OVER () AS id, * FROM (SELECT d.doc_id, d.span, trim(coalesce(string_agg(u[k - 1], '' ORDER BY k) FILTER (inside), '')) AS t FROM d JOIN tokens ON tokens.doc_id = d.doc_id WHERE d.span > 0 GROUP BY d.doc_id, d.span)),
    """ + STRUCTURE + r""", plain AS (SELECT *, array_to_string(list_transform(u, lambda x: CASE WHEN starts_with(x, '\') THEN 'x' ELSE x END), '') AS p FROM w),
    good AS (SELECT id, fault IS NULL AND coalesce(u[len(u)], '') <> '\' AND NOT regexp_matches(p, '[\^_]\s*([\^_}&]|$)') AND NOT (contains(p, '&') AND NOT list_contains(u, '\begin')) AS good FROM plain),
    r AS (SELECT e.doc_id, e.mode = 0 AND bool_and(good) AS renders FROM ends e JOIN t ON t.doc_id = e.doc_id JOIN good ON good.id = t.id GROUP BY e.doc_id, e.mode)
"""


@query(f"WITH RECURSIVE {RENDERS} SELECT d.doc_id, renders FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id", model=False)
def latex_renders(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", latex.renders(markdown.prose("text")).alias("renders"))


@query(f"""WITH RECURSIVE {RENDERS}, g AS (SELECT d.doc_id, {BODY} AS body, CASE WHEN quality < 1 THEN 'page-score' WHEN NOT renders THEN 'latex' END AS bad FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
    f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(body)) AS first FROM g WHERE bad IS NULL)
    SELECT doc_id, CASE WHEN first < doc_id THEN 'duplicate' END AS reason FROM f UNION ALL SELECT doc_id, bad FROM g WHERE bad IS NOT NULL""", model=False)
def verdicts(spark, sf_dir):
    return dataset.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")))


@query(f"WITH RECURSIVE {drawn_sql(LINES, 'chr(10)')}" + r""", l AS (SELECT id, string_split(t, chr(10)) AS l FROM t),
    w AS (SELECT id, 1 AS k, CAST(NULL AS VARCHAR) AS fence, 0 AS listing, CAST(NULL AS VARCHAR) AS line, 'none' AS kind FROM l
        UNION ALL
        SELECT w.id, k + 1, CASE WHEN fence IS NULL THEN CASE WHEN starts_with(l[k], '```') THEN regexp_extract(l[k], '^`+') END WHEN l[k] <> fence THEN fence END,
            listing + CASE WHEN fence IS NULL AND starts_with(l[k], '```') THEN 1 ELSE 0 END, l[k],
            CASE WHEN fence IS NULL THEN CASE WHEN starts_with(l[k], '```') THEN 'open' ELSE 'prose' END WHEN l[k] = fence THEN 'close' ELSE 'code' END
        FROM w JOIN l ON l.id = w.id WHERE k <= len(l)),
    c AS (SELECT id, listing, max(trim(regexp_replace(line, '^`+', ''))) FILTER (kind = 'open') || ':' || coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (kind = 'code'), '') AS code FROM w WHERE listing > 0 AND kind <> 'prose' GROUP BY id, listing),
    p AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (kind = 'prose'), '') AS prose FROM w GROUP BY id)
    SELECT p.id, prose, coalesce(string_agg(code, '|' ORDER BY listing), '') AS listings FROM p LEFT JOIN c ON c.id = p.id GROUP BY p.id, prose""", model=False)
def prose_and_listings(spark, sf_dir):
    own = drawn_rows(spark, sf_dir, LINES, "\n")
    return own.select("id", markdown.prose("t").alias("prose"), F.array_join(F.transform(markdown.listings("t"), lambda x: F.concat_ws(":", x["language"], x["code"])), "|").alias("listings"))


@query(f"WITH {drawn_sql(CLAIM)}" + r""", u AS (SELECT id, generate_subscripts(u, 1) AS k, unnest(u) AS u FROM (SELECT id, regexp_extract_all(t, '\\[\s\S]|[\s\S]') AS u FROM t)),
    m AS (SELECT *, coalesce(last_value(CASE WHEN u IN ('\(', '\)') THEN u = '\(' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS math, lead(u) OVER (PARTITION BY id ORDER BY k) AS next FROM u),
    r AS (SELECT id, k, CASE WHEN math AND u[len(u)] = chr(10) AND regexp_matches(coalesce(next, ''), '^[A-Za-z]') THEN u[1:len(u) - 1] || '\n' ELSE u END AS u FROM m),
    x AS (SELECT id, replace(replace(replace(replace(string_agg(u, '' ORDER BY k), chr(9), '\t'), chr(8), '\b'), chr(12), '\f'), chr(13), '\r') AS t FROM r GROUP BY id),
    s AS (SELECT id, regexp_split_to_array(t, '\\\([\s\S]*?\\\)') AS parts, regexp_extract_all(t, '\\\([\s\S]*?\\\)') AS spans FROM x),
    e AS (SELECT id, parts, list_transform(spans, lambda y: CASE WHEN regexp_matches(y, '^\\\(\s*[A-Za-z0-9_]+\s*\\\)$') AND regexp_matches(y, '_[A-Za-z0-9]{2}') THEN '`' || regexp_extract(y, '[A-Za-z0-9_]+') || '`' ELSE y END) AS spans FROM s)
    SELECT id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(spans[i], '')), '') AS claim FROM e""", model=False)
def mended_claims(spark, sf_dir):
    return drawn_rows(spark, sf_dir, CLAIM).select("id", latex.mended_claim("t").alias("claim"))


@query(model=False)
def page_reply_faults(spark, sf_dir):
    """Replies of four pieces each, whose texts the keys draw; thirteen rules in a cascade aren't written in SQL, tests
    plant a reply for each rule."""
    key = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("text", "formula", "heading", "footnote", "code")))
    content = F.when(key % 3 == 0, drawn(key, FORMULA[12:])).when(key % 3 == 1, F.col("p_name")).otherwise(drawn(key, CLAIM[:5]))
    none = {"label": "string", "caption": "string", "printed_number": "string", "name": "string", "statement": "string", "symbols": "array<struct<symbol:string,meaning:string>>", "printed_text": "array<string>", "note": "string", "summary": "string", "language": "string", "marker": "string", "cites": "array<string>", "bounds": "struct<left:int,top:int,right:int,bottom:int>"}
    piece = F.struct((key % 4 + 1).cast("int").alias("number"), F.element_at(kinds, (key % 5 + 1).cast("int")).alias("kind"), content.alias("content"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(key / 4).alias("page_id")).agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), piece.alias("piece"))))["piece"].alias("pieces"), F.min("p_brand").alias("printed"))
    replies = pages.select("page_id", "printed", F.lit(None).cast("string").alias("header"), (F.col("page_id") % 2 == 0).alias("starts"), (F.col("page_id") % 7 == 0).alias("ends"), F.lit(0).alias("layer_words"), "pieces", F.array(F.struct(F.lit(1).alias("piece"), F.lit(3).alias("about"))).alias("discusses"))
    return page_replies.first_faults(replies.withColumn("discusses", F.when(F.col("page_id") % 5 == 0, F.col("discusses")).otherwise(F.slice("discusses", 1, 0))))
