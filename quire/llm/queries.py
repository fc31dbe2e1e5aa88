"""The queries of this subpackage for __spark_entry__, and SQL for those that SQL can express."""

from pyspark.sql import functions as F

from quire.llm import ball_tree, divergence, html_text, jaccard, lattice, merkle, mixing, packing, pii, quality, secrets, toxicity, vp_tree
from quire.llm.common import stored
from quire.sources import table


def tokenizer_file(name="word_bpe_49k.json"):
    """A public tokenizer's file on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weak_supervision_pii(spark, sf_dir):
    found = stored(pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text"))
    found = found.withColumn("all", pii.accepted(pii.fit(found), F.col("base"), F.col("candidates"), 0.5))
    count = lambda kind, of="base": F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    more = [count(k, "all") for k in pii.KINDS if k not in pii.BASE]
    return found.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("all")).alias("spans"), *more, F.size("all").cast("long").alias("n_spans"))


def op2_best_two_fit(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def toxic_by_language(known, languages):
    """known with toxic_<language> for each; a document without a language is toxic in none of them."""
    return known.withColumns({f"toxic_{x}": F.col("toxic") * F.col("lang").eqNullSafe(x).cast("int") for x in languages})


def op3_chain_toxicity(spark, sf_dir):
    """Categories: toxic in each language of the corpus, then toxic in any."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    languages = ("en", "de", "fr", "es")
    known = toxic_by_language(labels.join(docs.select("doc_id", "lang"), "doc_id"), languages)
    chain = toxicity.fit(docs, known, (*(f"toxic_{x}" for x in languages), "toxic"), quality.learned())
    scored = toxicity.score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", (~quality.learned()).alias("held_out"), *(f"p_toxic_{x}" for x in languages), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))


def op4_ball_tree_topk(spark, sf_dir):
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_vp_tree_neighbours(spark, sf_dir):
    return vp_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_subword_lattice(spark, sf_dir):
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), train)


def op8_flow_mix(spark, sf_dir):
    taken, sources = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    own = taken.withColumn("source", F.element_at("pattern", 1))
    # A null source is a source too. The driver holds the table of sources.
    return own.join(F.broadcast(sources), own["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", "taken")


def op9_random_indexing_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, quality.learned())
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~quality.learned()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_max_subsequence_html(spark, sf_dir):
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_merkle_manifest(spark, sf_dir):
    """Proofs of a copy whose texts have lost their line ends where the id's checksum is even."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in merkle.FIELDS]
    claimed = merkle.leaf([*fields[:-1], text])
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"), fields, claimed)).withColumnRenamed("key", "doc_id")


def op12_source_divergence_audit(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_multipart_secret_scan(spark, sf_dir):
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind, of: F.size(F.filter(of, lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    more = [count(k, "all") for k in secrets.KINDS if k not in secrets.BASE]
    return spans.select(F.col("key").alias("doc_id"), *(count(k, "base") for k in secrets.BASE), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("all")).alias("spans"), *more)


QUERIES = {f.__name__: f for f in (op1_weak_supervision_pii, op2_best_two_fit, op3_chain_toxicity, op4_ball_tree_topk, op5_ngram_jaccard_join, op6_vp_tree_neighbours, op7_subword_lattice, op8_flow_mix, op9_random_indexing_quality, op10_max_subsequence_html, op11_merkle_manifest, op12_source_divergence_audit, op13_multipart_secret_scan)}

def _leaf(text):
    """A leaf's digest in SQL, of documents with this text."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _steps(units, nodes, keys):
    """What stands left and right of each unit's own node on each level above it, in SQL."""
    on = " AND ".join(f"u.{k} = a.{k}" for k in keys) or "true"
    own = "u.i // CAST(pow(3, a.level) AS BIGINT)"
    side = lambda mark: f"coalesce(string_agg(a.digest, '' ORDER BY a.i) FILTER (WHERE a.i {mark} {own}), '')"
    by = ", ".join(["u.i", "a.level", *(f"u.{k}" for k in keys)])
    return f"SELECT {by}, {side('<')} AS l, {side('>')} AS r FROM {units} u JOIN {nodes} a ON {on} AND a.i // 3 = {own} // 3 AND a.n > 1 GROUP BY {by}"


#: The unsigned CRC-32 of an id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, d: list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


ORACLE_SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
                {_leaf("CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS claimed
            FROM documents
        ), u AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d
        ), a AS (
            SELECT tree, 0 AS level, i, n, leaf AS digest FROM u
            UNION ALL
            SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY tree, level, i // 3, n
        ), s AS (
            SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1
        ), b AS (
            SELECT 0 AS level, i, n, subroot AS digest FROM s
            UNION ALL
            SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 3, n
        ), low AS ({_steps("u", "a", ["tree"])}
        ), high AS ({_steps("s", "b", [])}
        ), p AS (
            SELECT tree, i, level AS k, l, r FROM low
            UNION ALL
            SELECT u.tree, u.i, (SELECT count(DISTINCT level) FROM a WHERE a.tree = u.tree AND a.n > 1) + h.level, h.l, h.r
            FROM u JOIN s ON s.tree = u.tree JOIN high h ON h.i = s.i
        ), f AS (
            SELECT tree, i, 0 AS k, claimed AS x FROM u
            UNION ALL
            SELECT f.tree, f.i, f.k + 1, sha256(p.l || f.x || p.r) FROM f JOIN p ON p.tree = f.tree AND p.i = f.i AND p.k = f.k
        ), e AS (
            SELECT tree, i, max_by(x, k) AS folded_root FROM f GROUP BY tree, i
        ), q AS (
            SELECT tree, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM p GROUP BY tree, i
        )
        SELECT u.doc_id, u.leaf, s.subroot, (SELECT digest FROM b WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
            e.folded_root, e.folded_root = (SELECT digest FROM b WHERE n = 1) AS verified
        FROM u JOIN s ON s.tree = u.tree JOIN e ON e.tree = u.tree AND e.i = u.i LEFT JOIN q ON q.tree = u.tree AND q.i = u.i""",
    "op4_ball_tree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_source_divergence_audit": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), w AS (
            SELECT id, lang, source, unnest(terms) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
        ), c AS (
            SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term
        ), v AS (
            SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang
        ), n AS (
            SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source
        ), g AS (
            SELECT x.lang, x.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN n ON n.lang = x.lang AND n.source = x.source
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 * CAST(coalesce(c.c, 0) + 2 AS HUGEINT) // CAST(g.n + 2 * v.v AS HUGEINT) AS BIGINT) AS p,
                1 + CAST(1000000000 * CAST(k.c + 2 AS HUGEINT) // CAST(v.n + 2 * v.v AS HUGEINT) AS BIGINT) AS q
            FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ), t AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM t
        )
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
