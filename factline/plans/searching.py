"""Citations, evidence and search (family E)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from factline.plans.model import Model, sql
from factline.plans.registry import plan
from factline.search import evidence as EV
from factline.search import facts as SF
from factline.search import index as I
from factline.search import text as T
from factline.search import vectors as V
from factline.session import cut_lineage

CITE_SQL = """ci AS (SELECT o_orderkey AS fact_id, o_totalprice AS amount_aud, CASE WHEN o_orderpriority LIKE '1%' THEN 'https://fact/' || o_orderkey WHEN o_orderstatus <> 'P' THEN 'https://doc/' || o_custkey END AS landing_url,
  CASE WHEN l.r IS NOT NULL THEN 'https://resolved/' || o_orderkey ELSE 'https://canonical/' || o_custkey END AS original_resource_url, CASE WHEN o_orderpriority LIKE '2%' THEN 'files/x' WHEN l.r IS NOT NULL THEN 'files/' || o_orderkey END AS cached_copy_path,
  CASE WHEN o_orderpriority LIKE '3%' THEN '' ELSE 'row:' || o_orderkey END AS locator, CASE WHEN l.r IS NOT NULL THEN '2026' ELSE '2025' END AS retrieved_at FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS r FROM lineitem WHERE l_quantity > 40) l ON l.r = o_orderkey)"""


@plan("e1_citations", sql("WITH " + CITE_SQL + " SELECT * FROM ci WHERE landing_url IS NOT NULL AND cached_copy_path IS NOT NULL AND locator <> ''"))
def e1(m: Model):
    o, p = m.table("orders"), F.substring("o_orderpriority", 1, 1)
    k = F.col("o_orderkey").cast("string")
    facts = o.select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_totalprice").alias("amount_aud"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("retrieval_id"), F.lit("2025").alias("retrieved_at"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("https://doc/"), F.col("o_custkey").cast("string"))).alias("own_doc"),
        F.to_json(F.struct(F.when(p == "1", F.concat(F.lit("https://fact/"), k)).alias("landing_url"), F.when(p == "2", "files/x").alias("cached_copy_path"), F.when(p == "3", "").otherwise(F.concat(F.lit("row:"), k)).alias("locator"))).alias("locator_json"),
    )
    docs = m.table("customer").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("https://canonical/"), F.col("c_custkey").cast("string")).alias("canonical_resource_url"))
    ret = m.table("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("retrieval_id")).distinct()
    rk = F.col("retrieval_id").cast("string")
    ret = ret.select("retrieval_id", F.concat(F.lit("https://resolved/"), rk).alias("resolved_url"), F.concat(F.lit("files/"), rk).alias("local_path"), F.sha2(rk, 256).alias("sha256"), F.lit("2026").alias("retrieval_retrieved_at"))
    return EV.citations(facts.withColumnRenamed("own_doc", "doc_landing_url"), docs, ret).drop("sha256")


@plan("e2_locator_parse", sql("SELECT fact_id, split_part(node_name, ' / ', 1) AS x, CAST(month(o_orderdate) AS INTEGER) AS page_number, CAST(fact_id + 1 AS INTEGER) AS row_number, 'C' || fact_id AS cell FROM f WHERE fact_id < 10000000", "f").replace("split_part(node_name, ' / ', 1) AS x", "replace(split_part(node_name, ' / ', 1), 'Total ', '') AS sheet_name").replace(" WHERE fact_id < 10000000", ""))
def e2(m: Model):
    return EV.parse_locator(m.facts.select("fact_id", "locator")).select("fact_id", "sheet_name", "page_number", "row_number", "cell")


@plan(
    "e3_media_type",
    sql(
        """WITH u AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN url || '.PDF' WHEN page_id % 7 = 2 THEN url || '.csv' WHEN page_id % 7 = 3 THEN url || '.jsonl.gz' WHEN page_id % 7 = 4 THEN url || '.md' ELSE url || '.bin' END AS path, CASE WHEN page_id % 2 = 0 THEN 3 END AS pg FROM pages)
SELECT page_id, CASE WHEN path IS NULL THEN CASE WHEN pg IS NOT NULL THEN 'pdf' ELSE 'spreadsheet' END WHEN path LIKE '%.PDF' THEN 'pdf' WHEN path LIKE '%.csv' THEN 'spreadsheet' WHEN path LIKE '%.gz' OR path LIKE '%.md' THEN 'text_chunk' WHEN pg IS NOT NULL THEN 'pdf' ELSE 'unsupported' END AS media FROM u"""
    ),
)
def e3(m: Model):
    p, k = m.table("pages"), F.col("page_id") % 7
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", ".PDF", ".csv", ".jsonl.gz", ".md", ".bin", ".bin")]), (k + 1).cast("int"))
    path = F.when(k != 0, F.concat("url", suffix))
    page = F.when(F.col("page_id") % 2 == 0, 3)
    none = F.lit(None).cast("string")
    return p.select("page_id", EV.media_type(path, page, F.lit("s"), none, none.cast("int")).alias("media"))


@plan(
    "e4_row_window",
    sql(
        """WITH c AS (SELECT doc_id, max(line_no) // 2 AS cited_row FROM t GROUP BY ALL)
SELECT doc_id, CAST(cited_row AS BIGINT) AS cited_row, CAST(line_no AS INTEGER) AS row_no, line_no = cited_row AS is_cited, 2 AS highlight_column FROM t JOIN c USING (doc_id) WHERE abs(line_no - cited_row) <= 5""",
        "t",
    ),
)
def e4(m: Model):
    lines = m.text_lines.select("doc_id", F.col("line_no").alias("row_no"))
    cited = lines.groupBy("doc_id").agg(F.floor(F.max("row_no") / 2).cast("long").alias("cited_row"))
    staged = ["label", "financial_year", "Total paid", "note"]
    return EV.row_windows(cited, lines, "doc_id").select("doc_id", "cited_row", "row_no", "is_cited", F.lit(EV.highlight_column(staged)).alias("highlight_column"))


@plan("e5_fact_search", sql("SELECT fact_id, node_name, amount_aud FROM f WHERE compatibility_group = 'actual_expense' AND contains(lower(node_name), 'high') AND level = 'federal' AND financial_year >= '1997-98' AND amount_aud >= 250000", "f"))
def e5(m: Model):
    return SF.find_facts(m.facts, text="HIGH", mode="actuals", level="national", from_year="1997-98", min_amount=250000).select("fact_id", "node_name", "amount_aud")


@plan("e6_facts_by_source", sql("SELECT fact_id, fact_key FROM f WHERE source_key = 'asia_building' AND observation_date IS NULL", "f"))
def e6(m: Model):
    rows = m.facts.where("source_key = 'asia_building'").where(F.col("observation_date").isNull())
    return rows.select("fact_id", "fact_key")


NODE_TEXT_SQL = "nt AS (SELECT node_name || ' @ ' || level AS id, lower(node_name || ' ' || level) AS x FROM (SELECT DISTINCT node_name, level FROM f))"


def node_docs(m: Model):
    """Names and levels, found in the facts once however many steps read them."""
    names = lambda m: m.facts.select(F.concat_ws(" @ ", "node_name", "level").alias("id"), F.concat_ws(" ", "node_name", "level").alias("text")).distinct()
    return m.once("node_docs", lambda m: cut_lineage(names(m)))


@plan("e7_spending_postings", sql("WITH " + NODE_TEXT_SQL + r", w AS (SELECT id, len(regexp_extract_all(x, '[\p{L}\p{N}]+')) AS dl, unnest(regexp_extract_all(x, '[\p{L}\p{N}]+')) AS term FROM nt) SELECT term, id, CAST(dl AS INTEGER) AS dl, count(*) AS tf FROM w GROUP BY ALL", "f"))
def e7(m: Model):
    return node_index(m).postings


#: Tables that the facts' names and levels come from.
FACT_TABLES = ("orders", "customer", "nation", "region")


def kept(m: Model, name: str, docs, *tables: str) -> I.Index:
    """The index of that name over these tables, which outlives the query; it is refreshed where their files have changed."""
    own = hashlib.md5(m.folder.encode()).hexdigest()[:12]
    return m.once(name, lambda m: I.kept_index(m.spark, f"{name}-{own}", "id", lambda: docs(m), F.col("text"), [f"{m.folder}/{t}.parquet" for t in tables]))


def node_index(m: Model) -> I.Index:
    return kept(m, "node_index", node_docs, *FACT_TABLES)


CHUNK_SQL = r"""fl AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents), ch AS (SELECT doc_id, CAST(pos // 1050 AS INTEGER) AS chunk_index, substr(x, CAST(pos AS BIGINT) + 1, 1200) AS chunk_text
 FROM (SELECT doc_id, x, unnest(CASE WHEN length(x) <= 1200 THEN [0] ELSE range(0, length(x), 1050) END) AS pos FROM fl WHERE x <> ''))"""


@plan("e8_document_chunks", sql("WITH " + CHUNK_SQL + " SELECT doc_id, chunk_index, length(chunk_text) AS n_chars, substr(sha256(chunk_text), 1, 16) AS content_sha FROM ch").replace("length(chunk_text) AS n_chars", "CAST(length(chunk_text) AS INTEGER) AS n_chars"))
def e8(m: Model):
    return T.chunks(m.table("documents"), ["doc_id"]).select("doc_id", "chunk_index", F.length("chunk_text").alias("n_chars"), "content_sha")


@plan("e9_query_tokens", sql("SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'heed') AS both_tokens FROM documents"))
def e9(m: Model):
    terms = T.matched_terms(F.col("text"), "the HEED !")
    return m.table("documents").select("doc_id", (F.size(terms) == 2).alias("both_tokens"))


BM_SQL = r"""w AS (SELECT id, len(regexp_extract_all(x, '[\p{L}\p{N}]+')) AS dl, regexp_extract_all(x, '[\p{L}\p{N}]+') AS ts FROM src),
tf AS (SELECT id, dl, len(list_filter(ts, lambda t: t = '{a}')) AS f0, len(list_filter(ts, lambda t: starts_with(t, '{a}'))) AS f1, len(list_filter(ts, lambda t: t = '{b}')) AS f2, len(list_filter(ts, lambda t: starts_with(t, '{b}'))) AS f3 FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM tf),
idf AS (SELECT n, a, CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d0 + 0.5) / (d0 + 0.5)) END AS i0, CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END AS i1,
  CASE WHEN ln((n - d2 + 0.5) / (d2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d2 + 0.5) / (d2 + 0.5)) END AS i2, CASE WHEN ln((n - d3 + 0.5) / (d3 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d3 + 0.5) / (d3 + 0.5)) END AS i3 FROM st),
bm AS (SELECT id, round(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a)) + i3 * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * dl / a)), 9) AS bm25
  FROM tf, idf WHERE f1 > 0 AND f3 > 0 ORDER BY bm25 DESC, id LIMIT {limit})"""


def bm_sql(a: str, b: str, limit: int) -> str:
    return BM_SQL.replace("{a}", a).replace("{b}", b).replace("{limit}", str(limit))


CHUNK_SRC = CHUNK_SQL + ", src AS (SELECT doc_id || ':' || chunk_index AS id, lower(chunk_text) AS x FROM ch), "


def chunk_docs(m: Model, hits=None):
    """All chunks, or those of the documents that have a hit: the others are not cut up again to show a few."""
    docs = m.table("documents")
    if hits is not None:
        docs = docs.join(hits.select(F.substring_index("id", ":", 1).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    parts = T.chunks(docs, ["doc_id"])
    return parts.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("chunk_text").alias("text"))


def chunk_index(m: Model) -> I.Index:
    return kept(m, "chunk_index", chunk_docs, "documents")


def doc_text_hits(m: Model, q: str, limit: int):
    return T.bm25(chunk_index(m), "id", q, limit)


@plan("e10_bm25_documents", sql("WITH " + CHUNK_SRC + bm_sql("heed", "shes", 20) + " SELECT id, round(bm25, 6) AS bm25, round(1 / (1 + abs(bm25)), 6) AS score FROM bm"))
def e10(m: Model):
    return doc_text_hits(m, "heed shes", 20).select("id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@plan("e10_bm25_spending", sql("WITH " + NODE_TEXT_SQL + ", src AS (SELECT * FROM nt), " + bm_sql("building", "urgent", 20) + " SELECT id, round(bm25, 6) AS bm25 FROM bm", "f"))
def e10s(m: Model):
    return T.bm25(node_index(m), "id", "building urgent", 20).select("id", F.round("bm25", 6).alias("bm25"))


# vectors of documents stand for their first chunk
VEC_SQL = "vc AS (SELECT vec_id || ':0' AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5)), 9) AS score FROM embeddings ORDER BY score DESC, id LIMIT 40)"


def vector_lists(m: Model) -> V.Lists:
    own = hashlib.md5(m.folder.encode()).hexdigest()[:12]
    vectors = lambda: m.table("embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("id"), "embedding")
    return m.once("vector_lists", lambda m: V.kept_lists(m.spark, f"vectors-{own}", "id", vectors, [f"{m.folder}/embeddings.parquet"]))


def vector_hits(m: Model, limit: int, threshold: float):
    query = m.table("embeddings").where("vec_id = 5").select("embedding").first()
    return V.rank_by_lists(vector_lists(m), "id", query["embedding"] if query else None, limit, threshold)[0]


@plan("e11_cosine_ranking", sql("WITH " + VEC_SQL + " SELECT id, round(score, 5) AS score FROM vc WHERE score >= 0.28"))
def e11(m: Model):
    return vector_hits(m, 40, V.CHUNK_THRESHOLD).withColumn("score", F.round("score", 5))


VOCAB_SQL = "vo AS (SELECT p_name AS id, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5))), 9) AS score FROM embeddings JOIN part ON p_partkey = vec_id GROUP BY ALL ORDER BY score DESC, id LIMIT 10)"


def vocabulary_hits(m: Model, limit: int):
    """Names of the vocabulary by their best vector, above the threshold of names."""
    named = V.attach_vectors(m.table("part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("id")), m.table("embeddings"), "vec_id")
    query = m.table("embeddings").where("vec_id = 5").select("embedding").scalar()
    beside = named.select("id", "embedding", query.alias("_q"))
    best = beside.select("id", F.round(V.cosine(F.col("embedding"), F.col("_q")), 9).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(limit).where(F.col("score") >= V.CATEGORY_THRESHOLD)


@plan("e11_vocabulary_ranking", sql("WITH " + VOCAB_SQL + " SELECT id, round(score, 5) AS score FROM vo WHERE score >= 0.35"))
def e11v(m: Model):
    return vocabulary_hits(m, 10).withColumn("score", F.round("score", 5))


FUSE_SQL = """r AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS k, 0 AS l FROM bm UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1, 1 FROM (SELECT * FROM vc WHERE score >= 0.1)),
fu AS (SELECT id, round(sum(1.0 / (61 + k)), 9) AS score, count(*) AS n_lists, min(l * 1000000 + k) AS o FROM r GROUP BY ALL)"""


@plan("e12_rank_fusion", sql("WITH " + CHUNK_SRC + bm_sql("heed", "shes", 40) + ", " + VEC_SQL + ", " + FUSE_SQL + " SELECT id, round(score, 6) AS score, n_lists FROM fu ORDER BY fu.score DESC, o LIMIT 30"))
def e12(m: Model):
    text = doc_text_hits(m, "heed shes", 40).withColumn("order_score", F.col("bm25"))
    vec = vector_hits(m, 40, 0.1).withColumn("order_score", F.col("score"))
    return V.fuse([text, vec], "id", 30).withColumn("score", F.round("score", 6)).drop("shown")


@plan("e13_unified_search", sql("WITH " + CHUNK_SRC + bm_sql("heed", "shes", 20) + ", " + VEC_SQL.replace("LIMIT 40", "LIMIT 10") + ", " + FUSE_SQL.replace(">= 0.1", ">= 0.28") + " SELECT 'documents' AS scope, id, round(score, 6) AS score FROM fu ORDER BY fu.score DESC, o LIMIT 20"))
def e13(m: Model):
    text = doc_text_hits(m, "heed shes", 20).withColumn("order_score", F.col("bm25"))
    vec = vector_hits(m, V.vector_limit(20), V.CHUNK_THRESHOLD).withColumn("order_score", F.col("score"))
    hits = V.search("heed shes", "documents", 20, {"documents": text}, {"documents": vec}, "id")
    return hits.select("scope", "id", F.round("score", 6).alias("score"))


ALL_SQL = """, sb AS (SELECT * FROM bm), r2 AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS k, 0 AS l FROM sb UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1, 1 FROM vo WHERE score >= 0.35),
f2 AS (SELECT id, round(sum(1.0 / (61 + k)), 9) AS score, min(l) AS shown, min(l * 1000000 + k) AS o FROM r2 GROUP BY ALL ORDER BY score DESC, o LIMIT 20) SELECT id, score, shown FROM f2"""


@plan(
    "e13_unified_search_all",
    sql(
        "SELECT scope, id, round(score, 6) AS score, CAST(shown AS INTEGER) AS shown FROM (SELECT 'spending' AS scope, * FROM (WITH " + NODE_TEXT_SQL + ", src AS (SELECT * FROM nt), " + bm_sql("heed", "shes", 20) + ", " + VOCAB_SQL + ALL_SQL
        + ") UNION ALL SELECT 'documents', id, score, shown FROM (WITH " + CHUNK_SRC + bm_sql("heed", "shes", 20) + ", " + VEC_SQL.replace("LIMIT 40", "LIMIT 10").replace("vc AS", "vo AS") + ALL_SQL.replace("0.35", "0.28") + "))",
        "f",
    ),
)
def e13_all(m: Model):
    q = "heed shes"

    def text(hits, body):
        return hits.join(body, "id").withColumn("snippet", T.highlight(F.col("text"), q)).withColumn("order_score", F.col("bm25"))

    in_documents = doc_text_hits(m, q, 20)
    by_text = {"spending": text(T.bm25(node_index(m), "id", q, 20), node_docs(m)), "documents": text(in_documents, chunk_docs(m, in_documents))}
    by_vector = {"spending": vocabulary_hits(m, 10), "documents": vector_hits(m, V.vector_limit(20), V.CHUNK_THRESHOLD)}
    by_vector = {k: v.withColumn("order_score", F.col("score")) for k, v in by_vector.items()}
    return V.search(q, "all", 20, by_text, by_vector, "id").select("scope", "id", F.round("score", 6).alias("score"), "shown")


@plan(
    "e6_facts_by_id",
    sql("WITH " + CITE_SQL + " SELECT fact_id, amount_aud, landing_url, locator FROM ci WHERE landing_url IS NOT NULL AND cached_copy_path IS NOT NULL AND locator <> '' AND fact_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)"),
)
def e6_by_id(m: Model):
    """Facts asked for by id; those without a whole citation are not shown."""
    wanted = m.table("orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("fact_id"))
    return e1(m).join(wanted, "fact_id", "left_semi").select("fact_id", "amount_aud", "landing_url", "locator")


@plan(
    "e14_matched_terms_and_titles",
    sql(
        """SELECT DISTINCT node_name, CASE WHEN contains(lower(node_name), 'urgent') THEN 'urgent' ELSE '' END || CASE WHEN contains(lower(node_name), 'urgent') AND contains(lower(node_name), 'build') THEN ',' ELSE '' END || CASE WHEN contains(lower(node_name), 'build') THEN 'build' ELSE '' END AS terms,
 regexp_replace(node_name, '(?i)(urgent|build)', '«\\1»', 'g') AS snippet, CASE WHEN contains(lower(node_name), 'urgent') THEN 'URGENT' WHEN contains(lower(node_name), 'build') THEN string_split(node_name, ' / ')[1] WHEN node_name LIKE '% / %' THEN array_to_string(string_split(node_name, ' / ')[2:], ' / ') ELSE node_name END AS title FROM f""",
        "f",
    ),
)
def e14(m: Model):
    q, n = "urgent build", F.col("node_name")
    d = m.facts.select("node_name").distinct()
    return d.select("node_name", F.array_join(T.matched_terms(n, q), ",").alias("terms"), T.highlight(n, q).alias("snippet"), T.display_title(n, q).alias("title"))


@plan(
    "e15_mode_and_deep_link",
    sql(
        """WITH g AS (SELECT DISTINCT CASE WHEN quality_status = 'quarantined' THEN 'commitment' ELSE compatibility_group END AS g, level, financial_year, node_name FROM f)
SELECT g AS compatibility_group, CASE g WHEN 'actual_expense' THEN 'actuals' WHEN 'budget_expense' THEN 'budget' END AS mode, CASE WHEN g = 'commitment' THEN '/explorers/contracts/?year=' || financial_year || '&fact=9&q=' || replace(url_encode(node_name), '%20', '+')
 ELSE '/?mode=' || CASE g WHEN 'actual_expense' THEN 'actuals' ELSE 'budget' END || '&level=' || level || '&year=' || financial_year || '&fact=9&highlight=' || replace(url_encode(node_name), '%20', '+') END AS href FROM g""",
        "f",
    ),
)
def e15(m: Model):
    g = F.when(F.col("quality_status") == "quarantined", "commitment").otherwise(F.col("compatibility_group"))
    d = m.facts.select(g.alias("compatibility_group"), "level", "financial_year", "node_name").distinct()
    c = F.col("compatibility_group")
    return d.select("compatibility_group", T.mode_of_group(c).alias("mode"), T.deep_link(c, F.col("level"), F.col("financial_year"), F.lit(9), F.col("node_name")).alias("href"))


@plan("e16_vector_attach", sql("SELECT lang, count(*) AS n, 64 AS dim FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY ALL"))
def e16(m: Model):
    items = m.table("documents").select(F.col("doc_id").alias("id"), "lang")
    out = V.attach_vectors(items, m.table("embeddings").withColumnRenamed("vec_id", "id"), "id")
    return out.groupBy("lang", "dim").agg(F.count(F.lit(1)).alias("n"))
