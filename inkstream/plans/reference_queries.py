"""Queries of the retrieval, evaluation and preparation operators over the given tables, with the same questions in SQL.

Roles of the tables: ``documents`` are the documents, ``passage_collection`` the passages in order of ``pid``,
``queries_dev`` the queries, ``qrels_retrieval_dev`` the judgements (relevant from grade 2 on), ``click_log`` the query
and click log, ``embeddings`` the vectors (relevant: another vector of the same label), ``events`` the interactions
(property k is a vector's id). Searches ask every query whose id is divisible by 100.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import chunks, prompts, text
from inkstream.functions.hanzi import SIMPLIFIED, TRADITIONAL, to_simplified
from inkstream.operators import cells, dense, documents, eda, evaluate, fusion, generation, lexical, profile
from inkstream.operators.skew import join_hot
from inkstream.session import cut, spread, table
from inkstream.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---- SQL of the text functions -------------------------------------------------------------------------------------

W = text.SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replaced(c: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(by.replace('$', chr(92)))}, 'g')"
    return c


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, {q(text.EDGES)}, '', 'g')"


def sql_clean(c: str) -> str:
    return sql_strip(sql_replaced(sql_strip(f"coalesce({c}, '')"), text.CLEAN_STEPS))


def sql_tags(c: str) -> str:
    return sql_strip(sql_replaced(c, text.TAG_STEPS))


def sql_tags_ws(c: str) -> str:
    return sql_strip(sql_replaced(c, text.TAG_SPACE_STEPS))


def sql_wiki(c: str) -> str:
    lines = f"string_split({sql_replaced(f'coalesce({c}, {q(chr(0))[:1]}{chr(39)})', text.WIKI_STEPS)}, chr(10))"
    return sql_strip(f"array_to_string(list_filter(list_transform({lines}, lambda x: {sql_strip('x')}), lambda x: x <> ''), chr(10))")


def sql_bigrams(c: str) -> str:
    s = f"regexp_replace(lower(coalesce({c}, '')), '[^{text.WORD}]+', '', 'g')"
    return f"(SELECT CASE WHEN length(s) = 0 THEN [] WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) END FROM (SELECT {s} AS s))"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[{W}]+'), lambda x: x <> '')"


# ---- documents and text --------------------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, source, n_chars, title FROM documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars", "title")


def _text_query(name: str, of: str, key: str, column: str, make, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(table(spark, sf_dir, of).select(key, column)).select(key, make(F.col(column)).alias("result"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS result FROM {of}")(run)


_text_query("clean_text", "documents", "doc_id", "text", text.clean_text, sql_clean("text"))
_text_query("clean_html", "passage_collection", "pid", "text", text.clean_text, sql_clean("text"))
_text_query("normalize_text", "documents", "doc_id", "title", text.normalize_text, sql_strip("lower(coalesce(title, ''))"))
_text_query("strip_tags", "passage_collection", "pid", "text", text.strip_tags, sql_tags("text"))
_text_query("strip_tags_ws", "passage_collection", "pid", "text", text.strip_tags_ws, sql_tags_ws("text"))
_text_query("wiki_clean", "wikipedia_articles", "id", "text", text.wiki_clean, sql_wiki("text"))
_text_query("doc_length", "documents", "doc_id", "text", lambda c: F.length(F.coalesce(c, F.lit("None"))), "length(coalesce(text, 'None'))")
_text_query("snippet", "documents", "doc_id", "text", text.snippet, "replace(substring(text, 1, 300), chr(10), ' ') || '...'")
_text_query("tokenize", "queries_dev", "qid", "text", lambda c: F.array_join(text.tokens(c), "|"), f"array_to_string({sql_tokens('text')}, '|')")
_text_query("format_size", "documents", "doc_id", "n_chars", lambda c: text.format_size(c * 97), "CASE WHEN n_chars * 97 < 1024 THEN (n_chars * 97)::VARCHAR || ' B' WHEN n_chars * 97 < 1048576 THEN printf('%.1f KB', n_chars * 97 / 1024.0) ELSE printf('%.1f MB', n_chars * 97 / 1048576.0) END")
_text_query("t2s_translate", "documents", "doc_id", "text", to_simplified, f"translate(text, {q(TRADITIONAL)}, {q(SIMPLIFIED)})")
_text_query("classify_query", "queries_dev", "qid", "text", prompts.classify_query, "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(text, {q(w)})' for w in words)} THEN '{name}'" for name, words in prompts.QUERY_TYPES.items()) + " WHEN text LIKE '%？' OR text LIKE '%?' THEN 'open_discussion' ELSE 'default' END")


@query(f"""SELECT id, t AS title, x AS text, CASE WHEN x <> text THEN length(x)::INT ELSE length END AS length, coalesce(x <> text, false) OR coalesce(t <> title, false) AS changed
FROM (SELECT *, translate(title, {q(TRADITIONAL)}, {q(SIMPLIFIED)}) AS t, translate(text, {q(TRADITIONAL)}, {q(SIMPLIFIED)}) AS x FROM wikipedia_articles)""")
def t2s_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.simplified_update(table(spark, sf_dir, "wikipedia_articles")).select("id", "title", "text", "length", "changed")


@query(f"""SELECT pid, 'T2Ranking' AS source, text_length, content FROM (SELECT pid, {sql_tags_ws('text')} AS content, length({sql_tags_ws('text')}) AS text_length FROM passage_collection) WHERE text_length IS NOT NULL""")
def doc_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "passage_collection").select("pid", text.strip_tags_ws(F.col("text")).alias("text")).where("text is not null")
    return documents.passages_to_documents(rows).select("metadata.pid", "metadata.source", "metadata.text_length", F.col("page_content").alias("content"))


@query("SELECT doc_id, text AS content FROM documents WHERE length(text) >= 10")
def filter_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.filter_short(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))


@query("SELECT DISTINCT pid, text, site FROM passage_collection")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.remove_duplicates(table(spark, sf_dir, "passage_collection").select("pid", "text", "site"))


@query(f"SELECT DISTINCT content, lang FROM (SELECT {sql_strip('lower(' + sql_clean('text') + ')')} AS content, lang FROM documents) WHERE length(content) >= 10")
def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.process_documents(spread(table(spark, sf_dir, "documents").select(F.col("text").alias("content"), "lang")))


@query(f"SELECT DISTINCT \"Query\" FROM (SELECT {sql_strip('lower(' + sql_clean('query_text') + ')')} AS \"Query\" FROM click_log) WHERE length(\"Query\") > 0")
def process_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.process_queries(spread(table(spark, sf_dir, "click_log").select(F.col("query_text").alias("Query"))))


@query(f"SELECT pid, substring(t, 1, 2000) AS text FROM (SELECT pid, {sql_tags('text')} AS t FROM passage_collection) WHERE length(t) >= 10")
def load_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.load_passages(spread(table(spark, sf_dir, "passage_collection").select("pid", "text")))


@query(f"SELECT pid, substring(t, 1, 2000) AS text FROM (SELECT pid, {sql_tags_ws('text')} AS t FROM passage_collection) WHERE length(t) >= 10 AND pid > '10000500' ORDER BY pid, substring(t, 1, 2000) LIMIT 100")
def passage_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.passage_batch(table(spark, sf_dir, "passage_collection").select("pid", "text"), "pid", "10000500", 100).select("pid", "text")


@query(f"SELECT substring(v, 1, instr(v, chr(9)) - 1) AS pid, substring(v, instr(v, chr(9)) + 1) AS text FROM (SELECT {sql_strip('raw_line')} AS v FROM raw_lines) WHERE contains(v, chr(9))")
def tsv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_tsv(table(spark, sf_dir, "raw_lines").select(F.col("raw_line").alias("value")), ("pid", "text"), header=False)


@query("SELECT count(*) AS n_pairs, count(DISTINCT qid) AS n_queries FROM (SELECT DISTINCT qid, pid FROM qrels_retrieval_dev WHERE qid IS NOT NULL AND pid IS NOT NULL)")
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "qrels_retrieval_dev").select("qid", "pid").where("qid is not null and pid is not null").distinct()
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct("qid").alias("n_queries"))


@query("SELECT qid, text FROM queries_dev ORDER BY qid, text LIMIT 500")
def query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries_dev").select("qid", "text").orderBy("qid", "text").limit(500)


@query("SELECT qid, text FROM queries_dev WHERE qid IN (SELECT qid FROM qrels_retrieval_dev)")
def semi_join_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.with_judgements(table(spark, sf_dir, "queries_dev").select("qid", "text"), table(spark, sf_dir, "qrels_retrieval_dev"))


@query("SELECT qid, text FROM queries_dev WHERE qid IN (SELECT qid FROM qrels_retrieval_dev WHERE pid IN (SELECT pid FROM passage_collection))")
def pool_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.in_pool(table(spark, sf_dir, "queries_dev").select("qid", "text"), table(spark, sf_dir, "qrels_retrieval_dev"), table(spark, sf_dir, "passage_collection"))


@query("SELECT max(try_cast(pid AS BIGINT)) AS max_pid FROM qrels_retrieval_dev")
def max_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qrels_retrieval_dev").agg(F.max(F.col("pid").try_cast("bigint")).alias("max_pid"))


_PAGE = "SELECT id AS pos, title, '0' AS ns, text FROM wikipedia_articles"
_REASON = f"CASE WHEN title IS NULL OR text IS NULL THEN 'missing' WHEN starts_with(lower(text), '#redirect') OR starts_with(lower(text), '#重定向') THEN 'redirect' WHEN contains(text, '{{{{消歧义') OR contains(lower(text), '{{{{disambig') THEN 'disambiguation' WHEN length({sql_wiki('text')}) < 200 THEN 'short' END"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wikipedia_articles").select(F.col("id").alias("pos"), "title", F.lit("0").alias("ns"), "text").dropDuplicates(["pos"])


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_pages FROM (SELECT {_REASON} AS reason FROM (SELECT DISTINCT pos, title, text FROM ({_PAGE}))) GROUP BY ALL")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.skip_counts(_pages(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS id, {sql_strip('title')} AS title, x AS text, length(x)::INT AS length FROM (SELECT *, translate({sql_wiki('text')}, {q(TRADITIONAL)}, {q(SIMPLIFIED)}) AS x FROM (SELECT DISTINCT pos, title, text FROM ({_PAGE})) WHERE {_REASON} IS NULL)")
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.wiki_articles(_pages(spark, sf_dir))


# ---- chunks --------------------------------------------------------------------------------------------------------

_WINDOWS = f"""cut AS (SELECT doc_id, list_filter(list_transform(range(0, 1 + greatest(ceil((length(text) - 256) / 236.0), 0)::BIGINT), lambda i: {sql_strip('substring(text, i * 236 + 1, 256)')}), lambda x: x <> '') AS chunks FROM documents WHERE length(text) > 0),
rows AS (SELECT doc_id::VARCHAR AS document_id, unnest(range(0, len(chunks))) AS chunk_index, unnest(chunks) AS chunk, len(chunks) AS total_chunks FROM cut)"""


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", chunks.fixed_chunks(F.col("text")))


@query(f"WITH {_WINDOWS} SELECT document_id, chunk FROM rows")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir).select("document_id", "chunk")


@query(f"WITH {_WINDOWS} SELECT document_id, chunk_index, chunk, length(chunk) AS chunk_size, total_chunks FROM rows")
def chunk_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir)


@query(f"WITH {_WINDOWS}, l AS (SELECT length(chunk) AS n, row_number() OVER (ORDER BY length(chunk)) AS r, count(*) OVER () AS c FROM rows) SELECT count(*) AS total_chunks, min(n) AS min_length, max(n) AS max_length, round(avg(n), 6) AS avg_length, min(n) FILTER (r > c // 2) AS median_length, round(count(*) / (SELECT greatest(count(*), 1) FROM documents), 6) AS chunks_per_document FROM l")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunk_rows(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").agg(F.greatest(F.count("*"), F.lit(1)).alias("docs"))
    total = rows.agg(F.count("*").alias("total_chunks"), F.min("chunk_size").alias("min_length"), F.max("chunk_size").alias("max_length"), eda.six(F.avg("chunk_size")).alias("avg_length"))
    full = total.join(F.broadcast(eda.at_indexes(rows, "chunk_size", {"median_length": (1, 2)}))).join(F.broadcast(docs))
    return full.withColumn("chunks_per_document", eda.six(F.col("total_chunks") / F.col("docs"))).drop("docs")


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", chunks.recursive_chunks(F.col("text")))


# a sentence ends with its mark; parts of it go into the chunk before while there is room
_SENTENCES = """RECURSIVE sentences AS (SELECT doc_id, regexp_extract_all(text, '[^。！？]*[。！？]|[^。！？]+') AS s FROM documents WHERE length(text) > 0),
cut AS (SELECT doc_id, flatten(list_transform(s, lambda x: list_transform(range(0, length(x), 500), lambda i: substring(x, i + 1, 500)))) AS parts FROM sentences),
parts AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS p FROM cut),
packed AS (SELECT doc_id, i, 1 AS g, 500 - length(p) AS room FROM parts WHERE i = 1 UNION ALL
    SELECT a.doc_id, b.i, CASE WHEN length(b.p) <= a.room THEN a.g ELSE a.g + 1 END, CASE WHEN length(b.p) <= a.room THEN a.room ELSE 500 END - length(b.p) FROM packed a JOIN parts b ON b.doc_id = a.doc_id AND b.i = a.i + 1)"""


@query(f"""WITH {_SENTENCES}, chunks AS (SELECT doc_id, g, {sql_strip("string_agg(p, '' ORDER BY i)")} AS chunk FROM packed JOIN parts USING (doc_id, i) GROUP BY doc_id, g)
SELECT doc_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS chunk_index, chunk, length(chunk)::INT AS chunk_size, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks FROM chunks WHERE chunk <> ''""")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", chunks.sentence_chunks(F.col("text")))


# ---- figures -------------------------------------------------------------------------------------------------------

_LOG = ["event_id", "anonid", "query_text", "clickpos", "pid"]


@query("SELECT count(*) AS total_records, 5::BIGINT AS n_columns, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS nulls_{c}" for c in _LOG) + f", count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_LOG)} FROM click_log)) AS duplicate_count FROM click_log")
def basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.basic_stats(table(spark, sf_dir, "click_log").select(*_LOG))


@query("SELECT min(n) AS min_length, max(n) AS max_length, round(avg(n), 6) AS mean_length, round(median(n), 6) AS median_length, round(stddev_samp(n), 6) AS std_length, " + ", ".join(f"trunc(quantile_cont(n, {p / 100}))::INT AS p{p}" for p in (25, 50, 75, 90)) + " FROM (SELECT length(coalesce(text, 'None')) AS n FROM documents)")
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.document_length(table(spark, sf_dir, "documents").select(F.col("text").alias("content")))


@query("SELECT count(*) AS unique_queries, count(*) FILTER (n = 1) AS appearing_once, count(*) FILTER (n BETWEEN 2 AND 5) AS appearing_2_5, count(*) FILTER (n BETWEEN 6 AND 10) AS appearing_6_10, count(*) FILTER (n > 10) AS appearing_more_than_10 FROM (SELECT query_text, count(*) AS n FROM click_log WHERE query_text IS NOT NULL GROUP BY ALL)")
def query_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.query_distribution(table(spark, sf_dir, "click_log"), "query_text")


def _top(name: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return eda.most_common(table(spark, sf_dir, "click_log"), column)

    run.__name__ = name
    query(f"SELECT {column} AS value, count(*) AS n FROM click_log WHERE {column} IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 10")(run)


_top("top_queries", "query_text")
_top("top_users", "anonid")
_top("click_positions", "clickpos")


@query("SELECT count(*) AS unique_users, round(avg(n), 6) AS avg_queries_per_user, round(median(n), 6) AS median_queries_per_user, count(*) FILTER (n = 1) AS users_with_single_query FROM (SELECT anonid, count(*) AS n FROM click_log WHERE anonid IS NOT NULL GROUP BY ALL)")
def user_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.user_behavior(table(spark, sf_dir, "click_log"), "anonid")


@query("SELECT count(clickpos) AS total_clicks, round(avg(clickpos), 6) AS avg_click_position, round(median(clickpos), 6) AS median_click_position, count(*) FILTER (clickpos = 1) AS first_position_clicks FROM click_log")
def click_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.click_behavior(table(spark, sf_dir, "click_log"), "clickpos")


def _sql_at(n: str, a: int, b: int) -> str:
    return f"min({n}) FILTER (r > c * {a} // {b})"


@query(f"""SELECT count(*) AS total, count(*) FILTER (html) AS with_html, round(avg(html::INT) * 100, 6) AS with_html_pct, min(n) AS min_length, max(n) AS max_length, round(avg(n), 6) AS avg_length,
{', '.join(f"count(*) FILTER (n > {k}) AS over_{k}, round(avg((n > {k})::INT) * 100, 6) AS over_{k}_pct" for k in (500, 1000, 2000))}, {_sql_at('n', 1, 2)} AS median_length, {_sql_at('n', 1, 4)} AS p25, {_sql_at('n', 3, 4)} AS p75, {_sql_at('n', 9, 10)} AS p90
FROM (SELECT length(text) AS n, contains(text, '<br') OR contains(text, '<img') OR contains(text, '<div') OR contains(text, '<p>') AS html, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS c FROM passage_collection WHERE text IS NOT NULL)""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.collection_stats(table(spark, sf_dir, "passage_collection"))


@query(f"SELECT count(*) AS n_articles, min(length) AS min_length, max(length) AS max_length, round(avg(length), 6) AS mean_length, {_sql_at('length', 1, 4)} AS p25, {_sql_at('length', 1, 2)} AS p50, {_sql_at('length', 3, 4)} AS p75 FROM (SELECT length, row_number() OVER (ORDER BY length) AS r, count(*) OVER () AS c FROM wikipedia_articles WHERE length IS NOT NULL)")
def article_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.article_stats(table(spark, sf_dir, "wikipedia_articles"))


_REPORT = {
    "basic_stats": "SELECT count(*) AS total_records, 1 AS n_columns, count(*) - count(text) AS nulls_content, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS duplicate_count FROM documents",
    "document_length": ORACLE["doc_length_stats"],
    "query_distribution": ORACLE["query_distribution"],
    "user_behavior": ORACLE["user_behavior"],
    "click_behavior": ORACLE["click_behavior"],
}


@query("SELECT json_object(" + ", ".join(f"'{name}', (SELECT to_json(x) FROM ({sql}) x)" for name, sql in _REPORT.items()) + ")::VARCHAR AS report")
def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "click_log").select(F.col("query_text").alias("Query"), F.col("anonid").alias("AnonID"), F.col("clickpos").alias("ClickPos"))
    return eda.report(table(spark, sf_dir, "documents").select(F.col("text").alias("content")), log)


# ---- dense search --------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _sql_dense(k: int, where: str = "true", distance: str = "list_cosine_distance", source: str = "SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 100 = 0") -> str:
    return f"""SELECT qid, id, distance, rank FROM (SELECT q.qid, v.vec_id AS id, round({distance}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS distance,
    row_number() OVER (PARTITION BY q.qid ORDER BY round({distance}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9), v.vec_id)::INT AS rank FROM ({source}) q, embeddings v WHERE {where}) WHERE rank <= {k}"""


_DENSE_SELF = _sql_dense(10, "q.qid <> v.vec_id")


@query(f"SELECT qid, id, distance, rank FROM ({_sql_dense(10)})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.search(_vectors(spark, sf_dir), _asked(spark, sf_dir))


@query(f"SELECT qid, id, distance, rank FROM ({_sql_dense(5, distance='list_distance')})")
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5, "l2")


@query(f"SELECT qid, id, distance, rank FROM ({_sql_dense(10)}) WHERE round(1 - distance, 9) >= 0.3")
def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.above(dense.search(_vectors(spark, sf_dir), _asked(spark, sf_dir)))


@lru_cache(maxsize=4)
def _cells(spark: SparkSession, sf_dir: str) -> cells.CellIndex:
    return cells.build_cells(_vectors(spark, sf_dir))


@query()
def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search; ``dense_topk`` is the exact one."""
    return cells.search_cells(_cells(spark, sf_dir), _asked(spark, sf_dir))


@query()
def dense_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search against the exact one, every vector asked."""
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return cells.recall(cells.search_cells(_cells(spark, sf_dir), every), dense.search(_vectors(spark, sf_dir), every))


@query("SELECT vec_id, dim, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding::DOUBLE[]) AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(dense.l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query("SELECT count(*) AS document_count FROM embeddings")
def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.index_count(_vectors(spark, sf_dir))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc_"), "vec_id").alias("id"), F.concat(F.lit("text "), F.col("label").cast("string")).alias("document"))


@query("""SELECT 'doc_' || vec_id AS id, 'text ' || label AS document FROM embeddings UNION ALL
SELECT 'doc_' || ((SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY doc_id)), text FROM documents""")
def index_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.add_documents(_named(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document")), "doc_id")


@query("SELECT 'doc_' || vec_id AS id, 'text ' || label AS document FROM embeddings WHERE vec_id % 7 <> 0")
def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.delete_documents(_named(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select(F.concat(F.lit("doc_"), "vec_id").alias("id")))


@query("SELECT 'doc_' || vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'new ' || vec_id ELSE 'text ' || label END AS document FROM embeddings")
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select(F.concat(F.lit("doc_"), "vec_id").alias("id"), F.concat(F.lit("new "), F.col("vec_id").cast("string")).alias("document"))
    return dense.update_documents(_named(spark, sf_dir), changes)


# ---- lexical search ------------------------------------------------------------------------------------------------


def _passages(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Each passage once, or those of ``only (id)``; of copies that differ the greater text."""
    raw = table(spark, sf_dir, "passage_collection").select("pid", "text")
    raw = spread(raw) if only is None else raw.join(only.select(F.col("id").alias("pid")), "pid", "left_semi")
    rows = raw.select("pid", text.once(text.strip_tags(F.col("text"))).alias("text")).where("length(text) >= 10")
    return rows.groupBy(F.col("pid").alias("doc")).agg(F.max("text").alias("text"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "queries_dev").where("try_cast(qid as bigint) % 100 = 0").select("qid", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("qid").agg(F.max("text").alias("text"))


_PASSAGES = f"passages AS (SELECT pid AS doc, max(t) AS text FROM (SELECT pid, {sql_tags('text')} AS t FROM passage_collection) WHERE length(t) >= 10 GROUP BY pid)"
_QUESTIONS = "questions AS (SELECT qid, max(coalesce(text, '')) AS text FROM queries_dev WHERE try_cast(qid AS BIGINT) % 100 = 0 GROUP BY qid)"


def _sql_bm25(split) -> str:
    return f"""{_PASSAGES}, {_QUESTIONS},
split AS (SELECT doc, {split('text')} AS terms FROM passages), lengths AS (SELECT doc, len(terms) AS dl FROM split), corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM split) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT n_docs FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({split('text')}) AS term FROM questions) GROUP BY ALL),
scored AS (SELECT qid, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM corpus)))), 6) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc) GROUP BY ALL),
every AS (SELECT * FROM scored UNION ALL SELECT q.qid, p.doc, 0.0 FROM (SELECT qid FROM questions) q, (SELECT doc FROM passages ORDER BY doc LIMIT 50) p WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.qid = q.qid AND s.doc = p.doc)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc)::INT AS rank FROM every)"""


_BM25, _BM25_BIGRAMS = _sql_bm25(sql_tokens), _sql_bm25(sql_bigrams)


@lru_cache(maxsize=8)
def lexical_index(spark: SparkSession, sf_dir: str, split=text.bigrams) -> lexical.LexicalIndex:
    """The passages' index, written once in a session and asked by every query of it."""
    return lexical.build_index(_passages(spark, sf_dir), split)


def _ranked(spark: SparkSession, sf_dir: str, split=text.bigrams, k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    index, asked = lexical_index(spark, sf_dir, split), _questions(spark, sf_dir) if asked is None else asked
    return lexical.top_k(lexical.scores(index, asked, split), asked, index.docs, k).withColumnRenamed("doc", "id")


@query(f"WITH {_BM25_BIGRAMS} SELECT count(*) AS n_terms, sum(df)::BIGINT AS n_postings, count(*) FILTER (idf < 0) AS n_negative, round(avg(idf), 6) AS mean_idf, (SELECT n_docs FROM corpus) AS n_docs, (SELECT round(avgdl, 6) FROM corpus) AS avgdl FROM terms")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.index_stats(lexical_index(spark, sf_dir))


@query(f"WITH {_BM25_BIGRAMS} SELECT qid, doc, score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.scores(lexical_index(spark, sf_dir), _questions(spark, sf_dir), text.bigrams)


@query(f"WITH {_BM25_BIGRAMS} SELECT qid, doc AS id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query(f"WITH {_BM25} SELECT qid, doc AS id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, text.tokens)


# ---- evaluation ----------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qrels_retrieval_dev").select("qid", F.col("pid").alias("id"), "rel")


_JUDGED = "judged AS (SELECT DISTINCT qid, pid AS id FROM qrels_retrieval_dev WHERE qid IS NOT NULL AND pid IS NOT NULL AND rel >= 2)"


def _sql_metrics(ranked: str, judged: str, queries: str, by: str = "") -> str:
    ks = (1, 3, 5, 10)
    each = ", ".join(f"count(DISTINCT CASE WHEN r.rank <= {k} AND j.id IS NOT NULL THEN r.id END) AS hits_{k}" for k in ks)
    out = ", ".join(f"round(coalesce(avg(CASE WHEN n_rel > 0 THEN hits_{k} / n_rel ELSE 0 END), 0), 6) AS recall_{k}, round(coalesce(avg(hits_{k} / {k}), 0), 6) AS precision_{k}, round(coalesce(avg((hits_{k} > 0)::INT), 0), 6) AS hit_{k}" for k in ks)
    return f"""SELECT {by}{', ' if by else ''}count(*) AS n_queries, {out}, round(coalesce(avg(coalesce(1.0 / first, 0)), 0), 6) AS mrr FROM (
    SELECT q.qid{', any_value(q.' + by + ') AS ' + by if by else ''}, {each}, min(CASE WHEN r.rank <= 10 AND j.id IS NOT NULL THEN r.rank END) AS first, (SELECT count(*) FROM {judged} x WHERE x.qid = q.qid) AS n_rel
    FROM {queries} q LEFT JOIN {ranked} r ON r.qid = q.qid LEFT JOIN {judged} j ON j.qid = r.qid AND j.id = r.id GROUP BY q.qid) {'GROUP BY ' + by if by else ''}"""


_LIST = "list AS (SELECT qid, doc AS id, rank FROM ranked WHERE rank <= 10)"


@query(f"WITH {_BM25_BIGRAMS}, {_JUDGED}, {_LIST} SELECT l.qid, l.id, l.rank, j.id IS NOT NULL AS hit FROM list l LEFT JOIN judged j USING (qid, id)")
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.flagged(_ranked(spark, sf_dir).select("qid", "id", "rank"), evaluate.relevant(_judged(spark, sf_dir), 2))


@query(f"WITH {_BM25_BIGRAMS}, {_JUDGED}, {_LIST} " + _sql_metrics("list", "judged", "questions"))
def eval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_ranked(spark, sf_dir), evaluate.relevant(_judged(spark, sf_dir), 2), _questions(spark, sf_dir))


_NORMAL = sql_strip("lower(" + sql_clean("text") + ")")


@query(f"WITH {_BM25_BIGRAMS.replace(_QUESTIONS, f'asked_before AS ({_QUESTIONS[len('questions AS ('):-1]}), questions AS (SELECT qid, {_NORMAL} AS text FROM asked_before)')}, {_JUDGED}, {_LIST} SELECT 'mrr' AS metric, mrr AS after FROM ({_sql_metrics('list', 'judged', 'questions')})")
def rewrite_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reciprocal rank with normalised queries in place of the raw ones."""
    after = _questions(spark, sf_dir).withColumn("text", text.normalize_text(text.clean_text(F.col("text"))))
    return evaluate.metrics(_ranked(spark, sf_dir, asked=after), evaluate.relevant(_judged(spark, sf_dir), 2), after).select(F.lit("mrr").alias("metric"), F.col("mrr").alias("after"))


_TYPED = f"typed AS (SELECT qid, {ORACLE['classify_query'].split('SELECT qid, ')[1].split(' AS result')[0]} AS query_type FROM questions)"


@query(f"WITH {_BM25_BIGRAMS}, {_JUDGED}, {_LIST}, {_TYPED} " + _sql_metrics("list", "judged", "typed", "query_type"))
def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _questions(spark, sf_dir).withColumn("query_type", prompts.classify_query(F.col("text")))
    return evaluate.metrics(_ranked(spark, sf_dir), evaluate.relevant(_judged(spark, sf_dir), 2), typed, by="query_type")


_SAME_LABEL = "same AS (SELECT q.vec_id AS qid, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), asked AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0)"


def _same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    return asked.join(v.select(F.col("vec_id").alias("id"), "label"), "label").where("qid <> id").select("qid", "id")


@query(f"WITH {_SAME_LABEL}, list AS ({_DENSE_SELF}) " + _sql_metrics("list", "same", "asked"))
def eval_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = dense.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), exclude_self=True)
    return evaluate.metrics(ranked, _same_label(spark, sf_dir), _asked(spark, sf_dir))


_M = [*[f"recall_{k}" for k in (1, 3, 5, 10)], "mrr"]


@query(f"WITH {_BM25_BIGRAMS}, {_JUDGED}, {_LIST}, base AS ({_sql_metrics('list', 'judged', 'questions')}), {_SAME_LABEL.replace('asked', 'asked_vectors')}, dense AS ({_DENSE_SELF}), ours AS ({_sql_metrics('dense', 'same', 'asked_vectors')}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, base.{m} AS base, ours.{m} AS ours, round(ours.{m} - base.{m}, 6) AS delta FROM base, ours" for m in _M))
def eval_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.delta(eval_dense(spark, sf_dir), eval_bm25(spark, sf_dir))


_REWRITTEN = _BM25_BIGRAMS.replace(_QUESTIONS, f"asked_before AS ({_QUESTIONS[len('questions AS ('):-1]}), questions AS (SELECT qid, {_NORMAL} AS text FROM asked_before)")


@query("WITH " + ", ".join(f"{name} AS (WITH {lists}, {_JUDGED}, {_LIST} {_sql_metrics('list', 'judged', 'questions')})" for name, lists in (("base", _BM25_BIGRAMS), ("ours", _REWRITTEN))) + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, base.{m} AS base, ours.{m} AS ours, round(ours.{m} - base.{m}, 6) AS delta FROM base, ours" for m in _M))
def rewrite_uplift_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at each k and the reciprocal rank of raw queries (base) and of normalised ones (ours) against one index."""
    before = cut(_questions(spark, sf_dir))
    after = before.withColumn("text", text.normalize_text(text.clean_text(F.col("text"))))
    judged = evaluate.relevant(_judged(spark, sf_dir), 2)

    def metrics(asked: DataFrame) -> DataFrame:
        return evaluate.metrics(_ranked(spark, sf_dir, asked=asked), judged, asked)

    return evaluate.delta(metrics(after), metrics(before))


@query(f"""WITH {_BM25_BIGRAMS}, {_LIST}, graded AS (SELECT qid, pid AS id, max(rel) AS rel FROM qrels_retrieval_dev WHERE qid IS NOT NULL AND pid IS NOT NULL GROUP BY ALL),
ideal AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, id) AS best FROM graded WHERE rel > 0),
got AS (SELECT qid, {', '.join(f'sum(CASE WHEN rank <= {k} THEN (pow(2, rel) - 1) / log2(rank + 1) END) AS dcg_{k}' for k in (5, 10))} FROM list JOIN graded USING (qid, id) GROUP BY qid),
most AS (SELECT qid, {', '.join(f'sum(CASE WHEN best <= {k} THEN (pow(2, rel) - 1) / log2(best + 1) END) AS idcg_{k}' for k in (5, 10))} FROM ideal GROUP BY qid)
SELECT count(*) AS n_queries, {', '.join(f'round(avg(coalesce(dcg_{k} / idcg_{k}, 0)), 6) AS ndcg_{k}' for k in (5, 10))} FROM questions LEFT JOIN got USING (qid) LEFT JOIN most USING (qid)""")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg(_ranked(spark, sf_dir), _judged(spark, sf_dir), _questions(spark, sf_dir))


# ---- fusion: bigram and whitespace rankings of the same passages -----------------------------------------------------

_TWO = f"""one AS (WITH {_BM25_BIGRAMS} SELECT qid, doc AS id, score, rank FROM ranked WHERE rank <= 50), two AS (WITH {_BM25} SELECT qid, doc AS id, score, rank FROM ranked WHERE rank <= 50)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _ranked(spark, sf_dir, text.bigrams, 50), _ranked(spark, sf_dir, text.tokens, 50)


@query(f"""WITH {_TWO}, f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM one UNION ALL SELECT qid, id, rank FROM two) GROUP BY ALL)
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(list(_two(spark, sf_dir)))


_NORM = "(SELECT qid, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM {0} WINDOW w AS (PARTITION BY qid))"


@query(f"""WITH {_TWO}, f AS (SELECT qid, id, round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score FROM {_NORM.format('one')} a FULL JOIN {_NORM.format('two')} b USING (qid, id))
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM f) WHERE rank <= 10""")
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(*_two(spark, sf_dir))


@query(f"WITH {_TWO} SELECT qid, id FROM one UNION SELECT qid, id FROM two")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.pool(list(_two(spark, sf_dir)))


def _hybrid(spark: SparkSession, sf_dir: str, encoder: generation.Encoder | None = None) -> tuple[DataFrame, DataFrame]:
    """The 50 best passages by BM25 and the 50 nearest by the encoder's vectors."""
    asked, encoder = cut(_questions(spark, sf_dir)), encoder or generation.HashingEncoder()
    near = dense.search_texts(_embedded(spark, sf_dir) if isinstance(encoder, generation.HashingEncoder) else dense.embedded(_passages(spark, sf_dir), encoder), asked, encoder, 50)
    return _ranked(spark, sf_dir, k=50, asked=asked), near


@lru_cache(maxsize=4)
def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages' vectors, written once in a session."""
    return dense.embedded(_passages(spark, sf_dir), generation.HashingEncoder())



@query()
def hybrid_rrf_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(list(_hybrid(spark, sf_dir)))


@query()
def hybrid_weighted_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(*_hybrid(spark, sf_dir))


@query()
def pool_union_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.pool(list(_hybrid(spark, sf_dir)))


@query(f"""WITH RECURSIVE near AS ({_sql_dense(20)}),
hit AS (SELECT n.qid, n.id, n.rank AS was, v.embedding::DOUBLE[] AS e, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS near FROM near n JOIN embeddings v ON v.vec_id = n.id JOIN embeddings q ON q.vec_id = n.qid),
alike AS (SELECT a.qid, a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM hit a JOIN hit b USING (qid)),
picked AS (SELECT qid, id, 1 AS rank, [id] AS chosen FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * near, 9) DESC, was) AS n FROM hit) WHERE n = 1 UNION ALL
    SELECT qid, id, rank + 1, list_append(chosen, id) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(0.5 * near - 0.5 * s, 9) DESC, was) AS n FROM (
        SELECT p.qid, p.rank, p.chosen, h.id, h.was, h.near, max(a.s) AS s FROM picked p JOIN hit h ON h.qid = p.qid AND NOT list_contains(p.chosen, h.id) JOIN alike a ON a.qid = h.qid AND a.id = h.id AND list_contains(p.chosen, a.other)
        WHERE p.rank < 10 GROUP BY ALL)) WHERE n = 1)
SELECT qid, id, rank::INT AS rank FROM picked""")
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, asked = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    return fusion.mmr(dense.search(v, asked, 20), v, asked)


# ---- users ---------------------------------------------------------------------------------------------------------


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'click'")
    return rows.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("id"))


_CLICKS = "clicks AS (SELECT event_id, ts, user_id, json_extract_string(props, '$.k')::BIGINT AS id FROM events WHERE event_type = 'click')"


def _sql_mean(source: str) -> str:
    return f"(SELECT user_id, dim::INT AS dim, avg(x) AS x FROM (SELECT user_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM {source} c JOIN embeddings v ON c.id = v.vec_id) GROUP BY ALL)"


def _flat(users: DataFrame) -> DataFrame:
    return users.select("user_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_CLICKS} SELECT user_id, dim, round(x, 6) AS x FROM {_sql_mean('clicks')}")
def user_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(profile.mean_vector(_clicks(spark, sf_dir), _vectors(spark, sf_dir)))


@query(f"WITH {_CLICKS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM clicks) WHERE n <= 5) SELECT user_id, dim, round(x, 6) AS x FROM {_sql_mean('last')}")
def user_vector_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(profile.mean_vector(profile.recent(_clicks(spark, sf_dir), 5, "ts", "event_id"), _vectors(spark, sf_dir)))


def _personal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users whose id is divisible by 100 ask with the vector of that id."""
    users = profile.mean_vector(_clicks(spark, sf_dir), _vectors(spark, sf_dir))
    asked = _asked(spark, sf_dir).withColumn("user_id", F.col("qid"))
    return profile.personal_queries(users, asked), asked


_PERSONAL = f"""{_CLICKS}, users AS (SELECT user_id, array_agg(x ORDER BY dim) AS u FROM {_sql_mean('clicks')} GROUP BY user_id),
personal AS (SELECT vec_id AS qid, list_transform(range(1, len(u) + 1), lambda i: round(u[i] * 0.7 + embedding[i]::DOUBLE * (1 - 0.7), 9)) AS embedding FROM embeddings JOIN users ON user_id = vec_id WHERE vec_id % 100 = 0)"""


@query(f"WITH {_PERSONAL}, p AS ({_sql_dense(10, source='SELECT * FROM personal')}), s AS ({_sql_dense(10)}) SELECT qid, id FROM p UNION SELECT qid, id FROM s WHERE qid IN (SELECT qid FROM personal)")
def personal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, plain = _personal(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    return profile.merged_recall([dense.search(v, asked), dense.search(v, plain.join(asked.select("qid"), "qid", "left_semi"))])


@query(f"""WITH {_PERSONAL}, {_SAME_LABEL}, mine AS (SELECT qid FROM personal), p AS ({_sql_dense(10, 'q.qid <> v.vec_id', source='SELECT * FROM personal')}), s AS ({_DENSE_SELF}), a AS ({_sql_metrics('p', 'same', 'mine')}), b AS ({_sql_metrics('s', 'same', 'mine')})
SELECT a.hit_10 AS personal, b.hit_10 AS standard, round(CASE WHEN b.hit_10 <> 0 THEN (a.hit_10 - b.hit_10) / b.hit_10 * 100 END, 6) AS gain_pct FROM a, b""")
def personal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, plain = _personal(spark, sf_dir)
    v, judged = _vectors(spark, sf_dir), _same_label(spark, sf_dir)
    a = evaluate.metrics(dense.search(v, asked, exclude_self=True), judged, asked)
    return evaluate.personalized_gain(a, evaluate.metrics(dense.search(v, plain, exclude_self=True), judged, asked))


@query("SELECT anonid AS user_id, string_agg(query_text, chr(10) ORDER BY n DESC) AS context FROM (SELECT anonid, query_text, row_number() OVER (PARTITION BY anonid ORDER BY logged_at DESC, event_id DESC) AS n FROM (SELECT DISTINCT event_id, anonid, query_text, logged_at FROM click_log) WHERE anonid IS NOT NULL AND query_text IS NOT NULL) WHERE n <= 3 GROUP BY anonid")
def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "click_log").select("event_id", "anonid", "query_text", "logged_at").distinct()
    return profile.recent_context(log, "anonid", "query_text", 3, "logged_at", "event_id")


@query()
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = cut(_ranked(spark, sf_dir, k=20))
    lengths = _passages(spark, sf_dir, ranked).select(F.col("doc").alias("id"), F.length("text").cast("double").alias("n_chars"))
    popular = table(spark, sf_dir, "click_log").where("pid is not null").groupBy(F.col("pid").alias("id")).agg(F.count("*").cast("double").alias("clicks"))
    rows = ranked.join(lengths, "id").join(popular, "id", "left").fillna(0.0, ["clicks"]).select("qid", "id", F.col("score").alias("bm25"), F.col("rank").cast("double").alias("was"), "n_chars", "clicks")
    judged = _judged(spark, sf_dir).groupBy("qid", "id").agg(F.max("rel").cast("double").alias("rel"))
    labelled = rows.join(judged, ["qid", "id"], "left").fillna(0.0, ["rel"])
    return profile.rerank_held_out(labelled, ["bm25", "was", "n_chars", "clicks"], "rel").select("qid", "id", "rank")


# ---- prompts -------------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best passages of each question."""
    ranked = cut(_ranked(spark, sf_dir, k=5))
    return ranked.join(_passages(spark, sf_dir, ranked).withColumnRenamed("doc", "id"), "id").select("qid", "rank", F.col("id").alias("pid"), F.concat(F.lit("p"), "id").alias("source"), F.col("text").alias("content"))


_HITS = f"{_BM25_BIGRAMS}, hits AS (SELECT qid, rank, doc AS pid, 'p' || doc AS source, text AS content FROM ranked JOIN passages USING (doc) WHERE rank <= 5)"
_TRIM = """sums AS (SELECT *, sum(length(content)) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM hits),
overs AS (SELECT *, count(*) FILTER (upto > 3000) OVER (PARTITION BY qid ORDER BY rank) AS n_over, 3000 - (upto - length(content)) AS room FROM sums),
trimmed AS (SELECT qid, rank, pid, source, CASE WHEN upto <= 3000 THEN content ELSE substring(content, 1, room::BIGINT) || '...' END AS content FROM overs WHERE n_over = 0 OR (n_over = 1 AND upto > 3000 AND room > 200)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM trimmed),
contexts AS (SELECT qid, string_agg('[' || i || '] 来源: ' || source || chr(10) || substring(content, 1, 600), chr(10) || chr(10) ORDER BY rank) AS context FROM numbered GROUP BY qid)"""


@query(f"WITH {_HITS}, {_TRIM} SELECT qid, rank, pid, content FROM trimmed")
def trim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.trim_context(_hits(spark, sf_dir)).select("qid", "rank", "pid", "content")


@query(f"WITH {_HITS}, {_TRIM} SELECT qid, context FROM contexts")
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.format_context(prompts.trim_context(_hits(spark, sf_dir)))


_TYPE_OF = ORACLE["classify_query"].split("SELECT qid, ")[1].split(" AS result")[0]
_SYSTEM = "CASE query_type " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in prompts.PROMPTS.items()) + " END"


@query(f"SELECT qid, {_SYSTEM} AS system_prompt FROM (SELECT qid, {_TYPE_OF} AS query_type FROM queries_dev)")
def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries_dev").select("qid", prompts.system_prompt(prompts.classify_query(F.col("text"))).alias("system_prompt"))


def _sql_filled(template: str, **values: str) -> str:
    out = q(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_USER = _sql_filled(prompts.USER_TEMPLATE, context="coalesce(context, '')", question="text")


@query(f"WITH {_HITS}, {_TRIM} SELECT qid, {_USER} AS user_prompt FROM questions LEFT JOIN contexts USING (qid)")
def user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.rag_prompts(_questions(spark, sf_dir), _hits(spark, sf_dir)).select("qid", "user_prompt")


@query(f"WITH {_HITS}, {_TRIM} SELECT qid, query_type, {_SYSTEM} AS system_prompt, user_prompt FROM (SELECT qid, {_TYPE_OF} AS query_type, {_USER} AS user_prompt FROM questions LEFT JOIN contexts USING (qid))")
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.rag_prompts(_questions(spark, sf_dir), _hits(spark, sf_dir))


@query(f"WITH {_HITS} SELECT qid, string_agg('**[' || rank || '] pid=' || pid || '**' || chr(10) || '> ' || replace(substring(content, 1, 300), chr(10), ' ') || '...' || chr(10) || chr(10), '' ORDER BY rank) AS passages FROM hits GROUP BY qid")
def passages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.passages_markdown(_hits(spark, sf_dir))


@query()
def rag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_hits(spark, sf_dir))
    answers = generation.generate_answers(prompts.rag_prompts(_questions(spark, sf_dir), found), generation.ExtractiveModel())
    return answers.join(prompts.passages_markdown(found), "qid", "left")


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each logged query with its user's last three texts as context; users of a third kind have a profile."""
    log = table(spark, sf_dir, "click_log").select("event_id", "anonid", "query_text", "logged_at").distinct()
    context = profile.recent_context(log, "anonid", "query_text", 3, "logged_at", "event_id").withColumnRenamed("user_id", "anonid")
    # one row per user, with context or without; the busiest users' rows don't move, and rows without a user join nothing
    users = log.where("anonid is not null").groupBy("anonid").agg(F.count("*").alias("n")).join(context, "anonid", "left")
    known = join_hot(log.where("anonid is not null"), users, ["anonid"], "n").drop("n")
    every = known.unionByName(log.where("anonid is null").withColumn("context", F.lit(None).cast("string")))
    profiles = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("用户"), "anonid"))
    return every.select("event_id", F.col("query_text").alias("query"), F.when((F.col("event_id") % 2 == 0) & F.col("context").isNotNull(), F.split("context", "\n")).alias("context"), profiles.alias("user_profile"))


_ASKS = f"""asks AS (WITH c AS ({ORACLE['recent_context']}) SELECT event_id, query_text AS query, CASE WHEN event_id % 2 = 0 THEN context END AS context, CASE WHEN event_id % 3 = 0 THEN '用户' || anonid END AS user_profile FROM (SELECT DISTINCT event_id, anonid, query_text, logged_at FROM click_log) l LEFT JOIN c ON l.anonid = c.user_id)"""
_CHOICE = "CASE WHEN context IS NOT NULL AND user_profile IS NOT NULL THEN 'query_rewrite_full' WHEN context IS NOT NULL THEN 'query_rewrite_context' WHEN user_profile IS NOT NULL THEN 'query_rewrite_personalized' ELSE 'query_rewrite_basic' END"


@query(f"WITH {_ASKS} SELECT event_id, {_CHOICE} AS template FROM asks")
def select_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asks(spark, sf_dir).select("event_id", prompts.select_template(F.col("context"), F.col("user_profile")).alias("template"))


_VALUES = {"query": sql_strip("query"), "context": "context", "user_profile": "user_profile"}


@query(f"WITH {_ASKS} SELECT event_id, CASE WHEN coalesce({sql_strip('query')}, '') = '' THEN NULL ELSE CASE template " + " ".join(f"WHEN '{n}' THEN {_sql_filled(prompts.TEMPLATES[n], **_VALUES)}" for n in ("query_rewrite_full", "query_rewrite_context", "query_rewrite_personalized", "query_rewrite_basic")) + f" END END AS prompt FROM (SELECT *, {_CHOICE} AS template FROM asks)")
def rewrite_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asks(spark, sf_dir).select("event_id", prompts.rewrite_prompt(F.col("query"), F.col("context"), F.col("user_profile")).alias("prompt"))


def _sql_keywords(c: str) -> str:
    plain = c
    for word in generation.FILLERS:
        plain = f"replace({plain}, {q(word)}, ' ')"
    return f"coalesce(nullif(array_to_string({sql_tokens(plain)}, ' '), ''), {sql_strip(c)})"


@query(f"SELECT qid, query, CASE WHEN coalesce({sql_strip('query')}, '') = '' THEN query ELSE {_sql_keywords('line')} END AS rewritten FROM (SELECT qid, text AS query, regexp_extract({sql_strip('text')}, '^[^\\n]*') AS line FROM queries_dev)")
def rewrite_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "queries_dev").select("qid", F.col("text").alias("query"))
    prompt = prompts.rewrite_prompt(F.col("query"), F.array().cast("array<string>"), F.lit(""))
    return generation.rewrite_queries(rows, prompt, generation.ExtractiveModel())


@query()
def embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries_dev").select("qid", generation.embed(F.col("text"), generation.HashingEncoder()).alias("embedding"))
