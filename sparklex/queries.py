"""The registered queries of the search engine, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions.text import has, has_ngrams, ngrams
from sparklex.functions.values import canonical, epoch, like, time_seconds, typed
from sparklex.operators.rank import corpus_counts
from sparklex.operators.table import SearchTable, run
from sparklex.plans.language import boolean, simplified, web
from sparklex.plans.spec import Filter, Highlight, Query, Required, TableSpec, Term
from sparklex.sources.shared import new_path
from sparklex.sources.tables import documents, repeated_keys, synonyms
from sparklex.streaming.changes import checked, folded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, verify: str = "all", labelled: bool = False, kanji: int = 0, **more) -> SearchTable:
    """documents as a search table; its texts are taken as they are, which the SQL can do, too."""
    rows = read(spark, sf_dir, "documents")
    filters = ("lang", "source", "n_chars")
    if labelled:
        rows, filters = rows.join(read(spark, sf_dir, "labels"), "doc_id", "left"), (*filters, "quality", "toxic")
    spec = TableSpec("doc_id", ("text",), filters, verify=verify, kanji=kanji)
    return SearchTable(rows.select("doc_id", *filters, F.col("text").alias("norm_text"), F.col("text").alias("orig_text")), spec, **more)


def grams_sql(term: str, column: str = "text", n: int = 2) -> str:
    return "(" + " AND ".join(f"contains({column}, '{g}')" for g in ngrams(term, n)) + ")"


@query("SELECT doc_id FROM documents WHERE contains(text, 'with') AND lang = 'en' ORDER BY doc_id DESC LIMIT 10")
def search_filter_page(spark, sf_dir):
    return docs(spark, sf_dir).search(Query("with", filters=(Filter("lang", "=", "en"),), limit=10))


@query(f"SELECT doc_id FROM documents WHERE {grams_sql('data')}")
def ngram_and(spark, sf_dir):
    return docs(spark, sf_dir, "off").matches(Query("data")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'wh') OR contains(text, 'qu')")
def ngram_or(spark, sf_dir):
    t = docs(spark, sf_dir, "off")
    return t.matches(Query(expression=Term("wh") | Term("qu"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT (contains(text, 'wh') OR contains(text, 'qu'))")
def ngram_not(spark, sf_dir):
    return docs(spark, sf_dir, "off").matches(Query(none=("wh", "qu"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE " + " + ".join(f"contains(text, '{g}')::INT" for g in ngrams("shingle")) + " >= 4")
def ngram_threshold(spark, sf_dir):
    return docs(spark, sf_dir).rows.where(has_ngrams(F.col("norm_text"), "shingle", at_least=4)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'with') AND contains(text, 'that') ORDER BY doc_id DESC LIMIT 10 OFFSET 5")
def search_verified_topk(spark, sf_dir):
    return docs(spark, sf_dir).search(Query("with", all=("that",), limit=10, offset=5))


@query(f"SELECT doc_id FROM documents WHERE contains(text, 'with') AND NOT {grams_sql('from')}")
def not_by_ngrams(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query("with", none=("from",))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'q')")
def short_term(spark, sf_dir):
    return docs(spark, sf_dir, "off").matches(Query("q")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {grams_sql('with')} AND contains(text, 'with')")
def verify_ascii(spark, sf_dir):
    return docs(spark, sf_dir, "ascii").matches(Query("with")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE (contains(text, 'with') AND contains(text, 'that') OR contains(text, 'elle')) AND NOT {grams_sql('from')}")
def boolean_expression(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query(expression=((Term("with") & Term("that")) | Term("elle")) & ~Term("from"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'with') OR contains(text, 'from')")
def synonym_or(spark, sf_dir):
    spec = TableSpec("doc_id", ("text",))
    return docs(spark, sf_dir, synonyms=synonyms(["with\tfrom"], spec)).matches(Query("with")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars >= 1500 AND n_chars < 3000 AND lang <> 'fr'")
def filter_range(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query(filters=(Filter("n_chars", ">=", "1500"), Filter("n_chars", "<", "3000"), Filter("lang", "!=", "fr")))).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def filter_ne_null(spark, sf_dir):
    return docs(spark, sf_dir, labelled=True).matches(Query(filters=(Filter("quality", "!=", "1"),))).select("doc_id")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def filter_eq_null(spark, sf_dir):
    return docs(spark, sf_dir, labelled=True).matches(Query(filters=(Filter("TOXIC", "EQ", "1"),))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE false")
def filter_bad_number(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query(filters=(Filter("n_chars", "!=", "many"),))).select("doc_id")


@query("SELECT doc_id FROM documents")
def filter_unknown_column(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query(filters=(Filter("nothing", "!=", "1"),))).select("doc_id")


@query("SELECT event_id FROM events WHERE value > 20.5 AND value < 110 AND event_type = 'click'")
def filter_double(spark, sf_dir):
    spec = TableSpec("event_id", ("props",), ("value", "event_type"), verify="all")
    t = SearchTable(read(spark, sf_dir, "events").select("event_id", "value", "event_type", F.col("props").alias("norm_text")), spec)
    return t.matches(Query(filters=(Filter("value", ">", "20.5"), Filter("value", "<", "110"), Filter("value", ">", "-10"), Filter("event_type", "=", "click")))).select("event_id")


@query("SELECT count(*) AS total FROM documents WHERE contains(text, 'the')")
def count_term(spark, sf_dir):
    return docs(spark, sf_dir).count(Query("the"))


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def facet_all(spark, sf_dir):
    return docs(spark, sf_dir).facet("lang")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE contains(text, 'with') GROUP BY 1 ORDER BY n DESC, value LIMIT 5 OFFSET 2")
def facet_matches(spark, sf_dir):
    return docs(spark, sf_dir).facet("source", Query("with", limit=5, offset=2))


@query("SELECT doc_id, n_chars FROM documents WHERE contains(text, 'with') ORDER BY n_chars, doc_id LIMIT 20")
def sort_by_column(spark, sf_dir):
    return docs(spark, sf_dir).search(Query("with", sort="n_chars", ascending=True, limit=20))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id DESC LIMIT 50")
def sort_nulls(spark, sf_dir):
    return docs(spark, sf_dir, labelled=True).search(Query(sort="quality", limit=50))


def _bm25_sql(terms: list[str]) -> str:
    df = ", ".join(f"count(*) FILTER (contains(text, '{t}'))::DOUBLE AS df{i}" for i, t in enumerate(terms))
    score = " + ".join(f"ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(mean, 1)))" for i in range(len(terms)))
    tf = ", ".join(f"((length(text) - length(replace(text, '{t}', ''))) / {len(t)})::INT::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    return f"WITH s AS (SELECT count(*) FILTER (text <> '')::DOUBLE AS n, sum(length(text))::DOUBLE / count(*) FILTER (text <> '') AS mean, {df} FROM documents), d AS (SELECT doc_id, text, length(text)::DOUBLE AS len, {tf} FROM documents) SELECT doc_id, round({score}, 6) AS score FROM d, s WHERE " + " AND ".join(f"contains(text, '{t}')" for t in terms)


@query(_bm25_sql(["with", "that"]))
def bm25_scores(spark, sf_dir):
    return docs(spark, sf_dir).scored(Query("with", all=("that",))).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM ({_bm25_sql(['with'])}) ORDER BY score DESC, doc_id DESC LIMIT 20")
def bm25_top(spark, sf_dir):
    return docs(spark, sf_dir).search(Query("with", sort="score", limit=20)).select("doc_id")


@query("SELECT count(*) AS docs, sum(length(text))::BIGINT AS length, count(*) FILTER (contains(text, 'with')) AS df FROM documents WHERE text <> ''")
def corpus_statistics(spark, sf_dir):
    return corpus_counts(docs(spark, sf_dir).rows, ["with"], 2).select("docs", "length", F.col("df")[0].alias("df"))


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w FROM documents WHERE contains(text, 'wi')::INT + contains(text, 'it')::INT + contains(text, 'th')::INT >= 2) WHERE levenshtein(w, 'with') <= 1 OR contains(w, 'with')")
def fuzzy_verified(spark, sf_dir):
    enough = has_ngrams(F.col("norm_text"), "with", at_least=2)
    words = F.split(F.col("norm_text"), "[ \\t\\r\\n]+")
    near = F.exists(words, lambda w: F.levenshtein(w, F.lit("with"), 1) >= 0) | has(F.col("norm_text"), "with")
    return docs(spark, sf_dir).rows.where(enough & near).select("doc_id")


@query(r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \t\r\n\x{3000}\x{00A0}]+')) AS w FROM documents WHERE contains(text, 'wi')::INT + contains(text, 'it')::INT + contains(text, 'th')::INT >= 2),
p AS (SELECT doc_id, w, regexp_replace(w, '[^\x00-\x7F]', '#', 'g') AS p FROM w)
SELECT DISTINCT doc_id FROM p WHERE levenshtein(p, 'with') <= 1 OR contains(w, 'with')
OR (strlen(w) > length(w) AND len(list_filter(generate_series(1, length(p)), lambda i: (i + 2 <= length(p) AND levenshtein(substring(p, i, 3), 'with') <= 1) OR (i + 3 <= length(p) AND levenshtein(substring(p, i, 4), 'with') <= 1) OR (i + 4 <= length(p) AND levenshtein(substring(p, i, 5), 'with') <= 1))) > 0)
""")
def fuzzy_windows(spark, sf_dir):
    # with ideographs of one character, a distance of one costs a term one n-gram
    return docs(spark, sf_dir, kanji=1).matches(Query("with", fuzzy=1)).select("doc_id")


@query()
def fuzzy_search(spark, sf_dir):
    """Beyond ASCII, words match by any window, which SQL can't say within reason; tested against a plain edit distance."""
    return docs(spark, sf_dir).matches(Query("thsi", fuzzy=1)).select("doc_id")


@query("SELECT p_partkey, p_name || ' ' || p_brand AS orig_text FROM part WHERE p_size > 10 AND contains(p_name || ' ' || p_brand, 'Brand')")
def concatenated_source(spark, sf_dir):
    spec = TableSpec("p_partkey", ("p_name", "p_brand"), ("p_size",), verify="all", required=(Filter("p_size", ">", "10"),))
    return SearchTable.of(read(spark, sf_dir, "part"), spec).matches(Query("Brand")).select("p_partkey", "orig_text")


@query("SELECT ngram, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, length(text) - 1), lambda i: substring(text, i, 2)))) AS ngram FROM documents WHERE length(text) >= 2) GROUP BY 1")
def posting_sizes(spark, sf_dir):
    return docs(spark, sf_dir).posting_sizes()


@query("WITH p AS (SELECT ngram, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, length(text) - 1), lambda i: substring(text, i, 2)))) AS ngram FROM documents WHERE length(text) >= 2) GROUP BY 1) SELECT count(*) AS terms, sum(docs)::BIGINT AS postings FROM p")
def index_statistics(spark, sf_dir):
    return docs(spark, sf_dir).statistics()


@query("SELECT doc_id, lang, source, n_chars, text AS orig_text FROM documents WHERE doc_id = 7")
def get_by_key(spark, sf_dir):
    return docs(spark, sf_dir).get(7)


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated(spark, sf_dir):
    return repeated_keys(read(spark, sf_dir, "events").select("user_id"), "user_id").select("user_id")


@query("""
WITH e AS (SELECT user_id AS key, arg_max(event_type, event_id) AS text FROM events GROUP BY 1) SELECT key, text FROM e
""")
def replay_updates(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return folded(e.select(F.col("event_id").alias("seq"), F.lit("UPDATE").alias("op"), F.col("user_id").alias("key"), F.lit(None).cast("long").alias("old_key"), F.col("event_type").alias("text"), F.lit(True).alias("keep")))


@query("""
SELECT key, text FROM (SELECT user_id AS key, arg_min(event_type, event_id) AS text FROM events GROUP BY 1)
""")
def replay_inserts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return folded(e.select(F.col("event_id").alias("seq"), F.lit("INSERT").alias("op"), F.col("user_id").alias("key"), F.lit(None).cast("long").alias("old_key"), F.col("event_type").alias("text"), F.lit(True).alias("keep")))


@query()
def highlighted_page(spark, sf_dir):
    """Snippets are made by a Python function; tested on fixed cases."""
    return docs(spark, sf_dir).search(Query("with", limit=10, highlight=Highlight()))


@query()
def normalized_table(spark, sf_dir):
    """Unicode normalisation, tested against Python's."""
    return documents(read(spark, sf_dir, "documents"), TableSpec("doc_id", ("text",), lower=True)).select("doc_id", "norm_text")


DOC = "SELECT doc_id FROM documents WHERE "


@query(DOC + f"(contains(text, 'with') AND contains(text, 'that') OR contains(text, 'elle')) AND NOT {grams_sql('from')}")
def boolean_text(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query(expression=boolean("(with that OR elle) AND NOT from"))).select("doc_id")


@query(DOC + f"contains(text, 'with') AND NOT {grams_sql('from')} AND (contains(text, 'that') OR contains(text, ' the '))")
def web_expression(spark, sf_dir):
    return docs(spark, sf_dir).matches(Query(expression=boolean(web('+with -from (that OR " the ")')))).select("doc_id")


@query(DOC + f"contains(text, 'with') AND contains(text, 'that') AND NOT {grams_sql('from')}")
def web_flat(spark, sf_dir):
    return docs(spark, sf_dir).matches(simplified("with that -from")).select("doc_id")


def _run(spark, sf_dir: str, text: str) -> DataFrame:
    return run({"documents": docs(spark, sf_dir)}, text)


@query(f"""
WITH m AS (SELECT doc_id, n_chars FROM documents WHERE contains(text, 'with') AND contains(text, 'that') AND NOT {grams_sql('from')} AND lang = 'en' AND n_chars >= 500)
SELECT doc_id, n_chars, (SELECT count(*) FROM m) AS total FROM m ORDER BY n_chars, doc_id LIMIT 10 OFFSET 5
""")
def command_search(spark, sf_dir):
    return _run(spark, sf_dir, "search documents with AND that FILTER lang=en SORT BY n_chars asc NOT from LIMIT 5,10 FILTER n_chars GTE 500")


@query("SELECT count(*) AS total FROM documents WHERE contains(text, 'with') OR contains(text, 'elle')")
def command_count(spark, sf_dir):
    return _run(spark, sf_dir, "COUNT documents with or elle")


@query("SELECT source AS value, count(*) AS n, (SELECT count(DISTINCT source) FROM documents WHERE contains(text, ' the ')) AS values FROM documents WHERE contains(text, ' the ') GROUP BY 1 ORDER BY n DESC, value LIMIT 4 OFFSET 1")
def command_facet(spark, sf_dir):
    return _run(spark, sf_dir, "FACET documents SOURCE ' the ' LIMIT 4 OFFSET 1")


@query("SELECT doc_id, lang, source, n_chars, text AS orig_text FROM documents WHERE doc_id = 12")
def command_get(spark, sf_dir):
    return _run(spark, sf_dir, "GET documents 12")


@query("WITH m AS (SELECT doc_id FROM documents WHERE contains(text, 'with')) SELECT doc_id, (SELECT count(*) FROM m) AS total FROM m ORDER BY doc_id DESC LIMIT 7 OFFSET 3")
def search_with_total(spark, sf_dir):
    return docs(spark, sf_dir).search_with_total(Query("with", limit=7, offset=3))


@query("""
WITH m AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(text, 'with')), p AS (SELECT * FROM m ORDER BY doc_id DESC LIMIT 3),
r AS (SELECT string_agg('{"primary_key":"' || doc_id || '","filters":{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}}', ',' ORDER BY doc_id DESC) AS rs FROM p)
SELECT '{"count":' || (SELECT count(*) FROM m) || ',"limit":3,"offset":0,"results":[' || coalesce(rs, '') || ']}' AS json FROM r
""")
def search_json(spark, sf_dir):
    return docs(spark, sf_dir).search_json(Query("with", limit=3))


@query("SELECT unnest(['all', 'terms', 'exclusions', 'filters', 'verification']) AS stage, unnest([count(*), count(*) FILTER (t), count(*) FILTER (t AND e), count(*) FILTER (t AND e AND f), count(*) FILTER (t AND e AND f AND v)]) AS rows FROM (SELECT " + grams_sql("with") + " AS t, NOT " + grams_sql("from") + " AS e, lang = 'en' AS f, contains(text, 'with') AS v FROM documents)")
def search_funnel(spark, sf_dir):
    return docs(spark, sf_dir).funnel(Query("with", none=("from",), filters=(Filter("lang", "=", "en"),)))


@query("SELECT doc_id::VARCHAR AS key FROM documents WHERE contains(text, 'with') ORDER BY doc_id LIMIT 25")
def digit_keys(spark, sf_dir):
    """Keys that are texts of digits are sorted as numbers."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("norm_text"))
    return SearchTable(rows, TableSpec("key", ("text",), verify="all")).search(Query("with", ascending=True, limit=25))


@query(DOC + f"{grams_sql('with')} AND contains(text, 'with') AND contains(text, 'that') AND lang = 'en'")
def indexed_search(spark, sf_dir):
    """By postings: only the buckets of the terms' n-grams are read, then the rows that have them all."""
    t = docs(spark, sf_dir).indexed(new_path(spark, "postings"), 16)
    return t.matches(Query("with", all=("that",), filters=(Filter("lang", "=", "en"),))).select("doc_id")


@query("SELECT ngram, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, length(text) - 1), lambda i: substring(text, i, 2)))) AS ngram FROM documents WHERE length(text) >= 2) WHERE ngram IN ('wi', 'th', 'zq') GROUP BY 1")
def indexed_posting_sizes(spark, sf_dir):
    return docs(spark, sf_dir).indexed(new_path(spark, "postings"), 16).index.of(["wi", "th", "zq"]).groupBy("ngram").agg(F.count("*").alias("docs"))


@query(f"SELECT doc_id FROM ({_bm25_sql(['with'])}) ORDER BY score DESC, doc_id DESC LIMIT 10")
def saved_search(spark, sf_dir):
    """A search on a table that was saved, verified and loaded again."""
    path = new_path(spark, "table")
    docs(spark, sf_dir).save(path)
    return SearchTable.load(spark, path).search(Query("with", sort="score", limit=10)).select("doc_id")


@query("SELECT user_id, event_type AS orig_text, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value) AS k FROM events) WHERE k = 1")
def load_first_of_key(spark, sf_dir):
    """Insert or ignore: of rows with one key, the first in the order of their texts stays."""
    return SearchTable.of(read(spark, sf_dir, "events"), TableSpec("user_id", ("event_type",), ("value",))).rows.select("user_id", "orig_text", "value")


@query("SELECT event_id, event_type AS orig_text FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND event_type <> 'click' AND props IS NOT NULL AND value <= 50")
def required_filters(spark, sf_dir):
    """Rules of what gets into a table: dates, nulls, numbers."""
    rules = (Required("ts", ">=", "2024-01-15 12:00:00"), Required("event_type", "!=", "click"), Required("props", "is not null"), Required("value", "<=", "50"))
    return SearchTable.of(read(spark, sf_dir, "events"), TableSpec("event_id", ("event_type",), required=rules)).rows.select("event_id", "orig_text")


@query("SELECT event_id, event_type AS orig_text FROM events WHERE false")
def required_fail_closed(spark, sf_dir):
    """A rule on a column that isn't there lets no row in, whatever it asks."""
    return SearchTable.of(read(spark, sf_dir, "events"), TableSpec("event_id", ("event_type",), required=(Required("nothing", "!=", "1"),))).rows.select("event_id", "orig_text")


@query(r"""
WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value::DECIMAL(18, 2)::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN ' ' || event_id WHEN 3 THEN '+' || event_id WHEN 4 THEN '-0' || event_id ELSE event_type END AS v FROM events)
SELECT event_id, CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN v::BIGINT::VARCHAR END AS whole, coalesce(CASE WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]*)?') THEN v::DOUBLE END, -1.5) AS number, v IN ('1', 'true') AS flag FROM e
""")
def typed_filters(spark, sf_dir):
    """Filter values from texts, strictly: what isn't of the type is null."""
    k, v = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = F.when(k == 0, F.col("value").cast("decimal(18,2)").cast("string")).when(k == 1, v).when(k == 2, F.concat(F.lit(" "), v)).when(k == 3, F.concat(F.lit("+"), v)).when(k == 4, F.concat(F.lit("-0"), v)).otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", text.alias("v"))
    return rows.select("event_id", typed(F.col("v"), "bigint").cast("string").alias("whole"), F.coalesce(typed(F.col("v"), "double"), F.lit(-1.5)).alias("number"), typed(F.col("v"), "boolean").alias("flag"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - 32400 AS seconds, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) AS clock, epoch(date_trunc('day', ts))::BIGINT AS day FROM events")
def dates_and_times(spark, sf_dir):
    """Dates as seconds since 1970, here of a zone nine hours ahead, and durations."""
    ts = F.col("ts")
    rows = read(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("t"), F.date_format(ts, "HH:mm:ss").alias("c"), F.date_format(ts, "yyyy-MM-dd").alias("d"))
    return rows.select("event_id", epoch(F.col("t"), "+09:00").alias("seconds"), time_seconds(F.col("c")).alias("clock"), epoch(F.col("d")).alias("day"))


@query("SELECT event_id, value::DECIMAL(18, 2)::VARCHAR AS amount FROM events WHERE event_type ILIKE '%L_C%'")
def canonical_and_like(spark, sf_dir):
    """Decimals with leading zeros are brought to their one form; LIKE in any case."""
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    padded = F.when(amount.startswith("-"), F.concat(F.lit("-000"), F.substring(amount, 2, 40))).otherwise(F.concat(F.lit("000"), amount))
    return read(spark, sf_dir, "events").where(like(F.col("event_type"), "%l_C%")).select("event_id", canonical(padded, "decimal").alias("amount"))


@query("""
WITH e AS (SELECT event_id AS seq, user_id AS key, event_id % 7 AS m, event_id % 5 > 0 AS keep, CASE WHEN event_id % 11 > 0 THEN event_type END AS text, event_type, value FROM events WHERE event_id NOT IN (500, 1200)),
p AS (SELECT seq, key, CASE WHEN m = 0 THEN 'DELETE' WHEN m < 3 THEN 'INSERT' ELSE 'UPDATE' END AS op, text, value, m <> 5 AND (m > 2 OR keep) AS keep FROM e WHERE m < 6
      UNION ALL SELECT seq, key, 'DELETE', NULL, NULL, true FROM e WHERE m = 6 UNION ALL SELECT seq, key + 1, 'INSERT', event_type, value, true FROM e WHERE m = 6
      UNION ALL SELECT -1, key, 'INSERT', 'base', 0.0, true FROM (SELECT DISTINCT user_id AS key FROM events WHERE user_id < 300)),
q AS (SELECT * FROM p WHERE seq > (SELECT coalesce(max(event_id), -2) FROM events WHERE event_id IN (500, 1200))),
g AS (SELECT key, max(seq) AS gone FROM q WHERE op = 'DELETE' OR op = 'UPDATE' AND NOT keep GROUP BY 1),
u AS (SELECT q.* FROM q LEFT JOIN g USING (key) WHERE (gone IS NULL OR seq > gone) AND keep AND op <> 'DELETE')
SELECT key, coalesce(arg_max(text, seq) FILTER (op = 'UPDATE' AND text IS NOT NULL), arg_min_null(text, seq)) AS text,
       CASE WHEN count(*) FILTER (op = 'UPDATE') > 0 THEN arg_max_null(value, seq) FILTER (op = 'UPDATE') ELSE arg_min_null(value, seq) END AS value FROM u GROUP BY 1
""")
def replay_log(spark, sf_dir):
    """All operations, moves of keys, rows that fail the rules, a TRUNCATE and a base, with a carried column."""
    e = read(spark, sf_dir, "events")
    i, m = F.col("event_id"), F.col("event_id") % 7
    op = F.when(i.isin(500, 1200), "TRUNCATE").when(m == 0, "DELETE").when(m < 3, "INSERT").otherwise("UPDATE")
    moved = (m == 6) & (op == "UPDATE")
    log = e.select(
        i.alias("seq"), op.alias("op"), F.when(moved, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("key"), F.when(moved, F.col("user_id")).alias("old_key"),
        F.when(moved | (i % 11 > 0), F.col("event_type")).alias("text"), ((m != 5) & ((m > 2) | (i % 5 > 0))).alias("keep"), "value",
    )
    base = e.where("user_id < 300").select(F.col("user_id").alias("key"), F.lit("base").alias("text"), F.lit(0.0).alias("value")).distinct()
    return folded(log, base, carry=("value",))


@query("SELECT 'no key' AS kind, count(*) AS n FROM events WHERE user_id % 10 = 3 HAVING count(*) > 0 UNION ALL SELECT 'no such op', count(*) FROM events WHERE event_type = 'click' AND user_id % 10 <> 3 HAVING count(*) > 0 UNION ALL SELECT 'seq twice', count(DISTINCT event_id // 2) FROM events WHERE event_id // 2 IN (SELECT event_id // 2 FROM events GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def checked_log(spark, sf_dir):
    """What keeps a change log from being replayed."""
    bad = F.when(F.col("user_id") % 10 == 3, "INSERT").when(F.col("event_type") == "click", "MERGE").otherwise("DELETE")
    log = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("seq"), bad.alias("op"), F.when(F.col("user_id") % 10 != 3, F.col("user_id")).alias("key"))
    return checked(log)
