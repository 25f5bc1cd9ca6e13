"""Queries for the driver, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.functions import text as T
from quern.operators import chunks, confidence, coverage, feedback, keywords, models, plans, profile, questions, relations, results, vectors
from quern.sources import collections
from quern.sources.tables import table, written
from quern.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STOP = ["the", "and", "of", "to", "in", "is", "that", "it", "for", "de", "la", "der", "die", "und"]
IMPORTANT = ["license", "License", "token", "that"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _best(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return vectors.best(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"))


_VEC = "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"
_BEST = f"(SELECT a.vec_id, max(round(list_cosine_similarity(a.e, b.e), 6)) AS best FROM ({_VEC}) a, ({_VEC}) b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1)"
_NEAR = f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank, vec_id, sim FROM (SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(q.e, p.e), 6) AS sim FROM ({_VEC}) q, ({_VEC}) p WHERE q.vec_id % 20 = 0)"


def _levels(profile_name: str) -> str:
    rows = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in coverage.PROFILES[profile_name].items())
    return f"SELECT level, threshold, count(*) FILTER (best >= threshold) AS covered, count(*) AS total, round(avg((best >= threshold)::INT::DOUBLE), 6) AS rate FROM {_BEST}, (VALUES {rows}) t(level, threshold) GROUP BY 1, 2"


@query(_levels("rule"))
def coverage_levels(s, d):
    return coverage.levels(_best(s, d), "rule")


@query(_levels("default"))
def coverage_levels_default(s, d):
    return coverage.levels(_best(s, d), "default")


@query(f"SELECT vec_id, best, round(0.35 - best, 6) AS gap FROM {_BEST} WHERE best < 0.35")
def coverage_uncovered(s, d):
    return coverage.uncovered(_best(s, d), 0.35)


@query(f"SELECT CASE WHEN best >= 0.9 THEN 'excellent' WHEN best >= 0.8 THEN 'good' WHEN best >= 0.7 THEN 'fair' WHEN best >= 0.6 THEN 'poor' ELSE 'uncovered' END AS grade, count(*) AS chunks FROM {_BEST} GROUP BY 1")
def coverage_grades(s, d):
    return coverage.grades(_best(s, d))


@query(f"SELECT round(avg(best), 6) AS mean, round(median(best), 6) AS median, min(best) AS least, max(best) AS most, round(avg(best) * 0.4 + avg((best >= 0.4)::INT::DOUBLE) * 0.3 + greatest(0, 1 - stddev_pop(best)) * 0.3, 6) AS quality FROM {_BEST}")
def coverage_quality(s, d):
    return coverage.quality(_best(s, d), 0.4)


@query(f"SELECT CASE WHEN vec_id % 3 = 0 THEN 'short' WHEN vec_id % 3 = 1 THEN 'medium' ELSE 'long' END AS class, count(*) AS chunks, count(*) FILTER (best >= 0.4) AS covered, round(avg((best >= 0.4)::INT::DOUBLE), 6) AS rate FROM {_BEST} GROUP BY 1")
def coverage_by_class(s, d):
    m = F.col("vec_id") % 3
    return coverage.by_class(_best(s, d), F.when(m == 0, "short").when(m == 1, "medium").otherwise("long"), 0.4)


@query(f"SELECT * FROM ({_NEAR}) WHERE rank <= 5")
def dense_top_k(s, d):
    v = table(s, d, "embeddings")
    return vectors.top_k(v, v.where("vec_id % 20 = 0"), 5)


@query(f"""WITH near AS ({_NEAR}), lists AS (SELECT * FROM near WHERE rank <= 10 UNION ALL SELECT n.query_id, row_number() OVER (PARTITION BY n.query_id ORDER BY label DESC, sim DESC, n.vec_id), n.vec_id, sim FROM near n JOIN embeddings USING (vec_id) WHERE rank <= 10),
total AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM lists GROUP BY 1, 2), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM total) SELECT * FROM r WHERE rank <= 5""")
def rank_fusion(s, d):
    v = table(s, d, "embeddings")
    near = vectors.top_k(v, v.where("vec_id % 20 = 0"), 10)
    other = near.join(v.select(F.col("vec_id").alias("k"), "label"), F.col("vec_id") == F.col("k"))
    again = other.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("label"), F.desc("sim"), "vec_id")))
    return vectors.fuse([near, again], 5)


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(s, d):
    return _docs(s, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


_OTHER = "length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))"
_TOKENS = f"CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(trunc({_OTHER} * 0.5 + (length(text) - {_OTHER}) * 0.25)::INT, 1) END"


@query(f"SELECT doc_id, {_TOKENS} AS tokens, round(({_TOKENS})::DOUBLE / 1000 * 0.1 + 100 / 1000.0::DOUBLE * 0.4, 6) AS price FROM documents")
def token_estimates(s, d):
    n = T.estimated_tokens(F.col("text"))
    return _docs(s, d).select("doc_id", n.alias("tokens"), F.round(T.cost(n, F.lit(100), 0.1, 0.4), 6).alias("price"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def truncated_text(s, d):
    return _docs(s, d).select("doc_id", T.truncated(F.col("text"), 50).alias("preview"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' \t\n\r') <> '')) AS n_paragraphs FROM documents")
def paragraph_counts(s, d):
    return _docs(s, d).select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))


_ENDS = "。．.！？!?"
_SENTENCES = f"(SELECT doc_id, list_filter(list_transform(CASE WHEN len(p) = 0 THEN [text] ELSE list_append(p, split_part(text, rtrim(p[-1], ' \t\n\r'), -1)) END, lambda x: trim(x, ' \t\n\r')), lambda x: x <> '') AS l FROM (SELECT doc_id, text, regexp_extract_all(text, '[^{_ENDS}]+[{_ENDS}]\\s*') AS p FROM documents))"


@query(f"SELECT doc_id, generate_subscripts(l, 1)::INT - 1 AS i, unnest(l) AS sentence FROM {_SENTENCES}")
def sentence_rows(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, length(text) AS chars, len({_WORDS}) AS words, round(list_avg(list_transform({_WORDS}, lambda w: length(w))), 2) AS mean_word FROM documents")
def text_statistics(s, d):
    w = T.plain_words(F.col("text"))
    mean = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) / F.size(w)
    return _docs(s, d).select("doc_id", F.length("text").cast("bigint").alias("chars"), F.size(w).cast("bigint").alias("words"), F.round(F.when(F.size(w) > 0, mean), 2).alias("mean_word"))


_TERMS = "(SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[ァ-ヴー]{2,}|[一-龥]{2,}|[A-Za-z]{2,}[A-Za-z0-9]*') AS t FROM documents)) GROUP BY 1, 2)"
_STOPPED = f"lower(term) NOT IN ({', '.join(repr(x) for x in STOP)}) AND length(term) > 1"


@query(f"SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM {_TERMS} WHERE {_STOPPED}) WHERE rank <= 10")
def keywords_by_frequency(s, d):
    return keywords.by_frequency(_docs(s, d), "doc_id", "text", 10, STOP)


_SCORE = f"round(least(n / 3, 1.0) * 0.3::DOUBLE + least(length(term) / 8, 1.0) * 0.3::DOUBLE + CASE WHEN term IN ({', '.join(repr(x) for x in IMPORTANT)}) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(term, '^[ァ-ヴー]{{3,}}$') THEN 0.2::DOUBLE WHEN regexp_matches(term, '^[A-Z]{{2,}}') THEN 0.3 WHEN regexp_matches(term, '^[一-龥]{{4,}}$') THEN 0.2 ELSE 0 END, 6)"


@query(f"SELECT doc_id, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM (SELECT *, {_SCORE} AS score FROM {_TERMS} WHERE {_STOPPED})) WHERE rank <= 10")
def keywords_by_score(s, d):
    return keywords.by_score(_docs(s, d), "doc_id", "text", 10, STOP, IMPORTANT)


@query(f"WITH k AS (SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM {_TERMS} WHERE {_STOPPED}) WHERE rank <= 10) SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k j WHERE j.doc_id = k.doc_id AND contains(j.term, k.term) AND length(j.term) > length(k.term))")
def keywords_without_contained(s, d):
    return keywords.without_contained(keywords_by_frequency(s, d), "doc_id")


_TOK = "CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(floor(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) * 0.5 + (length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) * 0.25)::INT, 1) END"
_TECH = r"len(regexp_extract_all(text, '[A-Z][a-z]+(?:[A-Z][a-z]+)+|[\pL\pN_]{10,}'))"


@query(f"SELECT doc_id, CASE WHEN dense > 5 OR mean > 30 THEN 'high' WHEN dense > 2 OR mean > 20 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, {_TECH} * 100.0::DOUBLE / greatest(t, 1) AS dense, t::DOUBLE / len(string_split(text, '.')) AS mean FROM (SELECT *, {_TOK} AS t FROM documents))")
def text_complexity(s, d):
    return _docs(s, d).select("doc_id", T.complexity(F.col("text")).alias("level"))


@query()
def packed_chunks(s, d):
    return chunks.chunked(_docs(s, d))


@query()
def merged_chunks(s, d):
    return chunks.chunked_small(_docs(s, d))


_WIN = "(SELECT doc_id, n, greatest(ceil((n - 300) / 250.0), 0)::INT AS last FROM (SELECT doc_id, len(" + _WORDS + ") AS n FROM documents) WHERE n > 0)"


@query(f"SELECT doc_id, i::INT AS chunk_idx, (i * 250)::INT AS first, least(300, n - i * 250)::INT AS words, CASE WHEN last = 0 THEN 'full' WHEN i = 0 THEN 'start' WHEN i = last THEN 'end' ELSE 'middle' END AS position FROM (SELECT *, unnest(range(last + 1)) AS i FROM {_WIN})")
def token_window_chunks(s, d):
    return chunks.token_windows(_docs(s, d), "doc_id", "text")


@query(f"SELECT doc_id, CASE WHEN t < 50 THEN 2 WHEN t < 100 THEN 3 WHEN t < 200 THEN 4 WHEN t < 300 THEN 5 ELSE 6 END + CASE WHEN doc_id % 8 >= 5 THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def question_counts(s, d):
    return _docs(s, d).select("doc_id", T.qa_count(T.estimated_tokens(F.col("text")), F.col("doc_id") % 8).alias("n"))


@query("SELECT 'c_mktsegment' AS \"column\", count(*) AS rows, count(*) FILTER (trim(c_mktsegment) = '' OR c_mktsegment IS NULL) AS empty, count(DISTINCT c_mktsegment) AS \"distinct\" FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (c_nationkey IS NULL), count(DISTINCT c_nationkey) FROM customer")
def column_profile(s, d):
    return profile.columns(table(s, d, "customer").select("c_mktsegment", "c_nationkey"))


@query("SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_of_each_text(s, d):
    return profile.first_of(_docs(s, d), ["text"], ["doc_id"])


@query("SELECT round(avg(length(text)), 6) AS mean, max(length(text)) AS most, min(length(text)) AS least, round(quantile_cont(length(text), 0.25), 6) AS q1, round(quantile_cont(length(text), 0.5), 6) AS q2, round(quantile_cont(length(text), 0.75), 6) AS q3 FROM documents")
def length_statistics(s, d):
    return profile.lengths(_docs(s, d), "text")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, upper(lang), lang, source, 0 FROM documents WHERE doc_id % 10 = 0")
def upserted_rows(s, d):
    docs = _docs(s, d)
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.upper("lang").alias("text"), "lang", "source", F.lit(0).cast("bigint").alias("n_chars"))
    return profile.upserted(docs, new, "doc_id")


@query("SELECT source_collection, count(*) AS n, count(DISTINCT original_id) AS ids FROM (SELECT 'docs' AS source_collection, doc_id AS original_id FROM documents UNION ALL SELECT 'pages', page_id FROM pages) GROUP BY 1")
def merged_collections(s, d):
    parts = {"docs": _docs(s, d).select(F.col("doc_id").alias("id"), "text"), "pages": table(s, d, "pages").select(F.col("page_id").alias("id"), "url")}
    return profile.merged(parts, "id").groupBy("source_collection").agg(F.count("*").alias("n"), F.count_distinct("original_id").alias("ids"))


@query("SELECT source, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1")
def source_distribution(s, d):
    docs = _docs(s, d)
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 6)
    return docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("percent", share)


_SCORES = "(SELECT event_id, user_id, ts, value / (1 + abs(value)) AS c FROM events)"


def _scored(s, d):
    return table(s, d, "events").withColumn("c", F.col("value") / (1 + F.abs("value")))


@query("WITH e AS (SELECT user_id, event_id, value / (1 + abs(value)) AS c FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e) SELECT user_id, round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(sum(c * i) / sum(i), 6) AS weighted, round(avg(c) * CASE WHEN bool_or(c < 0.3) THEN 0.7::DOUBLE ELSE 1 END, 6) AS checked, bool_or(c < 0.3) AS critical FROM n GROUP BY 1")
def confidence_aggregates(s, d):
    return confidence.aggregated(_scored(s, d), "user_id", "event_id", "c")


@query(f"SELECT event_id, CASE WHEN c >= 0.9 THEN 'silent' WHEN c >= 0.7 THEN 'notify' WHEN c >= 0.4 THEN 'confirm' ELSE 'escalate' END AS action FROM {_SCORES}")
def confidence_actions(s, d):
    return _scored(s, d).select("event_id", T.action(F.col("c")).alias("action"))


@query(f"SELECT user_id, round(CASE WHEN max(c) >= 0.6 THEN max(c) ELSE greatest(0, max(c) * 0.7::DOUBLE + avg(c) * 0.3::DOUBLE - least(0.15::DOUBLE, var_pop(c) * 0.3::DOUBLE)) END, 6) AS quality FROM {_SCORES} GROUP BY 1")
def search_quality(s, d):
    one = _scored(s, d).groupBy("user_id").agg(F.max("c").alias("m"), F.avg("c").alias("a"), F.var_pop("c").alias("v"))
    return one.select("user_id", F.round(T.search_quality(F.col("m"), F.col("a"), F.col("v")), 6).alias("quality"))


@query()
def adjusted_thresholds(s, d):
    fed = _scored(s, d).select("user_id", "ts", F.col("c").alias("confidence"), (F.col("event_type") == "purchase").alias("was_correct"))
    return confidence.thresholds(fed)


@query("SELECT o_orderkey AS plan_id, l_linenumber AS step_id, coalesce(lag(flag = 'N') OVER (PARTITION BY o_orderkey ORDER BY l_linenumber), true) AS ready FROM (SELECT o_orderkey, l_linenumber, min(l_returnflag) AS flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def steps_ready(s, d):
    both = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = both.groupBy(F.col("o_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_id")).agg(F.min("l_returnflag").alias("flag"))
    before = F.lag("step_id").over(W.partitionBy("plan_id").orderBy("step_id"))
    steps = lines.withColumn("p", before).select("plan_id", "step_id", F.when(F.col("p").isNotNull(), F.array("p")).otherwise(F.array().cast(f"array<{dict(lines.dtypes)['step_id']}>")).alias("depends_on"))
    return confidence.ready(steps, lines.select("plan_id", "step_id", F.when(F.col("flag") == "N", "success").otherwise("failed").alias("status")))


@query("SELECT source AS category, lang, count(*) AS cases, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)")
def evaluation_report(s, d):
    rows = _docs(s, d).join(table(s, d, "labels"), "doc_id")
    return rows.rollup(F.col("source").alias("category"), "lang").agg(F.count("*").alias("cases"), F.round(F.avg("quality"), 6).alias("accuracy"))


@query("SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def question_pairs(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("r"), F.lead("text").over(w).alias("answer"))
    return c.where("role = 'user' AND r = 'assistant'").select("conv_id", "turn", "question", "answer")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(s, d):
    return E.tumbling(table(s, d, "events")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM r GROUP BY user_id, k")
def session_counts(s, d):
    return E.sessions(table(s, d, "events")).select(F.col("session.start").alias("start"), "user_id", "n")


@query("SELECT time_bucket(INTERVAL 10 second, ts) - INTERVAL 10 second * back AS start, event_type, count(*) AS n, count(*) > 3 AS over FROM events, range(6) t(back) GROUP BY 1, 2")
def sliding_rates(s, d):
    return E.rates(table(s, d, "events"), 3, step="10 seconds").select(F.col("window.start").alias("start"), "event_type", "n", "over")


@query("SELECT event_type, mode_n AS n, top FROM (SELECT event_type, count(*) AS mode_n, arg_max(user_id, value) AS top FROM events GROUP BY 1)")
def top_of_each(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("user_id", "value").alias("top"))


_TOP = f"(SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM {_TERMS} WHERE {_STOPPED}) WHERE rank <= 10)"
_PARTS = "list_filter(list_transform(string_split_regex(text, '[。！？.!?]+'), lambda x: trim(x, ' \t\n\r')), lambda x: x <> '')"


def _lists(s, d):
    """Each document's top terms in order, beside its text."""
    top = keywords_by_frequency(s, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("l")).select("doc_id", F.col("l.term").alias("t"))
    return top.join(_docs(s, d).select(F.col("doc_id").alias("k"), "text"), F.col("doc_id") == F.col("k")).drop("k")


@query(f"""WITH k AS {_TOP}, l AS (SELECT doc_id, list(term ORDER BY rank) AS t FROM k GROUP BY 1),
p AS (SELECT a.doc_id, count(*) AS shared FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.rank < b.rank AND list_has_any(list_transform(range(1, length(a.term)), lambda i: substr(a.term, i, 2)), list_transform(range(1, length(b.term)), lambda i: substr(b.term, i, 2))) GROUP BY 1),
m AS (SELECT doc_id, len(list_filter(t, lambda x: contains(text, x)))::DOUBLE / len(t) AS coverage, list_aggregate(list_transform(t, lambda x: length(x)), 'stddev_samp') AS sd, len(t) AS n,
least(1, list_sum(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[A-Z]{{2,}}[A-Z0-9]*$') THEN 1.2::DOUBLE WHEN regexp_matches(x, '^[ァ-ヴー]{{3,}}$') THEN 1 WHEN regexp_matches(x, '^[一-龥]{{4,}}$') THEN 0.9 WHEN regexp_matches(x, '^[A-Za-z]+[A-Za-z0-9]*$') THEN 0.8 ELSE 0 END)) / len(t)) AS technicality,
len(list_filter(t, lambda x: length(x) BETWEEN 2 AND 8))::DOUBLE / len(t) AS length_balance FROM l JOIN documents USING (doc_id)),
q AS (SELECT doc_id, coverage, CASE WHEN n < 2 THEN 0.5::DOUBLE ELSE least(1, CASE WHEN sd < 3 THEN sd / 3 ELSE (6 - sd) / 3 END) END AS diversity, technicality, CASE WHEN n < 2 THEN 0::DOUBLE ELSE coalesce(shared, 0)::DOUBLE / (n * (n - 1) / 2) END AS coherence, length_balance FROM m LEFT JOIN p USING (doc_id))
SELECT doc_id, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity, round(technicality, 6) AS technicality, round(coherence, 6) AS coherence, round(length_balance, 6) AS length_balance, round(least(1, coverage * 0.25::DOUBLE + diversity * 0.15::DOUBLE + technicality * 0.25::DOUBLE + coherence * 0.2::DOUBLE + length_balance * 0.15::DOUBLE), 6) AS total FROM q""")
def keyword_metrics(s, d):
    m = K.metrics(F.col("t"), F.col("text"))
    return _lists(s, d).select("doc_id", *[F.round(c, 6).alias(k) for k, c in m.items()], F.round(K.total(m), 6).alias("total"))


@query("SELECT doc_id, (CASE WHEN n < 100 THEN 3 WHEN n < 300 THEN 5 WHEN n < 500 THEN CASE WHEN len(regexp_extract_all(text, '[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}')) / (n / 100.0::DOUBLE) > 2 THEN 9 ELSE 7 END WHEN n < 1000 THEN CASE WHEN len(string_split_regex(text, '[。！？.!?]+')) > 10 THEN 12 ELSE 10 END WHEN n < 2000 THEN 15 ELSE least(20 + floor(log2(n / 2000.0::DOUBLE)), 30) END)::INT AS n_keywords FROM (SELECT doc_id, text, length(text) AS n FROM documents)")
def keyword_counts(s, d):
    return _docs(s, d).select("doc_id", K.auto_count(F.col("text")).alias("n_keywords"))


_HITS = "len(string_split(text, term)) - 1"


@query(f"WITH k AS (SELECT doc_id, term, {_HITS} AS c, contains(text, term || 'とは') OR (contains(text, term || 'は') AND contains(text, 'である')) OR contains(text, term || '（') AS told FROM {_TOP} JOIN documents USING (doc_id)) SELECT doc_id, term, CASE WHEN told AND c >= 3 THEN 'basic' WHEN NOT told AND regexp_matches(term, '^[A-Z]{{2,}}[A-Z0-9]*$') THEN 'advanced' WHEN length(term) >= 8 OR c = 1 THEN 'advanced' WHEN c >= 5 THEN 'basic' ELSE 'intermediate' END AS difficulty, CASE WHEN regexp_matches(term, '^[A-Z]{{2,}}[A-Z0-9]*$') THEN 'technical_term' ELSE 'other' END AS category FROM k")
def keyword_levels(s, d):
    t = F.col("term")
    return _lists(s, d).select("doc_id", "text", F.explode("t").alias("term")).select("doc_id", "term", K.difficulty(t, F.col("text")).alias("difficulty"), K.category(t).alias("category"))


@query(f"WITH c AS (SELECT doc_id, rank, sum(length(term) * ({_HITS})) OVER (PARTITION BY doc_id ORDER BY rank)::DOUBLE / length(text) AS covered FROM {_TOP} JOIN documents USING (doc_id)) SELECT doc_id, coalesce(min(rank) FILTER (rank >= 3 AND covered >= 0.3), max(rank)) AS n, round(coalesce(arg_min(covered, rank) FILTER (rank >= 3 AND covered >= 0.3), arg_max(covered, rank)), 6) AS covered FROM c GROUP BY 1")
def keywords_by_coverage(s, d):
    both = keywords_by_frequency(s, d).join(_docs(s, d).select(F.col("doc_id").alias("k"), "text"), F.col("doc_id") == F.col("k"))
    return keywords.enough(both, "doc_id", "text", 0.3)


_TOLD = " + ".join(f"contains(sentence, '{p}')::INT" for p in K.EXPLANATORY)
_TELLS = f"least(1, (1 - (strpos(sentence, term) - 1) / length(sentence)) * 0.2::DOUBLE + least(len(regexp_extract_all(sentence, '{K.TECHNICAL}')) / 5, 1) * 0.3::DOUBLE + ({_TOLD}) / {len(K.EXPLANATORY)} * 0.3::DOUBLE + greatest(0, 1 - abs(length(sentence) - 50) / 50) * 0.2::DOUBLE)"


@query(f"WITH s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS i FROM {_SENTENCES}), c AS (SELECT doc_id, term, sentence, i, round({_TELLS}, 6) AS importance FROM {_TOP} k JOIN s USING (doc_id) WHERE contains(sentence, term)) SELECT doc_id, term, sentence, importance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY importance DESC, i) AS r FROM c) WHERE r = 1")
def keyword_sentences(s, d):
    return questions.best_sentences(_docs(s, d), keywords_by_frequency(s, d), "doc_id", "text")


@query(f"""WITH p AS (SELECT doc_id, text, {_PARTS} AS t FROM documents), m AS (SELECT doc_id, text, len(t) AS n, list_transform(t, lambda x: length(x)::DOUBLE) AS z FROM p)
SELECT doc_id, n AS sentences, round(least(1, CASE WHEN n > 1 THEN least(1, list_aggregate(z, 'stddev_pop') / list_avg(z)) * 0.3::DOUBLE ELSE 0 END + least(1, len(regexp_extract_all(text, '[ァ-ヴー]{{3,}}|[A-Z]{{2,}}[A-Z0-9]*|[一-龥]{{4,}}')) / greatest(1, length(text) / 100.0::DOUBLE) / 5) * 0.4::DOUBLE + least(1, len(regexp_extract_all(text, '[、；：「」『』（）\\[\\]]')) / greatest(n, 1)::DOUBLE) * 0.3::DOUBLE), 6) AS difficulty FROM m""")
def text_difficulties(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", F.size(K.sentence_parts(t)).cast("bigint").alias("sentences"), F.round(K.text_difficulty(t), 6).alias("difficulty"))


@query("WITH q AS (SELECT min(conv_id * 1000 + turn) AS id, text, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM conversations WHERE role = 'user' GROUP BY text), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS s FROM q a JOIN q b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s > 0.7")
def questions_asked_twice(s, d):
    asked = table(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return questions.asked_twice(asked, "id", "text")


@query("SELECT conv_id, turn, round(least(1, CASE WHEN length(answer) BETWEEN 20 AND 200 THEN 0.2::DOUBLE WHEN length(answer) BETWEEN 10 AND 300 THEN 0.1 ELSE 0 END + CASE WHEN contains(question, 'what') OR contains(question, 'how') THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE + least(0.2, len(regexp_extract_all(question, '[ァ-ヴー]{2,}|[一-龥]{2,}|[A-Za-z]{2,}[A-Za-z0-9]*')) * 0.1)::DOUBLE + 0.1::DOUBLE), 6) AS quality FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def question_quality(s, d):
    q = F.col("question")
    score = K.pair_quality(q, F.col("answer"), F.lit("basic"), F.size(T.terms(q)), F.lit("user"), ["what", "how"])
    return question_pairs(s, d).select("conv_id", "turn", F.round(score, 6).alias("quality"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'token')")
def rows_with_any_word(s, d):
    return _docs(s, d).where(K.contains_any(F.col("text"), "license a token")).select("doc_id")


def _labelled(s, d):
    v = table(s, d, "embeddings")
    near = vectors.top_k(v, v.where("vec_id % 20 = 0"), 10)
    return near.join(v.select(F.col("vec_id").alias("k"), "label"), F.col("vec_id") == F.col("k")).drop("k")


_LABELLED = f"(SELECT n.*, e.label FROM ({_NEAR}) n JOIN embeddings e USING (vec_id) WHERE rank <= 10)"


@query(f"SELECT query_id, rank, vec_id, sim, label FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY CASE label WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, label) AS k FROM {_LABELLED}) WHERE k = 1")
def first_collection_with_results(s, d):
    return results.first_collection(_labelled(s, d), "query_id", "label", [2, 0])


@query(f"SELECT query_id, rank, vec_id, sim, label FROM (SELECT *, max(sim) OVER (PARTITION BY query_id) AS top FROM {_LABELLED}) WHERE rank = 1 OR top < 0.98")
def confident_results(s, d):
    return results.confident_only(_labelled(s, d), "query_id", "sim", ["vec_id"])


@query("SELECT c_custkey, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(var_pop(value), 1), 6) AS variance, coalesce(max(value), 0) AS most, coalesce(min(value), 0) AS least FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def score_statistics(s, d):
    found = table(s, d, "events").select(F.col("user_id").alias("c_custkey"), "value")
    one = results.score_statistics(table(s, d, "customer"), found, "c_custkey", "value")
    return one.withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query(f"WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.label, avg(list_cosine_similarity(a.e, b.e)) AS m FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1) SELECT label, n, round(coalesce(m, 1), 6) AS agreement FROM (SELECT label, count(*) AS n FROM v GROUP BY 1) LEFT JOIN p USING (label)")
def source_agreement(s, d):
    return results.agreement(table(s, d, "embeddings"), "label", "embedding").withColumn("agreement", F.round("agreement", 6))


_HARD = ORACLES["text_difficulties"]


@query(f"""WITH h AS (SELECT doc_id, difficulty AS hard FROM ({_HARD})), m AS (SELECT doc_id, hard, length(text) AS n, ({_TOKENS}) AS t, len(regexp_extract_all(text, '[ァ-ヴー]{{3,}}|[A-Z]{{2,}}[A-Z0-9]*|[一-龥]{{4,}}')) / greatest(1, length(text) / 100.0::DOUBLE) AS dense FROM documents JOIN h USING (doc_id)),
b AS (SELECT *, CASE WHEN n < 500 THEN 3 WHEN n < 1000 THEN 5 WHEN n < 2000 THEN 8 WHEN n < 5000 THEN 12 WHEN n < 10000 THEN 18 ELSE least(30, 18 + floor(log2(n / 10000.0::DOUBLE) * 3)) END AS base, CASE WHEN dense > 4 AND hard > 0.7 THEN 1.5::DOUBLE WHEN dense > 2.5 OR hard > 0.5 THEN 1.2 WHEN dense < 1 AND hard < 0.3 THEN 0.7 ELSE 1 END AS more FROM m)
SELECT doc_id, greatest(3, least(50, floor((greatest(3, floor(base * more)) + floor(floor(t / 150) * 0.7::DOUBLE / 2.5)) / 2)))::INT AS questions FROM b""")
def question_budgets(s, d):
    return _docs(s, d).select("doc_id", K.question_budget(F.col("text")).alias("questions"))


@query(f"""SELECT doc_id, term, unnest(CASE difficulty WHEN 'basic' THEN [term || 'とは何ですか？', term || 'について説明してください。'] WHEN 'intermediate' THEN [term || 'はどのように使われますか？', term || 'の利点は何ですか？'] ELSE CASE category WHEN 'technical_term' THEN [term || 'の技術的な詳細を説明してください。', term || 'と他の手法との違いは何ですか？'] ELSE [term || 'の応用例を挙げてください。', term || 'の課題と解決策は何ですか？'] END END) AS question, CASE difficulty WHEN 'basic' THEN '1-2文' WHEN 'intermediate' THEN '2-3文' ELSE '3-5文' END AS answer_length FROM ({ORACLES["keyword_levels"]})""")
def question_templates(s, d):
    return questions.by_template(keyword_levels(s, d), "doc_id")


_SPLIT = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"
_PAIRED = "SELECT a.conv_id, a.turn, b.turn AS other, len(list_intersect(a.w, b.w))::DOUBLE / len(a.w) AS score FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' WHERE len(a.w) > 0"


@query(f"WITH c AS (SELECT conv_id, turn, role, {_SPLIT.format('text')} AS w FROM conversations), p AS ({_PAIRED}), r AS (SELECT conv_id, turn, other, score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, other) AS rank FROM p WHERE score >= 0.05) SELECT conv_id, turn, other, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def reordered_answers(s, d):
    c = table(s, d, "conversations")
    asked, told = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")), c.where("role = 'assistant'").select(F.col("conv_id").alias("k"), F.col("turn").alias("other"), F.col("text").alias("a"))
    pairs = asked.join(told, F.col("conv_id") == F.col("k")).withColumn("query", F.struct("conv_id", "turn"))
    best = models.reordered(pairs, "query", models.shared_words(F.col("q"), F.col("a")), ["other"], 3, 0.05)
    return best.select("conv_id", "turn", "other", F.round("score", 6).alias("score"), "rank")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 hour ORDER BY ts DESC, event_id LIMIT 100")
def newest_events(s, d):
    return profile.newest(table(s, d, "events"), "ts", ["event_id"], 100, "1 hour").select("event_id", "user_id")


@query()
def hashed_vectors(s, d):
    return models.embedded(_docs(s, d), "doc_id", "text")


@query(f"SELECT doc_id, lower(term) AS term, sum(n)::FLOAT AS weight FROM {_TERMS} GROUP BY ALL")
def sparse_weights(s, d):
    size = 1 << 30
    found = models.sparse(_docs(s, d), "doc_id", "text", size).withColumnRenamed("doc_id", "k")
    asked = _docs(s, d).select("doc_id", F.explode_outer(F.array_distinct(F.transform(T.terms(F.col("text")), F.lower))).alias("term")).where("term IS NOT NULL")
    at = F.pmod(F.xxhash64("term"), F.lit(size)).cast("int")
    return asked.join(found, F.col("doc_id") == F.col("k")).select("doc_id", "term", F.try_element_at("weights", at).alias("weight"))


@query()
def forward_chunks(s, d):
    return chunks.chunked_forward(_docs(s, d))


@query()
def keyword_coverage(s, d):
    return keywords.covered_share(_docs(s, d), keywords_by_frequency(s, d), "doc_id", "text")


@query(f"SELECT doc_id, rank, term, n FROM {_TOP} WHERE rank > 5")
def keywords_only_new(s, d):
    found = keywords_by_frequency(s, d)
    return keywords.only_new(found, found.where("rank <= 5"), "doc_id")


_PARTS_AT = f"(SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s, t FROM (SELECT d.doc_id, {_PARTS} AS p, t FROM documents d JOIN (SELECT doc_id, list(term ORDER BY rank) AS t FROM {_TOP} GROUP BY 1) USING (doc_id)))"
_TOLD = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{r}'" for p, r in relations.PATTERNS) + " END"


@query(f"""WITH s AS (SELECT doc_id, i, s, list_filter(t, lambda x: contains(s, x)) AS t, {_TOLD} AS r FROM {_PARTS_AT}),
p AS (SELECT doc_id, i, s, r, t[a] AS a, t[b] AS b FROM (SELECT *, unnest(range(1, len(t))) AS a FROM s) x, LATERAL (SELECT unnest(range(x.a + 1, CASE WHEN x.r IS NULL THEN len(x.t) + 1 ELSE x.a + 2 END)) AS b)),
o AS (SELECT doc_id, i, s, coalesce(r, 'co_occurs') AS relation, CASE WHEN r IS NULL OR instr(s, a) < instr(s, b) THEN a ELSE b END AS source, CASE WHEN r IS NULL OR instr(s, a) < instr(s, b) THEN b ELSE a END AS target FROM p)
SELECT doc_id, source, target, relation, arg_min(s, i) AS context FROM o GROUP BY 1, 2, 3, 4""")
def term_relations(s, d):
    return relations.relations(written(_lists(s, d), "lists"), "doc_id", "text", "t")


@query()
def chunk_questions(s, d):
    return questions.by_chunk(_docs(s, d), "doc_id", "text")


@query("WITH c AS (SELECT l_orderkey AS batch, l_linenumber AS chunk, (l_quantity % 4)::INT AS expected FROM lineitem), f AS (SELECT *, coalesce(sum(expected) OVER (PARTITION BY batch ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM c), p AS (SELECT l_orderkey AS batch, l_linenumber - 1 AS pos FROM lineitem) SELECT batch, pos, chunk FROM p JOIN f USING (batch) WHERE pos >= lo AND pos < lo + expected")
def dealt_pairs(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    pairs = l.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") - 1).alias("pos"))
    return questions.dealt(pairs, l.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("chunk"), (F.col("l_quantity") % 4).cast("bigint").alias("expected")))


_STEPS = "SELECT event_id, CASE WHEN event_type = 'error' OR value < 0.05 THEN 'failed' ELSE 'success' END AS status, value / (1 + abs(value)) AS c, (user_id % 5) AS replans, (event_id % 7) + 1 AS step, CASE WHEN user_id % 2 = 0 THEN 'reasoning' END AS fallback FROM events"


@query(f"WITH s AS ({_STEPS}), t AS (SELECT *, CASE WHEN replans < 3 THEN CASE WHEN status = 'failed' THEN 'step_failed' WHEN c < 0.4 THEN 'low_confidence' END END AS why FROM s) SELECT event_id, why, CASE WHEN replans >= 3 THEN 'abort' WHEN why = 'step_failed' AND fallback IS NOT NULL THEN 'fallback' WHEN step / 7 <= 0.34 THEN 'full' ELSE 'partial' END AS strategy FROM t")
def replan_strategies(s, d):
    failed = (F.col("event_type") == "error") | (F.col("value") < 0.05)
    e = _scored(s, d).select("event_id", "c", (F.col("user_id") % 5).alias("replans"), (F.col("event_id") % 7 + 1).alias("step"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(F.col("user_id") % 2 == 0, "reasoning").alias("fallback"))
    why = e.withColumn("why", plans.trigger(F.col("status"), F.col("c"), F.col("replans")))
    return why.select("event_id", "why", plans.strategy(F.col("why"), F.col("replans"), F.col("step"), F.lit(7), F.col("fallback")).alias("strategy"))


@query("WITH l AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_id, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_discount::DOUBLE * 10 END) AS c, any_value(l_linenumber % 2) AS n FROM lineitem GROUP BY 1, 2) SELECT a.plan_id, a.step_id, CASE WHEN a.n = 0 AND b.c > 0 THEN b.c ELSE a.c END AS confidence FROM l a LEFT JOIN l b ON a.plan_id = b.plan_id AND b.step_id = a.step_id - 1")
def inherited_confidence(s, d):
    l = table(s, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_id"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_discount").cast("double") * 10).alias("c"))  # noqa: E741
    l = l.groupBy("plan_id", "step_id").agg(F.max("c").alias("confidence"))  # noqa: E741
    steps = l.select("plan_id", "step_id", F.lit("reasoning").alias("action"), F.array(F.col("step_id") - 1).alias("depends_on"))
    return plans.inherited(steps, l.withColumns({"status": F.lit("success"), "n_results": F.col("step_id") % 2}))


@query(f"SELECT query_id, list_sort(list_distinct(list(label::VARCHAR)))::VARCHAR AS sources FROM {_LABELLED} GROUP BY 1")
def result_sources(s, d):
    one = results.sources(_labelled(s, d).withColumn("label", F.col("label").cast("string")), "query_id", "label")
    return one.select("query_id", F.concat(F.lit("["), F.array_join("sources", ", "), F.lit("]")).alias("sources"))


@query("SELECT doc_id, CASE WHEN contains(lower(source), 'cc_news') THEN 'cc_news' WHEN contains(lower(source), 'livedoor') THEN 'livedoor' ELSE 'custom' END AS domain, coalesce(regexp_matches(source, '^[a-zA-Z0-9_-]+$'), false) AS valid FROM documents")
def source_domains(s, d):
    return _docs(s, d).select("doc_id", collections.domain(F.col("source")).alias("domain"), collections.valid_name(F.col("source")).alias("valid"))


@query(f"SELECT vec_id, answer FROM (SELECT vec_id, 'vector ' || vec_id AS answer, best FROM {_BEST} WHERE best < 0.9 ORDER BY round(0.9 - best, 6) DESC, vec_id LIMIT 5)")
def questions_for_uncovered(s, d):
    texts = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("vector "), F.col("vec_id")).alias("text"))
    return questions.for_uncovered(texts, coverage.uncovered(_best(s, d), 0.9), "vec_id", "text").select("vec_id", "answer")


@query()
def layered_questions(s, d):
    return questions.layered(_docs(s, d), "doc_id", "text")


_SHARES = ", ".join(f"coalesce(sum(CASE WHEN rank <= {e} THEN own END), 0) AS c{e}" for e in (3, 6, 10))


@query(f"WITH k AS (SELECT doc_id, rank, term, length(term) * ({_HITS}) / length(text) AS own FROM {_TOP} JOIN documents USING (doc_id)), c AS (SELECT doc_id, {_SHARES} FROM k GROUP BY 1) SELECT doc_id, rank, term FROM k JOIN c USING (doc_id) WHERE rank <= CASE WHEN c3 < 0.05 THEN 3 WHEN c6 - c3 < 0.05 THEN 6 ELSE 10 END")
def keywords_by_batches(s, d):
    both = keywords_by_frequency(s, d).join(_docs(s, d).select(F.col("doc_id").alias("k"), "text"), F.col("doc_id") == F.col("k"))
    return keywords.progressive(both, "doc_id", "text", (3, 6, 10), falling=True)  # DuckDB's join gives a document's terms in that order


@query()
def questions_until_covered(s, d):
    tests = table(s, d, "benchmark").withColumnRenamed("item_id", "vec_id")
    asked = tests.where("vec_id % 2 = 0").select(F.col("text").alias("question"), F.lit("").alias("answer"))
    return feedback.until_covered(tests, asked, "vec_id", "text", 0.6)[0]


@query()
def sentence_chunks(s, d):
    return chunks.with_ids(chunks.chunked_by_sentences(_docs(s, d)), "documents")


_POS = f"(SELECT *, CASE WHEN i < n * 0.33::DOUBLE THEN 'beginning' WHEN i < n * 0.67::DOUBLE THEN 'middle' ELSE 'end' END AS class FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM {_BEST}))"
_BY_POS = f"SELECT class, count(*) AS chunks, count(*) FILTER (best >= 0.7) AS covered, round(avg(best), 6) AS mean, round(avg((best >= 0.7)::INT::DOUBLE), 6) AS rate FROM {_POS} GROUP BY 1"


@query(_BY_POS)
def coverage_by_position(s, d):
    return coverage.by_position(_best(s, d), "vec_id", 0.7)


@query(f"SELECT * FROM ({_BY_POS}) WHERE rate < 0.7")
def coverage_insights(s, d):
    return coverage.insights(coverage_by_position(s, d))


@query("SELECT doc_id, concat_ws(chr(10), text, nullif(trim(source), '')) AS input FROM documents")
def embedding_inputs(s, d):
    return _docs(s, d).select("doc_id", T.embedding_input(F.col("text"), F.nullif(F.trim("source"), F.lit(""))).alias("input"))


_STEP = "SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS search, l_discount::DOUBLE * 10 AS quality, l_tax::DOUBLE * 12.5 AS agreement, (l_quantity::DOUBLE % 11) / 10 AS own, (l_quantity::DOUBLE % 7) / 10 AS covered, l_suppkey % 3 AS done, (l_suppkey % 3) + (l_partkey % 2) AS runs, l_partkey % 4 AS sources, l_suppkey % 2 AS found FROM lineitem"
_RATE = "SELECT *, CASE WHEN runs = 0 THEN 1.0::DOUBLE ELSE done::DOUBLE / runs END AS success FROM (" + _STEP + ")"
_PEN = "SELECT *, (CASE WHEN search AND found = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN success < 1 THEN success * 0.2::DOUBLE + 0.8::DOUBLE ELSE 1.0 END) * (CASE WHEN sources = 0 AND NOT (search AND found > 0) AND NOT (NOT search AND own >= 0.8::DOUBLE) THEN 0.7 ELSE 1.0 END)::DOUBLE AS factor FROM (" + _RATE + ")"
_PARTS = [("quality > 0", "quality", 0.6), ("true", "success", 0.4), ("sources > 1", "agreement", 0.2), ("own > 0.6::DOUBLE", "own", 0.3), ("covered > 0.1::DOUBLE", "covered", 0.1)]
_SUM, _WEIGHT = " + ".join(f"CASE WHEN {on} THEN {v} * {w}::DOUBLE ELSE 0::DOUBLE END" for on, v, w in _PARTS), " + ".join(f"CASE WHEN {on} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for on, _, w in _PARTS)


@query(f"SELECT l_orderkey, l_linenumber, factor, round(least(1, greatest(0, (CASE WHEN search THEN quality * CASE WHEN success < 1 THEN success ELSE 1 END ELSE ({_SUM}) / ({_WEIGHT}) END) * factor)), 3) >= 0.5 AS sure FROM ({_PEN})")
def step_confidences(s, d):
    steps = table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_linenumber % 2 = 0 AS search", "CAST(l_discount AS DOUBLE) * 10 AS quality", "CAST(l_tax AS DOUBLE) * 12.5D AS agreement",
        "(CAST(l_quantity AS DOUBLE) % 11) / 10 AS own", "(CAST(l_quantity AS DOUBLE) % 7) / 10 AS covered", "l_suppkey % 3 AS done", "(l_suppkey % 3) + (l_partkey % 2) AS runs", "l_partkey % 4 AS sources", "l_suppkey % 2 AS found",
    )
    steps = steps.withColumn("success", confidence.tool_success(F.col("done"), F.col("runs"), F.lit(1.0)))
    factor, _ = confidence.penalties(F.col("search"), F.col("found"), F.col("success"), F.col("sources"), F.col("own"))
    value = confidence.score(*[F.col(c) for c in ("search", "quality", "agreement", "own", "covered", "success", "sources")], factor)
    return steps.select("l_orderkey", "l_linenumber", factor.alias("factor"), (value >= 0.5).alias("sure"))
