"""Queries on keyword methods, retrieval, plans, test cases and reports, added to those of `registry`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.functions import text as T
from quern.operators import confidence, coverage, keywords, models, plans, questions, relations, reports, retrieval, vectors
from quern.plans.registry import _BEST, _HITS, _NEAR, _SCORE, _SPLIT, _STOPPED, _TERMS, _TOKENS, _TOP, IMPORTANT, ORACLES, STOP, _best, _docs, keyword_levels, keyword_sentences, keywords_by_frequency, query
from quern.sources import files
from quern.sources.tables import table, written

# Keywords by several methods

_OWN = f"round(least(1.0::DOUBLE, least(({_HITS}) / 3, 1.0) * 0.3::DOUBLE + least(length(term) / 8, 1.0) * 0.2::DOUBLE + CASE WHEN term IN ({', '.join(repr(x) for x in IMPORTANT)}) THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(term, '^[ァ-ヴー]{{3,}}$') THEN 0.15::DOUBLE WHEN regexp_matches(term, '^[A-Z]{{2,}}$') THEN 0.2 WHEN regexp_matches(term, '^[一-龥]{{4,}}$') THEN 0.15 ELSE 0 END), 6)"


def _again(found: str, n: int) -> str:
    return f"SELECT doc_id, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, old, term) AS rank FROM (SELECT doc_id, rank AS old, term, {_OWN} AS score FROM {found} JOIN documents USING (doc_id))) WHERE rank <= {n}"


_BY_SCORE = f"(SELECT doc_id, rank, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM (SELECT *, {_SCORE} AS score FROM {_TERMS} WHERE {_STOPPED})) WHERE rank <= 10)"
_METHODS = {"frequency": _again(_TOP, 10), "score": _again(_BY_SCORE, 10), "integrated": _again(_TOP.replace("rank <= 10", "rank <= 20"), 10)}
_ALL = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS method, rank, term, score FROM ({q})" for m, q in _METHODS.items())


@query(_METHODS["integrated"])
def keywords_integrated(s, d):
    return keywords.integrated(_docs(s, d), "doc_id", "text", 10, STOP, IMPORTANT)


@query(_ALL)
def keywords_by_all_methods(s, d):
    return keywords.by_all_methods(_docs(s, d), "doc_id", "text", 10, STOP, IMPORTANT)


_TOTALS = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS method, {i} AS o, total FROM ({ORACLES['keyword_metrics'].replace(_TOP, f'({q})')})" for i, (m, q) in enumerate(_METHODS.items()))


@query(f"SELECT doc_id, method, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, o) AS r FROM ({_TOTALS})) WHERE r = 1")
def keywords_by_best_method(s, d):
    return keywords.best_method(keywords_by_all_methods(s, d), _docs(s, d), "doc_id", "text").select("doc_id", "method", "total")


@query(f"SELECT doc_id, greatest(3, least(20, n_keywords)) AS auto, 5 AS summary, 20 AS exhaustive, 3 AS tag FROM ({ORACLES['keyword_counts']})")
def keyword_modes(s, d):
    return _docs(s, d).select("doc_id", *[K.count_by_mode(F.col("text"), m).alias(m) for m in ("auto", "summary", "exhaustive", "tag")])


_MARKED = "list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？!?]*[。！？!?]|[^。！？!?]+'), lambda x: trim(x, ' \t\n\r')), lambda x: x <> '')"


@query(f"SELECT doc_id, CASE WHEN m > 50 OR tokens > 500 THEN 'high' WHEN m > 25 OR tokens > 200 THEN 'medium' ELSE 'low' END AS level, sentences, round(m, 2) AS mean, tokens FROM (SELECT doc_id, len({_MARKED}) AS sentences, {_TOKENS} AS tokens, CASE WHEN len({_MARKED}) > 0 THEN ({_TOKENS})::DOUBLE / len({_MARKED}) ELSE 0 END AS m FROM documents)")
def length_levels(s, d):
    return _docs(s, d).select("doc_id", T.length_level(F.col("text")).alias("x")).select("doc_id", "x.*")


# Letters of the texts as kana, so that runs of kana are found in every text.
_LATIN, _KANA = "abcdefghijklmnopqrstuvwxyz", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
_AS_KANA = f"translate(lower(coalesce(text, '')), '{_LATIN}', '{_KANA}')"


@query(f"""WITH r AS (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all({_AS_KANA}, '[一-龯々ぁ-んァ-ン]{{2,}}') AS l FROM documents)),
f AS (SELECT doc_id, e, min(i) AS i FROM r GROUP BY doc_id, e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 5), c AS (SELECT doc_id, string_agg(e, ',' ORDER BY i) AS concepts FROM f GROUP BY 1)
SELECT doc_id, coalesce(concepts, '') AS concepts, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split_regex({_AS_KANA}, '\\s+'), lambda w: regexp_matches(w, '^[一-鿿゠-ヿ]+$')), regexp_extract_all({_AS_KANA}, '[一-鿿゠-ヿ]{{2,}}')))), ',') AS required FROM documents LEFT JOIN c USING (doc_id)""")
def key_concepts(s, d):
    docs = _docs(s, d).select("doc_id", F.translate(F.lower(F.coalesce("text", F.lit(""))), _LATIN, _KANA).alias("text"))
    return docs.select("doc_id", F.array_join(T.key_concepts(F.col("text")), ",").alias("concepts"), F.array_join(F.array_sort(T.required_terms(F.col("text"))), ",").alias("required"))


@query("SELECT doc_id, least(15, floor(floor(1.5::DOUBLE * CASE WHEN dense > 10 THEN 8 WHEN dense > 5 THEN 6 ELSE 4 END) + n * 0.5::DOUBLE))::INT AS questions FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' \t\n\r') <> '')) AS n, CASE WHEN length(text) > 0 THEN len(list_distinct(regexp_extract_all(text, '[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}'))) / (length(text) / 1000.0::DOUBLE) ELSE 0 END AS dense FROM documents)")
def batch_question_counts(s, d):
    return _docs(s, d).select("doc_id", T.batch_count(F.col("text"), F.size(T.paragraphs(F.col("text")))).alias("questions"))


# Searches

_MET = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM (SELECT q.doc_id AS query_id, p.doc_id, sum(q.n * p.n)::DOUBLE AS score FROM k q JOIN k p USING (term) WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)"


def _sparse(s, d, k):
    weights = written(keywords_by_frequency(s, d).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("weights")), "weights")
    return retrieval.sparse_top_k(weights, weights.where("doc_id % 20 = 0"), k)


@query(f"WITH k AS {_TOP} SELECT * FROM ({_MET}) WHERE rank <= 5")
def sparse_top_k(s, d):
    return _sparse(s, d, 5)


_HYBRID = f"""WITH k AS {_TOP}, lists AS (SELECT query_id, vec_id, rank FROM ({_NEAR}) WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM ({_MET}) WHERE rank <= 20),
fused AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM lists GROUP BY 1, 2)) WHERE rank <= 20),
p AS (SELECT query_id, vec_id, {_SPLIT.format("coalesce(q.text, '')")} AS a, {_SPLIT.format("coalesce(c.text, '')")} AS b FROM fused JOIN documents q ON q.doc_id = query_id JOIN documents c ON c.doc_id = vec_id),
m AS (SELECT query_id, vec_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END AS score FROM p), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM m WHERE score >= 0.05) SELECT * FROM r WHERE rank <= 3"""


@query(_HYBRID)
def hybrid_retrieval(s, d):
    v, docs = table(s, d, "embeddings"), _docs(s, d)
    lists = [vectors.top_k(v, v.where("vec_id % 20 = 0"), 20), _sparse(s, d, 20).withColumnRenamed("doc_id", "vec_id")]
    asked = docs.select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("q"))
    told = docs.select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("a"))
    return retrieval.retrieved(lists, asked, told, "vec_id", models.shared_words(F.col("q"), F.col("a")), 20, 3, 0.05).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id AS query_id, count(score) AS results, coalesce(max(score), 0) AS top, round(coalesce(avg(score), 0), 6) AS mean FROM documents LEFT JOIN ({_HYBRID}) ON query_id = doc_id WHERE doc_id % 20 = 0 GROUP BY 1")
def retrieval_metrics(s, d):
    asked = _docs(s, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"))
    return retrieval.search_metrics(asked, hybrid_retrieval(s, d))


# Coverage

_OF_DOC = "SELECT vec_id // 10 AS doc, vec_id, vec_id % 3 <> 0 AS chunk, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"WITH v AS ({_OF_DOC}), b AS (SELECT a.doc, a.vec_id, coalesce(max(round(list_cosine_similarity(a.e, b.e), 6)), 0) AS best FROM v a LEFT JOIN v b ON a.doc = b.doc AND NOT b.chunk WHERE a.chunk GROUP BY 1, 2) SELECT doc, count(*) AS chunks, count(*) FILTER (best >= 0.2) AS covered, round(avg((best >= 0.2)::INT::DOUBLE), 6) AS rate, round(avg(best), 9) AS mean FROM b GROUP BY 1")
def coverage_by_document(s, d):
    v = table(s, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 10))
    return coverage.by_document(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), "doc", "vec_id", "embedding", 0.2)


@query(f"SELECT count(*) AS chunks, count(*) FILTER (best >= 0.7) AS covered, round(avg((best >= 0.7)::INT::DOUBLE), 6) AS rate, round(avg(best), 6) AS mean, count(*) FILTER (best < 0.7) AS uncovered, count(*) FILTER (best >= 0.8) AS strict, count(*) FILTER (best >= 0.6) AS lenient, (SELECT coalesce(string_agg(class, ',' ORDER BY class), '') FROM ({ORACLES['coverage_insights']})) AS weak FROM {_BEST}")
def coverage_report(s, d):
    one = coverage.report(_best(s, d), "vec_id")
    return one.select("chunks", "covered", "rate", "mean", "uncovered", F.col("levels")["strict"].alias("strict"), F.col("levels")["lenient"].alias("lenient"), "weak")


# Questions and relations

_SHARES = {"basic": 0.3, "intermediate": 0.5, "advanced": 0.2}


@query(f"WITH i AS (SELECT doc_id, term, difficulty, n, k.rank AS place FROM ({ORACLES['keyword_levels']}) JOIN {_TOP} k USING (doc_id, term)), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, difficulty ORDER BY n DESC, place) <= CASE difficulty WHEN 'basic' THEN 1 WHEN 'intermediate' THEN 2 ELSE 1 END AS quota FROM i), r AS (SELECT doc_id, term, difficulty, row_number() OVER (PARTITION BY doc_id ORDER BY quota DESC, CASE WHEN NOT quota THEN 3 WHEN difficulty = 'basic' THEN 0 WHEN difficulty = 'intermediate' THEN 1 ELSE 2 END, n DESC, place) AS rank FROM p) SELECT * FROM r WHERE rank <= 5")
def keywords_by_quota(s, d):
    top = keywords_by_frequency(s, d).withColumnsRenamed({"doc_id": "_k", "term": "_t", "rank": "place"})
    items = keyword_levels(s, d).select("doc_id", "term", "difficulty").join(top, (F.col("doc_id") == F.col("_k")) & (F.col("term") == F.col("_t")))
    return questions.by_quota(items, "doc_id", "difficulty", "n", ["place"], 5, _SHARES).select("doc_id", "term", "difficulty", "rank")


@query(f"WITH k AS {_TOP}, e AS (SELECT a.doc_id, a.term AS source, b.term AS target FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.rank = a.rank + 1), w AS (SELECT doc_id, source AS term, target AS o FROM e UNION SELECT doc_id, target, source FROM e) SELECT doc_id, term, coalesce(string_agg(o, ',' ORDER BY o), '') AS others FROM k LEFT JOIN w USING (doc_id, term) GROUP BY 1, 2")
def related_terms(s, d):
    k = keywords_by_frequency(s, d)
    edges = k.withColumn("target", F.lead("term").over(W.partitionBy("doc_id").orderBy("rank"))).where("target IS NOT NULL").withColumnRenamed("term", "source")
    return relations.related(k, edges, "doc_id").withColumn("others", F.concat_ws(",", "others"))


_HINTS = f"SELECT * FROM ({ORACLES['keyword_levels']}) JOIN ({ORACLES['keyword_sentences']}) USING (doc_id, term)"


@query(f"SELECT doc_id, term, CASE difficulty WHEN 'basic' THEN term || 'は、' || substr(sentence, 1, 100) WHEN 'intermediate' THEN term || 'について、' || substr(sentence, 1, 150) ELSE term || 'の' || substr(sentence, 1, 200) END AS answer FROM ({_HINTS})")
def answers_by_level(s, d):
    told = keyword_sentences(s, d).select(F.col("doc_id").alias("_k"), F.col("term").alias("_t"), "sentence")
    both = keyword_levels(s, d).join(told, (F.col("doc_id") == F.col("_k")) & (F.col("term") == F.col("_t")))
    return both.select("doc_id", "term", questions.answer_by_level(F.col("term"), F.col("difficulty"), F.col("sentence")).alias("answer"))


@query("SELECT count(*) AS rows, sum(length(t))::BIGINT AS chars FROM (SELECT DISTINCT source, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM (SELECT DISTINCT source, lang, text FROM documents)) WHERE length(t) >= 50")
def preprocessed_rows(s, d):
    rows = files.preprocessed(_docs(s, d).select("source", "lang", "text"), ["text"], 50).distinct()
    return rows.agg(F.count("*").alias("rows"), F.sum(F.length("Combined_Text")).alias("chars"))


# Plans and test cases: an order is a plan, its lines are steps

_STEPS = "SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS step_id, CASE WHEN l_linenumber = 1 THEN [] ELSE [l_linenumber - 1, 3] END AS depends_on FROM lineitem"


def _steps(s, d):
    return table(s, d, "lineitem").selectExpr("l_orderkey AS plan_id", "l_linenumber AS step_id", "CASE WHEN l_linenumber = 1 THEN CAST(array() AS array<int>) ELSE array(CAST(l_linenumber - 1 AS int), 3) END AS depends_on")


def _ran(s, d):
    by = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_id"))
    one = by.agg(F.when(F.min("l_returnflag") == "N", "success").otherwise("failed").alias("status"), F.when(F.min("l_suppkey") % 2 == 0, "reasoning").otherwise("search").alias("action"), F.min("l_suppkey").cast("string").alias("output"))
    return one.withColumn("cancelled", F.col("plan_id") % 50 == 0)


_RAN = "SELECT l_orderkey AS plan_id, l_linenumber AS step_id, CASE WHEN min(l_returnflag) = 'N' THEN 'success' ELSE 'failed' END AS status, min(l_suppkey) % 2 = 0 AS reasons, min(l_suppkey)::VARCHAR AS output FROM lineitem GROUP BY 1, 2"


@query(f"WITH s AS ({_STEPS}), n AS (SELECT plan_id, step_id, unnest(depends_on) AS need FROM s) SELECT n.*, 'unknown' AS problem FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.plan_id = n.plan_id AND s.step_id = n.need) UNION ALL SELECT *, 'backward' FROM n WHERE need >= step_id")
def plan_problems(s, d):
    return plans.invalid_dependencies(_steps(s, d).distinct())


@query(f"WITH n AS (SELECT plan_id, step_id, unnest(depends_on) AS need FROM ({_STEPS})), r AS ({_RAN}) SELECT s.plan_id, s.step_id, coalesce((SELECT string_agg(output, ',' ORDER BY r.step_id, output) FROM n JOIN r ON r.plan_id = n.plan_id AND r.step_id = n.need AND status = 'success' WHERE n.plan_id = s.plan_id AND n.step_id = s.step_id), '') AS inputs FROM ({_STEPS}) s")
def plan_inputs(s, d):
    return plans.step_inputs(_steps(s, d).distinct(), _ran(s, d)).withColumn("inputs", F.concat_ws(",", "inputs"))


@query(f"SELECT plan_id, CASE WHEN plan_id % 50 = 0 THEN 'cancelled' WHEN bool_and(status = 'success') THEN 'success' WHEN bool_or(status = 'success') THEN 'partial' ELSE 'failed' END AS status, arg_max(output, step_id) FILTER (reasons AND status = 'success') AS answer FROM ({_RAN}) GROUP BY 1")
def plan_statuses(s, d):
    return reports.statuses(_ran(s, d), "plan_id", "step_id")


@query(f"SELECT count(*) FILTER (status = 'success' AND step_id < 6) AS success, count(*) FILTER (status <> 'success' AND step_id < 6) AS failed, count(*) FILTER (step_id >= 6) AS error, coalesce(sum(length(output)) FILTER (status = 'success' AND step_id < 6), 0)::BIGINT AS pairs FROM ({_RAN})")
def collected_results(s, d):
    return reports.collected(_ran(s, d).select((F.col("status") == "success").alias("success"), F.when(F.col("step_id") >= 6, "timeout").alias("error"), F.length("output").alias("pairs")))


@query("SELECT conv_id * 100 + turn AS case_id, route AND coll AND behavior AS passed, concat_ws('; ', CASE WHEN NOT route THEN 'route' END, CASE WHEN NOT coll THEN 'collection' END, CASE WHEN NOT behavior THEN 'behavior' END) AS failures FROM (SELECT *, (turn % 2 = 0) = (role = 'user' AND conv_id % 7 <> 0) AS route, turn % 3 <> 0 OR coalesce(role = 'user', false) AS coll, turn % 5 <> 0 OR contains(text, '情報がありません') AS behavior FROM conversations)")
def case_results(s, d):
    c = table(s, d, "conversations").withColumn("case_id", F.expr("conv_id * 100 + turn"))
    cases = c.selectExpr("case_id", "turn % 2 = 0 AS expected_tool_use", "CASE WHEN turn % 3 = 0 THEN 'user' END AS expected_collection", "CAST(NULL AS string) AS expected_tool", "CASE WHEN turn % 5 = 0 THEN 'not_found_response' END AS expected_behavior")
    return reports.compared(cases, c.selectExpr("case_id", "role = 'user' AND conv_id % 7 <> 0 AS tool_used", "role AS collection", "'search' AS tool", "text AS answer"), "case_id")


# Reports

@query("SELECT count(*) AS documents, sum(quality + 1)::BIGINT AS pairs, round(avg(quality + 1), 6) AS pairs_each, round(count(*) / sum(n_chars / 1000.0::DOUBLE), 6) AS per_second, round(avg(toxic::DOUBLE), 6) AS mean, min(toxic::DOUBLE) AS least, max(toxic::DOUBLE) AS most FROM labels JOIN documents USING (doc_id)")
def run_summary(s, d):
    both = table(s, d, "labels").join(_docs(s, d).select(F.col("doc_id").alias("k"), "n_chars"), F.col("doc_id") == F.col("k"))
    return reports.run_summary(both.select((F.col("quality") + 1).alias("pairs"), F.col("toxic").cast("double").alias("coverage"), (F.col("n_chars") / 1000).alias("seconds")))


@query("SELECT props, count(*) AS n FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY 1 ORDER BY n DESC, props LIMIT 5")
def top_reasons(s, d):
    return reports.top_values(table(s, d, "events").where("event_type = 'error'"), "props", 5)


@query("SELECT tag AS p_type, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 5")
def top_tags(s, d):
    return reports.tags(table(s, d, "part").select(F.replace("p_type", F.lit(" "), F.lit(",")).alias("p_type")), "p_type", 5)


@query("SELECT label, count(*) AS points, max(len(embedding)) AS dims FROM embeddings GROUP BY 1")
def collection_statistics(s, d):
    return reports.collections(table(s, d, "embeddings"), "label", "embedding")


def _has(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query(f"SELECT source, count(*) AS rows, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) < 100) AS short, {', '.join(f'count(*) FILTER ({_has(v)}) AS {k}' for k, v in reports.DOMAIN_TERMS.items())} FROM documents GROUP BY 1")
def domain_checks(s, d):
    return reports.text_checks(_docs(s, d), ["source"], "text")


@query("SELECT sum(n - 1)::BIGINT AS repeats FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def repeated_texts(s, d):
    return reports.repeated_values(_docs(s, d), "text")


# Complexity by score, questions on entities and keywords, confidences along plans

_SIGNS = " + ".join(f"contains(substr(text, 1, 100), '{x}')::INT" for x in T.JAPANESE_SIGNS)
_MARKS = r"CASE WHEN ja THEN len(regexp_extract_all(text, '[ァ-ヴー]{4,}|[一-龥]{4,}')) ELSE len(regexp_extract_all(text, '[A-Z][a-z]+(?:[A-Z][a-z]+)+|[\pL\pN_]{10,}')) END"
_PARTS = "len(list_filter(string_split(text, CASE WHEN ja THEN '。' ELSE '.' END), lambda x: length(trim(x, ' \t\n\r')) > 5))"


@query(f"SELECT doc_id, lang, score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level, statistics FROM (SELECT doc_id, CASE WHEN ja THEN 'ja' ELSE 'en' END AS lang, CASE WHEN dense > 5 THEN 3 WHEN dense > 2 THEN 2 ELSE 1 END + CASE WHEN mean > 30 THEN 2 WHEN mean > 20 THEN 1 ELSE 0 END + statistics::INT AS score, statistics FROM (SELECT doc_id, ja, ({_MARKS}) * 100.0::DOUBLE / greatest({_TOKENS}, 1) AS dense, ({_TOKENS})::DOUBLE / greatest({_PARTS}, 1) AS mean, len(regexp_extract_all(text, '[0-9]+\\.?[0-9]*%?')) > 2 AS statistics FROM (SELECT doc_id, coalesce(text, '') AS text, {_SIGNS.replace('text', 'coalesce(text, chr(32))')} > 3 AS ja FROM documents)))")
def scored_complexity(s, d):
    return _docs(s, d).select("doc_id", T.scored_complexity(F.col("text")).alias("x")).select("doc_id", "x.*")


_KINDS = ["PERSON", "ORG", "PRODUCT", "other"]
_ASKED = " ".join(f"WHEN kind = {i} THEN [{', '.join(repr(q).replace('{}', chr(39) + ' || entity || ' + chr(39)) for q in questions.ENTITIES.get(k, questions.ENTITIES['']))}]" for i, k in enumerate(_KINDS))


@query(f"SELECT doc_id, entity, unnest(CASE {_ASKED} END) AS question, answer FROM (SELECT doc_id, entity, length(entity) % 4 AS kind, trim(list_filter(string_split_regex(text, '[。.!?]'), lambda x: contains(x, entity))[1], ' \t\n\r') AS answer FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'))) AS entity FROM documents)) WHERE answer IS NOT NULL")
def entity_questions(s, d):
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))))
    found = _docs(s, d).select("doc_id", names.alias("entity"))
    kinds = F.get(F.array(*[F.lit(k) for k in _KINDS]), F.length("entity") % 4)
    return questions.by_entity(_docs(s, d), found.withColumn("kind", kinds), "doc_id", "text").select("doc_id", "entity", "question", "answer")


_TWENTY = _again(_TOP.replace("rank <= 10", "rank <= 20"), 10)
_ALONE = f"(SELECT doc_id, rank, term, score AS n FROM ({_TWENTY}) k WHERE NOT regexp_matches(term, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM ({_TWENTY}) j WHERE j.doc_id = k.doc_id AND contains(j.term, k.term) AND length(j.term) > length(k.term)))"
_PLACED = f"(WITH l AS (SELECT doc_id, term, difficulty, category, a.rank, a.n FROM ({ORACLES['keyword_levels'].replace(_TOP, _ALONE)}) JOIN {_ALONE} a USING (doc_id, term)), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, difficulty ORDER BY n DESC, rank) <= CASE difficulty WHEN 'basic' THEN 1 WHEN 'intermediate' THEN 2 ELSE 1 END AS quota FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quota DESC, CASE WHEN NOT quota THEN 3 WHEN difficulty = 'basic' THEN 0 WHEN difficulty = 'intermediate' THEN 1 ELSE 2 END, n DESC, rank) AS r FROM p) SELECT doc_id, term, difficulty, category FROM r WHERE r <= 5)"


@query(ORACLES["question_templates"].replace(f"({ORACLES['keyword_levels']})", _PLACED))
def questions_for_keywords(s, d):
    return questions.for_keywords(_docs(s, d), "doc_id", "text", 5, STOP, IMPORTANT, _SHARES)


_PLAN = "SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY line)::INT AS step_id, acts, bad, n, top, mean, variance, sources, agreement FROM (SELECT l_orderkey AS plan_id, l_linenumber AS line, min(l_suppkey) % 2 = 0 AS acts, min(l_returnflag) = 'R' AS bad, min(l_quantity)::INT % 4 AS n, round(min(l_discount)::DOUBLE * 10, 2) AS top, round(min(l_discount)::DOUBLE * 6, 2) AS mean, round(min(l_tax)::DOUBLE, 2) AS variance, min(l_linenumber) % 3 AS sources, round(min(l_tax)::DOUBLE * 10, 2) AS agreement FROM lineitem GROUP BY 1, 2)"
_QUALITY = "CASE WHEN found = 0 THEN 0 WHEN top >= 0.6 THEN top ELSE greatest(0, top * 0.7::DOUBLE + mean * 0.3::DOUBLE - least(0.15::DOUBLE, variance * 0.3::DOUBLE)) END"
_NEXT = f"""SELECT plan_id, step_id, CASE WHEN bad THEN 0 ELSE round(least(1, greatest(0, CASE WHEN NOT acts THEN quality ELSE (quality * CASE WHEN quality > 0 THEN 0.6::DOUBLE ELSE 0 END + 0.4::DOUBLE + CASE WHEN sources > 1 THEN agreement * 0.2::DOUBLE ELSE 0 END) / (CASE WHEN quality > 0 THEN 0.6::DOUBLE ELSE 0 END + 0.4::DOUBLE + CASE WHEN sources > 1 THEN 0.2::DOUBLE ELSE 0 END) END
* CASE WHEN NOT acts AND found = 0 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN sources = 0 AND NOT (NOT acts AND found > 0) THEN 0.7::DOUBLE ELSE 1 END)), 3) END AS confidence FROM (SELECT *, {_QUALITY} AS quality FROM (SELECT s.plan_id, s.step_id, acts, bad, variance, sources, agreement, CASE WHEN n = 0 AND acts AND c.confidence > 0 THEN 1 ELSE n END AS found, CASE WHEN n = 0 AND acts AND c.confidence > 0 THEN c.confidence ELSE top END AS top, CASE WHEN n = 0 AND acts AND c.confidence > 0 THEN c.confidence ELSE mean END AS mean FROM s JOIN c ON s.plan_id = c.plan_id AND s.step_id = c.step_id + 1))"""


@query(f"WITH RECURSIVE s AS ({_PLAN}), c AS (SELECT DISTINCT plan_id, 0 AS step_id, 0::DOUBLE AS confidence FROM s UNION ALL {_NEXT}) SELECT plan_id, step_id, confidence FROM c WHERE step_id > 0")
def plan_confidences(s, d):
    least = lambda c: F.min(c).cast("double")
    one = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("line")).agg(
        F.when(F.min("l_suppkey") % 2 == 0, "reasoning").otherwise("rag_search").alias("action"), F.when(F.min("l_returnflag") == "R", "failed").otherwise("success").alias("status"),
        (F.min("l_quantity").cast("int") % 4).alias("n_results"), F.round(least("l_discount") * 10, 2).alias("top"), F.round(least("l_discount") * 6, 2).alias("mean"), F.round(least("l_tax"), 2).alias("variance"),
        (F.min("l_linenumber") % 3).alias("n_sources"), F.round(least("l_tax") * 10, 2).alias("agreement"),
    )
    place = F.row_number().over(W.partitionBy("plan_id").orderBy("line"))
    return confidence.assembled(one.withColumn("step_id", place).withColumn("depends_on", F.array(F.col("step_id") - 1)))
