"""Queries on pruned search, upserts by bucket, spending limits, samples, token windows and named things, added to those of `registry`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import cells, compounds, confidence, coverage, entities, keywords, questions, reports, samples, windows
from quern.plans.registry import _BEST, _NEAR, _TOKENS, IMPORTANT, ORACLES, STOP, _best, _docs, _levels, query
from quern.sources import buckets, named, points
from quern.sources.tables import shared_folder, table
from quern.streaming import limits


@query(f"SELECT * FROM ({_NEAR}) WHERE rank <= 5")
def pruned_top_k(s, d):
    v = table(s, d, "embeddings")
    return cells.search(cells.built(v), v.where("vec_id % 20 = 0"), 5)


@query(_levels("rule"))
def pruned_coverage(s, d):
    v = table(s, d, "embeddings")
    return coverage.levels(cells.best(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")), "rule")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 10 = 3 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, lang, n_chars FROM documents WHERE doc_id % 10 = 5")
def upserts_by_bucket(s, d):
    docs, path = _docs(s, d).select("doc_id", "lang", "n_chars"), f"{shared_folder(s)}/quern-table-{uuid.uuid4().hex}"
    changed = lambda by: docs.where("doc_id % 10 = 3").withColumn("n_chars", F.col("n_chars") + by)
    new = docs.where("doc_id % 10 = 5").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    for number, batch in ((0, docs), (1, changed(1)), (1, changed(100)), (2, new)):  # batch 1 comes twice: the second time it changes nothing
        buckets.upsert(batch, path, "doc_id", number, 16)
    return buckets.read(s, path)


_REQUEST, _HOUR, _DAY = 200.0, 220.0, 300.0


def _verdict(a: str, b: str) -> str:
    return f"CASE WHEN e.cost > {_REQUEST} THEN 'request' WHEN {a} + e.cost > {_HOUR} THEN 'hour' WHEN {b} + e.cost > {_DAY} THEN 'day' ELSE 'ok' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, greatest(coalesce(value, 0), 0)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) // {limits.DAY} ORDER BY (epoch_us(ts) // 1000), value) AS i FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
f AS (SELECT user_id, t, cost, i, {_verdict('0', '0')} AS verdict, CASE WHEN {_verdict('0', '0')} = 'ok' THEN cost ELSE 0 END::DOUBLE AS a, CASE WHEN {_verdict('0', '0')} = 'ok' THEN cost ELSE 0 END::DOUBLE AS b FROM e WHERE i = 1
UNION ALL SELECT user_id, t, cost, i, v, CASE WHEN v = 'ok' THEN a + cost ELSE a END, CASE WHEN v = 'ok' THEN b + cost ELSE b END FROM (SELECT *, {_verdict('a', 'b')} AS v FROM (SELECT e.*, CASE WHEN e.t // {limits.HOUR} = f.t // {limits.HOUR} THEN f.a ELSE 0 END AS a, f.b FROM f JOIN e ON e.user_id = f.user_id AND e.t // {limits.DAY} = f.t // {limits.DAY} AND e.i = f.i + 1) e))
SELECT user_id, t AS "at", cost, round(a, 6) AS hour_spent, round(b, 6) AS day_spent, verdict FROM f""")
def spending_verdicts(s, d):
    got = limits.spent(table(s, d, "events"), "user_id", "value", _REQUEST, _HOUR, _DAY)
    return got.select("user_id", F.unix_millis("ts").alias("at"), "cost", F.round("hour_spent", 6).alias("hour_spent"), F.round("day_spent", 6).alias("day_spent"), "verdict")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id) LIMIT 50")
def sampled_documents(s, d):
    return samples.sampled(_docs(s, d).select("doc_id", "lang", "n_chars"), 50, ["doc_id"])


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id)) <= 25")
def sampled_by_type(s, d):
    return samples.sampled(table(s, d, "events").select("event_id", "event_type", "value"), 25, ["event_id"], seed=7, by="event_type")


@query(f"""WITH p AS (SELECT ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT < {int(0.2 * (1 << 32))} AS p, coalesce(length(text), 0)::DOUBLE AS x, ({_TOKENS})::DOUBLE AS y FROM documents),
s AS (SELECT count(*) AS rows, count(*) FILTER (p) AS n, sum(x) AS size, sum(x) FILTER (p) AS sx, sum(y) FILTER (p) AS sy, sum(x * x) FILTER (p) AS sxx, sum(x * y) FILTER (p) AS sxy, sum(y * y) FILTER (p) AS syy FROM p),
r AS (SELECT *, sy / sx AS r FROM s), t AS (SELECT *, r * size AS total, sqrt(greatest(syy - 2 * r * sxy + r * r * sxx, 0) / (n - 1) * (1 - n / rows) / n) * rows AS error FROM r)
SELECT rows, n AS sampled, round(size, 3) AS size, round(total, 3) AS total, round(error, 3) AS error, round(total - 1.96 * error, 3) AS low, round(total + 1.96 * error, 3) AS high FROM t""")
def token_totals(s, d):
    return samples.estimated_total(_docs(s, d), ["doc_id"], F.length("text"), T.estimated_tokens(F.col("text")), 0.2)


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH c AS (SELECT doc_id, text, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, text, string_split(text, '') AS l FROM documents WHERE text <> '')),
u AS (SELECT doc_id, pos, coalesce(sum(CASE WHEN unicode(ch) > 127 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4 AS tok FROM c),
t AS (SELECT doc_id, tok, min(pos) AS p FROM u GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
w AS (SELECT doc_id, n, last, unnest(range(0, last + 1)) AS k FROM (SELECT *, greatest(ceil((n - {size}) / {step}), 0)::BIGINT AS last FROM n))
SELECT w.doc_id, w.doc_id || '_chunk_' || k AS id, k AS chunk_idx, k * {step} AS first, least({size}, n - k * {step}) AS tokens, a.p AS "at", CASE WHEN last = 0 THEN 'full' WHEN k = 0 THEN 'start' WHEN k = last THEN 'end' ELSE 'middle' END AS position, substr(text, a.p + 1, coalesce(b.p, length(text)) - a.p) AS text
FROM w JOIN documents d ON d.doc_id = w.doc_id JOIN t a ON a.doc_id = w.doc_id AND a.tok = k * {step} LEFT JOIN t b ON b.doc_id = w.doc_id AND b.tok = k * {step} + {size}"""


@query(_windows(300, 50))
def token_windows(s, d):
    return windows.token_windows(_docs(s, d), "doc_id", "text")


@query(_windows(500, 0))
def fixed_token_windows(s, d):
    return windows.fixed_windows(_docs(s, d), "doc_id", "text")


@query("""WITH f AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '0', 'g'), '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b|[A-Z]{2,}') AS l FROM documents),
e AS (SELECT doc_id, entity, count(*) AS hits, min(i) AS i FROM (SELECT doc_id, unnest(l) AS entity, generate_subscripts(l, 1) AS i FROM f) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS rank, entity, hits FROM e QUALIFY rank <= 10""")
def key_entities(s, d):
    return entities.key_entities(_docs(s, d), "doc_id", "text", F.col("lang"))


_NAMES = "[a-z]{11,}"


@query(f"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_NAMES}')) AS entity FROM benchmark),
h AS (SELECT doc_id, entity, list_filter(range(1, length(text) - length(entity) + 2), lambda i: substr(text, i, length(entity)) = entity) AS p FROM documents JOIN n ON contains(text, entity)),
f AS (SELECT doc_id, entity, len(p) AS hits, p[1] AS first FROM h)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, first, entity) AS rank, entity, hits FROM f QUALIFY rank <= 10""")
def named_in_dictionary(s, d):
    names = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0))).alias("name"))
    return entities.most_named(entities.by_dictionary(_docs(s, d), names, "doc_id", "text"), "doc_id")


@query()
def compound_keywords(s, d):
    words = table(s, d, "benchmark").select(F.explode_outer(F.regexp_extract_all("text", F.lit("[a-z]{2,5}"), F.lit(0))).alias("surface")).distinct()
    dictionary = words.select("surface", F.when(F.length("surface") > 2, "noun").otherwise("other").alias("pos"), (8.0 - F.length("surface")).alias("cost"))
    more = compounds.ranked(compounds.compounds(_docs(s, d), dictionary, "doc_id", "text", connections={("other", "noun"): 1.0}, most=20), "doc_id", 20)
    return keywords.integrated(_docs(s, d), "doc_id", "text", 10, STOP, IMPORTANT, more)


@query("SELECT vec_id, label, len(embedding)::INT AS size FROM embeddings WHERE label = 3")
def paged_points(s, d):
    points.register(s)
    folder = f"{shared_folder(s)}/quern-points-{uuid.uuid4().hex}"
    table(s, d, "embeddings").write.parquet(folder)
    read = s.read.format(points.NAME).option("key", "vec_id").option("partitions", 4).load(folder.removeprefix("file://"))
    return read.where("label = 3").select("vec_id", "label", F.size("embedding").alias("size"))


_NAMED = "SELECT vec_id, embedding::DOUBLE[] AS e, [x * (CASE WHEN i % 2 = 0 THEN -1 ELSE 1 END) for x, i in embedding::DOUBLE[]][1:16] AS f FROM embeddings"


@query(f"SELECT query_id, rank, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(q.f, p.f), 6) AS sim FROM ({_NAMED}) q, ({_NAMED}) p WHERE q.vec_id % 50 = 0)) WHERE rank <= 3")
def named_vectors(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("whole"))
    part = F.slice(F.transform("whole", lambda x, i: F.when(i % 2 == 1, -x).otherwise(x)), 1, 16)
    both, root = v.withColumn("part", part), f"{shared_folder(s)}/quern-named-{uuid.uuid4().hex}"
    kinds = {"whole": named.Vector(64), "part": named.Vector(16)}
    for k in range(2):
        named.create(s, f"{root}/{k}", kinds)
        named.put(both.where(F.col("vec_id") % 2 == k), f"{root}/{k}", 0, "vec_id")
    named.merged(s, [f"{root}/0", f"{root}/1"], f"{root}/all", "vec_id")
    return named.search(s, f"{root}/all", both.where("vec_id % 50 = 0"), "part", 3, "vec_id")


@query(f"SELECT count(*) AS chunks, count(*) FILTER (best >= 0.4) AS covered, round(avg((best >= 0.4)::INT::DOUBLE), 6) AS rate, round(avg(best), 6) AS mean, min(best) AS least, max(best) AS most, count(*) FILTER (best >= 0.7) AS high, count(*) FILTER (best >= 0.5 AND best < 0.7) AS medium, count(*) FILTER (best < 0.5) AS low FROM {_BEST}")
def coverage_bands(s, d):
    return coverage.bands(_best(s, d), 0.4)


@query("WITH s AS (SELECT source FROM documents ORDER BY md5('42:' || doc_id) LIMIT 200), n AS (SELECT count(*) AS n FROM s), t AS (SELECT count(*) AS total FROM documents) SELECT coalesce(source, 'unknown') AS source, count(*) AS sampled, round(100 * count(*)::DOUBLE / any_value(n), 6) AS percent, floor(any_value(total) * count(*)::DOUBLE / any_value(n))::BIGINT AS estimated FROM s, n, t GROUP BY 1")
def sampled_sources(s, d):
    docs = _docs(s, d).select("doc_id", "source")
    return reports.source_shares(samples.sampled(docs, 200, ["doc_id"]), "source", docs.count())


_KEYS = ORACLES["keywords_by_score"]


@query(f"SELECT doc_id, count(*)::INT AS keywords, round(avg(contains(text, term)::INT::DOUBLE), 6) AS coverage, round(avg((length(term) >= 4)::INT::DOUBLE), 6) AS compound, round(avg(regexp_matches(term, '^([ァ-ヴー]{{3,}}|[A-Z]{{2,}}|[一-龥]{{4,}})$')::INT::DOUBLE), 6) AS technical FROM ({_KEYS}) JOIN documents USING (doc_id) GROUP BY 1")
def keyword_potential(s, d):
    found = keywords.by_score(_docs(s, d), "doc_id", "text", 10, STOP, IMPORTANT)
    return keywords.potential(found, _docs(s, d), "doc_id", "text")


@query()
def concept_terms(s, d):
    found = keywords.by_score(_docs(s, d), "doc_id", "text", 5, STOP, IMPORTANT)
    return keywords.concepts(found, _docs(s, d), "doc_id", "text", "en", 7).select("doc_id", F.explode_outer("concepts").alias("term"))


@query("SELECT event_id, CASE WHEN c >= 0.8 + user_id % 3 * 0.05 THEN 'silent' WHEN c >= 0.6 + user_id % 3 * 0.05 THEN 'notify' WHEN c >= 0.3 + user_id % 3 * 0.05 THEN 'confirm' ELSE 'escalate' END AS level FROM (SELECT event_id, user_id, value / (1 + abs(value)) AS c FROM events)")
def levels_by_thresholds(s, d):
    events = table(s, d, "events").withColumn("c", F.col("value") / (1 + F.abs("value")))
    least = lambda x: F.lit(x) + F.col("user_id") % 3 * 0.05
    return events.select("event_id", confidence.level(F.col("c"), least(0.8), least(0.6), least(0.3)).alias("level"))


@query("""WITH p AS (SELECT doc_id % 10 AS batch, doc_id, source || '何ですか' AS question, lang AS answer, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS r FROM documents)
SELECT batch, source || '何ではありませんか' AS question, answer || 'ではないものを指します。' AS answer, 'adversarial_negation' AS type FROM (SELECT p.*, d.source FROM p JOIN documents d USING (doc_id)) WHERE r <= 5
UNION ALL SELECT DISTINCT batch, unnest(['この文書に書かれていない情報は何ですか？', 'それは何を指していますか？']), unnest(['文書には含まれていない情報です。', '文脈により異なります。']), unnest(['out_of_context', 'ambiguous_reference']) FROM p""")
def adversarial_questions(s, d):
    pairs = _docs(s, d).select((F.col("doc_id") % 10).alias("batch"), "doc_id", F.concat("source", F.lit("何ですか")).alias("question"), F.col("lang").alias("answer"))
    return questions.adversarial(pairs, "batch", "doc_id")
