"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import collocations, decontamination, language, licenses, lines, quality, repeats, search, secrets, segmentation, simhash, toxicity, trie
from quern.sources.tables import table


def op1_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.top_k(docs, search.every_twentieth(docs))


def op2_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.deduplicate(table(spark, d, "documents"))


def op3_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op4_segmentations(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.encode(table(spark, d, "documents"))


def op5_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op8_language(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "documents"))


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op11_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.deduplicate(table(spark, d, "documents")).drop("kept")


def op12_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.of_conversations(table(spark, d, "conversations"))


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.mined(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_search, op2_repeats, op3_licenses, op4_segmentations, op5_secrets, op6_decontamination, op7_simhash, op8_language, op9_toxicity, op10_quality, op11_lines, op12_trie, op13_collocations)}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({i}, '{label}', string_split('{words}', ' '))" for i, (label, words) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', string_split('{words}', ' '))" for words, label in licenses.PHRASES.items())
_LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
t(template, label, w) AS (VALUES {_TEMPLATES}), p(label, w) AS (VALUES {_PHRASES}),
tg AS (SELECT template, label, len(w) AS size, w, unnest(range(1, len(w) - 1)) AS place FROM t),
dg AS (SELECT row, w, unnest(range(1, len(w) - 1)) AS pos FROM d),
v AS (SELECT row, template, label, size, pos - place AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM dg JOIN tg ON dg.w[pos] = tg.w[place] AND dg.w[pos + 1] = tg.w[place + 1] AND dg.w[pos + 2] = tg.w[place + 2] GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {licenses.GAP} THEN 0 ELSE 1 END AS new FROM v),
r AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS run FROM n),
m AS (SELECT row, label, size, max(hi) + 3 - min(lo) AS wide, least(sum(votes) + 2 * count(*), max(hi) + 3 - min(lo)) AS matched FROM r GROUP BY row, template, label, size, run),
f AS (SELECT row, label, least(matched / size, 1) AS share FROM m WHERE matched >= {licenses.LEAST_SHARE}::DOUBLE * least(size, greatest(wide, 16))),
b AS (SELECT row, label, pos - 1 AS pos FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS pos FROM d) x, p WHERE x.w[pos] = p.w[1] AND x.w[pos : pos + len(p.w) - 1] = p.w),
k AS (SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT row, label, share FROM f UNION ALL SELECT row, label, 1 FROM b) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(share, 0)::DOUBLE, 6) AS score
FROM d LEFT JOIN k USING (row) LEFT JOIN a USING (row)"""


def _found(kind: str, pattern: str) -> str:
    gaps = f"string_split_regex(text, '{pattern}')"
    return f"SELECT row, {kind} AS kind, hit[i] AS hit, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT row, {gaps} AS gap, regexp_extract_all(text, '{pattern}') AS hit, unnest(range(1, len(hit) + 1)) AS i FROM d)"


_BASE = " UNION ALL ".join(_found(str(k), p) for k, p in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX)))
_DENSE = " UNION ALL ".join(_found(f"{least}::DOUBLE", p) for p, least in secrets.CLASSES)
_SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
b AS ({_BASE}), c AS ({_DENSE}),
w AS (SELECT row, s, kind AS least, hit, unnest(range(1, length(hit) - {secrets.WINDOW - 2})) AS i FROM c WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '{secrets.ALLOWED.split("|(.)")[0]}')
AND len(list_filter(range(1, length(hit) - 4), lambda j: substr(lower(hit), j, 6) = repeat(substr(lower(hit), j, 1), 6))) = 0),
e AS (SELECT row, least, s, min(i) - 1 AS lo, max(i) + {secrets.WINDOW - 1} AS hi FROM w WHERE list_aggregate(string_split(substr(hit, i, {secrets.WINDOW}), ''), 'entropy') >= least GROUP BY ALL),
x AS (SELECT row, kind, s, s + length(hit) AS e FROM b WHERE kind <> 0 OR length(regexp_extract(hit, '{secrets.ASSIGN}', 2)) >= 6 UNION SELECT row, 3, s + lo, s + hi FROM e),
y AS (SELECT *, ({list(secrets.KINDS)})[kind + 1] || ':' || s || ':' || e AS t FROM x),
g AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, string_agg(t, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind, e) AS spans FROM y GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""
_LINES = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT row, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS owner FROM e WHERE length(k) >= {lines.LEAST} GROUP BY 1),
g AS (SELECT row, e.doc_id, i, line, o.owner IS NOT NULL AND (e.doc_id IS NULL OR e.doc_id > o.owner) AS gone FROM e LEFT JOIN o USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY row"""
_BITS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {_BITS}), 4294967295) % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {trie.GROUP} AND pos <= h UNION ALL SELECT conv_id, pos, role, text FROM t JOIN c USING (conv_id) WHERE pos > h),
w AS (SELECT conv_id, coalesce(w, []) AS w FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS w FROM b GROUP BY 1) USING (conv_id)),
p AS (SELECT conv_id, len(w) AS size, depth, w[1:depth] AS k FROM (SELECT *, unnest(range(0, len(w) + 1)) AS depth FROM w)),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(k[depth].text) END AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM p GROUP BY k, depth),
x AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.k[1:n.depth] = n.k) AS n_children, q.conv_id AS parent_conv_id FROM n LEFT JOIN n q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.k = n.k[1:n.depth - 1]),
u AS (SELECT k[1:d] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM x) GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN u USING (k)"""
_COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f, any_value(w[i:i + k - 1]) AS v FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k)) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, v, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= {collocations.LEAST}),
s AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, sub, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS sub FROM c WHERE k = 3) GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.sub = b.phrase WHERE longer IS NULL OR 100 * longer < {collocations.INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}"""
ORACLES: dict[str, str] = {"op3_licenses": _LICENSES, "op5_secrets": _SECRETS, "op11_lines": _LINES, "op12_trie": _TRIE, "op13_collocations": _COLLOCATIONS}
