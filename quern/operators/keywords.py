"""Keywords of documents."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.functions.keywords import occurrences as places
from quern.functions.text import TECHNICAL, TERM, terms
from quern.sources.tables import written

REPEATED = 500_000  # keys of several rows that are broadcast; more are joined by a shuffle
FOUND = re.compile(TERM).findall

# Terms that mean the same, the shorter one first.
SYNONYMS = {"AI": "人工知能", "ML": "機械学習", "DL": "深層学習", "NLP": "自然言語処理", "DX": "デジタルトランスフォーメーション"}


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n, at): candidate terms, how often and where first."""
    each = df.select(key, F.posexplode(terms(F.col(text))).alias("at", "term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("at").cast("bigint").alias("at"))


def apart(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """`df` in two: rows whose key no other row has, and those that share theirs (None if there are none). Only keys are shuffled, but where over REPEATED repeat."""
    again = written(df.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_again"), "keys")
    n = again.count()
    if not n:
        return df, None
    again = F.broadcast(again) if n <= REPEATED else again
    same = F.col(key).eqNullSafe(F.col("_again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def counted(stop: list[str], n: int | None = None, pieces: int = 256):
    """A function of a text: array<struct<term, n, at>> of its terms without stop words and single characters, by first place; the n most frequent by falling n.

    A text is counted within its row; so many texts of a batch are Python objects at once.
    """
    left, kind = frozenset(stop), pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64()), ("at", pa.int64())]))

    def one(text: str | None) -> list[tuple[str, int, int]]:
        found = FOUND(text) if text else []
        counts, first = Counter(found), dict(zip(reversed(found), range(len(found) - 1, -1, -1), strict=True))
        own = [(t, c, first[t]) for t, c in counts.items() if len(t) > 1 and t.lower() not in left]
        return own if n is None else sorted(own, key=lambda x: -x[1])[:n]

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), pieces):
            rows = [one(t) for t in texts.slice(i, pieces).to_pylist()]
            flat = [x for r in rows for x in r]
            columns = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            ends = np.cumsum([0] + [len(r) for r in rows])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "n", "at"])))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return F.arrow_udf(run, "array<struct<term: string, n: bigint, at: bigint>>")


def by_frequency(df: DataFrame, key: str, text: str, n: int, stop: list[str]) -> DataFrame:
    """(key, rank, term, n): the n most frequent terms; stop words and single characters don't count; ties by first place.

    Terms are counted within a row; rows that share a key are one text by parts, counted by a shuffle.
    """
    alone, shared = apart(df, key)
    each = alone.select(key, F.posexplode(counted(stop, n)(F.col(text))).alias("_i", "_x"))
    out = each.select(key, (F.col("_i") + 1).alias("rank"), F.col("_x.term").alias("term"), F.col("_x.n").alias("n"))
    if shared is None:
        return out
    found = occurrences(shared, key, text).where((F.length("term") > 1) & ~F.lower("term").isin(stop))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "at"))
    return out.unionByName(found.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "term", "n"))


def by_score(df: DataFrame, key: str, text: str, n: int, stop: list[str], important: list[str]) -> DataFrame:
    """(key, rank, term, score): frequency to 3 and length to 8 weigh 0.3 each, importance 0.5, and script 0.2 or 0.3. Counted as by `by_frequency`."""

    def score(t: Column, often: Column) -> Column:
        script = F.when(t.rlike("^[ァ-ヴー]{3,}$"), 0.2).when(t.rlike("^[A-Z]{2,}"), 0.3).when(t.rlike("^[一-龥]{4,}$"), 0.2).otherwise(0.0)
        return F.round(F.least(often / 3, F.lit(1.0)) * 0.3 + F.least(F.length(t) / 8, F.lit(1.0)) * 0.3 + F.when(t.isin(important), 0.5).otherwise(0.0) + script, 6)

    alone, shared = apart(df, key)
    scored = F.transform(counted(stop)(F.col(text)), lambda x: F.struct((-score(x["term"], x["n"])).alias("s"), x["at"].alias("at"), x["term"].alias("t")))
    each = alone.select(key, F.posexplode(F.slice(F.array_sort(scored), 1, n)).alias("_i", "_x"))
    out = each.select(key, (F.col("_i") + 1).alias("rank"), F.col("_x.t").alias("term"), (-F.col("_x.s")).alias("score"))
    if shared is None:
        return out
    t = F.col("term")
    found = occurrences(shared, key, text).where((F.length(t) > 1) & ~F.lower(t).isin(stop)).withColumn("score", score(t, F.col("n")))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "at"))
    return out.unionByName(found.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "term", "score"))


def without_contained(found: DataFrame, key: str) -> DataFrame:
    """`found` (key, term) without terms that a longer term of the same key contains. A key's terms are few: a top-n."""
    longer = found.select(F.col(key).alias("k"), F.col("term").alias("whole"))
    return found.join(longer, (F.col(key) == F.col("k")) & F.col("whole").contains(F.col("term")) & (F.length("whole") > F.length("term")), "left_anti")


def enough(ranked: DataFrame, key: str, text: str, target: float, least: int = 3) -> DataFrame:
    """(key, n, covered): how few of the ranked terms (key, rank, term, text), at least `least`, cover that share of the text; all if none do.

    Terms that overlap count each.
    """
    part = F.length("term") * places(F.col(text), F.col("term"))
    so_far = F.sum(part).over(W.partitionBy(key).orderBy("rank")) / F.length(text)
    each = ranked.select(key, "rank", so_far.alias("_c"))
    met = F.when((F.col("rank") >= least) & (F.col("_c") >= target), F.struct("rank", "_c"))
    one = each.groupBy(key).agg(F.coalesce(F.min(met), F.max(F.struct("rank", "_c"))).alias("_b"))
    return one.select(key, F.col("_b.rank").alias("n"), F.round("_b._c", 6).alias("covered"))


def without_synonyms(found: DataFrame, key: str) -> DataFrame:
    """`found` (key, term) without short terms whose long form the same key has; follows `without_contained`."""
    long = F.coalesce(*[F.when(F.col("term") == a, b) for a, b in SYNONYMS.items()])
    there = found.select(F.col(key).alias("_k"), F.col("term").alias("_t"))
    return found.withColumn("_long", long).join(there, (F.col(key) == F.col("_k")) & (F.col("_long") == F.col("_t")), "left_anti").drop("_long")


def only_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """`new` (key, term) without the terms of `old` and their synonyms."""
    either = F.coalesce(*[F.when(F.col("term") == a, b).when(F.col("term") == b, a) for a, b in SYNONYMS.items()])
    known = old.select(F.col(key).alias("_k"), F.explode(F.array_compact(F.array("term", either))).alias("_t"))
    return new.join(known, (F.col(key) == F.col("_k")) & (F.col("term") == F.col("_t")), "left_anti")


def covered_share(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(key, covered): the share of a text's characters that places of its terms (key, term) cover; a character counts once.

    A text is cut before every place of a term, those that overlap included, so its pieces give where the places start.
    Empty and null texts and texts without terms give 0.
    """
    rows = df.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_text"))
    both = found.select(key, "term").where("term <> ''").join(rows, F.col(key) == F.col("_k"))
    before = F.concat(F.lit("(?=\\Q"), F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    size = F.length("term")
    cut = both.select("_k", "term", F.col("_text").startswith(F.col("term")).alias("_first"), F.posexplode(F.split("_text", before, -1)).alias("_i", "_piece"))
    so_far = F.sum(F.length("_piece")).over(W.partitionBy("_k", "term").orderBy("_i"))
    places_ = cut.withColumn("_s", so_far - F.length("_piece")).where((F.col("_i") > 0) | F.col("_first")).select("_k", "_s", (F.col("_s") + size).alias("_e"))
    reached = F.max("_e").over(W.partitionBy("_k").orderBy("_s", "_e").rowsBetween(W.unboundedPreceding, -1))
    fresh = places_.select("_k", F.greatest(F.lit(0), F.col("_e") - F.greatest("_s", F.coalesce(reached, F.lit(0)))).alias("_n"))
    n = fresh.groupBy("_k").agg(F.sum("_n").alias("_n"))
    out = df.select(key, F.length(F.coalesce(text, F.lit(""))).alias("_size")).join(n, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.round(F.coalesce(F.col("_n") / F.nullif("_size", F.lit(0)), F.lit(0.0)), 6).alias("covered"))


def progressive(ranked: DataFrame, key: str, text: str, ends: tuple[int, ...] = (5, 10, 20, 30, 40), least: float = 0.05, falling: bool = False) -> DataFrame:
    """(key, rank, term) of `ranked` (key, rank, term, text) by batches up to these ranks, until one adds under `least` to the share of the text covered.

    Shares are added up in order of rank (`falling`: from the last rank of a batch to the first), as a sum of doubles near `least` depends on it. A key's terms are few: a top-n.
    """
    own = F.length("term") * places(F.col(text), F.col("term")) / F.length(text)
    lists = ranked.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("rank", own.alias("own"))), not falling).alias("_l"))

    def share(end: int) -> Column:
        return F.aggregate(F.filter("_l", lambda x: x["rank"] <= end), F.lit(0.0), lambda a, x: a + F.coalesce(x["own"], F.lit(0.0)))

    shares = [share(e) for e in ends]
    stop = F.coalesce(*[F.when(b - a < least, e) for a, b, e in zip([F.lit(0.0), *shares], shares, ends, strict=False)], F.lit(ends[-1]))
    last = lists.select("_k", stop.alias("_stop"))
    return ranked.join(last, (F.col(key) == F.col("_k")) & (F.col("rank") <= F.col("_stop"))).select(key, "rank", "term")


def integrated(df: DataFrame, key: str, text: str, n: int, stop: list[str], important: list[str], more: DataFrame | None = None) -> DataFrame:
    """(key, rank, term, score): the best n by `K.score` of the 2n most frequent terms and of `more` (key, rank, term), such as an analyser's compound nouns.

    A document's candidates are few and are scored beside its text, which moves once. Ties by the better rank of the two lists.
    """
    found = by_frequency(df, key, text, 2 * n, stop).select(key, "rank", "term")
    if more is not None:
        other = more.where((F.length("term") > 1) & ~F.lower("term").isin(stop) & (F.col("rank") <= 2 * n))
        found = found.unionByName(other.select(key, "rank", "term")).groupBy(key, "term").agg(F.min("rank").alias("rank"))
    return rescored(found, df, key, text, important, n)


def _hits(texts: pa.Array, lists: pa.Array) -> pa.Array:
    """How often each of a text's terms stands in it without overlap."""
    rows = [[t.count(x) if t is not None and x else None for x in own.as_py() or []] for t, own in zip((t.as_py() for t in texts), lists, strict=True)]
    return pa.array(rows, pa.list_(pa.int32()))


def rescored(found: DataFrame, df: DataFrame, key: str, text: str, important: list[str], n: int) -> DataFrame:
    """(key, rank, term, score): the best n of a document's few terms (key, rank, term) by `K.score`; ties by rank, then term."""
    lists = found.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("rank", "term")).alias("_l"))
    both = df.select(key, F.col(text).alias("_text")).join(lists, F.col(key) == F.col("_k"))
    both = both.select(key, "_l", F.arrow_udf(_hits, "array<int>")(F.col("_text"), F.col("_l.term")).alias("_n"))
    scored = F.zip_with("_l", "_n", lambda x, c: F.struct((-F.round(K.score(x["term"], c, important), 6)).alias("s"), x["rank"].alias("r"), x["term"].alias("t")))
    each = both.select(key, F.posexplode(F.slice(F.array_sort(scored), 1, n)).alias("_i", "_x"))
    return each.select(key, (F.col("_i") + 1).alias("rank"), F.col("_x.t").alias("term"), (-F.col("_x.s")).alias("score"))


def by_all_methods(df: DataFrame, key: str, text: str, n: int, stop: list[str], important: list[str], more: DataFrame | None = None) -> DataFrame:
    """(key, method, rank, term, score) of the methods side by side, all scored alike: frequency, score, integrated, and analyser if `more` is given."""
    lists = {"frequency": by_frequency(df, key, text, n, stop), "score": by_score(df, key, text, n, stop, important)}
    if more is not None:
        lists = {"analyser": more} | lists
    found = {m: rescored(x.where(F.col("rank") <= n).select(key, "rank", "term"), df, key, text, important, n) for m, x in lists.items()}
    found["integrated"] = integrated(df, key, text, n, stop, important, more)
    out = [x.withColumn("method", F.lit(m)) for m, x in found.items()]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0].select(key, "method", "rank", "term", "score")


def best_method(found: DataFrame, df: DataFrame, key: str, text: str, methods: tuple[str, ...] = ("analyser", "frequency", "score", "integrated")) -> DataFrame:
    """(key, method, total, terms): of `by_all_methods` the list with the greatest total of the five metrics; ties by the order of `methods`."""
    lists = found.groupBy(F.col(key).alias("_k"), "method").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_l"))
    sets = lists.groupBy("_k").agg(F.collect_list(F.struct("method", F.col("_l.term").alias("terms"))).alias("_sets"))
    both = df.select(key, F.col(text).alias("_text")).join(sets, F.col(key) == F.col("_k"))
    order = F.array(*[F.lit(m) for m in methods])
    each = F.transform("_sets", lambda x: F.struct((-F.round(K.total(K.metrics(x["terms"], F.col("_text"))), 6)).alias("s"), F.array_position(order, x["method"]).alias("o"), x["method"].alias("m"), x["terms"].alias("t")))
    best = both.select(key, F.array_min(each).alias("_b"))
    return best.select(key, F.col("_b.m").alias("method"), (-F.col("_b.s")).alias("total"), F.col("_b.t").alias("terms"))


def potential(found: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, keywords, coverage, compound, technical): of a text's keywords (key, term) the shares that stand in it, that have four characters or more, and that are technical terms."""
    lists = found.groupBy(F.col(key).alias("_k")).agg(F.collect_list("term").alias("_l"))
    both = df.select(key, F.col(text).alias("_t")).join(lists, F.col(key) == F.col("_k"))
    share = lambda test: F.round(F.size(F.filter("_l", test)) / F.size("_l"), 6)
    return both.select(
        key, F.size("_l").alias("keywords"), share(lambda t: F.contains(F.col("_t"), t)).alias("coverage"), share(lambda t: F.length(t) >= 4).alias("compound"), share(lambda t: t.rlike(f"^({K.TECHNICAL})$")).alias("technical")
    )


def concepts(ranked: DataFrame, df: DataFrame, key: str, text: str, lang: str = "ja", n: int = 5) -> DataFrame:
    """(key, concepts): of each text its keywords (key, rank, term) in order, then its first three technical terms, each once, n at most."""
    lists = ranked.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_l"))
    both = df.select(key, F.col(text).alias("_t")).join(lists, F.col(key) == F.col("_k"), "left")
    technical = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce("_t", F.lit("")), F.lit(TECHNICAL[lang]), F.lit(0))), 1, 3)
    own = F.coalesce(F.col("_l.term"), F.array().cast("array<string>"))
    return both.select(key, F.slice(F.array_distinct(F.concat(own, technical)), 1, n).alias("concepts"))
