"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.rows import versions, without
from quern.llm.words import let, words
from quern.sources.tables import written

#: Five words each, at these offsets; the positions between may differ. At every place each is tried. Together they hit every stretch of up to
#: 16 words that begins and ends with equal words and has LEAST_WORDS of them and LEAST_SHARE or more.
MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 4, 7), (0, 1, 2, 3, 4), (0, 1, 4, 5, 6))
SPAN = 1 + max(max(m) for m in MASKS)
#: AROUND is the margin of the tests' narrower version.
AROUND, LEAST_WORDS, LEAST_SHARE = 5, 8, 0.8
#: A differing word takes away what so many equal ones add: a stretch of LEAST_SHARE weighs 0.
COST = round(LEAST_SHARE / (1 - LEAST_SHARE))
#: Test seeds (24 bytes each) that are broadcast; more meet the documents' seeds by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: A document's hits go on in so many parts, by item.
PARTS = 16


def seeds(tokens: Column, k: int) -> Column:
    """array<bigint>: the seed of mask k at each place where it fits."""
    span = 1 + max(MASKS[k])
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(tokens, i + (o - 1)) for o in MASKS[k]])
    return F.when(F.size(tokens) >= span, F.transform(F.sequence(F.lit(1), F.size(tokens) - (span - 1)), at)).otherwise(F.array().cast("array<bigint>"))


def stretches(same: Column) -> Column:
    """struct<at,w,low,equal,size,first,last> of an array<boolean> that says where aligned words are equal.

    Looks at stretches that begin and end with an equal word, have LEAST_WORDS of them and LEAST_SHARE or more: equal words and size of the one
    with most (of those the shortest), first and last place in any. equal is 0 if there are none. `low` has, by how far the weight of all words up to
    there is under 0, the first place where a stretch can begin; so the longest stretch that ends at a place is looked up.
    """

    def step(a: Column, e: Column) -> Column:
        deeper = F.greatest(1 - a["w"] - F.size(a["low"]), F.lit(0))
        low = F.concat(a["low"], F.array_repeat(F.struct(a["at"].alias("at"), a["w"].alias("w")), deeper))

        def longest(low: Column) -> Column:
            return let(F.get(low, F.greatest(-1 - a["w"], F.lit(0))), lambda x: judged(low, x, a["at"] + 1 - x["at"]))

        def judged(low: Column, x: Column, size: Column) -> Column:
            def better(equal: Column) -> Column:
                on = equal >= LEAST_WORDS
                new = on & ((equal > a["equal"]) | ((equal == a["equal"]) & (size < a["size"])))
                return F.struct(
                    (a["at"] + 1).alias("at"), (a["w"] + 1).alias("w"), low.alias("low"),
                    F.when(new, equal).otherwise(a["equal"]).alias("equal"), F.when(new, size).otherwise(a["size"]).alias("size"),
                    F.when(on, F.least(a["first"], x["at"])).otherwise(a["first"]).alias("first"), F.when(on, a["at"]).otherwise(a["last"]).alias("last"),
                )

            return let(((size * COST + a["w"] + 1 - x["w"]) / (COST + 1)).cast("int"), better)

        rest = [a[c].alias(c) for c in ("low", "equal", "size", "first", "last")]
        return F.when(e, let(low, longest)).otherwise(F.struct((a["at"] + 1).alias("at"), (a["w"] - COST).alias("w"), *rest))

    none = F.array().cast("array<struct<at:int,w:int>>")
    zero = {"at": F.lit(0), "w": F.lit(0), "low": none, "equal": F.lit(0), "size": F.lit(0), "first": F.lit(2**31 - 1), "last": F.lit(-1)}
    return F.aggregate(same, F.struct(*[v.alias(c) for c, v in zero.items()]), step)


def overlooked(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words): the items that are never looked for, as they have under LEAST_WORDS words; null texts have 0."""
    return benchmark.select("item_id", F.size(words(F.col("text"))).alias("n_words")).where(F.col("n_words") < LEAST_WORDS)


def _hashes(tokens: Column) -> Column:
    """array<bigint>: a hash of each word. Seeds are hashes of these; the words themselves are compared at the hits."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _exploded(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """(keep, h, at): the seeds of all masks and their places; one flat array a row, from whose places the masks follow."""
    sized = rows.withColumn("size", F.size(tokens))  # beforehand, or every seed's row would carry the words along
    flat = sized.select(*keep, "size", F.posexplode_outer(F.concat(*[seeds(F.col(tokens), k) for k in range(len(MASKS))])).alias("pos", "h"))  # not posexplode: its inferred filters would make the array again
    return flat.select(*keep, "h", _place(F.col("pos"), F.col("size"), 0).alias("at"))


def _place(pos: Column, size: Column, k: int) -> Column:
    """The place in its mask's seeds of what stands at `pos` from where those of mask k begin."""
    if k == len(MASKS) - 1:
        return pos
    own = F.greatest(size - max(MASKS[k]), F.lit(0))
    return F.when(pos < own, pos).otherwise(_place(pos - own, size, k + 1))


def hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, version, part, hits): for each document the items and diagonals (place in the document less place in the item) that a seed of both tells.

    Only seeds meet here, no texts: a test seed is its hash, its item's number and its place. documents: doc_id, version, d; items: item, b; d and b are hashes of words.
    """
    tests = _exploded(items.withColumn("n", F.size("b")), "b", "item", "n").select(F.col("h").alias("test"), "item", "n", F.col("at").alias("j"))
    tests = F.broadcast(tests) if tests.count() <= BROADCAST_SEEDS else tests.hint("merge")  # by itself Spark would size them before they are exploded
    each = _exploded(documents, "d", "doc_id", "version").join(tests, F.col("h") == F.col("test"))
    diagonals = each.groupBy("doc_id", "version", "item", "n", (F.col("at") - F.col("j")).alias("diagonal")).agg(F.lit(1).alias("_one"))
    return diagonals.groupBy("doc_id", "version", F.pmod(F.xxhash64("item"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item", "n", "diagonal")).alias("hits"))


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps of documents with benchmark items, those changed by substitutions included.

    Both sides' seeds of all masks meet by an equality join (see `hits`); then a document's words and an item's are laid together as each hit tells:
    a stretch of them with LEAST_WORDS equal ones, at a share of LEAST_SHARE at least, is an overlap. A document goes to its hits once for each part of the items, and
    of it only what lies along the item goes to the item. Returns per
    (doc_id, item_id): words equal at best, their share, and the first and last word of the document concerned. Texts
    that are null or have under 8 words give no rows, nor do items (see `overlooked`); a null doc_id or item_id is kept; repeated rows give one
    pair; without test seeds there are no rows; other columns are ignored.
    """
    named = benchmark.select("item_id", words(F.col("text")).alias("b")).where(F.size("b") >= LEAST_WORDS).select("item_id", "b", F.xxhash64("item_id", F.col("item_id").isNull(), "b").alias("item")).dropDuplicates(["item"])
    items = written(named, "items")
    texts = documents.select("doc_id", F.xxhash64("text").alias("version"), "text")
    found = hits(texts.select("doc_id", "version", _hashes(words(F.col("text"))).alias("d")), items.select("item", _hashes(F.col("b")).alias("b")))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version"), "hits")
    own = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version"))
    met = texts.join(found, own)

    def along(d: Column) -> Column:
        def one(h: Column) -> Column:
            begin = F.greatest(h["diagonal"], F.lit(0))
            return F.struct(h["item"].alias("hit"), begin.alias("from"), (begin - h["diagonal"]).alias("j"), F.slice(d, begin + 1, F.least(F.size(d) - begin, h["n"] + h["diagonal"] - begin)).alias("p"))

        return F.transform("hits", one)

    pieces = met.select("doc_id", F.inline_outer(let(words(F.col("text")), along)))
    laid = pieces.join(items, F.col("hit") == F.col("item"))
    same = F.zip_with("p", F.slice("b", F.col("j") + 1, F.size("p")), lambda p, q: p == q)
    rows = laid.select("doc_id", "item_id", "from", same.alias("same")).where(F.size(F.filter("same", lambda e: e)) >= LEAST_WORDS)
    best = rows.select("doc_id", "item_id", "from", F.inline_outer(F.array(stretches(F.col("same"))))).where(F.col("equal") >= LEAST_WORDS)
    return best.groupBy("doc_id", "item_id").agg(
        F.max("equal").alias("equal"), F.max(F.col("equal") / F.col("size")).alias("share"), F.min(F.col("from") + F.col("first")).alias("first_word"), F.max(F.col("from") + F.col("last")).alias("last_word")
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`documents` without those that overlap a benchmark item.

    Each row is judged by its own text, whether its doc_id is null or that of others; null and empty texts stay.
    """
    named = versions(documents).select(F.struct("doc_id", "version").alias("doc_id"), "text")
    return without(documents, overlaps(named, benchmark).select("doc_id.*"))
