"""Phrase collocations: candidates by a sketch's upper bounds, counted by automata."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.tables import written

WORDS, LEAST, TOP = (2, 3), 10, 2_000  # words of a phrase, its least count, phrases given out for each language
INSIDE = 50  # percent of a phrase's count at which a longer one takes its place
BITS, MOST_BITS = 26, 30  # the sketch has 2 ** BITS counters of one byte, more in a larger corpus
LOAD = 3.75  # bytes of text for each counter, at most: about 1.25 places of phrases
CHUNK = 1 << 18  # counters that are added up together
HELD = 1 << 22  # places of phrases that a task holds before it gives out their counters
SHARD = 1 << 18  # characters of text that one automaton is for, or one document
BATCH, ROWS = 1_000, 256  # rows that come to a task together, and those of them that are Python objects at once
KEYS, PHRASES = 150_000, 300_000  # words, phrases that a task holds before it gives out their counts
KEY_BYTES = 16_000_000  # and bytes of them
KNOWN = 50_000  # words whose hashes a task keeps
PACKED = 256  # chunks of a sketch that leave a task together
SALTS = 64
# Bytes that end a piece, and those between its words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if c in ENDS else 32 if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
UND = "und"


def tokens(texts: list[str]) -> list[str]:
    """The words of texts, A-Z lower-cased, with a line feed wherever a piece ends. No word has a space or a line feed."""
    flat = "\n".join(texts).encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass")
    return list(filter(None, flat.replace("\n", " \n ").split(" ")))


def cells(words: list[str], distinct: Iterable[str], salt: int, known: dict[str, int], bits: int = BITS) -> dict[int, np.ndarray]:
    """By the number of words: which of 2 ** bits counters the phrase that starts at each place has, -1 where it leaves its piece. salt: of the language; known: hashes so far."""
    if len(known) > KNOWN:
        known.clear()
    own = {}
    for w in distinct:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        own[w] = h
    own["\n"] = 0
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    inside = h != 0
    out, now, on = {}, h + np.uint64(salt), inside
    for n in range(2, max(WORDS) + 1):
        now, on = now[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15), on[: len(h) - n + 1] & inside[n - 1 :]
        now = (now ^ (now >> np.uint64(29))) + h[n - 1 :]
        mixed = (now ^ (now >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[n] = np.where(on, (mixed >> np.uint64(64 - bits)).astype(np.int64), -1)
    return out


def _salt(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(lang, tokens) of documents of one language: of SHARD characters or a document that is longer, less where many languages come by."""
    held, size = defaultdict(list), Counter()
    for batch in batches:
        for k0 in range(0, len(batch), ROWS):
            rows = batch.slice(k0, ROWS)
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] >= SHARD or size.total() >= 2 * SHARD:
                    for k in [lang] if size[lang] >= SHARD else list(held):
                        yield k, tokens(held.pop(k))
                        del size[k]
    for k in list(held):
        yield k, tokens(held.pop(k))


def _packed(bytes_: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bytes_.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


_LEARNED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


class Sums:
    """A task's counts (lang, key, n), in Arrow: the keys that wait are no Python objects.

    Those of the shards are added up when they have 2 * keys rows or 2 * KEY_BYTES bytes, and given out if that leaves half as much or more. Further columns are null.
    """

    def __init__(self, schema: pa.Schema, keys: int = KEYS):
        self.keys, self.schema, self.parts, self.rows, self.size = keys, schema, [], 0, 0

    def add(self, lang: str, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        part = pa.table([pa.repeat(lang, len(counts)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], self.schema.names[:3])
        self._hold([*self.parts, part])
        if self.rows >= 2 * self.keys or self.size >= 2 * KEY_BYTES:
            self._hold([self._summed()])
            if self.rows >= self.keys or self.size >= KEY_BYTES:
                yield from self.rest()

    def _hold(self, parts: list[pa.Table]) -> None:
        self.parts, self.rows, self.size = parts, sum(p.num_rows for p in parts), sum(p.nbytes for p in parts)

    def _summed(self) -> pa.Table:
        lang, key, n = self.schema.names[:3]
        table = pa.concat_tables(self.parts).group_by([lang, key], use_threads=False).aggregate([(n, "sum")])
        return table.select([lang, key, f"{n}_sum"]).rename_columns([lang, key, n])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            table = self._summed() if len(self.parts) > 1 else self.parts[0]
            self._hold([])
            for b in table.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(len(b), t) for t in self.schema.types[3:])], schema=self.schema)


def _parts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """These places' counters, each once with its count, by chunk: their differences in order by bytes (lowest first), then the counts, 255 at most."""
    flat = np.sort(np.concatenate(held))
    head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    n, own = np.minimum(np.diff(np.append(head, len(flat))), 255).astype(np.uint8), flat[head]
    chunk = own // np.uint32(CHUNK)
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])).tolist()
    rows = []
    for lo, hi in zip(first, [*first[1:], len(own)], strict=True):
        step = np.diff(own[lo:hi], prepend=chunk[lo] * np.uint32(CHUNK)).astype("<u4")
        rows.append((None, None, None, int(chunk[lo]), _packed(np.concatenate([step.view(np.uint8).reshape(-1, 4).T.ravel(), n[lo:hi]]))))
        if len(rows) == PACKED or hi == len(own):
            yield _rows(_LEARNED, rows)
            rows = []


def learned(batches: Iterator[pa.RecordBatch], bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """Counts of words (lang, word, n) and parts of a sketch of phrases (chunk, data) of a task's documents. Only counters that are met are held and sent, whatever the sketch's size."""
    sums, known, held, size = Sums(_LEARNED), {}, [], 0
    for lang, words in _shards(batches):
        each = Counter(words)
        del each["\n"]
        yield from sums.add(lang, each)
        for at in cells(words, each, _salt(lang), known, bits).values():
            held.append(at[at >= 0].astype(np.uint32))
            size += len(held[-1])
        if size >= HELD:
            yield from _parts(held)
            held, size = [], 0
    yield from sums.rest()
    if size:
        yield from _parts(held)


def _flags(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(chunk, data): whether each counter of a chunk is `least` or more. Parts come sorted by chunk: one chunk is held at a time."""
    schema, last, total = pa.schema([("chunk", pa.int32()), ("data", pa.binary())]), None, None
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if chunk != last:
                if last is not None:
                    yield _rows(schema, [(last, _packed(np.packbits(total >= least)))])
                last, total = chunk, np.zeros(CHUNK, np.uint8)
            own = _unpacked(data).reshape(5, -1)
            at = np.cumsum(own[:4].T.copy().view("<u4").ravel(), dtype=np.int64)
            total[at] = np.minimum(total[at].astype(np.uint16) + own[4], 255)
    if last is not None:
        yield _rows(schema, [(last, _packed(np.packbits(total >= least)))])


def frequent(sketches: DataFrame, least: int, bits: int = BITS) -> np.ndarray:
    """2 ** bits bits: whether the counter of all tasks' sketches together is `least` or more. That many bits come to the driver, at most 2 ** MOST_BITS.

    A chunk's parts are of all tasks, but those of a counter are few bytes, and chunks get alike many.
    """
    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, CHUNK // 8)
    parts = sketches.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "data")
    for r in parts.mapInArrow(lambda b: _flags(b, least), "chunk int, data binary").collect():
        out[r.chunk] = _unpacked(bytes(r.data))
    return out.reshape(-1)


def matches(words: list[str], phrases: set[str]) -> dict[str, int]:
    """How often each of the phrases stands in a text of these tokens, overlaps included. Words are guarded by a space on both sides."""
    names, automaton = list(phrases), ahocorasick.Automaton(ahocorasick.STORE_INTS)
    if not names:
        return {}
    for k, p in enumerate(names):
        automaton.add_word(f" {p} ", k)
    automaton.make_automaton()
    n = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(f" {' '.join(words)} ")), np.int64), minlength=len(names))
    return dict(zip(names, n.tolist(), strict=True))


def counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the phrases in a task's documents whose counter is in `bits`: every shard gets an automaton of those it has."""
    sums, known, size = Sums(_COUNTED, PHRASES), {}, (8 * len(bits)).bit_length() - 1
    for lang, words in _shards(batches):
        some, on = set(), None
        for n, at in cells(words, set(words), _salt(lang), known, size).items():
            # A phrase stands as often as it does only if the two shorter ones in it do: their counters are asked first.
            maybe = np.flatnonzero((at >= 0) if on is None else (at >= 0) & on[:-1] & on[1:])
            own = at[maybe]
            maybe = maybe[((bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1).astype(bool)]
            on = np.zeros(len(at), bool)
            on[maybe] = True
            if n in WORDS:
                hit = maybe.tolist()
                some.update(map(" ".join, zip(*([words[i + o] for i in hit] for o in range(n)), strict=True)))
        yield from sums.add(lang, matches(words, some))
    yield from sums.rest()


@contextmanager
def _small_batches(spark: SparkSession):
    """Texts come to the tasks in batches of BATCH rows, so that those of a batch take little memory beside the tables."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, n) of the phrases of WORDS words that stand `least` times or more.

    The sketch bounds a phrase's count from above, so no phrase that does is missed; those that don't are dropped by their exact sums. It grows with
    the corpus up to 2 ** MOST_BITS counters; in a larger one more phrases pass its bound and are counted, and the result is the same.
    """
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("lang", F.lit(UND)).alias("lang"), "text").where("text IS NOT NULL")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    wide = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(size / LOAD, 1)))))
    with _small_batches(spark):
        found = written(texts.mapInArrow(lambda b: learned(b, wide), "lang string, word string, n bigint, chunk int, data binary"), "words")
    words = found.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sketches = found.where("chunk IS NOT NULL").select("chunk", "data")
    bits = spark.sparkContext.broadcast(frequent(sketches, least) if wide == BITS else frequent(sketches, least, wide))
    each = texts.mapInArrow(lambda b: counted(b, bits.value), "lang string, phrase string, n bigint")
    phrases = each.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    with _small_batches(spark):
        phrases = written(phrases, "phrases")
    return written(words, "word-counts"), phrases


def _score(a: Column, x: Column, y: Column) -> Column:
    """floor(1000000 * a * a / (x * y)) in decimals of 38 digits: exact for counts of up to 16 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(x) * wide(y))


def mined(documents: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a (its count), l, r (those of its parts at the cut), n (all words), score.

    A phrase has 2 or 3 words of one piece and stands `least` times or more. Of its cuts the one with the lowest score counts, ties going to the first. A phrase
    goes that stands in a longer one with `inside` percent of its count or more. Order: score and a descending, phrase by its bytes.
    A null lang is `und`; null and empty texts have no words; repeated rows count each; other columns are ignored; no documents: no rows.
    """
    words, phrases = counts(documents, least)
    parts = phrases.unionByName(words.where(F.col("n") >= least).withColumnRenamed("word", "phrase")).select(F.col("lang").alias("g"), F.col("phrase").alias("part"), F.col("n").alias("f"))
    w = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("left"), F.array_join(F.slice(w, k + 1, max(WORDS)), " ").alias("right"))
    cuts = F.array_compact(F.array(*[F.when(F.size(w) > k, cut(k)) for k in range(1, max(WORDS))]))
    each = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        own = parts.select(F.col("g").alias(f"g_{side}"), F.col("part").alias(f"p_{side}"), F.col("f").alias(name))
        each = each.join(own, (F.col("lang") == F.col(f"g_{side}")) & (F.col(side) == F.col(f"p_{side}")))
    best = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    subs = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " ")))
    longer = phrases.select(F.col("lang").alias("g"), "n", F.explode(F.array_distinct(subs)).alias("sub")).groupBy("g", "sub").agg(F.max("n").alias("longer"))
    left = best.join(longer, (F.col("lang") == F.col("g")) & (F.col("phrase") == F.col("sub")), "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True))).select(*best.columns)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = words.groupBy(F.col("lang").alias("g")).agg(F.sum("n").alias("n"))
    return first.join(totals, F.col("lang") == F.col("g")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
