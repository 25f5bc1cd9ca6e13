"""Compound nouns by a lattice of dictionary words: the cheapest path through a text, and runs of neighbouring nouns on it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.entities import automaton

#: A character that no word of the path covers: its part of speech and cost.
UNKNOWN, UNKNOWN_COST = "unknown", 10.0
WORDS = 1_000_000  # of a dictionary, which is sent to every task
STRETCH, KEPT = 64, 300_000  # characters of a stretch whose compounds a worker keeps, and how many it keeps
Word = tuple[str, str, float]


def cheapest(text: str, ending: dict[int, list[Word]], connections: dict[tuple[str, str], float], before: str = "", after: str = "") -> list[tuple[str, str]]:
    """(surface, part of speech) along the path with the least sum of costs of words and of neighbouring parts of speech; ties to fewer words, then to the parts of speech by name.

    ending: the words that end at each place. A place keeps one path for each part of speech that ends there. before, after: the parts of speech that stand around `text`, if any.
    """
    best: list[dict[str, tuple]] = [{before: (0.0, 0, "", "")}]  # by place: the path to each part of speech that ends there: its cost, words, the part of speech before, the last word
    ways: list[dict[str, tuple]] = [{} for _ in range(len(text) + 1)]  # by place: the best path that goes on to a part of speech
    for end, char in enumerate(text, 1):
        here: dict[str, tuple] = {}
        for surface, pos, cost in [*ending.get(end, ()), (char, UNKNOWN, UNKNOWN_COST)]:
            start = end - len(surface)
            way = ways[start].get(pos)
            if way is None:
                way = ways[start][pos] = min([(x[0] + connections.get((p, pos), 0.0), x[1] + 1, p) for p, x in best[start].items()])
            new = (way[0] + cost, way[1], way[2], surface)
            if pos not in here or new < here[pos]:
                here[pos] = new
        best.append(here)
    out, end = [], len(text)
    pos = min(best[end], key=lambda p: (best[end][p][0] + (connections.get((p, after), 0.0) if after else 0.0), best[end][p][1], p))
    while end:
        _, _, earlier, surface = best[end][pos]
        out.append((surface, pos))
        end, pos = end - len(surface), earlier
    return out[::-1]


def joined(path: list[tuple[str, str]], nouns: frozenset[str]) -> list[tuple[str, int]]:
    """(compound, first character) of each run of neighbouring nouns."""
    out, now, at = [], "", 0
    for surface, pos in [*path, ("", "")]:
        if pos in nouns:
            now += surface
        elif now:
            out.append((now, at - len(now)))
            now = ""
        at += len(surface)
    return out


class Lexicon:
    """A dictionary's words as an automaton, and the compounds of the stretches met so far, which a worker keeps from task to task."""

    def __init__(self, words: list[Word], nouns: frozenset[str], connections: dict[tuple[str, str], float]):
        self.words, self.nouns, self.connections, self.walk = words, nouns, connections, None

    def ready(self) -> Lexicon:
        """Itself, with what is built on the worker."""
        if self.walk is None:
            self.by_surface: dict[str, list[Word]] = {}
            for w in self.words:
                self.by_surface.setdefault(w[0], []).append(w)
            self.names = list(self.by_surface)
            self.walk = automaton(self.names).iter if self.names else lambda _: ()
            # Where unknown characters are nouns, compounds reach over them: the whole text is one stretch.
            chars = "".join(map(re.escape, sorted(set("".join(self.names)))))
            self.stretches = re.compile("(?s:.+)" if UNKNOWN in self.nouns else f"[{chars}]+" if chars else "(?!)").finditer
            self.known = lru_cache(KEPT)(self.within)
        return self

    def within(self, stretch: str, before: str, after: str) -> list[tuple[str, int]]:
        """(compound, first character) in a stretch between these parts of speech."""
        ending: dict[int, list[Word]] = {}
        for end, k in self.walk(stretch):
            ending.setdefault(end + 1, []).extend(self.by_surface[self.names[k]])
        return joined(cheapest(stretch, ending, self.connections, before, after), self.nouns) if ending else []


def compounds(df: DataFrame, dictionary: DataFrame, key: str, text: str, nouns: tuple[str, ...] = ("noun",), connections: dict[tuple[str, str], float] | None = None, most: int | None = None) -> DataFrame:
    """(key, term, n, at): the compound nouns of each text, how often and where first; of each row the `most` most frequent, ties by first place, if given.

    dictionary: surface, pos, cost; of words that are alike in surface and pos the cheapest counts; null or empty surfaces don't. It is sent to all tasks and may have WORDS words. A character
    that no word of the dictionary has is unknown on every path, so the stretches between such characters are walked apart: once to find their words, then once along the lattice, work in
    proportion to their length and the words that end at a place. Short stretches that come again are looked up.
    Null and empty texts have none; `connections` are costs of neighbouring parts of speech, 0 where not given.
    """
    rows = dictionary.where((F.col("surface") != "") & F.col("pos").isNotNull()).groupBy("surface", "pos").agg(F.min("cost").cast("double").alias("cost")).orderBy("surface", "pos").limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"a dictionary may have {WORDS} words")
    held = df.sparkSession.sparkContext.broadcast(Lexicon([(r.surface, r.pos, r.cost) for r in rows], frozenset(nouns), dict(connections or {})))
    of = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value.ready()
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                counts, first = Counter(), {}
                for m in lexicon.stretches(t):
                    start, end = m.span()
                    for c, p in (lexicon.known if end - start <= STRETCH else lexicon.within)(m[0], UNKNOWN if start else "", UNKNOWN if end < len(t) else ""):
                        counts[c] += 1
                        first.setdefault(c, start + p)
                own = counts.items() if most is None else sorted(counts.items(), key=lambda x: -x[1])[:most]
                out += [(c, n, first[c]) for c, n in own]
                at += [i] * len(own)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), *columns], ["_key", "term", "n", "at"])

    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return texts.mapInArrow(run, f"_key {of}, term string, n bigint, at bigint").withColumnRenamed("_key", key)


def ranked(found: DataFrame, key: str, n: int) -> DataFrame:
    """(key, rank, term, n): each text's n most frequent compounds, ties by first place: what `keywords.integrated` takes as `more`."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "at"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "term", "n")
