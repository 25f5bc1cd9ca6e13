"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.labels import held_out

#: Bound of the labelled sample: rows a language. Rows of up to SHORT characters are taken first; all are learnt from whole.
ROWS, SHORT = 32, 4_000
#: Characters learnt from in all languages together, which share them alike, and those of a language at least: more than CHARS // LEAST_CHARS languages aren't learnt.
CHARS, LEAST_CHARS = 1_000_000, 4_000
#: Every sample counts as longer by so many characters: pointing into a tiny one would else be so cheap that it wins where nothing matches.
MORE_CHARS = 4_096
#: A text is parsed in blocks of so many characters, side by side; a phrase that is open at the end of one goes on in the next.
BLOCK = 1_024
TOGETHER = 2_000_000  # characters parsed side by side
#: Symbols: the space between words, then every letter of the samples; any other letter, which matches nothing; no character; the sample's text ends.
SPACE, OTHER, PAD, BREAK = 0, 0x30000, 0x30001, 0x30002
#: Columns of a language's table: SPACE and its commonest letters; no character; all else, of which its rarer letters are looked up in a list.
WIDTH = 64
UNKNOWN = "und"


def labelled(documents: DataFrame) -> dict[str, str]:
    """Whole texts by language: of each, ROWS learnable rows at most and as many characters as `most` says: the short ones before the long, those whose ids hash lowest first.

    Rows are told apart by doc_id and a hash of the text. Where even the first text is longer than that, its first characters are learnt from. What
    is collected is bounded by CHARS, in rows, characters and languages.
    """
    can = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    can = can.select("doc_id", "lang", "text", F.xxhash64("text").alias("version"))
    each = can.groupBy("lang", "doc_id", "version").agg(F.max(F.length("text")).alias("size"))
    order = [F.col("size") > SHORT, F.xxhash64("doc_id"), "doc_id", "version"]
    first = each.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("r") <= ROWS)
    names = first.select("lang").distinct().orderBy(F.xxhash64("lang"), "lang").limit(CHARS // LEAST_CHARS).collect()
    most = min(ROWS * SHORT, CHARS // max(1, len(names)))
    before = F.sum("size").over(W.partitionBy("lang").orderBy("r").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    some = first.where(F.col("lang").isin([x.lang for x in names])).withColumn("before", before)
    some = some.where((F.col("before") + F.col("size") <= most) | (F.col("r") == 1)).select(F.col("lang").alias("l"), F.col("doc_id").alias("k"), F.col("version").alias("v"), "r")
    met = can.join(F.broadcast(some), (F.col("doc_id") == F.col("k")) & (F.col("lang") == F.col("l")) & (F.col("version") == F.col("v")))
    rows = met.groupBy("l", "r").agg(F.min(F.substring("text", 1, most)).alias("t")).collect()
    out: dict[str, str] = {}
    for x in sorted(rows, key=lambda x: (x.l, x.r)):
        out[x.l] = f"{out.get(x.l, '')}\0{x.t.lower()}"
    return out


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: next states by symbol, of each state; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


class Table:
    """A language's automaton over its own letters: a dense part for the commonest, a sorted list of transitions for the others."""

    def __init__(self, symbols: np.ndarray, letters: int):
        common = [c for c, _ in sorted(Counter(symbols[(symbols != SPACE) & (symbols < OTHER)].tolist()).items(), key=lambda x: (-x[1], x[0]))]
        pad, rest = WIDTH - 2, WIDTH - 1
        #: Column by symbol, those from OTHER on following the letters; from WIDTH on it is a rarer letter.
        self.column = np.full(letters + 3, rest, np.int32)
        self.column[[SPACE, letters + PAD - OTHER]] = 0, pad
        self.column[common] = [k + 1 if k + 1 < pad else WIDTH + k + 1 - pad for k in range(len(common))]
        steps = automaton(symbols.tolist())
        self.rare = max(0, len(common) + 1 - pad)
        dense, sparse = np.full((len(steps), WIDTH), -1, np.int32), {}
        self.start = np.zeros(WIDTH + self.rare, np.int32)
        column = self.column.tolist()
        for s, to in enumerate(steps):
            for c, t in to.items():
                if c < OTHER:
                    k = column[c]
                    if k < WIDTH:
                        dense[s, k] = t
                    else:
                        sparse[s * self.rare + k - WIDTH] = t
                    if s == 0:
                        self.start[k] = t
        dense[:, pad] = np.arange(len(steps))
        self.flat = dense.ravel()
        self.keys = np.array(sorted(sparse), np.int64)
        self.to = np.array([sparse[k] for k in self.keys.tolist()], np.int32)

    def _step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more symbol each, and where no longer match goes on: there a new phrase begins."""
        row = self.column[row]
        to = self.flat[state * np.int32(WIDTH) + (np.minimum(row, np.int32(WIDTH - 1)) if self.rare else row)]
        if self.rare:
            seldom = np.flatnonzero(row >= WIDTH)
            key = state[seldom].astype(np.int64) * self.rare + (row[seldom] - WIDTH)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[seldom] = np.where(self.keys[at] == key, self.to[at], -1)
        failed = to < 0
        return np.where(failed, self.start[row], to), failed

    def breaks(self, grid: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """How often a new phrase begins in each column of a grid of symbols. A column that follows the one before goes on with its open phrase.

        All columns are parsed side by side as if each began a text. Then those that follow are parsed again from the state in which the one before ends,
        only until both parses are in one state: from there they are the same. Where the end of a column changes thereby, the next one is parsed again.
        """
        state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int32)
        states, counts = np.empty(grid.shape, np.int32), np.empty(grid.shape, np.uint16)
        for r, row in enumerate(grid):
            state, failed = self._step(state, row)
            count += failed
            states[r], counts[r] = state, count
        own, end, todo = count.copy(), state.copy(), np.flatnonzero(follows)
        while len(todo):
            on, now, more = np.arange(len(todo)), end[todo - 1], np.zeros(len(todo), np.int32)
            last, total = state[todo], own[todo].copy()
            for r in range(len(grid)):
                now, failed = self._step(now, grid[r, todo[on]])
                more += failed
                met = now == states[r, todo[on]]
                if met.any():
                    total[on[met]] = more[met] + own[todo[on[met]]] - counts[r, todo[on[met]]]
                    on, now, more = on[~met], now[~met], more[~met]
                    if not len(on):
                        break
            total[on], last[on] = more, now
            count[todo] = total
            moved = todo[last != end[todo]]
            end[todo] = last
            todo = moved[moved + 1 < len(follows)] + 1
            todo = todo[follows[todo]]
        return count


def _entropy(symbols: np.ndarray) -> float:
    share = np.unique(symbols, return_counts=True)[1] / max(1, len(symbols))
    return float(-(share * np.log2(share)).sum())


class Model:
    """Automata of the sample's languages; built once in a worker, from the sample's text."""

    built: dict[int, Model] = {}

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        letters = sorted({c for c in "".join(texts.values()) if c.isalpha()})
        self.codes = np.full(0x110000, OTHER, np.int32)
        self.codes[[c for c in (*range(0x3040), *range(0xFF00, 0xFFF0)) if not chr(c).isalpha()]] = SPACE  # what parts words
        self.codes[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        self.codes[0] = BREAK
        coded = [self.code(texts[n]) for n in self.names]
        self.tables = [Table(c, self.letters) for c in coded]
        #: Bits a symbol by the frequencies of the sample's symbols alone.
        self.letter_bits = np.array([_entropy(c[c < OTHER]) for c in coded])
        self.bits = [float(np.log2(MORE_CHARS + len(texts[n]))) for n in self.names]
        self.codes[0] = SPACE

    @classmethod
    def of(cls, texts: dict[str, str]) -> Model:
        key = hash(tuple(sorted(texts.items())))
        if key not in cls.built:
            cls.built = {key: cls(texts)}
        return cls.built[key]

    def code(self, text: str) -> np.ndarray:
        """Symbols of a text: letters, and one for whatever stands between words."""
        c = self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        again = c == SPACE
        again[1:] &= again[:-1].copy()
        again[:1] = False
        return c[~again]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol by text and language (phrases of the parse, times what it takes to point at one); symbols by text."""
        small = np.uint16 if self.letters + 3 <= 0x10000 else np.int32
        coded = [np.where(c < OTHER, c, c - OTHER + self.letters).astype(small) for c in (self.code(t.lower()) for t in texts)]
        blocks = np.array([-(-len(c) // BLOCK) for c in coded], np.int64)
        grid = np.full(int(blocks.sum()) * BLOCK, self.letters + PAD - OTHER, small)
        for c, at in zip(coded, (np.cumsum(blocks) - blocks) * BLOCK, strict=True):
            grid[at : at + len(c)] = c
        grid = np.ascontiguousarray(grid.reshape(-1, BLOCK).T)
        owner = np.repeat(np.arange(len(texts)), blocks)
        follows = np.concatenate([[False], owner[1:] == owner[:-1]])[: len(owner)]
        out = np.zeros((len(texts), len(self.names)))
        for k, table in enumerate(self.tables):
            out[:, k] = ((blocks > 0) + np.bincount(owner, table.breaks(grid, follows), len(texts))) * self.bits[k]
        size = np.array([len(c) for c in coded])
        return out / np.maximum(1, size)[:, None], size


def has_letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def judged(model: Model | None, texts: list[str | None]) -> dict[str, np.ndarray]:
    """lang_pred, score, bits, symbols and letter_bits of some texts."""
    out = {"lang_pred": np.full(len(texts), UNKNOWN, object), "score": np.zeros(len(texts)), "bits": np.zeros(len(texts)), "symbols": np.zeros(len(texts), np.int32), "letter_bits": np.zeros(len(texts))}
    known = [i for i, t in enumerate(texts) if model and has_letters(t)]
    size, part = 0, []
    for i in known:
        part.append(i)
        size += len(texts[i])
        if size < TOGETHER and i != known[-1]:
            continue
        e, out["symbols"][part] = model.entropies([texts[k] for k in part])
        share = (e.min(axis=1, keepdims=True) / e) ** 4
        best = e.argmin(axis=1)
        out["lang_pred"][part] = np.array(model.names, object)[best]
        out["score"][part], out["bits"][part], out["letter_bits"][part] = 1 / share.sum(axis=1), e.min(axis=1), model.letter_bits[best]
        size, part = 0, []
    return out


def _predict(texts: dict[str, str]):
    def run(batches):
        model = Model.of(texts) if texts else None
        for b in batches:
            got = judged(model, list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], **{c: got[c] for c in ("lang_pred", "score", "bits", "symbols")}})

    return run


def _fitting(texts: dict[str, str], most: float, over: float, least: int):
    def run(batches):
        model = Model.of(texts) if texts else None
        for b in batches:
            got = judged(model, b.column("text").to_pylist())
            strange = (got["bits"] > np.maximum(most, got["letter_bits"] + over)) & (got["symbols"] >= least)
            yield b.filter(pa.array((got["lang_pred"] != UNKNOWN) & ~strange))

    return run


def fitting(documents: DataFrame, most: float, over: float, least: int) -> DataFrame:
    """`documents` without texts that no learned language fits: null or without letters, or of `least` symbols or more that take over
    `most` bits each, and over `over` more than that language's letters alone. Each row is judged by its own text, whatever its doc_id."""
    return documents.mapInArrow(_fitting(labelled(documents), most, over, least), documents.schema)


def identify(documents: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, lang_pred, score (0 to 1), bits (a symbol), symbols.

    Of the languages of `train` (`documents` itself if None) the one needing fewest phrases, normalised by sample size, wins;
    ties go to the first name. `und`, score 0: null text, no letters, or nothing to learn from. Whole texts are parsed;
    repeated rows each get a row; other columns are ignored.
    """
    texts = labelled(train if train is not None else documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return rows.mapInPandas(_predict(texts), f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double, symbols int")
