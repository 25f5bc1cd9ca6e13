"""Removal of byte strings that occur earlier in the corpus, by hash-compared sorting of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.rows import versions
from quern.sources.tables import written

LENGTH = 100  # bytes of a string
GRAM = 32  # bytes of an anchor; each string has one, the gram in it with the least hash, so equal strings have equal anchors
SUB = 1_500_000  # bytes taken together in a task
INDEX_BITS = 27
#: Segments in a group of the suffix sort; anchors in more segments than HOT are compared string by string, by combinable minima.
GROUP, HOT = 4_000, 4_000
SALTS = 16  # tasks that share a string's places
VERIFY = 100_000  # strings whose bytes are compared at once
_RNG = np.random.default_rng(20_240_229)
TABLES = _RNG.integers(1, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in BASES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Polynomial hashes of all prefixes, modulo 2**64, from which any substring's hash follows."""

    def __init__(self, data: np.ndarray, kind: int):
        n = len(data)
        power = np.full(n + 1, BASES[kind])
        power[0] = 1
        self.inverse = np.full(n + 1, INVERSES[kind])
        self.inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLES[kind][data] * power[:n], out=self.sums[1:])

    def of(self, start, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])


def _anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first string, strings, anchor hash, segment hash) of each run of strings with one anchor."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    p = Prefixes(data, 0)
    h = p.of(np.arange(len(data) - GRAM + 1), GRAM)
    low = np.uint64((1 << INDEX_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    anchor = (least & low).astype(np.int64)
    begin = np.cumsum(size) - size
    count = np.maximum(size - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[text] + place
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(text)])
    n = np.diff(np.append(new, len(text)))
    whole = Prefixes(data, 1).of(at[new], n + (LENGTH - 1))
    return text[new], place[new], n, h[anchor[new]].view(np.int64), whole.view(np.int64)


def _parts(batch: pd.DataFrame):
    """Pieces of a batch, by doc_id, of about SUB bytes: (doc_id, version, first byte) of each part of a text, and the parts.

    A text over SUB bytes is cut into parts that share LENGTH - 1 bytes, so that every string is in one of them.
    """
    b = batch[batch["doc_id"].notna() & batch["text"].notna()].sort_values("doc_id", kind="stable")
    names, parts, size = [], [], 0
    for doc, version, text in zip(b["doc_id"].to_numpy(np.int64).tolist(), b["version"].to_numpy(np.int64).tolist(), b["text"], strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        for lo in range(0, max(1, len(raw) - LENGTH + 1), SUB):
            names.append((doc, version, lo))
            parts.append(raw[lo : lo + SUB + LENGTH - 1])
            size += len(parts[-1])
            if size >= SUB:
                yield names, parts
                names, parts, size = [], [], 0
    if parts:
        yield names, parts


def _segments(batches):
    """A row for each segment; without hashes if the piece has the same bytes at an earlier place, of which all bytes are compared."""
    for b in batches:
        for names, parts in _parts(b):
            text, at, n, anchor, whole = _anchored(parts)
            doc, version, base = (np.array(x, np.int64)[text] for x in zip(*names, strict=True))
            lo = base + at
            order = np.lexsort((lo, doc, whole, anchor))
            new = np.concatenate([[True], (np.diff(anchor[order]) != 0) | (np.diff(whole[order]) != 0)])[: len(order)]
            first = np.empty(len(order), np.int64)
            first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            repeat = (doc != doc[first]) | (lo != lo[first])
            for k in np.flatnonzero(repeat).tolist():
                f, size = first[k], n[k] + LENGTH - 1
                repeat[k] = parts[text[k]][at[k] : at[k] + size] == parts[text[f]][at[f] : at[f] + size]
            hashes = {"anchor": pd.array(anchor, "Int64"), "whole": pd.array(whole, "Int64")}
            for x in hashes.values():
                x[repeat] = pd.NA
            yield pd.DataFrame({**hashes, "doc_id": doc, "version": version, "lo": lo, "n": n.astype(np.int32), "is_repeat": repeat})


SEGMENT = "anchor bigint, whole bigint, doc_id bigint, version bigint, lo bigint, n int, is_repeat boolean"
SLICE = "anchor bigint, doc_id bigint, version bigint, lo bigint, data binary, w1 bigint, w2 bigint"


def _slices(batches):
    """The bytes of a text's segments; of hot ones, instead, two hashes of each string."""
    for b in batches:
        rows = []
        for doc, version, text, own in zip(b["doc_id"], b["version"], b["text"], b["own"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for x in own:
                lo, n = int(x["lo"]), int(x["n"])
                data = raw[lo : lo + n + LENGTH - 1]
                if not x["hot"]:
                    rows.append((x["anchor"], doc, version, lo, data, 0, 0))
                    continue
                w = [Prefixes(np.frombuffer(data, np.uint8), k).of(np.arange(n), LENGTH).view(np.int64).tolist() for k in (0, 1)]
                rows += [(0, doc, version, lo + p, None, u, v) for p, (u, v) in enumerate(zip(*w, strict=True))]
        yield pd.DataFrame(rows, columns=["anchor", "doc_id", "version", "lo", "data", "w1", "w2"])


def common(p: Prefixes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to `most`: binary search on hashes of their prefixes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = p.of(a, mid) == p.of(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def compared(p: Prefixes, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the string of LENGTH bytes at a is less than, equal to or greater than that at b: by the byte after their common extension, which
    takes the logarithm of LENGTH in steps. What the hashes call equal is settled by the bytes themselves, so 0 is always true."""
    out = np.zeros(len(a), np.int8)
    for k in range(0, len(a), VERIFY):
        x, y = a[k : k + VERIFY], b[k : k + VERIFY]
        e = np.minimum(common(p, x, y, LENGTH), LENGTH - 1)
        u, v = raw[x + e].astype(np.int16), raw[y + e].astype(np.int16)
        out[k : k + VERIFY] = np.sign(u - v)
        doubt = np.flatnonzero(u == v)
        windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
        differ = windows[x[doubt]] != windows[y[doubt]]
        at = differ.argmax(axis=1)
        some = differ.any(axis=1)
        out[k + doubt[some]] = np.sign(raw[x[doubt[some]] + at[some]].astype(np.int16) - raw[y[doubt[some]] + at[some]])
    return out


def merge_sorted(p: Prefixes, raw: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the strings at `at`, by group (which rises), then by their bytes; equal strings keep theirs.

    A merge sort from runs of one string: all pairs of runs of all groups are merged at once, each string finding its place in the other run by binary
    search, so a string is compared as often as the square of the logarithm of its group's size.
    """
    order = np.arange(len(at))
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
    size = np.diff(np.append(head, len(group)))
    begin, count = np.repeat(head, size), np.repeat(size, size)
    place, width = np.arange(len(at)) - begin, 1
    while width < count.max(initial=0):
        own = np.flatnonzero(count > width)  # groups that are one run are done
        run = place[own] // width
        other = begin[own] + (run ^ 1) * width  # where the other run of the pair begins
        end = np.minimum(other + width, begin[own] + count[own])
        right = run % 2 == 1
        lo, hi = other.copy(), np.maximum(end, other)
        mine = at[order[own]]
        while len(on := np.flatnonzero(lo < hi)):
            mid = (lo[on] + hi[on]) // 2
            c = compared(p, raw, at[order[mid]], mine[on])
            before = (c < 0) | ((c == 0) & right[on])  # of equal ones those of the left run come first
            lo[on], hi[on] = np.where(before, mid + 1, lo[on]), np.where(before, hi[on], mid)
        new = begin[own] + (run // 2) * 2 * width + place[own] % width + (lo - other)
        merged = order.copy()
        merged[new] = order[own]
        order, width = merged, 2 * width
    return order


def _copies(pdf: pd.DataFrame) -> np.ndarray:
    """Which of the segments, sorted by place, have all bytes of one at an earlier place: each of their strings is there too, so they needn't be sorted."""
    first: dict[bytes, tuple[int, int]] = {}
    places = zip(pdf["doc_id"].tolist(), pdf["lo"].tolist(), strict=True)
    return np.fromiter((first.setdefault(bytes(d), at) != at for d, at in zip(pdf["data"], places, strict=True)), bool, len(pdf))


def _sorted_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of strings in the group's segments that occur earlier.

    Equal strings have their anchor, the gram with the least hash, at one place; so strings are apart by anchor and its place in
    them. The suffixes at the strings' starts are merge-sorted within these (see `merge_sorted`), earlier ones first among equals; then what equals its
    neighbour, by their common extension and by bytes, is held against the first of its kind.
    """
    pdf = pdf.sort_values(["doc_id", "lo"], kind="stable")
    copied = _copies(pdf)
    whole = pdf[copied]
    pdf = pdf[~copied]
    data = [bytes(x) for x in pdf["data"]]
    size = np.fromiter(map(len, data), np.int64, len(data))
    n = size - LENGTH + 1
    raw = np.frombuffer(b"".join(data), np.uint8)
    p = Prefixes(raw, 0)
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(data)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + inner
    doc, version, lo = (pdf[c].to_numpy(np.int64)[row] for c in ("doc_id", "version", "lo"))
    lo = lo + inner
    grams = p.of(np.arange(max(len(raw) - GRAM + 1, 0)), GRAM) >> np.uint64(INDEX_BITS)
    anchor = np.concatenate([np.zeros(0, np.int64), *[grams[base[k : k + 10_000, None] + np.arange(LENGTH - GRAM + 1)].argmin(axis=1) for k in range(0, len(base), 10_000)]])
    gram = grams[base + anchor][row] if len(base) else np.zeros(0, np.uint64)
    earlier = np.lexsort((lo, doc, anchor[row] - inner, gram))
    kind = np.stack([gram.view(np.int64), anchor[row] - inner])[:, earlier]
    group = np.cumsum(np.concatenate([[False], (kind[:, 1:] != kind[:, :-1]).any(axis=0)])[: len(earlier)])
    sort = merge_sorted(p, raw, at[earlier], group)
    order = earlier[sort]
    same = np.concatenate([[False], (group[1:] == group[:-1]) & (compared(p, raw, at[order[:-1]], at[order[1:]]) == 0)])[: len(order)]
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = same & ((doc[order] != doc[first]) | (lo[order] != lo[first]))
    hit = order[later]
    hit = hit[np.lexsort((lo[hit], version[hit], doc[hit]))]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(lo[hit]) != 1) | (doc[hit[1:]] != doc[hit[:-1]]) | (version[hit[1:]] != version[hit[:-1]])])[: len(hit)])
    out = pd.DataFrame({"doc_id": doc[hit[cut]], "version": version[hit[cut]], "lo": lo[hit[cut]], "n": np.diff(np.append(cut, len(hit))).astype(np.int32)})
    n = np.fromiter(map(len, whole["data"]), np.int32, len(whole)) - np.int32(LENGTH - 1)
    return pd.concat([out, pd.DataFrame({"doc_id": whole["doc_id"].to_numpy(np.int64), "version": whole["version"].to_numpy(np.int64), "lo": whole["lo"].to_numpy(np.int64), "n": n})])


def repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, version, lo, n): runs of n strings of LENGTH bytes, from byte lo on, each of which also starts earlier in the corpus.

    `version` is a hash of the text: rows that share a doc_id may have different ones. Earlier is a smaller (doc_id, lo), so equal rows
    are one place and don't take each other away.
    1. Each string's anchor is content-defined; neighbours with one anchor are a segment. Segments that repeat an earlier one of the same
    piece of a task are runs already; the rest meet by anchor. 2. An anchor with one kind of segment: all but the first are runs.
    3. With several kinds, the segments' bytes are fetched and their suffixes sorted within groups of bounded size; anchors of very many
    segments go string by string through a combinable minimum.
    """
    docs = versions(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), "version", "text")
    segments = written(docs.mapInPandas(_segments, SEGMENT), "all-segments")  # pieces differ between evaluations: there is one
    run = ["doc_id", "version", "lo", "n"]
    here = segments.where("is_repeat").select(*run)
    by = W.partitionBy("anchor")
    place = F.struct("doc_id", "lo")
    firsts = segments.where("NOT is_repeat").drop("is_repeat")
    met = firsts.select("*", F.count("*").over(by).alias("c"), (F.min("whole").over(by) != F.max("whole").over(by)).alias("mixed"), F.min(place).over(by).alias("first")).where("c > 1")
    met = written(met.select("anchor", *run, "mixed", (F.col("c") > HOT).alias("hot"), (place == F.col("first")).alias("is_first")), "segments")
    plain = met.where("NOT mixed AND NOT is_first").select(*run)
    mixed = met.where("mixed")
    own = mixed.groupBy("doc_id", "version").agg(F.collect_set(F.struct("anchor", "lo", "n", "hot")).alias("own"))
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    slices = written(texts.join(own, ["doc_id", "version"]).select("doc_id", "version", "text", "own").mapInPandas(_slices, SLICE), "slices")
    groups = max(1, mixed.count() // GROUP)
    found = slices.where("data IS NOT NULL").groupBy(F.pmod(F.hash("anchor"), F.lit(groups)).alias("g")).applyInPandas(_sorted_group, "doc_id bigint, version bigint, lo bigint, n int")
    # A string may be in very many texts: both sides of the join are dealt to SALTS tasks by text.
    strings = slices.where("data IS NULL").select("w1", "w2", "doc_id", "version", "lo", F.pmod(F.xxhash64("doc_id", "lo"), F.lit(SALTS)).alias("salt"))
    least = strings.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    least = least.select("w1", "w2", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    hot = strings.join(least, ["w1", "w2", "salt"]).where(place != F.col("first")).select("doc_id", "version", "lo", F.lit(1).alias("n"))
    return here.unionAll(plain).unionAll(found).unionAll(hot)


def _cut(batches):
    for b in batches:
        rows = []
        for doc, text, runs in zip(b["doc_id"], b["text"], b["runs"], strict=True):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            step = np.zeros(len(raw) + 1, np.int64)
            if runs is not None:
                lo = np.array([x["lo"] for x in runs], np.int64)
                hi = lo + np.array([x["n"] for x in runs], np.int64) + LENGTH - 1
                np.add.at(step, lo, 1)
                np.add.at(step, np.minimum(hi, len(raw)), -1)
            gone = np.cumsum(step)[: len(raw)] > 0
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            rows.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(documents: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of LENGTH bytes that also starts earlier (smaller doc_id, or same document) goes; strings are judged
    on the input. Null texts are empty; texts under LENGTH bytes keep all. doc_id names a document: rows with a null one keep all; equal rows
    are one place and get the same result, whatever task they are in; of rows that share a doc_id but not the text, what starts at a
    smaller byte in any is the earlier. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    runs = repeated(documents).groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "n")).alias("runs")).withColumnsRenamed({"doc_id": "k", "version": "v"})
    rows = versions(documents).join(runs, (F.col("doc_id") == F.col("k")) & (F.col("version") == F.col("v")), "left").select("doc_id", "text", "runs")
    return rows.mapInPandas(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
