"""Chunks of documents under a token budget."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = re.compile(r"[^。．.！？!?]+[。．.！？!?]\s*")
SCHEMA = "doc_id bigint, chunk_idx int, type string, tokens int, text string"


def tokens_of(text: str) -> int:
    plain = len(text) if text.isascii() else len(text.encode("ascii", "ignore"))
    return max(1, (2 * len(text) - plain) // 4) if text else 0


def split_sentences(text: str) -> list[str]:
    last = max((text.rfind(c) for c in "。．.！？!?"), default=-1) + 1
    parts = END.findall(text[:last])
    rest = text[text.rfind(parts[-1]) + len(parts[-1]) :] if parts else text
    return [s for s in (p.strip() for p in [*parts, rest]) if s]


def cut_by_tokens(text: str, most: int) -> list[str]:
    """Parts of a text that each reach the token budget, by the same estimate, and the rest."""
    out, begin, weight = [], 0, 0
    for i, c in enumerate(text):
        weight += 2 if ord(c) > 127 else 1  # quarters of a token
        if weight // 4 > most:
            out.append(text[begin:i])
            begin, weight = i, 2 if ord(c) > 127 else 1
    return [*out, text[begin:]] if begin < len(text) else out


def pack(text: str, most: int, least: int) -> list[tuple[str, str, int]]:
    """(type, text, tokens): paragraphs within the budget whole, others by sentences; then chunks under `least` join the one before, with a blank."""
    out: list[tuple[str, str]] = []
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not para:
            continue
        if tokens_of(para) <= most:
            out.append(("paragraph", para))
            continue
        group: list[str] = []
        size = 0
        for s in split_sentences(para):
            n = tokens_of(s)
            if group and size + n > most:
                out.append(("sentence_group", "".join(group)))
                group, size = [], 0
            if n > most:
                out += [("forced_split", x) for x in cut_by_tokens(s, most)]
            else:
                group.append(s)
                size += n
        if group:
            out.append(("sentence_group", "".join(group)))
    merged: list[tuple[str, str]] = []
    for kind, part in out:
        both = f"{merged[-1][1]} {part}" if merged and tokens_of(part) < least else None
        if both and tokens_of(both) < 300:
            merged[-1] = (kind if merged[-1][0] == kind else "merged", both)
        else:
            merged.append((kind, part))
    return [(kind, part, tokens_of(part)) for kind, part in merged]


def pack_sentences(text: str, most: int) -> list[tuple[str, int, int, int]]:
    """(text, tokens, first, last): runs of sentences under the budget, joined with a blank, and the numbers of their sentences."""
    out: list[tuple[list[str], int]] = []
    size = 0
    for i, s in enumerate(split_sentences(text)):
        n = tokens_of(s)
        if out and size + n <= most:
            out[-1][0].append(s)
            size += n
        else:
            out.append(([s], i))
            size = n
    return [(" ".join(own), tokens_of(" ".join(own)), i, i + len(own) - 1) for own, i in out]


def joined_small(chunks: list[tuple[int, str]], small: int, most: int) -> list[tuple[int, int, str, list[int]]]:
    """(first, tokens, text, chunks) of (number, text) in order: those under `small` tokens joined by blank lines up to `most`."""
    out: list[tuple[int, int, str, list[int]]] = []
    open_ = False
    for i, text in chunks:
        n = tokens_of(text)
        if open_ and n < small and out[-1][1] + n <= most:
            text = f"{out[-1][2]}\n\n{text}"
            out[-1] = (out[-1][0], tokens_of(text), text, [*out[-1][3], i])
        else:
            out.append((i, n, text, [i]))
            open_ = n < small
        open_ = open_ and n < small
    return out


def joined_forward(chunks: list[tuple[int, str, int]], small: int, most: int) -> list[tuple[int, int, str, int]]:
    """(first, tokens, text, last) of (number, text, tokens) in order: each under `small` tokens takes in those after it up to `most`."""
    out: list[tuple[int, int, str, int]] = []
    for i, text, n in chunks:
        if out and out[-1][1] < small and out[-1][1] + n <= most:
            out[-1] = (out[-1][0], out[-1][1] + n, f"{out[-1][2]} {text}", i)
        else:
            out.append((i, n, text, i))
    return out


def _in_row(documents: DataFrame, of_text, schema: str) -> DataFrame:
    """A row for each of `of_text(text)`, whole texts one by one; a document's chunks never leave its task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(d, *c) for d, t in zip(b["doc_id"], b["text"], strict=True) for c in of_text(t or "")], columns=names)

    return documents.select("doc_id", "text").mapInPandas(run, schema)


def chunked(documents: DataFrame, most: int = 200, least: int = 50) -> DataFrame:
    """One row per chunk of each whole text; null and blank texts give none."""
    return _in_row(documents, lambda t: [(i, k, n, x) for i, (k, x, n) in enumerate(pack(t, most, least))], SCHEMA)


def chunked_by_sentences(documents: DataFrame, most: int = 200) -> DataFrame:
    """One row per run of sentences under the budget, with the numbers of its first and last sentence; null and blank texts give none."""
    of_text = lambda t: [(i, n, x, a, b) for i, (x, n, a, b) in enumerate(pack_sentences(t, most))]
    return _in_row(documents, of_text, "doc_id bigint, chunk_idx int, tokens int, text string, first_sentence int, last_sentence int")


def with_ids(chunks: DataFrame, kind: str, title: str | None = None) -> DataFrame:
    """`chunks` and chunk_id: the kind of document, its id, 30 characters of its title if it has one, and the chunk's number."""
    name = [F.coalesce(F.substring(F.col(title), 1, 30), F.lit(""))] if title else []
    return chunks.withColumn("chunk_id", F.concat_ws("_", F.lit(kind), F.col("doc_id"), *name, F.lit("chunk"), F.col("chunk_idx")))


SMALL = "chunk_idx_first int, tokens int, text string, original_chunks array<int>"
FORWARD = "chunk_idx int, tokens int, text string, last_idx int"


def sampled(chunks: DataFrame, most: int) -> DataFrame:
    """At most so many of each document's chunks, evenly spaced from the first; all of a document that has no more."""
    own = Window.partitionBy("doc_id")
    place, n = F.row_number().over(own.orderBy("chunk_idx")) - 1, F.count("*").over(own)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return chunks.withColumns({"_i": place, "_n": n}).where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < most)).drop("_i", "_n")


def merged_small(chunks: DataFrame, small: int = 150, most: int = 400) -> DataFrame:
    """Neighbouring chunks of a document under `small` tokens joined up to `most`; a larger chunk stands alone. Joined texts are counted anew."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        out = joined_small(list(zip(pdf["chunk_idx"].tolist(), pdf["text"], strict=True)), small, most)
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *o) for o in out], columns=["doc_id", "chunk_idx_first", "tokens", "text", "original_chunks"])

    return chunks.groupBy("doc_id").applyInPandas(fold, f"doc_id bigint, {SMALL}")


def chunked_small(documents: DataFrame, small: int = 150, most: int = 400) -> DataFrame:
    """merged_small of `documents`' chunks, in the pass that cuts them: nothing is shuffled."""
    return _in_row(documents, lambda t: joined_small([(i, x) for i, (_, x, _) in enumerate(pack(t, 200, 50))], small, most), f"doc_id bigint, {SMALL}")


def merged_forward(chunks: DataFrame, small: int = 50, most: int = 600) -> DataFrame:
    """Each chunk under `small` tokens takes in those after it, in its document, as long as both fit in `most`."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        out = joined_forward(list(zip(pdf["chunk_idx"].tolist(), pdf["text"], pdf["tokens"].tolist(), strict=True)), small, most)
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *o) for o in out], columns=["doc_id", "chunk_idx", "tokens", "text", "last_idx"])

    return chunks.groupBy("doc_id").applyInPandas(fold, f"doc_id bigint, {FORWARD}")


def chunked_forward(documents: DataFrame, small: int = 50, most: int = 600) -> DataFrame:
    """merged_forward of `documents`' chunks, in the pass that cuts them: nothing is shuffled."""
    return _in_row(documents, lambda t: joined_forward([(i, x, n) for i, (_, x, n) in enumerate(pack(t, 200, 50))], small, most), f"doc_id bigint, {FORWARD}")


def token_windows(df: DataFrame, key: str, text: str, size: int = 300, overlap: int = 50) -> DataFrame:
    """(key, chunk_idx, first, words, position): windows of words, the last one ending with the text."""
    words = df.select(key, F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    each = words.select(key, "w", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    i = F.col("chunk_idx")
    return each.select(
        key, "chunk_idx", (i * step).alias("first"), F.size(F.slice("w", i * step + 1, size)).alias("words"),
        F.when(F.col("last") == 0, "full").when(i == 0, "start").when(i == F.col("last"), "end").otherwise("middle").alias("position"),
    )
