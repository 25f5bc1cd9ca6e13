"""Secret scans: fixed patterns and sliding-window entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import let, running

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Character classes of candidate strings: pattern, least bits a character over a window.
CLASSES = ((r"[0-9A-Fa-f]{20,}", 2.9), (r"[A-Za-z0-9+/_-]{20,}={0,2}", 3.7))
WINDOW = 20
#: A candidate with one of these is no secret: placeholders, counting, one symbol again and again; or no digit or no letter.
ALLOWED = r"(?i)example|sample|placeholder|dummy|changeme|0123456|1234567|abcdefg|(.)\1{5}|^[^0-9]*$|^[^A-Za-z]*$"
#: The parts of ALLOWED that a stage which masks asks of each window; no digit or no letter stays a question to the whole candidate.
PLACEHOLDER, ONE_SORT = "|".join(ALLOWED.split("|")[:-2]), "|".join(ALLOWED.split("|")[-2:])
#: All characters of candidates; the counts of PER_WORD of them are in one integer.
SYMBOLS, PER_WORD = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-=", 12
GAIN = [(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)]


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,hit>> of the leftmost non-overlapping matches, in code points; empty if there are none."""
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("hit"))
    place = lambda x, e: F.struct((e - F.length(x["hit"])).alias("start"), e.alias("end"), x["hit"].alias("hit"))
    ends = lambda own: running(F.transform(own, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
    found = let(F.filter(pairs, lambda x: x["hit"].isNotNull()), lambda own: F.zip_with(own, ends(own), place))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _symbols(hit: Column) -> Column:
    """array<struct<word,bit,one>>: of each character of a candidate, where its count is: five bits of one of a few integers."""
    place = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    bit = lambda k: (k % PER_WORD * 5).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(k))
    return F.transform(place, lambda k: F.struct(F.floor(k / PER_WORD).cast("int").alias("word"), bit(k).alias("bit"), one(k).alias("one")))


def _entropy(hit: Column, least: float, by_window: bool) -> Column:
    """struct<lo,hi>: from the first to the last window of `hit` with that many bits a character; -1 if there is none.

    `by_window` leaves out windows that hold a placeholder or a run.

    The counts of the window's characters are kept. A step changes two of them, that of the character that goes and of the one that comes, and the sum of c*log2(c) by what
    these give, so its work grows neither with the window nor with the candidate.
    """
    gain = F.array(*map(F.lit, GAIN))
    count = lambda n, c: F.call_function("shiftright", F.get(n, c["word"]), c["bit"]).bitwiseAND(F.lit(31)).cast("int")
    changed = lambda n, c, sign: F.transform(n, lambda x, k: F.when(k == c["word"], x + sign * c["one"]).otherwise(x))

    def step(codes: Column, a: Column, i: Column) -> Column:
        gone, new = F.get(codes, i - (WINDOW + 1)), F.get(codes, i - 1)

        def come(n: Column) -> Column:
            less = F.when(i > WINDOW, F.get(gain, count(n, gone))).otherwise(0.0)

            def close(s: Column) -> Column:
                high = (i >= WINDOW) & (math.log2(WINDOW) - s / WINDOW >= least)
                if by_window:
                    high = high & ~F.substring(hit, i - (WINDOW - 1), WINDOW).rlike(PLACEHOLDER)
                return F.struct(changed(n, new, 1).alias("n"), s.alias("s"), F.when(high & (a["lo"] < 0), i - WINDOW).otherwise(a["lo"]).alias("lo"), F.when(high, i).otherwise(a["hi"]).alias("hi"))

            return let(a["s"] + F.get(gain, count(n, new)) - less, close)

        return let(F.when(i > WINDOW, changed(a["n"], gone, -1)).otherwise(a["n"]), come)

    none = F.array_repeat(F.lit(0).cast("bigint"), -(-len(SYMBOLS) // PER_WORD))
    first = F.struct(none.alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    walk = lambda codes: F.aggregate(F.sequence(F.lit(1), F.size(codes)), first, lambda a, i: step(codes, a, i), lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))
    return let(_symbols(hit), walk)


def _dense(least: float, by_window: bool):
    """What finds a candidate's dense part. F.transform takes a second argument, even one with a default, for the index."""
    return lambda x: let(_entropy(x["hit"], least, by_window), lambda w: F.struct((x["start"] + w["lo"]).alias("start"), (x["start"] + w["hi"]).alias("end"), w["lo"].alias("lo")))


def with_spans(df: DataFrame, text: str = "text", by_window: bool = False) -> DataFrame:
    """`df` and array<struct<start,kind,end>> `secret_spans`: kind is the index in KINDS; sorted by start, then kind. A null text has none.

    A placeholder or run acquits its whole candidate, or, with `by_window`, only the windows that hold it.
    """
    allowed = ONE_SORT if by_window else ALLOWED
    t = F.coalesce(F.col(text), F.lit(""))
    span = lambda kind, s, e: F.struct(s.cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end"))
    plain = lambda c, kind: F.transform(c, lambda x: span(kind, x["start"], x["end"]))
    out = df.withColumn("_a", _places(t, ASSIGN)).withColumn("_b", _places(t, ACCESS)).withColumn("_c", _places(t, HEX))
    own = []
    for k, (pattern, least) in enumerate(CLASSES):
        out = out.withColumn(f"_d{k}", F.filter(_places(t, pattern), lambda x: ~x["hit"].rlike(allowed)))
        dense = F.transform(F.col(f"_d{k}"), _dense(least, by_window))
        own.append(F.transform(F.filter(dense, lambda x: x["lo"] >= 0), lambda x: span(3, x["start"], x["end"])))
    kept = F.filter("_a", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    spans = F.array_sort(F.array_distinct(F.concat(plain(kept, 0), plain(F.col("_b"), 1), plain(F.col("_c"), 2), *own)))
    return out.withColumn("secret_spans", spans).drop("_a", "_b", "_c", "_d0", "_d1")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(documents: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, counts of the base kinds, SHA-256 of the base spans, all spans.

    A null or empty text has no spans; repeated rows are each scanned; other columns are ignored.
    """
    found = with_spans(documents.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.filter("secret_spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def masked(documents: DataFrame, mask: str = "<secret>") -> DataFrame:
    """`documents` with each secret of `text` (overlapping spans as one) replaced by `mask`; n_chars, if there, follows."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")  # other columns can't clash
    found = with_spans(packed, by_window=True)

    piece = lambda chars, at, n: F.array_join(F.slice(chars, at + 1, n), "")

    def done(chars: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            gap = lambda: F.concat(a["out"], F.array(piece(chars, a["at"], x["start"] - a["at"]), F.lit(mask)))
            return F.struct(F.when(x["start"] >= a["at"], gap()).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
        return F.aggregate("secret_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), piece(chars, a["at"], F.size(chars) - a["at"])))

    whole = let(let(F.regexp_extract_all(F.col("text"), F.lit("(?s)."), F.lit(0)), done), lambda t: F.struct(t.alias("text"), F.length(t).alias("n")))
    out = found.select("row", F.when(F.size("secret_spans") > 0, whole).otherwise(F.struct(F.col("text"), F.lit(None).cast("int").alias("n"))).alias("new"))
    new = {"text": F.col("new.text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.coalesce(F.col("new.n").cast(documents.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])
