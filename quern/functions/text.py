"""Column functions on text: cleaning, token estimates, sentences, statistics, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends, for a character class.
ENDS = "。．.！？!?"
# Fixed value: candidate terms are runs of katakana, of kanji, or Latin words.
TERM = r"[ァ-ヴー]{2,}|[一-龥]{2,}|[A-Za-z]{2,}[A-Za-z0-9]*"
BLANKS = " \t\n\r"


def strip(c: Column) -> Column:
    """Without blanks, tabs and line ends on either side."""
    return F.btrim(c, F.lit(BLANKS))


def clean(c: Column) -> Column:
    """Null as empty; white space runs become one blank; no blanks on either side."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def half_width(c: Column) -> Column:
    """Full-width forms as ASCII, the ideographic space as a blank, doubled Japanese stops as one."""
    full = "".join(chr(0xFEE0 + k) for k in range(0x21, 0x7F)) + "　"
    narrow = F.translate(c, full, "".join(chr(k) for k in range(0x21, 0x7F)) + " ")
    return F.regexp_replace(F.regexp_replace(narrow, "。+", "。"), "、+", "、")


def estimated_tokens(c: Column) -> Column:
    """Half a token for each non-ASCII character and a quarter for each other, cut to an integer; at least 1, or 0 if empty."""
    other = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    n = (other * 0.5 + (F.length(c) - other) * 0.25).cast("int")
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.lit(0)).otherwise(F.greatest(n, F.lit(1)))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of so many tokens, at prices per thousand."""
    return tokens_in / 1000 * price_in + tokens_out / 1000 * price_out


def truncated(c: Column, tokens: int) -> Column:
    """At most two characters for each token, marked where cut."""
    return F.when(F.length(c) > 2 * tokens, F.concat(F.substring(c, 1, 2 * tokens), F.lit("..."))).otherwise(c)


def paragraphs(c: Column) -> Column:
    """array<string>: what blank lines part, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """array<string>: runs up to an end mark with what blanks follow, stripped; then the rest; a text without marks is one.

    The text is cut after its last mark first: matching the unmarked rest over and over would be quadratic.
    """
    head = F.regexp_extract(c, f"(?s)^.*[{ENDS}]", 0)
    found = F.regexp_extract_all(head, F.lit(rf"[^{ENDS}]+[{ENDS}]\s*"), F.lit(0))

    def stripped(parts: Column) -> Column:
        rest = F.call_function("substring_index", c, F.element_at(parts, -1), F.lit(-1))
        both = F.when(F.size(parts) == 0, F.array(strip(c))).otherwise(F.concat(F.transform(parts, strip), F.array(strip(rest))))
        return F.filter(both, lambda x: x != "")

    return F.element_at(F.transform(F.array(found), stripped), 1)  # the pattern runs once


def marked_sentences(c: Column) -> Column:
    """array<string>: what the marks 。！？!? end, each with its mark, stripped, blanks dropped; an ASCII full stop ends nothing."""
    return F.filter(F.transform(F.split(c, "(?<=[。！？!?])", -1), strip), lambda x: x != "")


def plain_words(c: Column) -> Column:
    """array<string>: what white space parts."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def terms(c: Column) -> Column:
    """array<string>: candidate terms in order, repeats included."""
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(0))


# What counts as a technical term, by language.
TECHNICAL = {
    "ja": r"[ァ-ヴー]{4,}|[一-龥]{4,}",
    "en": r"[A-Z][a-z]+(?:[A-Z][a-z]+)+|(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{10,}",
}


def complexity(c: Column, lang: str = "en") -> Column:
    """high / medium / low by technical terms per hundred tokens and by tokens a sentence; sentences are what the language's full stop parts."""
    tokens = estimated_tokens(c)
    density = F.regexp_count(c, F.lit(TECHNICAL[lang])) * 100.0 / F.greatest(tokens, F.lit(1))
    mean = tokens / F.size(F.split(c, "。" if lang == "ja" else r"\.", -1))
    return F.when((density > 5) | (mean > 30), "high").when((density > 2) | (mean > 20), "medium").otherwise("low")


# Signs of Japanese in the first hundred characters of a text; over three of them make it Japanese.
JAPANESE_SIGNS = ("。", "は", "が", "を", "に", "で", "と", "の")


def scored_complexity(c: Column) -> Column:
    """struct<lang, score, level, statistics>: 3, 2 or 1 for technical terms per hundred tokens, 2, 1 or 0 for tokens a sentence of over
    five characters, 1 for three or more numbers; high from 5, medium from 3. The language is told by signs; a null text is empty."""
    text = F.coalesce(c, F.lit(""))
    japanese = sum((F.contains(F.substring(text, 1, 100), F.lit(x)).cast("int") for x in JAPANESE_SIGNS), F.lit(0)) > 3
    tokens = estimated_tokens(text)
    found = F.when(japanese, F.regexp_count(text, F.lit(TECHNICAL["ja"]))).otherwise(F.regexp_count(text, F.lit(TECHNICAL["en"])))
    parts = F.when(japanese, F.split(text, "。", -1)).otherwise(F.split(text, r"\.", -1))
    mean = tokens / F.greatest(F.size(F.filter(parts, lambda s: F.length(strip(s)) > 5)), F.lit(1))
    dense = found * 100.0 / F.greatest(tokens, F.lit(1))
    numbers = F.regexp_count(text, F.lit(r"[0-9]+\.?[0-9]*%?")) > 2
    score = F.when(dense > 5, 3).when(dense > 2, 2).otherwise(1) + F.when(mean > 30, 2).when(mean > 20, 1).otherwise(0) + numbers.cast("int")
    level = F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")
    return F.struct(F.when(japanese, "ja").otherwise("en").alias("lang"), score.alias("score"), level.alias("level"), numbers.alias("statistics"))


def looked_up(name: Column, values: dict, default) -> Column:
    """What `values` gives for a name, such as a model's limits or prices by name (numbers or dicts of numbers, as structs); else the default."""
    lit = lambda v: F.struct(*[F.lit(x).alias(k) for k, x in v.items()]) if isinstance(v, dict) else F.lit(v)
    if not values:
        return lit(default)
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), lit(v))])
    return F.coalesce(F.try_element_at(table, name), lit(default))


def length_level(c: Column) -> Column:
    """struct<level, sentences, mean, tokens>: high / medium / low by all tokens and by tokens a sentence; an empty or null text is low."""
    text = F.coalesce(c, F.lit(""))
    n, tokens = F.size(marked_sentences(text)), estimated_tokens(text)
    mean = F.when(n > 0, tokens / n).otherwise(0.0)
    level = F.when((mean > 50) | (tokens > 500), "high").when((mean > 25) | (tokens > 200), "medium").otherwise("low")
    return F.struct(level.alias("level"), n.alias("sentences"), F.round(mean, 2).alias("mean"), tokens.alias("tokens"))


def key_concepts(c: Column, n: int = 5) -> Column:
    """array<string>: the first n different runs of two or more kanji and kana."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[一-龯々ぁ-んァ-ン]{2,}"), F.lit(0))), 1, n)


def required_terms(query: Column) -> Column:
    """array<string>: a query's words of kanji and katakana only, and its runs of two or more of them."""
    own = "[\u4e00-\u9fff\u30a0-\u30ff]"
    whole = F.filter(plain_words(query), lambda w: w.rlike(f"^{own}+$"))
    return F.array_distinct(F.concat(whole, F.regexp_extract_all(query, F.lit(own + "{2,}"), F.lit(0))))


def batch_count(c: Column, chunks: Column, thorough: bool = True) -> Column:
    """Questions to ask of a whole text: 8, 6 or 4 by different technical terms in 1,000 characters, half as many again if thorough, half a one a chunk; 15 at most."""
    terms_ = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit("[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}"), F.lit(0))))
    dense = F.when(F.length(c) > 0, terms_ / (F.length(c) / 1000)).otherwise(0.0)
    base = F.when(dense > 10, 8).when(dense > 5, 6).otherwise(4)
    return F.least(F.floor((F.floor(base * 1.5) if thorough else base) + chunks * 0.5), F.lit(15)).cast("int")


def combined(*columns: Column) -> Column:
    """Cleaned columns joined by blanks, empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(clean(c), F.lit("")) for c in columns])


def embedding_input(question: Column, answer: Column | None = None) -> Column:
    """What is embedded of a question, with its answer on the next line if there is one."""
    return F.concat_ws("\n", question, answer) if answer is not None else question


def qa_count(tokens: Column, index: Column, base: int = 3) -> Column:
    """Questions to ask of a chunk: more for longer ones, one more from the sixth chunk on, eight at most."""
    by_size = F.when(tokens < 50, 2).when(tokens < 100, 3).when(tokens < 200, base + 1).when(tokens < 300, base + 2).otherwise(base + 3)
    return F.least(by_size + F.when(index >= 5, 1).otherwise(0), F.lit(8))


def action(score: Column) -> Column:
    """What to do at a confidence."""
    return F.when(score >= 0.9, "silent").when(score >= 0.7, "notify").when(score >= 0.4, "confirm").otherwise("escalate")


def search_quality(top: Column, mean: Column, variance: Column) -> Column:
    """The best score if at least 0.6, else blended with the mean, less for spread."""
    return F.when(top >= 0.6, top).otherwise(F.greatest(F.lit(0.0), top * 0.7 + mean * 0.3 - F.least(F.lit(0.15), variance * 0.3)))
