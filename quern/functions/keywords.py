"""Column functions on keywords, the sentences around them, and questions about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import estimated_tokens, strip

# Patterns, weights and words that scores and classes must agree on.
TECHNICAL = r"[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}"
TECHNICAL_LONG = r"[ァ-ヴー]{3,}|[A-Z]{2,}[A-Z0-9]*|[一-龥]{4,}"
STOPS = r"[。！？.!?]+"
WEIGHTS = {"coverage": 0.25, "diversity": 0.15, "technicality": 0.25, "coherence": 0.20, "length_balance": 0.15}
MODES = {"summary": 5, "standard": 10, "detailed": 15, "exhaustive": 20, "tag": 3}
NAMES = ["BERT", "GPT", "CNN", "RNN", "LSTM"]
CORE = "技術|手法|方式|理論|モデル"
GENERAL = "データ|システム|処理|分析"
EXPLANATORY = ["とは", "である", "という", "により", "ため"]
QUESTION_WORDS = ["何", "なぜ", "どのように", "いつ", "どこ", "だれ", "どちら"]
HINTS = {"比較": 0.15, "違い": 0.15, "複数": 0.2, "最新": 0.1, "理由": 0.1, "方法": 0.1, "詳しく": 0.15, "ステップ": 0.1, "手順": 0.1, "なぜ": 0.1, "どのように": 0.15}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _moments(sizes: Column) -> Column:
    """struct<n,s,q> of integers: how many, their sum, and the sum of their squares."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(sizes, F.struct(zero.alias("n"), zero.alias("s"), zero.alias("q")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x.cast("bigint") * x).alias("q")))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def technicality(term: Column) -> Column:
    """1.2 for an acronym, 1 for katakana, 0.9 for kanji, 0.8 for another Latin word, else 0."""
    return F.when(term.rlike("^[A-Z]{2,}[A-Z0-9]*$"), 1.2).when(term.rlike("^[ァ-ヴー]{3,}$"), 1.0).when(term.rlike("^[一-龥]{4,}$"), 0.9).when(term.rlike("^[A-Za-z]+[A-Za-z0-9]*$"), 0.8).otherwise(0.0)


def score(term: Column, n: Column, important: list[str]) -> Column:
    """0 to 1: places in the text (n) to 3 weigh 0.3, length to 8 weighs 0.2, importance 0.4, script 0.15 or 0.2."""
    script = F.when(term.rlike("^[ァ-ヴー]{3,}$"), 0.15).when(term.rlike("^[A-Z]{2,}$"), 0.2).when(term.rlike("^[一-龥]{4,}$"), 0.15).otherwise(0.0)
    often = F.least(n / 3, F.lit(1.0)) * 0.3
    return F.least(F.lit(1.0), often + F.least(F.length(term) / 8, F.lit(1.0)) * 0.2 + F.when(term.isin(important), 0.4).otherwise(0.0) + script)


def metrics(terms: Column, text: Column) -> dict[str, Column]:
    """Five qualities of a document's few keywords, each by name; all 0 for an empty list.

    coherence is the share of pairs with two neighbouring characters in common; diversity is best at a deviation of three characters.
    """
    n = F.size(terms)
    spread = let(_moments(F.transform(terms, F.length)), lambda m: F.sqrt((m["n"] * m["q"] - m["s"] * m["s"]) / (m["n"] * (m["n"] - 1))))
    pairs = F.transform(terms, lambda t: F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    shared = let(pairs, lambda all_: _total(F.transform(all_, lambda p, i: F.size(F.filter(all_, lambda q, j: (j > i) & F.arrays_overlap(p, q))).cast("double"))))
    found = {
        "coverage": F.size(F.filter(terms, lambda t: text.contains(t))) / n,
        "diversity": F.when(n < 2, 0.5).otherwise(F.least(F.lit(1.0), F.when(spread < 3, spread / 3).otherwise((6 - spread) / 3))),
        "technicality": F.least(F.lit(1.0), _total(F.transform(terms, technicality)) / n),
        "coherence": F.when(n < 2, 0.0).otherwise(shared / (n * (n - 1) / 2)),
        "length_balance": F.size(F.filter(terms, lambda t: F.length(t).between(2, 8))) / n,
    }
    return {k: F.when(n > 0, c).otherwise(0.0) for k, c in found.items()}


def total(of: dict[str, Column]) -> Column:
    """The weighted sum of metrics, 1 at most."""
    return F.least(F.lit(1.0), sum((of[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)))


def auto_count(text: Column) -> Column:
    """How many keywords a text deserves: more for longer ones, and for technical or many sentences."""
    n = F.length(text)
    dense = F.regexp_count(text, F.lit(TECHNICAL)) / (n / 100) > 2
    many = F.size(F.split(text, STOPS, -1)) > 10
    long = F.least(20 + F.floor(F.log2(n / 2000)), F.lit(30))
    return F.when(n < 100, 3).when(n < 300, 5).when(n < 500, F.when(dense, 9).otherwise(7)).when(n < 1000, F.when(many, 12).otherwise(10)).when(n < 2000, 15).otherwise(long).cast("int")


def count_by_mode(text: Column, mode: str = "auto", fewest: int = 3, most: int = 20) -> Column:
    """How many keywords a mode asks for, within the bounds; an unknown mode asks for ten."""
    n = auto_count(text) if mode == "auto" else F.lit(MODES.get(mode, 10))
    return F.greatest(F.lit(fewest), F.least(F.lit(most), n))


def difficulty(term: Column, text: Column) -> Column:
    """basic / intermediate / advanced, by how often the text has the term and whether it explains it."""
    told = text.contains(F.concat(term, F.lit("とは"))) | (text.contains(F.concat(term, F.lit("は"))) & text.contains("である")) | text.contains(F.concat(term, F.lit("（")))

    def level(x: Column) -> Column:
        n, known = x["n"], x["told"]
        return F.when(known & (n >= 3), "basic").when(term.rlike("^[A-Z]{2,}[A-Z0-9]*$") & ~known, "advanced").when((F.length(term) >= 8) | (n == 1), "advanced").when(n >= 5, "basic").otherwise("intermediate")

    return let(F.struct(occurrences(text, term).alias("n"), told.alias("told")), level)


def category(term: Column) -> Column:
    """specific_name, technical_term, core_concept, general_term or other."""
    return F.when(term.isin(NAMES), "specific_name").when(term.rlike("^[A-Z]{2,}[A-Z0-9]*$|^[ァ-ヴー]{4,}$"), "technical_term").when(term.rlike(CORE), "core_concept").when(term.rlike(GENERAL), "general_term").otherwise("other")


def usable(term: Column, stop: list[str]) -> Column:
    """Whether a question can be asked about a term: not a stop word, a number, an ordinal, or a word cut from a phrase."""
    return ~term.isin(stop) & (F.length(term) >= 2) & ~term.rlike(r"^\d+$") & ~term.startswith("第") & ~term.endswith("等") & ~term.endswith("的")


def telling(sentence: Column) -> dict[str, Column]:
    """What a sentence's `importance` has whatever the term: technical terms (five are 1), explanatory phrases (all are 1), and a length of about 50 characters."""
    told = sum((sentence.contains(p).cast("int") for p in EXPLANATORY), F.lit(0)) / len(EXPLANATORY)
    return {"near": F.least(F.regexp_count(sentence, F.lit(TECHNICAL)) / 5, F.lit(1.0)), "told": told, "fit": F.greatest(F.lit(0.0), 1 - F.abs(F.length(sentence) - 50) / 50)}


def importance(sentence: Column, term: Column, own: dict[str, Column] | None = None) -> Column:
    """0 to 1: 0.2 for an early place, 0.3 for technical terms (five), 0.3 for explanatory phrases (all), 0.2 for about 50 characters; `own` is its `telling`, if known."""
    own = own or telling(sentence)
    at = F.position(term, sentence)
    place = F.when(at > 0, 1 - (at - 1) / F.length(sentence)).otherwise(0.0)
    return F.least(F.lit(1.0), place * 0.2 + own["near"] * 0.3 + own["told"] * 0.3 + own["fit"] * 0.2)


def sentence_parts(text: Column) -> Column:
    """array<string>: what stops part, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text, STOPS, -1), strip), lambda x: x != "")


def text_difficulty(text: Column) -> Column:
    """0 to 1: 0.3 for uneven sentences, 0.4 for technical terms (five in a hundred characters), 0.3 for brackets and inner stops."""
    n = F.greatest(F.length(text) / 100, F.lit(1.0))
    dense = F.least(F.lit(1.0), F.regexp_count(text, F.lit(TECHNICAL_LONG)) / n / 5)
    marks = F.regexp_count(text, F.lit(r"[、；：「」『』（）\[\]]"))

    def score(m: Column) -> Column:
        uneven = F.when(m["n"] > 1, F.least(F.lit(1.0), F.sqrt((m["n"] * m["q"] - m["s"] * m["s"]).cast("double")) / m["s"])).otherwise(0.0)
        return F.least(F.lit(1.0), uneven * 0.3 + dense * 0.4 + F.least(F.lit(1.0), marks / F.greatest(m["n"], F.lit(1))) * 0.3)

    return let(_moments(F.transform(sentence_parts(text), F.length)), score)


def question_difficulty(question: Column, hints: dict[str, float] = HINTS) -> Column:
    """0.3, more for each hint the question has and for length over 100 and over 200; 1 at most."""
    told = sum((F.when(question.contains(k), w).otherwise(0.0) for k, w in hints.items()), F.lit(0.3))
    return F.least(F.lit(1.0), told + F.when(F.length(question) > 100, 0.1).otherwise(0.0) + F.when(F.length(question) > 200, 0.1).otherwise(0.0))


def pair_quality(question: Column, answer: Column, level: Column, n_terms: Column, kind: Column, words: list[str] = QUESTION_WORDS) -> Column:
    """0 to 1 for a question with its answer: a question word, the answer's length, a known level, terms, and a category."""
    n = F.length(answer)
    asks = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: question.contains(w)), 0.2).otherwise(0.0)
    fits = F.when(n.between(20, 200), 0.2).when(n.between(10, 300), 0.1).otherwise(0.0)
    known = F.when(level.isin("basic", "intermediate", "advanced"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), asks + fits + known + F.least(F.lit(0.2), n_terms * 0.1) + F.when(F.coalesce(kind, F.lit("")) != "", 0.1).otherwise(0.0))


def contains_any(content: Column, asked: str) -> Column:
    """Whether content has any of the question's words of two or more characters; true if there are none."""
    words = [w for w in asked.split() if len(w) >= 2]
    return F.exists(F.array(*map(F.lit, words)), lambda w: content.contains(w)) if words else F.lit(True)


def question_budget(text: Column) -> Column:
    """How many questions a document deserves: by its length, more where dense and difficult, averaged with what its tokens need; 3 to 50. Difficulty counts to six places."""
    n = F.length(text)
    base = F.when(n < 500, 3).when(n < 1000, 5).when(n < 2000, 8).when(n < 5000, 12).when(n < 10000, 18).otherwise(F.least(F.lit(30), 18 + F.floor(F.log2(n / 10000) * 3)))
    dense = F.regexp_count(text, F.lit(TECHNICAL_LONG)) / F.greatest(F.lit(1.0), n / 100)

    def count(hard: Column) -> Column:
        more = F.when((dense > 4) & (hard > 0.7), 1.5).when((dense > 2.5) | (hard > 0.5), 1.2).when((dense < 1) & (hard < 0.3), 0.7).otherwise(1.0)
        needed = F.floor(F.floor(estimated_tokens(text) / 150) * 0.7 / 2.5)
        own = F.greatest(F.lit(3), F.floor(base * more))
        return F.greatest(F.lit(3), F.least(F.lit(50), F.floor((own + needed) / 2))).cast("int")

    return let(F.round(text_difficulty(text), 6), count)


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer, from its first brace to its last; null if there is none."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def final_answer(answer: Column) -> Column:
    """What follows `Final Answer:`, else `Answer:`; without a leading `Thought:`."""
    after = F.when(answer.contains("Final Answer:"), F.element_at(F.split(answer, "Final Answer:", 2), 2)).when(answer.contains("Answer:"), F.element_at(F.split(answer, "Answer:", 2), 2)).otherwise(answer)
    return strip(F.regexp_replace(after, r"^\s*Thought:", ""))
