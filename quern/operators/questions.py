"""Questions and answers by rule, and questions asked twice."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.functions.keywords import importance
from quern.functions.text import plain_words, sentences, strip, terms
from quern.operators import keywords

# What a definition, a naming and an enumeration look like, and the sentences made of them.
DEFINED = r"([^。]+)とは([^。]+)(?:である|です)"
NAMED = r"([^。]+)は([^。]+)と呼ばれ"
LISTED = r"([^。]+)(?:には|に|では)、([^。]+(?:、[^。]+)+)が(?:ある|あります|含まれ|存在)"

# Questions by difficulty and category ("" is any other category), and how long an answer should be.
TEMPLATES = [
    ("basic", "", ["{}とは何ですか？", "{}について説明してください。"]),
    ("intermediate", "core_concept", ["{}の仕組みを説明してください。", "{}の特徴は何ですか？"]),
    ("intermediate", "", ["{}はどのように使われますか？", "{}の利点は何ですか？"]),
    ("advanced", "technical_term", ["{}の技術的な詳細を説明してください。", "{}と他の手法との違いは何ですか？"]),
    ("advanced", "", ["{}の応用例を挙げてください。", "{}の課題と解決策は何ですか？"]),
]
LENGTHS = {"basic": "1-2文", "intermediate": "2-3文", "advanced": "3-5文"}


def _matches(text: str, pattern: str):
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    return F.transform(both, lambda m: F.struct(strip(m["a"]).alias("a"), strip(m["b"]).alias("b")))


def by_rule(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, question, answer, type, confidence) of each definition, naming and enumeration; null texts give none."""

    def pair(question, answer, kind: str, sure: float):
        return F.struct(question.alias("question"), answer.alias("answer"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))

    defined = F.transform(_matches(text, DEFINED), lambda m: pair(F.concat(m["a"], F.lit("とは何ですか？")), F.concat(m["a"], F.lit("とは"), m["b"], F.lit("です。")), "definition", 0.9))
    named = F.transform(_matches(text, NAMED), lambda m: pair(F.concat(m["a"], F.lit("は何と呼ばれますか？")), F.concat(m["b"], F.lit("と呼ばれます。")), "terminology", 0.85))
    items = lambda c: F.array_join(F.transform(F.split(c, "、"), strip), "、")
    listed = F.transform(_matches(text, LISTED), lambda m: pair(F.concat(m["a"], F.lit("には何がありますか？")), F.concat(m["a"], F.lit("には、"), items(m["b"]), F.lit("があります。")), "enumeration", 0.8))
    return df.select(key, F.inline(F.concat(defined, named, listed)))


def best_sentences(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, sentence, importance): for each term of `found` (key, term) the sentence that tells most about it; ties go to the first.

    A text's terms meet its sentences within its row, where all that doesn't follow from the term is told once; texts that share a key are compared afterwards.
    """
    lists = found.groupBy(F.col(key).alias("_k")).agg(F.collect_set("term").alias("_l"))

    def told(s: Column, i: Column) -> Column:
        return F.struct(s.alias("s"), i.alias("i"), *[c.alias(k) for k, c in K.telling(s).items()])

    def of(all_: Column) -> Column:
        value = lambda x, t: F.struct(F.round(importance(x["s"], t, {k: x[k] for k in ("near", "told", "fit")}), 6).alias("v"), (-x["i"]).alias("i"), x["s"].alias("s"))
        best = lambda t: F.array_max(F.transform(F.filter(all_, lambda x: F.contains(x["s"], t)), lambda x: value(x, t)))
        return F.filter(F.transform("_l", lambda t: F.struct(t.alias("term"), best(t).alias("b"))), lambda x: x["b"].isNotNull())

    def each(rows: DataFrame) -> DataFrame:
        both = rows.select(key, F.col(text).alias("_text")).join(lists, F.col(key) == F.col("_k"))
        return both.select(key, F.inline(K.let(F.transform(sentences(F.col("_text")), told), of)))

    alone, shared = keywords.apart(df, key)
    out = each(alone)
    if shared is not None:
        out = out.unionByName(each(shared).groupBy(key, "term").agg(F.max("b").alias("b")))
    return out.select(key, "term", F.col("b.s").alias("sentence"), F.col("b.v").alias("importance"))


def asked_twice(df: DataFrame, key: str, text: str, least: float = 0.7) -> DataFrame:
    """(a, b, similarity): different questions whose words have a Jaccard similarity over `least`; a and b are their smallest keys.

    Equal questions are one: `groupBy(text)` has their membership. Sets that alike share one of their rarest words, so only those are
    joined (as many as leave too few words if all were missing), then lengths and the exact similarity decide.
    """
    texts = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(F.min(key).alias("id"))
    words = texts.select("id", F.array_distinct(plain_words(F.col("_t"))).alias("w")).where(F.size("w") > 0)
    each = words.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    rare = each.join(each.groupBy("word").agg(F.count("*").alias("df")).select(F.col("word").alias("_w"), "df"), F.col("word") == F.col("_w"))
    heads = rare.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("o"))
    head = heads.select("id", "n", F.explode(F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("h")).select("id", "n", "h.word")
    left, right = head.select(F.col("id").alias("a"), F.col("n").alias("na"), "word"), head.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("word").alias("_w"))
    near = (F.col("word") == F.col("_w")) & (F.col("a") < F.col("b")) & (F.least("na", "nb") > F.greatest("na", "nb") * least)
    pairs = left.join(right, near).select("a", "b").distinct()
    of = lambda i, w: words.select(F.col("id").alias(f"_{i}"), F.col("w").alias(w))
    both = pairs.join(of("a", "wa"), F.col("a") == F.col("_a")).join(of("b", "wb"), F.col("b") == F.col("_b"))
    s = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return both.select("a", "b", s.alias("_s")).where(F.col("_s") > least).select("a", "b", F.round("_s", 6).alias("similarity"))


def by_template(levels: DataFrame, key: str) -> DataFrame:
    """(key, term, question, answer_length): two questions for each of `levels` (key, term, difficulty, category)."""
    same = lambda level, kind: (F.col("difficulty") == level) & ((F.col("category") == kind) if kind else F.lit(True))
    asked = F.coalesce(*[F.when(same(level, kind), F.array(*[F.replace(F.lit(q), F.lit("{}"), F.col("term")) for q in qs])) for level, kind, qs in sorted(TEMPLATES, key=lambda t: t[1] == "")])
    length = F.coalesce(*[F.when(F.col("difficulty") == k, v) for k, v in LENGTHS.items()], F.lit("2-3文"))
    return levels.select(key, "term", F.explode(asked).alias("question"), length.alias("answer_length"))


def negated(pairs: DataFrame) -> DataFrame:
    """(question, answer) turned into its opposite, to test a system that answers."""
    return pairs.withColumns({"question": F.replace("question", F.lit("何ですか"), F.lit("何ではありませんか")), "answer": F.concat("answer", F.lit("ではないものを指します。"))})


# Questions that a text can't answer, their answers and kinds.
UNANSWERABLE = [
    ("この文書に書かれていない情報は何ですか？", "文書には含まれていない情報です。", "out_of_context"),
    ("それは何を指していますか？", "文脈により異なります。", "ambiguous_reference"),
]


def adversarial(pairs: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """(key, question, answer, type): of each key's pairs (key, order, question, answer) the first `most` turned into their opposites, and two that no text can answer."""
    first = F.row_number().over(W.partitionBy(key).orderBy(order))
    own = negated(pairs.withColumn("_r", first).where(F.col("_r") <= most)).select(key, "question", "answer", F.lit("adversarial_negation").alias("type"))
    fixed = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer"), F.lit(t).alias("type")) for q, a, t in UNANSWERABLE])
    return own.unionByName(pairs.select(key).distinct().select(key, F.inline(fixed)))


# Signs of English and of Japanese text, a capitalised phrase, and the questions asked of a chunk.
ENGLISH = ("the ", "The ", " is ", " are ", " was ", " were ", " have ", " has ", "and ", "for ")
JAPANESE = ("。", "は", "が", "を", "に", "で", "と", "の")
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
ASKED_EN = {
    "whole": "What information is discussed in this section?",
    "fact": "What specific information is provided about {}?",
    "context": "What information is provided in the following context: {}?",
    "relation": "How does {} relate to {}?",
    "before": "How does the information '{}...' connect to the previous context?",
    "about": "What is mentioned about {}?",
    "theme": "What is the main theme related to {}?",
    "themes": "What is the main theme discussed in this content?",
}
ASKED_JA = {
    "whole": "このセクションにはどのような情報が含まれていますか？",
    "fact": "「{}」について詳しく説明してください。",
    "about": "「{}」について何が述べられていますか？",
    "theme": "「{}」に関する主要テーマは何ですか？",
    "themes": "この内容の主要テーマは何ですか？",
}


def english(text: Column) -> Column:
    """Whether the head of a text has more signs of English than of Japanese."""
    head = F.substring(text, 1, 200)
    count = lambda signs: sum((F.contains(head, F.lit(x)).cast("int") for x in signs[1:]), F.contains(head, F.lit(signs[0])).cast("int"))
    return count(ENGLISH) > count(JAPANESE)


def by_chunk(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, i, question, answer, type): up to `n` questions on each chunk: on the whole, on each sentence (what it says, what it has
    to do with the one before, what it names), and on the theme. Chunks without a sentence of over 20 characters give none."""
    t = F.col(text)
    parts = F.filter(F.transform(F.when(english(t), F.split(t, r"\. ")).otherwise(F.split(t, "。")), strip), lambda s: F.length(s) > 20)
    rows = df.select(key, t.alias("_x"), english(t).alias("_en"), parts.alias("_s")).where(F.size("_s") > 0)
    row = lambda q, a, kind: F.struct(q.alias("question"), a.alias("answer"), F.lit(kind).alias("type"))
    ask = lambda q, *by: F.concat(*[x for k, p in enumerate(q.split("{}")) for x in ([F.lit(p)] if k == 0 else [by[k - 1], F.lit(p)])])
    phrase = lambda c: F.nullif(F.regexp_extract(c, PHRASE, 0), F.lit(""))
    none = F.array().cast("array<struct<question:string,answer:string,type:string>>")
    some = lambda cond, *r: F.when(cond, F.array(*r)).otherwise(none)

    def in_english(s: Column, i: Column) -> Column:
        after, before = F.get("_s", i + 1), F.get("_s", i - 1)
        head, last = phrase(F.substring(s, 1, 30)), phrase(F.substring(before, 1, 30))
        fact = F.coalesce(ask(ASKED_EN["fact"], phrase(F.substring(s, 1, 50))), ask(ASKED_EN["context"], F.substring(s, 1, 50)))
        link = F.coalesce(ask(ASKED_EN["relation"], head, last), ask(ASKED_EN["before"], F.substring(s, 1, 30)))
        return F.concat(
            F.array(row(fact, F.concat_ws(" ", s, after), "factual_detailed")),
            some(i > 0, row(link, F.concat_ws(" ", before, s), "contextual")),
            some(phrase(s).isNotNull(), row(ask(ASKED_EN["about"], phrase(s)), s, "keyword_based")),
        )

    def in_japanese(s: Column, i: Column) -> Column:
        named = F.transform(F.slice(F.array_distinct(F.filter(terms(s), lambda w: F.length(w) > 1)), 1, 2), lambda w: row(ask(ASKED_JA["about"], w), s, "keyword_based"))
        return F.concat(F.array(row(ask(ASKED_JA["fact"], F.substring(s, 1, 30)), F.concat_ws("。", s, F.get("_s", i + 1)), "factual_detailed")), named)

    own = F.slice("_s", 1, n - 1)
    each = F.flatten(F.when(F.col("_en"), F.transform(own, in_english)).otherwise(F.transform(own, in_japanese)))
    x = F.col("_x")
    whole = some(F.length(x) > 50, row(F.when(F.col("_en"), ASKED_EN["whole"]).otherwise(ASKED_JA["whole"]), F.substring(x, 1, 500), "comprehensive"))
    named = F.when(F.col("_en"), ask(ASKED_EN["theme"], phrase(F.substring(F.get("_s", F.lit(0)), 1, 50)))).otherwise(ask(ASKED_JA["theme"], F.get(terms(F.substring(x, 1, 200)), F.lit(0))))
    theme = some(F.length(x) > 100, row(F.coalesce(named, F.when(F.col("_en"), ASKED_EN["themes"]).otherwise(ASKED_JA["themes"])), F.substring(x, 1, 400), "thematic"))
    return rows.select(key, F.posexplode(F.slice(F.concat(whole, each, theme), 1, n)).alias("i", "_q")).select(key, "i", "_q.*")


def dealt(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(batch, pos, chunk): a batch's pairs dealt out in order to its chunks, to each as many as were expected; what is over is left out.

    pairs: batch, pos (from 0); chunks: batch, chunk, expected. A batch is a model's one answer, so small; batches are many.
    """
    before = F.coalesce(F.sum("expected").over(W.partitionBy("batch").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = chunks.withColumn("_from", before).where("expected > 0").select(F.col("batch").alias("_b"), "chunk", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("expected") - 1)).alias("_pos"))
    return pairs.join(slots, (F.col("batch") == F.col("_b")) & (F.col("pos") == F.col("_pos"))).select("batch", "pos", "chunk")


def for_uncovered(chunks: DataFrame, uncovered: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, question, answer): a question on each of the `n` least covered chunks (key, gap), its text being the answer."""
    worst = uncovered.orderBy(F.desc("gap"), key).limit(n).select(F.col(key).alias("_k"), "gap")
    both = chunks.join(F.broadcast(worst), F.col(key) == F.col("_k"))  # n rows at most
    about = F.coalesce(F.get(terms(F.col(text)), F.lit(0)), F.lit(""))
    return both.select(key, F.when(about != "", F.concat(about, F.lit("について説明してください。"))).otherwise("この内容を説明してください。").alias("question"), F.col(text).alias("answer"))


# Questions on a document, a paragraph and a name, and what names look like, in English and in Japanese.
LAYERS_EN = ("What is the main content of this document?", "Explain the following: '{}...'", "What is mentioned about {}?", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b|[A-Z]{2,}")
LAYERS_JA = ("この文書の主要な内容を要約してください", "「{}...」について説明してください", "「{}」について何が述べられていますか？", r"[ァ-ヴー]{3,}|[一-龥]{4,}")


def layered(df: DataFrame, key: str, text: str, japanese: bool = False) -> DataFrame:
    """(key, layer, question, answer): on the document (its first 500 characters), on up to four paragraphs of over 50 characters (without
    blank lines: slices of 500 every 400), and on the first six names, answered by the first sentence with them. Null texts give none."""
    whole, part, about, names = LAYERS_JA if japanese else LAYERS_EN
    t = F.col(text)
    row = lambda layer, q, a: F.struct(F.lit(layer).alias("layer"), q.alias("question"), a.alias("answer"))
    ask = lambda q, x: F.concat(F.lit(q.split("{}")[0]), x, F.lit(q.split("{}")[1]))
    slices = F.transform(F.filter(F.array(*[F.lit(k) for k in range(0, 1600, 400)]), lambda k: k < F.length(t)), lambda k: F.substr(t, k + 1, F.lit(500)))
    paragraphs = F.slice(F.when(t.contains("\n\n"), F.split(t, "\n\n")).otherwise(slices), 1, 4)
    second = F.transform(F.filter(paragraphs, lambda p: F.length(strip(p)) > 50), lambda p: row(2, ask(part, F.substring(p, 1, 30)), p))
    found = F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(names), F.lit(0))), 1, 6)
    third = F.transform(found, lambda e: row(3, ask(about, e), F.get(F.filter(F.split(t, "[。.!?]"), lambda s: F.contains(s, e)), F.lit(0))))
    return df.where(t.isNotNull()).select(key, F.inline(F.concat(F.array(row(1, F.lit(whole), F.substring(t, 1, 500))), second, third)))


def by_quota(items: DataFrame, key: str, level: str, weight: str, ties: list, n: int, shares: dict[str, float]) -> DataFrame:
    """`items` with rank: n of each key, by levels in the order of `shares`, int(n * share) of each by falling weight; then the rest by falling weight."""
    order = F.coalesce(*[F.when(F.col(level) == k, i) for i, k in enumerate(shares)])
    most = F.coalesce(*[F.when(F.col(level) == k, int(n * v)) for k, v in shares.items()], F.lit(0))
    place = F.row_number().over(W.partitionBy(key, level).orderBy(F.desc(weight), *ties))
    dealt_ = items.withColumn("_in", place <= most).withColumn("_level", F.when(F.col("_in"), order))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_in"), "_level", F.desc(weight), *ties))
    return dealt_.withColumn("rank", rank).where(F.col("rank") <= n).drop("_in", "_level")


# An answer by level: what follows the term, how much of the hint, and what stands in for a hint.
ANSWERS = {
    "basic": ("は、", 100, "文書内で言及されている重要な概念です。"),
    "intermediate": ("について、", 150, "文書では詳細に説明されており、その特徴や使用方法が示されています。"),
    "advanced": ("の", 200, "技術的な詳細や応用例が文書内で議論されています。"),
}


def answer_by_level(term: Column, level: Column, hint: Column) -> Column:
    """An answer about a term from a hint, such as its best sentence; a null or empty hint is replaced, an unknown level is advanced."""
    told = {k: F.concat(term, F.lit(join), F.when(F.length(hint) > 0, F.substring(hint, 1, n)).otherwise(other)) for k, (join, n, other) in ANSWERS.items()}
    return F.when(level == "basic", told["basic"]).when(level == "intermediate", told["intermediate"]).otherwise(told["advanced"])


def answer_with_related(term: Column, level: Column, hint: Column, others: Column) -> Column:
    """The hint, and unless the level is basic the first two related terms; without a hint that it is about the term."""
    named = F.concat(F.lit("関連する概念として、"), F.array_join(F.slice(others, 1, 2), "、"), F.lit("があります。"))
    more = F.concat(hint, F.lit(" "), F.when(level != "basic", named).otherwise(""))
    return F.when(F.length(hint) > 0, F.when(F.size(others) > 0, more).otherwise(hint)).otherwise(F.concat(term, F.lit("に関する説明")))


# Questions on a named entity by its kind ("" is any other), and on when and where something happens.
ENTITIES = {
    "PERSON": ["{}は誰ですか？", "{}は何をしましたか？", "{}の役割は何ですか？"],
    "ORG": ["{}はどのような組織ですか？", "{}の使命は何ですか？", "{}は何を提供していますか？"],
    "PRODUCT": ["{}の特徴は何ですか？", "{}はどのように使われますか？", "{}の利点は何ですか？"],
    "WORK_OF_ART": ["{}の特徴は何ですか？", "{}はどのように使われますか？", "{}の利点は何ですか？"],
    "": ["{}とは何ですか？", "{}の重要性は何ですか？", "{}の例を挙げてください。"],
}


def _first_sentences(texts: pa.Array, names: pa.Array) -> pa.Array:
    """For each name of a text the first sentence that has it, else null. A name without a stop stands in one sentence wherever it stands."""
    out = []
    for text, own in zip(texts, names, strict=True):
        whole = text.as_py() or ""
        ends = [*(m.start() for m in re.finditer("[。.!?]", whole)), len(whole)]
        found = []
        for name in own.as_py() or []:
            at = -1 if re.search("[。.!?]", name) else whole.find(name)
            k = bisect_left(ends, at)
            found.append(whole[ends[k - 1] + 1 if k else 0 : ends[k]] if at >= 0 else None)
        out.append(pa.array(found, pa.string()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in out]), pa.int32()), pa.concat_arrays(out)) if out else pa.array([], pa.list_(pa.string()))


def by_entity(df: DataFrame, entities: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity, question, answer, type, confidence): three questions on each of `entities` (key, entity, kind), answered by the first sentence
    of the key's text that has it; entities that no sentence has give none. An analyser of the caller tells entities and kinds."""
    names = entities.where("entity <> ''").groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("entity", "kind")).alias("_l"))
    both = df.select(key, F.col(text).alias("_text")).join(names, F.col(key) == F.col("_k"))
    told = F.arrow_udf(_first_sentences, "array<string>")(F.col("_text"), F.col("_l.entity"))
    each = both.select(key, F.inline(F.arrays_zip(F.col("_l").alias("e"), told.alias("first")))).select(key, "e.*", "first")
    filled = {k: F.array(*[F.replace(F.lit(q), F.lit("{}"), F.col("entity")) for q in qs]) for k, qs in ENTITIES.items()}
    asked = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in filled.items() if k], filled[""])
    rows = each.select(key, "entity", asked.alias("_q"), strip(F.col("first")).alias("answer")).where("answer IS NOT NULL")
    return rows.select(key, "entity", F.explode("_q").alias("question"), "answer", F.lit("entity_based").alias("type"), F.lit(0.75).alias("confidence"))


def by_facts(parsed: DataFrame, key: str) -> DataFrame:
    """(key, question, answer, type, confidence): when and where, for each sentence of `parsed` (key, subjects, verbs, dates, places: arrays that a
    parser of the caller found in it) with a subject and a verb; the first of each array is taken."""
    head = lambda c: F.get(c, F.lit(0))
    who, does = head("subjects"), head("verbs")
    one = lambda q, c, kind: F.when(who.isNotNull() & does.isNotNull() & head(c).isNotNull(), F.struct(q.alias("question"), F.concat(head(c), F.lit("です。")).alias("answer"), F.lit(kind).alias("type"), F.lit(0.7).alias("confidence")))
    when = one(F.concat(who, F.lit("はいつ"), does, F.lit("ましたか？")), "dates", "temporal")
    where = one(F.concat(who, F.lit("はどこで"), does, F.lit("ますか？")), "places", "location")
    return parsed.select(key, F.inline(F.array_compact(F.array(when, where))))


def for_keywords(df: DataFrame, key: str, text: str, n: int, stop: list[str], important: list[str], shares: dict[str, float]) -> DataFrame:
    """(key, term, question, answer_length): two questions on each of up to n keywords of a text, by quotas of difficulty.

    Of the 2n best keywords those that can be asked about stay, without ones that others contain or mean; their difficulty and
    category are told from the text.
    """
    found = keywords.integrated(df, key, text, 2 * n, stop, important).where(K.usable(F.col("term"), stop))
    found = keywords.without_synonyms(keywords.without_contained(found, key), key)
    both = found.join(df.select(F.col(key).alias("_k"), F.col(text).alias("_text")), F.col(key) == F.col("_k"))
    levels = both.select(key, "term", "rank", "score", K.difficulty(F.col("term"), F.col("_text")).alias("difficulty"), K.category(F.col("term")).alias("category"))
    kept = by_quota(levels.withColumnRenamed("rank", "_place"), key, "difficulty", "score", ["_place"], n, shares)
    return by_template(kept.select(key, "term", "difficulty", "category"), key)


def in_phases(df: DataFrame, phases: list[DataFrame], key: str, text: str, n: int = 20, least: float = 0.7) -> DataFrame:
    """(key, place, question, answer, type, quality): up to n pairs of each text from phases (key, question, answer, type, confidence) in order, such as rules,
    templates and a model's answers: each fills what those before it left open.

    Rule pairs under `least` confidence are left out, and a question counts once, in its first phase. A pair must stand a check: a question of 5 to
    200 characters, an answer of 5 to 500, and half or more of the answer's terms in the text. quality is `K.pair_quality` of an intermediate pair; the best stand first.
    """
    every = None
    for i, p in enumerate(phases):
        one = p.where(F.col("confidence") >= least).select(key, F.lit(i).alias("_phase"), "question", "answer", "type", "confidence")
        every = one if every is None else every.unionByName(one)
    first = F.min(F.struct("_phase", -F.col("confidence"), "answer", "type"))
    once = every.groupBy(key, "question").agg(first.alias("_f")).select(key, "question", "_f._phase", "_f.answer", "_f.type")
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    told = F.array_distinct(terms(F.col("answer")))
    known = F.size(F.filter(told, lambda w: F.contains(F.col("_text"), w))) * 2 >= F.size(told)
    sound = F.length("question").between(5, 200) & F.length("answer").between(5, 500) & known
    good = once.join(texts, F.col(key) == F.col("_k")).where(sound).drop("_k", "_text")
    quality = F.round(K.pair_quality(F.col("question"), F.col("answer"), F.lit("intermediate"), F.size(terms(F.col("question"))), F.col("type")), 6)
    scored = good.withColumn("quality", quality)
    ranked = scored.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_phase", F.desc("quality"), "question"))).where(F.col("_r") <= n)
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("quality"), "_phase", "question"))
    return ranked.select(key, place.alias("place"), "question", "answer", "type", "quality")


def topped_up(chunks: DataFrame, key: str, at: str, text: str, most: int = 300, n: int = 4, more: int = 50) -> DataFrame:
    """(key, at, i, question, answer, type): questions on a document's chunks by `by_chunk`, those that begin with the same 30 characters once.

    Of a document with over `most` chunks evenly spaced ones are taken (at most `most`; a sampling operator). Where fewer than two questions
    a chunk come out, the `more` chunks after that number of them give two each.
    """
    w = W.partitionBy(key)
    rows = chunks.select(key, at, text, (F.row_number().over(w.orderBy(at)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    taken = F.least("_n", F.lit(most))
    ids = rows.withColumn("_id", F.struct(key, at, "_i", "_n"))
    chosen = ids.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < most))
    asked = by_chunk(chosen, "_id", text, n).select("_id.*", "i", "question", "answer", "type")
    once = asked.withColumn("_r", F.row_number().over(W.partitionBy(key, F.substring("question", 1, 30)).orderBy("_i", "i"))).where("_r = 1").drop("_r", "_i", "_n")
    counts = once.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_have"))
    late = ids.where(F.col("_i").between(taken, taken + more - 1))
    short = late.join(counts, F.col(key) == F.col("_key"), "left").where(F.coalesce("_have", F.lit(0)) < 2 * F.col("_n"))
    extra = by_chunk(short, "_id", text, 2).select("_id.*", "i", "question", "answer", "type").drop("_i", "_n")
    return once.unionByName(extra)
