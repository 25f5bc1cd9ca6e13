"""Documents from files, and results to files. Paths are any that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import clean, strip

# Columns that may hold a document's text, in order of preference; other names of a question's and an answer's column.
CANDIDATES = ("text", "content", "body", "document", "answer", "question")
ALIASES = {"Question": "question", "Response": "answer", "Answer": "answer", "correct_answer": "answer"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TXT (a document a line, blank lines dropped), JSON or JSONL by suffix; ValueError for others."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=True)
    if kind == "txt":
        return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")
    if kind in ("json", "jsonl"):
        return spark.read.json(path, multiLine=kind == "json")
    raise ValueError(f"unknown format: {kind}")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """(url, date, title, content, category) of a tree category/article.txt: three lines, then the text; files under four lines and licenses are left out."""
    lines = spark.read.text(f"{folder}/*/*.txt", wholetext=True).select(F.split("value", "\n").alias("l"), F.input_file_name().alias("f")).where(~F.col("f").contains("LICENSE") & (F.size("l") >= 4))
    at = lambda k: F.trim(F.get("l", F.lit(k)))
    return lines.select(at(0).alias("url"), at(1).alias("date"), at(2).alias("title"), strip(F.array_join(F.expr("slice(l, 4, size(l))"), "\n")).alias("content"), F.element_at(F.split("f", "/"), -2).alias("category"))


def combined(df: DataFrame, title: str | None = None, text: str | None = None) -> DataFrame:
    """`df` with Combined_Text: title and text, else the text, else the first candidate column, else all columns; blank ones dropped."""
    own = [c for c in (title, text) if c and c in df.columns] or next(([c] for c in CANDIDATES if c in df.columns), df.columns)
    parts: list[Column] = [F.nullif(clean(F.col(c).cast("string")), F.lit("")) for c in own]
    return df.withColumn("Combined_Text", F.concat_ws(" ", *parts)).where("Combined_Text <> ''")


def questions(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Questions and answers under their usual names, nulls as empty, each pair once."""
    named = df.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in df.columns and v not in df.columns})
    missing = {"question", "answer"} - set(named.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = named.na.fill("", ["question", "answer"]).dropDuplicates(["question", "answer"])
    return out.limit(limit) if limit else out


def save(df: DataFrame, folder: str, name: str) -> None:
    """A dataset as CSV, its Combined_Text as lines, and one row about it as JSON."""
    df.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
    df.select(F.regexp_replace("Combined_Text", "\n", " ")).write.mode("overwrite").text(f"{folder}/{name}.txt")
    df.agg(F.count("*").alias("row_count")).withColumns({"dataset": F.lit(name), "processed_at": F.current_timestamp()}).write.mode("overwrite").json(f"{folder}/{name}.metadata")


def append(df: DataFrame, path: str) -> None:
    """Rows added to a CSV log."""
    df.write.mode("append").csv(path, header=True)


def history(spark: SparkSession, folder: str, pattern: str = "*", newest_first: bool = True) -> DataFrame:
    """(name, modified, bytes, size) of a folder's files by time, the size as text; contents aren't read."""
    n = F.col("length")
    size = F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    at = F.col("modified")
    return files.select(name.alias("name"), F.col("modificationTime").alias("modified"), n.alias("bytes"), size.alias("size")).orderBy(at.desc() if newest_first else at.asc(), "name")


def newest(spark: SparkSession, folder: str, pattern: str, by_time: bool = False) -> str | None:
    """The path of the file whose name, as with a date in it, is last, or that was written last; None without any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    last = files.agg(F.max_by("path", F.struct("modificationTime", "path")) if by_time else F.max("path")).first()
    return last[0]


def matching_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The columns whose name contains a wanted name or stands in one, letters in either case."""
    return [c for c in df.columns if any(w.lower() in c.lower() or c.lower() in w.lower() for w in wanted)]


def preprocessed(df: DataFrame, wanted: list[str], least: int = 1) -> DataFrame:
    """`df` once a row, without rows of nulls only, its matching columns cleaned, with their Combined_Text of `least` characters or more.

    Rows are compared by all columns, so a map column isn't allowed. Without a matching column no row has text.
    """
    own = matching_columns(df, wanted)
    once = df.dropDuplicates().na.drop("all").withColumns({c: clean(F.col(c).cast("string")) for c in own})
    return once.withColumn("Combined_Text", F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in own])).where(F.length("Combined_Text") >= max(least, 1))


def complete_pairs(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """The rows whose question and answer are neither null nor blank."""
    return df.where((F.trim(question) != "") & (F.trim(answer) != ""))


def preview(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """The first n rows of a few columns; the others aren't read."""
    return df.select(*columns).limit(n)


def project(spark: SparkSession, path: str, out: str, columns: tuple[str, ...] = ("question", "answer")) -> None:
    """A file's columns as another CSV."""
    read(spark, path).select(*columns).write.mode("overwrite").csv(out, header=True, escape='"')


def paragraphs_of(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a text corpus, a row for what blank lines part, blank ones dropped; files are read in parts."""
    return spark.read.option("lineSep", "\n\n").text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")


def entries(df: DataFrame, number: str, columns: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """(value): each row as a text of named fields under its number, blank fields left out, to be written as a corpus."""
    fields = [F.when(strip(F.col(c)) != "", F.concat(F.lit(f"**{c}**: "), strip(F.col(c)))) for c in columns if c in df.columns]
    return df.select(F.concat_ws("\n", F.concat(F.lit("## Entry "), F.col(number)), *fields, F.lit("\n---\n")).alias("value"))
