"""Question answering over retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import shared_path

STEPS, PER_STEP = 3, 3
#: The reply without documents, the mark of a further search, the note that ends them, and how a source is cited.
NOTHING = "I couldn't find any relevant documents to answer your question."
AGAIN, ENDED = r"SEARCH:\s*(.+)", "*Max search steps reached. Best effort answer:*"
CITED = "\nSource [%s]: %s (Lines %s-%s)\n%s"


def context_line(number: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    """One cited source; a missing path is unknown, a missing or zero line ?."""
    line = lambda n: F.when(F.coalesce(n, F.lit(0)) == 0, "?").otherwise(n.cast("string"))
    return F.when(text.isNotNull(), F.format_string(CITED, number.cast("string"), F.coalesce(path, F.lit("unknown")), line(start), line(end), F.trim(text)))


def contexts(rows: DataFrame, query: str, order: list, limit: int = PER_STEP) -> DataFrame:
    """(query, context): the best ``limit`` rows (path, start_line, end_line, text) of each query, as cited text."""
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("__n") <= limit)
    lines = placed.select(query, "__n", context_line(F.col("__n"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(query).agg(joined.alias("context"))


def accumulate(known: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """Known rows and the new ones whose text isn't known, each text once."""
    fresh = new.join(known.select(text).distinct(), text, "left_anti").dropDuplicates([text])
    return known.unionByName(fresh.select(*known.columns))


def without_search(answer: Column) -> Column:
    """The answer when steps run out: its request for another search replaced by a note."""
    return F.regexp_replace(answer, "SEARCH:.*", ENDED)


def deep_dive(search: Callable[[DataFrame, int], DataFrame], questions: DataFrame, generate: Callable[[Column, Column], Column], max_steps: int = STEPS, per_step: int = PER_STEP) -> DataFrame:
    """(qid, answer, sources, steps) for all questions (qid, text) at once, each step one search for those that are still open.

    ``search`` gives (qid, rank, path, start_line, end_line, text) for (qid, text); ``generate`` makes the answer's column from question
    and context. An answer with SEARCH: and another query keeps a question open, up to ``max_steps``; a text is cited once. Without any
    document in the first step the answer is the fixed reply. What a step found and answered is written, so no step runs twice.
    """
    spark, folder = questions.sparkSession, shared_path(questions.sparkSession, "deep-dive")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    open_rows, known, answers = questions.select("qid", F.col("text").alias("question"), F.col("text").alias("query")), None, None
    for step in range(max_steps):
        found = search(open_rows.select("qid", F.col("query").alias("text")), per_step).select("qid", F.lit(step).alias("step"), "rank", "path", "start_line", "end_line", "text")
        if known is not None:
            found = found.join(known.select("qid", "text"), ["qid", "text"], "left_anti").unionByName(known)
        once = F.row_number().over(Window.partitionBy("qid", "text").orderBy("step", "rank"))
        known = stored(found.withColumn("__once", once).where("__once = 1").drop("__once"), f"known-{step}")
        cited = contexts(known, "qid", [F.asc("step"), F.asc("rank")], per_step * max_steps).join(known.groupBy("qid").agg(F.count("*").alias("sources")), "qid")
        said = open_rows.join(cited, "qid", "left")
        nothing = F.col("context").isNull()
        text = F.when(nothing, F.lit(NOTHING)).otherwise(generate(F.col("question"), F.col("context")))
        again = F.when(nothing, "").otherwise(F.trim(F.regexp_extract("answer", AGAIN, 1)))
        said = stored(said.withColumn("answer", text).withColumn("query", again), f"said-{step}")
        ended = F.col("query") == "" if step + 1 < max_steps else F.lit(True)
        final = said.where(ended).select("qid", without_search(F.col("answer")).alias("answer"), F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), F.lit(step + 1).alias("steps"))
        answers = final if answers is None else answers.unionByName(final)
        open_rows = said.where(~ended).select("qid", "question", "query")
    return answers
