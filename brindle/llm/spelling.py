"""Spelling variants: words one edit apart, by scans of sorted lists.

The vocabulary is sorted twice, forwards and by reversed words, and cut into blocks of neighbours. Of two words one edit apart, one
edit in the second half leaves them neighbours in the first list and one in the first half leaves them neighbours in the
second: they share a beginning (or an end) of half their length. So a word only meets the blocks that hold words of its beginning, and its end.
There it scans the sorted words with a banded edit matrix of three cells a row. Rows belong to prefixes, so what a word
shares with the one before it (their LCP) keeps its rows; where all three cells of a prefix exceed one edit, all words of that
prefix are skipped at once. A block whose common prefix is that far away isn't visited.

Blocks and the words that visit them meet by key, in parts of bounded size, so no task holds more than a block and a part, however many
words share a beginning. Only the blocks' edges reach the driver: two words for each ``BLOCK`` of the vocabulary.

A word's form is its most frequent near word, if that is ``FACTOR`` times as frequent; forms are followed by pointer doubling, as
frequencies grow by the factor at each step, so a few rounds suffice whatever the vocabulary.

Defined cases: null texts have no words; a null id is an empty one. Words are compared by code points, ties of frequency go to the smallest.
Rows that share an id count each for itself. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ascii_lower, written

#: Least code points and occurrences of a word, and how much more frequent its form has to be.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Words in a block, and words that meet it at a time.
BLOCK, PART = 16384, 8192
RUN = r"[A-Za-zÀ-ÿ]+"
_LAST = chr(0x10FFFF)


def words_of(docs: DataFrame, every: int | None = 199) -> DataFrame:
    """(word) of every run of letters, lower-cased in A-Z; one in ``every``, by a checksum of document and word, loses a code point."""
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    if every is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def fixed_part(length: int) -> int:
    """What a word shares with any near word, at its beginning or at its end."""
    return max(LEAST_LENGTH // 2, (length - 1) // 2)


def next_row(row: tuple[int, int, int], depth: int, letter: str, word: str) -> tuple[int, int, int]:
    """The matrix row of a prefix with one more letter: edits from it to word[:depth], word[:depth + 1] and word[:depth + 2]."""
    before, same, after = row
    first = min(same + 1, before + (letter != word[depth - 1]) if depth else 9) if depth <= len(word) else 9
    second = min(same + (letter != word[depth]), after + 1, first + 1) if depth < len(word) else 9
    third = min(after + (letter != word[depth + 1]), second + 1) if depth + 1 < len(word) else 9
    return first, second, third


class SortedWords:
    """A block: sorted words and the LCP of each with the one before it."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lcp = [0, *(shared(a, b) for a, b in zip(words, words[1:], strict=False))]
        self.scanned = 0  # words looked at, for tests

    def near(self, word: str, fixed: int) -> Iterator[int]:
        """Places of the words one edit from ``word`` that share its first ``fixed`` letters."""
        words, lcp, start = self.words, self.lcp, word[:fixed]
        at, end = bisect_left(words, start), bisect_left(words, start + _LAST)
        rows = [(9, 9, 9)] * fixed + [(1, 0, 1 if len(word) > fixed else 9)]
        known = fixed
        while at < end:
            self.scanned += 1
            other, depth = words[at], known
            del rows[known + 1 :]
            row = rows[known]
            while depth < len(other) and min(row) <= 1:
                row = next_row(row, depth, other[depth], word)
                rows.append(row)
                depth += 1
            if min(row) > 1:  # every word of this prefix is too far
                at = bisect_left(words, other[:depth] + _LAST, at + 1, end)
            else:
                gap = len(word) - depth + 1
                if 0 <= gap <= 2 and row[gap] == 1:
                    yield at
                at += 1
            if at < end:
                known = max(fixed, min(depth, lcp[at]))


def reachable(word: str, fixed: int, low: str, high: str) -> bool:
    """Whether a block from ``low`` to ``high`` may hold a near word: its common prefix isn't too far yet."""
    common = low[: shared(low, high)]
    row = (1, 0, 1 if len(word) > fixed else 9)
    for depth in range(fixed, len(common)):
        row = next_row(row, depth, common[depth], word)
        if min(row) > 1:
            return False
    return True


def sorted_blocks(vocab: DataFrame, blocks: int) -> DataFrame:
    """(side, s, n, block): the words and, on side 1, the reversed words, sorted and cut into blocks."""
    both = vocab.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("e"), "n").select("e.*", "n")
    ordered = both.repartitionByRange(blocks, "side", "s").sortWithinPartitions("side", "s")
    return written(ordered.withColumn("block", (F.spark_partition_id() * 2 + F.col("side")).cast("long")), "spelling-lists")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): how many words are near, and the most frequent of them; no row for words without."""
    spark = vocab.sparkSession
    lists = sorted_blocks(vocab, max(1, -(-2 * vocab.count() // BLOCK)))
    found = lists.groupBy("block").agg(F.min("side").alias("side"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
    edges = [sorted((r.low, r.high, r.block) for r in found if r.side == side) for side in (0, 1)]
    held = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("array<struct<side: int, block: long>>")
    def visited(words: pd.Series) -> pd.Series:
        highs = [[high for _, high, _ in some] for some in held.value]

        def blocks(word: str) -> list[dict]:
            out = []
            for side, some in enumerate(held.value):
                own = word[::-1] if side else word
                fixed = fixed_part(len(own))
                start = own[:fixed]
                at = bisect_left(highs[side], start)
                while at < len(some) and some[at][0] <= start + _LAST:
                    if reachable(own, fixed, some[at][0], some[at][1]):
                        out.append({"side": side, "block": some[at][2]})
                    at += 1
            return out

        return words.map(blocks)

    visits = written(vocab.select("word", F.explode(visited("word")).alias("v")).select("word", "v.side", "v.block"), "spelling-visits")
    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    left = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts"))).select("block", "part", "side", "word")
    right = lists.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("block", "part", "s", "n")

    def scan(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(block):
            block, side = block.sort_values("s"), int(asked.side.iloc[0])
            words, counts = SortedWords(block.s.to_list()), block.n.to_list()
            for word in sorted(asked.word):
                own = word[::-1] if side else word
                fixed = fixed_part(len(word))
                count, best = 0, None
                for place in words.near(own, fixed):
                    other = words.words[place][::-1] if side else words.words[place]
                    if side and other[:fixed] == word[:fixed]:
                        continue  # the first list has it
                    count += 1
                    best = min(best or (0, ""), (-counts[place], other))
                if count:
                    out.append((word, count, -best[0], best[1]))
        return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.word").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling."""
    now = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if then.where("moved").isEmpty():
            return then.drop("moved")
        now = then.drop("moved")


def is_form(near_n: Column, n: Column, factor: int = FACTOR) -> Column:
    return near_n >= factor * n


def variants(vocab: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    vocab = written(vocab, "spelling-words")
    near = near_words(vocab)
    likely = is_form(F.col("near_n"), F.col("n"), factor)
    linked = written(vocab.join(near, "word", "left").select("word", F.when(likely, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(linked.where("form IS NOT NULL"))
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
