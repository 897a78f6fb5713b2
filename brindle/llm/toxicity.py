"""Toxicity by the nearest labelled examples.

A bounded, class-balanced sample of labelled documents is the index. Terms (words, and word starts marked ``*``, each
also for repeated occurrence) that tell toxic documents from clean ones span the space; a document is its TF-IDF vector over
them, with document frequencies counted over the whole corpus. Vectors over all terms are not used, as a few toxic words weigh
little beside a text's own rare ones: see the README for figures. The examples' vectors are stored as inverted lists, cut into blocks of examples; for each term
and block the largest weight is kept. A query adds these maxima up to a bound per block, visits blocks in the order of
their bounds, and stops when no bound reaches the k-th best cosine: the result is the exact top k. Neighbours vote by
distance, and an isotonic map from votes to label rates, fitted on the examples with themselves left out, calibrates.

Defined cases: null and empty texts, and texts without any of the terms, get the label rate of the examples without
terms. Equal texts get equal scores; ties among neighbours go to the example that stands first in the index. Rows of
``labels`` with a null label or id, or of documents that aren't there, are ignored; of repeated ids the largest label and the least text count. Without toxic or without clean
examples every score is the label rate. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import PieceMemo, fold, text_slices, written

#: Examples per label at most, and terms at most: they bound the index, which is broadcast.
EXAMPLES, TERMS = 8192, 2048
NEIGHBOURS, BLOCK, BINS = 15, 64, 64
#: Least documents, z value and log odds ratio of a term.
LEAST_DOCS, LEAST_Z, LEAST_ODDS = 8, 3.0, 1.5
#: Lengths of the word starts that are terms beside the word, and numbers of occurrences that make further terms.
STARTS, REPEATS = (4, 5), (1, 2, 4)
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(piece: str) -> list[str]:
    words = _LETTERS.findall(piece.lower())
    return words + [w[:n] + "*" for w in words for n in STARTS if len(w) > n]


def count_terms(text: str | None) -> Counter[str]:
    terms: Counter[str] = Counter()
    for piece, n in Counter((text or "").split()).items():
        for term in terms_of(piece):
            terms[term] += n
    return terms


def repeated(counts: Counter[str]) -> set[str]:
    """The terms of a text, and for those that occur often a further term for each of REPEATS that they reach."""
    return {t + (chr(n) if n > 1 else "") for t, c in counts.items() for n in REPEATS if c >= n}


class TermReader:
    """Term numbers of texts."""

    def __init__(self, terms: dict[str, int]):
        self.bases: dict[str, int] = {}
        marks = {chr(n): place for place, n in enumerate(REPEATS) if n > 1}
        found = [(t[:-1], marks[t[-1]], i) if t[-1] in marks else (t, 0, i) for t, i in terms.items()]
        self.levels = np.full((len(found) + 1, len(REPEATS)), -1)
        for base, level, i in found:
            self.levels[self.bases.setdefault(base, len(self.bases)), level] = i
        self.memo = PieceMemo(self._pieces)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get = self.bases.get
        found = [[i for t in terms_of(p) if (i := get(t)) is not None] for p in pieces]
        return np.array([i for each in found for i in each], np.int32), np.array(list(map(len, found)), np.int64)

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its distinct term numbers and their counts."""
        ids, offsets = self.memo.lists([t.replace("\n", " ") for t in texts], " ")
        return [self._numbers(ids[a:b]) for a, b in zip(offsets, offsets[1:])]  # noqa: B905

    def _numbers(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ids):
            return ids, ids
        bases, counts = np.unique(ids, return_counts=True)
        reached = np.where(counts[:, None] >= np.array(REPEATS), self.levels[bases], -1)
        rows, _ = np.nonzero(reached >= 0)
        numbers = reached[reached >= 0]
        order = np.argsort(numbers)
        return numbers[order], counts[rows][order]


@dataclass
class Index:
    """Block-max inverted index of the examples' unit vectors."""

    idf: np.ndarray
    doc_ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of an example's label, so that votes follow the labels' rates
    pointers: np.ndarray  # terms x (blocks + 1), into examples and values
    examples: np.ndarray
    values: np.ndarray
    maxima: np.ndarray  # terms x blocks

    @classmethod
    def build(cls, vectors: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray, class_weights: tuple[float, float]) -> Index:
        """From (doc_id, label, terms, counts). Examples are ordered by their weightiest term, so blocks are alike inside."""
        unit = [(d, y, t, unit_vector(t, c, idf)) for d, y, t, c in vectors]
        unit.sort(key=lambda e: (int(e[2][np.argmax(e[3])]), e[1], e[0]))
        n_terms, n_blocks = len(idf), max(1, -(-len(unit) // BLOCK))
        terms = np.concatenate([e[2] for e in unit]) if unit else np.zeros(0, np.int64)
        examples = np.repeat(np.arange(len(unit)), [len(e[2]) for e in unit])
        values = np.concatenate([e[3] for e in unit]) if unit else np.zeros(0)
        order = np.lexsort((examples, terms))
        terms, examples, values = terms[order].astype(np.int64), examples[order], values[order]
        cells = terms * n_blocks + examples // BLOCK
        edges = np.searchsorted(cells, np.arange(n_terms * n_blocks + 1))
        maxima = np.zeros(n_terms * n_blocks)
        np.maximum.at(maxima, cells, values)
        pointers = np.hstack([edges[:-1].reshape(n_terms, n_blocks), edges[n_blocks::n_blocks].reshape(-1, 1)])
        labels = np.array([e[1] for e in unit], np.int64)
        return cls(idf, np.array([e[0] for e in unit], np.int64), labels, np.array(class_weights)[labels], pointers, examples, values, maxima.reshape(n_terms, n_blocks))

    def search(self, terms: np.ndarray, vector: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine, first in the index first among ties, and their cosines."""
        bounds = vector @ self.maxima[terms] + 1e-9
        blocks = np.argsort(-bounds, kind="stable")
        best, cosine, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(blocks) and (len(best) < k or bounds[blocks[at]] >= cosine[-1]) and bounds[blocks[at]] > 1e-9:
            some = np.sort(blocks[at : at + step])
            at, step = at + step, 2 * step
            first, last = self.pointers[np.ix_(terms, some)].ravel(), self.pointers[np.ix_(terms, some + 1)].ravel()
            sizes = last - first
            places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            found, slot = np.unique(self.examples[places], return_inverse=True)
            scores = np.bincount(slot, self.values[places] * np.repeat(np.repeat(vector, len(some)), sizes), len(found))
            keep = found != without
            best, cosine = np.concatenate([best, found[keep]]), np.concatenate([cosine, scores[keep]])
            order = np.lexsort((best, -np.round(cosine, 12)))[:k]
            best, cosine = best[order], cosine[order]
        return best, cosine

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Share of the toxic neighbours' weight, near ones counting more."""
        near = self.weights[best] / (1.05 - np.minimum(cosine, 1.0))
        return float((near * self.labels[best]).sum() / near.sum())


def unit_vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term frequencies that saturate, 2 tf / (tf + 1), so that a long text's common terms don't outweigh the others, times idf."""
    vector = 2.0 * counts / (counts + 1.0) * idf[terms]
    return vector / np.sqrt((vector * vector).sum())


@dataclass
class Model:
    terms: dict[str, int]
    index: Index
    bins: np.ndarray  # votes
    rates: np.ndarray  # label rates at these votes, ascending
    bare: float  # score of texts without terms

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Score, and the ids of the three nearest examples."""
        if not len(terms) or not len(self.index.doc_ids):
            return self.bare, []
        best, cosine = self.index.search(terms, unit_vector(terms, counts, self.index.idf))
        if not len(best):
            return self.bare, []
        return float(np.interp(self.index.vote(best, cosine), self.bins, self.rates)), self.index.doc_ids[best[:3]].tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, examples: int = EXAMPLES) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, text, toxic) of at most ``examples`` training documents per label, and the labels' counts in training; only labels
    whose documents are in ``docs`` count."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1)")
    train = written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")
    counts = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    picks = [train.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(sample, "toxic-sample"), (counts.get(0, 0), counts.get(1, 0))


def select_terms(sample: DataFrame, sizes: tuple[int, int], limit: int = TERMS) -> dict[str, int]:
    """Terms that stand more often in toxic documents, by the z value of the log odds ratio; so a long clean part hides nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for at, n in text_slices(batch.column(0)):
                for text, toxic in zip(*(c.to_pylist() for c in batch.slice(at, n).columns), strict=True):
                    found[toxic].update(repeated(count_terms(text)))
            names = list(found[0] | found[1])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[y][t] for t in names], pa.int64()) for y in (0, 1))], ["term", "clean", "toxic"])

    a, b, size_a, size_b = F.col("toxic") + 0.5, F.col("clean") + 0.5, F.lit(sizes[1] + 1.0), F.lit(sizes[0] + 1.0)
    odds = F.log(a / (size_a - a)) - F.log(b / (size_b - b))
    counted = sample.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rated = counted.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    kept = rated.where((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "term").limit(limit).select("term").collect()
    return {r.term: i for i, r in enumerate(kept)}


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents; a count per term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found, n = TermReader(shared.value), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for at, rows in text_slices(batch.column(0)):
                for numbers, _ in reader.read([t or "" for t in batch.column(0).slice(at, rows).to_pylist()]):
                    found[numbers] += 1
                n += rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(terms))], pa.int32()), pa.array([n, *found.tolist()], pa.int64())], ["term", "n"])

    sums = {r.term: r.n for r in docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(terms))], np.int64), sums.get(-1, 0)


def _pool(bins: np.ndarray, toxic: np.ndarray, total: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic label rates by pooling adjacent violators; each bin gets two pseudo-examples of the prior rate."""
    stack: list[list[float]] = []
    for x, a, n in zip(bins, toxic + 2 * prior, total + 2.0, strict=True):
        stack.append([x, x, a, n])
        while len(stack) > 1 and stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3]:
            _, high, a2, n2 = stack.pop()
            stack[-1] = [stack[-1][0], high, stack[-1][2] + a2, stack[-1][3] + n2]
    points = [(x, a / n) for low, high, a, n in stack for x in sorted({low, high})]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Learn from the labelled documents outside fold 0."""
    context = docs.sparkSession.sparkContext
    sample, counts = labelled_sample(docs, labels, folds)
    got = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    sizes = (got.get(0, 0), got.get(1, 0))
    prior = counts[1] / max(1, sum(counts))
    terms = select_terms(sample, sizes) if min(sizes) else {}
    frequency, n_docs = document_frequencies(docs, terms) if terms else (np.zeros(0, np.int64), 0)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    weights = tuple(c / max(1, n) for c, n in zip(counts, sizes, strict=True))
    shared = context.broadcast(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(shared.value)
        for batch in batches:
            pairs = [p for at, n in text_slices(batch.column(1)) for p in reader.read([t or "" for t in batch.column(1).slice(at, n).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([p[i].tolist() for p in pairs], pa.list_(pa.int32())) for i in (0, 1))], ["doc_id", "toxic", "terms", "counts"])

    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").collect()
    full = [(r.doc_id, r.toxic, np.array(r.terms), np.array(r.counts)) for r in rows if r.terms]
    bare = [weights[r.toxic] * np.array([1 - r.toxic, r.toxic]) for r in rows if not r.terms]
    clean, toxic = np.sum(bare, axis=0) if bare else (0.0, 0.0)
    index = Index.build(full, idf, weights)
    model = Model(terms, index, np.array([0.0, 1.0]), np.array([prior, prior]), float((toxic + 2 * prior) / (clean + toxic + 2)))
    if not full:
        return model
    held = context.broadcast(model)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, reader = held.value.index, TermReader(held.value.terms)
        places = {d: i for i, d in enumerate(index.doc_ids.tolist())}
        found = np.zeros((BINS + 1, 2))
        for whole in batches:
            for at, n in text_slices(whole.column(1)):
                ids, texts, labels = (c.to_pylist() for c in whole.slice(at, n).columns)
                for doc_id, toxic, (numbers, counts) in zip(ids, labels, reader.read([t or "" for t in texts]), strict=True):
                    if len(numbers):
                        best, cosine = index.search(numbers, unit_vector(numbers, counts, index.idf), without=places[doc_id])
                        if len(best):
                            found[round(BINS * index.vote(best, cosine)), toxic] += weights[toxic]
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS + 1), pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["bin", "clean", "toxic"])

    again = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    bins = {r.bin: r for r in again.mapInArrow(leave_out, "bin int, clean double, toxic double").groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    used = [b for b in sorted(bins) if bins[b].clean + bins[b].toxic > 0]
    if used:
        hit = np.array([bins[b].toxic for b in used])
        model.bins, model.rates = _pool(np.array(used) / BINS, hit, hit + np.array([bins[b].clean for b in used]), prior)
    return model


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column (score, evidence) of a text column: the calibrated score and the nearest examples' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, evidence: array<bigint>>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, reader = shared.value, TermReader(shared.value.terms)
        for texts in batches:
            found = [model.score(*v) for at, n in text_slices(texts) for v in reader.read([t or "" for t in texts.slice(at, n).to_pylist()])]
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["score", "evidence"])

    return scores(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    scored = docs.select("doc_id", score_column(docs, fit(docs, labels, folds)).alias("s"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s.score")))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``limit``, all columns."""
    scored = docs.select(F.struct("*").alias("row"), score_column(docs, fit(docs, labels)).alias("s"))
    return scored.where(F.col("s.score") < limit).select("row.*")
