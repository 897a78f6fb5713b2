"""Sparse and dense representations of texts."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import TOKEN_BYTES, TOKEN_GAP, stable_bucket, tokens

BUCKETS = 30_000


def hashing_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed token hashes, scaled to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), dims), np.float32), {}
        for row, text in zip(out, texts, strict=True):
            counts = Counter(text.lower().split())
            for word, n in counts.items():
                if word not in known:  # a batch's words are hashed once
                    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                    known[word] = (h % dims, 1 if h >> 63 else -1)
                place, sign = known[word]
                row[place] += sign * n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return encode


def dense(text: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder) -> Column:
    """Vectors by any encoder; it is made once per task, so models load once. The function counts as nondeterministic, or Spark would call it again in
    every filter over the vectors."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    return embed.asNondeterministic()(text)


def _words(docs: DataFrame, key: str, words: Column, buckets: int, keep: list[int] | None) -> DataFrame:
    """(key, term) of every word; with ``keep`` words of other entries go where they stand, and the rest to where all that follows by key is done."""
    rows = docs.select(key, F.explode(words).alias("term"))
    return rows if keep is None else rows.where(stable_bucket(F.col("term"), buckets).isin(keep)).repartition(key)


def keywords() -> Column:
    """A text's words of more than two characters, repeats included; none without a text."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[ \t\r\n\f\x0b]+", " ")), " ")
    return F.coalesce(F.filter(words, lambda w: F.length(w) > 2), F.array().cast("array<string>"))


def keyword_vector(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, keep: list[int] | None = None) -> DataFrame:
    """(key, term, idx, val): counts of words longer than two characters, of the entries ``keep`` where given; words that collide keep entries of their own."""
    counts = _words(docs, key, keywords(), buckets, keep).groupBy(key, "term").agg(F.count("*").cast("double").alias("val"))
    return counts.select(key, "term", stable_bucket(F.col("term"), buckets).alias("idx"), "val")


def pooled(logits: DataFrame, key: str = "doc_id") -> DataFrame:
    """SPLADE pooling of (key, idx, logit): the largest logit per entry, negative ones to zero, log1p, zeros dropped."""
    weight = F.log1p(F.greatest(F.max("logit"), F.lit(0.0)))
    return logits.groupBy(key, "idx").agg(weight.alias("val")).where("val > 0")


def term_weights(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, keep: list[int] | None = None) -> DataFrame:
    """(key, idx, val): square roots of term frequencies by bucket, of the entries ``keep`` where given, without document frequencies."""
    words = _words(docs, key, tokens(F.col("text")), buckets, keep).groupBy(key, "term").agg(F.count("*").alias("n"))
    return words.groupBy(key, stable_bucket(F.col("term"), buckets).alias("idx")).agg(F.sqrt(F.sum("n").cast("double")).alias("val"))


# ---- vectors from the corpus

#: Words of the vocabulary, by the number of texts that hold them, more columns than wanted while iterating, rounds, and words whose rows are added up together.
WORDS, MORE, ROUNDS, CHUNK = 8192, 8, 3, 256


class Latent:
    """Latent semantic vectors: a text's tf-idf weights over a vocabulary, projected on the corpus' main directions, at length one.

    Texts without a word of the vocabulary are zero.
    """

    def __init__(self, words: list[str], idf: np.ndarray, basis: np.ndarray):
        self.words, self.idf, self.basis = words, idf, basis
        self.places = {w: i for i, w in enumerate(words)}

    def weights(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, weight) of each text's known words, every text at length one."""
        known = [Counter(map(self.places.get, own)) for own in texts]
        found = [(i, p, n) for i, own in enumerate(known) for p, n in own.items() if p is not None]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        row, word, n = (np.array(c) for c in zip(*found, strict=True))
        weight = (1 + np.log(n)) * self.idf[word]
        return row, word, weight / np.sqrt(np.bincount(row, weight**2))[row]

    def project(self, texts: list[list[str]]) -> np.ndarray:
        row, word, weight = self.weights(texts)
        out = np.zeros((len(texts), self.basis.shape[1]))
        np.add.at(out, row, weight[:, None] * self.basis[word])
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        own = [[w for w in regex.split(TOKEN_GAP, t.lower()) if w and len(w.encode()) < TOKEN_BYTES] for t in texts]
        out = self.project(own)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


def _gram_product(words: DataFrame, model: Latent) -> np.ndarray:
    """The corpus' word-by-word matrix times the model's basis: tasks add up their texts, then chunks of words are added up in two steps."""
    rows, columns = model.basis.shape
    shared = words.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total = shared.value, np.zeros((rows, columns))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                own = batch["words"].iloc[at : at + 1024].to_list()
                row, word, weight = model.weights(own)
                np.add.at(total, word, weight[:, None] * model.project(own)[row])
        yield pd.DataFrame({"chunk": range(0, rows, CHUNK), "part": TaskContext.get().partitionId() % 64, "sums": [total[i : i + CHUNK].tobytes() for i in range(0, rows, CHUNK)]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in group.sums)
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "sums": [total.tobytes()]})

    parts = words.mapInPandas(add, "chunk int, part int, sums binary")
    summed = parts.groupBy("chunk", "part").applyInPandas(merge, "chunk int, sums binary").groupBy("chunk").applyInPandas(merge, "chunk int, sums binary")
    return np.concatenate([np.frombuffer(r.sums).reshape(-1, columns) for r in summed.orderBy("chunk").collect()])


def latent(docs: DataFrame, dims: int = 64, words: int = WORDS, rounds: int = ROUNDS) -> Latent:
    """Directions of a corpus (text) by a randomised decomposition: a random basis is multiplied by the word-by-word matrix, one pass over the
    texts each time, and made orthogonal. The driver holds ``words`` times ``dims`` numbers, whatever the corpus."""
    own = docs.select(tokens(F.col("text")).alias("words"))
    df = own.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known, n = df.orderBy(F.desc("df"), "term").limit(words).collect(), docs.count()
    names = [r.term for r in known]
    idf = np.log((1 + n) / (1 + np.array([r.df for r in known], float))) + 1e-3
    columns = min(len(names), dims + MORE)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(len(names), columns)))[0] if names else np.zeros((0, 0))
    model = Latent(names, idf, basis)
    if not names:
        return model
    for _ in range(rounds):
        model = Latent(names, idf, np.linalg.qr(_gram_product(own, model))[0])
    values, turn = np.linalg.eigh(model.basis.T @ _gram_product(own, model))
    return Latent(names, idf, model.basis @ turn[:, np.argsort(-values)[:dims]])
