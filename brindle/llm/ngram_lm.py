"""Word bigram language model with deleted interpolation.

P(w | v) mixes three maximum-likelihood estimates, c(v, w) / c(v), c(w) / N and 1 / (V + 1), by weights that depend on
the bucket of the context's frequency c(v). The weights are learned by expectation-maximisation: counts from the
training documents without a held-out part give the estimates, and the tokens of that part are the events. Afterwards
all training documents count.

How it runs. Documents are packed into slices of a few megabytes, which are written once. A slice lists its distinct
unigrams and bigrams as sorted 64-bit hashes and sends them, cut by hash range, to the buckets; a bucket adds the counts
of all slices up and answers each slice in the order of its request, so answers are plain counts. Slices and answers
meet again, and each slice scores its documents. Beyond FAN slices they first meet in parts of about FAN: a part adds its
slices' requests up by wide hash ranges, asks in their stead and hands the answers on; beyond FAN parts, parts meet in parts of parts,
and so on. So a hot word or bigram is one entry per slice of a part, then one per part, a slice sends a bounded number of blobs, and
a blob has about BUCKET / FAN bytes at every level, however large the corpus is.
No count table, and no dictionary, is ever held in one place; what is exchanged grows with the corpus.

Defined cases: a null or empty text is its end token alone; the context of a first word is the end token; repeated rows
count and score each for itself; texts of any length stand in one slice; with no held-out tokens (a tiny table) the
weights stay at their equal start; an empty table gives no rows. Two tokens with one 64-bit hash count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fold, text_slices, written

#: Bytes of text in a slice and per bucket.
SLICE, BUCKET = 8 << 20, 6 << 20
#: Slices that meet in one step, and about as many as a part has where there are more.
FAN = 512
#: Context-frequency buckets: by powers of two, the first for unseen contexts.
CONTEXTS = 16
FIT, HELD, OTHER = 0, 1, 2
_END = xxhash.xxh64_intdigest(b"\n")
#: Log-scale steps per octave and smallest power of two for the events' histogram.
_STEPS, _LEAST = 4, -40


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def slices(docs: DataFrame, trained, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slice, kind, bytes, blob): documents packed by kind; ``trained`` and ``held`` are conditions on the documents."""
    kind = F.when(~trained, OTHER).when(held, HELD).otherwise(FIT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # a task that runs again gives its slices the same numbers
        waiting: dict[int, list[pa.RecordBatch]] = {k: [] for k in (FIT, HELD, OTHER)}
        sizes = dict.fromkeys(waiting, 0)

        def flush(k: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            table = pa.Table.from_batches(waiting[k]).combine_chunks().to_batches()[0]
            row = [[number], [k], [sizes[k]], [_pack(table)]]
            waiting[k], sizes[k] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["slice", "kind", "bytes", "blob"])

        for batch in batches:
            for k in waiting:
                some = batch.filter(pc.equal(batch.column(0), k)).select([1, 2])
                for at, n in text_slices(some.column(1), SLICE // 4):
                    waiting[k].append(some.slice(at, n))
                    sizes[k] += pc.sum(pc.binary_length(some.column(1).slice(at, n))).as_py() or 0
                    if sizes[k] >= SLICE:
                        yield flush(k)
        for k in waiting:
            if waiting[k]:
                yield flush(k)

    rows = docs.select(kind.cast("int").alias("kind"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(pack, "slice long, kind int, bytes long, blob binary")


class Tokens:
    """Hashed tokens of a slice's documents; ``ends`` are the places after each document's end token."""

    def __init__(self, blob: bytes):
        batch = next(iter(pa.ipc.open_stream(blob)))
        self.doc_id = batch.column("doc_id")
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.cast(batch.column("text"), pa.large_string())))
        coded = words.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        at, offsets = coded.indices.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
        real = np.array([bool(n) for n in names], bool)[at] if len(at) else np.zeros(0, bool)
        kept = np.concatenate([[0], np.cumsum(real)])[offsets]
        n = len(offsets) - 1
        self.ends = kept[1:] + np.arange(1, n + 1)
        self.words = np.full(int(kept[-1]) + n, _END, np.uint64)
        is_word = np.ones(len(self.words), bool)
        is_word[self.ends - 1] = False
        self.words[is_word] = hashes[at[real]] if len(at) else np.zeros(0, np.uint64)
        self.before = np.concatenate([[np.uint64(_END)], self.words[:-1]]).astype(np.uint64)  # a document's first word follows an end token
        with np.errstate(over="ignore"):
            mixed = (self.before * np.uint64(0x9E3779B97F4A7C15)) ^ (self.words + (self.before >> np.uint64(29)))
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            self.pairs = mixed ^ (mixed >> np.uint64(32))

    def grams(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of unigrams and bigrams: the distinct hashes in order, each token's place among them, and their counts."""
        return [np.unique(x, return_inverse=True, return_counts=True) for x in (self.words, self.pairs)]


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin, and the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _keys_out(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted keys and counts, byte by byte of equal weight, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(steps + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _keys_in(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 16
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(8, n).T).view("<u8").ravel()


def _counts_out(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _counts_in(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def requests(packed: DataFrame, bits: int) -> DataFrame:
    """(bucket, slice, kind, gram, blob) for every slice, gram order and bucket that the slice has keys in."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for gram, (keys, _, counts) in enumerate(Tokens(blob).grams()):
                    at = _cut(keys, bits)
                    rows += [(b, number, kind, gram, _keys_out(keys[i:j], counts[i:j])) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]  # noqa: B905
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "slice", "kind", "gram", "blob"])

    return packed.select("slice", "kind", "blob").mapInArrow(ask, "bucket int, slice long, kind int, gram int, blob binary")


def answers(asked: DataFrame) -> DataFrame:
    """(slice, kind, gram, bucket, counts, fitted, total, distinct): counts over training slices in the request's order.

    ``fitted`` leaves held-out slices out and is only sent to them. Rows of slice -1 hold a bucket's training tokens
    and distinct training unigrams, with and without the held-out part.
    """

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        gram, out = int(group.gram.iloc[0]), []
        sent = [_keys_in(b) for b in group.blob]
        sizes = [len(k) for k, _ in sent]
        distinct, place = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
        weight = np.concatenate([c for _, c in sent]).astype(np.float64)  # sums are exact up to 2 ** 53
        kind = np.repeat(group.kind.to_numpy(), sizes)
        sums = {k: np.bincount(place[kind == k], weight[kind == k], len(distinct)).astype(np.int64) for k in (FIT, HELD)}
        every, at = sums[FIT] + sums[HELD], 0
        bucket = int(group.bucket.iloc[0])
        for number, k, size in zip(group.slice, group.kind, sizes, strict=True):
            own = place[at : at + size]
            at += size
            out.append((number, k, gram, bucket, _counts_out(every[own]), _counts_out(sums[FIT][own]) if k == HELD else None, None, None, None, None))
        if gram == 0:
            out.append((-1, OTHER, gram, bucket, None, None, int(every.sum()), int((every > 0).sum()), int(sums[FIT].sum()), int((sums[FIT] > 0).sum())))
        return pd.DataFrame(out, columns=["slice", "kind", "gram", "bucket", "counts", "fitted", "tokens", "types", "fit_tokens", "fit_types"]).astype({c: "Int64" for c in ("tokens", "types", "fit_tokens", "fit_types")})

    schema = "slice long, kind int, gram int, bucket int, counts binary, fitted binary, tokens long, types long, fit_tokens long, fit_types long"
    return asked.groupBy("bucket", "gram").applyInPandas(answer, schema)


def part_requests(asked: DataFrame, wide: int, bits: int) -> DataFrame:
    """Requests of whole parts: per part, kind and gram the distinct keys and summed counts of its slices, cut into the buckets of
    ``bits``. Rows are like ``asked``'s, with the part in place of the slice."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        part, near, gram, out = int(group.part.iloc[0]), int(group.bucket.iloc[0]), int(group.gram.iloc[0]), []
        for kind, own in group.groupby("kind"):
            keys, sums = _summed(own.blob)
            at = _cut(keys, bits)
            for b in range(near << (bits - wide), (near + 1) << (bits - wide)):
                if at[b + 1] > at[b]:
                    out.append((b, part, int(kind), gram, _keys_out(keys[at[b] : at[b + 1]], sums[at[b] : at[b + 1]])))
        return pd.DataFrame(out, columns=["bucket", "slice", "kind", "gram", "blob"])

    return asked.groupBy("part", "bucket", "gram").applyInPandas(merge, "bucket int, slice long, kind int, gram int, blob binary")


def _summed(blobs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of requests in order, and their counts added up."""
    sent = [_keys_in(b) for b in blobs]
    keys, place = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in sent]).astype(np.float64), len(keys)).astype(np.int64)


def slice_answers(asked: DataFrame, back: DataFrame, wide: int, bits: int) -> DataFrame:
    """The answers to parts, ``back``, handed on to each slice in the order of its own request; rows of slice -1 stay."""

    def hand_on(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, own in left.groupby("kind"):
            keys, _ = _summed(own.blob)
            came = right[right.kind == kind].sort_values("bucket")
            every = np.concatenate([_counts_in(b) for b in came.counts])
            fitted = np.concatenate([_counts_in(b) for b in came.fitted]) if kind == HELD else None
            for number, near, gram, blob in zip(own.slice, own.bucket, own.gram, own.blob, strict=True):
                at = np.searchsorted(keys, _keys_in(blob)[0])
                out.append((number, kind, gram, near, _counts_out(every[at]), None if fitted is None else _counts_out(fitted[at])))
        return pd.DataFrame(out, columns=["slice", "kind", "gram", "bucket", "counts", "fitted"])

    came = back.where("slice <> -1").select(F.col("slice").alias("part"), F.shiftright("bucket", bits - wide).alias("near"), "gram", "kind", "bucket", "counts", "fitted")
    met = asked.groupBy("part", "bucket", "gram").cogroup(came.groupBy("part", "near", "gram"))
    handed = met.applyInPandas(hand_on, "slice long, kind int, gram int, bucket int, counts binary, fitted binary")
    return handed.unionByName(back.where("slice = -1"), allowMissingColumns=True)


def levels(total: int, count: int) -> list[int]:
    """How finely hash ranges are cut, in bits, at each level from slices up; ``count`` slices of ``total`` bytes. FAN units of a level meet in
    ranges that hold about BUCKET bytes of theirs, so a blob has about BUCKET / FAN bytes at every level and size."""
    bits, out, span = (total // BUCKET).bit_length(), [], FAN
    while count > FAN:
        out.append(min(bits, (span * SLICE // BUCKET).bit_length()))
        count, span = -(-count // FAN), span * FAN
    return [*out, bits]


def exchanged(packed: DataFrame) -> DataFrame:
    """The answers to all slices, written: in one step up to FAN slices, by way of parts, and of parts of parts, beyond."""
    total, count = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    cuts, asked = levels(total, count), []
    rows = requests(packed, cuts[0])
    for lower, upper in zip(cuts, cuts[1:], strict=False):
        count = -(-count // FAN)
        asked.append(written(rows.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(count))), "lm-requests"))
        rows = part_requests(asked[-1], lower, upper)
    back = written(answers(rows), "lm-answers")
    for i in reversed(range(len(asked))):
        back = written(slice_answers(asked[i], back, cuts[i], cuts[i + 1]), "lm-answers")
    return back


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(CONTEXTS - 1, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)), 0)


class Scored:
    """A slice's tokens with their counts: c of the word, of its context and of both."""

    def __init__(self, blob: bytes, back: pd.DataFrame, column: str):
        self.tokens = Tokens(blob)
        (words, word_at, _), (_, pair_at, _) = self.tokens.grams()
        by_gram = [np.concatenate([_counts_in(b) for b in back[back.gram == g].sort_values("bucket")[column]]) for g in (0, 1)]
        self.word, self.pair = by_gram[0][word_at], by_gram[1][pair_at]
        self.context = np.concatenate([[by_gram[0][np.searchsorted(words, np.uint64(_END))]], self.word[:-1]])


def _cells(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.floor(_STEPS * np.maximum(np.log2(np.maximum(values, 1e-300)), _LEAST)).astype(np.int64), -(10**6))


def learn_weights(packed: DataFrame, back: DataFrame, tokens: int, types: int, rounds: int = 60) -> np.ndarray:
    """CONTEXTS x 3 mixture weights by expectation-maximisation on the held-out tokens.

    Tasks count the events in cells of equal context bucket and nearly equal estimates; the driver gets the cells' counts
    and means, at most CONTEXTS * (_STEPS * -_LEAST + 2) ** 2 of them, and iterates over these.
    """

    def events(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"context": [], "b": [], "u": [], "n": [], "pb": [], "pu": []})
        s = Scored(left.blob.iloc[0], right, "fitted")
        two, one = s.pair / np.maximum(s.context, 1), s.word / max(tokens, 1)
        rows = pd.DataFrame({"context": context_bucket(s.context), "b": _cells(two), "u": _cells(one), "n": 1, "pb": two, "pu": one})
        return rows.groupby(["context", "b", "u"], as_index=False).sum()

    held = packed.where(F.col("kind") == HELD).select("slice", "blob").groupBy("slice").cogroup(back.where(F.col("kind") == HELD).groupBy("slice"))
    cells = held.applyInPandas(events, "context long, b long, u long, n long, pb double, pu double").groupBy("context", "b", "u").agg(F.sum("n").alias("n"), F.sum("pb").alias("pb"), F.sum("pu").alias("pu")).toPandas()
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # a context that was never seen has no bigram estimate
    for context, rows in cells.groupby("context"):
        n = rows.n.to_numpy(float)
        p = np.stack([rows.pb / n, rows.pu / n, np.full(len(n), 1 / (types + 1))], axis=1)
        w = weights[int(context)].copy()
        for _ in range(rounds):
            share = p * w
            w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            w[2] = max(w[2], 1e-6)  # unseen words keep some probability
        weights[int(context)] = w / w.sum()
    return weights


def score_documents(docs: DataFrame, trained, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, kind, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    packed = written(slices(docs, trained, held, id_col, text_col), "lm-slices", compression="uncompressed")
    back = exchanged(packed)
    sums = back.where("slice = -1").agg(F.sum("tokens"), F.sum("types"), F.sum("fit_tokens"), F.sum("fit_types")).first()
    tokens, types, fit_tokens, fit_types = (x or 0 for x in sums)
    weights = learn_weights(packed, back, fit_tokens, fit_types)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"doc_id": [], "kind": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        s = Scored(left.blob.iloc[0], right, "counts")
        w = weights[context_bucket(s.context)]
        mixed = w[:, 0] * s.pair / np.maximum(s.context, 1) + w[:, 1] * s.word / max(tokens, 1) + w[:, 2] / (types + 1)
        base = np.log10((s.word + 1) / (tokens + types + 1))
        starts = np.concatenate([[0], s.tokens.ends[:-1]])
        return pd.DataFrame({
            "doc_id": s.tokens.doc_id.to_pandas(types_mapper=pd.ArrowDtype), "kind": int(left.kind.iloc[0]), "n_tokens": np.diff(s.tokens.ends, prepend=0),
            "n_known": np.add.reduceat((s.word > 0).astype(np.int64), starts), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(mixed), starts),
        })

    met = packed.select("slice", "kind", "blob").groupBy("slice").cogroup(back.where("slice <> -1").select("slice", "gram", "bucket", "counts").groupBy("slice"))
    scored = met.applyInPandas(score, "doc_id long, kind int, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def corpus_scores(docs: DataFrame, modulus: int = 7, test: int = 2, held: int = 3) -> DataFrame:
    """Scores of all documents; those in fold ``test`` aren't learned from, those in fold ``held`` fit the weights."""
    part = fold(F.col("doc_id"), modulus)
    scored = score_documents(docs, part != test, part == held)
    return scored.select("doc_id", (F.col("kind") == OTHER).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
