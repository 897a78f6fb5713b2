"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest run that isn't in the dictionary
yet, and enters it. The set of phrases is hashed and kept as a one-permutation minimum-hash signature: of the hashes
in each of SLOTS equal ranges the smallest, by its last 16 bits. The share of equal slots estimates the sets' Jaccard
similarity, and so how well one text would compress the other.

The query pairs every document with the next one by id. Documents are range-partitioned and sorted by id, a task
streams over its documents, and only the last document of a partition waits for the first of the next one, which is
found in a second pass over these edges alone.

Defined cases: a null text counts as empty; an empty text has no phrase, is alike only to empty texts (1) and to no
other (0). Rows that share an id stand in the order of their text's hash; a null id stands before all others; a single
document is its own successor. Texts of any length are parsed in one pass. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import text_slices, written

SLOTS = 128
_EDGES = (np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.uint64)


def parse(data: bytes, seen: set[bytes], start: int, at: int, end: int) -> int:
    """Add the phrases of ``data[at:end]`` to ``seen``; the open phrase began at ``start``. Returns where the open one begins."""
    add = seen.add
    for stop in range(at + 1, end + 1):
        phrase = data[start:stop]
        if phrase not in seen:
            add(phrase)
            start = stop
    return start


def signature(phrases: set[bytes]) -> np.ndarray:
    """SLOTS 16-bit values, 0 for an empty slot."""
    out = np.zeros(SLOTS, np.uint16)
    if phrases:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, phrases), np.uint64, len(phrases))
        hashes.sort()
        at = np.searchsorted(hashes, _EDGES)
        filled = at < np.append(at[1:], len(hashes))
        out[filled] = np.maximum(hashes[at[filled]] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum() / used) if used else 1.0


def fingerprint(text: str | None) -> np.ndarray:
    phrases: set[bytes] = set()
    data = (text or "").encode()
    parse(data, phrases, 0, 0, len(data))
    return signature(phrases)


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of the text and of its edited form, which share the parse of what is kept, and the edited form."""
    kept, other, phrases = text[: len(text) - len(text) // 2].encode(), edited(text, following), set()
    data, changed = text.encode(), other.encode()
    start = parse(data, phrases, 0, 0, len(kept))
    fork = set(phrases)
    parse(data, phrases, start, len(kept), len(data))
    parse(changed, fork, start, len(kept), len(changed))
    return signature(phrases), signature(fork), other


_OUT = "part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, first boolean, text string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]


def _row(part, doc_id, text, following, following_print, first, edge):
    own, changed, other = both(text, following)
    near = None if following_print is None else likeness(own, following_print)
    return own, [part, doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), own.tobytes(), changed.tobytes(), likeness(own, changed), near, first, edge]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition. The first and last keep their texts; the last has no likeness to a next one (null)."""
    held, rows, first = None, [], True
    for whole in batches:
        for at, n in text_slices(whole.column(2)):
            for part, doc_id, text in zip(*(c.to_pylist() for c in whole.slice(at, n).columns), strict=True):
                text = text or ""
                if held is not None:
                    own, row = _row(*held, text, None, first, held[2] if first else None)
                    if rows:  # the row before waits for this one's fingerprint
                        rows[-1][7] = likeness(np.frombuffer(rows[-1][4], np.uint16), own)
                    rows.append(row)
                    first = False
                held = (part, doc_id, text)
            if len(rows) > 1:
                yield _batch(rows[:-1])
                rows = rows[-1:]
    if held is not None:
        own, row = _row(*held, "", None, first, held[2])
        if rows:
            rows[-1][7] = likeness(np.frombuffer(rows[-1][4], np.uint16), own)
        yield _batch([*rows, row])


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (c.to_pylist() for c in batch.columns)
        rows = [_row(part, doc_id, text, following, np.frombuffer(print_, np.uint16), False, None)[1] for part, doc_id, text, following, print_ in zip(*columns, strict=True)]
        if rows:
            yield _batch(rows)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprints (binary) of the text and its edited form, near_edited and near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    parts = written(placed.mapInArrow(_stream, _OUT), "lz-parts")
    firsts = parts.where("first").select(F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("following_print"))
    # parts that hold documents, few of them, each with its successor, the last with the first of all
    by_part = Window.orderBy("next_part")
    follows = firsts.select("next_part").withColumn("part", F.lag("next_part").over(by_part))
    ends = firsts.agg(F.min("next_part").alias("next_part"), F.max("next_part").alias("part")).where("part IS NOT NULL")
    follows = follows.where("part IS NOT NULL").unionByName(ends)
    lasts = parts.where("near_next IS NULL").select("part", "doc_id", "text")
    joined = lasts.join(follows, "part").join(firsts, "next_part").select("part", "doc_id", "text", "following", "following_print")
    return parts.where("near_next IS NOT NULL").unionByName(joined.mapInArrow(_join_edges, _OUT)).drop("part", "first", "text")
