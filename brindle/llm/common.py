"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_path, spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")  # the same class: \s is ASCII white space here


#: Odd multipliers of a byte's place in a piece.
_WEIGHTS = np.random.default_rng(0).integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_hashes(pieces: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit number of each piece; different pieces may share it."""
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _WEIGHTS[place & 1023], out=sums[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


class PieceMemo:
    """Numbers of text pieces (token ids, say); pieces that aren't known are resolved in one call, which gives all their numbers, one
    piece after the other, and how many each has. Of more than ``size`` pieces, or 64 bytes for each of them, the half that was met last stays.

    Known pieces are found by sorted hashes and compared; one that shares its hash with another may be resolved again.
    """

    def __init__(self, resolve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], size: int = 300_000):
        self.resolve, self.size, self.clock = resolve, size, 0
        self.known, self.ids = pa.array([], pa.large_string()), np.empty(0, np.int32)
        self.starts, self.sizes, self.met = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)  # in the order of hashes

    def _find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each piece among the known ones, or -1."""
        place = np.full(len(pieces), -1)
        at = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(at < len(self.hashes))
        hit = hit[self.hashes[at[hit]] == hashes[hit]]
        found = self.places[at[hit]]
        same = pc.equal(self.known.take(pa.array(found)), pieces.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        place[hit[same]] = found[same]
        return place

    def _values(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct pieces: all numbers, where each piece's begin, and how many it has."""
        hashes = piece_hashes(pieces)
        place = self._find(pieces, hashes)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = pieces.take(pa.array(fresh))
            ids, sizes = self.resolve(new.to_pylist())
            place[fresh] = len(self.known) + np.arange(len(fresh))
            order = fresh[np.argsort(hashes[fresh])]
            at = np.searchsorted(self.hashes, hashes[order])
            self.hashes, self.places = np.insert(self.hashes, at, hashes[order]), np.insert(self.places, at, place[order])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.known, self.ids, self.sizes = pa.concat_arrays([self.known, new]), np.concatenate([self.ids, ids]), np.append(self.sizes, sizes.astype(np.int32))
            self.met = np.append(self.met, np.zeros(len(fresh), np.int32))
        self.clock += 1
        self.met[place] = self.clock
        found = self.ids, self.starts[place], self.sizes[place]
        if len(self.known) > self.size or self.known.nbytes + self.ids.nbytes > 64 * self.size:
            self._forget()
        return found

    def _forget(self) -> None:
        kept = np.argsort(-self.met, kind="stable")[: self.size // 2]
        weight = 8 + pc.binary_length(self.known).to_numpy() + 4 * self.sizes
        kept = np.sort(kept[np.cumsum(weight[kept]) <= 32 * self.size])
        now = np.full(len(self.known), -1, np.int32)
        now[kept] = np.arange(len(kept))
        self.ids, ends = pick_lists(self.ids, self.starts[kept], self.sizes[kept])
        self.known, self.starts, self.sizes, self.met = self.known.take(pa.array(kept)), ends[:-1], self.sizes[kept], self.met[kept]
        places = now[self.places]
        self.hashes, self.places = self.hashes[places >= 0], places[places >= 0]

    def lists(self, texts: list[str], separator: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts one after the other, and where each text's begin; pieces stand between separators."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), pattern=separator)
        out, ends = self.numbers(pieces.values)
        return out, ends[pieces.offsets.to_numpy()]

    def numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces one after the other, and where each piece's begin, and the end."""
        coded = pieces.dictionary_encode()
        ids, starts, sizes = self._values(coded.dictionary)
        at = coded.indices.to_numpy()
        return pick_lists(ids, starts[at], sizes[at])


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches whose worker hands freed memory back to the system at the end, as it stays idle beside what follows."""

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
            libc.malloc_trim(0)

    return run


def text_slices(batch: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of about ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, end - at
        at = end


def pick_lists(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` from ``starts`` on, one after the other, and where each begins, and the end."""
    ends = np.append(0, np.cumsum(sizes))
    return values[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
