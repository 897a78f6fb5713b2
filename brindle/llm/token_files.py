"""Token ids in Parquet list columns, for selective reads.

Documents are range-partitioned and sorted by id, encoded, closed with an end id and written as Parquet: a list
column of 32-bit ids (dictionary pages, or delta pages where ``encoding`` is "delta"), row groups of a set size, and
page indexes, which Parquet's writer puts into every file. A reader takes token columns or only metadata columns, and
skips row groups and pages by doc_id. Each row also carries the number of its partition and its place in it, so global
offsets follow from a sum per partition and a running sum within it; no task sees all rows.

Defined cases: a null text counts as empty and holds the end id only; a null id sorts before all others; rows that share
an id are ordered by their text's hash, and ``place`` tells the order in a file; texts of any length are cut where the pre-tokenizer cuts; an empty table
gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import PieceMemo, id_lists, pick_lists, shared_path, text_slices

END_ID = 0
#: Bytes of a row group and rows of a page.
ROW_GROUP, PAGE_ROWS = 16 << 20, 512
#: Bytes of text that a task encodes at a time.
SLICE = 4 << 20
SCHEMA = "part int, place long, doc_id long, n_tokens long, token_ids array<int>"
#: Pieces that a task remembers, and that the library encodes as one text.
MEMO, JOINED = 1_000_000, 512
#: Kinds of bytes. Vague ones may be white space (a character's first bytes, or controls), opaque ones are anything else.
_VAGUE, _SPACE, _OPAQUE, _LETTER, _DIGIT, _SYMBOL = range(6)
_KINDS = np.full(256, _SYMBOL, np.uint8)
_KINDS[0x80:] = _OPAQUE
_KINDS[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = _VAGUE
_KINDS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KINDS[list(b"0123456789")] = _DIGIT
#: Pieces that the pre-tokenizer surely leaves whole, and the characters that stand for bytes in the vocabulary.
_WHOLE = re.compile(r" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[0-9]+|[!-/:-@\[-`{-~]+)")
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_AS_CHARACTERS = {byte: 0x100 + n for n, byte in enumerate(_HIDDEN)}
_IN_WHOLE = frozenset(chr(_AS_CHARACTERS.get(byte, byte)) for byte in (*b" \n", *range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3))


def _byte_kinds(data: np.ndarray) -> np.ndarray:
    kinds = _KINDS[data]
    if data.max(initial=0) < 0x80:
        return kinds
    at = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF: letters but for two
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kinds[at] = kinds[at + 1] = _LETTER
    at = np.flatnonzero((kinds == _VAGUE) & (data >= 0x80))
    first, second, third = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    spaces = (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & ((second == 0x9A) | (second == 0xA0))
    spaces |= (first == 0xE2) & ((second == 0x80) & ((third < 0x8C) | (third > 0xA7)) | (second == 0x81)) | (first == 0xE3) & (second == 0x80)
    kinds[at[~spaces]] = _OPAQUE
    return kinds


def cut_pieces(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pieces of all texts, one after the other and without nulls, and where each text's begin."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds, kinds, cut = bounds - bounds[0], _byte_kinds(data), np.zeros(len(data) + 1, bool)
    left, right = kinds[:-1], kinds[1:]
    cut[1:-1] = (left != right) & (left >= _LETTER) & (right >= _LETTER) & (data[:-1] != ord("'"))
    space = np.flatnonzero((left == _SPACE) & (right >= _OPAQUE))
    cut[space] = True
    cut[space[data[space] != ord(" ")] + 1] = True
    last = bounds[1:][np.diff(bounds) > 0] - 1
    cut[last[kinds[last] == _SPACE]] = False  # what follows is another text
    cut[bounds] = True
    places = np.flatnonzero(cut)
    pieces = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
    return pieces, np.searchsorted(places, bounds)


class PieceEncoder:
    """Token ids by a byte-level tokenizer of the tokenizers library, which remembers pieces.

    The pre-tokenizer always cuts before white space that something else follows, after it unless it is a blank, and where
    letters, digits and other characters meet, but for what an apostrophe begins; what follows doesn't depend on what stands
    before. Cuts are made where bytes tell these apart. The library encodes pieces that aren't remembered in batches, those that
    the pre-tokenizer leaves whole by its model alone, and texts that hold added tokens, which go before the pre-tokenizer, as a whole.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = PieceMemo(self._pieces, MEMO)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that start with a blank
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.line_feed = self.tokenizer.token_to_id("Ċ")
        model = self.tokenizer.model
        whole = isinstance(model, BPE) and not (model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix or self.tokenizer.normalizer)
        crossing = any(("Ġ" in token.lstrip("Ġ") or "Ċ" in token and token.strip("Ċ")) and _IN_WHOLE.issuperset(token) for token in self.tokenizer.get_vocab())
        self.merger = Tokenizer(model) if whole and not crossing else None  # no merge joins pieces that follow each other
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, keys: list[str], glue: str, whole: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers of pieces encoded as one text: they start with a blank, or line feeds tell them apart."""
        text = glue.join(keys)
        if whole:
            ids = np.array(self.merger.encode_batch_fast([text.encode().decode("latin-1").translate(_AS_CHARACTERS)], add_special_tokens=False)[0].ids, np.int32)
        else:
            ids = self._library([text])[0]
        if glue:
            marks = ids == self.line_feed
            sizes, ids = np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1, ids[~marks]
        else:
            sizes = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
        return None if len(sizes) != len(keys) or any(a in text for a in self.added) else (ids, sizes)

    def _pieces(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, those of one word many at a time."""
        joined, others = {(glue, whole): [] for glue in ("", "\n") for whole in (True, False)}, []
        for i, k in enumerate(keys):
            whole = self.merger is not None and _WHOLE.fullmatch(k) is not None
            if whole or k.split() == [k[k[:1] == " " :]]:
                joined["" if k[0] == " " else "\n", whole].append(i)
            else:
                others.append(i)
        order, found, counts = [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for (glue, whole), some in joined.items():
            for at in range(0, len(some), JOINED):
                part = some[at : at + JOINED]
                if got := self._joined([keys[i] for i in part], glue, whole):
                    order += part
                    found.append(got[0])
                    counts.append(got[1])
                else:
                    others += part
        each = self._library([keys[i] for i in others])
        ids, sizes = np.concatenate([*found, *each]), np.concatenate([*counts, np.array(list(map(len, each)), np.int64)])
        place = np.argsort(np.array(order + others, np.int64))
        return pick_lists(ids, (np.cumsum(sizes) - sizes)[place], sizes[place])[0], sizes[place]

    def encode_all(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin; a null text counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column, odd = pc.fill_null(column.cast(pa.large_string()), ""), {}
        for content in self.added:
            odd |= dict.fromkeys(np.flatnonzero(pc.match_substring(column, content).to_numpy(zero_copy_only=False)).tolist())
        for i in odd:
            odd[i] = self._library([column[i].as_py()])[0]
        if odd:
            whole = np.zeros(len(column), bool)
            whole[list(odd)] = True
            column = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column)
        pieces, begins = cut_pieces(column)
        ids, ends = self.memo.numbers(pieces)
        offsets = ends[begins]
        if odd:
            each = [odd[i] if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]  # noqa: B905
            ids, offsets = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return ids, offsets


@lru_cache(maxsize=1)
def _encoder(spec: str) -> PieceEncoder:
    return PieceEncoder(spec)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, encoding: str = "dictionary", row_group: int = ROW_GROUP, page_rows: int = PAGE_ROWS) -> None:
    """Encode every text and write (part, place, doc_id, n_tokens, token_ids) to ``path``, each file in ascending doc_id order, place by place."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = _encoder(spec.value), 0
        for whole in batches:
            for at, n in text_slices(whole.column(2), SLICE):
                batch = whole.slice(at, n)
                ids, starts = encoder.encode_all(batch.column(2))
                lists = id_lists(np.insert(ids, starts[1:], end_id), starts + np.arange(n + 1))
                lengths = pa.array(np.diff(starts) + 1, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(place, place + n), pa.int64()), batch.column(1), lengths, lists], ["part", "place", "doc_id", "n_tokens", "token_ids"])
                place += n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    options = {"compression": "zstd", "parquet.block.size": row_group, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v2" if encoding == "delta" else "v1"}
    placed.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def offsets(files: DataFrame) -> DataFrame:
    """The columns of ``files``, and start: the number of ids in all documents before.

    Parts are few and summed first; only metadata columns are read for it.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = parts.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(before, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("base")


def checksums(files: DataFrame) -> DataFrame:
    """part, place, doc_id, n_tokens and token_crc32: the unsigned crc32 of the ids as little-endian 32-bit integers."""

    @F.arrow_udf("long")
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values, ends = np.asarray(lists.flatten()).astype("<u4"), np.append(0, np.cumsum(pc.list_value_length(lists))).tolist()
            raw = memoryview(values.tobytes())
            yield pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64())  # noqa: B905

    return files.select("part", "place", "doc_id", "n_tokens", crc("token_ids").alias("token_crc32"))


def token_file_digest(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Write the files, read them back, and return doc_id, start, n_tokens and ids_crc32 per document."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, **options)
    placed = offsets(checksums(read_tokens(docs.sparkSession, path)))
    return placed.select("doc_id", "start", "n_tokens", F.col("token_crc32").alias("ids_crc32"))
