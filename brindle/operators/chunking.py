"""Chunks: code blocks, recursive text splitting, fixed strides, enhancement and ids."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import basename
from brindle.operators import blocks

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK = "content string, chunk_type string, symbols array<string>, start_line int, end_line int, node_type string"


def code_blocks(text: str | None, language: str | None) -> list[tuple]:
    """Classes, functions and methods, outer before inner and overlapping; one module chunk where there are none."""
    if not text:
        return []
    return (blocks.scan(text, language) if language in blocks.LANGUAGES else []) or [(text, "module", [], 1, len(text.split("\n")), "module")]


def ast_chunks(files: DataFrame) -> DataFrame:
    """Rows of CHUNK, with chunk_index, for every file (path, language, text); one Arrow pass."""

    @F.pandas_udf(f"array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in CHUNK.split(', '))}>>")
    def found(text: pd.Series, language: pd.Series) -> pd.Series:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        return pd.Series([[dict(zip(names, b, strict=True)) for b in code_blocks(t, x)] for t, x in zip(text, language, strict=True)])

    rows = files.select("path", "language", F.posexplode(found("text", "language")).alias("chunk_index", "c"))
    return rows.select("path", "language", "chunk_index", "c.*")


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return [c for c in [*out, "".join(held).strip()] if c]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive splitting: cut at the coarsest separator that occurs, keep it in front of the next piece, split what is
    still too long at the next ones, and merge neighbours up to ``size`` with whole pieces of at most ``overlap`` repeated."""
    separator = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(separator) + 1 :] if separator in separators else ()
    if separator:
        first, *rest = text.split(separator)
        parts = [p for p in [first, *(separator + r for r in rest)] if p]
    else:
        parts = list(text)
    out, short = [], []
    for part in parts:
        if len(part) <= size:
            short.append(part)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + _merge(short, size, overlap)


def recursive_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(path, chunk_index, content) of every text."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return files.select("path", F.posexplode(split("text")).alias("chunk_index", "content"))


def fixed_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, path, chunk_index, content): windows of ``size`` characters, each ``size - overlap`` after the last."""
    last = F.greatest(F.length("text") - 1 - overlap, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    rows = files.where(F.length("text") > 0).select("doc_id", "path", "text", F.posexplode(starts).alias("chunk_index", "at"))
    return rows.select("doc_id", "path", F.col("chunk_index").cast("long").alias("chunk_index"), F.substring("text", F.col("at") + 1, F.lit(size)).alias("content"))


def enhanced(path: Column, content: Column) -> Column:
    """What the vector encoders see: file name and path before the content."""
    return F.concat(F.lit("File: "), basename(path), F.lit("\nPath: "), path, F.lit("\n\n"), content)



def ingest_status(text: Column, language: Column) -> Column:
    """skipped for empty texts, else the way of chunking: ast where the language is known, else fallback."""
    return F.when(F.coalesce(text, F.lit("")) == "", "skipped").when(language.isNotNull(), "ast").otherwise("fallback")
