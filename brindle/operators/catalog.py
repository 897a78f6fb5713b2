"""Catalogue and presentation of files and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import glob_pattern


def list_files(chunks: DataFrame, org: str | None = None, glob: str | None = None) -> DataFrame:
    """Distinct paths of a store in order, those that match ``glob`` whole."""
    rows = chunks if org is None else chunks.where(F.col("org_id") == org)
    paths = rows.select("path").where("path IS NOT NULL").distinct()
    return (paths if glob is None else paths.where(F.col("path").rlike(glob_pattern(glob)))).orderBy("path")


def read_files(chunks: DataFrame) -> DataFrame:
    """(path, text): the chunks of each file in order, joined by line feeds."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"))


def store_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("org_id").agg(F.count("*").alias("doc_count"))


def file_tree(paths: DataFrame, contains: str = "") -> DataFrame:
    """(parent, name, type, depth): each folder and file once, of the paths that contain a substring whatever its case."""
    kept = paths.where(F.contains(F.lower("path"), F.lit(contains.lower()))).select(F.filter(F.split("path", "/"), lambda p: p != "").alias("parts"))
    nodes = kept.select("parts", F.posexplode("parts").alias("at", "name"))
    parent = F.array_join(F.slice("parts", F.lit(1), F.col("at")), "/")
    kind = F.when(F.col("at") + 1 < F.size("parts"), "folder").otherwise("file")
    return nodes.select(parent.alias("parent"), "name", kind.alias("type"), (F.col("at") + 1).cast("long").alias("depth")).distinct()


def expanded(paths: DataFrame, contains: str = "") -> DataFrame:
    """(path): every folder that is open when all are expanded, of the paths that contain a substring whatever its case."""
    folders = file_tree(paths, contains).where("type = 'folder'")
    return folders.select(F.concat_ws("/", F.nullif("parent", F.lit("")), "name").alias("path"))


def group_settings(settings: DataFrame, contains: str = "") -> DataFrame:
    """(category, keys): sorted keys by what precedes their first full stop."""
    kept = settings.where(F.contains("key", F.lit(contains)))
    return kept.groupBy(F.substring_index("key", ".", 1).alias("category")).agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("keys"))


def preview(text: Column, chars: int = 50_000, lines: int = 2000) -> Column:
    """Large files by their first lines."""
    parts = F.split(text, "\n", -1)
    return F.when((F.length(text) > chars) & (F.size(parts) - 1 > lines), F.array_join(F.slice(parts, 1, lines), "\n")).otherwise(text)


def grep_line(path: Column, index: Column, text: Column, score: Column) -> Column:
    head = F.substring(F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), 1, 200)
    return F.concat(path, F.lit(":"), index.cast("string"), F.lit(": "), head, F.lit(" ("), F.format_string("%.3f", score), F.lit(")"))


def first_lines(text: Column, n: int = 3) -> Column:
    return F.array_join(F.transform(F.slice(F.split(text, "\n", -1), 1, n), lambda x: F.trim(x)), "\n")
