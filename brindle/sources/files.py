"""Files as DataFrames: listing, ignore rules, hashing, change detection, parsing and languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import basename

#: File endings and their languages for code-aware chunking.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cc": "cpp",
    ".c": "c",
    ".h": "c",
    ".rb": "ruby",
    ".php": "php",
}
#: File endings and their languages for the viewer.
VIEWER_LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "cpp": "cpp",
    "c": "c",
    "h": "c",
    "json": "json",
    "md": "markdown",
    "yaml": "yaml",
    "yml": "yaml",
    "html": "html",
    "css": "css",
}
#: Patterns that are ignored everywhere.
DEFAULT_IGNORES = [
    ".git/",
    ".git",
    "node_modules/",
    "__pycache__/",
    "*.pyc",
    ".venv/",
    "venv/",
    ".env",
    "dist/",
    "build/",
    ".next/",
    "target/",
    ".idea/",
    ".vscode/",
    "*.egg-info/",
    ".pytest_cache/",
    ".mypy_cache/",
    "*.log",
    ".DS_Store",
]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: path, org_id, language and text beside doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), F.col("source").alias("org_id"), F.col("lang").alias("language"), "text", "n_chars")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All regular files below a folder, hidden ones too, without .git: path relative to it, size, time and bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), "modificationTime", "content").where(~F.col("path").rlike(r"(^|/)\.git/"))


def ignore_rule(line: str) -> tuple[bool, str] | None:
    """(keeps, pattern) of a line of an ignore file; None for blank lines and comments. A backslash takes a leading # or ! and a trailing blank as they are."""
    text = re.sub(r"(?<!\\)[ \t\r\n]+$", "", line)
    if not text.strip() or text.startswith("#"):
        return None
    keeps = text.startswith("!")
    pattern = text[1:] if keeps else text
    return (keeps, pattern) if pattern.strip("/") else None


def _glob_part(part: str) -> str:
    """A path component as a regular expression: * and ?, [classes] with ! or ^, and escapes; an open bracket is itself."""
    out, i = "", 0
    while i < len(part):
        c = part[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(part):
            out += re.escape(part[i])
            i += 1
        elif c == "[" and (end := part.find("]", i + 1 + (part[i : i + 1] in ("!", "^")))) > 0:
            inner = part[i:end]
            negated = inner[0] in "!^"
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", inner[negated:])
            out += f"[^/{body}]" if negated else f"[{body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def _ignore_body(pattern: str) -> tuple[str, bool, bool]:
    """(expression, whether it is tied to the top, whether it is for folders only) of a pattern."""
    body, folder = pattern.rstrip("/"), pattern.endswith("/")
    rooted, body = "/" in body, body.lstrip("/")
    parts, out = body.split("/"), ""
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += _glob_part(part) + ("" if last else "/")
    return out, rooted, folder


def ignore_expression(pattern: str) -> str:
    """A pattern, without leading !, as a regular expression over relative paths, which also matches what lies below."""
    out, rooted, folder = _ignore_body(pattern)
    return ("^" if rooted else "(^|/)") + out + ("/" if folder else "(/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last of the rules that matches a path ignores it; blank lines and comments don't count."""
    out = F.lit(False)
    for keeps, pattern in filter(None, map(ignore_rule, rules)):
        out = F.when(path.rlike(ignore_expression(pattern)), F.lit(not keeps)).otherwise(out)
    return out


#: Ignore files of a folder, the strongest last; further ones are a parameter.
IGNORE_FILES = (".gitignore", ".ignore")


def nested_rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(folder, strength, line, keeps, expression) of all ignore files among ``files`` (path, content): one row per rule, its expression being
    for paths relative to the file's folder, folders ending with a slash."""

    @F.pandas_udf("array<struct<line: int, keeps: boolean, expression: string>>")
    def parsed(contents: pd.Series) -> pd.Series:
        def rules(content) -> list[dict]:
            out = []
            for n, line in enumerate((bytes(content) if content is not None else b"").decode("utf-8", "replace").splitlines()):
                if rule := ignore_rule(line):
                    body, rooted, folder = _ignore_body(rule[1])
                    out.append({"line": n, "keeps": rule[0], "expression": f"^(?:{'' if rooted else '(?:.*/)?'}{body}{'/' if folder else '/?'})$"})
            return out

        return contents.map(rules)

    strength = F.array_position(F.array(*map(F.lit, names)), basename(F.col("path"))).cast("int")
    found = files.where(basename(F.col("path")).isin(*names)).select(F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder"), strength.alias("strength"), F.explode(parsed(F.col("content").cast("binary"))).alias("r"))
    return found.select("folder", "strength", "r.line", "r.keeps", "r.expression")


def _beginnings(path: Column) -> Column:
    """A path's folders from the top, each ending with a slash, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n < F.size(parts), "/").otherwise("")))


def not_ignored(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES, rules: DataFrame | None = None) -> DataFrame:
    """The files that a walk from the top meets: every folder's ignore files count below it. Of the rules that match a folder or file those of the
    stronger ignore file decide, then those of the deepest folder, then the last; below an ignored folder nothing is kept.

    Each folder is decided once, however many files it holds: distinct folders and files meet the rules of the folders above them by name.
    """
    rules = nested_rules(files, names) if rules is None else rules
    steps = files.select("path", F.explode(_beginnings(F.col("path"))).alias("step"))
    each = steps.select("step").distinct()
    above = F.concat(F.array(F.lit("")), F.filter(_beginnings(F.rtrim("step", F.lit("/"))), lambda s: F.endswith(s, F.lit("/"))))
    met = each.select("step", F.explode(above).alias("folder")).join(rules, "folder")
    met = met.where(F.col("folder") != F.col("step")).where(F.rlike(F.substring(F.col("step"), F.length("folder") + 1, F.length("step")), F.col("expression")))
    decided = met.groupBy("step").agg(F.max_by("keeps", F.struct("strength", F.length("folder"), "line")).alias("keeps"))
    gone = steps.join(decided.where(~F.col("keeps")), "step").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def is_text(content: Column) -> Column:
    """Whether the first 1024 bytes are UTF-8, but for up to three at their end where a character may be cut; null content isn't."""
    data = content.cast("binary")
    valid = lambda n: F.is_valid_utf8(F.substring(data, 1, n).cast("string"))
    cut = (F.octet_length(data) > 1024) & (valid(1023) | valid(1022) | valid(1021))
    return F.coalesce(valid(1024) | cut, F.lit(False))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose (path, hash) the snapshot ``before`` lacks."""
    return now.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


def language(path: Column) -> Column:
    """Language by ending, whatever its case; null where it isn't known."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending)


def viewer_language(path: Column) -> Column:
    """The viewer's language, from what follows the last full stop of the whole path; text by default."""
    ending = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VIEWER_LANGUAGES.items() for x in pair]), ending), F.lit("text"))


def strip_tags(html: Column) -> Column:
    """Markup to blanks, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \t\r\n\f\x0b]+", " "))


class _Elements(HTMLParser):
    """Text of block elements, without scripts and styles."""

    BLOCKS = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "title", "pre", "article", "section", "tr", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements, self.parts, self.hidden = [], [], 0

    def _close(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.elements.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self._close()

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self._close()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def html_elements(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The texts of a page's elements, two line feeds between them."""

    def parse(html):
        if html is None:
            return None
        reader = _Elements()
        reader.feed(html)
        reader._close()
        return "\n\n".join(reader.elements)

    for pages in batches:
        yield pages.map(parse)


def parse(files: DataFrame) -> DataFrame:
    """``text`` and ``status`` from path and content: HTML by its elements, else UTF-8 as it is, else an error status."""
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    is_html = F.lower("path").rlike(r"\.html?$")
    text = F.when(is_html & plain.isNotNull(), html_elements(plain)).otherwise(plain)
    return files.withColumn("text", text).withColumn("status", F.when(F.col("text").isNull(), "error").when(F.col("text") == "", "skipped").otherwise("success"))


def url_path(url: Column) -> Column:
    """What follows the host in a URL."""
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")


__all__ = ["basename", "changed", "content_hash", "corpus", "html_elements", "ignored", "is_text", "language", "nested_rules", "not_ignored", "parse", "scan", "strip_tags", "url_path", "viewer_language"]
