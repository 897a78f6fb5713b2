"""Scalar expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the full-text analyser splits at, and its limit on a token's bytes.
TOKEN_GAP, TOKEN_BYTES = r"[^\p{L}\p{N}]+", 40


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits under TOKEN_BYTES bytes, in order; null gives an empty array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_GAP)
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) < TOKEN_BYTES))


def stable_bucket(term: Column, n: int) -> Column:
    """A term's bucket from its MD5: stable across processes and engines."""
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n))


def hash_uuid(key: Column) -> Column:
    """The first 32 hex digits of a SHA-256, in UUID form."""
    return F.regexp_replace(F.substring(F.sha2(key.cast("binary"), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_truthy(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a shell pattern whose * crosses slashes; [seq] and [!seq] as usual."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i:end].replace("\\", "\\\\")
            out += f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]"
            i = end + 1
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 else c
    return f"(?s)^{out}$"
