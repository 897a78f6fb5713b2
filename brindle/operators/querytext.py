"""The query language as a tree of clauses.

``words``, ``"phrases"~slop``, ``+`` and ``-``, ``NOT``, ``AND`` (which binds more tightly), ``OR``, parentheses, ``^boosts``, ``[a TO b]`` and ``{a TO b}`` ranges of
terms with ``*`` for an open end, ``IN [a b]`` sets, ``*`` for everything, and ``text:`` before any of these. A tree says which documents match by set
algebra, and what each clause adds to a score. Defined for any text: what isn't in the language is read as a bag of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import regex

from brindle.functions.text import TOKEN_BYTES, TOKEN_GAP

FIELD = "text"
_TOKEN = regex.compile(r'\s*(?:(?P<open>[()])|(?P<range>(?:IN\s*)?[\[{][^\]}\[{"]*[\]}])|(?P<mark>[+-](?=\S))|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d{1,6}))?|(?P<field>\w+):(?=\S)|(?P<boost>\^[0-9]+(?:\.[0-9]+)?)|(?P<word>[^\s"()^\[\]{}]+))')


class BadQuery(ValueError):
    """The text isn't in the language."""


@dataclass(frozen=True)
class Words:
    """Terms in this order with at most ``slop`` other words between them; a single one is a term."""

    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class Span:
    """Terms from ``low`` to ``high`` (None: open), bounds included or not."""

    low: str | None
    high: str | None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Every:
    """All documents."""


@dataclass(frozen=True)
class Boosted:
    node: object
    factor: float


@dataclass(frozen=True)
class Group:
    """Clauses (mark, node), mark being +, - or nothing: all + match, no - does, and without + one of the others has to."""

    clauses: tuple[tuple[str, object], ...]


Node = Words | Span | Every | Boosted | Group


def split(text: str) -> list[str]:
    """A text's terms, as the index has them."""
    return [t for t in regex.split(TOKEN_GAP, text.lower()) if t and len(t.encode()) < TOKEN_BYTES]


def bag(text: str) -> Node:
    return Group(tuple(("", Words((t,))) for t in split(text)))


def parse(text: str) -> Node:
    """The tree of a query; a bag of its words where it isn't in the language."""
    try:
        return _Reader(text).whole()
    except (BadQuery, RecursionError):
        return bag(text)


class _Reader:
    """Recursive descent over tokens."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise BadQuery(text)
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self, kind: str) -> str | None:
        return self.tokens[self.at][kind] if self.at < len(self.tokens) else None

    def take(self, kind: str) -> str:
        self.at += 1
        return self.tokens[self.at - 1][kind]

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise BadQuery("more than a query")
        return node

    def either(self) -> Node:
        """Clauses with OR, or nothing, between those that AND binds."""
        parts, any_or = [], False
        while self.at < len(self.tokens) and self.peek("open") != ")":
            if self.peek("word") == "OR":
                if not parts:
                    raise BadQuery("OR at the start")
                self.take("word")
                any_or = True
                if self.at >= len(self.tokens) or self.peek("open") == ")":
                    raise BadQuery("OR at the end")
            parts.append(self.both())
        if any_or:  # beside OR, NOT is a complement
            parts = [("", Group((("", Boosted(Every(), 0.0)), ("-", node)))) if mark == "-" else (mark, node) for mark, node in parts]
        return parts[0][1] if len(parts) == 1 and parts[0][0] != "-" else Group(tuple(parts))

    def both(self) -> tuple[str, Node]:
        """Clauses with AND between them: all have to match."""
        parts = [self.clause()]
        while self.peek("word") == "AND":
            self.take("word")
            if self.at >= len(self.tokens):
                raise BadQuery("AND at the end")
            parts.append(self.clause())
        return parts[0] if len(parts) == 1 else ("", Group(tuple((mark or "+", node) for mark, node in parts)))

    def clause(self) -> tuple[str, Node]:
        if self.peek("word") == "NOT":
            self.take("word")
            if self.at >= len(self.tokens):
                raise BadQuery("NOT at the end")
            mark, node = self.clause()
            return ("" if mark == "-" else "-"), node
        if self.peek("word") == "AND":
            raise BadQuery("AND without a clause")
        mark = self.take("mark") if self.peek("mark") else ""
        if mark and self.peek("mark"):
            raise BadQuery("two marks")
        node = self.leaf()
        while self.peek("boost"):
            node = Boosted(node, float(self.take("boost")[1:]))
        return mark, node

    def leaf(self) -> Node:
        if self.at >= len(self.tokens):
            raise BadQuery("a mark without a clause")
        if self.peek("field"):
            if self.take("field") != FIELD:
                raise BadQuery("no such field")
            return self.leaf()
        if self.peek("open") == "(":
            self.take("open")
            node = self.either()
            if self.peek("open") != ")":
                raise BadQuery("open parenthesis")
            self.take("open")
            return node
        if self.peek("range"):
            return self.span(self.take("range"))
        if self.peek("phrase") is not None:
            slop = int(self.peek("slop") or 0)
            terms = tuple(split(self.take("phrase")))
            return Words(terms, slop) if terms else Group(())
        word = self.peek("word")
        if word is None:
            raise BadQuery("not a clause")
        self.take("word")
        if word == "*":
            return Every()
        terms = split(word)
        return Words((terms[0],)) if len(terms) == 1 else Group(tuple(("", Words((t,))) for t in terms))

    @staticmethod
    def span(text: str) -> Node:
        body = text.removeprefix("IN").strip()
        inner = body[1:-1].split()
        if text.startswith("IN"):
            if body[0] != "[" or body[-1] != "]":
                raise BadQuery("a set has square brackets")
            return Group(tuple(("", Words((t,))) for word in inner for t in split(word)))
        if len(inner) != 3 or inner[1] != "TO":
            raise BadQuery("a range is a TO b")
        low, high = (None if x == "*" else x.lower() for x in (inner[0], inner[2]))
        return Span(low, high, body[0] == "[", body[-1] == "]")


def leaves(node: Node) -> Iterator[Words | Span]:
    """All words and ranges of a tree."""
    if isinstance(node, Words | Span):
        yield node
    elif isinstance(node, Boosted):
        yield from leaves(node.node)
    elif isinstance(node, Group):
        for _, inner in node.clauses:
            yield from leaves(inner)


def holds(node: Node, leaf, every, both, either, no):
    """A tree's condition, put together from its leaves' by ``both``, ``either`` and ``no``; ``every`` is the condition that always holds."""
    if isinstance(node, Every):
        return every
    if isinstance(node, Words | Span):
        return leaf(node)
    if isinstance(node, Boosted):
        return holds(node.node, leaf, every, both, either, no)
    of = {mark: [holds(inner, leaf, every, both, either, no) for m, inner in node.clauses if m == mark] for mark in ("+", "", "-")}
    found = None
    for condition in of["+"]:
        found = condition if found is None else both(found, condition)
    if found is None:
        for condition in of[""]:
            found = condition if found is None else either(found, condition)
    if found is None:  # nothing but exclusions
        return no(every)
    for condition in of["-"]:
        found = both(found, no(condition))
    return found


def empty_matches(node: Node) -> bool:
    """Whether a document without any of the query's terms matches."""
    return holds(node, lambda leaf: False, True, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)
