"""Code blocks of eleven languages by one scanner: a table says what comments and texts look like and how blocks begin.

Comments and the insides of texts are blanked first, so nothing in them opens or closes a block. Blocks end where their brace is closed,
where their ``end`` stands, or where the indentation goes back. Blocks may overlap, outer before inner.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

_QUOTED, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_C_NOTES, _HASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"#[^\n]*"
_HEREDOC = r"<<<[ \t]*[\"']?(?P<doc>\w+)[\"']?\n.*?\n[ \t]*(?P=doc)\b"
_SHELL_DOC = r"<<[~-]?[\"']?(?P<doc>[A-Z]\w*)[\"']?[^\n]*\n.*?\n[ \t]*(?P=doc)\b"
_JS_REGEX = r"(?<=[=(,:;!&|?{}+\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
#: Texts with longer lines, which no one has written by hand, have no blocks.
LONGEST_LINE = 20_000
#: Words that look like the name of a method.
_NOT_NAMES = frozenset("if for while switch catch return new else do throw function synchronized sizeof elseif foreach match with await super this".split())


@dataclass(frozen=True)
class Language:
    """Notes and texts to blank, how blocks begin (node type, expression with a name n), and how they end: brace, end or indent. In an expression
    b is where the block itself begins, o a receiver, p an opening bracket of parameters that a body has to follow, c a constructor's name.

    Node types of ``owners`` give names to what is in them; those of ``inside`` count in the body of an owner only, those of ``outside`` elsewhere only.
    """

    notes: str
    texts: str
    heads: tuple[tuple[str, str], ...]
    owners: frozenset[str]
    inside: frozenset[str] = frozenset()
    outside: frozenset[str] = frozenset()
    ends: str = "brace"


_JS_HEADS = (
    ("function_declaration", r"(?<![=(,:?&|!.]\s)\b(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)\s*(?=[(<])"),
    ("class_declaration", r"(?<![=(,:?&|!.]\s)\b(?:abstract\s+)?class\s+(?P<n>[\w$]+)(?=[^;={}]*\{)"),
    ("method_definition", r"(?<![\w$.])(?:(?:static|async|get|set|public|private|protected|override)\s+)*\*?\s*(?P<n>#?[\w$]+)\s*(?:<[^<>{}()]*>)?\s*(?P<p>\()"),
    ("arrow_function", r"(?:(?P<n>[\w$]+)\s*(?::[^=;{}()\n]+)?[=:]\s*)?(?P<b>(?:\basync\s*)?(?:\([^(){}]*\)|(?<![\w$.])[\w$]+)\s*(?::\s*[^=;{}()]+)?=>)"),
)
_JS = Language(_C_NOTES, rf"{_QUOTED}|{_SINGLE}|`(?:\\.|[^`\\])*`|{_JS_REGEX}", _JS_HEADS, frozenset({"class_declaration"}), frozenset({"method_definition"}))
_C_FUNCTION = ("function_definition", r"^[ \t]*(?!return\b|else\b|new\b)[A-Za-z_][\w \t*&:<>,\[\]]*?[\s*&](?P<n>[\w:~]+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?=\{)")
#: The node types that are blocks, by language.
LANGUAGES = {
    "python": Language(_HASH, rf'"""(?:\\.|.)*?"""|\'\'\'(?:\\.|.)*?\'\'\'|{_QUOTED}|{_SINGLE}', (("class_definition", r"^[ \t]*class\s+(?P<n>\w+)"), ("function_definition", r"^[ \t]*(?:async\s+)?def\s+(?P<n>\w+)")), frozenset({"class_definition"}), ends="indent"),
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "go": Language(_C_NOTES, rf"{_QUOTED}|{_SINGLE}|`[^`]*`", (("function_declaration", r"^func\s+(?P<n>\w+)"), ("method_declaration", r"^func\s*\(\s*(?:\w+\s+)?\*?(?P<o>\w+)[^)]*\)\s*(?P<n>\w+)"), ("type_declaration", r"^[ \t]*type\s+(?P<n>\w+)?")), frozenset()),
    "rust": Language(_C_NOTES, rf'r(?P<doc>#*)".*?"(?P=doc)|{_QUOTED}|\'(?:\\[^\n]+?|[^\'\\\n])\'', (("struct_item", r"\bstruct\s+(?P<n>\w+)"), ("impl_item", r"\bimpl\b\s*(?:<[^{};]*?>)?\s*(?:[^{};]*?\bfor\s+)?(?P<n>\w+)(?=[^;{}]*\{)"), ("function_item", r"\bfn\s+(?P<n>\w+)(?=[^;{}]*\{)")), frozenset({"impl_item"})),
    "java": Language(_C_NOTES, rf'"""(?:\\.|.)*?"""|{_QUOTED}|{_SINGLE}', (("class_declaration", r"\bclass\s+(?P<n>\w+)(?=[^;{}]*\{)"), ("interface_declaration", r"(?<!@)\binterface\s+(?P<n>\w+)(?=[^;{}]*\{)"), ("method_declaration", r"(?:(?:public|private|protected|static|final|abstract|default|synchronized|native)\s+)*(?:<[^<>{}()]*>\s*)?(?!(?:public|private|protected|static|final|abstract|new|return|throw|else)\b)[A-Za-z_][\w.]*(?:<[^{}();]*>)?(?:\[\])*\s+(?P<n>\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{;])")), frozenset({"class_declaration", "interface_declaration"}), frozenset({"method_declaration"})),
    "c": Language(_C_NOTES, rf"{_QUOTED}|{_SINGLE}", (_C_FUNCTION, ("struct_specifier", r"\bstruct\s+(?P<n>\w+)\s*(?=\{)")), frozenset()),
    "cpp": Language(_C_NOTES, rf'R"(?P<doc>\w*)\(.*?\)(?P=doc)"|{_QUOTED}|{_SINGLE}', (_C_FUNCTION, ("function_definition", r"^[ \t]*(?:explicit\s+|constexpr\s+)*(?P<c>(?P<n>~?\w+))\s*\([^;{}]*\)\s*(?:noexcept\s*)?(?::[^;{}]*)?(?=\{)"), ("class_specifier", r"\bclass\s+(?P<n>\w+)\s*(?:final\s*)?(?::[^;{}]*)?(?=\{)")), frozenset({"class_specifier"})),
    "ruby": Language(rf"^=begin.*?^=end[^\n]*|{_HASH}", rf"{_SHELL_DOC}|{_QUOTED}|{_SINGLE}", (("class", r"^[ \t]*class\s+(?P<n>[A-Z][\w:]*)"), ("method", r"^[ \t]*def\s+(?P<n>[\w.]+[?!=]?)")), frozenset({"class"}), ends="end"),
    "php": Language(rf"{_C_NOTES}|#(?!\[)[^\n]*", rf"{_HEREDOC}|{_QUOTED}|{_SINGLE}", (("class_declaration", r"\bclass\s+(?P<n>\w+)(?=[^;{}]*\{)"), ("method_declaration", r"(?:(?:public|private|protected|static|final|abstract)\s+)*\bfunction\s+&?(?P<n>\w+)\s*\("), ("function_definition", r"\bfunction\s+&?(?P<n>\w+)\s*\(")), frozenset({"class_declaration"}), frozenset({"method_declaration"}), frozenset({"function_definition"})),
}
_CLASSES = frozenset({"class_definition", "class_declaration", "interface_declaration", "class_specifier", "struct_specifier", "struct_item", "impl_item", "type_declaration", "class"})


#: What stands between a method's parameters and its body.
_BODY = re.compile(r"\s*(?::[^{};=]+)?\{")


@cache
def _gaps(language: str) -> re.Pattern[str]:
    spec = LANGUAGES[language]
    return re.compile(f"(?P<text>{spec.texts})|(?:{spec.notes})", re.DOTALL | re.MULTILINE)


@cache
def _heads(language: str) -> list[tuple[str, re.Pattern[str]]]:
    return [(node, re.compile(expression, re.MULTILINE)) for node, expression in LANGUAGES[language].heads]


def blanked(text: str, language: str) -> tuple[str, set[int]]:
    """The text with notes and the insides of texts as blanks, line feeds kept, and the numbers (from 0) of lines that begin inside a text."""
    inside: set[int] = set()

    def blank(m: re.Match[str]) -> str:
        if m["text"] is None:
            return re.sub(r"[^\n]", " ", m[0])
        first = text.count("\n", 0, m.start())
        inside.update(range(first + 1, first + 1 + m[0].count("\n")))
        return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

    return _gaps(language).sub(blank, text), inside


def _closings(code: str) -> dict[int, int]:
    """Where each bracket is closed."""
    stack, found = [], {}
    for m in re.finditer(r"[{}()\[\]]", code):
        if m[0] in "{([":
            stack.append(m)
            continue
        while stack and stack[-1][0] + m[0] not in ("{}", "()", "[]"):
            stack.pop()  # a bracket that is never closed
        if stack:
            found[stack.pop().start()] = m.start()
    return found


def _brace_end(code: str, closings: dict[int, int], at: int, node: str) -> int | None:
    """The last place of a block whose head ends at ``at``: its closing brace, or what ends a statement or an expression."""
    if node == "arrow_function" and not re.compile(r"\s*\{").match(code, at):
        while at < len(code) and code[at] not in ",;)]}":
            if code[at] == "\n" and code[:at].rstrip()[-1:] not in ("=", ">", "(", "?", ":", "&", "|", "+"):
                break
            at = closings.get(at, at) + 1 if code[at] in "{([" else at + 1
        return len(code[:at].rstrip()) - 1
    for m in re.compile(r"[{;()\[]|\n" if node == "type_declaration" else r"[{;(\[]").finditer(code, at):
        if m.start() < at:
            continue
        if m[0] == "{" or (m[0] == "(" and node == "type_declaration"):
            return closings.get(m.start())
        if m[0] in ";\n":
            return m.start() - (m[0] == "\n") if node in ("struct_item", "type_declaration", "method_declaration") else None
        at = closings.get(m.start(), m.start()) + 1
    return len(code) - 1 if node == "type_declaration" else None


def _word_end(lines: list[str], first: int) -> int | None:
    """The line of the ``end`` that closes what line ``first`` opens."""
    if re.match(r"\s*def\s+[\w.]+[?!]?\s*(?:\([^)]*\))?\s*=\s", lines[first]):
        return first
    depth = 0
    for i in range(first, len(lines)):
        line = lines[i]
        opens = len(re.findall(r"(?:^|;|=)\s*(?:class|module|def|if|unless|while|until|case|for|begin)\b", line))
        opens += bool(re.search(r"\bdo\b\s*(?:\|[^|]*\|)?\s*$", line)) and not re.match(r"\s*(?:while|until|for)\b", line)
        depth += opens - len(re.findall(r"(?<![.:\w])end\b(?![?!:])", line))
        if depth <= 0:
            return i
    return None


def _indent_end(lines: list[str], inside: set[int], first: int) -> int:
    """The last line before the indentation goes back."""
    width = lambda line: len(line) - len(line.lstrip())
    own, last, depth = width(lines[first]), first, 0
    for i in range(first, len(lines)):
        line = lines[i]
        if i > first and line.strip() and not depth and i not in inside and width(line) <= own:
            break
        if line.strip():
            last = i
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    return last


def scan(text: str, language: str) -> list[tuple[str, str, list[str], int, int, str]]:
    """(content, kind, names, first line, last line, node type) of every block, lines from 1; a name holds those of the classes around it."""
    source = text.split("\n")
    if max(map(len, source)) > LONGEST_LINE:
        return []
    spec, (code, inside) = LANGUAGES[language], blanked(text, language)
    lines = code.split("\n")
    begins = list(accumulate((len(x) + 1 for x in lines), initial=0))
    line_of = lambda at: bisect_right(begins, at) - 1
    closings = _closings(code) if spec.ends == "brace" else {}
    found: list[tuple[int, int, str, str | None, str | None, bool]] = []
    for node, head in _heads(language):
        for m in head.finditer(code):
            if m["n"] in _NOT_NAMES:
                continue
            groups = m.re.groupindex
            if "p" in groups and not _BODY.match(code, closings.get(m.start("p"), len(code)) + 1):
                continue
            start = m.start("b") if "b" in groups else m.start() + len(m[0]) - len(m[0].lstrip())
            line = line_of(start)
            if spec.ends == "brace":
                end = _brace_end(code, closings, closings[m.start("p")] + 1 if "p" in groups else m.end(), node)
            else:
                stop = _word_end(lines, line) if spec.ends == "end" else _indent_end(lines, inside, line)
                end = None if stop is None else begins[stop + 1] - 2
            if end is not None:
                found.append((start, end, node, m["n"], m["o"] if "o" in groups else None, "c" in groups))
    found.sort(key=lambda b: (b[0], -b[1]))
    out, open_blocks = [], []
    for block in found:
        start, end, node, name, owner, constructs = block
        open_blocks = [b for b in open_blocks if b[1] >= start]
        around = [b for b in open_blocks if b[0] < start and end <= b[1]]
        open_blocks.append(block)
        if any(b[1] == end and b[3] == name and b[2] not in spec.owners for b in around):
            continue  # the same block with its modifiers
        owners = [b for b in around if b[2] in spec.owners]
        direct = bool(owners) and around[-1] is owners[-1]
        if (node in spec.inside and not direct) or (node in spec.outside and direct):
            continue
        if constructs and not (direct and owners[-1][3] == name.lstrip("~")):
            continue
        kind = "class" if node in _CLASSES else "method" if owners or owner or node.startswith("method_") else "function"
        path = [b[3] for b in owners] + ([owner] if owner else []) + ([name] if name else [])
        first, last = line_of(start), line_of(end)
        out.append(("\n".join(source[first : last + 1]), kind, [".".join(path)] if name else [], first + 1, last + 1, node))
    return out
