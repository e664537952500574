"""A source text as code without comments and string contents, and what can be read off it without a grammar: calls, arguments, literals, blocks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

_C = re.compile(r"""(?P<note>//[^\n]*|/\*(?:(?!\*/)[\s\S])*(?:\*/)?)|(?P<text>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?)""")
_OPEN, _SHUT = "([{", ")]}"
# Words in front of a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch catch return function func new typeof await throw else do in of case with super synchronized".split())
_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?<![\w$.])((?:this\s*\??\.\s*)?{_NAME}(?:\s*\??\.\s*{_NAME}|\[[^\[\]\n]*\])*)\s*(<[\w\s.,<>\[\]|?&]*>)?\s*\(")


@dataclass
class Call:
    name: str
    receiver: str | None
    args: list[str]
    generics: str | None
    at: int
    line: int
    raw: str


@dataclass
class Source:
    text: str
    marks: dict = field(default_factory=dict)

    @cached_property
    def _parts(self) -> tuple[str, str]:
        """The text without comments, and without comments and string contents; both as long as the text."""
        bare, code, at = [], [], 0
        for m in _C.finditer(self.text):
            between = self.text[at : m.start()]
            blank = re.sub(r"[^\n]", " ", m[0])
            quoted = m["text"]
            bare += [between, quoted or blank]
            code += [between, quoted[0] + blank[1:-1] + (quoted[-1] if len(quoted) > 1 else "") if quoted else blank]
            at = m.end()
        rest = self.text[at:]
        return "".join([*bare, rest]), "".join([*code, rest])

    @property
    def bare(self) -> str:
        return self._parts[0]

    @property
    def code(self) -> str:
        return self._parts[1]

    @cached_property
    def _starts(self) -> list[int]:
        return [0] + [m.end() for m in re.finditer(r"\n", self.text)]

    def line(self, at: int) -> int:
        return bisect_right(self._starts, at)

    def shut(self, at: int) -> int:
        """The place behind the bracket that closes the one at `at`; the end of the text if none does."""
        depth = 0
        for m in re.compile(r"[()\[\]{}]").finditer(self.code, at):
            depth += 1 if m[0] in _OPEN else -1
            if depth == 0:
                return m.end()
        return len(self.text)

    def split(self, start: int, end: int, by: str = ",") -> list[tuple[int, int]]:
        """Ranges between the separators that no bracket encloses; empty ones are left out."""
        out, depth, at = [], 0, start
        for i in range(start, end):
            c = self.code[i]
            if c in _OPEN:
                depth += 1
            elif c in _SHUT:
                depth -= 1
            elif c == by and depth == 0:
                out.append((at, i))
                at = i + 1
        out.append((at, end))
        return [(a, z) for a, z in out if self.text[a:z].strip()]

    @cached_property
    def calls(self) -> list[Call]:
        out = []
        for m in _CALL.finditer(self.code):
            path = re.sub(r"\s+|\?", "", self.bare[m.start(1) : m.end(1)])
            index = re.search(r"""\[(["'`])([\w$]+)\1\]$""", path)
            if index:
                path = f"{path[: index.start()]}.{index[2]}"
            receiver, _, name = path.rpartition(".")
            if name in _NO_CALL or "[" in name or re.search(r"\b(?:function|func|def)\s+$", self.code[: m.start()][-12:]):
                continue
            shut = self.shut(m.end() - 1)
            args = [self.bare[a:z].strip() for a, z in self.split(m.end(), shut - 1)]
            out.append(Call(name, receiver or None, args, m[2], m.start(), self.line(m.start()), self.bare[m.start() : shut]))
        return out

    def blocks(self, pattern: str) -> Iterator[tuple[re.Match, int, int]]:
        """Matches of a pattern over the code whose next brace opens a block, with the block's inner range."""
        for m in re.finditer(pattern, self.code):
            brace = self.code.find("{", m.end() - 1)
            stop = self.code.find(";", m.end() - 1)
            if brace >= 0 and not 0 <= stop < brace:
                yield m, brace + 1, self.shut(brace) - 1


def string(text: str | None) -> str | None:
    """The value of a plain string literal."""
    m = re.fullmatch(r"""(["'`])((?:\\.|(?!\1)[^\\])*)\1""", (text or "").strip(), re.S)
    return re.sub(r"\\(.)", r"\1", m[2]) if m and not (m[1] == "`" and "${" in m[2]) else None


def constants(source: Source) -> dict[str, str]:
    """Names that a file binds once, to a string literal."""
    found: dict[str, str | None] = {}
    for m in re.finditer(rf"""\b(?:const|let|var|final\s+String|String)\s+({_NAME})\s*(?::\s*\w+\s*)?=\s*((["'`])(?:\\.|(?!\3)[^\\])*\3)\s*[;\n,]""", source.bare):
        found[m[1]] = None if m[1] in found else string(m[2])
    return {k: v for k, v in found.items() if v is not None}


def value(text: str | None, known: dict[str, str]) -> str | None:
    """What a string expression comes to: literals, names of constants, sums of both, and templates, whose unknown parts stay as ${name}."""
    text = (text or "").strip()
    if (plain := string(text)) is not None:
        return plain
    if re.fullmatch(_NAME, text):
        return known.get(text)
    if re.fullmatch(r"`(?:\\.|[^`\\])*`", text, re.S):
        def part(m: re.Match) -> str:
            name = m[1].strip()
            return known.get(name) or ("${" + (re.findall(_NAME, name) or ["param"])[-1] + "}")

        return re.sub(r"\$\{([^}]*)\}", part, text[1:-1])
    s = Source(text)
    parts = s.split(0, len(text), "+")
    if len(parts) > 1:
        got = [value(s.bare[a:z], known) for a, z in parts]
        return "".join(got) if all(x is not None for x in got) else None
    return None


def members(text: str | None) -> dict[str, str]:
    """The top-level members of an object literal, as source text; shorthand members stand for themselves."""
    text = (text or "").strip()
    if not text.startswith("{"):
        return {}
    s, out = Source(text), {}
    for a, z in s.split(1, s.shut(0) - 1):
        m = re.match(rf"""\s*(?:async\s+)?(?:({_NAME})|(["'])([^"']+)\2)\s*(?:(:)|(\()|$)""", s.bare[a:z], re.S)
        if m:
            out[m[1] or m[3]] = s.bare[a + m.end() : z].strip() if m[4] else s.bare[a:z].strip()
    return out
