"""Tokens of the dialect. Keywords are written all in upper or all in lower case; other words are names."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset("select distinct from where group by having order asc desc limit offset as and or not between in like true false date union".split())


class ParseError(ValueError):
    """The text is not in the dialect."""


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, number, string, symbol or end
    value: str
    at: int


_SCAN = re.compile(
    r"""(?P<space>\s+)
      | (?P<number>\d*\.?\d+)
      | (?P<word>[A-Za-z_]\w*)
      | (?P<quoted>`[A-Za-z][\w.\-:*]*`|\[[A-Za-z][\w.\-:*]*\])
      | (?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      | (?P<symbol>==|<>|!=|<=|>=|[-+*/=<>(),.])""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "number" and m.end() < len(text) and re.match(r"[A-Za-z_]", text[m.end()]):
            raise ParseError(f"a name cannot start with a digit, at {at}")
        if kind == "word":
            known = value.lower() in KEYWORDS and value in (value.lower(), value.upper())
            out.append(Token("keyword", value.lower(), at) if known else Token("name", value, at))
        elif kind == "quoted":
            out.append(Token("name", value[1:-1] if value[0] == "`" else value, at))
        elif kind == "string":
            out.append(Token("string", re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.DOTALL), at))
        elif kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]
