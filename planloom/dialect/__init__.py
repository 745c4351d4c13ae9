"""The SELECT dialect: tokens, syntax tree and parser."""

from planloom.dialect.parser import ParseError, parse, parse_expression

__all__ = ["ParseError", "parse", "parse_expression"]
