"""A tolerant lexer for Swift-like text: tokens with line and column, comments dropped."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Token:
    kind: str  # word, number, string, op, directive
    text: str
    line: int
    column: int
    spaced: bool  # white space stands before it


class LexError(ValueError):
    """Text that can't be tokens: an unclosed comment or string."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(message)
        self.line, self.column = line, column


_WORD = re.compile(r"`?[^\W\d]\w*`?|\$\d+")
_NUMBER = re.compile(r"0[xob][\w]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?")
_OP = re.compile(r"\.\.\.|\.\.<|->|===|!==|==|!=|<=|>=|&&|\|\||\?\?|&\+|&-|&\*|\+=|-=|\*=|/=|%=|[{}()\[\],:;.@#&|^~!?<>=+\-*/%\\]")


def _string_end(text: str, at: int) -> int:
    """Where the string literal that starts at ``at`` (hashes allowed) ends, -1 if it doesn't."""
    hashes = 0
    while text[at + hashes] == "#":
        hashes += 1
    quote = '"""' if text.startswith('"""', at + hashes) else '"'
    i, close, escape = at + hashes + len(quote), quote + "#" * hashes, "\\" + "#" * hashes
    while i < len(text):
        if text.startswith(close, i):
            return i + len(close)
        if text.startswith(escape + "(", i):  # interpolation: skip to its bracket
            depth, i = 1, i + len(escape) + 1
            while i < len(text) and depth:
                if text[i] == '"':
                    end = _string_end(text, i)
                    if end < 0:
                        return -1
                    i = end
                    continue
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                i += 1
            continue
        if text.startswith(escape, i):
            i += len(escape) + 1
            continue
        if quote == '"' and text[i] == "\n":
            return -1
        i += 1
    return -1


def tokens(text: str) -> list[Token]:
    """All tokens; ``#if``, ``#elseif``, ``#else`` and ``#endif`` lines are one directive each."""
    out: list[Token] = []
    i, line, start, spaced = 0, 1, 0, True
    size = len(text)
    while i < size:
        c = text[i]
        if c == "\n":
            line, start, spaced = line + 1, i + 1, True
            i += 1
            continue
        if c.isspace():
            spaced = True
            i += 1
            continue
        if text.startswith("//", i):
            end = text.find("\n", i)
            i = size if end < 0 else end
            continue
        column = i - start + 1
        if text.startswith("/*", i):
            depth, j = 1, i + 2
            while j < size and depth:
                if text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            if depth:
                raise LexError("unterminated comment", line, column)
            skipped = text[i:j]
            if "\n" in skipped:
                line += skipped.count("\n")
                start = i + skipped.rfind("\n") + 1
            i, spaced = j, True
            continue
        m = re.compile(r"#(if|elseif|else|endif)\b[^\n]*").match(text, i)
        if m:
            out.append(Token("directive", m[1], line, column, spaced))
            i = m.end()
            continue
        if c == '"' or (c == "#" and re.compile('#+"').match(text, i)):
            end = _string_end(text, i)
            if end < 0:
                raise LexError("unterminated string literal", line, column)
            lit = text[i:end]
            out.append(Token("string", lit, line, column, spaced))
            if "\n" in lit:
                line += lit.count("\n")
                start = i + lit.rfind("\n") + 1
            i, spaced = end, False
            continue
        for kind, pattern in (("word", _WORD), ("number", _NUMBER), ("op", _OP)):
            m = pattern.match(text, i)
            if m:
                out.append(Token(kind, m[0], line, column, spaced))
                i, spaced = m.end(), False
                break
        else:
            raise LexError(f"unexpected character {c!r}", line, column)
    return out
