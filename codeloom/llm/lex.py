"""Tokenisers: source text to one class character per token, for six languages."""

from __future__ import annotations

import re
import unicodedata
from itertools import count

#: Newline characters of Python carry the width of the indentation that follows, up to ``INDENT_MOST`` columns.
INDENT_BASE, INDENT_MOST = 0x3000, 0xA7FF
#: Combining marks, which may follow in a name but are no word characters of a regular expression.
_MARKS = "".join(c for c in map(chr, [*range(0x300, 0xFFFF), *range(0xE0100, 0xE01F0)]) if unicodedata.category(c) in ("Mn", "Mc"))


class Lexer:
    """One regular expression per language; ``classes`` maps each distinct token text to its character."""

    def __init__(self, skip: str, tokens: list[str], keywords: str, operators: str, letters: str = "", newline: str = "", marks: bool = True, dotted: bool = True):
        ops = operators.split()
        by_length = sorted((o for o in ops if o not in "()[]{}"), key=len, reverse=True)
        word = rf"(?:[^\W\d]|[{letters}])[\w{letters}]*+" if letters else r"[^\W\d]\w*+"
        if marks:
            word += rf"(?:[{_MARKS}][\w{letters}{_MARKS}]*+)?"
        number = rf"0[xXbBoO][\da-fA-F_]+\w*|(?:\d[\d_]*(?:\.(?![._a-zA-Z])[\d_]*)?{r'|\.\d[\d_]*' if dotted else ''})(?:[eE][+-]?\d[\d_]*)?\w*"
        parts = [*tokens, word, number, r"[()\[\]{}]", "|".join(map(re.escape, by_length)), r"[^\s]"]
        if newline:
            parts.insert(0, newline)
        self.pattern = re.compile(rf"(?:{skip})*+({'|'.join(parts)}|\Z)")
        self.newline = bool(newline)
        ids = count(0x100)
        self.tokens = {c: c for c in "()[]{}"}  # a template or raw string in back quotes is TPL
        for kind in ("ID", "NUM", "STR", "TPL", "NL", "ASI", "ERR", "LIFE", "TYPE"):
            self.tokens[kind] = chr(next(ids))
        for text in [*keywords.split(), *ops]:
            if text not in self.tokens:
                self.tokens[text] = chr(next(ids))
        self.tokens["ANY"] = "".join(c for t, c in self.tokens.items() if t not in ("ERR", *"()[]{}"))
        self.fixed = {t: c for t, c in self.tokens.items() if not t.isupper()}
        self.classes: dict[str, str] = dict(self.fixed)
        self.classes[""] = ""

    def classify(self, token: str) -> str:
        first = token[0]
        if first == "\n" or (self.newline and first in "/;" and "\n" in token):
            char = self.tokens["NL"]
        elif first in "\"'`" or (token[-1] in "\"'" and len(token) > 1):
            closed = len(token) > 1 and token[-1] in "\"'`"
            char = self.tokens["TPL" if closed and first == "`" else "STR" if closed else "LIFE" if first == "'" and len(token) > 1 else "ERR"]
        elif first.isdigit() or (first == "." and len(token) > 1):
            char = self.tokens["NUM"]
        elif first == "/" and len(token) > 2:
            char = self.tokens["STR"]
        elif first.isalpha() and token[-1].isspace():  # a word that is a keyword before what follows it
            char = self.tokens["TYPE"]
        elif first.isalpha() or first in "_$#" and len(token) > 1 or first in "_$":
            char = self.tokens["ID"]
        else:
            char = self.tokens["ERR"]
        if len(self.classes) > 300_000:
            self.classes = dict(self.fixed) | {"": ""}
        self.classes[token] = char
        return char

    def encode(self, text: str) -> str:
        known = self.classes.get
        return "".join([known(t) or (self.classify(t) if t else "") for t in self.pattern.findall(text)])

    def positions(self, text: str) -> tuple[str, list[int]]:
        """As ``encode``, with the offset of every token."""
        chars, at = [], []
        for m in self.pattern.finditer(text):
            token = m.group(1)
            if token:
                chars.append(self.classes.get(token) or self.classify(token))
                at.append(m.start(1))
        return "".join(chars), at


_BAD_NUMBER = re.compile(r"0[\d_]*[1-9][\d_]*")


class PythonLexer(Lexer):
    def classify(self, token: str) -> str:
        if token[0] == "\n":
            last = token[token.rfind("\n") + 1 :]
            width = len(last.expandtabs(8))
            char = chr(INDENT_BASE + min(width, INDENT_MOST))
            self.classes[token] = char
            return char
        if _BAD_NUMBER.fullmatch(token):
            return self.tokens["ERR"]
        return super().classify(token)
