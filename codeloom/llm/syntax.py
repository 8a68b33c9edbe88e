"""Source files that do not parse: packrat grammars per language, failure positions and rates.

Defined cases: null content is skipped (no row); empty content is valid; a byte-order mark and
mixed line ends do no harm; a file whose extension has no grammar gives ``parsed`` null; a path
is taken from the current row of its file record; whole texts are parsed, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import busy_partitions
from ..tables import current_rows
from .formats import FORMATTED, plain_formats, plain_script
from .grammars import BY_EXTENSION, PYTHON, PYTHON_LEXER, separators
from .lex import INDENT_BASE, INDENT_MOST, Lexer
from .peg import GROUP_BASE, Grammar

_INNER = re.compile(r"[(\[{][^()\[\]{}]*+[)\]}]")
_LINE_ENDS = re.compile(r"\r\n?")
_INDENT = f"{chr(INDENT_BASE)}-{chr(INDENT_BASE + INDENT_MOST)}"
_INDENTS = re.compile(f"[{_INDENT}]")
_LINES = re.compile(f"([{_INDENT}])([^{_INDENT}]*+)")
_MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)")
_CLOSERS = {")": "(", "]": "[", "}": "{"}


def _clean(text: str) -> str:
    return _LINE_ENDS.sub("\n", text.removeprefix("﻿"))


def _reduce(grammar: Grammar, chars: str, indents: bool) -> str:
    known, make = grammar.memo.get, grammar.group

    def replace(m: re.Match) -> str:
        group = m.group()
        return known(group) or make(group)

    def replace_lines(m: re.Match) -> str:
        group = _INDENTS.sub("", m.group())
        return known(group) or make(group)

    found = 1
    while found:
        chars, found = _INNER.subn(replace_lines if indents else replace, chars)
    return chars


def _layout(chars: str) -> str | None:
    """Indented suites as groups; None where a line returns to no open indentation."""
    newline = PYTHON.tokens["NL"]
    widths, open_ = [0], [[]]
    for indent, line in _LINES.findall(chars):
        if not line:
            continue
        width = ord(indent) - INDENT_BASE
        if width > widths[-1]:
            widths.append(width)
            open_.append([])
        while width < widths[-1]:
            widths.pop()
            suite = "".join(open_.pop())
            open_[-1].append(PYTHON.group(f"<{suite}>"))
        if width != widths[-1]:
            return None
        open_[-1].append(line + newline)
    while len(open_) > 1:
        suite = "".join(open_.pop())
        open_[-1].append(PYTHON.group(f"<{suite}>"))
    return "".join(open_[0])


def _python(text: str) -> bool:
    chars = _layout(_reduce(PYTHON, PYTHON_LEXER.encode(f"\n{text}\n"), True))
    return chars is not None and PYTHON.accepts(chars)


def _other(text: str, language: str, lexer: Lexer, grammar: Grammar) -> bool:
    chars, drop = separators(language, lexer.encode(text))
    return grammar.accepts(_reduce(grammar, chars.replace(drop, "") if drop else chars, False))


def parses(text: str, extension: str) -> bool | None:
    """True if the whole text is syntactically valid for the extension's language (None: no grammar)."""
    if extension not in BY_EXTENSION:
        return None
    language, lexer, grammar = BY_EXTENSION[extension]
    text = _clean(text)
    if not text or text.isspace():
        return True
    if language == "python":
        return _python(text) or FORMATTED.search(text) is not None and _python(plain_formats(text))
    if language in ("typescript", "javascript") and text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    if _other(text, language, lexer, grammar):
        return True
    return language in ("typescript", "javascript") and ("`" in text or "/" in text) and _other(plain_script(text), language, lexer, grammar)


def _furthest(grammar: Grammar, rules: list[str], items: list[tuple[str, int]], end: int) -> int:
    text = "".join(c for c, _ in items)
    at = max(grammar.furthest(rule, text)[1] for rule in rules)
    return items[at][1] if at < len(items) else end


def first_failure(text: str, extension: str) -> tuple[int, int, str]:
    """(line, column, cause) of the furthest failure of a text that does not parse; both count from 1.

    Causes: conflict marker, unterminated literal, unbalanced bracket, indentation, end of file, token.
    """
    language, lexer, grammar = BY_EXTENSION[extension]
    text = _clean(text)
    python = language == "python"
    source = f"\n{plain_formats(text)}\n" if python else text
    if language in ("typescript", "javascript"):
        source = plain_script(text)
    shift = 1 if python else 0
    chars, offsets = lexer.positions(source)
    chars, drop = separators(language, chars)
    items = [(c, o) for c, o in zip(chars, offsets) if c != drop]
    size = len(source.rstrip()) if source.strip() else 0
    fail: tuple[int, str] | None = None
    stack: list[tuple[str, int, list[tuple[str, int]]]] = [("", 0, [])]
    for char, at in items:
        if char == lexer.tokens["ERR"] and source[at : at + 1] in "\"'`":
            fail = (at, "unterminated literal")
            break
        if char in "([{":
            stack.append((char, at, []))
        elif char in _CLOSERS:
            if stack[-1][0] != _CLOSERS[char]:
                fail = (at, "unbalanced bracket")
                break
            bracket, began, inner = stack.pop()
            if python:
                inner = [(c, o) for c, o in inner if not _INDENTS.match(c)]
            made = grammar.group(bracket + "".join(c for c, _ in inner) + char)
            if ord(made) == GROUP_BASE[bracket]:
                fail = (_furthest(grammar, [r for _, r in grammar.roles[bracket]], inner, at), "token")
                break
            stack[-1][2].append((made, began))
        else:
            stack[-1][2].append((char, at))
    if fail is None and len(stack) > 1:
        fail = (size, "end of file")
    if fail is None and python:
        fail = _layout_failure(stack[0][2], size)
    if fail is None:
        at = _furthest(grammar, [grammar.start], stack[0][2], size)
        fail = (at, "end of file" if at >= size else "token")
    at = min(max(fail[0] - shift, 0), len(text))
    line = text.count("\n", 0, at) + 1
    column = at - (text.rfind("\n", 0, at) + 1) + 1
    marker = next((m for m in _MARKER.finditer(text) if abs(text.count("\n", 0, m.start()) + 1 - line) <= 3), None)
    if marker or (fail[1] != "token" and _MARKER.search(text)):
        return line, column, "conflict marker"
    return line, column, fail[1]


def _layout_failure(items: list[tuple[str, int]], size: int) -> tuple[int, str] | None:
    widths, open_ = [0], [[]]
    newline = PYTHON.tokens["NL"]

    def close(at: int) -> tuple[int, str] | None:
        widths.pop()
        inner = open_.pop()
        made = PYTHON.group("<" + "".join(c for c, _ in inner) + ">")
        if ord(made) == GROUP_BASE["<"]:
            return _furthest(PYTHON, ["block"], inner, at), "token"
        open_[-1].append((made, inner[0][1]))
        return None

    lines: list[tuple[int, list[tuple[str, int]]]] = []
    for char, at in items:
        if _INDENTS.match(char):
            lines.append((ord(char) - INDENT_BASE, []))
        elif lines:
            lines[-1][1].append((char, at))
    for width, line in lines:
        if not line:
            continue
        if width > widths[-1]:
            widths.append(width)
            open_.append([])
        while width < widths[-1]:
            if bad := close(line[0][1]):
                return bad
        if width != widths[-1]:
            return line[0][1], "indentation"
        open_[-1] += [*line, (newline, line[-1][1])]
    while len(open_) > 1:
        if bad := close(size):
            return bad
    at = _furthest(PYTHON, ["file"], open_[0], size)
    return at, "end of file" if at >= size else "token"


_RESULT = "file_id long, language string, parsed boolean, line int, column int, cause string"


def _check_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, extension, content in zip(batch.file_id, batch.extension, batch.content):
            ok = parses(content, extension)
            where = first_failure(content, extension) if ok is False else (None, None, None)
            rows.append((file_id, BY_EXTENSION[extension][0] if ok is not None else None, ok, *where))
        out = pd.DataFrame(rows, columns=["file_id", "language", "parsed", "line", "column", "cause"])
        yield out.astype({"line": "Int32", "column": "Int32", "parsed": "boolean"})


def file_paths(files: DataFrame) -> DataFrame:
    """id, absolute_path (slashes), extension and repository of the current file records."""
    path = F.translate("absolute_path", "\\", "/")
    return current_rows(files.where("absolute_path is not null"), ["absolute_path"]).select(
        "id",
        path.alias("absolute_path"),
        F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("extension"),
        F.regexp_extract(path, r"/repos/([^/]+)", 1).alias("repository"),
    )


def check_syntax(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Per file with non-null content: file_id, repository, language, parsed, line, column, cause."""
    paths = file_paths(files)
    sources = texts.select("file_id", "content").where("content is not null and file_id is not null")
    sources = sources.repartition(busy_partitions(texts.sparkSession), "file_id")
    joined = sources.join(paths, sources.file_id == paths.id).select("file_id", "extension", "repository", "content")
    out = joined.select("file_id", "extension", "content").mapInPandas(_check_batches, _RESULT)
    return out


def invalid_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    return check_syntax(files, texts).where("parsed = false")


def syntax_rates(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files and their rate."""
    checked = check_syntax(files, texts).where("parsed is not null")
    return (
        checked.join(file_paths(files).select(F.col("id").alias("file_id"), "repository"), "file_id")
        .groupBy("repository", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum((~F.col("parsed")).cast("long")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
