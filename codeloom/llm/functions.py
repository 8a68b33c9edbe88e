"""Functions paired with their documentation.

Signatures are found by regular expressions; bodies end where an indentation stack (Python), a
brace stack, or an end-keyword stack (Ruby, Lua) closes; a comment belongs to a signature when
it ends within ``MAX_DISTANCE`` lines above it, annotations aside, and a docstring when it is
the first statement of the body.

Defined cases: null or blank sources and null ids give no pair; a null or blank documentation
column falls back to the comment or docstring that heads the source; a null signature or name
is allowed; repeated rows and versions give one pair, of the current row; empty tables give no
rows; texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import busy_partitions, spread
from .syntax import file_paths

#: Lines between the end of a comment and the signature it documents.
MAX_DISTANCE = 2

_WORDY = r"(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|async|export|override|readonly|get|set)"
_NOT_NAMES = "if|for|while|switch|catch|return|throw|else|do|try|new|with|function|await|typeof|super|match|loop"
SIGNATURES = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)", re.M),
    "go": re.compile(r"^func[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*[\[(]", re.M),
    "rust": re.compile(r'^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern(?:[ \t]+"[^"\n]*")?)[ \t]+)*fn[ \t]+(?P<name>\w+)', re.M),
    "java": re.compile(rf"^[ \t]*(?:{_WORDY}[ \t]+)*(?:<[^>\n]+>[ \t]+)?(?!(?:{_NOT_NAMES}|def|func|fn|package|import|throws|yield|assert)\b)[\w.$]+(?:<[^;{{}}()\n]*>)?(?:\[\])*[ \t]+(?P<name>(?!(?:{_NOT_NAMES})\b)[\w$]+)[ \t]*\((?=[^;{{}}]*\)[^;{{}}=]*[{{;])", re.M),
    "script": re.compile(rf"^[ \t]*(?:(?:{_WORDY})[ \t]+)*(?:function[ \t]*\*?[ \t]*|(?:const|let|var)[ \t]+(?=[\w$]+[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^;{{}}]*\)[^;{{}}]*=>|[\w$]+[ \t]*=>))|\*?[ \t]*)(?P<name>(?!(?:{_NOT_NAMES})\b)[\w$#]+)[ \t]*(?:<[^>\n]*>)?(?:\((?=[^;{{}}]*\)[^;={{}}]*\{{)|=[ \t]*(?:async|function|\(|[\w$]+[ \t]*=>))", re.M),
    "ruby": re.compile(r"^[ \t]*def[ \t]+(?:self\.)?(?P<name>[\w?!=]+)", re.M),
    "lua": re.compile(r"^[ \t]*(?:local[ \t]+)?function[ \t]+(?P<name>[\w.:]+)", re.M),
}
FAMILY = {
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "lua": "lua",
    **dict.fromkeys(("js", "mjs", "cjs", "ts", "mts", "cts"), "script"),
}
_BRACES = re.compile(r'"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|\'(?:[^\'\\\n]|\\.){1,2}\'|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?\*/|[{};]', re.S)
_ENDS = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*|--[^\n]*|(?:^|(?<=[\s;=]))(?:def|class|module|if|unless|while|until|case|begin|do|for|function|end)\b', re.M)
_NOTED = re.compile(r"[ \t]*(?:@(?!\w+[ \t]*\()[\w.]+|@[\w.]+\(.*\)?|#!?\[.*\])[ \t]*$")
_DOCSTRING = re.compile(r'\s*[rRuU]?("""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')')
_HEAD = re.compile(r"\s*((?:(?://[^\n]*|#(?!!?\[)[^\n]*|/\*[\s\S]*?\*/)\s*)+)")
_MARKS = re.compile(r'^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//[/!]*|#+|[rRuU]?"""|[rRuU]?\'\'\'|--+\[*|;+)?[ \t]?|(?:\*+/|"""|\'\'\')[ \t]*$', re.M)


def family_of(source: str) -> str | None:
    """Language family of a lone function, from the signature that comes first."""
    found = [(m.start(), n, k) for n, (k, p) in enumerate(SIGNATURES.items()) if k not in ("ruby", "lua") and (m := p.search(source))]
    return min(found)[2] if found else None


def _brace_end(text: str, start: int) -> int:
    depth = 0
    for m in _BRACES.finditer(text, start):
        token = m.group()
        if token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif token == ";" and depth == 0:
            return m.end()
    return len(text)


def _indent_end(text: str, start: int) -> tuple[int, int]:
    """(start of the body, its end): lines deeper than the signature's, after the colon that closes it."""
    depth, at = 0, start
    for m in re.finditer(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:]", text[start:]):
        token = m.group()
        depth += (token in "([{") - (token in ")]}")
        if token == ":" and depth == 0:
            at = start + m.end()
            break
    width = len(text[start:]) - len(text[start:].lstrip(" \t"))
    end = text.find("\n", at)
    if end < 0:
        return at, len(text)
    body = at
    stack = [width]
    for m in re.finditer(r"([ \t]*)([^\n]*)(?:\n|\Z)", text[end + 1 :]):
        if m.group(2).strip():
            indent = len(m.group(1))
            if indent <= stack[0]:
                break
            while indent < stack[-1]:
                stack.pop()
            if indent > stack[-1]:
                stack.append(indent)
            at = end + 1 + m.end()
        if end + 1 + m.end() >= len(text):
            break
    return body, max(at, end)


def _keyword_end(text: str, start: int) -> int:
    depth = 0
    for m in _ENDS.finditer(text, start):
        word = m.group()
        if word == "end":
            depth -= 1
            if depth == 0:
                return m.end()
        elif word.isalpha() and not (word in ("do",) and depth and re.search(r"\b(?:while|until|for)\b[^\n]*$", text[start : m.start()].rsplit("\n", 1)[-1])):
            depth += 1
    return len(text)


def _comment_above(lines: list[str], at: int) -> str | None:
    """Comment lines that end within MAX_DISTANCE lines above line ``at``, annotations aside."""
    k = at - 1
    while k >= 0 and _NOTED.match(lines[k]):
        k -= 1
    blank = 0
    while k >= 0 and not lines[k].strip() and blank < MAX_DISTANCE - 1:
        k, blank = k - 1, blank + 1
    if k < 0:
        return None
    last = lines[k].strip()
    if last.endswith("*/"):
        first = k
        while first >= 0 and "/*" not in lines[first]:
            first -= 1
        return "\n".join(lines[max(first, 0) : k + 1]) if first >= 0 and lines[first].lstrip().startswith("/*") else None
    first = k + 1
    while first > 0 and re.match(r"[ \t]*(?://|#(?!!?\[)|--)", lines[first - 1]):
        first -= 1
    return "\n".join(lines[first : k + 1]) or None


def extract_functions(text: str, family: str) -> Iterator[tuple[str, int, int, str, str, str | None]]:
    """(name, first line, last line, signature, code, comment) of each function; lines count from 1."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines: list[str] | None = None
    for m in SIGNATURES[family].finditer(text):
        start = m.start()
        if lines is None:
            lines = text.split("\n")
        if family == "python":
            body, end = _indent_end(text, start)
            signature, doc = text[start:body], _DOCSTRING.match(text, body)
            comment = doc.group(1) if doc and doc.end() <= end else None
        else:
            end = _keyword_end(text, start) if family in ("ruby", "lua") else _brace_end(text, start)
            stop = text.find("{" if family not in ("ruby", "lua") else "\n", m.end())
            signature, comment = text[start : stop if 0 <= stop <= end else end], None
        line = text.count("\n", 0, start)
        if comment is None:
            comment = _comment_above(lines, line)
        code = text[start:end].rstrip()
        yield m.group("name"), line + 1, line + 1 + code.count("\n"), signature.strip(), code, comment


def heading_comment(source: str) -> str | None:
    """The comment or docstring that heads the source of one function."""
    head = _HEAD.match(source)
    if head:
        return head.group(1)
    if family_of(source) == "python":
        return next(extract_functions(source, "python"))[5]
    return None


def strip_marks(comment: str) -> str:
    """Comment text without its marks."""
    return _MARKS.sub("", comment.strip()).strip()


# Words that say nothing about a function.
FILLER = frozenset(
    "a an the this that these it its is are was be to of for in on at by with and or from into as method function func procedure"
    " class member helper constructor getter setter does do will used use simply just given here".split()
)
PLACEHOLDER = frozenset(
    "todo tbd fixme xxx hack wip n na none null nil undocumented placeholder description summary doc docs documentation document"
    " documented comment comments write add insert missing no not yet stub auto generated autogenerated automatically see above"
    " below me inheritdoc later rename fill 待补充 待定 待办 暂无 无 说明 描述 注释".split()
)
_RIGHTS = re.compile(r"(?i)^\W*(?:copyright\b|\(c\)|©|spdx-|licen[sc]e\s*:|licen[sc]ed\s+under|released\s+under|all\s+rights\s+reserved)")
_TAG_LINE = re.compile(r"^\s*(?:@\w+|:\w+[^:\n]*:|\\(?:param|return|brief)\b)")
_INLINE = re.compile(r"\{@\w+[^}]*\}|</?\w+[^>]*>|&\w+;")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_WORD = re.compile(r"[^\W_]+(?:'\w+)?")


def _same_word(word: str, part: str) -> bool:
    """Equal but for an English ending."""
    if word == part:
        return True
    for end in ("s", "es", "d", "ed", "ing", "er", "ers"):
        if word == part + end or (part.endswith("e") and word == part[:-1] + end):
            return True
        if part.endswith("y") and word == part[:-1] + "i" + end:
            return True
        if part and word == part + part[-1] + end:
            return True
    return part.endswith("s") and word == part[:-1]


def is_trivial(comment: str, name: str | None) -> bool:
    """True if nothing is said: only placeholders, tags, markup, rules, a rights notice, or the name's own words."""
    lines = []
    for line in strip_marks(comment).split("\n"):
        if _TAG_LINE.match(line) or _RIGHTS.match(line):
            continue
        lines.append(line)
    words = [w.lower() for w in _WORD.findall(_INLINE.sub(" ", "\n".join(lines)))]
    parts: list[str] | None = None
    for word in words:
        if word in FILLER or word in PLACEHOLDER:
            continue
        if parts is None:
            parts = [p.lower() for p in _NAME_PARTS.findall(name or "")]
            parts.append((name or "").lower().replace("_", ""))
        if not any(_same_word(word, p) for p in parts if p):
            return False
    return True


def pair_of(name: str | None, signature: str | None, doc: str | None, source: str) -> tuple[str | None, str, str] | None:
    """(signature, code, description) of one function, None if its documentation is absent or trivial.

    The signature is found by its regular expression, the body by its stack; without a
    documentation column the comment within MAX_DISTANCE lines above the signature counts, else the
    docstring, else (for a form that no pattern knows) the comment that heads the source.
    """
    family = family_of(source)
    first = next(extract_functions(source, family), None) if family else None
    comment = doc
    if comment is None and first is not None:
        lines = source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        comment = _comment_above(lines, first[1] - 1) or first[5]
    if comment is None:
        comment = heading_comment(source)
    if comment is None or is_trivial(comment, name if name is not None else first[0] if first else None):
        return None
    return signature if signature and signature.strip() else first[3] if first else None, first[4] if first else source.strip(), strip_marks(comment)


_BLANK = r"^\s*$"
_PAIR = "method_id long, at long, tie long, signature string, code string, description string"


def _pairs(whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [pair_of(*row) if row[3] is not None else None for row in zip(b["name"], b["signature"], b["doc"], b["source"])]
            out = pd.DataFrame({"method_id": b["id"], "at": b["at"], "tie": b["tie"]})
            if whole:
                out["signature"], out["code"], out["description"] = ([f[i] if f else None for f in found] for i in range(3))
            else:
                out["paired"] = [f is not None for f in found]
            yield out

    return run


def _versions(methods: DataFrame) -> DataFrame:
    """Versions of methods; of those with one time the greatest hash of the content is the current one."""
    has_code = F.col("source").isNotNull() & ~F.col("source").rlike(_BLANK)
    return methods.where("id is not null").select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**63))).alias("at"),
        F.xxhash64("name", "signature", "doc_comment", "source").alias("tie"), "name", "signature",
        F.when(~F.col("doc_comment").rlike(_BLANK), F.col("doc_comment")).alias("doc"), F.when(has_code, F.col("source")).alias("source"),
    )


def documented_methods(methods: DataFrame) -> DataFrame:
    """method_id of every method whose current row pairs code with a description.

    Rows are paired where they lie; only (id, time, hash, verdict) is shuffled to find current rows.
    """
    judged = spread(_versions(methods)).mapInPandas(_pairs(False), "method_id long, at long, tie long, paired boolean")
    last = judged.groupBy("method_id").agg(F.max(F.struct("at", "tie", "paired")).alias("last"))
    return last.where("last.paired").select("method_id")


def method_pairs(methods: DataFrame) -> DataFrame:
    """method_id, signature, code (without its comment), description (without marks) of each documented method."""
    pairs = spread(_versions(methods)).mapInPandas(_pairs(True), _PAIR)
    last = pairs.groupBy("method_id").agg(F.max(F.struct("at", "tie", "signature", "code", "description")).alias("last"))
    return last.where("last.description is not null").select("method_id", "last.signature", "last.code", "last.description")


def _from_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "name", "start_line", "end_line", "signature", "code", "description"]
    for b in batches:
        rows = []
        for file_id, extension, content in zip(b.file_id, b.extension, b.content):
            for name, first, last, signature, code, comment in extract_functions(content, FAMILY[extension]):
                if comment is not None and not is_trivial(comment, name):
                    rows.append((file_id, name, first, last, signature, code, strip_marks(comment)))
        yield pd.DataFrame(rows, columns=columns)


def file_pairs(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Documented functions found in whole source files, with their lines."""
    sources = texts.where("content is not null").select("file_id", "content")
    joined = sources.repartition(busy_partitions(texts.sparkSession), "file_id").join(
        file_paths(files).select(F.col("id").alias("file_id"), "extension"), "file_id"
    ).where(F.col("extension").isin(list(FAMILY)))
    return joined.select("file_id", "extension", "content").mapInPandas(
        _from_files,
        "file_id long, name string, start_line int, end_line int, signature string, code string, description string",
    )
