"""Declarations and calls found in source text line by line: a scanner with per-language patterns.

Literals and comments are blanked first (keeping lengths), so nothing inside them counts. A
declaration takes the comment lines just above it; a method belongs to the class declared last
above it; a call is attributed to the method it stands in, which makes the call graph usable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|export|default|pub(?:\([^)]*\))?|data|inline|suspend|synchronized|native|unsafe|const|extern|partial|readonly|local)\s+)*"
_NAME = r"[A-Za-z_$][\w$]*"


def _spec(classes: str, functions: str, comment: str = "//") -> tuple[re.Pattern, re.Pattern, str]:
    """Patterns of a language: words that declare a class, and the form of a function head."""
    head = {
        "fn": rf"^\s*{_MODIFIERS}(?:fn|func|fun|def|function|sub|defp?|let(?:\s+rec)?)\s+(?:\([^)]*\)\s*)?(?:{_NAME}[.:])?(?P<name>{_NAME}[?!]?)",
        "typed": rf"^\s*(?:@\w+\s+)*{_MODIFIERS}(?:<[^>]+>\s+)?(?!(?:return|new|else|throw|case|package|import)\b)[\w$.]+(?:<[^;(){{}}]*>)?[\[\]*&]*\s+[*&]*(?P<name>{_NAME})\s*\((?=[^;]*$)",
        "script": rf"^\s*{_MODIFIERS}(?:function\s*\*?\s*)?(?P<name>(?!(?:if|for|while|switch|catch|return|function|with)\b){_NAME})\s*(?:<[^>]*>)?\((?=[^;]*\)?[^;]*\{{\s*$)",
    }[functions]
    kinds = classes.replace(" ", "|") or r"(?!)"
    return re.compile(rf"^\s*{_MODIFIERS}(?:type\s+(?P<before>{_NAME})\s+(?P<kind2>struct|interface)|(?P<kind>{kinds})\s+(?P<name>{_NAME}))"), re.compile(head), comment


SPECS = {
    "go": _spec("", "fn"), "rust": _spec("struct enum trait impl", "fn"), "py": _spec("class", "fn", "#"), "ruby": _spec("class module", "fn", "#"),
    "kotlin": _spec("class interface object enum", "fn"), "swift": _spec("class struct enum protocol extension", "fn"), "scala": _spec("class object trait", "fn"),
    "php": _spec("class interface trait enum", "fn"), "lua": _spec("", "fn", "--"), "bash": _spec("", "fn", "#"), "elixir": _spec("defmodule", "fn", "#"),
    "ocaml": _spec("module class type", "fn", "(*"), "groovy": _spec("class interface trait enum", "typed"), "java": _spec("class interface enum record @interface", "typed"),
    "csharp": _spec("class interface struct enum record", "typed"), "cpp": _spec("class struct enum", "typed"), "c": _spec("struct enum union", "typed"),
    "ts": _spec("class interface enum type namespace", "script"), "js": _spec("class", "script"), "svelte": _spec("class", "script"),
    "protobuf": _spec("message enum service", "fn"), "sql": _spec("table view", "fn", "--"), "hcl": _spec("resource module variable", "fn", "#"),
}
_CLASS_TYPE = {"interface": "INTERFACE", "@interface": "INTERFACE", "protocol": "INTERFACE", "trait": "ABSTRACT", "enum": "ENUM", "record": "OBJECT", "object": "OBJECT", "module": "OBJECT"}
_CALL = re.compile(rf"({_NAME}(?:(?:\.|::|->){_NAME})*)\s*\(")
# Names before a parenthesis that are no calls.
NO_CALLS = frozenset((
    "if", "for", "while", "switch", "return", "catch", "throw", "new", "delete", "typeof", "instanceof", "import", "print", "len", "cap", "make", "append", "copy",
    "close", "panic", "recover", "range", "defer", "go", "assert", "raise", "yield", "await", "async", "super", "this", "self", "fun", "val", "var", "when", "is",
    "in", "suspend", "require", "check", "error", "TODO", "println", "fn", "let", "mut", "match", "impl", "trait", "struct", "enum", "use", "mod", "sizeof",
    "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast", "printf", "func", "guard", "repeat", "where", "associatedtype", "fatalError", "echo", "print_r",
    "var_dump", "isset", "empty", "unset", "die", "exit", "puts", "require_relative", "attr_accessor", "attr_reader", "attr_writer", "loop", "cd", "source", "local",
    "export", "eval", "IO.puts", "IO.inspect", "IO.gets", "Enum.map", "Enum.filter", "Enum.reduce", "Enum.each", "Map.get", "Map.put", "String.length",
    "print_endline", "print_string", "print_int", "List.map", "List.filter", "List.fold_left", "List.iter", "Printf.printf", "failwith", "rec", "done", "pcall",
    "tostring", "tonumber", "rawget", "rawset", "string.format", "string.len", "table.insert", "table.remove", "math.floor", "math.max", "sprintf", "size", "each",
    "collect", "findAll", "inject",
))
# Words that declare or join, which no pattern above takes for a head.
_NO_HEADS = frozenset(("def", "class", "function", "elif", "except", "with", "not", "and", "or", "lambda"))
_BLANK = {
    "hash": re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", re.S),
    "slash": re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
    "dash": re.compile(r"--[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S),
}


def blank_literals(text: str, language: str) -> str:
    """Text with literals and comments turned to spaces of the same length; line breaks stay."""
    mark = SPECS.get(language, (None, None, "//"))[2]
    pattern = _BLANK["hash" if mark == "#" else "dash" if mark == "--" else "slash"]
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def scan(text: str, language: str) -> Iterator[tuple[str, str, str, str | None, int, str | None]]:
    """(kind, name, type, owner, line, doc): kind class, method or call; owner is the class, for a call the method."""
    if language not in SPECS:
        return
    klass, function, mark = SPECS[language]
    text = text.replace("\r\n", "\n")
    owner: str | None = None
    method: str | None = None
    doc: list[str] = []
    for number, (line, clean) in enumerate(zip(text.split("\n"), blank_literals(text, language).split("\n")), 1):
        bare = line.strip()
        if bare and not clean.strip() and bare.startswith((mark, "/*", "*", '"""')):
            doc.append(re.sub(r"^(?:///?|/\*+|\*+/?|#+|--+|\(\*+)\s?|\s*\*+/$", "", bare).strip())
            continue
        found = klass.match(clean)
        head = None if found else function.match(clean)
        if found:
            owner, method = found.group("name") or found.group("before"), None
            kind = found.group("kind") or found.group("kind2")
            yield "class", owner, _CLASS_TYPE.get(kind, "CLASS"), None, number, "\n".join(doc).strip() or None
        elif head and head.group("name") not in NO_CALLS | _NO_HEADS:
            method = head.group("name")
            yield "method", method, "", owner, number, "\n".join(doc).strip() or None
        for call in _CALL.finditer(clean):
            name = call.group(1)
            if len(name) > 1 and name not in NO_CALLS and name not in _NO_HEADS and not (head and call.start(1) == head.start("name")):
                yield "call", name, "direct", method, number, None
        if bare and not bare.startswith("@"):
            doc = []


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "kind", "name", "type", "owner", "line", "doc"]
    for b in batches:
        rows = [(i, *row) for i, lang, text in zip(b.file_id, b.language, b.content) for row in scan(text, lang)]
        yield pd.DataFrame(rows, columns=columns)


def declarations(texts: DataFrame) -> DataFrame:
    """file_id, kind, name, type, owner, line, doc from (file_id, language, content)."""
    rows = texts.where("content is not null").select("file_id", "language", "content")
    return rows.mapInPandas(_scan_batches, "file_id long, kind string, name string, type string, owner string, line int, doc string")
