"""Literals that nest or depend on what is before them, as plain ones: formatted strings, templates, regular expressions."""

from __future__ import annotations

import re

#: A prefix of a formatted string with its quote.
FORMATTED = re.compile(r"(?i)\b(?:[ft]r?|r[ft])[\"']")
_NEXT = re.compile(r"#[^\n]*|(?i:\b(?:[ft]r?|r[ft]))(?=[\"'])|\"{3}|'{3}|[\"'()\[\]{}:]")
_PLAIN = {q: re.compile(rf"(?:[^\\]|\\[\s\S])*?{q}" if len(q) == 3 else rf"(?:[^\\\n{q}]|\\[\s\S])*+{q}") for q in ("'" * 3, '"' * 3, "'", '"')}


def _quote(text: str, at: int) -> str:
    return text[at : at + 3] if text[at : at + 3] in _PLAIN else text[at]


def plain_formats(text: str) -> str:
    """The text with every formatted string as a plain one of the same length; unchanged if one does not end."""
    out: list[str] = []
    at = kept = 0
    #: Open parts, innermost last: [quote, start] of a string, ["{", brackets open] of a field, [":"] of its format.
    parts: list[list] = []
    while at < len(text):
        inner = parts[-1] if parts else None
        if inner is None or inner[0] == "{":
            m = _NEXT.search(text, at)
            if not m:
                break
            token, at = m.group(), m.end()
            if token[0].isalpha():
                parts.append([_quote(text, at), at])
                at += len(parts[-1][0])
            elif token in _PLAIN:
                closed = _PLAIN[token].match(text, at)
                if not closed:
                    return text
                at = closed.end()
            elif inner and token in ("(", "[", "{"):
                inner[1] += 1
            elif inner and token in (")", "]", "}") and inner[1]:
                inner[1] -= 1
            elif inner and token == "}":
                parts.pop()
            elif inner and token == ":" and not inner[1]:
                parts.append([":"])
            continue
        quote = next(p[0] for p in reversed(parts) if p[0] not in ("{", ":"))
        char = text[at]
        if char == "\\" and text[at + 1 : at + 2] not in ("{", "}"):
            at += 2
        elif char == "{":
            if inner[0] != ":" and text.startswith("{{", at):
                at += 2
            else:
                parts.append(["{", 0])
                at += 1
        elif char == "}" and inner[0] == ":":
            del parts[-2:]
            at += 1
        elif inner[0] != ":" and text.startswith(quote, at):
            at += len(quote)
            start = parts.pop()[1]
            if not parts:
                out += [text[kept:start], quote, "_" * (at - start - 2 * len(quote)), quote]
                kept = at
        elif char == "\n" and len(quote) == 1:
            return text
        else:
            at += 1
    return "".join(out) + text[kept:]


_SCRIPT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[`{}/]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{)")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/\w*")
#: The end of code after which a slash divides; after these words it begins a regular expression all the same.
_OPERAND = re.compile(r"(?:([\w$]+)|[)\]\"'`])\Z")
_WORDS = {"return", "typeof", "case", "of", "in", "do", "else", "void", "delete", "throw", "new", "instanceof", "await", "yield"}


def plain_script(text: str) -> str:
    """Script text, of the same length, with templates without fields, however they nest, and regular expressions as strings.

    What a slash means follows from the code before it, comments aside.
    """
    out: list[str] = []
    at = kept = start = 0
    before = ""
    open_: list[int] = []  # braces open in each template field, innermost last
    while m := _SCRIPT.search(text, at):
        code = text[at : m.start()].rstrip()
        before = code[-20:] or before
        token, at = m.group(), m.end()
        if token[:2] in ("//", "/*"):
            continue
        if token == "/":
            operand = _OPERAND.search(before)
            literal = None if operand and operand.group(1) not in _WORDS else _REGEX.match(text, m.start())
            before = token
            if literal:
                at, before = literal.end(), '"'
                if not open_:
                    out += [text[kept : m.start()], '"', "_" * (at - m.start() - 2), '"']
                    kept = at
            continue
        before = token[-1]
        if token == "`" or (token == "}" and open_ and open_[-1] == 0):
            if token == "}":
                open_.pop()
            elif not open_:
                start = at
            part = _TEMPLATE.match(text, at)
            if not part:
                return text
            at = part.end()
            before = "`" if text[at - 1] == "`" else "{"
            if before == "{":
                open_.append(0)
            elif not open_:
                out += [text[kept:start], re.sub(r"[^\n]", "_", text[start : at - 1]), "`"]
                kept = at
        elif open_ and token == "{":
            open_[-1] += 1
        elif open_ and token == "}":
            open_[-1] -= 1
    return "".join(out) + text[kept:]
