"""Parsing-expression grammars over token classes, evaluated group by group.

A source text becomes a string of one character per token. Bracketed groups are parsed from
the inside out; a parsed group is replaced by one character that says which roles (block,
arguments, type list, ...) its content satisfies, so only type arguments need recursion. Each level is parsed by a packrat parser (memo by node
and position); above it stands a second memo by content, for groups and for the items of a
sequence, which all files of a worker share: equal shapes are parsed once.

``furthest`` gives the position that no alternative could pass.

Notation: ``a b`` sequence, ``a / b`` ordered choice, ``* + ?`` greedy, ``!a &a`` lookahead,
``'if'`` a token, ``ID`` a token kind, ``END`` the end of the text, ``@role`` a group having the
role, ``name`` a rule.
"""

from __future__ import annotations

import re
import sys

#: Calls that one level of type arguments or of statements without braces takes at most, and the tokens that begin one.
DEEP, NESTING = 100, ("<", "if", "for", "while", "lambda", "?", "extends", ":", "=>")
_LEX = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|(@\w+)|([A-Za-z_]\w*)|([()/*+?!&|]))")

#: Stands for the end of a text in a memo key; no token has it.
FINISH = "\0"
#: First code point of the group characters of each bracket; the role mask is added to it.
GROUP_BASE = {"(": 0xE000, "[": 0xE200, "{": 0xE400, "<": 0xE800}


class Grammar:
    """tokens: text or kind -> character; roles: bracket -> {role: rule}; start: rule of a whole text; covers: role -> roles that serve wherever it does."""

    def __init__(self, rules: str, tokens: dict[str, str], roles: dict[str, dict[str, str]], start: str, ends: str = ";", covers: dict[str, tuple[str, ...]] | None = None):
        self.tokens, self.start, self.covers = tokens, start, covers or {}
        self.rules: dict[str, tuple] = {}
        for line in re.split(r"\n(?=\w+ +=)", rules.strip()):
            name, body = line.split("=", 1)
            self.rules[name.strip()] = self._parse(body)
        self.roles = {b: list(r.items()) for b, r in roles.items()}
        self.role_chars: dict[str, str] = {}
        for bracket, named in self.roles.items():
            for bit, (role, _) in enumerate(named):
                at = [GROUP_BASE[bracket] + m for m in range(1 << len(named)) if m >> bit & 1]
                self.role_chars[role] = self.role_chars.get(role, "") + "".join(map(chr, at))
        self._firsts: dict[tuple, tuple[frozenset, bool]] = {}
        self.memo: dict[str, str] = {}
        self.items: dict[tuple[str, str], int] = {}
        groups = "".join(f"{chr(GROUP_BASE[b])}-{chr(GROUP_BASE[b] + 0x3FF)}" for b in "{<")
        self.boundary = re.compile("[" + "".join(re.escape(tokens[e]) for e in ends.split()) + groups + "]")

    def _parse(self, body: str) -> tuple:
        items = [next((i, g) for i, g in enumerate(m.groups()) if g) for m in _LEX.finditer(body)]
        at = 0

        def choice() -> tuple:
            nonlocal at
            options = [sequence()]
            while at < len(items) and items[at] == (3, "/"):
                at += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else ("/", *options)

        def sequence() -> tuple:
            nonlocal at
            parts = []
            while at < len(items) and items[at] not in ((3, "/"), (3, ")")):
                parts.append(prefixed())
            return parts[0] if len(parts) == 1 else (" ", *parts)

        def prefixed() -> tuple:
            nonlocal at
            if items[at] in ((3, "!"), (3, "&")):
                at += 1
                return (items[at - 1][1], prefixed())
            if items[at] == (3, "("):
                at += 1
                node = choice()
                at += 1
            else:
                kind, text = items[at]
                at += 1
                if kind == 0:
                    node = ("t", text)
                elif kind == 1:
                    node = ("@", text[1:])
                elif text == "END":
                    node = ("$",)
                else:
                    node = ("t", text) if text.isupper() else ("r", text)
            while at < len(items) and items[at] in ((3, "*"), (3, "+"), (3, "?")):
                node = (items[at][1], node)
                at += 1
            return node

        return choice()

    def _first(self, node: tuple) -> tuple[frozenset, bool]:
        """(characters a match may begin with, whether it may consume nothing)."""
        known = self._firsts.get(node)
        if known is not None:
            return known
        kind = node[0]
        if kind == "t":
            out = (frozenset(self.tokens[node[1]]), False)
        elif kind == "@":
            out = (frozenset(self.role_chars[node[1]]), False)
        elif kind == "r":
            out = self._first(self.rules[node[1]])
        elif kind == " ":
            chars, empty = frozenset(), True
            for part in node[1:]:
                more, empty = self._first(part)
                chars |= more
                if not empty:
                    break
            out = (chars, empty)
        elif kind == "/":
            parts = [self._first(n) for n in node[1:]]
            out = (frozenset().union(*(c for c, _ in parts)), any(e for _, e in parts))
        elif kind in "*+?":
            chars, empty = self._first(node[1])
            out = (chars, empty or kind != "+")
        else:
            out = (frozenset(), True)
        self._firsts[node] = out
        return out

    def _parser(self, text: str):
        """Packrat evaluation over one text: (run(node, at) -> end or -1, furthest failure, furthest look); memo by node and position."""
        memo: dict[tuple, int] = {}
        far, high, size, first = 0, 0, len(text), self._first
        tokens, roles, rules = self.tokens, self.role_chars, self.rules
        depth = 1000 + DEEP * sum(text.count(tokens.get(t, FINISH)) for t in NESTING)
        if depth > sys.getrecursionlimit():
            sys.setrecursionlimit(depth)

        def run(node: tuple, at: int) -> int:
            nonlocal far, high
            if at > high:
                high = at
            kind = node[0]
            if kind == "t" or kind == "@":
                if at < size and text[at] in (tokens if kind == "t" else roles)[node[1]]:
                    return at + 1
                if at > far:
                    far = at
                return -1
            chars, empty = first(node)
            if not empty and (at >= size or text[at] not in chars):
                if at > far:
                    far = at
                return -1
            key = (id(node), at)
            end = memo.get(key)
            if end is None:
                end = memo[key] = step(kind, node, at)
            return end

        def step(kind: str, node: tuple, at: int) -> int:
            nonlocal far
            if kind == "$":
                if at < size:
                    far = max(far, at)
                    return -1
                return at
            if kind == "r":
                return run(rules[node[1]], at)
            if kind == " ":
                for part in node[1:]:
                    at = run(part, at)
                    if at < 0:
                        return -1
                return at
            if kind == "/":
                for option in node[1:]:
                    end = run(option, at)
                    if end >= 0:
                        return end
                return -1
            if kind == "?":
                return max(at, run(node[1], at))
            if kind in "*+":
                count = 0
                while (end := run(node[1], at)) > at:
                    at, count = end, count + 1
                return at if count or kind == "*" else -1
            kept, end = far, run(node[1], at)
            far = kept
            return at if (end >= 0) == (kind == "&") else -1

        return run, lambda: far, lambda: high

    def matches(self, rule: str, text: str) -> bool:
        """True if the rule consumes the whole text.

        A rule ending in a repeated item (statements, members, arms) is walked item by item:
        an item whose text up to a boundary, and one character more, was seen before is not
        parsed again. At the end of the text that character is ``FINISH``: a shape that ends a
        text says nothing of the same shape with more behind it.
        """
        node = self.rules[rule]
        run, _, looked = self._parser(text)
        parts = node[1:] if node[0] == " " else (node,)
        last = parts[-1]
        if last[0] not in "*+" or last[1][0] != "r":
            return run(node, 0) == len(text)
        at, item, seen, size, padded = 0, last[1], self.items, len(text), text + FINISH
        for part in parts[:-1]:
            at = run(part, at)
            if at < 0:
                return False
        if last[0] == "+" and at == size:
            return False
        name = item[1]
        ends = [m.end() for m in self.boundary.finditer(text, at)]
        if not ends or ends[-1] != size:
            ends.append(size)
        k = 0
        while at < size:
            while ends[k] <= at:
                k += 1
            j = k
            while j < len(ends):
                step = seen.get((name, padded[at : ends[j] + 1]))
                if step is None or step > 0:
                    break
                j += 1
            else:
                step = None
            if step is None:
                end = run(item, at)
                if end <= at:
                    return False
                if len(seen) > 300_000:
                    seen.clear()
                for e in ends[k:]:
                    if e >= end:
                        if e == end and looked() <= end:  # else it depends on more than its key
                            seen[name, padded[at : e + 1]] = end - at
                        break
                    seen[name, padded[at : e + 1]] = 0
                at = end
            else:
                at += step
        return True

    def group(self, text: str) -> str:
        """Character of a bracketed group given with its brackets (no brackets inside)."""
        char = self.memo.get(text)
        if char is None:
            bracket, close, inner = text[0], text[-1], text[1:-1]
            mask, has = 0, set()
            if bracket + close in ("()", "[]", "{}", "<>"):
                for bit, (role, rule) in enumerate(self.roles.get(bracket, ())):
                    if has.isdisjoint(self.covers.get(role, ())) and self.matches(rule, inner):
                        mask |= 1 << bit
                        has.add(role)
            if len(self.memo) > 400_000:
                self.memo.clear()
            char = self.memo[text] = chr(GROUP_BASE.get(bracket, 0xE000) + mask)
        return char

    def accepts(self, text: str) -> bool:
        """Whole text, all groups already replaced."""
        return self.matches(self.start, text)

    def furthest(self, rule: str, text: str) -> tuple[bool, int]:
        """(whole text consumed, index of the furthest token that no alternative could take)."""
        run, far, _ = self._parser(text)
        end = run(("r", rule), 0)
        return end == len(text), max(far(), end)
