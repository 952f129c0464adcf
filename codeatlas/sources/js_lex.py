"""A masking scanner for JavaScript, TypeScript and JSX.

mask() keeps the length of a text and blanks what isn't code: comments, the inside of strings, templates and regular expressions, and the text between JSX
tags. Names, brackets and punctuation stay where they are, so that patterns can be matched on the masked text and read from the original at the same offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_BEFORE_EXPRESSION = frozenset("return typeof case in of do else void delete throw new await yield default extends instanceof".split())
_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")


@dataclass
class Masked:
    text: str
    code: str = ""
    strings: dict[int, tuple[int, str]] = field(default_factory=dict)  # start of a literal -> (end, value)
    jsx: list[int] = field(default_factory=list)  # starts of elements and fragments
    attributes: list[tuple[int, str, int, int]] = field(default_factory=list)  # (offset, name, start and end of an {expression})
    containers: set[int] = field(default_factory=set)  # places of the { of expressions in JSX


class _Scanner:
    def __init__(self, text: str, jsx: bool):
        self.t, self.n, self.jsx = text, len(text), jsx
        self.out = list(text)
        self.m = Masked(text)

    def blank(self, a: int, b: int) -> None:
        for i in range(a, min(b, self.n)):
            if self.out[i] != "\n":
                self.out[i] = " "

    def string(self, i: int) -> int:
        q, j = self.t[i], i + 1
        while j < self.n and self.t[j] != q and self.t[j] != "\n":
            j += 2 if self.t[j] == "\\" else 1
        self.m.strings[i] = (min(j + 1, self.n), self.t[i + 1 : j])
        self.blank(i + 1, j)
        return min(j + 1, self.n)

    def template(self, i: int) -> int:
        j = at = i + 1
        plain = True
        while j < self.n and self.t[j] != "`":
            if self.t[j] == "\\":
                j += 2
            elif self.t.startswith("${", j):
                plain = False
                self.blank(at, j)
                j = at = self.code(j + 2, "}")
            else:
                j += 1
        self.blank(at, j)
        if plain:
            self.m.strings[i] = (min(j + 1, self.n), self.t[i + 1 : j])
        return min(j + 1, self.n)

    def regex(self, i: int) -> int | None:
        j, cls = i + 1, False
        while j < self.n and self.t[j] != "\n":
            c = self.t[j]
            if c == "\\":
                j += 1
            elif c == "[":
                cls = True
            elif c == "]":
                cls = False
            elif c == "/" and not cls:
                self.blank(i + 1, j)
                return j + 1
            j += 1
        return None

    def expression_next(self, i: int) -> bool:
        """Whether an expression, not an operator, may begin at i."""
        j = i - 1
        while j >= 0 and self.out[j].isspace():
            j -= 1
        if j < 0:
            return True
        c = self.out[j]
        if c.isalnum() or c in "_$":
            k = j
            while k >= 0 and (self.out[k].isalnum() or self.out[k] in "_$"):
                k -= 1
            return "".join(self.out[k + 1 : j + 1]) in _BEFORE_EXPRESSION
        return c not in ")]}\"'`"

    def code(self, i: int, end: str | None) -> int:
        """Scans code from i to the matching `end` bracket, or to the end of the text; returns the place after it."""
        depth = 0
        while i < self.n:
            c = self.t[i]
            if c == "/" and self.t.startswith("//", i):
                j = self.t.find("\n", i)
                j = self.n if j < 0 else j
                self.blank(i, j)
                i = j
            elif c == "/" and self.t.startswith("/*", i):
                j = self.t.find("*/", i + 2)
                j = self.n if j < 0 else j + 2
                self.blank(i, j)
                i = j
            elif c in "\"'":
                i = self.string(i)
            elif c == "`":
                i = self.template(i)
            elif c == "/" and self.expression_next(i) and (j := self.regex(i)):
                i = j
            elif c == "<" and self.jsx and self.expression_next(i) and (i + 1 < self.n) and (self.t[i + 1] == ">" or _TAG_NAME.match(self.t, i + 1)) and (j := self.element(i)):
                i = j
            elif c in "({[":
                depth += 1
                i += 1
            elif c in ")}]":
                if depth == 0 and c == end:
                    return i + 1
                depth = max(0, depth - 1)
                i += 1
            else:
                i += 1
        return i

    def element(self, i: int) -> int | None:
        """Scans a JSX element at i; None if it doesn't look like one."""
        saved = len(self.m.jsx)
        self.m.jsx.append(i)
        j = i + 1
        if (m := _TAG_NAME.match(self.t, j)) is not None:
            j = m.end()
        while j < self.n:
            c = self.t[j]
            if c.isspace():
                j += 1
            elif self.t.startswith("/>", j):
                return j + 2
            elif c == ">":
                return self.children(j + 1)
            elif c == "{":
                j = self.code(j + 1, "}")
            elif (m := _TAG_NAME.match(self.t, j)) is not None:
                name, at, j = m[0], j, m.end()
                if j < self.n and self.t[j] == "=":
                    j += 1
                    if j < self.n and self.t[j] in "\"'":
                        end = self.t.find(self.t[j], j + 1)
                        self.m.strings[j] = (end + 1, self.t[j + 1 : end])
                        self.blank(j + 1, end)
                        j = end + 1 if end > 0 else self.n
                    elif j < self.n and self.t[j] == "{":
                        start = j + 1
                        self.m.containers.add(j)
                        j = self.code(start, "}")
                        self.m.attributes.append((at, name, start, j - 1))
                    else:
                        break
            else:
                break
        del self.m.jsx[saved:]
        return None

    def children(self, i: int) -> int:
        at = i
        while i < self.n:
            c = self.t[i]
            if c == "{":
                self.blank(at, i)
                self.m.containers.add(i)
                i = at = self.code(i + 1, "}")
            elif self.t.startswith("</", i):
                self.blank(at, i)
                j = self.t.find(">", i)
                return self.n if j < 0 else j + 1
            elif c == "<" and (j := self.element(i)):
                self.blank(at, i)
                i = at = j
            else:
                i += 1
        self.blank(at, i)
        return i


def mask(text: str, path: str = "x.tsx") -> Masked:
    s = _Scanner(text, not path.endswith(".ts"))
    s.code(0, None)
    s.m.code = "".join(s.out)
    return s.m


def matching(code: str, i: int) -> int:
    """The place after the bracket that closes the one at i, in masked code."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for j in range(i, len(code)):
        if code[j] in pairs:
            depth += 1
        elif code[j] in ")]}":
            depth -= 1
            if depth == 0:
                return j + 1
    return len(code)
