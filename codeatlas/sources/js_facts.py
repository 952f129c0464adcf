"""Facts of one JavaScript or TypeScript file, read from its masked text."""

from __future__ import annotations

import bisect
import re

from .js_lex import Masked, mask, matching

_NAME = r"[A-Za-z_$][\w$]*"
_IMPORT = re.compile(r"\bimport\b(?!\s*[(.])")
_EXPORT = re.compile(r"\bexport\b")
_FUNCTION = re.compile(rf"\b(?:async\s+)?function\b\s*\*?\s*({_NAME})?\s*(?:<[^(]*>)?\s*(?=\()")
_ARROW = re.compile(r"=>")
_CLASS = re.compile(rf"\bclass\b\s*({_NAME})?([^{{]*)(?=\{{)")
_METHOD = re.compile(rf"(?:^|[;}}{{])\s*((?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*)\*?\s*({_NAME})\s*(?:<[^(]*>)?\s*(?=\()")
_CALL = re.compile(rf"(?<![\w$.])({_NAME})\s*(?:<[\w\s,.\[\]|]*>)?\s*(?=\()")
_IDENT = re.compile(rf"(?<![\w$])({_NAME})")
_HOOK = re.compile(rf"\b(?:const|let|var)\s*\[\s*({_NAME})\s*,\s*({_NAME})[^\]]*\]\s*(?::[^=]+)?=\s*(?:React\.)?(useState|useReducer)\b")
_EFFECT = re.compile(r"\b(?:React\.)?(useEffect|useLayoutEffect)\s*(?=\()")
_NOT_CALLS = frozenset("default export if for while switch catch function return typeof await import super constructor new async of in do else void delete throw case yield".split())
_COMPONENT = re.compile(r"^(React\.)?(Pure)?Component(<.*>)?$")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


_EXPORT_STAR = re.compile(rf"\s*(?:type\s+)?\*(?:\s*as\s+({_NAME}))?\s*from\b")
_EXPORT_LIST = re.compile(r"\s*(?:type\s+)?\{([^}]*)\}\s*(from\b)?")
_EXPORT_DEFAULT = re.compile(rf"\s*default\b\s*(async\s+)?(?:(?:abstract\s+)?(?:function\b\s*\*?|class\b)\s*({_NAME})?|({_NAME})\s*(?:;|\n|$))?")
_EXPORT_DECLARED = re.compile(
    rf"\s*(?:declare\s+)?(?:abstract\s+)?(async\s+)?(?:function\b\s*\*?|class|interface|type|enum|namespace)\s+({_NAME})|\s*(?:declare\s+)?(async\s+)?function\b\s*\*?\s*({_NAME})"
)
_EXPORT_VARIABLES = re.compile(r"\s*(?:declare\s+)?(?:const|let|var)\s+")
_VARIABLE = re.compile(rf"({_NAME})\s*!?\s*(?::[^=;\n]*(?:=>[^=;\n]*)*)?(?:=\s*(async\b))?")
_BOUND = re.compile(rf"({_NAME})\s*(?=[,}}\]=])")
_BLANK = re.compile(r"\s*")
#: What carries a statement on in its next line, and what leaves a line open.
_CONTINUED = re.compile(r"[,.=+\-*/%?:|&<>\[(]|in\b|of\b|as\b|instanceof\b|satisfies\b")
_OPEN_ENDED = re.compile(r"[,=+\-*/%?:|&<>(]\s*$")


class File:
    """All facts of a file, on demand."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.m: Masked = mask(text, path)
        self.code = self.m.code
        self.lines = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.lines, offset) + 1

    def _literal(self, at: int) -> tuple[str | None, int]:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        end_value = self.m.strings.get(at)
        return (end_value[1], end_value[0]) if end_value else (None, at)

    def imports(self) -> list[dict]:
        """Imports, then re-exports: decl, specifier, line, off, default_name, namespace_name, named."""
        out = []
        for m in _IMPORT.finditer(self.code):
            spec, _ = self._literal(m.end())
            row = {"decl": "import", "specifier": spec, "line": self.line(m.start()), "off": m.start(), "default_name": None, "namespace_name": None, "named": []}
            if spec is None:
                clause = re.compile(rf"\s*(?:type\s+(?!from\b|,))?(?:({_NAME})\s*,?\s*)?(?:\*\s*as\s+({_NAME})|\{{([^}}]*)\}})?\s*from\b").match(self.code, m.end())
                if not clause or not any(clause.groups()):
                    continue
                row["specifier"], _ = self._literal(clause.end())
                row["default_name"], row["namespace_name"], row["named"] = clause[1], clause[2], _named(clause[3])
            out.append(row)
        for m in _EXPORT.finditer(self.code):
            clause = re.compile(rf"\s*(?:type\s+)?(?:\*(?:\s*as\s+({_NAME}))?|\{{([^}}]*)\}})\s*from\b").match(self.code, m.end())
            if clause:
                spec, _ = self._literal(clause.end())
                out.append({"decl": "export", "specifier": spec, "line": self.line(m.start()), "off": m.start(), "default_name": None, "namespace_name": clause[1], "named": _named(clause[2])})
        return out

    def exports(self) -> list[dict]:
        """Exported names: name, local_name, from_specifier, is_star, is_default, is_async, line."""
        out = []

        def add(at, name, local=None, spec=None, star=False, default=False, is_async=False):
            out.append({"name": name, "local_name": local, "from_specifier": spec, "is_star": star, "is_default": default, "is_async": is_async, "line": self.line(at)})

        code = self.code
        for m in _EXPORT.finditer(code):
            at = m.end()
            if c := _EXPORT_STAR.match(code, at):
                add(m.start(), c[1], spec=self._literal(c.end())[0], star=c[1] is None)
            elif c := _EXPORT_LIST.match(code, at):
                spec = self._literal(c.end())[0] if c[2] else None
                for imported, local in _named(c[1]):
                    add(m.start(), local, imported, spec, default=local == "default")
            elif c := _EXPORT_DEFAULT.match(code, at):
                add(m.start(), "default", c[2] or c[3], default=True, is_async=bool(c[1]))
            elif c := _EXPORT_DECLARED.match(code, at):
                add(m.start(), c[2] or c[4], is_async=bool(c[1] or c[3]))
            elif c := _EXPORT_VARIABLES.match(code, at):
                for start in self._declarators(c.end()):
                    if v := _VARIABLE.match(code, start):
                        add(m.start(), v[1], is_async=bool(v[2]))
                    elif code[start : start + 1] in ("{", "["):
                        for name in _BOUND.findall(code, start, matching(code, start)):
                            add(m.start(), name)
        return out

    def _declarators(self, at: int) -> list[int]:
        """Where the declarators of a const, let or var begin: after commas outside of brackets, up to the statement's end."""
        code, out = self.code, []
        while True:
            at = _BLANK.match(code, at).end()
            out.append(at)
            typed, angles = False, 0  # within a type annotation, commas between < and > separate nothing
            while at < len(code) and (code[at] not in ",;" or angles):
                c = code[at]
                if c in "([{":
                    at = matching(code, at)
                    continue
                if c == "\n" and not angles and not _CONTINUED.match(code, _BLANK.match(code, at).end()) and not _OPEN_ENDED.search(code, max(0, at - 80), at):
                    return out
                if c == ":":
                    typed = True
                elif c == "=" and code[at + 1 : at + 2] != ">":
                    typed = False
                elif typed and c in "<>" and code[at - 1] != "=":
                    angles = max(0, angles + (1 if c == "<" else -1))
                at += 1
            if at >= len(code) or code[at] == ";":
                return out
            at += 1

    def _body(self, at: int) -> int | None:
        """The end of the braced body that follows a parameter list at `at`."""
        j = matching(self.code, at)
        c = re.compile(r"\s*(?::\s*[^={;]*(?:\{[^}]*\}[^={;]*)?)?(?=\{)").match(self.code, j)
        return matching(self.code, c.end()) if c else None

    def _params(self, at: int) -> list[tuple[str, str | None]]:
        inner = self.text[at + 1 : matching(self.code, at) - 1]
        out = []
        for part in _split(inner):
            name, _, note = part.partition(":")
            note = note.split("=")[0].strip()
            out.append((name.split("=")[0].strip().rstrip("?"), note or None))
        return [p for p in out if p[0]]

    def callables(self) -> list[dict]:
        """Functions with a body, in the order: declarations, methods of top-level classes, arrows, function expressions. Those without a name of their own or of the variable or
        property they are given to have name null."""
        groups: dict[str, list[dict]] = {"declaration": [], "method": [], "arrow": [], "expression": []}

        def add(group, kind, name, start, paren, end, body):
            back = re.compile(r"\s*:\s*([^={;]+?)\s*(?:=>|\{)").match(self.text, matching(self.code, paren)) if paren is not None else None
            groups[group].append({"group": group, "kind": kind, "name": name, "start_off": start, "end_off": end, "body_off": body, "start_line": self.line(start), "end_line": self.line(end - 1), "params": self._params(paren) if paren is not None else [], "return_type": back[1] if back else None, "has_jsx": any(start <= j < end for j in self.m.jsx), "top_level": self.depth(start) == 0})

        for m in _FUNCTION.finditer(self.code):
            end = self._body(m.end())
            if end is None:
                continue
            before = self.code[: m.start()].rstrip()
            statement = before == "" or before[-1] in ";}{" or re.search(r"\b(export|default)$", before) is not None or "\n" in self.code[len(before) : m.start()] and before[-1] not in "=(,:?&|+"
            if statement and m[1]:
                add("declaration", "function", m[1], m.start(), m.end(), end, m.end())
            else:
                add("expression", "function-expression", m[1] or self._given(m.start()), m.start(), m.end(), end, m.end())
        for m in _CLASS.finditer(self.code):
            if self.depth(m.start()) > 0:
                continue
            open_, close = m.end(), matching(self.code, m.end())
            at = open_
            while (k := _METHOD.search(self.code, at, close)) is not None:
                if self.depth(k.start(2)) == 1 and k[2] not in _NOT_CALLS | {"constructor"} and (end := self._body(k.end())):
                    add("method", "method", k[2], k.start(2), k.end(), end, k.end())
                    at = end - 1
                else:
                    at = k.end()
        for m in _ARROW.finditer(self.code):
            j = len(self.code[: m.start()].rstrip()) - 1
            if j < 0:
                continue
            if self.code[j] == ")":
                paren = self._opening(j)
                start = paren
            else:
                typed = re.search(rf"\)\s*:\s*[^()=;{{}}]+$", self.code[: j + 1])
                if typed:
                    paren = self._opening(typed.start())
                    start = paren
                else:
                    one = re.search(rf"({_NAME})$", self.code[: j + 1])
                    if not one:
                        continue
                    paren, start = None, one.start()
            lead = re.search(r"\basync\s*(?:<[^()]*>)?\s*$", self.code[:start])
            start = lead.start() if lead else start
            k = m.end()
            while k < len(self.code) and self.code[k].isspace():
                k += 1
            end = matching(self.code, k) if k < len(self.code) and self.code[k] in "{(" else self._expression_end(k)
            if k < len(self.code) and self.code[k] == "(":
                end = max(end, self._expression_end(end))
            add("arrow", "arrow", self._given(start), start, paren, end, k)
        rows = [r for g in groups.values() for r in sorted(g, key=lambda r: r["start_off"])]
        for r in rows:
            if r["kind"] == "arrow" and not r["params"] and (one := re.match(rf"(?:async\s+)?({_NAME})\s*=>", self.code[r["start_off"] : r["end_off"]])):
                r["params"] = [(one[1], None)]
        return [{"seq": k, **r} for k, r in enumerate(rows)]

    def _opening(self, j: int) -> int:
        depth = 0
        for i in range(j, -1, -1):
            if self.code[i] in ")]}":
                depth += 1
            elif self.code[i] in "([{":
                depth -= 1
                if depth == 0:
                    return i
        return 0

    def _given(self, start: int) -> str | None:
        """The variable or property that a function at `start` is assigned to."""
        before = self.code[:start].rstrip()
        m = re.search(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=$", before) or re.search(rf"(?:^|[{{,;\n])\s*(?:(?:public|private|protected|static|readonly)\s+)*({_NAME})\s*(?::[^=;{{}}]+)?[:=]$", before)
        return m[1] if m else None

    def _expression_end(self, k: int) -> int:
        depth = 0
        for j in range(k, len(self.code)):
            c = self.code[j]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if depth == 0:
                    return j
                depth -= 1
            elif depth == 0 and c in ",;\n" and (c != "\n" or not re.match(r"\s*[.?:&|+*]", self.code[j:])):
                return j
        return len(self.code)

    def depth(self, at: int) -> int:
        if not hasattr(self, "_depths"):
            self._depths, d = [], 0
            for c in self.code:
                d += c in "{"
                d -= c in "}"
                self._depths.append(d)
        return self._depths[at - 1] if at else 0

    def calls(self) -> list[dict]:
        """Calls of bare identifiers: callee, line, off, args_end, used (whether the value is)."""
        out = []
        for m in _CALL.finditer(self.code):
            before = self.code[: m.start()].rstrip()
            if m[1] in _NOT_CALLS or re.search(r"\b(function\s*\*?|new)$", before):
                continue
            end = matching(self.code, m.end())
            if re.match(r"\s*(?::[^=;{]*)?\{", self.code[end:]) and not re.search(r"[=(,:?&|!+]$|\breturn$", before) and self._is_method_head(m.start(), end):
                continue
            lead = re.sub(r"\bawait$", "", before).rstrip()
            statement = lead == "" or lead[-1] in ";{}" and not lead.endswith("${") and len(lead) - 1 not in self.m.containers or ("\n" in self.code[len(lead) : m.start()] and lead[-1] not in "=(,:?&|+.[!<>-*/")
            after = self.code[end:].lstrip(" \t")
            used = not (statement and (after == "" or after[0] in ";\n}"))
            out.append({"seq": len(out), "callee": m[1], "line": self.line(m.start()), "off": m.start(), "args_end": end, "used": used})
        return out

    def _is_method_head(self, start: int, end: int) -> bool:
        before = self.code[:start].rstrip()
        return before == "" or before[-1] in "{};" or bool(re.search(r"\b(async|static|public|private|protected|get|set|override)$", before))

    def identifiers(self) -> list[dict]:
        """Every identifier: name, line, off, is_import (within an import or re-export clause)."""
        spans = []
        for m in [*_IMPORT.finditer(self.code)]:
            c = re.compile(r"[^;'\"`]*").match(self.code, m.end())
            spans.append((m.start(), c.end()))
        return [{"name": m[1], "line": self.line(m.start()), "off": m.start(), "is_import": any(a <= m.start() < b for a, b in spans)} for m in _IDENT.finditer(self.code)]

    def hooks(self) -> list[dict]:
        """State hooks (value_name, setter_name) and effects (body span, deps or null)."""
        out = [{"hook": m[3], "value_name": m[1], "setter_name": m[2], "off": m.start(), "line": self.line(m.start()), "body_start": None, "body_end": None, "deps": None} for m in _HOOK.finditer(self.code)]
        for m in _EFFECT.finditer(self.code):
            end = matching(self.code, m.end())
            inner = self.code[m.end() + 1 : end - 1]
            parts = _split(inner)
            if not parts or ("=>" not in parts[0] and "function" not in parts[0]):
                continue
            deps = re.findall(rf"(?<![\w$.])({_NAME})", parts[1]) if len(parts) > 1 else None
            out.append({"hook": m[1], "value_name": None, "setter_name": None, "off": m.start(), "line": self.line(m.start()), "body_start": m.end() + 1, "body_end": m.end() + 1 + len(parts[0]), "deps": deps})
        return out

    def handlers(self) -> list[dict]:
        """JSX event attributes: attr, target (an identifier, or the one call of an inline function), line, off."""
        out = []
        for at, name, a, b in self.m.attributes:
            if not re.match(r"on[A-Z]", name):
                continue
            value = self.code[a:b].strip()
            one = re.fullmatch(rf"({_NAME})", value)
            arrow = re.fullmatch(rf"(?:async\s*)?(?:\([^)]*\)|{_NAME})\s*=>\s*(?:\{{\s*(?:return\s+)?)?(?:await\s+)?({_NAME})\s*\(.*\)\s*;?\s*\}}?", value, re.S)
            target = one[1] if one else arrow[1] if arrow else None
            out.append({"attr": name, "target": target, "line": self.line(at), "off": at})
        return out

    def flags(self) -> dict:
        renders = bool(re.search(r"[\w$)\]]\s*\.\s*render\s*\(", self.code)) or bool(re.search(r"(?<![\w$])createRoot\s*\(", self.code))
        first = re.match(r"\s*", self.code).end()
        value, _ = self._literal(first)
        return {"renders_dom": renders, "use_server": value == "use server"}

    def components(self) -> list[dict]:
        """React components: top-level functions, arrows and function expressions that hold JSX, and classes that extend Component."""
        if not self.path.endswith((".tsx", ".jsx")):
            return []
        out = [{"name": c["name"] or "<anonymous>", "line": c["start_line"]} for c in self.callables() if c["has_jsx"] and (c["group"] in ("arrow", "expression") or c["group"] == "declaration" and c["top_level"])]
        for m in _CLASS.finditer(self.code):
            base = re.search(r"\bextends\s+([\w$.]+(?:<.*>)?)", m[2])
            if base and _COMPONENT.match(base[1].strip()):
                out.append({"name": m[1] or "<anonymous>", "line": self.line(m.start())})
        return out


def _named(clause: str | None) -> list[tuple[str, str]]:
    """(imported, local) pairs of a braces clause."""
    out = []
    for part in (clause or "").split(","):
        words = re.sub(r"^\s*type\s+(?=\S)", "", part).split()
        if words:
            out.append((words[0], words[2] if len(words) == 3 and words[1] == "as" else words[0]))
    return out


def _split(text: str) -> list[str]:
    """Splits at commas outside of brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and (i == 0 or text[i - 1] != "="):
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    last = text[at:]
    return [*out, last] if last.strip() else out
