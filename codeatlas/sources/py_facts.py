"""Facts of one Python file, from its syntax tree; a file that doesn't parse gives line-wise imports and a gap."""

from __future__ import annotations

import ast
import re


def parse(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def imports(text: str, tree: ast.Module | None) -> list[dict]:
    """All `import` statements, then all `from` ones, at any depth: form, level, module, names, is_wildcard, line. Plain names of a statement come before aliased ones."""
    if tree is None:
        plain, froms = [], []
        for n, line in enumerate(text.split("\n"), 1):
            if (m := re.match(r"\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)", line)) is not None:
                names = [x.split(" as ")[0].strip(" ()\\") for x in m[3].split("#")[0].split(",")]
                froms.append({"form": "from", "level": len(m[1]), "module": m[2], "names": [x for x in names if x and x != "*"], "is_wildcard": "*" in names, "line": n})
            elif (m := re.match(r"\s*import\s+([\w., ]+)", line)) is not None:
                plain += [{"form": "import", "level": 0, "module": x.split(" as ")[0].strip(), "names": [], "is_wildcard": False, "line": n} for x in m[1].split(",")]
        return plain + froms
    plain, froms = [], []
    nodes = sorted((n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset))
    for n in nodes:
        names = [a for a in n.names if a.asname is None] + [a for a in n.names if a.asname is not None]
        if isinstance(n, ast.Import):
            plain += [{"form": "import", "level": 0, "module": a.name, "names": [], "is_wildcard": False, "line": n.lineno} for a in names]
        else:
            star = any(a.name == "*" for a in names)
            froms.append({"form": "from", "level": n.level, "module": n.module or "", "names": [a.name for a in names if a.name != "*"], "is_wildcard": star, "line": n.lineno})
    return plain + froms


def surface(tree: ast.Module | None) -> dict:
    """has_all, all_names, defs (functions, then classes), from_names (not starting with '_'), has_main_guard."""
    out: dict = {"has_all": False, "all_names": [], "defs": [], "from_names": [], "has_main_guard": False}
    if tree is None:
        return out
    functions, classes = [], []
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append((n.name, n.lineno))
        elif isinstance(n, ast.ClassDef):
            classes.append((n.name, n.lineno))
        elif isinstance(n, ast.ImportFrom):
            out["from_names"] += [(a.asname or a.name, n.lineno) for a in n.names if not (a.asname or a.name).startswith("_") and a.name != "*"]
        elif isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, ast.List):
            out["has_all"] = True
            out["all_names"] = [(e.value, n.lineno) for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        elif isinstance(n, ast.If) and isinstance(n.test, ast.Compare) and len(n.test.comparators) == 1:
            two = (n.test.left, n.test.comparators[0])
            name = any(isinstance(x, ast.Name) and x.id == "__name__" for x in two)
            text = any(isinstance(x, ast.Constant) and x.value == "__main__" for x in two)
            out["has_main_guard"] |= name and text
    out["defs"] = functions + classes
    return out
