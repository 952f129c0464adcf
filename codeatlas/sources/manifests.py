"""Package manifests and alias configurations: (path, text) in, flat rows out. Unreadable files give a gap row, never an error."""

from __future__ import annotations

import ast
import configparser
import json
import posixpath
import re
import tomllib

from .js_lex import mask, matching

SECTIONS = {"dependencies": "direct", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
UI_FRAMEWORKS = ("react", "next", "vue", "svelte", "@angular/core", "solid-js", "preact")


def package_json(text: str) -> dict:
    """The manifest as a dict; {} if it can't be read."""
    try:
        out = json.loads(text)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def js_dependencies(manifest: dict) -> list[tuple[str, str, str]]:
    """(name, version, scope), sections in order; the first scope of a name wins."""
    seen: dict[str, tuple[str, str, str]] = {}
    for section, scope in SECTIONS.items():
        part = manifest.get(section)
        for name, version in part.items() if isinstance(part, dict) else ():
            seen.setdefault(name, (name, str(version), scope))
    return list(seen.values())


def export_target(value, depth: int = 0) -> str | None:
    """The file that an `exports` field leads to: the string itself, '.', import, default, or the first other string that isn't types."""
    if isinstance(value, str):
        return value
    if not isinstance(value, dict) or depth > 5:
        return None
    if "." in value:
        return export_target(value["."], depth + 1)
    for key in ("import", "default"):
        if isinstance(value.get(key), str):
            return value[key]
    return next((v for k, v in value.items() if k != "types" and isinstance(v, str)), None)


def pep508(spec: str) -> tuple[str, str | None] | None:
    m = re.match(r"^[A-Za-z0-9][A-Za-z0-9._-]*", spec.strip())
    return (m[0], spec.strip()[m.end() :].split(";")[0].strip() or None) if m else None


def pyproject(text: str) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, name, value, scope) rows: name, script, dependency; or one gap row."""
    try:
        t = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return [("gap", "pyproject.toml could not be parsed", None, None)]
    get = lambda *keys: _in(t, keys)
    rows: list[tuple[str, str, str | None, str | None]] = []
    name = get("project", "name") or get("tool", "poetry", "name")
    if isinstance(name, str):
        rows.append(("name", name, None, None))
    for where in (("project", "scripts"), ("project", "gui-scripts"), ("tool", "poetry", "scripts")):
        for k, v in (get(*where) or {}).items():
            if isinstance(v, str):
                rows.append(("script", k, v, None))
    seen: set[str] = set()

    def add(found, scope):
        if found and found[0] not in seen:
            seen.add(found[0])
            rows.append(("dependency", found[0], found[1], scope))

    for spec in get("project", "dependencies") or ():
        add(pep508(spec) if isinstance(spec, str) else None, "direct")
    for group in (get("project", "optional-dependencies") or {}).values():
        for spec in group if isinstance(group, list) else ():
            add(pep508(spec) if isinstance(spec, str) else None, "optional")
    for section, scope in (("dependencies", "direct"), ("dev-dependencies", "dev")):
        for k, v in (get("tool", "poetry", section) or {}).items():
            if k != "python":
                add((k, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None), scope)
    return rows


def _in(obj, keys):
    for k in keys:
        if not isinstance(obj, dict) or k not in obj:
            return None
        obj = obj[k]
    return obj


def setup_cfg(text: str) -> list[tuple[str, str, str | None, str | None]]:
    c = configparser.ConfigParser(interpolation=None)
    try:
        c.read_string(text)
    except configparser.Error:
        return [("gap", "setup.cfg could not be parsed", None, None)]
    name = c.get("metadata", "name", fallback=None)
    return [("name", name.strip(), None, None)] if name else []


def setup_py(text: str) -> list[tuple[str, str, str | None, str | None]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [("gap", "setup.py could not be parsed", None, None)]
    for n in ast.walk(tree):
        called = n.func if isinstance(n, ast.Call) else None
        if isinstance(called, ast.Name) and called.id == "setup" or isinstance(called, ast.Attribute) and called.attr == "setup":
            rows: list[tuple[str, str, str | None, str | None]] = []
            for k in n.keywords:
                if k.arg == "name" and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str):
                    rows.append(("name", k.value.value, None, None))
                if k.arg == "entry_points" and isinstance(k.value, ast.Dict):
                    for key, value in zip(k.value.keys, k.value.values, strict=True):
                        if isinstance(key, ast.Constant) and key.value == "console_scripts" and isinstance(value, ast.List):
                            for e in value.elts:
                                if isinstance(e, ast.Constant) and isinstance(e.value, str) and "=" in e.value:
                                    script, _, target = e.value.partition("=")
                                    rows.append(("script", script.strip(), target.strip(), None))
            return rows
    return []


def python_config(files: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
    """Rows of pyproject.toml, setup.cfg and setup.py in that order; the first name wins."""
    rows, named = [], False
    for path, read in (("pyproject.toml", pyproject), ("setup.cfg", setup_cfg), ("setup.py", setup_py)):
        for row in read(files[path]) if path in files else ():
            if row[0] == "name":
                if named:
                    continue
                named = True
            rows.append(row)
    return rows


# --- aliases

BUNDLERS = (
    (("vite.config.ts", "vite.config.js", "vite.config.mjs"), ("resolve", "alias")),
    (("webpack.config.js", "webpack.config.ts"), ("resolve", "alias")),
    (("rsbuild.config.ts", "rsbuild.config.js"), ("resolve", "alias")),
    (("rollup.config.js", "rollup.config.mjs", "rollup.config.ts"), ("entries",)),
    (("nuxt.config.ts", "nuxt.config.js"), ("alias",)),
    (("next.config.js", "next.config.mjs", "next.config.ts"), ("alias",)),
    (("babel.config.js", ".babelrc.js", ".babelrc", "babel.config.json"), ("alias",)),
)


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas."""
    m = mask(text, "x.ts")
    out = list(m.code)
    for start, (end, _) in m.strings.items():
        out[start:end] = text[start:end]
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def aliases(files: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(pattern, target, match_type, source) of all alias sources of a project's root files; the first of a pattern wins, longer patterns first. match_type is
    exact, prefix or gap."""
    found: list[tuple[str, str, str, str]] = []
    for names, keys in BUNDLERS:
        path = next((n for n in names if n in files), None)
        if path:
            found += _bundler(path, files[path], keys)
    config = next((n for n in ("tsconfig.json", "jsconfig.json") if n in files), None)
    if config:
        found += _tsconfig(config, files)
    imports = package_json(files.get("package.json", "")).get("imports")
    for k, v in imports.items() if isinstance(imports, dict) else ():
        if isinstance(v, str):
            found.append(_pattern(k, v, "package.json"))
    first: dict[str, tuple[str, str, str, str]] = {}
    for row in found:
        first.setdefault(row[0], row)
    return sorted(first.values(), key=lambda r: -len(r[0]))


def _pattern(pattern: str, target: str, source: str) -> tuple[str, str, str, str]:
    target = posixpath.normpath(target.removesuffix("*") or ".")
    return (pattern[:-1], target, "prefix", source) if pattern.endswith("*") else (pattern, target, "exact", source)


def _tsconfig(path: str, files: dict[str, str], depth: int = 0) -> list[tuple[str, str, str, str]]:
    try:
        c = json.loads(strip_jsonc(files[path]))
    except ValueError:
        return [(path, "could not be parsed", "gap", path)]
    options = c.get("compilerOptions") or {}
    if "paths" not in options and isinstance(c.get("extends"), str) and depth < 5:
        parent = posixpath.normpath(posixpath.join(posixpath.dirname(path), c["extends"]))
        parent = next((p for p in (parent, parent + ".json") if p in files), None)
        return _tsconfig(parent, files, depth + 1) if parent else []
    base = posixpath.join(posixpath.dirname(path), options.get("baseUrl", "."))
    return [_pattern(k, posixpath.join(base, t), path) for k, targets in (options.get("paths") or {}).items() for t in targets if isinstance(t, str)]


def _bundler(path: str, text: str, keys: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """Aliases of an object or array literal at a property path; targets are literals or path.resolve/join of literals."""
    m = mask(text, "x.ts")
    at = 0
    for key in keys:
        k = re.compile(rf"['\"]?\b{key}\b['\"]?\s*[:=]\s*").search(text, at)
        if not k:
            return []
        at = k.end()
    if at >= len(text) or text[at] not in "{[":
        return []
    body_end = matching(m.code, at)
    rows, i = [], at + 1
    if text[at] == "[":
        for e in re.finditer(r"find\s*:\s*(['\"])(.*?)\1\s*,\s*replacement\s*:\s*([^,}]+(?:\([^)]*\))?)", text[at:body_end]):
            rows.append((e[2], e[3]))
    else:
        for e in re.finditer(r"(?:(['\"])(.+?)\1|([\w$@~]+))\s*:\s*((?:[\w.]+\s*\([^)]*\))|['\"][^'\"]*['\"]|[^,}\n]+)", text[i:body_end]):
            rows.append((e[2] or e[3], e[4]))
    out = []
    for pattern, value in rows:
        target = _target(value.strip())
        if target is None:
            out.append((pattern, f"alias '{pattern}' is computed", "gap", path))
        elif pattern.endswith("$"):
            out.append((pattern[:-1], target, "exact", path))
        elif pattern.endswith("/*"):
            out.append(_pattern(pattern, target, path))
        else:
            out += [(pattern, target, "exact", path), (pattern.rstrip("/") + "/", target, "prefix", path)]
    return out


def _target(value: str) -> str | None:
    one = re.fullmatch(r"(['\"])(.*)\1", value)
    if one:
        return posixpath.normpath(one[2])
    call = re.fullmatch(r"(?:path\.)?(?:resolve|join)\s*\((.*)\)", value, re.S)
    if not call:
        return None
    parts = [p.strip() for p in call[1].split(",")]
    texts = [re.fullmatch(r"(['\"])(.*)\1", p) for p in parts if p not in ("__dirname", "process.cwd()")]
    return posixpath.normpath(posixpath.join(".", *[t[2].lstrip("/") for t in texts])) if texts and all(texts) else None
