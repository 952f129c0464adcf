"""Path and specifier predicates as Column expressions. Paths are POSIX and relative to the repository's root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that decide how files are treated.
TEST_SUPPORT_DIRECTORIES = ["fixtures", "__fixtures__", "__mocks__"]
JS_EXCLUDED = ["node_modules", "dist", "build", "out", ".next", "coverage", ".git", *TEST_SUPPORT_DIRECTORIES]
PY_EXCLUDED = ["__pycache__", ".venv", "venv", "env", ".tox", ".eggs", "build", "dist", ".git", "site-packages", ".mypy_cache", ".pytest_cache", ".ipynb_checkpoints", "node_modules", *TEST_SUPPORT_DIRECTORIES]
TEST_ROOTS = ["test", "tests", "__tests__", "e2e"]
ASSET_EXTENSIONS = ["css", "scss", "sass", "less", "svg", "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "woff", "woff2", "ttf", "eot", "otf", "mp4", "mp3", "wav", "webm", "pdf"]
TOOLS = ["jest", "webpack", "babel", "vite", "vitest", "rollup", "next", "tailwind", "postcss", "eslint", "commitlint", "cypress", "playwright", "karma", "rspack", "parcel", "esbuild", "tsup", "turbo", "metro"]
JS_EXTENSIONS = ["ts", "tsx", "js", "jsx"]
DATA_LAYER = r"(?i)(^|/)(models?|migrations?|schema\w*|db|database)(/|$)"
MANIFEST = r"(^|/)(package(-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|requirements[\w.-]*\.txt|pyproject\.toml|poetry\.lock|go\.mod|go\.sum)$"


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def segments(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    """The segments without the file's own name."""
    s = segments(path)
    return F.slice(s, F.lit(1), F.size(s) - 1)


def dirname(path: Column) -> Column:
    return F.array_join(directories(path), "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def relative_to(path: Column, root: Column) -> Column:
    """`path` below `root`, with forward slashes."""
    return F.substr(F.replace(path, F.lit("\\"), F.lit("/")), F.length(root) + 2)


def normalize(path: Column) -> Column:
    """Folds '.' and '..'; a '..' above the root is dropped."""
    kept = F.filter(segments(path), lambda s: ~s.isin("", "."))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), step), "/")


def resolve_relative(from_file: Column, specifier: Column) -> Column:
    """Where a specifier that begins with '.' leads from a file; null for others."""
    return F.when(specifier.startswith("."), normalize(F.concat_ws("/", dirname(from_file), specifier)))


def is_relative(specifier: Column) -> Column:
    return specifier.startswith("./") | specifier.startswith("../")


def looks_like_alias(specifier: Column) -> Column:
    return specifier.startswith("@/")


def is_asset(specifier: Column) -> Column:
    return F.lower(specifier).rlike(r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$")


def is_js_excluded(path: Column) -> Column:
    """Any segment counts, the file's name too."""
    return F.arrays_overlap(segments(path), _array(JS_EXCLUDED))


def is_py_excluded(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.isin(*PY_EXCLUDED) | s.endswith(".egg-info"))


def is_py_excluded_by_directory(path: Column) -> Column:
    """What a walk that skips directories leaves out: the file's own name doesn't count."""
    return F.exists(directories(path), lambda s: s.isin(*PY_EXCLUDED) | s.endswith(".egg-info"))


def is_js_test(path: Column) -> Column:
    first = F.element_at(segments(path), 1)
    return path.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$") | F.array_contains(segments(path), "__tests__") | first.isin("test", "tests", "e2e")


def is_py_test(path: Column) -> Column:
    return basename(path).rlike(r"^(test_.*|.*_test)\.py$") | F.element_at(segments(path), 1).isin("test", "tests")


def is_e2e_root(path: Column) -> Column:
    return F.element_at(segments(path), 1) == "e2e"


def is_js_tooling(path: Column) -> Column:
    return path.rlike("^(" + "|".join(TOOLS) + r")\.(config|setup)\.(js|cjs|mjs|ts|cts|mts)$")


def is_py_tooling(path: Column) -> Column:
    return path == "setup.py"


def is_test_support(path: Column) -> Column:
    return F.arrays_overlap(segments(path), _array(TEST_SUPPORT_DIRECTORIES))


def test_root_depth(path: Column) -> Column:
    """Place (from 1) of the first directory named like a test root; 0 if there is none."""
    d = directories(path)
    places = F.filter(F.sequence(F.lit(1), F.size(segments(path))), lambda i: (i <= F.size(d)) & F.element_at(segments(path), i).isin(*TEST_ROOTS))
    return F.when(F.size(places) > 0, F.element_at(places, F.lit(1))).otherwise(F.lit(0))


def is_under_test_root(path: Column) -> Column:
    return test_root_depth(path) > 0


def test_root(path: Column) -> Column:
    """The path up to the test root; '' without one."""
    return F.array_join(F.slice(segments(path), F.lit(1), test_root_depth(path)), "/")


def area_at_depth(path: Column, depth: Column | int, cap: bool = True) -> Column:
    """The directory prefix of `depth` segments that names an area, at most down to a test root; '.' for files at the root."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    root = test_root_depth(path)
    most = F.when((root > 0) & F.lit(cap), F.least(depth, root)).otherwise(depth)
    d = directories(path)
    return F.when(F.size(d) == 0, F.lit(".")).otherwise(F.array_join(F.slice(d, F.lit(1), most), "/"))


def is_data_layer(path: Column) -> Column:
    return path.rlike(DATA_LAYER)


def is_manifest(path: Column) -> Column:
    return path.rlike(MANIFEST)


def package_name(specifier: Column) -> Column:
    """The package of a bare specifier: two segments if scoped, else one."""
    s = segments(specifier)
    return F.when(specifier.startswith("@"), F.array_join(F.slice(s, 1, 2), "/")).otherwise(F.element_at(s, 1))


def python_name(name: Column) -> Column:
    """Names that differ in case or in punctuation are one distribution."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
