"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: tags (with the words of their class, id and role) and texts. Adjacent repeats in a stream fold into
repeated groups; then the streams of a host are aligned one after another with the host's wrapper. What both have stays
required, what one lacks becomes an optional group (split where a later page has only part of it), repeated groups take in
each other's units as optional parts, and every text is a slot. The wrapper so far accepts every page it has seen, so it is a union-free
regular expression of the host's template.

Afterwards every page is aligned with its host's wrapper, and slots are measured: how many pages fill them, with how many words, and
whether their text ever varies. Text that varies is content, text that all pages have alike is the template's. The main slot is the smallest element of
the wrapper that holds more than half of the varying words (links, and elements whose names or words mark them as something else, not
counted) and the varying headline; an article or main element with varying words is taken first. Within it texts are kept, but for menus, forms, asides, footers
and containers marked as adverts, comments and the like, and, where no article or main element says what belongs to it, texts that never vary. A page's main text is
what stands in the element that falls on the wrapper's main slot.

Pages that don't fill the main slot, or whose host has none (a single page without an article, say), are classed by their own elements.
Every page takes part in inference and in the measures: tasks fold their pages into a partial wrapper per host without moving html; partial
wrappers, a few hundred bytes each, are aligned per host in two levels, so that no task holds all those of a large host.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialize

#: Elements without content, whose text isn't shown, that aren't main text, and that don't end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script|style|noscript|template|svg|iframe|object|textarea|select|title"
ASIDE = frozenset("head nav header footer aside form menu dialog button fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
#: Elements that can be a main slot, or be dropped from one for the words of their class, id and role.
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
PARTS = CONTAINERS - {"body"} | frozenset("dl ol ul".split())

#: Words in a class, id or role that mark an element as not main text: anywhere outside of a main slot, and a container inside of it.
MARKS = frozenset(
    "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notification pagination popup "
    "promo promoted recommended related reply responses respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

INSIDE = frozenset(
    "ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr newsletter "
    "pagination promo promoted recommended related share sharing sidebar signup social sponsor sponsored subscribe".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + HIDDEN + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSEEN = re.compile(r"\shidden(?=[\s=/>])(?!\s*=\s*[\"']?until-found)|\sstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_REPEAT = re.compile(r"(.{1,16}?)\1+", re.S)

TEXT = "#"
#: Mark of elements that aren't shown.
UNSEEN = "!"
#: Hosts, page shapes and slots that a task holds at once before it passes them on or forgets them (results don't depend on them); pages on which a text is
#: the same that are taken for its being the template's; partial wrappers that are aligned in one go.
HOSTS, SHAPES, SLOTS, CONSTANT_PAGES, FAN_IN = 2000, 2000, 200_000, 3, 64

_SYMBOLS: dict[str, str | None] = {}


def _symbol(tag: str) -> str | None:
    """'<div.ad>' for a start tag, '</div>' for an end tag: the name and the words of class, id and role without digits, and a mark if it isn't shown."""
    if tag in _SYMBOLS:
        return _SYMBOLS[tag]
    m = _TAG.match(tag)
    name = m[2].lower()
    if m[1]:
        out = f"</{name}>" if name not in VOID else None
    else:
        words = sorted({w for x in _NAMES.findall(tag) for w in re.findall(r"[a-z]+", x.lower())})
        out = f"<{'.'.join([name, *[UNSEEN] * bool(_UNSEEN.search(tag)), *words])}>"
    if len(_SYMBOLS) < 50_000 and len(tag) < 200:
        _SYMBOLS[tag] = out
    return out


def tokens(page: str) -> tuple[list[str], list[str]]:
    """(symbols, texts): texts[i] is the raw text where symbols[i] is TEXT, else ''. Comments, hidden elements and blank texts are left out."""
    symbols, texts = [], []
    for m in _TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or t == "<":
            if symbols and symbols[-1] == TEXT:
                texts[-1] += t
            elif t.strip():
                symbols.append(TEXT)
                texts.append(t)
            elif symbols and texts[-1] == "":
                texts[-1] = " "  # white space after an inline tag
        elif m[1] is None and t[1] not in "!?" and (s := _symbol(t)):
            symbols.append(s)
            texts.append("")
    return symbols, texts


# --- wrappers: a list of nodes; a node is a symbol or a repeated group ["+", units], whose units are runs of symbols; every round of a
# --- repeated group is its units in order, each optional. Next to a node stands its optional group (0: required).


def _units(body: list) -> list[list[str]]:
    """The units of a body: its runs of symbols, and the units of groups within."""
    out: list[list[str]] = []
    run: list[str] = []
    for node in body:
        if isinstance(node, str):
            run.append(node)
            continue
        if run:
            out.append(run)
            run = []
        out += node[1]
    if run:
        out.append(run)
    return _distinct(out)


def _distinct(units: list[list[str]]) -> list[list[str]]:
    out: list[list[str]] = []
    for u in units:
        if u not in out:
            out.append(u)
    return out


def fold(symbols: list[str]) -> tuple[list, list[int]]:
    """Nodes of a stream, adjacent repeats of up to 16 nodes folded, inner ones first; and how many symbols each stands for."""
    code: dict[str, str] = {}
    nodes: list = []

    def char(node) -> str:
        key = node if isinstance(node, str) else json.dumps(node)
        if key not in code:
            code[key] = chr(0xF0000 + len(nodes))
            nodes.append(node)
        return code[key]

    text, lens = "".join(map(char, symbols)), [1] * len(symbols)
    while True:
        out, counts, at = [], [], 0
        for m in _REPEAT.finditer(text):
            lo, hi = m.span()
            out += [text[at:lo], char(["+", _units([nodes[ord(c) - 0xF0000] for c in m[1]])])]
            counts += [*lens[at:lo], sum(lens[lo:hi])]
            at = hi
        if not at:
            return [nodes[ord(c) - 0xF0000] for c in text], lens
        text, lens = "".join(out) + text[at:], counts + lens[at:]


def _key(node) -> str:
    """What aligns: equal symbols, or repeated groups whose units begin alike."""
    return node if isinstance(node, str) else "+" + node[1][0][0]


def _absorb(nodes: list, groups: list[int], other: list, lens: list[int] | None = None) -> tuple[list, list[int], list[int]]:
    """Turns units of groups, of `other` or of the nodes themselves, that occur by themselves into groups, and joins groups in a row."""
    lens = lens or [1] * len(nodes)
    units = _distinct([u for n in [*other, *nodes] if not isinstance(n, str) for u in n[1]])
    by_first: dict[str, list] = {}
    for u in sorted(units, key=len, reverse=True):
        by_first.setdefault(u[0], []).append(u)
    out: list = []
    marks: list[int] = []
    counts: list[int] = []
    i = 0
    while i < len(nodes):
        node, step = nodes[i], 1
        if isinstance(node, str):
            for u in by_first.get(node, ()):
                if nodes[i : i + len(u)] == u and len(set(groups[i : i + len(u)])) == 1:
                    node, step = ["+", [u]], len(u)
                    break
        count = sum(lens[i : i + step])
        if not isinstance(node, str) and out and not isinstance(out[-1], str) and marks[-1] == groups[i] and _key(out[-1]) == _key(node):
            out[-1] = ["+", _distinct([*out[-1][1], *node[1]])]
            counts[-1] += count
        else:
            out.append(node)
            marks.append(groups[i])
            counts.append(count)
        i += step
    return out, marks, counts


def align(wrapper: dict | None, page: dict) -> dict:
    """The wrapper that accepts what both accept. A wrapper is {"n": nodes, "g": optional groups}."""
    if wrapper is None or wrapper == page:
        return page
    a, ga, _ = _absorb(wrapper["n"], wrapper["g"], page["n"])
    b, gb, _ = _absorb(page["n"], page["g"], a)
    shift = max([0, *ga])
    gb = [g + shift if g else 0 for g in gb]
    nodes, groups = [], []
    split: dict[tuple, int] = {}  # what decides which nodes come and go together -> optional group

    def put(node, marks: tuple) -> None:
        nodes.append(node)
        groups.append(split.setdefault(marks, len(split) + 1) if any(marks) else 0)

    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    for at, (op, i, j, x, y) in enumerate(SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes(), 1):
        if op == "equal":
            for p, q in zip(range(i, j), range(x, y), strict=True):
                put(a[p] if a[p] == b[q] else ["+", _distinct([*a[p][1], *b[q][1]])], (ga[p], gb[q], 0))
        else:
            for p in range(i, j):
                put(a[p], (ga[p], 0, at))
            for q in range(x, y):
                put(b[q], (0, gb[q], -at))
    return {"n": nodes, "g": groups}


def _nodes(symbols: list[str]) -> tuple[list, list[int]]:
    nodes, lens = fold(symbols)
    nodes, _, lens = _absorb(nodes, [0] * len(nodes), [], lens)
    return nodes, lens


def wrapper_of(symbols: list[str]) -> dict:
    nodes, _ = _nodes(symbols)
    return {"n": nodes, "g": [0] * len(nodes)}


# --- classing


class Stack:
    """The open elements: (name, words, payload)."""

    def __init__(self):
        self.open: list[tuple[str, list[str], object]] = []

    def feed(self, s: str, payload=None) -> bool:
        """Takes a tag; says whether it opened an element."""
        if s[1] == "/":
            name = s[2:-1]
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == name:
                    del self.open[k:]
                    break
            return False
        name, *words = s[1:-1].split(".")
        if name in VOID:
            return False
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == name:
            self.open.pop()
        self.open.append((name, words, payload))
        return True


def _is_main(name: str, words: list[str]) -> bool:
    return (name in MAIN or "main" in words and name in ("div", "section")) and not INSIDE.intersection(words)


def _off_outside(name: str, words: list[str]) -> bool:
    return name in ASIDE or UNSEEN in words or (not _is_main(name, words) and name not in ("html", "body") and bool(MARKS.intersection(words)))


def _off_inside(name: str, words: list[str]) -> bool:
    return (name in ASIDE and name != "header") or UNSEEN in words or (name in PARTS and not _is_main(name, words) and bool(INSIDE.intersection(words)))


def class_stream(symbols: list[str]) -> list[bool]:
    """For each token, whether a text there is main text by the page's own elements: inside of an article or main element that isn't itself in a marked element,
    or, where the page has none with text, outside of marked elements."""
    stack = Stack()
    clear, within = [], []
    for s in symbols:
        if s != TEXT:
            stack.feed(s)
        main = next((k for k, x in enumerate(stack.open) if _is_main(*x[:2])), None)
        before = stack.open if main is None else stack.open[:main]
        clear.append(not any(_off_outside(*x[:2]) for x in before))
        within.append(main is not None and clear[-1] and not any(_off_inside(*x[:2]) for x in stack.open[main:]))
    some = any(w and s == TEXT for w, s in zip(within, symbols, strict=True))
    return within if some else clear


class Matcher:
    """A host's wrapper, aligned with pages; with measures of its slots, also their main text."""

    def __init__(self, wrapper: dict, slots: list[dict] | None = None):
        self.nodes = wrapper["n"]
        self.keys = [_key(n) for n in self.nodes]
        self.places: dict[tuple, list[int]] = {}
        self.main: set[int] = set()
        self.constant: set[int] = set()
        if slots is not None:
            self._choose({x["slot"]: x for x in slots})

    def place(self, symbols: list[str]) -> list[int]:
        """For each token the node of the wrapper that it falls on, or -1."""
        nodes, lens = _nodes(symbols)
        nodes, _, lens = _absorb(nodes, [0] * len(nodes), self.nodes, lens)
        keys = tuple(map(_key, nodes))
        at = self.places.get(keys)
        if at is None:
            at = [-1] * len(keys)
            for i, j, n in SequenceMatcher(None, self.keys, keys, autojunk=False).get_matching_blocks():
                at[j : j + n] = range(i, i + n)
            if len(self.places) >= SHAPES:
                self.places.clear()
            self.places[keys] = at
        return [x for x, n in zip(at, lens, strict=True) for _ in range(n)]

    def _choose(self, slots: dict[int, dict]) -> None:
        """Sets the main slot, and the slots whose text is the template's."""
        weight: dict[int, int] = {}  # element, by the node that opens it -> varying words
        elements: dict[int, tuple[str, list[str]]] = {}
        headline: set[int] | None = None
        total = 0
        stack = Stack()
        for i, node in enumerate(self.nodes):
            run = [node] if isinstance(node, str) else [x for u in node[1] for x in u]
            inner = Stack()
            link, heading = [], False
            for s in run:
                if s == TEXT:
                    names = [x[0] for x in (*stack.open, *inner.open)]
                    link.append("a" in names)
                    heading = heading or "h1" in names
                elif len(run) > 1 or not isinstance(node, str):
                    inner.feed(s)
                elif stack.feed(s, i):
                    elements[i] = stack.open[-1][:2]
            x = slots.get(i)
            if x is None or not link or all(link):
                continue
            around = [e[2] for e in stack.open]
            main = any(_is_main(*e[:2]) for e in stack.open)
            if x["varies"] and not any((_off_inside if main else _off_outside)(*e[:2]) for e in stack.open):
                total += x["words"]
                for e in around:
                    weight[e] = weight.get(e, 0) + x["words"]
                if heading and headline is None:
                    headline = set(around)
        said = {e: w for e, w in weight.items() if _is_main(*elements[e])}
        if said:
            # the innermost ones: an article in a main element goes before it if it has most of its words
            most = max(said.values())
            self.main = {max(e for e, w in said.items() if 2 * w > most)} | {e for e, w in said.items() if elements[e][0] == "article" and 2 * w <= most}
            return
        chain = [e for e, w in weight.items() if 2 * w > total and elements[e][0] in CONTAINERS and (headline is None or e in headline)]
        if chain:
            self.main = {max(chain)}
            self.constant = {i for i, x in slots.items() if not x["varies"] and x["pages"] >= CONSTANT_PAGES}

    def classed(self, symbols: list[str]) -> list[bool] | None:
        """For each token, whether it is main text; None if the page has nothing in the wrapper's main slot."""
        if not self.main:
            return None
        place = self.place(symbols)
        out = [False] * len(symbols)
        stack = Stack()
        some = False
        for k, (s, at) in enumerate(zip(symbols, place, strict=True)):
            if s != TEXT:
                stack.feed(s, at in self.main)
            start = next((j for j, x in enumerate(stack.open) if x[2]), None)
            if start is not None and at not in self.constant and not any(_off_inside(*x[:2]) for x in stack.open[start + 1 :]):
                out[k] = True
                some = some or s == TEXT
        return out if some else None


def main_text(symbols: list[str], texts: list[str], main: list[bool]) -> str:
    """The blocks' texts, character references decoded, white space runs made one space, joined by line feeds."""
    blocks, block = [], []
    for s, t, m in zip(symbols, texts, main, strict=True):
        if s == TEXT:
            if m:
                block.append(t)
            continue
        name = s.strip("</>").split(".")[0]
        if name == "br":
            block.append(" ")
        elif name not in INLINE:
            blocks.append(block)
            block = []
        if t:
            block.append(t)
    blocks.append(block)
    lines = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str | None, matcher: Matcher | None) -> tuple[str, bool]:
    """(main text, whether the wrapper gave it)."""
    symbols, texts = tokens(page or "")
    main = matcher.classed(symbols) if matcher else None
    return main_text(symbols, texts, class_stream(symbols) if main is None else main), main is not None


# --- the distributed operator


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, set[int]] = {}
    held: dict[str, dict] = {}
    shapes = 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], ["host", "wrapper"])

    for batch in batches:
        for h, page in zip(batch["host"].to_pylist(), batch["html"], strict=True):
            w = wrapper_of(tokens(page.as_py() or "")[0])
            key = hash(json.dumps(w["n"]))
            if key in (known := seen.setdefault(h, set())):
                continue
            known.add(key)
            shapes += 1
            held[h] = align(held.get(h), w)
            if len(held) >= HOSTS:
                yield rows()
                seen, held, shapes = {}, {}, 0
            elif shapes >= SHAPES:  # an accepted page that comes again changes nothing
                seen, shapes = {}, 0
    if held:
        yield rows()


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    out = None
    for w in sorted(table["wrapper"].to_pylist(), key=lambda x: (len(x), x)):
        out = align(out, json.loads(w))
    return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(out)]})


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, pages, words, low, high): sums over a task's pages, and the least and greatest hash of the slot's text."""
    matchers: dict[str, Matcher] = {}
    held: dict[tuple[str, int], list[int]] = {}

    def rows() -> pa.RecordBatch:
        hosts, slots = pa.array([h for h, _ in held]), pa.array([s for _, s in held], pa.int32())
        return pa.RecordBatch.from_arrays([hosts, slots, *(pa.array(c, pa.int64()) for c in zip(*held.values(), strict=True))], ["host", "slot", "pages", "words", "low", "high"])

    for batch in batches:
        for h, wrapper, page in zip(batch["host"].to_pylist(), batch["wrapper"], batch["html"], strict=True):
            if h not in matchers:
                if len(matchers) >= HOSTS:
                    matchers.clear()
                matchers[h] = Matcher(json.loads(wrapper.as_py()))
            symbols, texts = tokens(page.as_py() or "")
            filled: dict[int, list[str]] = {}
            for s, t, at in zip(symbols, texts, matchers[h].place(symbols), strict=True):
                if s == TEXT and at >= 0:
                    filled.setdefault(at, []).append(t)
            for at, parts in filled.items():
                words = " ".join(parts).split()
                x = xxhash.xxh64_intdigest(" ".join(words)) - 2**63
                old = held.get((h, at))
                held[h, at] = [1, len(words), x, x] if old is None else [old[0] + 1, old[1] + len(words), min(old[2], x), max(old[3], x)]
        if len(held) >= SLOTS:
            yield rows()
            held = {}
    if held:
        yield rows()


def _hosted(pages: DataFrame, wrappers: DataFrame, size: int) -> DataFrame:
    """Pages with their host's wrapper. Wrappers of a few megabytes in all go to every task; more of them meet the pages in a shuffle join."""
    p = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("host", host(F.col("url")))
    return p.join(F.broadcast(wrappers) if size <= 8 << 20 else wrappers, "host", "left")


def _size(wrappers: DataFrame) -> int:
    return wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, slots) of pages (url, html); a wrapper is JSON, slots array<struct<slot, pages, words, varies>> are the measures of its nodes with text."""
    bound_batches(pages.sparkSession)
    pages = pages.select("url", "html")
    parts = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_partial, "host string, wrapper string")
    parts = materialize(parts.distinct(), "partial")
    # a host with many partial wrappers has them aligned in bundles first
    many = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    bundle = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN_IN))
    bundles = parts.join(many, "host").withColumn("bundle", bundle).groupBy("host", "bundle").applyInArrow(_joined, "host string, wrapper string")
    w = materialize(bundles.groupBy("host").applyInArrow(_joined, "host string, wrapper string"), "wrappers")
    rows = _hosted(pages, w, _size(w)).select("html", "host", "wrapper").mapInArrow(_slot_rows, "host string, slot int, pages long, words long, low long, high long")
    per = rows.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"), (F.min("low") < F.max("high")).alias("varies"))
    slots = per.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "pages", "words", "varies"))).alias("slots"))
    return w.join(slots, "host", "left")


def extract_pages(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, by_wrapper) for every row of pages (page_id, url, html).

    Null html is an empty page with an empty text. A null url, or one without a host, belongs to the host ''. Repeated rows are
    extracted alike; pages of a host that are all equal show nothing that varies and are classed by their own elements. Very long pages are read
    whole, one at a time. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    w = materialize(infer(pages) if wrappers is None else wrappers, "wrappers")
    joined = _hosted(pages.select("page_id", "url", "html"), w, 2 * _size(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, Matcher] = {}
        for batch in batches:
            out = []
            for h, wrapper, slots, page in zip(batch["host"].to_pylist(), batch["wrapper"], batch["slots"], batch["html"], strict=True):
                if h not in compiled:
                    if len(compiled) >= HOSTS:
                        compiled.clear()
                    compiled[h] = Matcher(json.loads(wrapper.as_py()), slots.as_py() or []) if wrapper.is_valid else None
                out.append(extract(page.as_py(), compiled[h]))
            texts = pa.array([t for t, _ in out], pa.string())
            sizes = pa.array([len(t) for t, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], texts, sizes, pa.array([b for _, b in out], pa.bool_())], ["page_id", "url", "text", "n_chars", "by_wrapper"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "host", "wrapper", "slots").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_wrapper boolean")
