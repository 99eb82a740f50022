"""HTML extraction: wrappers, union-free regular expressions inferred from the pages of a host, tell text slots of the article from the rest."""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import extended, fresh, mapped, without, written

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby s samp small span strike strong sub sup td th time tt u var wbr br svg path".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select")
NEVER = frozenset("head nav header footer aside form script style noscript template textarea title iframe svg select button menu dialog object canvas video audio".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main body nav aside footer header".split())
BAD_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|subscri\w*|newsletter|signup|login|search\w*|"
    r"side-?bars?|rail|widgets?|nav\w*|menus?|breadcrumbs?|toolbar|pagination|pager|header|masthead|footer|foot|copyright|legal|comments?\w*|disqus|replies|reply|respond|"
    r"share\w*|sharing|social\w*|related\w*|recommend\w*|more-links|tags?|skip\w*|hidden|print-only|screen-reader\w*)(?:$|[-_ ])", re.IGNORECASE
)
GOOD_NAMES = re.compile(r"(?:^|[-_ ])(?:article\w*|post|posts?-(?:body|content|text)|entry(?:-content|-body)?|content|main(?:-content)?|story\w*|text|body)(?:$|[-_ ])", re.IGNORECASE)

#: Elements that no name rules out.
STRUCTURE = frozenset(("html", "body", "main", "article"))
STATES = re.compile(r"(?:has|with|without|no)-", re.IGNORECASE)
POST_NAMES = frozenset(("post", "hentry", "type-post"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
#: Open elements at most. Deeper ones keep their texts, which go to the deepest open element (or one with a name that rules it out), as browsers do.
DEEPEST = 200


class Node:
    """An element of a page: label (name, classes and id without digits), and children, elements or texts."""

    __slots__ = ("label", "name", "children")

    def __init__(self, label: str, name: str):
        self.label, self.name = label, name
        self.children: list[Node | str] = []


def parse(text: str | None) -> Node:
    """A page as a tree. Ends are found as browsers do for common cases: paragraphs, list items and cells end where the next begins; an end
    without a start is skipped; what is open at the end ends there."""
    text = text or ""
    root = Node("#page", "#page")
    stack, at, n = [root], 0, len(text)
    flat: dict[str, int] = {}  # elements that are open but not on the stack, by name
    while at < n:
        m = _TOKEN.search(text, at)
        if not m:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if flat.get(name):
                flat[name] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in SCOPES and name in INLINE:
                    break
            continue
        if name in CLOSES_P or name == "p":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in SCOPES:
                    break
        if name in SELF_CLOSING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in SELF_CLOSING[name]:
                    del stack[k:]
                    break
                if stack[k].name in SCOPES:
                    break
        label = name
        if m[3] and "=" in m[3] or "hidden" in m[3]:
            found = {k.lower(): (a or b or c or k).strip() for k, a, b, c in _NAMED.findall(m[3])}
            label = f"{name}.{' '.join(v for k, v in sorted(found.items()) if k in ('class', 'id', 'role', 'hidden') or v == 'true')}" if found else name
            label = re.sub(r"\d+", "", label).rstrip(".")
        node = Node(label, name)
        if len(stack) >= DEEPEST and name not in VOID and name not in RAW and (_bad(stack[-1].label) or not _bad(label)):
            flat[name] = flat.get(name, 0) + 1
            stack[-1].children.append(" ")
            continue
        stack[-1].children.append(node)
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(text, at)
            at = end.end() if end else n
        elif name not in VOID:
            stack.append(node)
    return root


# ---- wrappers: {"l": label, "o": 1 if optional, "r": 1 if repeated, "n": times seen, "c": children, and for a text slot "s", "a", "h": characters, those in links, hash or None}


def _slot(pieces: list[str], linked: int) -> dict:
    joined = " ".join(" ".join(pieces).split())
    return {"l": "#text", "o": 0, "r": 0, "c": [], "n": 1, "s": len(joined), "a": linked, "h": hash_of(joined)}


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 20 | len(text) & 0xFFFFF


def expression(node: Node) -> dict:
    """The expression of one page: inline elements are part of their text, texts are slots, and children are grouped as `grouped` says."""
    out: list[dict] = []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if any(p.strip() for p in pieces):
            out.append(_slot(pieces, linked))
        pieces.clear()
        linked = 0

    def inline(n: Node, link: bool) -> None:
        nonlocal linked
        for c in n.children:
            if isinstance(c, str):
                pieces.append(c)
                linked += len(c) if link else 0
            elif _absorbed(c):
                inline(c, link or c.name == "a")
            else:
                flush()
                out.append(expression(c))

    inline(node, False)
    flush()
    return {"l": node.label, "o": 0, "r": 0, "n": 1, "c": _folded(out)}


def grouped(labels: list[str]) -> tuple[list[int], list[bool]]:
    """(place of each label in the shorter list of groups, whether a group is of optional ones): equal neighbours share a place. A label that comes back twice or
    more after others makes all from its first to its last one repeated group of optional labels, (a? b? ...)+, each with one place in it."""
    runs: list[int] = []
    for i, label in enumerate(labels):
        if not i or label != labels[i - 1]:
            runs.append(i)
    spots: dict[str, list[int]] = {}
    for k, i in enumerate(runs):
        spots.setdefault(labels[i], []).append(k)
    until = list(range(len(runs)))  # last run of a group that starts here
    for own in spots.values():
        if len(own) > 2:
            until[own[0]] = own[-1]
    place, optional, k = [], [], 0
    of_run: list[int] = []
    while k < len(runs):
        end, j = until[k], k
        while j <= end:
            end = max(end, until[j])
            j += 1
        if end == k:
            of_run.append(len(optional))
            optional.append(False)
        else:
            own: dict[str, int] = {}
            for r in range(k, end + 1):
                label = labels[runs[r]]
                if label not in own:
                    own[label] = len(optional)
                    optional.append(True)
                of_run.append(own[label])
        k = end + 1
    for r, i in enumerate(runs):
        place += [of_run[r]] * ((runs[r + 1] if r + 1 < len(runs) else len(labels)) - i)
    return place, optional


def _folded(children: list[dict]) -> list[dict]:
    place, optional = grouped([c["l"] for c in children])
    out: list[dict | None] = [None] * len(optional)
    for c, k in zip(children, place, strict=True):
        out[k] = c if out[k] is None else merge(out[k], c) | {"r": 1}
    return [c | {"r": 1, "o": 1} if more else c for c, more in zip(out, optional, strict=True)]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels in a longest common sequence; -1 stands for none. A row of the table of lengths is a number whose bits are its steps."""
    n, m, k = len(a), len(b), 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    while n > k and m > k and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    masks: dict[str, int] = {}
    for j in range(k, m):
        masks[b[j]] = masks.get(b[j], 0) | 1 << j - k
    full = (1 << m - k) - 1
    rows = [full]
    for i in range(k, n):
        v = rows[-1]
        u = v & masks.get(a[i], 0)
        rows.append(((v + u) | (v - u)) & full)
    back, i, j = [], n - k, m - k
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            back.append((-1, k + j))
        else:
            i -= 1
            if i and not rows[i] >> (j - 1) & 1:
                back.append((k + i, -1))
            else:
                j -= 1
                back.append((k + i, k + j))
    back += [(-1, k + x) for x in range(j - 1, -1, -1)] + [(k + x, -1) for x in range(i - 1, -1, -1)]
    return [(x, x) for x in range(k)] + back[::-1] + [(n + x, m + x) for x in range(len(a) - n)]


def merge(a: dict, b: dict) -> dict:
    """The expression that covers both: children are aligned, mismatches become optional, what then comes back is grouped, texts that differ make an open slot."""
    out = {"l": a["l"], "o": a["o"] | b["o"], "r": a["r"] | b["r"], "n": a["n"] + b["n"]}
    if a["l"] == "#text":
        return out | {"c": [], "s": a["s"] + b["s"], "a": a["a"] + b["a"], "h": a["h"] if a["h"] == b["h"] else None}
    x, y = a["c"], b["c"]
    children = []
    for i, j in align([c["l"] for c in x], [c["l"] for c in y]):
        children.append(merge(x[i], y[j]) if i >= 0 and j >= 0 else (x[i] if i >= 0 else y[j]) | {"o": 1})
    return out | {"c": _folded(children)}


@lru_cache(1 << 16)
def ill_named(label: str) -> bool:
    """Whether classes, id or role name what is not an article. States of a layout (has-sidebar, no-comments) and the tags of a post don't."""
    words = [w for w in label.partition(".")[2].split() if not STATES.match(w)]
    if not POST_NAMES.isdisjoint(words):
        words = [w for w in words if not w.startswith(("tag-", "category-"))]
    return bool(BAD_NAMES.search(" ".join(words)))


@lru_cache(1 << 16)
def _bad(label: str) -> bool:
    name = label.partition(".")[0]
    return name in NEVER or name not in STRUCTURE and ill_named(label)


def _article(label: str) -> bool:
    return label.partition(".")[0] == "article" or label.endswith((" article", ".article"))


def _main(label: str) -> bool:
    return label.partition(".")[0] == "main" or label.endswith((".main", " main"))


#: Where an article may be. Names of whole pages say nothing of the article's place.
PLACES = (
    lambda s: _article(s) and not ill_named(s),
    _main,
    _article,
    lambda s: bool(GOOD_NAMES.search(s.partition(".")[2])),
    lambda s: _main(s) or _article(s) and not ill_named(s),  # within containers with other names
)
#: By how much a character counts more in a place than in the page as a whole, the last. A host's texts outweigh names where they differ by more.
PRIOR = (8.0, 6.0, 2.5, 3.0, 1.2, 1.0)
CLEAN, NAMED, LOOSE, OPEN, WHOLE = 0, 3, 4, 5, 6


def _absorbed(n: Node) -> bool:
    """Whether an inline element is part of the text around it."""
    return n.name in INLINE and not ill_named(n.label)


def _blocks(node: Node) -> list[Node]:
    out: list[Node] = []
    for c in node.children:
        if isinstance(c, Node):
            out += _blocks(c) if _absorbed(c) else [c]
    return out


def _find(node, place: int, label, children) -> list:
    """Outermost nodes that a test of PLACES takes."""
    own = label(node)
    name = own.partition(".")[0]
    if own not in ("#page", "#text") and (name in NEVER if place == LOOSE else _bad(own)):
        return []
    if name not in ("#page", "#text", "html", "body") and PLACES[place](own):
        return [node]
    return [x for c in children(node) for x in _find(c, place, label, children)]


def _size(node: Node) -> int:
    """Characters of text outside of menus, notices, forms and the like."""
    return sum(len(c.strip()) if isinstance(c, str) else _size(c) if not _bad(c.label) else 0 for c in node.children)


def place_of(page: Node, wrapper: dict) -> int:
    """The article's place on a page, of those that have text there: the one whose elements hold most text of their own on the host's pages, on average, by PRIOR.

    Text of its own varies from page to page and stands outside of links, menus, notices, forms and the like.
    """
    best, most = OPEN, PRIOR[OPEN] * wrapper["w"].get((OPEN, "#page"), 0.0)
    for place in range(OPEN):
        roots = _find(page, place, lambda n: n.label, _blocks)
        if sum(map(_size, roots)):
            own = PRIOR[place] * max(1e-9, sum(wrapper["w"].get((place, r.label), 0.0) for r in roots))
            if own > most:
                best, most = place, own
    return best


def _weigh(wrapper: dict) -> None:
    """Sets "w" of a host's wrapper: characters of their own, on average, of each (place, label of its elements)."""

    def mass(node: dict, varying: bool, top: bool) -> int:
        if not top and node["l"] != "#text" and _bad(node["l"]):
            return 0
        if node["l"] == "#text":
            same = node["n"] >= 3 and node["h"] is not None and not node["r"]
            return 0 if varying and same else max(0, node["s"] - node["a"])
        return sum(mass(c, varying, False) for c in node["c"])

    # pages that are nearly all alike are copies: there, what is the same counts too
    varying = 10 * mass(wrapper, True, True) > mass(wrapper, False, True)
    sums: dict[tuple[int, str], list[float]] = {(OPEN, "#page"): [mass(wrapper, varying, True), wrapper["n"]]}
    for place in range(OPEN):
        for r in _find(wrapper, place, lambda n: n["l"], lambda n: n["c"]):
            own = sums.setdefault((place, r["l"]), [0.0, 0.0])
            own[0] += mass(r, varying, True)
            own[1] += r["n"]
    wrapper["w"] = {k: total / n for k, (total, n) in sums.items()}


def decide(wrapper: dict) -> dict:
    """Marks each node of a wrapper with "k", a bit for each place of an article: whether the node's own text slots are the article's on pages with that place.

    Pages of a host may differ in their places. Never the article's is what stands within menus, notices, forms and the like. On open pages
    neither is a slot that is mostly links, nor (but in the bit WHOLE) one that says the same on all of three pages or more.
    """
    roots: dict[int, int] = {id(wrapper): 1 << OPEN | 1 << WHOLE}
    for place in range(OPEN):
        for r in _find(wrapper, place, lambda n: n["l"], lambda n: n["c"]):
            roots[id(r)] = roots.get(id(r), 0) | 1 << place

    def mark(node: dict, bits: int) -> None:
        if node["l"] not in ("#page", "#text"):
            if _bad(node["l"]):
                bits = 0
            elif ill_named(node["l"]) and node["l"].partition(".")[0] == "article":
                bits &= ~(1 << CLEAN)  # comments and teasers within an article
        bits |= roots.get(id(node), 0)
        if node["l"] == "#text":
            if node["n"] >= 3 and node["h"] is not None and not node["r"]:
                bits &= ~(1 << OPEN)
            if 2 * node["a"] > node["s"]:
                bits &= ~(1 << OPEN | 1 << WHOLE)
        node["k"] = bits
        for c in node["c"]:
            mark(c, bits)

    mark(wrapper, 0)
    _weigh(wrapper)
    return wrapper


def extract(page: Node, wrapper: dict) -> str:
    """Text of a page's tokens that the wrapper's article slots take, blocks joined by line breaks.

    If nearly all of an open page is the same on the host's pages, they are copies, and what is the same is not left out.
    """
    place = place_of(page, wrapper)
    bit = 1 << (WHOLE if place == OPEN else place)
    blocks: list[tuple[str, bool]] = []  # text, whether it differs between pages

    def take(node: Node, guide: dict, keep: int) -> None:
        items: list[tuple[str, object]] = []  # block-level children and runs of text with inline elements
        pieces: list[str] = []

        def flush() -> None:
            if any(p.strip() for p in pieces):
                items.append(("#text", "".join(pieces)))
            pieces.clear()

        def inline(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    pieces.append(c)
                elif c.name == "br":
                    pieces.append("\n")
                elif _absorbed(c):
                    if c.name in ("td", "th"):
                        pieces.append(" ")
                    inline(c)
                else:
                    flush()
                    items.append((c.label, c))

        inline(node)
        flush()
        spot, optional = grouped([label for label, _ in items])
        folded = [""] * len(optional)
        for (label, _), x in zip(items, spot, strict=True):
            folded[x] = label
        own = guide["c"]
        to = {i: j for i, j in align(folded, [c["l"] for c in own]) if i >= 0 and j >= 0}
        first = {c["l"]: j for j, c in reversed(list(enumerate(own)))}
        for (label, item), x in zip(items, spot, strict=True):
            j = to.get(x, first.get(label, -1))
            next_guide = own[j] if j >= 0 else {"c": [], "k": 0 if _bad(label) else keep}
            if isinstance(item, Node):
                take(item, next_guide, next_guide["k"])
            elif next_guide["k"] & bit:
                block = " ".join(entities.unescape(item).split())
                if block:
                    blocks.append((block, bool(next_guide["k"] & 1 << OPEN)))

    take(page, wrapper, wrapper["k"])
    if place == OPEN:
        own = [b for b in blocks if b[1]]
        if 10 * len(own) > len(blocks) or 10 * sum(len(b) for b, _ in own) > sum(len(b) for b, _ in blocks):
            blocks = own
    return "\n".join(b for b, _ in blocks)


def host_of(url):
    """A URL's host in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each key, merged in order of text so that results don't hang on the order of rows."""

    def run(key, pdf):
        import pandas as pd

        whole = None
        for text in sorted(pdf["wrapper"]):
            one = json.loads(text)
            whole = one if whole is None else merge(whole, one)
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(whole, separators=(",", ":"))]})

    return rows.groupBy(*keys).applyInPandas(run, "host string, wrapper string")


def wrappers(pages: DataFrame, html_col: str = "html", url_col: str = "url", held: int = 2000) -> DataFrame:
    """(host, wrapper) of all pages. Tasks merge the pages they read by host (of `held` hosts at most at a time), so a host's pages never meet
    in one task; what tasks leave is merged in two steps, a part of a host's wrappers and then the host's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, dict] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([json.dumps(w, separators=(",", ":")) for w in own.values()])], ["host", "wrapper"])

        for b in batches:
            for host, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = expression(parse(text.as_py()))
                own[host] = merge(own[host], one) if host in own else one
                if len(own) > held:
                    yield out()
                    own = {}
        if own:
            yield out()

    parts = mapped(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("body")), run, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)))
    return _merged(_merged(salted, ["host", "salt"]), ["host"])


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with kd_text, the article's text ('' if none; a null page is an empty one). Pages without a host make up one host together.

    Long pages are read whole; elements nested deeper than DEEPEST keep their texts. Pages that repeat get the same text, and a host of copies keeps what is the
    same on all. Wrappers hang on no order of rows. An empty table gives no rows. Columns of pages pass through, but one named kd_text is replaced.
    """
    pages = without(pages, "kd_text string")
    of, host, guide = (fresh(n, pages) for n in ("kd_of", "kd_host", "kd_wrapper"))
    known = written(wrappers(pages, html_col, url_col), "wrappers").select(F.col("host").alias(host), F.col("wrapper").alias(guide))
    both = pages.withColumn(of, host_of(F.col(url_col))).join(known, F.col(of) == F.col(host))
    own = pages.columns
    column = own.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, dict] = {}
        for b in batches:
            texts = []
            for body, host, wrapper in zip(b.column(column), b.column(of).to_pylist(), b.column(guide), strict=True):
                if host not in ready:
                    if len(ready) > 500:
                        ready.clear()
                    ready[host] = decide(json.loads(wrapper.as_py()))
                texts.append(extract(parse(body.as_py()), ready[host]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), pa.array(texts, pa.string())], [*own, "kd_text"])

    return mapped(both.select(*own, of, guide), run, extended(pages, "kd_text string"))


def op3_html(pages: DataFrame) -> DataFrame:
    """The contract's columns of `extract_text`, which states all odd cases."""
    found = extract_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("kd_text").alias("text"), F.length("kd_text").cast("long").alias("n_chars"))
