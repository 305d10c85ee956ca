"""Main text of web pages, by wrappers inferred for each host.

The pages of a host are token streams of one or a few templates. Those of a template are folded pairwise into a union-free
regular expression: labels that agree are aligned, neighbours of one label become a repeated group, what only one side has becomes
optional, and text becomes a slot unless it is the same on every page. The wrapper then tells where the template keeps its
articles and which blocks are its own and no page's (slogans, notices, rights lines); a page is read along it.
"""
from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._shared import settle, slices, work_dir

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>""", re.S)
#: Whole attributes, so that no word of a value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
#: Element names by what they do to text.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_GONE = _RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "template", "object", "canvas", "dialog", "menu", "audio", "video"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hgroup", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words that name what is no article, alone or with words of place and shape, or as the last of others; what
#: a name with a modifier says is said of something else.
_NOISE = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs
footer header masthead comment comments reply replies respond disqus cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login share sharing
social related recommended recommendations popup modal overlay widget pagination pager complementary contentinfo search toolbar alert""".split())
_SHAPE = frozenset("""area articles bar block bottom box button buttons col column container global group inner item items left link links list main outer panel posts primary
right rows secondary section site slot stories thread top unit wrap wrapper""".split())
_LAST = frozenset("ads breadcrumb breadcrumbs comments footer nav navigation pagination sidebar".split())
_MODIFIERS = frozenset("has hide is no not show with without".split())
#: An id on one of these is a place to link to; a heading may be called a header.
_ANCHORS = _HEADINGS | {"section", "p", "li", "dt", "dd", "td", "th", "tr", "span", "figure", "blockquote", "pre", "details", "summary"}
_TITLES = frozenset(("header", "masthead", "banner"))
_ARTICLE = ("article", "main")
#: Noise of an element: by its nature, or by its names only, which a wrapper may overrule.
_SURE, _NAMED = 1, 2
#: An open element of the first kind ends where one of the second begins.
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}}
_SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body"}


def names_noise(token: str) -> bool:
    """Whether a class or id as a whole names what is no article."""
    parts = {w for w in re.split(r"[^a-z]+", token) if w}
    if parts.isdisjoint(_NOISE) or not parts.isdisjoint(_MODIFIERS):
        return False
    return parts <= _NOISE | _SHAPE or re.split(r"[^a-z]+", token.rstrip("0123456789-_"))[-1] in _LAST


def label_of(tag: str, attributes: str) -> tuple[str, int]:
    """(label, noise): the element with its class, and whether it is no part of an article. What is noise by its attributes
    has a mark in its label, and its id."""
    noise, words, seen = _SURE if tag in _GONE else 0, set(), set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'").lower()
        if name in seen:
            continue  # the first of a name counts
        seen.add(name)
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            noise |= _SURE
            words.add("!hidden")
        elif name in ("class", "id", "role"):
            if name == "class":
                words |= {w for w in re.split(r"[^a-z]+", value) if w}
            if tag in ("html", "body", *_ARTICLE) or name == "id" and tag in _ANCHORS:
                continue
            tokens = [x for x in value.split() if not (tag in _HEADINGS and x in _TITLES)]
            if any(x in _NOISE if name == "role" else names_noise(x) for x in tokens):
                noise |= _NAMED
                words.add("!" if name == "class" else f"!{name}-" + "-".join(w for w in re.split(r"[^a-z]+", value) if w))
    return ".".join([tag, *sorted(words)]), noise


def events(page: str) -> Iterator[tuple[str, str, int]]:
    """("open", label, noise), ("close", tag, False), ("text", raw text, in a link) with the ends that HTML lets out."""
    stack: list[str] = []
    link, at, low = 0, 0, ""
    while True:
        m = _TAG.search(page, at)
        if at < (end := m.start() if m else len(page)):
            yield "text", page[at:end], link > 0
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in stack:
                while True:
                    top = stack.pop()
                    yield "close", top, False
                    if top == tag:
                        break
            elif tag not in _BLOCK and tag not in _GONE:
                yield "inline", tag, False
            continue
        if tag == "a":
            link = 1
            continue
        if tag in _VOID:
            yield ("rule" if tag == "hr" else "gap" if tag == "br" else "inline"), tag, False
            continue
        label, noise = label_of(tag, m[3])
        if tag not in _BLOCK and not noise:
            yield "inline", tag, False
            continue
        if tag in _BLOCK:
            k = len(stack) - 1
            while k >= 0 and (stack[k] not in _SCOPE or stack[k] in _ENDS):
                if tag in _ENDS.get(stack[k], ()):
                    for _ in range(len(stack) - k):
                        yield "close", stack.pop(), False
                    break
                k -= 1
        yield "open", label, noise
        if tag in _RAW:
            low = low or page.lower()
            k = low.find(f"</{tag}", at)
            at = len(page) if k < 0 else page.find(">", k) + 1 or len(page)
            yield "close", tag, False
        else:
            stack.append(tag)
    while stack:
        yield "close", stack.pop(), False


# --- wrappers: [label, repeated, optional, text, link text, noise, children, blocks, pages] ----------------------------
# text and link text are amounts; blocks are the texts that all pages have there, by hash, with their lengths


#: Levels and neighbours that a wrapper tells apart. The reading of pages has no such bounds.
_DEPTH, _WIDTH = 60, 64


#: Elements that a template is known by, and how near the root.
_CONTAINERS, _NEAR = {"html", "body", "div", "main", "article", "section", "table", "center"}, 5


def template_of(page: str) -> int:
    """What pages of one template have in common: the paths of labels of the containers near the root, hashed."""
    found, stack = set(), [("", True)]
    for kind, what, noise in events(page):
        if kind == "open":
            path, live = stack[-1]
            live = live and not noise and len(stack) <= _NEAR and what.split(".")[0] in _CONTAINERS
            stack.append((f"{path}/{what}" if live else path, live))
            if live:
                found.add(stack[-1][0])
        elif kind == "close" and len(stack) > 1:
            stack.pop()
    return int.from_bytes(blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: Pages that a template must have, and of them those that must have an element, before a text of it is the template's own;
#: and the most of an average page's text that may be. Pages that are copies of each other so keep what they have.
LEAST_PAGES, MOST_PAGES, MOST_TEXT = 5, 0.5, 0.5


def _hash(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _block(buffer: list[str]) -> str:
    text = " ".join(unescape("".join(buffer)).split())
    buffer.clear()
    return text


def tree_of(page: str) -> list:
    root = ["", 0, 0, 0, 0, 0, [], {}, 1]
    stack, buffer, noise = [root], [], [0]

    def end() -> None:
        if text := _block(buffer):
            stack[-1][7][_hash(text)] = len(text)

    for kind, what, flag in events(page):
        # blocks end where main_text ends them
        if not noise[-1] and (kind in ("close", "rule") or kind == "open" and what.split(".")[0] not in _RAW):
            end()
        if kind == "open":
            noise.append(noise[-1] or flag)
        elif kind == "close" and len(noise) > 1:
            noise.pop()
        elif not noise[-1] and kind in ("text", "gap"):
            buffer.append(what if kind == "text" else " ")
        if kind == "open":
            if len(stack) < _DEPTH:
                stack[-1][6].append(node := [what, 0, 0, 0, 0, int(flag), [], {}, 1])
            else:  # deeper elements are not told apart in the wrapper; their text counts at this one
                node = stack[-1]
            stack.append(node)
        elif kind == "close":
            stack[-1][6] = _groups(stack[-1][6])
            stack.pop()
        elif kind == "text" and (n := len(what.strip())):
            stack[-1][3] += n
            stack[-1][4] += n if flag else 0
    if not noise[-1]:
        end()
    root[6] = _groups(root[6])
    return root


def _groups(children: list) -> list:
    """Neighbours of one label as one repeated group; a long row of changing labels is one group of each."""
    out: list = []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = merge(out[-1], c, False)
            out[-1][1] = 1
        else:
            out.append(c)
    if len(out) > _WIDTH:
        by: dict[str, list] = {}
        for c in out:
            by[c[0]] = [*(m := merge(by[c[0]], c, False))[:1], 1, *m[2:]] if c[0] in by else c
        out = list(by.values())
    return out


def merge(a: list, b: list, pages: bool = True) -> list:
    """The wrapper of both, which are of different pages or else neighbours in one."""
    blocks = {k: n for k, n in a[7].items() if k in b[7]} if pages else a[7] | b[7]
    return [a[0], a[1] | b[1], a[2] | b[2], a[3] + b[3], a[4] + b[4], a[5] | b[5], _groups(_align(a[6], b[6], pages)), blocks, a[8] + b[8] if pages else max(a[8], b[8])]


def _align(a: list, b: list, pages: bool = True) -> list:
    """Longest common subsequence of labels; what one side alone has is optional."""
    n, m = len(a), len(b)
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([*a[i][:2], 1, *a[i][3:]])
            i += 1
        else:
            out.append([*b[j][:2], 1, *b[j][3:]])
            j += 1
    return out


def kept_of(wrapper: list) -> list[str]:
    """Labels of elements that are noise by their names only, but hold most of the text that is no link."""
    found: set[str] = set()

    def mass(node: list) -> int:
        return 0 if node[5] & _SURE else node[3] - node[4] + sum(map(mass, node[6]))

    by: dict[str, int] = {}

    def add(node: list, above: frozenset) -> None:
        if node[5] & _SURE:
            return
        if node[5] and node[0] not in above:
            by[node[0]] = by.get(node[0], 0) + mass(node)
            above = above | {node[0]}
        for c in node[6]:
            add(c, above)

    add(wrapper, frozenset())
    total = mass(wrapper)
    found.update(label for label, n in by.items() if 2 * n > total)
    return sorted(found)


def constants_of(wrapper: list, kept: Collection[str] = ()) -> list[str]:
    """The blocks that are the template's own, as label and hash: in an element that is neither repeated nor within a repeated
    one, and that half of the pages have, the same text on every one of them. None at all, if they are most of the text."""
    found: dict[str, int] = {}
    total = 0

    def walk(node: list, single: bool) -> None:
        nonlocal total
        if node[5] & _SURE or node[5] and node[0] not in kept:
            return
        total += node[3]
        single = single and not node[1]
        if single and node[8] >= max(LEAST_PAGES, MOST_PAGES * wrapper[8]):
            found.update({f"{node[0]}:{h}": n for h, n in node[7].items()})
        for c in node[6]:
            walk(c, single)

    walk(wrapper, True)
    return sorted(found) if sum(found.values()) * wrapper[8] <= MOST_TEXT * total else []


def region_of(wrapper: list, kept: Collection[str] = ()) -> str:
    """Label of the element that holds the articles of a template: of article and main the one with more text, if it has half
    of all that is neither link nor noise (an element about it, if the title stands there). Else the smallest element
    beside which no such text stands."""

    def tag(node: list) -> str:
        return node[0].split(".")[0]

    def lost(node: list) -> bool:
        return bool(node[5]) and (bool(node[5] & _SURE) or node[0] not in kept)

    def mass(node: list) -> int:
        return 0 if lost(node) else node[3] - (0 if tag(node) in _HEADINGS else node[4]) + sum(map(mass, node[6]))

    def tops(node: list, name: str, above: tuple) -> Iterator[tuple[list, tuple]]:
        if lost(node):
            return
        if tag(node) == name:
            yield node, above
            return
        for c in node[6]:
            yield from tops(c, name, (*above, node))

    def has(node: list, names: tuple) -> bool:
        return not lost(node) and (tag(node) in names or any(has(c, names) for c in node[6]))

    total = mass(wrapper)
    found = [(sum(mass(n) for n, _ in places), name, places) for name in _ARTICLE if (places := list(tops(wrapper, name, ())))]
    if found:
        held, _, places = max(found, key=lambda x: (x[0], x[1] == "article"))
        if 2 * held >= total:
            first, above = max(places, key=lambda x: mass(x[0]))
            titled = any(has(n, ("h1", "h2")) for n, _ in places)
            return first[0] if titled else next((n[0] for n in reversed(above) if n[0] and has(n, ("h1",))), first[0])
    node = wrapper
    while True:
        live = [c for c in node[6] if mass(c)]
        if node[3] > node[4] or len(live) != 1 or live[0][1] or tag(live[0]) in _HEADINGS | {"p", "li", "td", "pre", "blockquote"}:
            return node[0]
        node = live[0]


def main_text(page: str | None, region: str = "", kept: Collection[str] = (), constants: Collection[str] = ()) -> str:
    """Blocks inside the region (elsewhere if the page has none) without noise and the template's own, joined by an empty line."""
    if not page:
        return ""
    inside: list[str] = []
    outside: list[str] = []
    stack: list[list] = []  # label, noise, in region
    buffer: list[str] = []
    noise = where = 0
    own = frozenset(constants)

    def end() -> None:
        text = _block(buffer)
        if text and not (own and f"{stack[-1][0] if stack else ''}:{_hash(text)}" in own):
            (inside if where else outside).append(text)

    tag = region.split(".")[0]
    for kind, what, _ in events(page):
        if kind == "text":
            if not noise:
                buffer.append(what)
        elif kind == "open":
            name = what.split(".")[0]
            if not noise and name not in _RAW:  # a script stands within its block
                end()
            # a header is noise but for the headings of an article
            lost = _ & _SURE or _ and what not in kept or name == "header" and region and not where
            here = bool(region) and (what == region or tag in _ARTICLE and name == tag)
            stack.append([what, lost, here])
            noise += bool(lost)
            where += here and not noise
        elif kind == "close":
            if not stack:
                continue
            if not noise:
                end()
            _, lost, here = stack.pop()
            where -= bool(here and not noise)
            noise -= bool(lost)
        elif not noise and kind == "gap":
            buffer.append(" ")
        elif not noise and kind == "rule":
            end()
    if not noise:
        end()
    return "\n\n".join(inside if inside else outside)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


#: Parts in which the wrappers of a host's template are folded first.
_PARTS = 64


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row (columns page_id, url, html).

    Null or empty html, or a page without article text, gives an empty text and 0. A null or strange url is the host "".
    Repeated rows give a row each; an empty table none; other columns do not matter; pages may be long. A task folds the pages
    it has of a template of a host into one wrapper; the wrappers of a host meet in two steps, so a hot one with a row from
    each task is folded by many; pages meet their region in a join that can be split.
    """
    spark, root = pages.sparkSession, work_dir(pages.sparkSession, "html")
    named = pages.select("page_id", "url", "html", host_of().alias("_host"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    tree, at = tree_of(page), (host, template_of(page))
                    held[at] = merge(held[at], tree) if at in held else tree
                if len(held) > 20_000:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array([h for h, _ in held], pa.string()), pa.array([t for _, t in held], pa.int64()), pa.array([json.dumps(t) for t in held.values()], pa.string())], names=["_host", "_template", "wrapper"])

    def folded(table: pa.Table) -> list:
        out = None
        for w in sorted(table.column("wrapper").to_pylist()):
            out = json.loads(w) if out is None else merge(out, json.loads(w))
        return out

    def part(table: pa.Table) -> pa.Table:
        return pa.table({"_host": table.column("_host").slice(0, 1), "_template": table.column("_template").slice(0, 1), "wrapper": pa.array([json.dumps(folded(table))], pa.string())})

    def whole(table: pa.Table) -> pa.Table:
        out = folded(table)
        kept = kept_of(out)
        strings = lambda x: pa.array([x], pa.list_(pa.string()))
        return pa.table({"_host": table.column("_host").slice(0, 1), "_template": table.column("_template").slice(0, 1), "_region": pa.array([region_of(out, kept)], pa.string()), "_kept": strings(kept), "_own": strings(constants_of(out, kept))})

    wrappers = named.select("_host", "html").mapInArrow(learn, "_host string, _template long, wrapper string")
    parts = wrappers.groupBy("_host", "_template", F.pmod(F.xxhash64("wrapper"), F.lit(_PARTS)).alias("_part")).applyInArrow(part, "_host string, _template long, wrapper string")
    regions = settle(parts.groupBy("_host", "_template").applyInArrow(whole, "_host string, _template long, _region string, _kept array<string>, _own array<string>"), f"{root}/regions")

    # what one template of a host has as its own is so in the others too, such as that of a page with one more element
    own = regions.select("_host", F.explode("_own").alias("o")).groupBy("_host").agg(F.sort_array(F.collect_set("o")).alias("_own"))
    regions = regions.drop("_own").join(own, "_host", "left")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([template_of(p) if p else None for p in batch.column("html").to_pylist()], pa.int64())], names=[*batch.schema.names, "_template"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("html").to_pylist()
            for a, b in slices(pages):
                chunk = batch.slice(a, b - a)
                texts = [main_text(p, r or "", k or (), o or ()) for p, r, k, o in zip(pages[a:b], *(chunk.column(c).to_pylist() for c in ("_region", "_kept", "_own")), strict=True)]
                yield pa.record_batch([chunk.column("page_id"), chunk.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    signed = named.mapInArrow(sign, f"page_id {kinds['page_id']}, url {kinds['url']}, html string, _host string, _template long")
    return (signed.join(regions, ["_host", "_template"], "left").select("page_id", "url", "html", "_region", "_kept", "_own")
            .mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"))
