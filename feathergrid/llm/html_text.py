"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page becomes a token stream nested by its block tags (inline markup only
joins text).  Streams of one host are aligned one after the other: equal texts
stay constants, different ones become text slots, neighbours of one shape fold
into repeated groups, and what only some pages have becomes optional.  Partial
wrappers align with each other like pages, so tasks infer them from the pages
they hold and a host with most of the pages needs no task of its own.  The
wrapper then says where the host's pages carry text that varies and is no link;
that region, without elements marked as menus, adverts, comments and so on and
without the host's constant phrases, is a page's main text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, own_names, written

#: A text is a phrase of the host, not of the page, if this many different pages and most of the host's have it at the same single place.
PHRASE_PAGES = 5
#: Rules of up to this many bytes altogether are sent to all executors; more are joined by a shuffle.
SMALL_RULES = 8_000_000
SALTS = 64
#: Blocks nested deeper than this lie side by side in the deepest one kept, as browsers do; no text is lost.
MAX_DEPTH = 200

# HTML's element classes.
VOID = set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
RAW = "script style noscript template textarea title svg math iframe object canvas audio video select xmp".split()
DROPPED = set("head nav footer aside form button fieldset menu dialog datalist".split()) | set(RAW)
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address".split())
CLOSED_BY = {
    "p": set(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hgroup hr main menu nav ol p pre search section summary table ul".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Words in class, id or role that mark an element as no part of an article.
MARKS = set(
    "nav navbar navigation menu menubar topbar masthead header footer sidebar aside rail ad ads adv advert adverts advertisement "
    "advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "toolbar breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies respond social share sharing "
    "related recommended recommendations newsletter subscribe subscription signup login search widget widgets copyright "
    "skip hidden complementary contentinfo dialog form tags".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattr>[^>]*?)(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """A block element: its signature, whether it is marked as noise, and its children (elements and texts)."""

    __slots__ = ("name", "sig", "noise", "children", "inline", "depth", "dead", "shares")

    def __init__(self, name: str, sig: str, noise: bool, inline: bool = False):
        self.name, self.sig, self.noise, self.inline, self.children = name, sig, noise, inline, []
        self.depth, self.dead, self.shares = 0, noise, False

    def add(self, child: Element) -> None:
        """``child`` as the last one; too deep, it writes into this element's list behind a break."""
        child.depth, child.dead = self.depth + 1, self.dead or child.noise
        if self.depth < MAX_DEPTH or child.noise and not self.dead:
            self.children.append(child)
        else:
            self.children.append(Element("", "", False))
            child.depth, child.children, child.shares = self.depth, self.children, True


def _marked(attr: str) -> tuple[str, bool]:
    """Signature of the attributes that shape a page, and whether they mark noise."""
    words, noise = [], False
    for m in _ATTR.finditer(attr):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            words.append(key[0] + re.sub(r"\d+", "#", " ".join(sorted(value.lower().split()))))
            if key != "itemprop" and not MARKS.isdisjoint(w.lower() for w in _WORDS.findall(value)):
                noise = True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            noise = True
    return "".join("." + w for w in words), noise


def parse(html: str) -> Element:
    """The page's blocks.  Texts are ``(raw text, in a link)``; missing, stray and unclosed tags are tolerated."""
    root = Element("html", "html", False)
    stack, links, at = [root], 0, 0

    def close(k: int) -> None:
        shared = any(e.shares and not e.inline for e in stack[k:])
        del stack[k:]
        if shared:
            stack[-1].children.append(Element("", "", False))  # a block has ended

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].children.append((html[at : m.start()], links > 0))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in ("html", "body"):
            continue
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if name in INLINE and not stack[k].inline:
                    break
            continue
        if name == "br" or name == "hr":
            stack[-1].children.append((" ", False))
        if name in VOID:
            continue
        sig, noise = _marked(m["attr"]) if m["attr"].strip(" /\n\t") else ("", False)
        if name in INLINE:
            links += name == "a" and not m["attr"].endswith("/")
            if noise and name != "a":
                part = Element(name, name + sig, True, True)
                stack[-1].add(part)
                stack.append(part)
            continue
        while len(stack) > 1 and (stack[-1].inline or name in CLOSED_BY.get(stack[-1].name, ())):
            close(len(stack) - 1)
        links = 0
        noise = (noise and name not in ("article", "main")) or name in DROPPED
        if name == "header" and not any(e.name in ("article", "main") for e in stack):
            noise = True
        part = Element(name, name + sig, noise)
        stack[-1].add(part)
        if not m["attr"].endswith("/"):
            stack.append(part)
    if at < len(html):
        stack[-1].children.append((html[at:], links > 0))
    return root


def _squeeze(raw: str) -> str:
    return " ".join((unescape(raw) if "&" in raw else raw).split())


# A wrapper item is a list [sig, pages, repeated, optional, chars, link_chars, constant, children].
# Texts have the signature "#"; `constant` is the hash of their text, or None for a slot.
_SIG, _PAGES, _REP, _OPT, _CHARS, _LINKS, _CONST, _KIDS = range(8)


def wrapper_of(element: Element) -> list:
    """The wrapper of one page."""
    kids: list[list] = []
    text, linked = [], 0

    def flush():
        nonlocal text, linked
        value = _squeeze("".join(text))
        if value:
            kids.append(["#", 1, False, False, len(value), min(linked, len(value)), xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")), []])
        text, linked = [], 0

    for child in element.children:
        if isinstance(child, tuple):
            text.append(child[0])
            linked += len(child[0]) if child[1] else 0
        elif child.inline:
            continue
        else:
            flush()
            if not child.noise:
                kids.append(wrapper_of(child))
    flush()
    return [element.sig, 1, False, False, 0, 0, None, _fold(kids)]


def _fold(kids: list[list]) -> list[list]:
    """Neighbours of one shape become a repeated item, neighbouring equal groups of two or three a repeated group."""
    out: list[list] = []
    for kid in kids:
        if out and out[-1][_SIG] == kid[_SIG] and kid[_SIG] != "#":
            out[-1] = _merge(out[-1], kid, within=True)
            out[-1][_REP] = True
        else:
            out.append(kid)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            here, there = out[i : i + size], out[i + size : i + 2 * size]
            if [x[_SIG] for x in here] == [x[_SIG] for x in there]:
                merged = [_merge(a, b, within=True) for a, b in zip(here, there)]
                out[i : i + 2 * size] = merged
                for x in merged:
                    x[_REP] = True
            else:
                i += 1
    return out


def _merge(a: list, b: list, within: bool = False) -> list:
    """Two items of one signature; ``within`` a page the page counts once."""
    pages = max(a[_PAGES], b[_PAGES]) if within else a[_PAGES] + b[_PAGES]
    constant = a[_CONST] if a[_CONST] == b[_CONST] else None
    return [
        a[_SIG], pages, a[_REP] or b[_REP], a[_OPT] or b[_OPT], a[_CHARS] + b[_CHARS], a[_LINKS] + b[_LINKS], constant,
        align(a[_KIDS], b[_KIDS], within),
    ]


def align(a: list[list], b: list[list], within: bool = False) -> list[list]:
    """Align two streams: common items merge, the rest becomes optional, in order."""
    if [x[_SIG] for x in a] == [x[_SIG] for x in b]:
        return [_merge(x, y, within) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    steps = _common(a, b)

    def best(i: int, j: int) -> int:
        """Most items that a[i:] and b[j:] have in common in order."""
        return (steps[i] >> j).bit_count()

    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][_SIG] == b[j][_SIG]:
            out.append(_merge(a[i], b[j], within))
            i, j = i + 1, j + 1
        else:
            take_a = j >= m or (i < n and best(i + 1, j) >= best(i, j + 1))
            item = a[i] if take_a else b[j]
            i, j = (i + 1, j) if take_a else (i, j + 1)
            out.append([*item[:_OPT], True, *item[_OPT + 1 :]])
    return _fold_alike(out)


def _common(a: list[list], b: list[list]) -> list[int]:
    """For each i, bits j where the longest common subsequence of a[i:] and b[j:] is one more than that of b[j+1:].

    A row of the table is one whole number, computed with a few operations on it.
    """
    m = len(b)
    full, where = (1 << m) - 1, {}
    for j, item in enumerate(b):
        # reversed, so that carries run from the end of b to its front
        where[item[_SIG]] = where.get(item[_SIG], 0) | 1 << (m - 1 - j)
    row, rows = full, [0]
    for item in reversed(a):
        match = row & where.get(item[_SIG], 0)
        row = ((row + match) | (row - match)) & full
        rows.append(int(f"{~row & full:0{m}b}"[::-1], 2) if m else 0)
    return rows[::-1]


def _fold_alike(kids: list[list]) -> list[list]:
    """After an alignment: optional items of one shape side by side are one repeated item."""
    out: list[list] = []
    for kid in kids:
        if out and kid[_OPT] and out[-1][_SIG] == kid[_SIG]:
            out[-1] = _merge(out[-1], kid)
            out[-1][_REP] = True
        else:
            out.append(kid)
    return out


def _slots(item: list) -> bool:
    return (item[_SIG] == "#" and item[_CONST] is None) or any(_slots(k) for k in item[_KIDS])


def _weight(item: list, slots_only: bool) -> int:
    """Characters of text that is no link."""
    own = item[_CHARS] - item[_LINKS] if item[_SIG] == "#" and (item[_CONST] is None or item[_REP] or not slots_only) else 0
    return own + sum(_weight(k, slots_only) for k in item[_KIDS])


def _own(item: list, pages: int) -> int:
    """Characters of text that is no link and not the same in most of the host's pages; of one page all text."""
    hosts = item[_CONST] is not None and not item[_REP] and pages > 1 and 2 * item[_PAGES] > pages
    own = item[_CHARS] - item[_LINKS] if item[_SIG] == "#" and not hosts else 0
    return own + sum(_own(k, pages) for k in item[_KIDS])


def rules(wrapper: list) -> dict:
    """Where the main text is (the signatures from the root down) and which phrases belong to the host."""
    varied = wrapper[_PAGES] > 1 and _slots(wrapper)
    total = _weight(wrapper, varied)
    if not total:
        varied, total = False, _weight(wrapper, False)
    named: list[tuple[int, list[str], list]] = []

    def look(item: list, path: list[str]) -> None:
        for kid in item[_KIDS]:
            if kid[_SIG] != "#":
                here = [*path, kid[_SIG]]
                if re.match(r"(article|main)\b", kid[_SIG]) or ".rmain" in kid[_SIG]:
                    named.append((_weight(kid, varied), here, kid))
                look(kid, here)

    look(wrapper, [])
    path, node = [], wrapper
    named = [x for x in named if x[0] >= 0.3 * total and x[0] > 0]
    if named:
        articles = [x for x in named if x[1][-1].startswith("article")] or named
        _, path, node = max(articles, key=lambda x: x[0])
    else:
        pages = wrapper[_PAGES] if varied else 1
        while True:  # down as long as nothing of a page's own stands beside
            kids = [k for k in node[_KIDS] if _own(k, pages)]
            if len(kids) != 1 or kids[0][_SIG] == "#" or kids[0][_SIG].split(".")[0] in TEXT_BLOCKS:
                break
            path, node = [*path, kids[0][_SIG]], kids[0]
    phrases: set[int] = set()

    def collect(item: list, heading: bool, hosts: bool = False) -> None:
        for kid in item[_KIDS]:
            if kid[_SIG] == "#":
                if kid[_CONST] is not None and not kid[_REP] and not heading and kid[_PAGES] >= PHRASE_PAGES and 2 * kid[_PAGES] > wrapper[_PAGES]:
                    phrases.add(kid[_CONST])
            else:
                # A whole block without text of the pages' own is the host's with its headings and paragraphs.
                all_hosts = hosts or not named and kid[_SIG].split(".")[0] not in TEXT_BLOCKS and not _own(kid, wrapper[_PAGES])
                text = re.match(r"h[1-6]\b|p\b", kid[_SIG]) is not None and not all_hosts
                collect(kid, heading or kid[_REP] or text, all_hosts)

    if varied:
        collect(node, False)
    return {"path": path, "phrases": sorted(phrases)}


def blocks(element: Element, phrases: set[int]) -> Iterator[str]:
    """Text blocks of an element in page order, without noise and the host's phrases."""
    text: list[str] = []

    def take() -> Iterator[str]:
        value = _squeeze("".join(text))
        text.clear()
        if value and not (phrases and xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) in phrases):
            yield value

    for child in element.children:
        if isinstance(child, tuple):
            text.append(child[0])
        elif child.inline:  # noise in the middle of a text
            text.append(" ")
        else:
            yield from take()
            if not child.noise:
                yield from blocks(child, phrases)
    yield from take()


def _regions(element: Element, path: list[str]) -> Iterator[Element]:
    if not path:
        yield element
        return
    for child in element.children:
        if isinstance(child, Element) and child.sig == path[0] and not child.noise:
            yield from _regions(child, path[1:])


def extract(html: str | None, rule: dict | None) -> str:
    """Main text of a page by its host's rule; a page that the rule does not fit is its own wrapper."""
    if not html:
        return ""
    root = parse(html)
    for path, phrases in [(rule["path"], set(rule["phrases"]))] if rule else []:
        found = "\n".join(x for region in _regions(root, path) for x in blocks(region, phrases))
        if found:
            return found
    own = rules(wrapper_of(root))
    return "\n".join(x for region in _regions(root, own["path"]) for x in blocks(region, set()))


def host_of(url):
    """The host in lowercase; null or odd addresses share the empty host, whose pages are each their own wrapper."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """``host, rule`` (JSON) for every host; the pages are folded into wrappers where they lie.

    Pages of a host with equal text count once, so copies make no phrase of the
    host.  Rows are known by their place in the table, which must read the same
    each time.
    """
    row = fresh_name(pages, "host")
    pages = pages.select(host_of(F.col("url")).alias(row), "html", F.monotonically_increasing_id().alias("place"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(blocks(parse(html.as_py()), set())) if html.as_py() else "" for html in batch.column(1)]
            digest = [xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digest, pa.string())], names=["host", "place", "digest"])

    hashed = pages.where(f"{row} <> ''").mapInArrow(digests, "host string, place long, digest string")
    once = written(hashed.groupBy("host", "digest").agg(F.min("place").alias("place")).select("place"), "page-texts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if html.as_py():
                    one = wrapper_of(parse(html.as_py()))
                    held[host] = _merge(held[host], one) if host in held else one
                if len(held) >= 2000:
                    yield _packed(held)
                    held = {}
        if held:
            yield _packed(held)

    def _packed(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], names=["host", "wrapper"])

    def join(group: pa.Table) -> pa.Table:
        texts = sorted(group.column("wrapper").to_pylist())
        whole = json.loads(texts[0])
        for text in texts[1:]:
            whole = _merge(whole, json.loads(text))
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(whole)])})

    parts = pages.join(once, "place", "left_semi").select(row, "html").mapInArrow(fold, "host string, wrapper string")
    parts = written(parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))), "wrappers")
    some = parts.groupBy("host", "salt").applyInArrow(join, "host string, wrapper string")

    def rule(group: pa.Table) -> pa.Table:
        whole = join(group)
        return pa.table({"host": whole.column("host"), "rule": pa.array([json.dumps(rules(json.loads(whole.column("wrapper")[0].as_py())))])})

    return some.groupBy("host").applyInArrow(rule, "host string, rule string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (columns ``page_id``, ``url``, ``html``).

    Character references are decoded, white space inside a block is one space,
    and blocks are joined by line feeds in page order.  A null or empty page, or
    one without text, gives an empty text.  Repeated pages give equal texts; an
    empty table gives no rows.  Pages without a host are each their own wrapper.
    Pages are read whole, however long; blocks nested deeper than ``MAX_DEPTH``
    are taken side by side.  Further columns are left out.
    """
    pages = own_names(pages, "page_id", "url", "html")
    found = written(infer(pages), "host-rules")
    size = found.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0
    side = F.broadcast(found) if size <= SMALL_RULES else found
    placed = pages.withColumn("host", host_of(F.col("url"))).join(side, "host", "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, rule in zip(batch.column(2), batch.column(3).to_pylist()):
                if rule and rule not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(extract(html.as_py(), known.get(rule)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
