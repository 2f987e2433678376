"""Main text of web pages by wrappers inferred from pages of the same host.

A page is a tree of blocks. Its wrapper is a union-free regular expression over that tree:
neighbours of one kind become one repeated group, and so do repeated runs of kinds. Wrappers
of two pages are aligned child by child; a block that only one of them has becomes optional,
a run that one repeats becomes a repeated group, and a text that differs becomes a slot
while a text that is the same on all pages stays constant. Slots outside links show where
the article is; the wrapper of the host then names the article's path in the tree, and every
page gives all text under that path, except marked parts such as menus or comments.

Wrappers are merged inside each batch first, then by host and salt, then by host, so a host
with most of the pages sends one small tree per batch."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import text_slices
from tallyrift.session import materialize

SALTS, BROADCAST_BYTES = 64, 16 << 20
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)/?>|<[!?/][^>]*>""", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed sets of names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
LEFT_OUT_TAGS = RAW | set("head nav header footer aside form button select option fieldset svg object canvas audio video dialog menu".split())
LEFT_OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply "
    "replies respond disqus share sharing social related recommended newsletter subscribe signup login pagination pager toolbar widget complementary "
    "contentinfo search".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html", "blockquote", "nav", "aside", "footer", "header", "form"}


@dataclass
class Block:
    kind: str
    parent: int
    left_out: bool
    main: bool
    texts: list[tuple[str, int]] = field(default_factory=list)  # text and how much of it is links


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in NAMED.finditer(raw)} if raw and "=" in raw or "hidden" in raw else {}


def parse(page: str) -> list[Block]:
    """Blocks of a page in order; the first is the page itself. Inline tags are no blocks,
    end tags may be missing, and text runs end where a block begins or ends."""
    blocks = [Block("", -1, False, False)]
    stack: list[tuple[str, int]] = [("", 0)]  # block tags only
    runs: list[str] = []
    order: list[tuple[int, str]] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join(html.unescape("".join(runs)).split())
            if text:
                blocks[stack[-1][1]].texts.append((text, linked))
                order.append((stack[-1][1], text))
            runs.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            runs.append(text)
            linked += len(text) if in_link else 0

    size = len(page)
    while at < size:
        found = TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            in_link = (not found[1]) if name == "a" else in_link
            if name == "br":
                runs.append(" ")
            continue
        flush()
        in_link = False
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                del stack[depth:]
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        closing = CLOSES.get(name, ()) if name in CLOSES else {"p"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in closing:
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break
        if stack[-1][0] == "p":
            stack.pop()
        attributes = _attributes(found[3])
        words = [w.lower() for k in ("class", "id", "role") for w in PARTS.findall(attributes.get(k, ""))]
        left_out = (
            name in LEFT_OUT_TAGS or not LEFT_OUT_WORDS.isdisjoint(words) or "hidden" in attributes
            or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        main = name in ("article", "main") or attributes.get("role") in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
        kind = name + "".join("." + w for w in sorted(set(words))[:3])
        parent = stack[-1][1]
        blocks.append(Block(kind, parent, left_out and name not in ("html", "body"), main))
        stack.append((name, len(blocks) - 1))
    flush()
    blocks[0].texts.append(("", 0))
    blocks[0].order = order  # type: ignore[attr-defined]
    return blocks


# A wrapper node: kind, pages, repeated, characters of slots outside links, constant text
# (hash; 0 none yet, -1 a slot), article mark, left out, children.
KIND, PAGES, REPEATED, CHARS, CONSTANT, MAIN, OUT, CHILDREN = range(8)


def _fold(children: list[list]) -> list[list]:
    """Repeated neighbours, and repeated runs of up to four kinds, as groups."""
    folded: list[list] = []
    for child in children:
        if folded and folded[-1][KIND] == child[KIND] and child[KIND] != "()":
            folded[-1] = merge(folded[-1], child, folded[-1][PAGES])
            folded[-1][REPEATED] = 1
        else:
            folded.append(child)
    for width in (2, 3, 4):
        at = 0
        if len({c[KIND] for c in folded}) == len(folded):
            break  # nothing repeats
        while at + 2 * width <= len(folded):
            run = folded[at : at + width]
            kinds = [c[KIND] for c in run]
            times = 1
            while [c[KIND] for c in folded[at + times * width : at + (times + 1) * width]] == kinds:
                times += 1
            if times > 1 and "()" not in kinds:
                for k in range(1, times):
                    run = [merge(a, b, a[PAGES]) for a, b in zip(run, folded[at + k * width : at + (k + 1) * width])]
                folded[at : at + times * width] = [["()", 1, 1, 0, 0, 0, 0, run]]
            at += 1
    return folded


def _regroup(children: list[list], groups: list[list[str]]) -> list[list]:
    """Runs that the other page repeats as groups of one turn."""
    for kinds in groups:
        at, out = 0, []
        while at < len(children):
            run = children[at : at + len(kinds)]
            if [c[KIND] for c in run] == kinds:
                out.append(["()", 1, 0, 0, 0, 0, 0, run])
                at += len(kinds)
            else:
                out.append(children[at])
                at += 1
        children = out
    return children


def _kinds(group: list) -> list[str]:
    return [c[KIND] for c in group[CHILDREN]]


def _label(node: list) -> str:
    return node[KIND] if node[KIND] != "()" else "(" + " ".join(_kinds(node)) + ")"


def _align(left: list[list], right: list[list]) -> list[tuple[list, list | None]]:
    """Children of both, in order, as pairs to merge; a child of one side stands alone. Equal
    kinds meet along a longest common subsequence."""
    a, b = [_label(x) for x in left], [_label(x) for x in right]
    if a != b:
        left, right = (
            _regroup(x, [_kinds(g) for g in y if g[KIND] == "()"]) for x, y in ((left, right), (right, left))
        )
        a, b = [_label(x) for x in left], [_label(x) for x in right]
    if a == b:
        return list(zip(left, right))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((left[i], None))
            i += 1
        else:
            out.append((right[j], None))
            j += 1
    return out + [(x, None) for x in left[i:] + right[j:]]


def _joined(left: list, right: list, pages: int | None = None) -> list:
    constant = left[CONSTANT] if left[CONSTANT] == right[CONSTANT] or not right[CONSTANT] else right[CONSTANT] if not left[CONSTANT] else -1
    return [
        left[KIND], left[PAGES] + right[PAGES] if pages is None else pages, left[REPEATED] | right[REPEATED], left[CHARS] + right[CHARS],
        constant, left[MAIN] | right[MAIN], left[OUT] | right[OUT], left[CHILDREN] or right[CHILDREN],
    ]


def merge(left: list, right: list, pages: int | None = None) -> list:
    """One wrapper for what both wrappers match; optional blocks have fewer pages than the
    block they stand in. Pairs wait in a list, so nesting may be of any depth."""
    whole = _joined(left, right, pages)
    waiting = [(whole, left, right)]
    while waiting:
        node, left, right = waiting.pop()
        if not left[CHILDREN] or not right[CHILDREN]:
            continue
        node[CHILDREN] = []
        for a, b in _align(left[CHILDREN], right[CHILDREN]):
            child = a if b is None else _joined(a, b)
            node[CHILDREN].append(child)
            if b is not None:
                waiting.append((child, a, b))
    return whole


def dump(wrapper: list) -> str:
    """A wrapper as flat JSON: its nodes in order, each with its number of children."""
    flat, waiting = [], [wrapper]
    while waiting:
        node = waiting.pop()
        flat.append([*node[:CHILDREN], len(node[CHILDREN])])
        waiting.extend(reversed(node[CHILDREN]))
    return json.dumps(flat)


def load(text: str) -> list:
    nodes = json.loads(text)
    done: list[list] = []  # wrappers of what follows, the nearest last
    for node in reversed(nodes):
        count = node[CHILDREN]
        node[CHILDREN] = done[len(done) - count :][::-1]
        del done[len(done) - count :]
        done.append(node)
    return done[0]


def page_wrapper(blocks: list[Block]) -> list:
    nodes = []
    for b in blocks:
        text = " ".join(t for t, _ in b.texts)
        chars = sum(max(len(t) - link, 0) for t, link in b.texts)
        constant = zlib.crc32(text.encode()) + 1 if text else 0
        nodes.append([b.kind, 1, 0, chars, constant, int(b.main), int(b.left_out), []])
    for node, b in zip(nodes[1:], blocks[1:]):
        nodes[b.parent][CHILDREN].append(node)
    for node in reversed(nodes):
        node[CHILDREN] = _fold(node[CHILDREN])
    return nodes[0]


def article_paths(wrapper: list) -> list[str]:
    """Paths of the article: marked blocks with the most text, else the deepest block that
    holds most of the text that differs from page to page. Of nested paths the outer one."""
    pages = wrapper[PAGES]
    nodes, above, depth, waiting = [], [], [], [(wrapper, -1)]  # a node before its children, those from the last to the first
    while waiting:
        node, parent = waiting.pop()
        if node[OUT]:
            continue
        nodes.append(node)
        above.append(parent)
        depth.append((depth[parent] if parent >= 0 else 0) + (node[KIND] not in ("", "()")))
        waiting.extend((c, len(nodes) - 1) for c in node[CHILDREN])
    total = [n[CHARS] if n[CONSTANT] == -1 or pages < 2 or n[REPEATED] else 0 for n in nodes]
    found = []
    for at in range(len(nodes) - 1, -1, -1):  # children first, in their order
        if above[at] >= 0:
            total[above[at]] += total[at]
        if nodes[at][KIND] != "()":
            found.append(at)
    if not found:
        return [""]

    def path(at: int) -> str:
        kinds = []
        while at >= 0:
            if nodes[at][KIND] not in ("", "()"):
                kinds.append("/" + nodes[at][KIND])
            at = above[at]
        return "".join(reversed(kinds))

    marked = [at for at in found if nodes[at][MAIN]]
    if marked:
        most = max(total[at] for at in marked)
        deep = [at for at in marked if total[at] >= 0.6 * most] if most else marked
        kind = nodes[max(deep, key=lambda at: (depth[at], total[at]))][KIND]
        chosen = {at for at in marked if nodes[at][KIND] == kind}
        under = [False] * len(nodes)
        for at in range(1, len(nodes)):
            under[at] = under[above[at]] or above[at] in chosen
        return sorted({path(at) for at in chosen if not under[at]})
    if not total[0]:
        return [""]
    holding = [at for at in found if total[at] >= 0.6 * total[0]]
    # a lone paragraph is not a region: its block is
    regions = [at for at in holding if nodes[at][KIND].split(".")[0] not in ("p", "li", "h1", "h2", "h3", "td", "tr")] or holding
    return [path(max(regions, key=lambda at: depth[at]))]


def main_text(blocks: list[Block], paths: list[str] | None) -> str | None:
    """All text under one of ``paths`` outside left-out blocks; None if the page has none of
    these paths. Blocks follow the paths step by step, so no path is spelled out per block."""
    steps: dict = {}
    for path in paths or ():
        here = steps
        for kind in path.split("/")[1:]:
            here = here.setdefault(kind, {})
        here[""] = True  # an article begins here; no block has this kind
    known, place = False, [steps if i == 0 else None for i in range(len(blocks))]
    inside, out = [False] * len(blocks), [False] * len(blocks)
    for i, b in enumerate(blocks):
        if i and place[b.parent] is not None:
            place[i] = place[b.parent].get(b.kind)
        out[i] = b.left_out or (i > 0 and out[b.parent])
        here = place[i] is not None and "" in place[i] and not out[i]
        known |= here
        inside[i] = here or (i > 0 and inside[b.parent])
    if not known:
        return None
    return "\n".join(text for i, text in blocks[0].order if inside[i] and not out[i])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _batch_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged: dict[str, list] = {}
        for start, stop, texts in text_slices(batch.column(1)):
            for url, page in zip(batch.column(0).slice(start, stop - start).to_pylist(), texts):
                host, wrapper = host_of(url), page_wrapper(parse(page.decode()))
                merged[host] = merge(merged[host], wrapper) if host in merged else wrapper
        yield _rows({host: dump(wrapper) for host, wrapper in merged.items()})


def _rows(merged: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(merged.keys(), pa.string()), pa.array(merged.values(), pa.string())], ["host", "wrapper"]
    )


def _merge_sorted(finish: bool):
    def last(wrapper: list) -> str:
        return json.dumps(article_paths(wrapper)) if finish else dump(wrapper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper = None, None
        for batch in batches:
            done: dict[str, str] = {}
            for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                other = load(text)
                if name == host:
                    wrapper = merge(wrapper, other)
                else:
                    if wrapper is not None:
                        done[host] = last(wrapper)
                    host, wrapper = name, other
            if done:
                yield _rows(done)
        if wrapper is not None:
            yield _rows({host: last(wrapper)})

    return run


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, wrapper``: the article paths (JSON) that the host's pages agree on."""
    first = pages.select(url, page).mapInArrow(_batch_wrappers, "host string, wrapper string")
    salted = first.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    salted = salted.repartition("host", "salt").sortWithinPartitions("host").select("host", "wrapper")
    second = salted.mapInArrow(_merge_sorted(False), "host string, wrapper string")
    second = second.repartition("host").sortWithinPartitions("host")
    return materialize(second.mapInArrow(_merge_sorted(True), "host string, wrapper string"), "wrappers")


def _text_of(page: str, paths: list[str] | None) -> str:
    blocks = parse(page)
    text = main_text(blocks, paths) if paths else None
    if text is None:  # the host's wrapper has no place for this page
        text = main_text(blocks, article_paths(page_wrapper(blocks)))
    return text or ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: all article text, one block a line.

    A null or empty page has an empty text; a null url belongs to the host without name; a
    page that its host's wrapper does not fit is read by its own; tags may be nested to any
    depth; repeated rows give repeated rows. No pages give no rows. The wrappers are sent to all tasks while they fit
    BROADCAST_BYTES, which is measured; beyond that pages meet them in a join."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    known = host_paths(rows)
    size = known.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint"

    def out(batch: pa.RecordBatch, paths: list[list[str] | None], html_at: int) -> pa.RecordBatch:
        found = []
        for start, stop, texts in text_slices(batch.column(html_at)):
            found += [_text_of(page.decode(), known) for page, known in zip(texts, paths[start:stop])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    if size <= BROADCAST_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast({r.host: json.loads(r.wrapper) for r in known.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield out(batch, [sent.value.get(host_of(u)) for u in batch.column(1).to_pylist()], 2)

        return rows.mapInArrow(run, schema)

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], [*batch.schema.names, "host"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out(batch, [json.loads(w) if w else None for w in batch.column("wrapper").to_pylist()], 2)

    named = rows.mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
    return named.join(known, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(joined, schema)
