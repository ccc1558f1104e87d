"""HTML extraction with wrappers inferred per host.

Method: union-free regular-expression inference. A page is a stream of tokens: tags (with class and id, less numbers) and
texts. Within a page, runs of equal parts fold into repeated groups. The pages of a host are then aligned one after the
other with the wrapper so far: matching tags are merged, tags that only one side has become optional groups, parts that
repeat on one side become repeated groups, and texts become slots. A slot keeps how many pages fill it, how often, how much
text and link text it holds, whether the text is the same everywhere, and a sketch of its distinct texts.

The slots decide. A slot of one text is the template's; so is one whose few texts come again and again over pages (an advert,
a notice), measured against how many of the host's pages differ (unless most of the host's text is like that: then it copies its
articles, and this tells nothing); a slot of links is a menu. What is left is text that changes
from page to page, and the article is where most of it is. A group named as an article or content is taken if it holds at least
SHARE of that text, so names only choose among groups that the slots bear out; a group named as boilerplate that holds nearly
all of it isn't boilerplate; with no such name, the lowest group of parts that holds most of it is taken. A host of fewer than
ENOUGH differing pages can't show what repeats: there, names weigh more, and where nearly all text is the same, it is no template's. Extraction reads each page's slots under all groups of
the best kind that the page has, and the headline and texts around them in a main or content group.

Wrappers are folded on the map side and merged by host as a tree, at most FAN wrappers a task, so a host with a third of all
pages is never one task's work. No part is dropped: a node of more than WIDE parts holds them by label instead of in page order,
parts of one label merged, as decisions speak of paths of labels and never of places. So a host's wrapper has as many parts as
the host has paths of labels, and one task holds that; levels below DEEP count as one. Pages meet their host's decisions in a
join whose large side AQE can split; the decisions are broadcast only where Spark finds them under its threshold. Where a host's
decisions are longer than KEPT, its pages don't carry them: they are dealt out by path, and pages of one set of paths get those that
speak of these.

Text: scripts, styles and markup go; character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined in page order by one space. Nothing is dropped or capped besides boilerplate groups.

Defined cases: null or empty html gives the empty text and 0. A null url, or one without `://`, is of host "". A page without
any of its host's article groups is judged by its own wrapper. Pages of any length and depth are read whole. Ties between groups
go to the better kind, then the upper group. Repeated rows and null ids give rows like others; an empty table gives an empty
result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, written

#: Levels of nesting that a wrapper tells apart; parts of a node from which on they are held by label, not in page order; wrappers
#: that one task merges; hosts and, in all their wrappers, parts that one task folds before it hands them on.
DEEP, WIDE, FAN, HOLD, HELD = 200, 400, 16, 500, 100_000
#: Characters of a host's decisions that each of its pages carries; longer ones are dealt out by path.
KEPT = 1 << 16
#: Differing pages from which on a host shows what repeats; share of the changing text that bears a name out; distinct texts in a sketch.
ENOUGH, SHARE, SKETCH = 4, 0.5, 32
#: Pairs of parts up to which two lists of parts are aligned by longest common subsequence; longer ones greedily. Lists
#: of up to WIDE parts, as nodes have them, are never longer.
ALIGN = 250_000

# HTML's elements without content, with raw content, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# A tag on the left is closed by one on the right.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
# Words in a tag, class, id or role that tell what a group is.
NOISE = frozenset("nav navbar navigation menu menus footer foot aside sidebar sidebars ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond form search share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login toolbar widget widgets masthead skip copyright button select option input fieldset dialog legal disclaimer tags toc contentinfo complementary discussion feedback rail".split())
NOISE_STARTS = ("cookie", "sidebar", "advert", "newsletter")
NOISE_ENDS = ("comment", "comments", "sidebar", "menu", "nav", "footer", "banner", "advert", "cookie", "cookies")
HEADS = frozenset(["head", "header", "masthead"])
# A class or id with one of these speaks of a layout or a kind of text, not of the group itself.
QUALIFIERS = frozenset("has with without no free long layout".split())
ROOTS = (frozenset(["article"]), frozenset(["main"]), frozenset("content post entry story articlebody maincontent postcontent entrycontent".split()))
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMBERS = re.compile(r"\d{2,}|(?<![A-Za-z])\d")  # a letter and one digit, as in col2, is a name
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is open, close, or text; for text the rest is the decoded text."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", html.unescape(page[at:])
            return
        if m.start() > at:
            yield "text", "", html.unescape(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        yield "open", name, m[3]
        if m[3].rstrip().endswith("/") and name not in VOID and name not in INLINE and name not in CLOSES and name != "div":
            yield "close", name, ""


def label(name: str, attributes: str) -> str:
    """The tag with its role, class and id names, less numbers."""
    found = [_NUMBERS.sub("", next(x for x in m.groups()[1:] if x is not None)).lower() if m[1].lower() != "class" else _NUMBERS.sub("", next(x for x in m.groups()[1:] if x is not None)) for m in _ATTR.finditer(attributes)] if "=" in attributes else []
    return name + "".join("." + ".".join(x.split()) for x in found if x.strip()).replace("/", "_").replace("|", "_")


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """(path of labels joined by /, text of the block, how many of its characters are link text), in page order."""
    path: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    links, in_link = 0, 0

    def flush():
        nonlocal links
        block = " ".join("".join(text).split())
        out = ("/".join(x for _, x in path[:DEEP]), block, min(links, len(block))) if block else None
        text.clear()
        links = 0
        return out

    for kind, name, rest in tokens(page):
        if kind == "text":
            text.append(rest)
            links += len(rest.strip()) if in_link else 0
        elif name in INLINE:
            in_link = max(0, in_link + (kind == "open") - (kind == "close")) if name == "a" else in_link
        elif name == "br":
            text.append(" ")
        else:
            if b := flush():
                yield b
            if kind == "open":
                while path and name in CLOSES.get(path[-1][0], ()):
                    opened[path.pop()[0]] -= 1
                if name not in VOID:
                    path.append((name, label(name, rest)))
                    opened[name] += 1
            elif opened[name]:
                while (last := path.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
            in_link = 0
    if b := flush():
        yield b


# A wrapper is [label, optional, repeated, children, slot]; a slot is None or [pages, characters, link characters, text, times,
# sketch], where the sketch is the SKETCH smallest CRC32 of its texts. The root has one item more: a slot of the whole pages.
# Children are a list in page order or, where there are more than WIDE, a dict by label.


def page_wrapper(page: str) -> list:
    """The wrapper of one page: its tree, with runs of equal parts folded into repeated groups."""
    root: list = ["", False, False, [], None]
    open_nodes = [root]
    whole = 0
    for path, text, links in blocks(page):
        labels = path.split("/") if path else []
        keep = 0
        while keep < len(labels) and keep + 1 < len(open_nodes) and open_nodes[keep + 1][0] == labels[keep]:
            keep += 1
        keep = min(keep, max(0, len(labels) - 1)) if labels else 0
        del open_nodes[keep + 1 :]
        for x in labels[keep:]:
            node: list = [x, False, False, [], None]
            open_nodes[-1][3].append(node)
            open_nodes.append(node)
        raw = text.encode("utf-8", "surrogatepass")
        crc, whole = zlib.crc32(raw), zlib.crc32(raw, whole)
        open_nodes[-1][4] = _slot(open_nodes[-1][4], [1, len(text), links, text if len(text) <= 200 else f"{len(text)}:{crc}:{zlib.adler32(raw)}", 1, [crc]], same_page=True)
    return [*_fold(root), [1, 0, 0, None, 1, [whole]]]


def _slot(a: list | None, b: list | None, same_page: bool = False) -> list | None:
    if a is None or b is None:
        return a or b
    return [max(a[0], b[0]) if same_page else a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else None, a[4] + b[4], sorted({*a[5], *b[5]})[:SKETCH]]


def _distinct(slot: list) -> float:
    """How many distinct texts a slot has, by its sketch."""
    return len(slot[5]) if len(slot[5]) < SKETCH else (SKETCH - 1) * (1 << 32) / max(1, slot[5][-1])


def _fold(node: list) -> list:
    """Fold tandem repeats of up to four parts among the children into repeated groups, innermost first."""
    todo, order = [node], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x[3]
    for x in reversed(order):
        x[3] = _by_label(_squares(x[3]))
    return node


def _squares(parts: list) -> list:
    for width in (1, 2, 3, 4):
        out: list = []
        for p in parts:
            out.append(p)
            while len(out) >= 2 * width and [x[0] for x in out[-width:]] == [x[0] for x in out[-2 * width : -width]]:
                again = out[-width:]
                del out[-width:]
                for i, y in enumerate(again, len(out) - width):
                    out[i] = align(out[i], y, same_page=True)
                    out[i][2] = True
        parts = out
    return parts


def _matched(xs: list[str], ys: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of positions of equal labels, both rising: a longest common subsequence, or a greedy one of very long lists."""
    front = 0
    while front < min(len(xs), len(ys)) and xs[front] == ys[front]:
        yield front, front
        front += 1
    back = 0
    while back < min(len(xs), len(ys)) - front and xs[-1 - back] == ys[-1 - back]:
        back += 1
    n, m = len(xs) - back, len(ys) - back
    if (n - front) * (m - front) <= ALIGN:
        best = [[0] * (m - front + 1) for _ in range(n - front + 1)]
        for i in range(n - 1, front - 1, -1):
            row, below = best[i - front], best[i - front + 1]
            for j in range(m - 1, front - 1, -1):
                row[j - front] = below[j - front + 1] + 1 if xs[i] == ys[j] else max(below[j - front], row[j - front + 1])
        i, j = front, front
        while i < n and j < m:
            if xs[i] == ys[j]:
                yield i, j
                i, j = i + 1, j + 1
            elif best[i - front + 1][j - front] >= best[i - front][j - front + 1]:
                i += 1
            else:
                j += 1
    else:
        at: dict[str, list[int]] = {}
        for j in range(m - 1, front - 1, -1):
            at.setdefault(ys[j], []).append(j)
        last = front - 1
        for i in range(front, n):
            here = at.get(xs[i], [])
            while here and here[-1] <= last:
                here.pop()
            if here:
                last = here.pop()
                yield i, last
    for k in range(back, 0, -1):
        yield len(xs) - k, len(ys) - k


def align(a: list, b: list, same_page: bool = False) -> list:
    """Merge two parts of one label: matching children merge, the others become optional."""
    xs, ys = a[3], b[3]
    if isinstance(xs, dict) or isinstance(ys, dict):
        children = _union(_labelled(xs), _labelled(ys), same_page)
    elif (lx := [x[0] for x in xs]) == (ly := [y[0] for y in ys]):
        children = [align(x, y, same_page) for x, y in zip(xs, ys)]
    else:
        children, i, j = [], 0, 0
        for k, h in [*_matched(lx, ly), (len(xs), len(ys))]:
            children += [[x[0], True, *x[2:]] for x in xs[i:k]] + [[y[0], True, *y[2:]] for y in ys[j:h]]
            if k < len(xs):
                children.append(align(xs[k], ys[h], same_page))
            i, j = k + 1, h + 1
        children = _by_label(_squares(children))
    whole = [_slot(a[5], b[5])] if len(a) > 5 and len(b) > 5 else []
    return [a[0], a[1] or b[1], a[2] or b[2], children, _slot(a[4], b[4], same_page), *whole]


def _by_label(parts: list) -> list | dict:
    """More than WIDE parts by label; fewer as they are."""
    return parts if len(parts) <= WIDE else _labelled(parts)


def _labelled(parts: list | dict) -> dict:
    """All parts by label, each of them optional: those of one label are one repeated group, wherever they stand."""
    if isinstance(parts, dict):
        return parts
    out: dict[str, list] = {}
    for p in parts:
        x = [p[0], True, *p[2:]]
        if p[0] in out:
            x = align(out[p[0]], x, same_page=True)
            x[2] = True
        out[p[0]] = x
    return out


def _union(xs: dict, ys: dict, same_page: bool) -> dict:
    """The parts of both, in the larger dict: a page's few parts cost no walk over its host's many."""
    big, small = (ys, xs) if len(ys) > len(xs) else (xs, ys)
    for name, y in small.items():
        big[name] = align(big[name], y, same_page) if name in big else y
    return big


def _parts(node: list) -> list:
    return list(node[3].values()) if isinstance(node[3], dict) else node[3]


def _size(node: list) -> int:
    """How many parts a wrapper has."""
    n, todo = 0, [node]
    while todo:
        children = _parts(todo.pop())
        n += len(children)
        todo += children
    return n


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression."""
    inner = ("#text" if node[4] else "") + " ".join(map(expression, _parts(node)))
    body = f"<{node[0]}>{inner}</{node[0].split('.')[0]}>" if node[0] else inner
    return f"({body})" + ("*" if node[1] and node[2] else "+" if node[2] else "?") if node[1] or node[2] else body


def _words(x: str) -> set[str]:
    return {w.lower() for w in _NAMES.findall(x)} | {w.lower() for w in re.split(r"[.]", x)}


def _noise(x: str, inside: bool) -> bool:
    """Whether a group of this label is boilerplate. A header inside the article holds its headline and stays."""
    tag, *names = x.split(".")
    if tag in ("html", "body", "main"):
        return False  # their classes tell how the page is laid out
    w = {tag}.union(*(ws for n in names if not (ws := _words(n)) & QUALIFIERS))
    return bool(w & NOISE) or any(y.startswith(NOISE_STARTS) or y.endswith(NOISE_ENDS) for y in w) or not inside and bool(w & HEADS)


def decide(wrapper: list) -> list[list[str]]:
    """Paths of the groups that hold the article, by kind, best kind first.

    A kind's paths are all its groups and, ending in a blank and +, what stands around them in a main or content group: texts that are
    neither the template's own nor links, and the headline. A path that ends in ! is a slot of the template, or of texts that come
    again; one that ends in a blank and ~ is a group that holds the article though its name speaks against it.
    """
    whole = wrapper[5] if len(wrapper) > 5 else None
    differ = _distinct(whole) / whole[0] if whole else 1.0  # of the host's pages
    shown = bool(whole) and _distinct(whole) >= ENOUGH
    tree: list[dict] = []
    todo = [(wrapper, "", -1)]
    while todo:
        node, above, parent = todo.pop()
        (name, _, repeated, _, slot, *_), children = node, _parts(node)
        links = bool(slot) and slot[2] * 2 >= slot[1]
        again = shown and bool(slot) and slot[4] >= ENOUGH and _distinct(slot) < 0.5 * differ * slot[4]
        once = bool(slot) and (slot[3] is None or slot[0] == 1)
        path = f"{above}/{name}" if above else name
        tree.append({"name": name, "path": path, "parent": parent, "repeated": repeated, "group": bool(children) and not repeated, "slot": slot, "links": links, "again": again, "once": once})
        todo += [(c, path, len(tree) - 1) for c in children]
    texts = [x for x in tree if x["slot"] and not x["links"]]
    same, fresh = (sum(x["slot"][1] for x in texts if x["once"] == once) for once in (False, True))
    if not shown and same > 9 * fresh:  # a few copies of a page: what is added to one isn't the article
        for x in texts:
            x["once"] = True
    shown = shown and same <= fresh  # else the host has one article, again and again
    plain = lambda again: sum(x["slot"][1] for x in texts if x["once"] and x["again"] == again)
    if not shown or plain(True) > plain(False):  # what comes again is most of the text: the host copies its articles, and this tells nothing
        for x in tree:
            x["again"] = False
    for x in tree:
        x["once"] = x["once"] and not x["again"]
        x["mass"] = x["slot"][1] - x["slot"][2] if x["once"] and not x["links"] else 0
    total = [x["mass"] for x in tree]
    for i in range(len(tree) - 1, 0, -1):  # a node's parent stands before it
        total[tree[i]["parent"]] += total[i]
    roots: list[tuple[int, int, str]] = []
    fixed: list[str] = []
    around: list[str] = []
    cleared: list[str] = []
    nodes: list[tuple[str, int, bool, int]] = []  # path, the node above, whether it is one group of parts, its text
    share: dict[str, int] = {}
    place: dict[int, int] = {-1: -1}
    state: dict[int, tuple[bool, bool, int]] = {-1: (False, True, -1)}  # inside a named group, without boilerplate above, depth
    for i, x in enumerate(tree):
        if x["parent"] not in state:
            continue
        (inside, clean, depth), name, path, slot = state[x["parent"]], x["name"], x["path"], x["slot"]
        w = _words(name) | {name.replace("-", "").replace("_", "").split(".")[-1].lower()}
        noisy = bool(name) and _noise(name, inside)
        if noisy and shown and total[0] and total[i] * 10 >= total[0] * 9:
            cleared.append(f"{path} ~")
            noisy = False
        if noisy and not w & ROOTS[0]:
            continue
        clean = clean and not noisy
        kind = next((k for k, r in enumerate(ROOTS) if w & r), None)
        if kind is not None:
            roots.append((len(ROOTS) if noisy else kind, depth + 1, path))  # a comment may be an article of its own: it comes last
            share[path] = max(share.get(path, 0), total[i])
            inside = inside or clean and _encloses(name)
        if slot and (x["again"] or x["links"] and x["repeated"] or not x["links"] and not x["once"] and slot[0] > 2):
            fixed.append(f"{path}!")
        elif clean and slot and (not x["links"] or name.split(".")[0] == "h1" and x["once"]):
            around.append(path)
        state[i], place[i] = (inside, clean, depth + 1), len(nodes)
        nodes.append((path, place[x["parent"]], x["group"], x["mass"]))
    named = [p for _, _, p in sorted(roots)]
    first = {p: i for i, p in reversed([*enumerate(named)])}
    own = [p for p in dict.fromkeys(named) if not any(first.get(q, len(named)) < first[p] for q in _above(p))]
    kinds = {(k, p) for k, _, p in roots}
    out = []
    clean_text = sum(m for *_, m in nodes)
    dropped = [p for p in fixed if shown]
    for k in sorted({k for k, _, _ in roots}):
        groups = [p for p in own if (k, p) in kinds]
        if shown and k < len(ROOTS) and sum(share[p] for p in groups) < SHARE * clean_text:
            continue  # the slots don't bear the name out
        over = {q for p in groups for q in _above(p)} if k < len(ROOTS) else set()
        wide = {q for i, _, q in roots if i < len(ROOTS) and q in over and _encloses(q.rpartition("/")[2])}
        if groups:
            held = set(groups)
            out.append(groups + [f"{t} +" for t in dict.fromkeys(around) if not wide.isdisjoint([t, *_above(t)]) and held.isdisjoint([t, *_above(t)])] + dropped + cleared)
    taken = {p for kind in out for p in kind}
    if not any(k < len(ROOTS) and p in taken for k, _, p in roots):
        out.insert(0, [_centre(nodes), *fixed, *cleared])
    return out


def _above(path: str) -> list[str]:
    """The paths above this one, but for the root's."""
    return [path[: m.start()] for m in re.finditer("/", path)]


def _encloses(name: str) -> bool:
    """Whether a group of this label may hold an article together with its headline: html and body hold the whole page."""
    return name.split(".")[0] not in ("html", "body")


def _centre(tree: list[tuple[str, int, bool, int]]) -> str:
    """Path of the lowest group of parts, repeated ones left whole, that holds most of the text that changes, or the one around it with a headline."""
    total = [mass for *_, mass in tree]
    for i in range(len(tree) - 1, 0, -1):  # a node's parent stands before it
        total[tree[i][1]] += total[i]
    titled = {parent for path, parent, _, mass in tree if mass and path.rpartition("/")[2].split(".")[0] in ("h1", "h2")}
    at = 0
    for i, (_, parent, group, _) in enumerate(tree):
        if parent == at and at not in titled and group and total[i] * 10 >= total[0] * 7 and total[0]:
            at = i
    return tree[at][0]


def text_of(page: str | None, groups: list[list[str]] | None) -> str:
    """The page's text, in page order, under all groups of the first kind that the page has; else by the page's own wrapper."""
    if not page:
        return ""
    found = list(blocks(page))
    for chosen in (groups or [], None):
        for paths in decide(page_wrapper(page)) if chosen is None else chosen:
            fixed = {p[:-1] for p in paths if p.endswith("!")}
            more = {p[:-2] for p in paths if p.endswith(" +")}
            clear = {p[:-2] for p in paths if p.endswith(" ~")}
            kind = {p for p in paths if not p.endswith(("!", " +", " ~"))}
            under: dict[str, bool] = {}
            for path, _, _ in found:
                if path not in under:
                    under[path] = path not in fixed and any(_holds(k, path, clear) for k in dict.fromkeys(["", *_above(path), path]) if k in kind)
            if any(under.values()):
                return " ".join(text for path, text, _ in found if under[path] or path in more)
    return ""


def _holds(group: str, path: str, clear: set[str]) -> bool:
    """Whether the path is under the group, without boilerplate between them."""
    if group and path != group and not path.startswith(f"{group}/"):
        return False
    at = group
    for x in path[len(group) :].strip("/").split("/") if path != group else ():
        at = f"{at}/{x}" if at else x
        if _noise(x, True) and at not in clear:
            return False
    return True


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), F.lit("")))


def _merge_all(parts: Iterator[str]) -> list | None:
    out = None
    for p in parts:
        w = json.loads(p)
        out = w if out is None else align(out, w)
    return out


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) for every host."""
    lean_batches(pages.sparkSession)
    most_parts = HELD

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        parts = 0
        for b in batches:
            for host, page in zip(b["host"], b["html"]):
                w = page_wrapper(page)
                parts += _size(w)
                held[host] = align(held[host], w) if host in held else w
                full = len(held) > HOLD
                if parts > most_parts:  # as many as in the pages; what is held may be far less
                    parts = sum(map(_size, held.values()))
                    full = full or parts * 2 > most_parts
                if full:
                    yield pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})
                    held, parts = {}, 0
        if held:
            yield pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [b["host"].iloc[0]], "wrapper": [json.dumps(_merge_all(iter(sorted(b["wrapper"]))))]})

    some = pages.where("html is not null and html <> ''").select(_host(F.col("url")).alias("host"), "html")
    parts = written(some.mapInPandas(fold, "host string, wrapper string").withColumn("part", F.monotonically_increasing_id()), "parts")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > FAN:
        # wrappers of one host are dealt out at random: about FAN of them meet in a task
        salt = F.pmod(F.xxhash64("part"), F.lit(-(-most // FAN)))
        parts = written(parts.groupBy("host", salt.alias("salt")).applyInPandas(meet, "host string, wrapper string").withColumn("part", F.monotonically_increasing_id()), "parts")
    return parts.groupBy("host").applyInPandas(meet, "host string, wrapper string")


def _dealt_out(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows of the hosts in chosen, each with those of its host's decisions that speak of its paths; the others can't tell on it."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for host, groups in zip(b["host"], b["groups"]):
                for kind, paths in enumerate(json.loads(groups)):
                    for at in range(0, len(paths), 10_000):
                        some = paths[at : at + 10_000]
                        yield pd.DataFrame({"host": host, "kind": kind, "entry": some, "path": [p[:-1] if p.endswith("!") else p[:-2] if p.endswith((" +", " ~")) else p for p in some]})

    @F.pandas_udf("array<string>")
    def paths(s: pd.Series) -> pd.Series:
        return s.map(lambda page: sorted({q for path in {p for p, _, _ in blocks(page or "")} for q in ("", *_above(path), path)}))

    rows = rows.join(chosen.select("host"), "host", "left_semi").withColumn("paths", paths("html"))
    rows = rows.withColumn("shape", F.sha2(F.concat_ws("\n", "paths"), 256))
    need = rows.select("host", "shape", "paths").dropDuplicates(["host", "shape"]).select("host", "shape", F.explode("paths").alias("path"))
    told = need.join(chosen.mapInPandas(entries, "host string, kind int, entry string, path string"), ["host", "path"])
    kinds = told.groupBy("host", "shape", "kind").agg(F.collect_list("entry").alias("entries"))
    groups = kinds.groupBy("host", "shape").agg(F.to_json(F.sort_array(F.collect_list(F.struct("kind", "entries")))["entries"]).alias("groups"))
    return rows.join(groups, ["host", "shape"], "left").select("page_id", "url", "html", "groups")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    @F.pandas_udf("string")
    def groups(s: pd.Series) -> pd.Series:
        return s.map(lambda w: json.dumps(decide(json.loads(w))))

    chosen = written(infer(pages).select(F.col("host"), groups("wrapper").alias("groups")), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"))
    long = chosen.where(F.length("groups") > KEPT)
    if long.isEmpty():
        rows = rows.join(chosen, "host", "left").select("page_id", "url", "html", "groups")
    else:
        few = rows.join(long.select("host"), "host", "left_anti").join(chosen.where(F.length("groups") <= KEPT), "host", "left")
        rows = few.select("page_id", "url", "html", "groups").unionByName(_dealt_out(rows, long))

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str | None, list[str] | None] = {None: None}
        for pages_, groups_ in batches:
            out = []
            for page, g in zip(pages_, groups_):
                if g not in known:
                    known[g] = json.loads(g)
                out.append(text_of(page, known[g]))
            yield pd.Series(out, dtype=object)

    out = rows.select("page_id", "url", F.coalesce(read("html", "groups"), F.lit("")).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
