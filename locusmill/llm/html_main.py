"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every block element of a page is a node with features of its subtree, attributes, depth and siblings. Trees boosted
on a bounded sample of pages give the log odds that a node holds main text; the page's most likely labelling is found
under the rule that nothing below a dropped node is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Pages that training reads at most (lowest hashes), how often each counts, page layouts made of each, and the size of the boosted model.
TRAIN_PAGES, GIVEN, LAYOUTS, TREES, DEPTH, BINS, RATE = 240, 3, 4, 80, 5, 24, 0.3
#: Longer pages take no part in training; the text of every page is extracted whole.
TRAIN_CHARS = 100_000
#: Rows of a block of two-valued features, and pages that a training task reads.
FLAG_ROWS, TASK_PAGES = 65_536, 15

#: A quote opens a value only behind an equals sign; nothing is tried twice (possessive), so broken tags cost no more.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-truth)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: HTML's element kinds.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "annotation", "annotation-xml"}
#: Inside such an element nothing counts but its own end tag.
RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br object".split())
#: Formulas are text of their paragraph.
INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is open, as far as the element in the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Kinds of attribute tokens.
KINDS = {
    "main": "article content main post entry story text body blog prose",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager",
    "header": "header masthead banner topbar logo hero",
    "footer": "footer copyright legal colophon bottom",
    "side": "sidebar side aside widget related recommended popular trending rail complementary more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp",
    "comment": "comment comments reply replies discussion disqus respond thread",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay banner toast warning message",
    "form": "form subscribe newsletter signup login search contact register",
    "share": "share social sharing follow twitter facebook tags meta byline author",
}
KIND_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(KINDS.values()):
    for _w in _words.split():
        KIND_OF.setdefault(_w, []).append(_i)
TAGS = "body main article section div p h1 h2 h3 ul ol li nav header footer aside form table td blockquote pre figure figcaption button details dl fieldset".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}


class Page:
    """The block elements of a page in page order, and the texts that stand directly in them."""

    def __init__(self, source: str | None) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["body"]
        self.kinds: list[list[int]] = [[]]
        self.truth: list[str | None] = [None]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._read(source or "")

    def _read(self, source: str) -> None:
        open_ = [0]  # open block elements
        depths: dict[str, list[int]] = {}  # places of each kind in that list
        run: list[str] = []
        links = linked = at = 0

        def flush() -> None:
            nonlocal linked
            if run:
                if text := " ".join("".join(run).split()):
                    self.blocks.append((open_[-1], text, linked))
                run.clear()
            linked = 0

        def cut(depth: int) -> None:
            while len(open_) > depth:
                depths[self.tag[open_.pop()]].pop()

        while m := TAG.search(source, at):
            if m.start() > at:
                piece = html.unescape(source[at : m.start()])
                run.append(piece)
                if links:
                    linked += len(piece.strip())
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name in RAW:
                if not m[1] and not m[3].endswith("/"):
                    end = RAW_END[name].search(source, at)
                    at = end.end() if end else len(source)
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if m[1] else 1
                elif name == "br":
                    run.append(" ")
                continue
            if name in VOID:
                flush()
                continue
            if name in ("html", "head", "body"):  # a head may lack its end tag; its elements are RAW or VOID
                continue
            flush()
            links = 0
            if m[1]:
                if depths.get(name):
                    cut(depths[name][-1])
                continue
            if self.tag[open_[-1]] == "p":
                cut(len(open_) - 1)  # any block ends a paragraph
            if name in CLOSES:
                own, within = CLOSES[name]
                last = max((depths[t][-1] for t in own if depths.get(t)), default=0)
                if last > max((depths[t][-1] for t in within if depths.get(t)), default=0):
                    cut(last)
            words, truth = [], None
            for key, *value in ATTRIBUTE.findall(m[3]) if "=" in m[3] else ():
                value = "".join(value)
                if key.lower() == "data-truth":
                    truth = value
                else:
                    words += [t.lower() for t in TOKEN.findall(value)]
            self.parent.append(open_[-1])
            self.tag.append(name)
            self.kinds.append([k for w in words for k in KIND_OF.get(w, ())])
            self.truth.append(truth)
            depths.setdefault(name, []).append(len(open_))
            open_.append(len(self.tag) - 1)
        if at < len(source):
            run.append(html.unescape(source[at:]))
        flush()


def node_features(page: Page) -> np.ndarray:
    """(nodes, features): tag, attribute tokens here and above, depth, siblings, and sums over the subtree."""
    n = len(page.tag)
    own = np.zeros((n, 5))  # characters, characters in links, blocks, sentence ends, elements
    before = np.zeros(n)
    seen = 0
    first = np.full(n, -1.0)
    for at, text, linked in page.blocks:
        row = own[at]
        row[0] += len(text)
        row[1] += min(linked, len(text))
        row[2] += 1
        row[3] += text.count(".") + text.count("?") + text.count("!") + text.count(",")
        if first[at] < 0:
            first[at] = seen
        seen += len(text)
    own[:, 4] = 1
    total = own.copy()
    start = first.copy()
    depth, children, place, same = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    kinds = np.zeros((n, len(KINDS)))
    above = np.zeros((n, len(KINDS)))
    by_tag: dict[tuple[int, str], int] = {}
    for i in range(n):
        for k in page.kinds[i]:
            kinds[i, k] += 1
        if i:
            p = page.parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            above[i] = np.minimum(above[p] + kinds[p], 3)
            by_tag[p, page.tag[i]] = by_tag.get((p, page.tag[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        total[p] += total[i]
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
        same[i] = by_tag[p, page.tag[i]]
    before = np.where(start < 0, 0, start) / max(seen, 1)
    tags = np.zeros((n, len(TAGS)))
    up = np.full(n, -1.0)
    for i, t in enumerate(page.tag):
        if (k := TAG_AT.get(t)) is not None:
            tags[i, k] = 1
        if i:
            up[i] = TAG_AT.get(page.tag[page.parent[i]], -1)
    chars = np.maximum(total[:, 0], 1)
    siblings = np.array([children[p] if i else 1 for i, p in enumerate(page.parent)])
    sums = np.column_stack([
        np.log1p(own[:, 0]), np.log1p(total[:, 0]), total[:, 1] / chars, total[:, 0] / total[:, 4], chars / np.maximum(total[:, 2], 1), total[:, 3] / chars,
        total[:, 0] / max(seen, 1), before, depth, children, place, siblings, place / np.maximum(siblings, 1), same, up, np.log1p(total[:, 4]),
    ])
    return np.hstack([sums, kinds, above, tags]).astype(np.float32)


def flag_sums(low: list[np.ndarray], node: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """For each of ``width`` tree nodes and each two-valued feature the weight of the rows on its low side, a block of rows at a time."""
    out = np.zeros((width, low[0].shape[1]))
    for i, block in enumerate(low):
        rows = slice(i * FLAG_ROWS, i * FLAG_ROWS + len(block))
        by_node = np.zeros((width, len(block)))
        by_node[node[rows], np.arange(len(block))] = weight[rows]
        out += by_node @ block
    return out


class BoostedTrees:
    """Binary logistic boosting with histogram splits; complete trees of equal depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)]).astype(np.int64)
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        self.feature = np.zeros((TREES, 2**DEPTH - 1), np.int64)
        self.cut = np.full((TREES, 2**DEPTH - 1), np.inf, np.float32)
        self.leaf = np.zeros((TREES, 2**DEPTH))
        logit = np.full(len(y), self.base)
        flags = {f: k for k, f in enumerate(f for f, q in enumerate(cuts) if len(q) == 1)}
        low = [(binned[list(flags), a : a + FLAG_ROWS] == 0).T.astype(float) for a in range(0, len(y), FLAG_ROWS)]
        for t in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            g, h = p - y, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width = 2**level
                best = np.zeros(width)
                pick = np.full((width, 2), -1)
                ga, ha = np.bincount(node, g, width)[:, None], np.bincount(node, h, width)[:, None]
                low_g, low_h = flag_sums(low, node, g, width), flag_sums(low, node, h, width)
                for f, (q, b) in enumerate(zip(cuts, binned, strict=True)):
                    if not len(q):
                        continue
                    if f in flags:
                        gl, hl = low_g[:, [flags[f]]], low_h[:, [flags[f]]]
                    else:
                        at = node * (len(q) + 1) + b
                        gl = np.cumsum(np.bincount(at, g, width * (len(q) + 1)).reshape(width, -1), axis=1)[:, :-1]
                        hl = np.cumsum(np.bincount(at, h, width * (len(q) + 1)).reshape(width, -1), axis=1)[:, :-1]
                    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    gain[(hl < 1e-3) | (ha - hl < 1e-3)] = -1
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(width), top] > best + 1e-9
                    best[better] = gain[np.arange(width), top][better]
                    pick[better] = np.column_stack([np.full(width, f), top])[better]
                right = np.zeros(len(y), bool)
                for k, (f, c) in enumerate(pick):
                    if f >= 0:
                        self.feature[t, width - 1 + k], self.cut[t, width - 1 + k] = f, cuts[f][c]
                        own = node == k
                        right[own] = binned[f, own] > c
                node = 2 * node + right
            self.leaf[t] = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            logit += self.leaf[t][node]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def kept_nodes(page: Page, logit: np.ndarray) -> np.ndarray:
    """The most likely labels under the rule that nothing below a dropped node is kept."""
    keep, drop = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    for i in range(len(keep) - 1, 0, -1):
        keep[page.parent[i]] += max(keep[i], drop[i])
        drop[page.parent[i]] += drop[i]
    out = np.zeros(len(keep), bool)
    for i in range(len(keep)):
        out[i] = keep[i] >= drop[i] and (i == 0 or out[page.parent[i]])
    return out


def main_text(page: Page, logit: np.ndarray) -> str:
    kept = kept_nodes(page, logit)
    return "\n".join(text for at, text, _ in page.blocks if kept[at])


_BOILER = ("nav", "header", "footer", "side", "ad", "comment", "notice", "form", "share")
_TAG_OF = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside"), "comment": ("section", "div", "ol"), "notice": ("div", "section"), "form": ("form", "div"), "share": ("div", "ul")}


def layouts(source: str | None, seed: int) -> Iterator[str]:
    """Made pages around one page's own texts: other wrappers, attributes and boilerplate, with ``data-truth`` marks."""
    page = Page(source)
    weak = weak_truth(page)
    main = [t for at, t, _ in page.blocks if weak[at]] or ["Text."]
    words = " ".join(main).split()
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    esc = html.escape

    def phrase(low: int, high: int) -> str:
        at = int(rng.integers(len(words)))
        return " ".join((words[at:] + words[:at])[: int(rng.integers(low, high))])

    def hashed() -> str:
        """A class name that says nothing."""
        return f"{pick(('css', 'sc', 'jsx', 'x'))}-{rng.integers(16**6):x}"

    def boiler(kind: str) -> str:
        tag = pick(_TAG_OF[kind])
        token = pick(KINDS[kind].split())
        name = pick((token, f"{token}-{pick(('box', 'area', 'wrap', 'list', 'block'))}", f"{pick(('site', 'page', 'top', 'my'))}-{token}", f"{token}s")) if rng.random() < 0.85 else hashed()
        attr = "" if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else f' {pick(("class", "id", "class"))}="{name}"'
        if kind in ("nav", "share") or rng.random() < 0.25:
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{esc(phrase(1, 4))}</a></li>' for i in range(int(rng.integers(2, 9)))) + "</ul>"
        elif kind == "comment":
            inner = "".join(f"<{pick(('div', 'li', 'article'))} class=\"{pick(('comment', 'reply', 'item'))}\"><p>{esc(phrase(4, 60))}</p></div>" for _ in range(int(rng.integers(1, 6)))).replace("</div>", "")
        elif kind == "form":
            inner = f"<label>{esc(phrase(1, 4))}</label><input name=q><button>{esc(phrase(1, 3))}</button><p>{esc(phrase(2, 12))}</p>"
        else:
            inner = pick((esc(phrase(2, 25)), f"<p>{esc(phrase(2, 40))}</p>", f"<h3>{esc(phrase(1, 5))}</h3><p>{esc(phrase(3, 30))}</p>", f"&copy; {esc(phrase(2, 10))} &middot; {esc(phrase(1, 5))}"))
        return f'<{tag}{attr} data-truth="0">{inner}</{tag}>'

    def listed() -> str:
        kind = pick(("ul", "ol"))
        return f"<{kind}{mark}>" + "".join(f"<li>{esc(phrase(3, 15))}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{kind}>"

    for _ in range(LAYOUTS):
        wrap = pick(("article", "main", "div", "section", "div", "td", "article", "")) if rng.random() < 0.9 else ""  # "": the text stands in the body
        token = pick(KINDS["main"].split())
        attr = f' class="{pick((token, f"{token}-{pick(("area", "inner", "wrap", "text"))}", f"{pick(("post", "page", "entry"))}-{token}"))}"' if wrap in ("div", "section", "td") or rng.random() < 0.4 else ""
        if wrap and wrap != "td" and (odd := rng.random()) < 0.2:  # names that say nothing, or name what is beside or around the text
            beside = [pick(KINDS[pick(("side", "comment", "header", "footer", "form", "share", "nav"))].split()) for _ in range(2)]
            attr = f' class="{hashed()}"' if odd < 0.07 else f' class="{token} {pick((f"{token}-with-{beside[0]}", f"has-{beside[0]}", f"no-{beside[0]}", f"{beside[0]}-{pick(("wide", "left", "right"))}"))}' + (f' {beside[1]}-{pick(("wide", "on", "off"))}"' if odd < 0.14 else '"')
        start = int(rng.integers(len(main)))
        many = int(rng.integers(1, 4)) if rng.random() < 0.5 else int(rng.integers(1, 25))
        own = (main[start:] + main[:start])[:many] if rng.random() < 0.6 else [phrase(4, 30) for _ in range(many)]
        mark = "" if wrap else ' data-truth="1"'
        title = f"<h1{mark}>{esc(phrase(3, 12))}</h1>" if rng.random() < 0.7 else ""
        body = [f"<header{mark}>{title}</header>" if title and wrap and rng.random() < 0.25 else title]
        close = rng.random() < 0.8
        for text in own:
            tag = pick(("p", "p", "p", "p", "p", "blockquote", "div", "h2"))
            body.append(f"<{tag}{mark}>{esc(text if tag != 'h2' else phrase(2, 8))}" + (f"</{tag}>" if close or tag != "p" else ""))
            if rng.random() < 0.06:
                body.append(boiler(pick(("ad", "side", "share", "form", "notice"))))
            if rng.random() < 0.12:
                body.append(listed())
        if rng.random() < 0.3:
            body.append(boiler(pick(("comment", "share", "footer"))))
        article = f'<{wrap}{attr} data-truth="1">{"".join(body)}' + (f"</{wrap}>" if close else "") if wrap else "".join(body)
        ahead, after = ("".join(boiler(k) for k in kinds if rng.random() < some) for kinds, some in ((("header", "nav", "notice", "ad", "form"), rng.random()), (("comment", "side", "ad", "notice", "form", "share", "footer", "nav"), 0.8 * rng.random())))
        if wrap == "td":
            cells = [f'<td class="{pick(KINDS["nav"].split())}" data-truth="0">' + "".join(f"<a href=/{i}>{esc(phrase(1, 3))}</a> " for i in range(4)) + "</td>", article]
            article = "<table><tr>" + "".join(cells if rng.random() < 0.6 else cells[::-1] if rng.random() < 0.5 else cells[1:]) + "</tr></table>"
        elif not close:
            after = ""
        middle = pick((article, f"<div class=\"{pick(('container', 'wrapper', 'row', 'page', 'layout'))}\">{article}{boiler('side') if close and rng.random() < 0.5 else ''}</div>", f"<div>{boiler('side')}{article}</div>")) if close and wrap else article
        yield f"<html><body>{ahead}{'' if rng.random() < 0.06 else middle}{after}</body></html>"


def weak_truth(page: Page) -> np.ndarray:
    """Labels of a real page by the meaning of its tags: in an article, or main, and in nothing named as boilerplate."""
    bad = {i for i, k in enumerate(KINDS) if k in _BOILER}
    wanted = np.zeros(len(page.tag), np.int64)
    for i in range(1, len(wanted)):
        wanted[i] = wanted[page.parent[i]]
        if page.tag[i] in ("article", "main") and wanted[i] == 0:
            wanted[i] = 1
        if page.tag[i] in ("nav", "footer", "aside", "form", "header") or bad.intersection(page.kinds[i]):
            wanted[i] = -1
    return wanted == 1


def truth_of(page: Page, weak: bool) -> np.ndarray:
    """1 for nodes that hold main text somewhere below, else 0."""
    if weak:
        inner = weak_truth(page)
    else:
        inner = np.zeros(len(page.tag), bool)
        for i in range(1, len(inner)):
            inner[i] = inner[page.parent[i]] if page.truth[i] is None else page.truth[i] == "1"
    own = np.zeros(len(inner), bool)
    for at, _, _ in page.blocks:
        own[at] |= inner[at]
    for i in range(len(own) - 1, 0, -1):
        own[page.parent[i]] |= own[i]
    return own.astype(float)


def train(pages: DataFrame, source: str = "html", max_pages: int = TRAIN_PAGES) -> BoostedTrees:
    """Boosts on ``max_pages`` pages at most, those of lowest hash, and on layouts made around their texts.

    Pages of more than TRAIN_CHARS characters are left out, not cut: a cut page would end in the midst of its elements.
    Features and labels are made on the executors; the bounded table of nodes comes to the driver. Without pages, or
    with one class only, layouts around a fixed sentence are used. Null pages count as empty; repeated pages count as often as they
    stand; only ``source`` is read.
    """
    names = [f"f{i}" for i in range(16 + 2 * len(KINDS) + len(TAGS))]

    def rows_of(sources: list[str]) -> pd.DataFrame:
        x, y = [], []
        for s in sources:
            for made, weak in [*[(s, True)] * GIVEN, *((m, False) for m in layouts(s, len(s)))]:
                page = Page(made)
                x.append(node_features(page))
                y.append(truth_of(page, weak))
        return pd.DataFrame(np.concatenate(x), columns=names).assign(y=np.concatenate(y))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield rows_of(batch.s.tolist())

    chosen = pages.where(F.coalesce(F.length(source), F.lit(0)) <= TRAIN_CHARS).select(F.col(source).alias("s")).orderBy(F.xxhash64("s"), "s").limit(max_pages)
    dealt = chosen.repartition(max(1, -(-max_pages // TASK_PAGES)))
    nodes = dealt.mapInPandas(run, ", ".join(f"{n} float" for n in names) + ", y double").toArrow().to_pandas()
    if nodes.y.nunique() < 2:
        nodes = rows_of(["<article>" + "<p>A plain sentence, of some words, stands here.</p>" * 5 + "</article>"] * 5)
    nodes = nodes.sort_values(nodes.columns.tolist(), kind="stable")
    return BoostedTrees(nodes[names].to_numpy(), nodes.y.to_numpy())


def extract(pages: DataFrame, model: BoostedTrees, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep..., text, n_chars: one row for each row, from the whole page. Null pages count as empty; text is never null.

    Character references are decoded, white space in a block becomes one space, blocks are joined by line ends in page order.
    Repeated rows and null keys are rows like any other; only the named columns are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources = batch.pop("__html").tolist()
            texts: list[str] = []
            for at in range(0, len(sources), 256):
                read = [Page(s) for s in sources[at : at + 256]]
                ends = np.cumsum([len(p.tag) for p in read])
                logit = shared.value.logits(np.concatenate([node_features(p) for p in read]))
                texts += [main_text(p, x) for p, x in zip(read, np.split(logit, ends[:-1]), strict=True)]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.select(*keep, F.col(source).alias("__html")).mapInPandas(run, f"{kinds}, text string, n_chars bigint")
