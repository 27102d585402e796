"""Main text of web pages by consensus paths of their host.

Every page's containers are scored by the text they hold themselves, less links; the scores are votes
for the containers' generalised tag-class paths, summed per host in Spark. Each page is then extracted
again from the containers on the path that its host chose. Hosts with several templates choose more paths:
those that hold the best container of a tenth of their pages, three at least; a page takes the one that scores
best in it. A page without any of them falls back on its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by their tags, roles and class words; class words never leave out an element that is or
holds the page's main element, else its largest article, else most of its text, reader comments not counted: they are never
kept, whatever their size, unless the element also holds the page's headline or main element.

A form, or an element hidden from view or from screen readers, that holds the page's headline, main element or an article is the page's frame and no form:
it stays, a hidden one only if the page shows no such element outside. Navigation, asides and forms that are never closed end at the
next article or main element. A page that has no text else gives what its forms and hidden elements hold, less their controls, if that is `FRAME_WORDS`
words or more.

Defined results: null and empty pages have the empty text; a null or odd URL belongs to the host of the
empty name; repeated rows are extracted alike; a page without any container uses its body, broken markup
is closed as browsers do; extra columns are ignored. Whole pages are read, of any length and depth.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Collection
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dealweave.llm.common import lean_batches, written

#: Winners of so many hosts are broadcast at most; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000

# Tags and class words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article main section div td body".split())
SKIPPED = set("nav footer aside form script style noscript template iframe svg math button select option input textarea object embed canvas audio video head title dialog menu map".split())
CLOSES_P = BLOCKS | set("nav footer aside form menu".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_SCOPES = ("td", "th", "button", "object", "caption")
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
BAD_WORDS = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup login paywall sidebar sidebars sidenav nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs footer comment comments commentlist "
    "disqus respond replies related recommended recommendations recirc share sharing sharebar social popup popups modal overlay widget widgets toolbar pagination pager skip hidden alert alerts toplinks".split()
)
#: Class words of reader comments.
REMARKS = set("comment comments commentlist disqus respond replies".split())
#: Words that forms and unseen elements must hold to be a page's text where there is no other.
FRAME_WORDS = 25
#: Skipped elements that may turn out to frame the page, and elements that an article or main element closes if they are never closed.
FRAMES, UNCLOSED = {"form"}, ("nav", "aside", "form")
HEAD_WORDS = set("header masthead topbar".split())
GOOD_WORDS = set("article content post entry main story text body".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: A further template of a host has this share of its pages, and so many pages, at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.1, 3
#: Weight of main elements and articles.
ARTICLE = 3.0
#: Class tokens that speak of something else than the element itself.
_MODIFIERS = re.compile(r"(?<!\S)(?:(?:has|no|not|with|without)[-_]\S*|hidden-(?:xs|sm|md|lg|xl)\S*)", re.I)
#: Share of a page's text that its largest article has at least, and that counts as most of it.
FAIR, MOST = 0.25, 0.75
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    """An element; what depends on the elements around it is carried down, so that depth costs nothing."""

    __slots__ = ("tag", "parent", "children", "skip", "frame", "good", "heading", "marked", "remarks", "depth", "path", "inside", "shown", "holds_h1", "holds_main", "holds_article")

    def __init__(self, tag, label, parent, skip=False, good=1.0):
        self.tag, self.parent, self.skip, self.good = tag, parent, skip, good
        #: Whether neither it nor an element around it is skipped or holds reader comments.
        self.shown = not skip and (parent is None or parent.shown)
        #: Why a skipped element may frame the page: "form" or "unseen".
        self.frame = ""
        self.children, self.heading, self.marked, self.remarks = [], False, False, False
        self.holds_h1 = self.holds_main = self.holds_article = False
        self.depth = parent.depth + 1 if parent else 0
        #: Digest of the tag-class path: each label's, seeded with that of the path to its parent.
        self.path = xxh64_intdigest(label.encode(errors="replace"), parent.path) if parent else 0
        #: Whether it stands inside the article.
        self.inside = parent is not None and (parent.inside or parent.good >= ARTICLE)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None)
        self.marked, self.open, self.frames, self.leads = [], defaultdict(list), [], False
        #: Tags of which more are opened than closed in the page.
        self.unclosed: set[str] = set()

    def _hold(self, node, what):
        """Tells a node and the elements around it what they hold."""
        self.leads, up = self.leads or node.shown, node
        while up is not None and not getattr(up, what):
            setattr(up, what, True)
            up = up.parent

    def _close(self, node):
        """Leaves `node`, and with it all that is open in it."""
        while True:
            left, self.at = self.at, self.at.parent
            self.open[left.tag].pop()
            if left is node:
                return

    def _open(self, tags, stops=()):
        """The innermost open element of `tags`, unless one of `stops` is open inside it."""
        found = max((self.open[t][-1] for t in tags if self.open[t]), key=lambda n: n.depth, default=None)
        if found and any(self.open[t][-1].depth > found.depth for t in stops if self.open[t]):
            return None
        return found

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self._open((tag,)):
            return
        if tag in CLOSES_P and (p := self._open(("p",), P_SCOPES)):
            self._close(p)
        if tag in SIBLINGS and (other := self._open(SIBLINGS[tag], SCOPES[tag])):
            self._close(other)
        if tag in ("article", "main") and (other := self._open(self.unclosed)):
            self._close(other)
        attrs = dict(attrs)
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        words = {w.lower() for w in _WORDS.findall(_MODIFIERS.sub("", names))} if names != " " else set()
        role, top = (attrs.get("role") or "").lower(), tag in ("html", "body")
        unseen = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"
        unseen = unseen or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        skip = tag in SKIPPED or not top and (role in BAD_ROLES or unseen)
        is_article = tag in ("article", "main") or role in ("main", "article")
        is_article = is_article or (attrs.get("itemprop") or "").lower() == "articlebody"
        good = ARTICLE if is_article else 1.5 if words & GOOD_WORDS else 1.0
        classes = {re.sub(r"\d+", "#", c) for c in (attrs.get("class") or "").lower().split()}
        label = ".".join([tag, *sorted(c for c in classes if len(c) <= 40)])
        node = Node(tag, label, self.at, skip, good)
        node.heading = tag == "header" or not top and bool(words & HEAD_WORDS)
        if not top and not skip and tag != "main" and words & BAD_WORDS:
            node.marked, node.remarks = True, bool(words & REMARKS)
            node.shown = node.shown and not node.remarks
            self.marked.append(node)
        if skip and (tag in FRAMES or tag not in SKIPPED and (unseen or role in FRAMES)):
            node.frame = "unseen" if unseen else "form"
            self.frames.append(node)
        if tag == "h1":
            self._hold(self.at, "holds_h1")
        if tag == "main" or role == "main":
            self._hold(self.at, "holds_main")
        if is_article:
            self._hold(self.at, "holds_article")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag].append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math", "script") and self.at.tag == tag:
            self._close(self.at)

    def handle_endtag(self, tag):
        if tag not in ("html", "body") and (found := self._open((tag,))):
            self._close(found)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    lower = html.lower()
    builder.unclosed = {t for t in UNCLOSED if len(re.findall(rf"<{t}[\s/>]", lower)) > lower.count(f"</{t}")}
    builder.feed(html)
    builder.close()
    for node in builder.frames:
        if (node.holds_h1 or node.holds_main or node.holds_article) and (node.frame == "form" or not builder.leads):
            node.skip = False
    for node in builder.marked:
        node.remarks = node.remarks and not (node.holds_h1 or node.holds_main)
    if builder.marked:
        spared = set()
        for node in _keepers(builder.root):
            while node is not None and id(node) not in spared:
                spared.add(id(node))
                node.marked, node = False, node.parent
    return builder.root


def _keepers(root: Node) -> list[Node]:
    """What class words must not leave out: main elements, else the article with most text, else the innermost element with most of the text, comments aside."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if isinstance(x, Node) and not x.skip and not x.remarks]
    sizes = {id(n): 0 for n in order}
    for node in reversed(order):  # inner ones first
        sizes[id(node)] += sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        if node.parent is not None:
            sizes[id(node.parent)] += sizes[id(node)]
    if mains := [n for n in order if n.tag == "main" and sizes[id(n)]]:
        return mains
    articles = [n for n in order if n.tag == "article" and sizes[id(n)] >= FAIR * sizes[id(root)] > 0]
    if articles:
        return [max(articles, key=lambda n: sizes[id(n)])]
    most = [n for n in order if sizes[id(n)] >= MOST * sizes[id(root)] > 0]
    return most[-1:]


def _left_out(node: Node) -> bool:
    """Boilerplate; a header is kept only inside the article and if it holds the page's headline."""
    return node.skip or node.marked or node.heading and not (node.inside and node.holds_h1)


def container_scores(root: Node) -> list[tuple[Node, float, Node | None]]:
    """(container, score, container around it), outer ones first.

    The score is the text that stands nearest to it, links deducted, and half of what its inner containers have.
    """
    scores: dict[int, float] = {}
    order: list[tuple[Node, Node | None]] = []
    todo = [(root, None, False)]
    while todo:
        node, holder, link = todo.pop()
        if node.tag in CONTAINERS:
            order.append((node, holder))
            scores[id(node)] = 0.0
            holder = node
        link = link or node.tag == "a"
        for x in reversed(node.children):
            if isinstance(x, str):
                if holder is not None:
                    n = len("".join(x.split()))
                    scores[id(holder)] += -n if link else n
            elif not _left_out(x):
                todo.append((x, holder, link))
    for node, holder in reversed(order):  # inner ones first
        if holder is not None:
            scores[id(holder)] += max(0.0, scores[id(node)]) / 2
    return [(n, max(0.0, scores[id(n)]) * n.good, holder) for n, holder in order]


def page_votes(html: str) -> list[tuple[int, float]]:
    """(path, share) of a page: its containers' scores over the best one's, the greatest of each path."""
    scored = [(n.path, s) for n, s, _ in container_scores(parse(html)) if s > 0]
    if not scored:
        return []
    best, votes = max(s for _, s in scored), {}
    for path, s in scored:
        votes[path] = max(votes.get(path, 0.0), s / best)
    return list(votes.items())


def text_of(nodes: list[Node], frames: bool = False) -> str:
    """Blocks of text under `nodes`, in page order, one a line; with `frames`, also what stands in forms and unseen elements."""
    blocks: list[str] = []
    words: list[str] = []

    def flush():
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(text)

    for top in nodes:
        todo: list = [(top, False)]
        while todo:
            x, closing = todo.pop()
            if isinstance(x, str):
                words.append(x)
            elif closing:
                flush()
            elif x is top or not _left_out(x) or frames and x.frame:
                if x.tag == "br":
                    words.append(" ")
                block = x.tag in BLOCKS or x is top
                if block:
                    flush()
                    todo.append((x, True))
                todo += [(c, False) for c in reversed(x.children)]
        flush()
    return "\n".join(blocks)


def extract(html: str, path: int | None = None, others: Collection[int] = ()) -> str:
    """Main text of one page: from the outermost containers on `path`, else from its best container, else from its body.

    Of `path` and the paths of the host's other templates, the one that scores best in the page counts.
    """
    if not html:
        return ""
    root = parse(html)
    scored = container_scores(root)
    if others:
        known = {path, *others}
        best = max((x for x in scored if x[0].path in known), key=lambda x: x[1], default=None)
        if best and best[1] > 0:
            path = best[0].path
    found, within = [], set()
    for n, _, holder in scored if path is not None else ():
        if holder is not None and id(holder) in within:
            within.add(id(n))
        elif n.path == path:
            within.add(id(n))
            found.append(n)
    text = text_of(found)
    if not text and scored:
        best = max(scored, key=lambda x: x[1])
        text = text_of([best[0]]) if best[1] > 0 else ""
    text = text or text_of([root])
    if not text:
        framed = text_of([root], True)
        text = framed if len(framed.split()) >= FRAME_WORDS else ""
    return text


def host_of(url) -> F.Column:
    """Lower-case host of a URL without port, user and leading www."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), "^www\\.", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, others): the path with most votes of each host, ties going to the least digest, and those of its other templates, under ten."""

    def run(batches):
        for b in batches:
            hosts, paths, votes, firsts = [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of_page = page_votes(html) if html else []
                first = max(of_page, key=lambda v: (v[1], -v[0]), default=(None, 0))[0]
                for path, share in of_page:
                    hosts.append(host)
                    paths.append(path - (1 << 64) if path >= 1 << 63 else path)
                    votes.append(round(share * 1_000_000))
                    firsts.append(int(path == first))
            columns = [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (paths, votes, firsts))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "votes", "firsts"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, votes long, firsts long")
    summed = rows.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("firsts").alias("firsts"))
    summed = written(summed, "votes")
    best = summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("b"), F.sum("firsts").alias("pages"))
    best = best.select("host", F.col("b.path").alias("path"), "pages")
    often = summed.where(F.col("firsts") >= TEMPLATE_PAGES).select("host", F.col("path").alias("other"), "firsts").join(best, "host")
    often = often.where((F.col("firsts") >= F.col("pages") * TEMPLATE_SHARE) & (F.col("other") != F.col("path")))
    others = often.groupBy("host").agg(F.sort_array(F.collect_list("other")).alias("others"))
    return best.join(others, "host", "left").select("host", "path", F.coalesce("others", F.array().cast("array<long>")).alias("others"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of `pages` (page_id, url, html)."""
    lean_batches(pages.sparkSession)
    winners = written(host_paths(pages), "hosts")

    def run(batches):
        for b in batches:
            texts = []
            for html, path, others in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                path = None if path is None else path % (1 << 64)
                texts.append(extract(html or "", path, [x % (1 << 64) for x in others or ()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    small = winners.count() <= BROADCAST_HOSTS
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(winners) if small else winners, "host", "left")
    return rows.select("page_id", "url", "html", "path", "others").mapInArrow(run, "page_id long, url string, text string")
