"""Main text of web pages by site template removal.

Every element subtree of a page is hashed; Spark counts on how many pages of the host each hash occurs, and subtrees
that recur on at least half of the host's pages (three or more) are template and go. What is furniture by its element,
role or a whole class or id token (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles,
comments) goes as well, as it need not recur. On hosts too small to count, parts of hyphenated names tell furniture
outside articles too. The text is that of ``main`` where it encloses the ``article`` elements, else of those, else of
``main``, else of the body. Those containers themselves, and the text blocks of the article (of ``main`` on pages without
one) with the elements around them, are content even if they recur; text blocks and inline elements of it are never
furniture by name. An ``article`` named comment is one only beside another article or ``main``, or among several. Pages of
equal html count once.

The host's templates, which are bounded by twice a page's subtrees, travel to the pages, whose html is not shuffled: as a
broadcast up to TEMPLATES_SENT hashes in all, beyond it by a join whose hosts are dealt over SALTS parts.

Blocks are joined by two newlines, white space inside a block becomes one space, character references are decoded.

Defined results: null or empty html gives an empty text; pages without a host have no template; unclosed elements end
where their parent does; nothing is cut, however long or deep; repeated rows are extracted separately, and count as
one page of their host; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pricebase.llm.common import prepared, written
from pricebase.llm.url_filter import host_of

#: A subtree is template from this share of its host's pages, and this many pages, on.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
#: Hashes of all hosts that are broadcast at most; parts over which a host's pages are dealt beyond it.
TEMPLATES_SENT, SALTS = 2_000_000, 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title xmp object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th figcaption caption summary".split())
FURNITURE = frozenset("head nav footer aside form button select dialog menu fieldset".split()) | RAW
CONTAINERS = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "related replies respond share sharing sidebar social sponsor sponsored sponsors subscribe toolbar widget".split()
)
#: Elements whose start ends an open element of these tags (up to the containers after the bar).
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
_P_SCOPE = frozenset("table td th caption button html body article main".split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")


_P = frozenset(("p",))
ARTICLE, MAIN = 1, 2
#: Class or id tokens of an ``article`` that is a reader's comment.
COMMENTS = frozenset("comment comments comment-body comment-list".split())


class Node:
    __slots__ = ("tag", "tokens", "roles", "children", "digest", "holds_main", "holds_text", "around", "inside")

    def __init__(self, tag: str, attributes: str, around: int):
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        self.tag, self.children, self.digest, self.holds_main, self.holds_text = tag, [], 0, False, False
        self.tokens = frozenset(f"{found.get('class', '')} {found.get('id', '')}".split()) if found else frozenset()
        self.roles = frozenset(found.get("role", "").split()) if found else frozenset()
        #: the containers around it, ARTICLE and MAIN; whether that of the page's text is among them
        self.around, self.inside = around, False

    def container(self) -> int:
        return ARTICLE if self.tag == "article" else MAIN if self.tag == "main" or "main" in self.roles else 0

    def closed(self) -> None:
        own = xxhash.xxh64(self.tag)
        for name in sorted({w for token in self.tokens for w in _WORDS.findall(token)}):
            own.update(f"\0{name}")
        for child in self.children:
            own.update(f"\1{child}" if isinstance(child, str) else b"\2" + child.digest.to_bytes(8, "little"))
        self.digest = own.intdigest()

    def comment(self) -> bool:
        return self.tag == "article" and bool(self.tokens & COMMENTS)

    def furniture(self, by_parts: bool) -> bool:
        """Whether its element, role or name tells so; parts of a name count only if asked for, and outside articles."""
        if self.tag in CONTAINERS:
            return False
        if self.tag in FURNITURE or self.tag == "header" and not self.around:
            return True
        if self.holds_main or self.tag in TEXT_BLOCKS or self.inside and self.tag not in BLOCKS:
            return False
        if self.tokens & NAMES or self.roles & ROLES:
            return True
        return by_parts and not self.inside and any(not NAMES.isdisjoint(_WORDS.findall(token)) for token in self.tokens)

    def may_be_template(self) -> bool:
        if self.tag not in BLOCKS or self.tag in CONTAINERS or self.holds_main:
            return False
        return not (self.inside and (self.holds_text or self.tag in TEXT_BLOCKS))


class _Open:
    """The open elements, and where the last one of a tag or of a set of tags is, whatever the depth."""

    def __init__(self, root: Node):
        self.nodes, self._at = [root], {}
        self._sets: dict[frozenset[str], list[int]] = {tags: [] for tags in (BLOCKS, _P_SCOPE)}

    def push(self, node: Node) -> None:
        self._at.setdefault(node.tag, []).append(len(self.nodes))
        for tags, places in self._sets.items():
            if node.tag in tags:
                places.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> Node:
        node = self.nodes.pop()
        if self.nodes:
            self._at[node.tag].pop()
            for tags, places in self._sets.items():
                if node.tag in tags:
                    places.pop()
        return node

    def _last(self, tags: frozenset[str]) -> int:
        if tags in self._sets:
            return self._sets[tags][-1] if self._sets[tags] else 0
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def inside(self, tags: frozenset[str], scope: frozenset[str]) -> int | None:
        """The place of the innermost open element of these tags, unless one of the scope lies further inside."""
        found = self._last(tags)
        return found if found and found >= self._last(scope) else None


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all elements, in the order in which they end."""
    root = Node("html", "", 0)
    opened, done, at = _Open(root), [], 0
    stack = opened.nodes

    def close(n: int) -> None:
        while len(stack) > n:
            node = opened.pop()
            node.closed()
            done.append(node)

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(unescape(part) if "&" in part else part)

    size, pending, last = len(html), 0, html.rfind(">")
    while at < size:
        less = html.find("<", at)
        if not 0 <= less < last:
            break
        found = _MARKUP.match(html, less)
        if not found:
            at = less + 1  # an ordinary character
            continue
        text(html[pending:less])
        at = pending = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if (n := opened.inside(frozenset((tag,)), frozenset() if tag in BLOCKS else BLOCKS)) is not None:
                close(n)
            continue
        if tag in BLOCKS and (n := opened.inside(_P, _P_SCOPE)) is not None:
            close(n)
        if tag in _IMPLIED:
            while (n := opened.inside(*_IMPLIED[tag])) is not None:
                close(n)
        node = Node(tag, found[3], stack[-1].around | stack[-1].container())
        stack[-1].children.append(node)
        if node.container():
            for around in reversed(stack):
                if around.holds_main:
                    break
                around.holds_main = True
        if tag in TEXT_BLOCKS:
            for around in reversed(stack):
                if around.holds_text:
                    break
                around.holds_text = True
        if tag in VOID:
            node.closed()
            done.append(node)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else size])
            at = pending = end.end() if end else size
            node.closed()
            done.append(node)
        else:
            opened.push(node)
    text(html[pending:])
    close(0)
    articles = any(n.tag == "article" for n in done)
    for node in done:
        node.inside = bool(node.around & (ARTICLE if articles else MAIN))
    return root, done


def template_candidates(html: str) -> set[int]:
    """The hashes of the page's subtrees that may be template."""
    return {n.digest for n in parse(html)[1] if n.tag not in VOID and n.children and n.may_be_template()}


def main_text(html: str, template: frozenset[int] | set[int] | None) -> str:
    """``template`` is None where the host has too few pages to count."""
    root, done = parse(html)
    articles = [n for n in done if n.tag == "article"]
    lone = len(articles) == 1 and not any(n.container() == MAIN for n in done)

    def goes(node: Node) -> bool:
        if node.comment() and not lone:
            return True
        return bool(template) and node.digest in template and node.may_be_template() or node.furniture(template is None)

    found: dict[int, list[Node]] = {ARTICLE: [], MAIN: []}
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or goes(node):
            continue
        if kind := node.container():
            found[kind].append(node)
        if kind != ARTICLE:
            stack += reversed(node.children)
    enclosed = found[MAIN] and all(n.around & MAIN for n in found[ARTICLE])
    tops = found[MAIN][:1] if enclosed else found[ARTICLE]
    blocks: list[str] = []
    part: list[str] = []

    def ended() -> None:
        if words := " ".join("".join(part).split()):
            blocks.append(words)
        part.clear()

    for top in tops or [root]:
        ended()
        walk: list = [top]
        while walk:
            node = walk.pop()
            if node is None:
                ended()
            elif isinstance(node, str):
                part.append(node)
            elif node is top or not goes(node):
                if node.tag == "br":
                    part.append(" ")
                if node.tag in BLOCKS:
                    ended()
                    walk.append(None)
                walk += reversed(node.children)
        ended()
    return "\n\n".join(blocks)


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template) of hosts with enough pages: the hashes that recur, at most twice a page's number of subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, contents = [], [], []
            for host, html, content in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "content"))):
                found = template_candidates(html)
                hosts += [host] * len(found)
                hashes += [h - (1 << 64) if h >> 63 else h for h in found]
                contents += [content] * len(found)
            columns = [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "hash", "content"])

    with_host = pages.where("host <> ''").select("host", "html", F.xxhash64("html").alias("content"))
    sizes = with_host.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    found = with_host.mapInArrow(run, "host string, hash long, content long").distinct()
    counts = found.groupBy("host", "hash").agg(F.count("*").alias("n"))
    recurring = counts.where(F.col("n") >= TEMPLATE_PAGES).join(sizes, "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    lists = recurring.groupBy("host").agg(F.collect_list("hash").alias("template"))
    return sizes.select("host").join(lists, "host", "left").select("host", F.coalesce("template", F.array().cast("array<bigint>")).alias("template"))


def _with_templates(rows: DataFrame) -> DataFrame:
    """The rows with their host's ``template``, null on hosts with too few pages to count."""
    templates = written(host_templates(rows), "templates")
    sent = templates.agg(F.sum(F.size("template") + F.lit(1))).first()[0] or 0
    if sent <= TEMPLATES_SENT:
        return rows.join(F.broadcast(templates), "host", "left")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    copies = templates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["host", "salt"], "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, url, text, n_chars (code points)."""
    prepared(pages.sparkSession)
    rows = pages.select(id_col, url_col, host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    joined = _with_templates(rows).select(id_col, url_col, "html", "template")
    schema = StructType(
        [joined.schema[id_col], joined.schema[url_col], StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                texts.append(main_text(html, None if template is None else {h % (1 << 64) for h in template}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema.names,
            )

    return joined.mapInArrow(run, schema)
