"""Main text of web pages by a site style tree.

Every page becomes a tree of block elements, each known by its path of tags and classes. The trees of a
host are merged: for each path, the entropy of its children's styles and of its texts over the pages says
how important it is. Branches that look alike on all pages, and those whose presentation names them as
menus, headers, footers, sidebars, notices, adverts, forms or comments, are taken out of each page.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.store import stored
from faultline.operators.scale import is_small

#: nodes under this importance are taken out where the host shows them on enough pages
LEAST, PAGES = 0.2, 5
#: weight of a node's styles against that of the texts below it
STYLE_WEIGHT = 0.1
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: elements whose text is never part of the article
CHROME_TAGS = frozenset(
    "head script style noscript template svg iframe object canvas nav footer aside form button select textarea dialog menu title audio video".split()
)
RAW_TAGS = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: words of class, id and role that name such parts
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist respond reply replies disqus share sharing social related recommended widget "
    "search pagination pager toolbar copyright skip masthead topbar".split()
)
#: words that name a page's header; inside the article a header holds the article's own title
HEADER_WORDS = frozenset(("header", "heading-bar", "site-header"))
#: classes that tell what a page has or lacks, such as no-sidebar or comments-open, name no part
STATE = re.compile(r"(?:no|not|non|has|have|with|without)[-_].*|.*[-_](?:open|closed|enabled|disabled|off)")
#: an opening tag that ends an open element of the same group
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")


@dataclass
class _Node:
    tag: str
    path: str
    chrome: bool
    main: bool
    kept: bool = False
    hard: bool = False
    #: the text before an inline element, and how many elements of its name are open in it
    held: list[str] = field(default_factory=list)
    nested: int = 0
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    path: str
    chrome: bool
    main: bool
    text: str
    #: inside an article or main element, if only names above it speak against it
    kept: bool = False


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for m in ATTR.finditer(raw):
        name = (m[1] or m[5]).lower()
        found.setdefault(name, html_module.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _named(raw: str) -> tuple[str, set[str], bool]:
    """Classes for the path, words of class, id and role, and whether the element is hidden."""
    if "=" not in raw and "hidden" not in raw:
        return "", set(), False
    attrs = _attributes(raw)
    classes = ".".join(sorted(set(attrs.get("class", "").lower().split())))
    names = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower()
    names = " ".join(x for x in names.split() if not STATE.fullmatch(x))
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return classes, set(re.findall(r"[a-z0-9]+", names)), hidden


def parse(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """The blocks of a page in order, and (path, styles of its children) of every element on the way."""
    root = _Node("", "", False, False)
    stack, blocks, seen, pieces = [root], [], [], []
    skip_name, at = "", 0

    def flush() -> None:
        if pieces:
            text = " ".join(html_module.unescape("".join(pieces)).split())
            pieces.clear()
            node = stack[-1]
            if text:
                blocks.append(Block(node.path, node.chrome, node.main, text, node.kept))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            flush()
            node = stack.pop()
            pieces.extend(node.held)
            seen.append((node.path, " ".join(dict.fromkeys(node.children))))

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        pieces.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                pieces.append(html_module.escape(m.group()[9:].removesuffix("]]>")))
            continue
        block = name in BLOCKS or name in CHROME_TAGS
        if m["end"]:
            if block:
                flush()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
                if depth:
                    pop_to(depth)
            elif name in ("br", "hr"):
                pieces.append(" ")
            elif depth := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0):
                if stack[depth].nested:
                    stack[depth].nested -= 1
                else:
                    pop_to(depth)
            continue
        if name in ("br", "hr", "img", "wbr"):
            pieces.append("" if name == "wbr" else " ")
            continue
        if name in VOID_TAGS:
            continue
        if name in RAW_TAGS:  # taken out without a trace; the text around stays one block
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        classes, words, hidden = _named(m["attrs"] or "")
        named = hidden or bool(words & CHROME_WORDS)
        if not block and not named:
            open_one = next((x for x in reversed(stack) if x.tag == name), None)
            if open_one:
                open_one.nested += 1
            continue
        if block:
            flush()
        if name in BLOCKS:
            top = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if top and name not in ("html", "body"):
                pop_to(top)
            for tag in CLOSES.get(name, ()):
                if stack[-1].tag == tag:
                    pop_to(len(stack) - 1)
        parent = stack[-1]
        style = f"{name}.{classes}" if classes else name
        parent.children.append(style)
        header = (name == "header" or bool(words & HEADER_WORDS)) and not (parent.main or parent.kept)
        chrome = parent.chrome or name in CHROME_TAGS or (named and name not in ("html", "body")) or header
        main = (parent.main or name in ("article", "main") or "main" in words and "role" in (m["attrs"] or "")) and not chrome
        hard = parent.hard or name in CHROME_TAGS or header or (hidden and name not in ("html", "body"))
        marked = name in ("article", "main") or "main" in words and "role" in (m["attrs"] or "")
        kept = not hard and (marked or parent.kept and not named)
        held = [] if block else pieces[:]
        if held:
            pieces.clear()
        stack.append(_Node(name, f"{parent.path}/{style}", chrome, main, kept, hard, held))
    flush()
    pop_to(0)
    return blocks, seen


def main_text(page: str, unimportant: frozenset[str] | set[str] = frozenset()) -> str:
    """The article's blocks, joined by an empty line.

    Named parts and the branches whose path is unimportant go everywhere, the latter unless all marked text
    would go with them. What a page marks as article is taken alone where it is not shorter than the
    text left beside it. An article inside a part named as something else counts if there is no
    other and it is longer than what the rest of the page leaves.
    """
    blocks, _ = parse(page)
    low = lambda b: bool(unimportant) and any(b.path[: m.start()] in unimportant for m in re.finditer("/|$", b.path))
    size = lambda found: sum(len(b.text) for b in found)
    seen = [b for b in blocks if not b.chrome]
    marked = [b for b in seen if b.main]
    spared = all(low(b) for b in marked)
    marked = [b for b in marked if spared or not low(b)]
    plain = [b for b in seen if not b.main and not low(b)]
    if not marked:
        kept = [b for b in blocks if b.kept]
        own = kept if size(kept) > size(plain) else plain
    elif size(marked) >= size(plain):
        own = marked
    else:
        own = [b for b in seen if not low(b) or b.main and spared]
    return "\n\n".join(b.text for b in own)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and path: the styles of the children, and the texts."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks, seen = parse(page or "")
            texts: dict[str, list[str]] = {}
            styles: dict[str, list[str]] = {}
            for b in blocks:
                texts.setdefault(b.path, []).append(b.text)
            for path, children in seen:
                styles.setdefault(path, []).append(children)
            rows += [(host, "text", p, "\n".join(t)) for p, t in texts.items()]
            rows += [(host, "style", p, "\n".join(sorted(set(t)))) for p, t in styles.items()]
            if len(rows) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["host", "kind", "path", "value"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["host", "kind", "path", "value"])


def unimportant_nodes(pages: DataFrame) -> DataFrame:
    """(host, path) of the low-importance nodes of every host's merged tree.

    The entropy of what a path shows is taken over the pages that have it and is 1 where all differ. A node's
    importance weighs the entropy of its own styles and the largest entropy of the texts at or below it.
    """
    seen = pages.mapInArrow(_observed, "host string, kind string, path string, value string")
    counts = seen.groupBy("host", "kind", "path", F.xxhash64("value").alias("v")).agg(F.count("*").alias("c"))
    c = F.col("c")
    nodes = counts.groupBy("host", "kind", "path").agg(F.sum("c").alias("n"), F.sum(c * F.log(c.cast("double"))).alias("s"))
    entropy = F.when(F.col("n") > 1, (F.log(F.col("n").cast("double")) - F.col("s") / F.col("n")) / F.log(F.col("n").cast("double"))).otherwise(1.0)
    nodes = stored(nodes.select("host", "kind", "path", "n", entropy.alias("h")), "nodes")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    texts = nodes.filter("kind = 'text' and path <> ''").select("host", F.explode(above).alias("path"), "n", "h")
    texts = texts.groupBy("host", "path").agg(F.max("h").alias("h"), F.max("n").alias("n"))
    styles = nodes.filter("kind = 'style'").select("host", "path", F.col("h").alias("style"))
    both = texts.join(styles, ["host", "path"], "left")
    importance = STYLE_WEIGHT * F.coalesce("style", F.lit(0.0)) + (1 - STYLE_WEIGHT) * F.col("h")
    return both.filter((F.col("n") >= PAGES) & (importance < LEAST)).select("host", "path")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    The host is what stands between ``://`` and the next /, ? or #, lower-cased; rows without one (a null
    url too) form a site of their own. A null or empty html gives an empty text. White space inside a block
    becomes one space, blocks are joined by an empty line, character references are decoded. Pages are
    parsed whole. Repeated rows each get a row and count each as a page; null ids stay null; extra columns are
    ignored; an empty table gives no rows. Pages are read twice and not shuffled as long as the list of
    unimportant nodes passes the check for a broadcast; beyond it they join on the host, where a large
    host is split like any skewed join.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"://([^/?#]*)", 1))
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host")
    )
    low = stored(unimportant_nodes(pages.select("host", "html")), "unimportant")
    low = low.groupBy("host").agg(F.collect_list("path").alias("low"))
    low = F.broadcast(low) if is_small(low) else low
    rows = pages.join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h or "", frozenset(u or ())) for h, u in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                lengths = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
