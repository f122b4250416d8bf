"""HTML extraction: union-free regular-expression inference.

A page becomes a nested stream of tokens: block elements (name and class), and text. The streams of one host are
aligned pair by pair into a wrapper. Where they agree, a token stays; text against other text becomes a text slot; a
run of equal blocks becomes a repeated group; what only one side has becomes optional. The result has no unions: a
sequence of tokens, slots, optional and repeated groups, nested as the blocks are.

Wrappers are built over all pages: each task folds its pages into one wrapper for each host, and the tasks' wrappers
are folded again by host, so a hot host costs a row for each task and no page is left out. Then every page is laid
against its host's wrapper. Text that fell on a constant of the template, or in a part that is not article by its
element or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments), is left
out; the rest of the main part is the text. A class, id or role marks such a part by a whole word of it, never the page
itself, its <main>, an outermost <article>, or a block that holds most of the page's text with no other main part.

A wrapper is a model of bounded size: its blocks nest 128 deep, and a block keeps 1,000 optional parts. Pages of any
depth and any number of blocks are laid out whole.

Null html counts as empty and gives an empty text; a null url is a host of its own. Pages are laid out one by one, so
repeated rows and ties have no effect. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Elements that begin a block, whose text stands apart from its neighbours'.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script section "
    "select style summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
VOID = {"hr"}
#: Elements that are never part of an article.
NOT_ARTICLE = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "iframe", "template", "svg", "button", "select", "textarea", "dialog", "menu", "option", "title"}
#: Words of a class, id or role that mark a part that is not the article.
NOT_ARTICLE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent dialog disqus footer form gdpr login menu menubar modal nav navbar navigation newsletter notice overlay popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tags teaser toolbar widget masthead alert".split()
)
#: Words that stand beside those in hyphenated ones ("related-posts") without changing what is marked.
BESIDE_WORDS = set("area bar block box button buttons container group inner item items links list outer panel posts section site slot unit wrapper".split())
#: Words of a class that mark a part as the article.
ARTICLE_WORDS = re.compile(r"\b(article|content|entry|post|story)\b")
#: Blocks are nested so deep at most; deeper ones stand side by side (browsers do the same, at 512).
DEEPEST = 128
#: Two lists of blocks are aligned by a longest common subsequence up to this product of lengths.
LARGEST = 1_000_000
#: Optional parts that a block's wrapper keeps: those of most pages.
MOST_OPTIONAL = 1000
#: Elements that a new block of the same family ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A template's constant is text that all different pages of a host have in one place. With this many pages any text
#: is; with fewer, from two on, the words of neighbouring constants times the pages must reach this number.
LEAST_PAGES = 12

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Node:
    """A block of a page: its key is the element's name and class; content holds strings and nodes in order.

    It is marked if its class, id or role says that it is not the article, which alone need not exclude it.
    """

    key: str
    name: str
    excluded: bool = False
    marked: bool = False
    content: list = field(default_factory=list)

    def length(self) -> int:
        return 0 if self.excluded else sum(len(c) if isinstance(c, str) else c.length() for c in self.content)


def _says_not_article(token: str) -> bool:
    """A word, or a hyphenated one of which all parts say so or say nothing; parts as in has-sidebar do not count."""
    parts = set(re.findall(r"[a-z]+", token))
    return bool(parts & NOT_ARTICLE_WORDS) and parts <= NOT_ARTICLE_WORDS | BESIDE_WORDS


def _opened(name: str, attributes: str) -> Node:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    marked = any(_says_not_article(token) for mark in ("class", "id", "role") if mark in found for token in found[mark].lower().split())
    hidden = "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").lower() == "true" or bool(_UNSHOWN.search(found.get("style", "")))
    whole = name in ("html", "body")
    # Numbers in a class, as in post-1234, tell blocks of one kind apart and not kinds.
    return Node(f"{name}.{re.sub('[0-9]+', '0', found.get('class', ''))}", name, name in NOT_ARTICLE or hidden and not whole, marked and not whole and name != "main")


def _judge(root: Node) -> None:
    """Exclude marked blocks, save those that hold a <main>, or most of the page's text and every part that may be the article."""
    sizes: dict[int, int] = {}
    parts: dict[int, int] = {}
    mains: set[int] = set()

    def measure(node: Node) -> None:
        own = [c for c in node.content if not isinstance(c, str)]
        for c in own:
            measure(c)
        if node.excluded:
            sizes[id(node)] = parts[id(node)] = 0
            return
        sizes[id(node)] = sum(len(c) if isinstance(c, str) else sizes[id(c)] for c in node.content)
        may_be = node.name in ("article", "main") or not node.marked and node.name not in ("html", "body") and ARTICLE_WORDS.search(node.key.partition(".")[2])
        parts[id(node)] = bool(may_be) + sum(parts[id(c)] for c in own)
        if node.name == "main" or any(id(c) in mains for c in own):
            mains.add(id(node))

    def exclude(node: Node) -> None:
        if node.marked and id(node) not in mains and not (2 * sizes[id(node)] > sizes[id(root)] and parts[id(node)] == parts[id(root)]):
            node.excluded = True
        for c in node.content:
            if not isinstance(c, str):
                exclude(c)

    measure(root)
    exclude(root)


def _after(page: str, name: str, at: int) -> int:
    """The place behind the end tag of an element whose content is not markup."""
    found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
    return found.end() if found else len(page)


def parse(page: str) -> Node:
    """The nested blocks of a page. Inline elements vanish; missing and stray end tags are forgiven."""
    root = Node("", "")
    open_, text, at, end = [root], [], 0, len(page)
    depth = Counter()  # open blocks by name

    def close() -> Node:
        depth[open_[-1].name] -= 1
        return open_.pop()

    def flush() -> None:
        if text:
            if said := " ".join(entities.unescape("".join(text)).split()):
                open_[-1].content.append(said)
            text.clear()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if name == "br":
            text.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if m[1]:
            if depth[name]:
                while close().name != name:
                    pass
            continue
        # A paragraph ends where any block begins; items end where the next begins.
        if open_[-1].name == "p":
            close()
        while open_[-1].name in CLOSES.get(name, ()):
            close()
        node = _opened(name, m[3])
        if name == "header" and not depth["article"]:
            node.excluded = True
        # An article in an article may be a comment; others are never excluded by their marks.
        if name == "article" and not depth["article"]:
            node.marked = False
        if len(open_) <= DEEPEST:
            open_[-1].content.append(node)
        elif not node.excluded and not node.marked:
            # What is nested deeper stands in its ancestor at that depth, in page order.
            node.content = open_[-1].content
        if name in RAW and not m[3].endswith("/"):
            at = _after(page, name, at)
        elif name not in VOID:
            open_.append(node)
            depth[name] += 1
    flush()
    _judge(root)
    return root


# A wrapper is a list [key, pages, optional, repeated, content]; its content holds wrappers and texts, and a text is
# [constant or None, pages, optional]. Plain lists, as they travel as JSON.


def wrap(node: Node) -> list:
    """The wrapper of one page."""
    content: list = []
    for child in node.content:
        if isinstance(child, str):
            content.append([child, 1, False])
            continue
        own = wrap(child)
        if content and len(content[-1]) == 5 and content[-1][0] == own[0]:
            merged = align(content[-1], own)
            merged[1], merged[3] = 1, True
            content[-1] = merged
        else:
            content.append(own)
    return [node.key, 1, False, False, content]


def _key(item: list) -> str:
    return item[0] if len(item) == 5 else "#text"


def pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence of two lists of keys, as pairs of places; equal ends are cut off first.

    It is a longest one up to LARGEST pairs of places. Beyond, the k-th of a key in one list is paired with the k-th in
    the other, and the longest rising run of such pairs is taken, which needs memory for the lists only.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    middle = _longest if n * m <= LARGEST else _by_turn
    found = [(head + x, head + y) for x, y in middle(a[head : head + n], b[head : head + m])] if n and m else []
    return [(k, k) for k in range(head)] + found + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence; the leftmost places of a are left out first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _by_turn(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The longest rising run of pairs of the k-th places of each key."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    tops: list[int] = []
    ends: list[tuple] = []  # for each length the pair that ends it and its chain
    for i, key in enumerate(a):
        if not places.get(key):
            continue
        j = places[key].pop()
        at = bisect_left(tops, j)
        link = (i, j, ends[at - 1] if at else None)
        tops[at : at + 1], ends[at : at + 1] = [j], [link]
    found, link = [], ends[-1] if ends else None
    while link:
        found.append(link[:2])
        link = link[2]
    return found[::-1]


def align(a: list, b: list) -> list:
    """One wrapper for what two wrappers with the same key describe."""
    if len(a) == 3:
        return [a[0] if a[0] == b[0] else None, a[1] + b[1], a[2] or b[2]]
    out, i, j = [], 0, 0
    for x, y in [*pairs([_key(c) for c in a[4]], [_key(c) for c in b[4]]), (len(a[4]), len(b[4]))]:
        for only in (a[4][i:x], b[4][j:y]):
            out += [[*c[:2], True, *c[3:]] for c in only]
        if x < len(a[4]):
            out.append(align(a[4][x], b[4][y]))
        i, j = x + 1, y + 1
    return [a[0], a[1] + b[1], a[2] or b[2], a[3] or b[3], _bounded(_grouped(out))]


def _bounded(content: list) -> list:
    """A wrapper's parts without the rarest optional ones, which say nothing of the template."""
    optional = [i for i, c in enumerate(content) if c[2]]
    if len(optional) <= MOST_OPTIONAL:
        return content
    gone = set(sorted(optional, key=lambda i: content[i][1])[: len(optional) - MOST_OPTIONAL])
    return [c for i, c in enumerate(content) if i not in gone]


def _grouped(content: list) -> list:
    """Neighbouring blocks with one key are a repeated group."""
    out: list = []
    for c in content:
        if out and len(c) == 5 and len(out[-1]) == 5 and out[-1][0] == c[0]:
            pages = max(out[-1][1], c[1])
            merged = align(out[-1], c)
            out[-1] = [c[0], pages, out[-1][2] and c[2], True, merged[4]]
        else:
            out.append(c)
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression, for people to read."""
    if len(wrapper) == 3:
        said = "#TEXT" if wrapper[0] is None else wrapper[0]
        return f"({said})?" if wrapper[2] else said
    inner = f"<{wrapper[0].rstrip('.')}>" + "".join(map(expression, wrapper[4])) + "</>" if wrapper[0] else "".join(map(expression, wrapper[4]))
    return f"({inner})" + ("*" if wrapper[2] and wrapper[3] else "+" if wrapper[3] else "?") if wrapper[2] or wrapper[3] else inner


def main_parts(root: Node) -> list[Node]:
    """The article: <article>s if they hold most of what would be taken else, which is <main>, else what is marked as
    content if it holds most of the page, else the whole page. All outermost nodes are taken, in page order.
    """

    def outermost(node: Node, is_one: Callable[[Node], bool]) -> list[Node]:
        if node.excluded:
            return []
        return [node] if is_one(node) else [n for c in node.content if not isinstance(c, str) for n in outermost(c, is_one)]

    def size(nodes: list[Node]) -> int:
        return sum(map(Node.length, nodes))

    taken = [root]
    content = outermost(root, lambda n: bool(ARTICLE_WORDS.search(n.key.partition(".")[2])))
    mains = outermost(root, lambda n: n.name == "main")
    articles = outermost(root, lambda n: n.name == "article")
    if size(mains):
        taken = mains
    elif 2 * size(content) > size(taken):
        taken = content
    return articles if 2 * size(articles) > size(taken) else taken


def blocks(node: Node, wrapper: list | None, inside: set[int], kept: bool = False) -> list[tuple[str, bool]]:
    """Texts of the main part in page order without excluded parts, and whether all pages have them in this place."""
    kept = kept or id(node) in inside
    if node.excluded:
        return []
    places: dict[int, list] = {}
    if wrapper:
        # Runs of one key stand against one repeated group.
        runs, firsts = [], []
        for i, c in enumerate(node.content):
            key = "#text" if isinstance(c, str) else c.key
            if not (runs and key == runs[-1] and key != "#text"):
                runs.append(key)
                firsts.append([])
            firsts[-1].append(i)
        for x, y in pairs(runs, [_key(c) for c in wrapper[4]]):
            for i in firsts[x]:
                places[i] = wrapper[4][y]
    out = []
    for i, c in enumerate(node.content):
        laid = places.get(i)
        if isinstance(c, str):
            if kept:
                out.append((c, laid is not None and laid[0] == c and not laid[2]))
        else:
            out += blocks(c, laid if laid and not laid[2] else None, inside, kept)
    return out


def without_constants(found: list[tuple[str, bool]], pages: int) -> list[str]:
    """Texts less the template's constants, for which few pages need more words.

    Where pages are few, constants that hold most of a page's text make its pages near copies of one article rather
    than pages of one template, and all of the text stays.
    """
    if pages >= LEAST_PAGES:
        return [text for text, constant in found if not constant]
    kept, gone = [], 0
    for constant, run in groupby(found, key=lambda x: x[1]):
        texts = [text for text, _ in run]
        if constant and pages * sum(len(t.split()) for t in texts) >= LEAST_PAGES:
            gone += sum(map(len, texts))
        else:
            kept += texts
    return kept if 2 * gone <= sum(len(text) for text, _ in found) else [text for text, _ in found]


def main_text(page: str, wrapper: list | None, pages: int = LEAST_PAGES) -> str:
    """The text of a page, given its host's wrapper and the number of different pages that made it."""
    root = parse(page)
    return "\n".join(without_constants(blocks(root, wrapper, set(map(id, main_parts(root)))), pages))


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html", most_hosts: int = 2000) -> DataFrame:
    """host and wrapper (JSON) of every host, from all of its pages. Pages with one and the same html count once a task."""

    def join(a: list, b: list) -> list:
        """The least page hashes, which tell how many different pages there are up to LEAST_PAGES, and the aligned wrapper."""
        return [sorted({*a[0], *b[0]})[:LEAST_PAGES], align(a[1], b[1])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        seen: set[tuple[str, int]] = set()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array(map(json.dumps, known.values()), pa.string())], ["host", "wrapper"])

        for batch in slices(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                same = xxhash.xxh3_64_intdigest(page)
                if (host, same) in seen:
                    continue
                seen.add((host, same))
                own = [[same], wrap(parse(page))]
                known[host] = join(known[host], own) if host in known else own
                if len(known) >= most_hosts or len(seen) >= 200_000:
                    yield out()
                    known, seen = {}, set()
        yield out()

    def again(table: pa.Table) -> pa.Table:
        made = None
        for text in table.column("wrapper").to_pylist():
            own = json.loads(text)
            made = join(made, own) if made else own
        return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(made)], pa.string())})

    rows = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    schema = "host string, wrapper string"
    parts = scratch.save(rows.mapInArrow(fold, schema), "parts")
    return scratch.save(parts.groupBy("host").applyInArrow(again, schema), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    wrappers = infer(pages, scratch, url_col, html_col)
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, tuple[list | None, int]] = {}
        for batch in slices(batches, "html"):
            texts = []
            for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
                if host not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    hashes, made = json.loads(wrapper) if wrapper else ([], None)
                    parsed[host] = made if len(hashes) > 1 else None, len(hashes)
                texts.append(main_text(page or "", *parsed[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), _host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.join(wrappers, "host", "left").select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, schema)
