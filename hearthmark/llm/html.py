"""HTML main text by consensus host paths.

A page is parsed into clean blocks and a tree of containers, each scored by the unlinked text inside. The page votes for the generalised
tag-class path of its innermost container with most of the text; votes are counted per host. So are the blocks outside
of what their page voted for, by path: a path that says the same on page after page is part of the host's template. Pages are
then parsed again, and the text is what stands in the container on the host's winning path (the page's own where no winning
path holds most of its text), and around it what is neither links nor template. What moves between hosts' tasks are parsed
blocks, votes and hashes, never html. Menus, adverts, comments and the like are left out before, by tag, role and class
names, unless a page's evidence speaks against it. Time is linear in a page.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm.common import stored

TAG = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|noscript|template|iframe|svg|textarea|select|title|object)\b(?:"[^"]*"|'[^']*'|[^>"'])*(?:(?<=/)>|>.*?(?:</\1\s*>|$))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|$)|<[a-zA-Z!?/][^>]*(?:>|$)""", re.S | re.I)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: elements that end a block, that are never article text, and class words of such parts
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "li", "caption", "tbody", "thead", "tfoot"}
LEFT_OUT = frozenset("nav footer aside form button dialog menu head input label audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = re.compile("comments?(?:list|box|area|section|thread)?|disqus|respond|replies|reply|discussion")
WORDS = re.compile(r"nav(?:bar|igation)?|menus?|header|footer|foot|sidebars?|aside|rail|ads?|dfp|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|cookieconsent|consent|gdpr|notices?|alerts?|share|sharing|social|related|recommend\w*|subscri\w*|newsletter|signup|login|breadcrumbs?|popup|modal|overlay|widgets?|pagination|pager|toolbar|masthead|skip|search|hidden|" + COMMENTS.pattern)
BESIDE = frozenset("area bar block body bottom box button buttons center col column container content desktop dropdown entry fixed form global group holder inline inner item items js left level line link links list main mobile module outer page panel part post posts primary region right row secondary section site slot small sticky tertiary text thread title to top unit user v window wrap wrapper x".split())
CONSENT = re.compile("cc-(?:window|banner|revoke)")  # of a common cookie notice
CONTAINERS = frozenset("article main section div td body blockquote".split())


HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SALTS = 64
DEPTH = 512  # levels of a path; elements further down are on the path of the level above, and further up are not closed unasked
KEPT, DOUBTED, OUT = range(3)
MOST = 0.8  # share of a page's text in the container it votes for
TEMPLATE_PAGES, TEMPLATE_TEXTS = 3, 0.5  # a template's path stands on so many pages, with at most this share of them in different texts


class Node:
    __slots__ = ("at", "box", "comments", "core", "depth", "doubt", "kind", "parent", "path", "state", "tag")

    def __init__(self, tag: str, parent: Node | None, kind: str, state: int, comments: bool = False):
        """state is that of the element itself or of what is around it; doubt is the nearest doubted element, box the nearest
        container, core whether it stands in an article or main, all with the element itself included."""
        self.tag, self.parent, self.kind, self.comments, self.at = tag, parent, kind, comments, 0
        self.depth = parent.depth + 1 if parent else 0
        self.path = kind if not parent else f"{parent.path}>{kind}" if self.depth <= DEPTH else parent.path
        self.state = max(state, parent.state) if parent else state
        self.doubt = self if state == DOUBTED else parent.doubt if parent else None
        self.box = self if tag in CONTAINERS or not parent else parent.box
        self.core = tag in ("article", "main") or (parent is not None and parent.core)


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTR.findall(text)} if text.strip() else {}


def generalised(tag: str, attrs: dict[str, str]) -> str:
    """The tag with its sorted classes (or else its id); digits do not tell paths apart."""
    name = sorted(set(attrs.get("class", "").lower().split())) or attrs.get("id", "").lower().split()[:1]
    return ".".join([tag, *(re.sub(r"\d+", "#", n) for n in name)])


@lru_cache(100_000)
def named(word: str) -> tuple[bool, bool]:
    """Whether a class or id names a part that is no article text, and whether that is reader comments.

    All its parts must be such words or words that go beside them: has-sidebar and social-science are neither.
    """
    parts = [p for p in re.split(r"[-_\d]+", word.lower()) if p]
    hits = [p for p in parts if WORDS.fullmatch(p)]
    own = (bool(hits) and all(p in BESIDE or WORDS.fullmatch(p) for p in parts)) or CONSENT.fullmatch(word.lower()) is not None
    return own and hits != ["header"], own and any(COMMENTS.fullmatch(p) for p in hits)


def described(tag: str, text: str) -> tuple[str, int, bool, bool]:
    """By its tag and attributes an element's generalised name, state, and whether it is reader comments or a header.

    Tags, roles and hiding leave out for certain. Names and forms only raise a doubt. A header, by tag or name, is left
    out but inside an article or main.
    """
    attrs = attributes(text)
    kind = generalised(tag, attrs) if tag in CONTAINERS else tag
    words = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    found = [named(w) for w in words]
    comments = tag not in ("html", "body", "main") and any(c for _, c in found)
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDING.search(attrs.get("style", "")) is not None
    if (tag in LEFT_OUT and tag != "form") or attrs.get("role", "").lower() in ROLES or hidden:
        return kind, OUT, comments, False
    if tag in ("html", "body", "article", "main"):
        return kind, DOUBTED if comments else KEPT, comments, False
    if tag == "form" or any(n for n, _ in found):
        return kind, DOUBTED, comments, False
    parts = [re.split("[-_]", w) for w in words]
    heads = tag == "header" or any("header" in p and all(x in BESIDE or x == "header" for x in p) for p in parts)
    return kind, (OUT if tag == "header" else DOUBTED) if heads else KEPT, comments, heads


often = lru_cache(50_000)(described)


def blocks(html: str | None) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """A page's containers in order of their opening, the root first, and its clean blocks in order: their innermost container, text,
    and characters inside links.

    A doubted element is kept if it is not reader comments and holds every article and main of the page, or if it is a
    form that holds most of the unlinked text; if nothing else is left, what is doubted in an article or main is kept.
    """
    root = Node("#", None, "#", KEPT)
    stack, out, text, linked, cores, anchors = [root], [], [], 0, [], 0
    boxes, still = [root], {}  # still: how many elements of a tag are open

    def flush() -> None:
        nonlocal text, linked
        words = " ".join(unescape("".join(text)).split())
        node = stack[-1]
        if words and node.state != OUT:
            out.append((node, words, min(linked, len(words))))
        text, linked = [], 0

    def pop(to: int) -> None:
        nonlocal anchors
        if any(n.tag in BLOCK or n.state != n.parent.state or n.doubt is n for n in stack[to:]):
            flush()
        for n in stack[to:]:
            still[n.tag] -= 1
            anchors -= n.tag == "a"
        del stack[to:]

    at = 0
    for m in TAG.finditer(html or ""):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if still.get(tag) else 0
            if depth and not any(n.tag in ("article", "main", "body", "table") for n in stack[depth + 1 :] if tag not in ("html", "body", "article", "main", "table")):
                pop(depth)
            elif tag == "p":
                flush()
            continue
        if tag == "br" or tag in ("td", "th", "img", "wbr"):
            text.append(" " if tag != "wbr" else "")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        same = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "option": ("option", ()), "a": ("a", ())}.get(tag)
        if (tag in CLOSES_P and still.get("p")) or (same and any(map(still.get, same[0].split()))):
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - DEPTH), -1):
                if (stack[i].tag == "p" and tag in CLOSES_P) or (same and stack[i].tag in same[0].split()):
                    pop(i)
                    break
                if stack[i].tag in CONTAINERS or stack[i].tag in LEFT_OUT or stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        parent = stack[-1]
        kind, state, comments, heads = (often if len(m[4]) < 200 else described)(tag, m[4])
        if heads and parent.core:
            state = KEPT
        if tag in BLOCK or state == DOUBTED or state > parent.state:
            flush()
        if not m[4].rstrip().endswith("/") or tag in BLOCK:
            node = Node(tag, parent, kind, state, comments)
            stack.append(node)
            still[tag] = still.get(tag, 0) + 1
            anchors += tag == "a"
            if node.box is node:
                node.at = len(boxes)
                boxes.append(node)
            if tag in ("article", "main") and node.state != OUT:
                cores.append(node)
    text.append((html or "")[at:])
    flush()
    kept = trusted(out, cores) or [b for b in out if b[0].core and not commented(b[0])]
    return boxes, [(node.box, words, linked) for node, words, linked in kept]


def doubts(node: Node) -> list[Node]:
    """The doubted elements around a node, innermost first."""
    found, at = [], node.doubt
    while at:
        found.append(at)
        at = at.parent.doubt if at.parent else None
    return found


def commented(node: Node) -> bool:
    return any(d.comments for d in doubts(node))


def trusted(found: list[tuple[Node, str, int]], cores: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks all of whose doubted elements a page's evidence clears; each element is judged once, from its sums."""
    cores = [c for c in cores if not commented(c)]
    held, holds, whole = {}, {}, 0
    for node, words, linked in found:
        whole += len(words) - linked
        if node.doubt:
            for d in doubts(node):
                held[d] = held.get(d, 0) + len(words) - linked
    for core in cores:
        for d in doubts(core):
            holds[d] = holds.get(d, 0) + 1
    clear: dict[Node | None, bool] = {None: True}

    def judged(doubt: Node) -> bool:
        for d in reversed([doubt, *doubts(doubt)[1:]]):
            if d not in clear:
                around = d.parent.doubt if d.parent else None
                own = not d.comments and ((bool(cores) and holds.get(d, 0) == len(cores)) or (d.tag == "form" and 2 * held.get(d, 0) > whole))
                clear[d] = own and clear[around]
        return clear[doubt]

    return [b for b in found if not b[0].doubt or judged(b[0].doubt)]


def scored(boxes: list[Node], found: list[tuple[Node, str, int]]) -> tuple[list[tuple[Node, int, int]], int]:
    """The containers that hold more than half of a page's unlinked text, each with its first block and the one after its last, outermost first, and
    the place in this list of the one the page votes for: the innermost with MOST of it; an article or main around that is taken
    whole. A page of links alone is scored by all its text.
    """
    weights = [len(words) - linked for _, words, linked in found]
    weights = weights if any(weights) else [len(words) for _, words, _ in found]
    inside, first, last = [0] * len(boxes), [len(found)] * len(boxes), [0] * len(boxes)
    for i, ((node, _, _), weight) in enumerate(zip(found, weights, strict=True)):
        inside[node.at] += weight
        first[node.at], last[node.at] = min(first[node.at], i), i + 1
    for n in reversed(boxes[1:]):  # a container opens after those around it
        up = n.parent.box.at
        inside[up] += inside[n.at]
        first[up], last[up] = min(first[up], first[n.at]), max(last[up], last[n.at])
    whole = inside[0]
    chain = [(n, first[n.at], last[n.at]) for n in boxes if whole and 2 * inside[n.at] > whole]
    best = max((i for i, (n, _, _) in enumerate(chain) if inside[n.at] >= MOST * whole), default=0)
    return chain, next((i for i in range(best, -1, -1) if chain and chain[i][0].tag in ("article", "main")), best)


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


VOTE = "path string, page long, outside array<struct<path: long, text: long>>"
PARSED = "words array<string>, loose array<boolean>, paths array<long>, own int, choices array<struct<path: string, a: int, b: int>>"


def vote(html: str | None) -> tuple[str | None, int, list[dict]]:
    """A page's path, a hash of what it would take, and path and text of each block outside of it, hashed."""
    boxes, found = blocks(html)
    chain, best = scored(boxes, found)
    if not chain:
        return None, 0, []
    node, a, b = chain[best]
    outside = [{"path": digest(n.path), "text": digest(words)} for n, words, _ in found[:a] + found[b:]]
    return node.path, digest("\n".join(words for _, words, _ in found[a:b])), outside


def parse(html: str | None) -> tuple[list[str], list[bool], list[int], int, list[dict]]:
    """A page's blocks, whether each is more than links, the hash of its path, the place of the page's own choice, and the paths that hold more than half
    of the unlinked text with the blocks inside, outermost first."""
    boxes, found = blocks(html)
    chain, best = scored(boxes, found)
    known: dict[str, int] = {}
    paths = [known[n.path] if n.path in known else known.setdefault(n.path, digest(n.path)) for n, _, _ in found]
    return [words for _, words, _ in found], [2 * linked <= len(words) for _, words, linked in found], paths, best, [{"path": n.path, "a": a, "b": b} for n, a, b in chain]


def extract(html: str | None, winners: list[str] | None = None, template: frozenset[int] = frozenset()) -> str:
    """Main text by the first winning path that holds more than half of the text, or else the page's own."""
    words, loose, paths, own, choices = parse(html)
    if not choices:
        return ""
    at = next((c for w in winners or [] for c in choices if c["path"] == w), choices[own])
    return "\n\n".join(w for i, w in enumerate(words) if at["a"] <= i < at["b"] or (loose[i] and paths[i] not in template))


def host_paths(pages: DataFrame, least: float = 0.2) -> DataFrame:
    """(host, paths) from (host, path): the paths with at least a share of their host's votes, most votes first, ties by name.

    Votes are counted map-side first, so a host of a third of all pages sends one row a task and path.
    """
    votes = pages.filter("path is not null").groupBy("host", "path").count()
    shares = votes.withColumn("votes", F.sum("count").over(Window.partitionBy("host"))).filter(F.col("count") >= least * F.col("votes"))
    return shares.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "path"))).alias("won")).select("host", F.transform("won", lambda x: x["path"]).alias("paths"))


def templates(votes: DataFrame) -> DataFrame:
    """(host, template): hashes of the paths whose blocks say the same on several different pages of a host.

    Pages that take the same text count once, so that copies of a page make no template.
    """
    rows = votes.select("host", "page", F.explode("outside").alias("o")).groupBy("host", F.col("o.path").alias("path"))
    counts = rows.agg(F.countDistinct("page").alias("pages"), F.countDistinct("o.text").alias("texts"))
    own = counts.filter((F.col("pages") >= TEMPLATE_PAGES) & (F.col("texts") <= TEMPLATE_TEXTS * F.col("pages")))
    return own.groupBy("host").agg(F.collect_list("path").alias("template"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty html gives an empty text; a null url is a host of its own; repeated rows stay; no rows give no rows;
    other columns are left out. An unclosed element ends with the page, a tag whose quote is never closed at its first >. A page that
    no winning path holds for the most part falls back to its own container. A host's pages are spread over SALTS keys, each with the host's few paths.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))

    @F.pandas_udf(PARSED)
    def read(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h) for h in htmls], columns=["words", "loose", "paths", "own", "choices"], index=htmls.index)

    @F.pandas_udf(VOTE)
    def voted(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vote(h) for h in htmls], columns=["path", "page", "outside"], index=htmls.index)

    votes = stored(rows.select(host.alias("host"), voted("html").alias("v")).select("host", "v.*"), "votes")
    won = host_paths(votes).join(templates(votes), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parsed = rows.select("page_id", "url", host.alias("host"), read("html").alias("p")).select("page_id", "url", "host", "p.*")
    salted = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "words"), F.lit(SALTS)).cast("int"))
    held = F.transform(F.coalesce("won", F.array().cast("array<string>")), lambda p: F.get(F.filter("choices", lambda c: c["path"] == p), F.lit(0)))
    both = salted.join(won.withColumnRenamed("paths", "won"), ["host", "salt"], "left")
    both = both.withColumn("at", F.coalesce(F.get(F.filter(held, lambda x: x.isNotNull()), F.lit(0)), F.get("choices", "own")))
    both = both.withColumn("template", F.coalesce("template", F.array().cast("array<bigint>")))
    inside = lambda i: (i >= F.col("at")["a"]) & (i < F.col("at")["b"])
    kept = F.filter("words", lambda w, i: inside(i) | (F.get("loose", i) & ~F.array_contains("template", F.get("paths", i))))
    text = F.when(F.col("at").isNotNull(), F.array_join(kept, "\n\n")).otherwise("")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; a null or empty html gives an empty text."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
