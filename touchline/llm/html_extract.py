"""Operator 8, HTML extraction: a minimum cut separates a page's content blocks from its boilerplate.

A tolerant tag reader splits a page into text blocks, each with the open elements around it. A linear
classifier over length, link share, sentence ends, share of the page's text in the block's container,
element and names gives a block log odds: above zero they are its capacity from the source (content),
below its capacity to the sink (boilerplate). Blocks near each other in the document tree are joined by
smoothness edges, weaker with each element between them and across sections. Costs and edges are of one
scale: a short line between paragraphs follows them, a paragraph of a menu follows the menu. The maximum
flow's source side is the content, in page order.

Names (class, id, role) are read as compounds: the last word that says something decides; a name that
only mentions a boilerplate word counts less the more of the page's text its element holds.

Defined results: null or empty html gives an empty text; unclosed, crossed and cut-off tags are read
as far as they go; repeated rows give repeated rows; an empty table gives no row; only ``page_id``,
``url`` and ``html`` are read. Memory, edges and reading time are linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import importable, table

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object|select|title)\b"
                  r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
                  r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
                  re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose start or end separates blocks.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second starts, up to the third.
_IMPLIED = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
            "td": (frozenset(["td", "th"]), frozenset(["table"])), "th": (frozenset(["td", "th"]), frozenset(["table"])),
            "tr": (frozenset(["tr"]), frozenset(["table"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
            "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]))}

#: Log odds for (above zero) or against content. Of elements around a block the strongest counts.
ELEMENT = {"nav": -6.0, "footer": -6.0, "header": -5.0, "aside": -6.0, "menu": -6.0, "form": -4.0, "button": -6.0, "dialog": -6.0,
           "fieldset": -4.0, "legend": -4.0, "option": -6.0, "head": -20.0}
#: A name of comments is firmer than others: it is never taken for that of a wrapper of the article.
NAMED, COMMENTS, HIDDEN, GOOD_NAME, ARTICLE, ANSWER = -5.0, -5.5, -9.0, 1.5, 2.0, -5.0
OWN = {"p": 0.5, "pre": 0.5, "blockquote": 0.5, "h1": 1.0, "h2": 0.7, "h3": 0.6, "h4": 0.5, "h5": 0.4, "h6": 0.4, "li": 0.0,
       "td": 0.0, "dd": 0.2, "figcaption": 0.2}
BIAS, LINKS, STOP, RIGHTS = -0.5, -4.0, 0.5, -1.5
#: Length: log2 of words over the first, times the second, within the others.
USUAL, PER_DOUBLING, SHORTEST, LONGEST = 8, 0.9, -1.5, 2.5
#: A container without unlinked words, and what one with this share of the page's adds to that.
POOR, RICH, RICH_SHARE = -1.0, 2.5, 0.25
#: Smoothness of two blocks side by side, less by half for each further element between them; the next block of
#: the same container; across sections.
NEAR, SIBLING, ACROSS = 2.5, 0.8, 0.25
#: Elements whose blocks count to the container around them.
LISTS = frozenset("dir dl figure menu ol table tbody thead tr ul".split())
SECTIONS = frozenset("article aside body dialog footer form header main menu nav section".split())

COMMENT_WORDS = frozenset("""comment comments commenting disqus discussion replies reply respond kommentar kommentare leserkommentare
commentaire commentaires comentario comentarios""".split())
BAD_WORDS = COMMENT_WORDS | frozenset("""ad ads adv advert adverts advertisement advertising advertorial alert anuncio anuncios anzeige anzeigen
banner bar breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright disclaimer foot footer form gdpr header hidden
hinweis login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination
popular popup privacy promo promoted promotion publicidad publicite recommend recommended related search share sharing sidebar signup skip
social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar trending warning werbung widget""".split())
GOOD_WORDS = frozenset("article articlebody artikel beitrag entry post story".split())
#: Words that say nothing beside another word.
PLAIN_WORDS = frozenset("""area block body bottom box col column container content first global inner item items last left list main outer page
right row section site text top wrap wrapper zone""".split())


def name_evidence(name: str) -> tuple[float, bool]:
    """(evidence, whether it is the name's meaning and not only a part of it) of one class, id or role."""
    words = [w.lower() for w in _HINT_WORD.findall(name)]
    told = [w for w in words if w not in PLAIN_WORDS]
    if not told:
        return (GOOD_NAME if words else 0.0), True
    bad = sum(w in BAD_WORDS for w in told)
    if told[-1] == "header" and GOOD_WORDS.intersection(told):
        return 0.0, True
    if told[-1] in BAD_WORDS:
        return (COMMENTS if COMMENT_WORDS.intersection(told) else NAMED), True
    if told[-1] in GOOD_WORDS:
        return GOOD_NAME, True
    return NAMED * bad / len(told), False


def _names(attributes: str) -> tuple[float, float, float]:
    """(firm evidence against, evidence against from parts of names, evidence for) from class, id, role and hiding."""
    firm = partly = good = 0.0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            firm = HIDDEN
        elif name in ("class", "id", "role"):
            for one in value.split():
                told, whole = name_evidence(one)
                good = max(good, told)
                if whole and told < 0:
                    firm = min(firm, told)
                else:
                    partly = min(partly, told)
    return firm, partly, 0.0 if firm else good


class Block:
    """A text block: its words and linked characters, where it hangs, and what the elements around it say.

    ``steps`` are the elements closed and opened since the block before; ``share`` is its container's part of
    the page's unlinked words."""
    __slots__ = ("text", "words", "linked", "tag", "container", "section", "steps", "against", "partly", "holder", "in_favour", "share")

    def __init__(self, text, linked, tag, container, section, steps, against, partly, holder, in_favour):
        self.text, self.words, self.linked, self.tag, self.container = text, text.count(" ") + 1, linked, tag, container
        self.section, self.steps, self.against, self.partly, self.holder, self.in_favour = section, steps, against, partly, holder, in_favour
        self.share = 0.0

    def plain_words(self) -> float:
        return self.words * (1.0 - min(1.0, self.linked / len(self.text)))


class Open:
    """An open block element and the evidence inherited through it; ``holder`` is the element of the partly bad name."""
    __slots__ = ("tag", "number", "container", "section", "against", "partly", "holder", "in_favour", "article", "before")

    def __init__(self, tag, number, container, section, against, partly, holder, in_favour, article, before):
        self.tag, self.number, self.container, self.section, self.against = tag, number, container, section, against
        self.partly, self.holder, self.in_favour, self.article, self.before = partly, holder, in_favour, article, before


def read_blocks(page: str) -> list[Block]:
    """Text blocks in page order with what the elements around them say."""
    blocks: list[Block] = []
    stack = [Open("", 0, 0, 0, 0.0, 0.0, 0, 0.0, -1, 0.0)]
    places: dict[str, list[int]] = {}  # where elements of a tag are on the stack
    held: list[str] = []
    numbers, links, linked, lowest = 0, 0, 0, 0
    plain, inside = 0.0, {}  # unlinked words so far; those of each closed element with a partly bad name

    def flush():
        nonlocal held, linked, lowest, plain
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            top, depth = stack[-1], len(stack) - 1
            steps = (flush.depth - lowest) + (depth - lowest)
            blocks.append(Block(text, linked, top.tag, top.container, top.section, steps, top.against, top.partly, top.holder, top.in_favour))
            plain += blocks[-1].plain_words()
            flush.depth = lowest = depth
        held, linked = [], 0

    flush.depth = 0

    def close(to):
        nonlocal lowest
        flush()
        while len(stack) > to:
            gone = stack.pop()
            places[gone.tag].pop()
            if gone.holder == gone.number:
                inside[gone.number] = plain - gone.before
        lowest = min(lowest, len(stack) - 1)

    def last(tags):
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            held.append(page[at:m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1] and m[1].lower() not in ("svg", "iframe", "object"):
                flush()
            continue
        tag, ending, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            links = max(0, links - 1) if ending else 1
        elif tag == "br":
            held.append(" ")
        if tag not in BLOCK:
            continue
        if ending:
            if places.get(tag):
                close(places[tag][-1])
            else:
                flush()
            continue
        flush()
        links = 0
        if stack[-1].tag == "p" or (tag[0] == "h" and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
            close(len(stack) - 1)
        if tag in _IMPLIED:
            same, border = _IMPLIED[tag]
            if last(same) > last(border):
                close(last(same))
        if tag in ("body", "article", "main") and places.get("head"):
            close(places["head"][0])
        if tag in VOID:
            continue
        numbers += 1
        top = stack[-1]
        against, partly, holder, in_favour, article = top.against, top.partly, top.holder, top.in_favour, top.article
        firm, part, good = (0.0, 0.0, 0.0) if tag in ("html", "body") or not attributes else _names(attributes)
        own = ELEMENT.get(tag, 0.0)
        if tag == "header" and article >= 0:
            own = 0.0  # the heading of an article
        if tag == "article" and 0 <= article < len(blocks):
            own, in_favour = ANSWER, 0.0  # an article after another's text and inside it answers it
        elif tag in ("article", "main"):
            if against == NAMED:
                against *= 0.25  # the name of a wrapper says little about the article in it
            in_favour = max(in_favour, ARTICLE)
            if tag == "article":
                article = len(blocks)
        if part < partly:
            partly, holder = part, numbers
        if min(firm, own) < 0:
            in_favour = 0.0  # boilerplate set into an article
        stack.append(Open(tag, numbers, top.container if tag in OWN or tag in LISTS else numbers, numbers if tag in SECTIONS or firm < 0 else top.section,
                          min(against, firm, own), partly, holder, max(in_favour, good), article, plain))
        places.setdefault(tag, []).append(len(stack) - 1)
    if at < len(page):
        held.append(page[at:])
        if links:
            linked += len(page) - at
    close(1)
    containers: dict[int, float] = {}
    for b in blocks:
        containers[b.container] = containers.get(b.container, 0.0) + b.plain_words()
    for b in blocks:
        b.share = containers[b.container] / plain if plain else 0.0
        if b.holder:
            b.partly *= 1.0 - inside.get(b.holder, 0.0) / plain if plain else 1.0
    return blocks


def evidence(b: Block) -> float:
    """Linear classifier: log odds of content."""
    length = min(LONGEST, max(SHORTEST, PER_DOUBLING * math.log2(b.words / USUAL)))
    score = BIAS + min(b.against, b.partly) + b.in_favour + OWN.get(b.tag, 0.0) + LINKS * min(1.0, b.linked / len(b.text)) + length
    rich = POOR + RICH * min(1.0, b.share / RICH_SHARE)
    score += min(0.0, rich) if b.against <= NAMED else rich  # much boilerplate is no article
    return score + (STOP if b.text[-1] in ".!?…。" else 0.0) + (RIGHTS if b.text[0] == "©" else 0.0)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, capacity) between neighbours, by the elements between them, and between successive blocks of one container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR * 0.5 ** min(20, max(0, b.steps - 2)) * (1.0 if blocks[i - 1].section == b.section else ACROSS)))
        j = last.get(b.container)
        if j is not None and j < i - 1:
            edges.append((j, i, SIBLING))
        last[b.container] = i
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: ``costs`` above zero hang on the source, below on the sink.

    Dinic's algorithm with an explicit stack."""
    n = len(costs)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def arc(u, v, there, back):
        graph[u].append(len(to))
        to.append(v)
        room.append(there)
        graph[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            arc(s, i, c, 0.0)
        elif c < 0:
            arc(i, t, -c, 0.0)
    for u, v, c in edges:
        arc(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        place, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while place[u] < len(graph[u]):
                e = graph[u][place[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                place[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                place[u] += 1


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by newlines."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    keep = minimum_cut([evidence(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return importable(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
