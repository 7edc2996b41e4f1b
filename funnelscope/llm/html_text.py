"""Main text of web pages by consensus paths of their hosts.

Every page is read once to score its containers; its best container is one vote for a generalised tag-class path
(classes and ids with digits turned into ``#``). Votes are summed per host in Spark, so one odd page cannot decide
for itself. The text of every page is then extracted anew with its host's consensus: of the containers that hold a fair share
(``FAIR_SHARE``) of the page's best score it takes the one with most votes; ties go to the smaller path.

Menus, page headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles never count: by element
name, by role, or by a class or id that says so as a whole (``ad``, ``site-footer``; not ``section-header`` or ``hljs-comment``).
Classes say nothing inside code, and an article's own header belongs to it. A block that only such a class or ``form`` marks still counts
where it holds most of the page's text without links, or the page's only article or main; reader comments and consents do not.
A list of three or more items that are nothing but links is a menu, save in an article or main, after prose of its own container, or, where
it stands in the body itself, between prose.

Null or empty HTML gives an empty text; a page without a host takes part under the empty host; broken markup is read
as far as it goes (unclosed elements end with their parent, unclosed tags are text), in time linear in its length. Repeated pages each
vote and each come back; an empty table gives an empty one. Other columns are not read, whatever their names.
The shuffles: the votes (one row per host, path and task), the fair paths of pages that have several, and, where Spark finds those
pages' choices too large to broadcast, the pages themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from funnelscope.llm.store import written

# Possessive groups that stop at the next "<": a tag that never closes costs its own length only.
TOKEN = r"""<!--(?:>|.*?(?:-->|\Z))|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+[^<>]*+)>|<[!?/][^<>]*+>"""
ATTRIBUTE = r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
# Fixed values of HTML.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object annotation annotation-xml".split())
NESTS = frozenset("svg template object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr img math mi mn mo mtext mrow msub msup msubsup mfrac msqrt mroot mover munder semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table article section main body".split())
CONTAINERS = frozenset("article body center div main section td".split())
# What is never part of an article.
OUT_TAGS = frozenset("nav footer aside form button select dialog menu header".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus feedback footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup privacy promo promos promotion related replies responses rail share sharing sidebar sidebars signup social "
    "sponsor sponsored subscribe subscription teaser toc toolbar tooltip widget widgets".split())
NEVER_WORDS = frozenset("comment comments consent cookie cookies disqus gdpr replies responses".split())
HEADER_WORDS = frozenset("header masthead".split())
SCOPE_WORDS = frozenset(
    "area articles bar bottom box block body button buttons card center column container content fixed form global google inner item items "
    "left link links list main message module outer page panel posts reader right row section site slot sticky stories text thread "
    "top unit user web website wrap wrapper".split())
CONTENT_WORDS = frozenset("article blog entry post story".split())
BODY_WORDS = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FAIR_SHARE = 0.6
DEEPEST = 64   # containers nested deeper count as the one at this depth


class Element:
    __slots__ = ("tag", "path", "out", "link", "menu", "article", "code", "mark")

    def __init__(self, tag, path, out, link, menu, article, code=False, mark=-1):
        self.tag, self.path, self.out, self.link, self.menu, self.article, self.code, self.mark = tag, path, out, link, menu, article, code, mark


@lru_cache(1 << 16)
def left_out(mark: str, article: bool) -> bool:
    """Whether a class or id as a whole names what is not part of an article; inside one a header is its own."""
    words = set(re.findall("[a-z]+", mark))
    if words.isdisjoint(OUT_WORDS) or article and words & OUT_WORDS <= HEADER_WORDS:
        return False
    known = OUT_WORDS | SCOPE_WORDS
    return words <= (known if words & HEADER_WORDS else known | CONTENT_WORDS)


class Reader:
    """Pages to blocks ``[path of the container, text, characters in links, list, in an article or main]``; one per task."""

    def __init__(self) -> None:
        self.tokens = re.compile(TOKEN, re.DOTALL).search
        self.attributes = re.compile(ATTRIBUTE, re.IGNORECASE).finditer
        self.edges = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^<>]*+>?", re.IGNORECASE).finditer for tag in RAW}
        self.number = re.compile(r"\d+|(?<![a-z])[0-9a-f]{8,}")

    def blocks(self, html: str) -> list[list]:
        stack, out, parts, links, lists = [Element("", "", False, False, 0, False)], [], [], 0, 0
        done, broken = 0, set()
        doubtful, anchors = [], []  # of each marked block whether it may count and the mark around it; the mark around each article and main
        opened = Counter()

        def flush() -> None:
            nonlocal parts, links
            if parts:
                if text := " ".join("".join(parts).split()):
                    top = stack[-1]
                    out.append([top.path, text, links, top.menu, top.article, top.mark])
                parts, links = [], 0

        def take(start: int, end: int) -> None:
            nonlocal links
            if end > start and not stack[-1].out:
                piece = html[start:end]
                if "&" in piece:
                    piece = unescape(piece)
                parts.append(piece)
                if stack[-1].link:
                    links += len(piece.strip())

        while found := self.tokens(html, done):
            name = found[2]
            take(done, found.start())
            done = found.end()
            if not name:
                continue
            tag = name.lower()
            if found[1]:
                if tag not in VOID:
                    for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                        if stack[i].tag == tag:
                            if tag not in INLINE or any(e.tag not in INLINE for e in stack[i:]):
                                flush()
                            self.cut(stack, i, opened)
                            break
                        if tag in INLINE and stack[i].tag not in INLINE:
                            break  # the end of an inline element does not close blocks
                if tag not in INLINE:
                    flush()
                continue
            if tag in RAW:
                if not (tag == "svg" and found[3].endswith("/")) and tag not in broken:
                    if (end := self.end_of(tag, html, done)) is not None:
                        done = end
                    elif tag in NESTS:
                        broken.add(tag)  # nothing closes it from here on: its content is read
                    else:
                        done = len(html)
                continue
            if tag not in INLINE:
                flush()
                if tag in CLOSES_P:
                    self.close(stack, ("p",), opened)
                if tag in SIBLINGS:
                    self.close(stack, SIBLINGS[tag], opened)
            if tag in VOID:
                continue
            top = stack[-1]
            path, dropped, article, code, around = top.path, top.out, top.article, top.code or tag in ("pre", "code"), top.mark
            if not dropped:
                marks, role, hidden = "", "", False
                for a in self.attributes(found[3]) if found[3] else ():
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key in ("class", "id"):
                        marks += " " + value
                    elif key == "role":
                        role = value
                    else:
                        hidden |= key == "hidden" or value == "true"
                names = [] if code else marks.split()
                said = any(left_out(name, article) for name in names)
                words = set().union(*(re.findall("[a-z]+", name) for name in names)) if said else set()
                worded = said and tag not in ("body", "html", "article", "main") and tag not in HEADINGS
                dropped = (hidden or role in OUT_ROLES and not (article and role == "banner")
                           or tag in OUT_TAGS and tag != "form" and not (tag == "header" and article)
                           or worded and tag in INLINE
                           or tag == "article" and said and (article or not {"comment", "comments"}.isdisjoint(words))
                           or tag == "article" and "reply" in names)
                if not dropped and (worded or tag == "form"):
                    doubtful.append((NEVER_WORDS.isdisjoint(words), around))
                    around = len(doubtful) - 1
                if not dropped and tag in ("article", "main"):
                    anchors.append(around)
                if tag in CONTAINERS and path.count("/") < DEEPEST:
                    first = self.number.sub("#", marks.split()[0]) if marks.strip() else ""
                    path = f"{path}/{tag}{'.' + first if first else ''}"
            if tag in ("ul", "ol"):
                lists += 1
            menu = lists if tag in ("ul", "ol") else 0 if tag in CONTAINERS else top.menu
            opened[tag] += 1
            stack.append(Element(tag, path, dropped, top.link or tag == "a", menu, article or tag in ("article", "main"), code, around))
        take(done, len(html))
        flush()
        if doubtful:
            out = self.counted(out, doubtful, anchors)
        return self.without_menus([b[:5] for b in out])

    def end_of(self, tag: str, html: str, start: int) -> int | None:
        """Where the element that opened before ``start`` is over, or None."""
        depth = 1
        for edge in self.edges[tag](html, start):
            depth += (-1 if edge[1] else 1) if tag in NESTS else -1 if edge[1] else 0
            if not depth:
                return edge.end()
        return None

    @staticmethod
    def without_menus(blocks: list[list]) -> list[list]:
        """The blocks but for lists of three or more items that are nothing but links, where prose does not make them references."""
        lists, prose = {}, {}
        for i, (path, text, links, menu, article) in enumerate(blocks):
            if menu:
                seen = lists.setdefault(menu, [0, True, i])
                seen[0] += 1
                seen[1] &= links >= len(text)
            if 2 * links < len(text):
                prose.setdefault(path, [i, i])[1] = i
        menus = set()
        for menu, (items, only_links, i) in lists.items():
            if only_links and items >= 3 and not blocks[i][4]:
                path = blocks[i][0]
                first, last = prose.get(path, (i, i))
                if not (first < i and (last > i or path.count("/") > 1)):
                    menus.add(menu)
        return [b for b in blocks if b[3] not in menus]

    @staticmethod
    def counted(blocks: list[list], doubtful: list[tuple], anchors: list[int]) -> list[list]:
        """The blocks whose marks all turn out to hold the page's text."""
        held, total, only = [0] * len(doubtful), 0, set()
        for _, text, links, _, _, mark in blocks:
            worth = max(0, len(text) - links)
            total += worth
            if mark >= 0:
                held[mark] += worth
        if min(anchors, default=-1) >= 0:
            for mark in anchors:
                while mark >= 0 and mark not in only:
                    only.add(mark)
                    mark = doubtful[mark][1]
        for mark in range(len(doubtful) - 1, -1, -1):
            if (around := doubtful[mark][1]) >= 0:
                held[around] += held[mark]
        keeps = []
        for mark, (may, around) in enumerate(doubtful):
            keeps.append(may and (2 * held[mark] > total or mark in only) and (around < 0 or keeps[around]))
        return [b for b in blocks if b[5] < 0 or keeps[b[5]]]

    @staticmethod
    def cut(stack: list, i: int, opened: Counter) -> None:
        for element in stack[i:]:
            opened[element.tag] -= 1
        del stack[i:]

    @classmethod
    def close(cls, stack: list, tags: tuple, opened: Counter) -> None:
        """An element that a new sibling ends, with all that is open inside it."""
        if not any(opened[tag] for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cls.cut(stack, i, opened)
                return
            if stack[i].tag in SCOPES or stack[i].tag in CONTAINERS:
                return

    @staticmethod
    def scores(blocks: list[list]) -> dict[str, float]:
        """Score of each container: its own text without links, and half of what its children hold."""
        out: dict[str, float] = {}
        for path, text, links, *_ in blocks:
            worth = max(0, len(text) - 2 * links)
            path = semantic(path)
            out[path] = out.get(path, 0) + worth
            if (parent := path.rpartition("/")[0]):
                out[parent] = out.get(parent, 0) + worth / 2
        for path in out:
            tag, _, mark = path.rpartition("/")[2].partition(".")
            if tag in ("article", "main") or not BODY_WORDS.isdisjoint(re.findall("[a-z]+", mark)):
                out[path] *= 1.5
        return out


def semantic(path: str) -> str:
    """The path up to its first ``article``, else ``main``, else itself: what belongs together by the page's own word."""
    steps = path.split("/")
    for tag in ("article", "main"):
        for i, step in enumerate(steps):
            if step.partition(".")[0] == tag:
                return "/".join(steps[:i + 1])
    return path


def best(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda p: (scores[p], -len(p), p)) if scores else None


def text_under(blocks: list[list], path: str | None) -> str:
    """Texts of the blocks in containers of that path, in page order, joined by one space."""
    return " ".join(b[1] for b in blocks if b[0] == path or b[0].startswith(f"{path}/")) if path is not None else ""


READ_TYPE = T.StructType([
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("vote", T.StringType())])
ARROW_READ = pa.struct([("blocks", pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))),
                        ("paths", pa.list_(pa.string())), ("vote", pa.string())])
PAGES_AT_ONCE = 512


@F.arrow_udf(READ_TYPE)
def read_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: a page's blocks in order, the paths of its containers with a fair share of the best score, and the best (its vote)."""
    reader = Reader()
    for pages in batches:
        parts = []
        for start in range(0, max(1, len(pages)), PAGES_AT_ONCE):
            rows = []
            for page in pages.slice(start, PAGES_AT_ONCE):
                blocks = reader.blocks(page.as_py() or "")
                scores = reader.scores(blocks)
                vote = best(scores)
                rows.append({"blocks": [{"path": b[0], "text": b[1]} for b in blocks],
                             "paths": [p for p, score in scores.items() if score >= FAIR_SHARE * scores[vote]], "vote": vote})
            parts.append(pa.array(rows, ARROW_READ))
        yield pa.concat_arrays(parts)


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and ``www.``; empty where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def consensus(read: DataFrame) -> DataFrame:
    """(page, path) of every page with several fair paths: the one with most votes on its host. ``read``: (page, host, paths, vote)."""
    votes = read.where("vote is not null").groupBy("host", "vote").agg(F.count(F.lit(1)).alias("votes"))
    fair = read.where(F.size("paths") > 1).select("page", "host", F.explode("paths").alias("vote"))
    order = F.struct(F.negative("votes").alias("votes"), "vote")
    return fair.join(votes, ["host", "vote"]).groupBy("page").agg(F.min(order)["vote"].alias("path"))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page, and ``main_text``: struct of the main text and the path it was found under.

    What the pages hold is written once; the votes and the texts are both read from there.
    """
    read = pages.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], host_of(F.col(url_col)).alias("host"),
                        read_page(F.col(html_col)).alias("read"))
    read = written(read.select("*", "read.*", F.monotonically_increasing_id().alias("page")).drop("read"), "pages")
    chosen = written(consensus(read), "chosen")
    path = F.coalesce("path", "vote")
    under = F.filter("blocks", lambda b: (b["path"] == F.col("path")) | F.startswith(b["path"], F.concat(F.col("path"), F.lit("/"))))
    text = F.coalesce(F.array_join(F.transform(under, lambda b: b["text"]), " "), F.lit(""))
    return (read.join(chosen, "page", "left").withColumn("path", path)
            .select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], F.struct(text.alias("text"), F.col("path")).alias("main_text")))
