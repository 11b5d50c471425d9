"""Main text of HTML pages, with removal of site templates.

1. Every page is parsed into a light tree of elements (tolerant of unclosed tags), in time that grows with its length: a tag is read
   once, and what it closes is found by places of open elements.  Elements that cannot hold main text by their tag, role or class
   (menus, headers, footers, forms, scripts, adverts, notices, comments) are out at once; a class counts only as a whole token.
2. The subtrees of every page are hashed bottom-up (tag, texts, and hashes of children; comments do not count), and Spark counts them for each host: outside a marked article the pages on which a
   hash occurs, inside one the different articles.  Subtrees that recur on at least ``MIN_PAGES`` of them are template.
3. The second pass deletes template subtrees and reads the text of what is left: of the article, if the page marks one, or
   else of the whole body.

Inside a marked article a separate rule guards what is reposted.  Copies of an article count once, inline elements and articles
are never template, and a recurring block that holds prose (``PROSE``) is template only if more than half of the host's
articles have it; so reposted articles, passages and license lines stay.
Recurring hashes go to the tasks if there are at most ``FEW`` (48 bytes each); beyond that they are joined, by page.

Cases: a null or empty html gives an empty text.  A page with a null URL or no host belongs to the host ''.  Repeated rows are
extracted each on its own, and count once per page_id, or article, and hash.  Markup of any length and depth is read whole.  Extra columns
are ignored; an empty table gives an empty result.  A tag without end is text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import short_batches, staged, table

MIN_PAGES, FEW = 5, 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUT_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg math object textarea button select option input label dialog menu canvas audio video title".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A class or id is out if all words of one of its tokens are of these two lists, and one of the first.
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead toolbar share sharing social related recommended comment comments disqus replies reply respond login search widget pagination pager skip".split())
BESIDE_WORDS = frozenset("site page main top bottom left right side global primary secondary content container wrapper wrap box bar block list section area item items link links text title form buttons icons inner outer".split())
#: Elements of running text, which articles repost.
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figure".split())
#: Marks hashes of subtrees inside a marked article; alone, it counts the articles.
INSIDE = b"i"
#: An open element of the key closes when one of the set starts.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "caption", "figcaption", "legend", "summary"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}

#: name -> names of open elements that its start closes.
CLOSES = {new: tuple(sorted(old for old, news in CLOSED_BY.items() if new in news)) for new in sorted(set().union(*CLOSED_BY.values()))}
#: A start does not close anything outside the innermost of these.
WALLS = frozenset("table ul ol dl select article section div body blockquote".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_TO_END = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++)))?")
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("children", "digest", "name", "out", "prose", "tag")

    def __init__(self, name: str, tag: str, out: bool) -> None:
        self.name, self.tag, self.out, self.children, self.digest, self.prose = name, tag, out, [], b"", False


def _out_token(token: str) -> bool:
    words = [w for w in _PARTS.split(token) if w]
    return any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in BESIDE_WORDS for w in words)


def _out(name: str, attributes: str) -> bool:
    if name in OUT_TAGS:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and any(map(_out_token, value.split())) or key == "role" and value.strip() in OUT_ROLES or key == "hidden" or key == "aria-hidden" and value.strip() == "true":
            return True
    return False


class _Page:
    """Ends of tags in a page. Quotes are heeded until a tag would run to the end of the page; from then on they are not."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place behind the > that ends a tag; -1 without one."""
        page, begin = self.page, at
        while self.quotes:
            m = _TO_END.search(page, at)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                at = page.find(m[0], m.end()) + 1
                if not at:
                    self.quotes = False
        return page.find(">", begin) + 1 or -1


def parse(page: str, hashed: bool = True) -> Element:
    """The root, with digests if asked for. Children are elements and texts."""
    root = Element("#root", "", False)
    stack, made, at, scan = [root], [root], 0, _Page(page)
    # places in the stack, by name of the open element, and of walls
    places: dict[str, list[int]] = {}
    walls: list[int] = []

    def close(k: int) -> None:
        while len(stack) > k:
            name = stack.pop().name
            places[name].pop()
            if name in WALLS:
                walls.pop()

    def text(begin: int, end: int) -> None:
        if end > begin:
            stack[-1].children.append(page[begin:end])

    while m := _OPEN.search(page, at):
        begin = m.start()
        if m[1] or m[2]:
            end = page.find("-->", m.end()) + 3 if m[1] else page.find(">", m.end()) + 1
            end = end if end > 2 or end and not m[1] else len(page)
        else:
            end = scan.end(m.end())
            if end < 0:
                # no tag ends behind this place
                break
        text(at, begin)
        at = end
        if not m[4]:
            continue
        name = m[4].lower()
        if m[3]:
            if places.get(name):
                close(places[name][-1])
            continue
        last = max((places[old][-1] for old in CLOSES.get(name, ()) if places.get(old)), default=-1)
        if last > (walls[-1] if walls else 0):
            close(last)
        attributes = page[m.end() : end - 1]
        e = Element(name, page[begin:end], _out(name, attributes))
        stack[-1].children.append(e)
        made.append(e)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, end)
            if name not in ("script", "style"):
                e.children = [page[end : shut.start() if shut else len(page)]]
            at = shut.end() if shut else len(page)
            continue
        places.setdefault(name, []).append(len(stack))
        if name in WALLS:
            walls.append(len(stack))
        stack.append(e)
    text(at, len(page))
    # children were made behind their parents
    for e in reversed(made) if hashed else ():
        h = hashlib.blake2b(_SPACE.sub(" ", e.tag).encode("utf-8", "surrogatepass"), digest_size=12)
        e.prose = e.name in PROSE
        line: list[str] = []
        for c in [*e.children, None]:
            if isinstance(c, str):
                line.append(c)
                continue
            # a comment between two texts does not matter, nor does white space around them
            h.update(b"\0" + _SPACE.sub(" ", "".join(line)).strip().encode("utf-8", "surrogatepass"))
            line.clear()
            if c is not None:
                h.update(b"\1" + c.digest)
                e.prose = e.prose or c.prose and not c.out
        e.digest = h.digest()
    return root


def main_parts(root: Element) -> list[Element]:
    """The outermost article or main elements that are not in an element that is out; none if the page marks none."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.name in ("article", "main") and not e.out:
            found.append(e)
        elif not e.out:
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    return found


def subtrees(root: Element) -> set[tuple[bytes, bytes | None]]:
    """(hash, article): every subtree that the template count looks at, with the digest of its innermost marked article, or
    None outside; and INSIDE for each article. Not the document's frame, articles themselves, or inline elements in articles.
    """
    found: set[tuple[bytes, bytes | None]] = set()
    todo: list[tuple[Element, bytes | None, bool]] = [(root, None, False)]
    while todo:
        e, article, out = todo.pop()
        for c in e.children:
            if not isinstance(c, Element) or c.name == "br" or c.name in RAW:
                continue
            inner = article
            if c.name in ("article", "main") and not out:
                inner = c.digest
                found.add((INSIDE, inner))
            elif article is not None:
                if c.name in BLOCKS:
                    found.add((INSIDE + c.digest, article))
            elif c.name not in ("html", "body"):
                found.add((c.digest, None))
            todo.append((c, inner, out or c.out))
    return found


def _is_template(e: Element, marked: bool, template: dict[bytes, bool]) -> bool:
    """template: the hashes, each with whether more than half of the host's articles have it."""
    if not template or e.name in ("#root", "html", "body"):
        return False
    if not marked:
        return e.digest in template
    if e.name not in BLOCKS or e.name in ("article", "main"):
        return False
    most = template.get(INSIDE + e.digest)
    return most is not None and (most or not e.prose)


def text_of(root: Element, template: dict[bytes, bool] | None = None) -> str:
    parts = main_parts(root)
    marked, template = bool(parts), template or {}
    parts = parts or [root]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    for part in parts:
        todo: list = [part]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif x.out or _is_template(x, marked, template):
                if x.name in BLOCKS:
                    flush()
            elif x.name in BLOCKS:
                flush()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
        flush()
    return "\n".join(blocks)


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template_hashes(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, hash, most: subtrees that recur on at least min_pages pages or articles of a host; whether most of its articles have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a place is an article, or a page
            rows = [(h, d, f"p{i}".encode() if a is None else a) for h, i, page in zip(pdf["host"], pdf["page_id"], pdf["html"], strict=True) for d, a in subtrees(parse(page))]
            yield pd.DataFrame(rows, columns=["host", "hash", "place"])

    seen = pages.where("html is not null").select(_host().alias("host"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "html").mapInPandas(run, "host string, hash binary, place binary")
    n = seen.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    n = staged(n.where((F.col("n") >= min_pages) | (F.col("hash") == F.lit(INSIDE))), "recurring")
    articles = n.where(F.col("hash") == F.lit(INSIDE)).select("host", F.col("n").alias("articles"))
    most = F.coalesce(F.substring("hash", 1, 1).eqNullSafe(F.lit(INSIDE)) & (F.length("hash") > 12) & (2 * F.col("n") > F.col("articles")), F.lit(False))
    return n.where(F.col("hash") != F.lit(INSIDE)).join(articles, "host", "left").select("host", "hash", most.alias("most"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, few: int = FEW) -> DataFrame:
    """page_id, url, text, n_chars."""
    short_batches(pages.sparkSession, 128)
    template = template_hashes(pages, min_pages)
    known = template.limit(few + 1).collect()
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    if len(known) <= few:
        of_host: dict[str, dict[bytes, bool]] = {}
        for r in known:
            of_host.setdefault(r["host"], {})[bytes(r["hash"])] = r["most"]

        @F.pandas_udf("string")
        def text(html: pd.Series, host: pd.Series) -> pd.Series:
            return pd.Series([text_of(parse(p, h in of_host), of_host.get(h)) if p else "" for p, h in zip(html, host, strict=True)], dtype=object)

        out = rows.withColumn("text", text("html", "host"))
    else:

        @F.pandas_udf("array<binary>")
        def hashes(html: pd.Series) -> pd.Series:
            return pd.Series([sorted({d for d, _ in subtrees(parse(p))}) if p else [] for p in html], dtype=object)

        @F.pandas_udf("string")
        def text_without(html: pd.Series, gone: pd.Series, most: pd.Series) -> pd.Series:
            sets = [(() if g is None else g, {bytes(x) for x in (() if m is None else m)}) for g, m in zip(gone, most, strict=True)]
            return pd.Series([text_of(parse(p), {bytes(x): bytes(x) in m for x in g}) if p else "" for p, (g, m) in zip(html, sets, strict=True)], dtype=object)

        own = rows.select("page_id", "host", F.explode(hashes("html")).alias("hash"))
        gone = own.join(template, ["host", "hash"]).groupBy(F.col("page_id").alias("of"), F.col("host").alias("at")).agg(F.collect_set("hash").alias("gone"), F.collect_set(F.when(F.col("most"), F.col("hash"))).alias("most"))
        out = rows.join(gone, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("host") == F.col("at")), "left").withColumn("text", text_without("html", "gone", "most"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
