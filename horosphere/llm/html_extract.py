"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template. Every page is parsed into tokens: elements
told apart by their path (tag with class and id names, long numbers dropped) and the
text below each. A token's occurrence vector is how often it occurs on each
page of the host; vectors are compared by a hash that combines over pages in any
order, so each host needs one row per token and the counting combines on the map side. Tokens
with equal vectors are a class. Classes that occur on enough pages of
the host are valid; as paths nest, the valid classes nest into the template,
and the paths below them that hold text are its slots. A slot whose text is the same on all
its pages is template text if their largest other slots differ; copies of one page count
once. Inside a region named as the article that takes a box (div, section, table,
list, ...) with a class or id below the region that holds no other slots; headings, paragraphs and
passages beside varying text stay, however many pages share them. The main region is the path
below which the article lies: the one named so (article, main, ...), unless it is
so named by a class or id only and holds few words beside a region that
holds most; on pages without one the deepest path that holds most of the words of the host's
varying, unlinked slots.

A page's text is what its slots below the main region hold, without template text and regions
that are named as menus, headers, footers, side bars, notices, adverts, forms,
comments and the like.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.tables import kept

LEAST_SUPPORT = 0.02   # share of a host's pages on which a valid class occurs
CONSTANT_PAGES = 5     # pages of different contents from which unchanging text is template text
OTHER_WORDS = 0.1      # share of a slot's words that another slot must hold to tell contents apart
MOST_WORDS = 0.6       # share of the host's words below the main region
FEW_WORDS = 0.25       # share of the best region's words a page under which a class or id names no article
TEMPLATE_BYTES = 1 << 25   # templates of all hosts that are sent to every task

# HTML's void, raw-text and inline elements and elements that close each other.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg noembed noframes xmp annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr label button math mi mn mo ms mtext mrow mfrac msup "
                   "msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom mfenced "
                   "menclose mmultiscripts semantics".split())
SPACED = frozenset("br mtr mtd".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table td th ul ol dl article section main div body html aside nav form".split())
BOXES = frozenset("div section header footer aside table ul ol dl figure details fieldset center".split())
# Element and name words that mark regions other than the article.
APART = frozenset("nav footer aside form script style template head title iframe svg select "
                  "textarea dialog menu input object".split())
APART_OUTSIDE = frozenset("header noscript button".split())   # apart unless in a named article
APART_WORDS = frozenset("nav navbar navigation menu footer sidebar aside banner ad ads advert adverts advertisement "
                        "advertising sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal "
                        "overlay newsletter subscribe subscription signup share sharing social comment comments "
                        "disqus reply replies respond breadcrumb breadcrumbs pagination pager related recommended "
                        "widget masthead toolbar login search copyright skip complementary contentinfo search "
                        "alert alertdialog dialog".split())
HEADER_WORDS = frozenset({"header", "topbar", "masthead"})
# Words of place and form that may stand beside those in one name ("site-footer", "comment-list").
PLACE_WORDS = frozenset("site page main top bottom left right primary secondary global local list box bar container "
                        "wrapper wrap area section block slot inner outer posts links link buttons button icons form "
                        "items item media post panel the js wp".split())
MAIN_WORDS = frozenset("article main content post entry story articlebody postbody entrycontent maincontent "
                       "postcontent articlecontent bodytext".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = frozenset("class id role itemprop".split())
_NAME = re.compile(r"[a-zA-Z]+(?:[0-9]{1,2}(?![0-9]))?")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def _attributes(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id, role and itemprop, in order, numbers over 99 dropped; whether the element is hidden."""
    out, hidden = [], False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = next(v for v in (m[2], m[3], m[4], "") if v is not None)
        if key in _NAMING:
            value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
            out += ["-".join(_NAME.findall(name.lower())) for name in value.split()]
        elif key == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif key == "aria-hidden":
            hidden = hidden or value.lower() == "true"
    return tuple(n for n in out if n), hidden


def _says(name: str, words: frozenset) -> bool:
    """Whether a whole name is one of ``words``, alone or with words of place: not "has-sidebar"."""
    parts = [w.rstrip("0123456789") for w in name.split("-")]
    return not words.isdisjoint(parts) and all(w in words or w in PLACE_WORDS or not w for w in parts)


class _Open:
    __slots__ = ("tag", "path", "apart", "main", "by_name")

    def __init__(self, tag, path, apart, main, by_name):
        self.tag, self.path, self.apart, self.main, self.by_name = tag, path, apart, main, by_name


def parse(page: str) -> list:
    """Rows of ``page`` (see ``_rows``). If all its named articles lie in elements that are
    apart by class, id or hidden only, those elements hold the article and are not apart."""
    holders: set[int] = set()
    rows = list(_rows(page, frozenset(), holders))
    if holders and not any(main and not apart and text and not text.isspace() for _, _, apart, main, text in rows):
        rows = list(_rows(page, frozenset(holders), set()))
    return rows


def _rows(page: str, spared: frozenset, holders: set):
    """Yield (path, linked, apart, main, text) for every text, (path, ..., None) where
    a block element opens and ("", ..., None) where one closes.

    ``apart``: below an element that is no part of an article; ``main``: the
    path of the outermost element above that is named as the article, or "".
    ``holders`` gets the places of elements that are apart by name only and hold
    an element named as the article; those in ``spared`` are not apart.
    """
    stack = [_Open("", "", False, "", ())]
    links = 0
    at, size = 0, len(page)

    def close(i):
        nonlocal links
        links -= sum(o.tag == "a" for o in stack[i:])
        del stack[i:]

    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        top = stack[-1]
        if end > at:
            yield top.path, links > 0, top.apart, top.main, page[at:end]
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield top.path, links > 0, top.apart, top.main, m[0][9:].removesuffix("]]>")
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        yield "", False, False, "", None
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in RAW or tag == "noscript" and not top.main:
            e = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = e.end() if e else size
            continue
        if tag not in INLINE:
            shut = CLOSED_BY.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or t in shut:
                    close(i)
                    if t == "p":
                        break
                elif t in SCOPE and t not in INLINE:
                    break
            top = stack[-1]
        if tag in VOID or m[3].endswith("/") and tag not in SCOPE:
            if tag not in INLINE:
                yield "", False, False, "", None
            if tag in SPACED:
                yield top.path, links > 0, top.apart, top.main, " "
            continue
        if tag in SPACED:
            yield top.path, links > 0, top.apart, top.main, " "
        names, hidden = _attributes(m[3]) if m[3] else ((), False)
        if tag in INLINE and not names:
            path = top.path
        else:
            path = f"{top.path}/{tag}" + "".join("." + n for n in names)
        by_tag = tag in APART or not top.main and tag in APART_OUTSIDE
        by_name = not by_tag and tag not in ("html", "body") and m.start() not in spared and (
            hidden or any(_says(n, APART_WORDS) or not top.main and _says(n, HEADER_WORDS) for n in names))
        # None below an element that is apart by its tag; else places of those apart by name
        above = None if by_tag or top.by_name is None else top.by_name + (m.start(),) * by_name
        named = tag in ("article", "main") or any(n.replace("-", "").rstrip("0123456789") in MAIN_WORDS for n in names)
        apart = top.apart or by_tag or by_name
        main = top.main
        if not main and not apart and named:
            main = path
        elif named and above:
            holders.update(above)
        stack.append(_Open(tag, path, apart, main, above))
        links += tag == "a"
        if tag not in INLINE:
            yield path, False, apart, main, None


def _tokens(batches):
    """Per page and path: count, words, linked words, a hash of the texts; apart and main flags."""
    for b in batches:
        out = []
        ids = b.column(0).to_pylist()
        hosts = b.column(1).to_pylist()
        for i, host, page in zip(ids, hosts, b.column(2).to_pylist()):
            seen: dict = {"": [0, 0, 0, [], False, ""]}
            for path, linked, apart, main, text in parse(page or ""):
                s = seen.setdefault(path, [0, 0, 0, [], apart, main])
                if text is None:
                    s[0] += 1
                elif not text.isspace():
                    n = len(text.split())
                    s[1] += n
                    s[2] += n * linked
                    s[3].append(text)
            texts = {p: "\n".join(s[3]) for p, s in seen.items()}
            open_ = sorted((p for p, s in seen.items() if s[1] and not s[4] and 2 * s[2] <= s[1]),
                           key=lambda p: (-seen[p][1], p))[:2]

            def other(path, n):
                """Text of the page's largest other slot, None if that holds too few words."""
                for q in open_:
                    if q != path:
                        return texts[q] if seen[q][1] >= OTHER_WORDS * n else None
                return None

            out += [(i, host, p, s[0], s[1], s[2], texts[p], s[4], s[5], other(p, s[1]) if s[1] else None)
                    for p, s in seen.items()]
            if len(out) >= 4096:
                yield _token_batch(out)
                out = []
        if out:
            yield _token_batch(out)


def _token_batch(out):
    from pandas.util import hash_array
    c = list(zip(*out))
    text = hash_array(np.array(c[6], object), categorize=False).view(np.int64)
    none = np.array([x is None for x in c[9]])
    other = hash_array(np.array([x or "" for x in c[9]], object), categorize=True).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()),
         *[pa.array(c[i], pa.int64()) for i in (3, 4, 5)], pa.array(text), pa.array(c[7], pa.bool_()),
         pa.array(c[8], pa.string()), pa.array(other, mask=none)],
        ["page_id", "host", "path", "n", "words", "linked", "text", "apart", "main", "other"])


def _deduce(host_rows: pd.DataFrame) -> pd.DataFrame:
    """One host's token rows (valid ones only) -> its template: (host, main regions, template
    text paths, named regions that are not the article)."""
    t = host_rows
    pages = int(t["host_pages"].iloc[0])
    # classes: tokens sharing an occurrence vector
    size = t.groupby("vector")["path"].transform("size")
    on = dict(zip(t["path"], t["pages"]))
    slots = t[t["words"] > 0]
    unchanging = slots["same_text"] & (slots["contents"] >= CONSTANT_PAGES)
    varying = set()     # elements above text that is not the same everywhere
    for path in slots["path"][~unchanging]:
        while path not in varying:
            varying.add(path)
            path = path.rpartition("/")[0]

    def template_text(path, main, of_class):
        if not main:
            return of_class > 1
        while path != main and path not in varying:
            path, _, element = path.rpartition("/")
            if "." in element and element.split(".")[0] in BOXES:
                return True
        return False

    fixed = [p for p, m, n in zip(slots["path"][unchanging], slots["main"][unchanging], size[slots.index][unchanging])
             if template_text(p, m, n)]
    open_ = slots[~slots["apart"] & ~slots["path"].isin(fixed) & (2 * slots["linked"] <= slots["words"])]

    def words_below(some):
        sums: dict[str, int] = {}
        for path, w in zip(some["path"], some["words"]):
            parts = path.split("/")
            for k in range(1, len(parts) + 1):
                p = "/".join(parts[:k])
                sums[p] = sums.get(p, 0) + w
        return sums

    def deepest(some):
        best, total = "", some["words"].sum()
        for p, w in words_below(some).items():
            if w >= MOST_WORDS * total and (p.count("/"), p) > (best.count("/"), best) and p.rpartition("/")[2].split(".")[0] != "p":
                best = p
        return best

    sums, best = words_below(open_), deepest(open_)
    named = sorted({m for m, a in zip(slots["main"], slots["apart"]) if m and not a})
    # a class or id alone is weak evidence: the words may say otherwise
    refused = [m for m in named if m.rpartition("/")[2].split(".")[0] not in ("article", "main")
               and best and not _below(best, m) and not _below(m, best) and on.get(best, 0) >= on.get(m, 0)
               and sums.get(m, 0) * on.get(best, 0) < FEW_WORDS * sums[best] * on.get(m, 1)]
    region = [m for m in named if m not in refused]
    if sum(on.get(m, 0) for m in region) < pages:   # pages without a named article
        region.append(deepest(open_[~open_["main"].isin(region)]))
    return pd.DataFrame({"host": [t["host"].iloc[0]], "pages": [pages], "region": [region], "fixed": [sorted(fixed)],
                         "refused": [refused]})


def _below(path: str, region: str) -> bool:
    return not region or path == region or path.startswith(region + "/")


def extract(page: str, region, fixed, refused=()) -> str:
    """Text of one page: blocks of the slots below ``region`` joined by a blank line."""
    rows = list(parse(page))
    skip = set(fixed)
    if any(main and main not in refused and not apart and text and not text.isspace() for _, _, apart, main, text in rows):
        def inside(path, main):
            return bool(main) and main not in refused
    else:
        region = [r for r in region if any(_below(p, r) for p, _, a, _, t in rows if t and not a and t.strip())] or [""]

        def inside(path, main):
            return any(_below(path, r) for r in region)
    blocks, part = [], []
    for path, _, apart, main, text in rows:
        if text is None:
            if part:
                blocks.append("".join(part))
                part = []
        elif not apart and path not in skip and inside(path, main):
            part.append(text)
    if part:
        blocks.append("".join(part))
    clean = (" ".join(_html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def _extract(batches):
    for b in batches:
        ids, urls = b.column(0), b.column(1)
        out = [extract(p or "", r or [], f or [], n or [])
               for p, r, f, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, region, fixed, refused) for every host of ``pages`` (page_id, host, html)."""
    token = pages.select("page_id", "host", "html").mapInArrow(
        _tokens, "page_id long, host string, path string, n long, words long, linked long, text long, "
                 "apart boolean, main string, other long")
    per = token.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.expr("bit_xor(xxhash64(page_id, n))").alias("vector"),
        F.sum("words").alias("words"), F.sum("linked").alias("linked"),
        (F.min("text") == F.max("text")).alias("same_text"),
        F.approx_count_distinct("other", 0.05).alias("contents"),    # 512 registers: a few are counted exactly or one short
        F.min("apart").alias("apart"), F.max("main").alias("main"))
    per = kept(per, "page-tokens")
    # the root path is on every page
    size = per.where("path = ''").select("host", F.col("pages").alias("host_pages"))
    # valid tokens: at most (tokens of a page) / LEAST_SUPPORT rows per host
    valid = per.join(size, "host").where(F.col("pages") >= F.ceil(F.col("host_pages") * LEAST_SUPPORT))
    return valid.groupBy("host").applyInPandas(_deduce, "host string, pages long, region array<string>, fixed array<string>, "
                                               "refused array<string>")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    ``pages`` needs page_id, url and html. Null html counts as empty, pages with
    null or malformed urls share one host, repeated rows are extracted one by
    one, other columns are ignored, an empty table gives no rows. White space
    inside a block becomes one space; blocks are joined by a blank line.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"),
                        F.col("html").cast("string").alias("html"))
    t = kept(templates(rows), "templates").select("host", "region", "fixed", "refused")
    words = F.concat("region", "fixed", "refused")
    size = t.agg(F.sum(F.length(F.array_join(words, "/")) + 64)).first()[0] or 0
    # small templates go to the pages; beyond that both are joined by host, and large hosts are split by the
    # bytes they hold (AQE's skewed join)
    t = F.broadcast(t) if size <= TEMPLATE_BYTES else t
    return rows.join(t, "host", "left").select("page_id", "url", "html", "region", "fixed", "refused").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
