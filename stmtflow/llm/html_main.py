"""Operator 3: main text of web pages by template deduction over equivalence classes.

Pages of one host share a template. A token is an element role (the path of tags and
class names down to an opening tag, so that equal tags in different places differ) or a
run of text under a role. Its occurrence vector says how often it occurs on every page of
the host; tokens with equal vectors form an equivalence class. A vector is kept as a sum
of one hash per page and count, so vectors of any length are aggregated before the
shuffle, and no task holds a host.

* A class is valid as template if it has the support of ``SUPPORT`` pages and holds an element
  role; its roles nest by their paths, and so do the classes.
* A text run in the class of a role is text of the template (a label, a notice), not content. Where the
  main role is an article or main element, this holds for runs and roles inside such elements, on half
  of its pages or more; if those runs are more than half of its text, the pages are copies and keep them.
* What is left between template tokens are the slots. Each role has the mass of slot text
  below it over all pages of the host, and the main role is the deepest template role that
  still holds most of it; ``article`` and ``main`` elements, where a host has them, are
  preferred. Roles that mark menus, headers, footers, notices, adverts, forms and
  comments, by tag or by class name (outside of article elements by id too), hold no slots.

A page yields the text of its main role, in page order. A page without host, of a host with
too little support, or without the host's main role is read by its own roles alone.

Cases: null or empty html gives empty text; null url is a page without host; unclosed
elements, comments and scripts end with the page; repeated rows stay rows of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SUPPORT = 4
MOST = 0.7           # share of the slot text that the main role holds
BROADCAST_BYTES = 32 << 20
RESULT = "page_id bigint, url string, text string, n_chars bigint"

# Fixed values of HTML: elements without content, without text, and those that do not end a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea object canvas audio video title".split())
CODE = frozenset("script style noscript template iframe textarea title".split())  # of RAW: without an end they last to the end of the page
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms msub msup msubsup mfrac msqrt mroot mtext mstyle "
                    "mover munder munderover semantics").split())
# Opening one of the keys ends an open one of the values, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
CONTAINERS = frozenset("html body main article section div ul ol dl table blockquote form nav header footer aside td th".split())
# Elements and words of class names or ids that mark what is not the article.
APART = frozenset("nav aside footer form menu dialog select button fieldset".split())
APART_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
                         "sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
                         "comment comments disqus reply replies respond discussion share sharing social related recommended "
                         "recommendations footer masthead newsletter subscribe subscription signup login popup modal overlay "
                         "widget widgets pagination pager toolbar skip search copyright disclaimer outbrain taboola").split())
# Words that say nothing about what an element holds: beside them a word of the above decides also within an article.
BARE_WORDS = frozenset("area block bottom box center container content for inner item items left link links list main new outer panel post right row section slot small the top unit wrap wrapper".split())
HEADER_WORDS = frozenset(("header", "topbar", "site-header", "page-header"))
SEMANTIC = frozenset(("article", "main"))
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())

PIECE = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'<])*+)(?:>|\Z)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


class Element:
    __slots__ = ("tag", "role", "depth", "apart", "semantic", "main")

    def __init__(self, tag, role, depth, apart, semantic, main):
        self.tag, self.role, self.depth, self.apart, self.semantic, self.main = tag, role, depth, apart, semantic, main


def named_apart(name: str, within: bool = False) -> bool:
    """Whether a class name or id marks something beside the article.

    Outside of article elements the first or the last part of the name is enough; ``within`` them every part has to say
    so, or nothing: ``search-results`` or ``copyright-law`` are subjects an article may have.
    """
    parts = [x for x in re.split(r"[-_0-9]+", name.lower()) if x]
    if not parts or parts[0] in ("with", "has", "no", "without"):
        return False
    if within:
        return any(x in APART_WORDS for x in parts) and all(x in APART_WORDS or x in BARE_WORDS for x in parts)
    return parts[0] in APART_WORDS or parts[-1] in APART_WORDS


def opened(tag: str, attributes: str, parent: Element | None, main_role: int | None) -> Element:
    names, classes, semantic, hidden, header = [], [], tag in SEMANTIC, False, tag == "header"
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += value.split()
                classes += value.split() if key == "class" else []
            elif key == "role":
                semantic = semantic or value in SEMANTIC
                names += [value] if value in ("navigation", "search", "banner", "contentinfo", "complementary") else []
                hidden = hidden or value in ("navigation", "search", "banner", "contentinfo", "complementary", "dialog", "alert")
            elif key == "itemprop":
                semantic = semantic or value == "articleBody"
            elif key == "hidden":
                hidden = True
            elif "display:none" in value.replace(" ", "").lower():
                hidden = True
    within = parent is not None and parent.semantic
    header = header or any(n.lower() in HEADER_WORDS for n in names)
    apart = (parent is not None and parent.apart) or hidden or tag in APART or (header and not within)
    if not apart and tag not in ("html", "body") and tag not in INLINE:
        # Ids name places to link to, and headings and paragraphs are text: within an article neither sets anything apart.
        apart = (tag not in TEXT_BLOCKS and any(named_apart(n, True) for n in classes)) if within else any(named_apart(n) for n in names)
    if tag in INLINE:
        role, depth = (parent.role, parent.depth) if parent else (0, 0)
    else:
        label = tag + "".join("." + re.sub(r"[0-9]+", "#", n) for n in sorted(set(names)))
        role = xxhash.xxh64_intdigest(f"{parent.role if parent else 0}/{label}") >> 1
        depth = (parent.depth if parent else 0) + 1
    main = (parent is not None and parent.main) or (main_role is not None and role == main_role)
    return Element(tag, role, depth, apart, within or semantic, main)


def walk(page: str, main_role: int | None = None) -> Iterator[tuple]:
    """(kind, element, data): 'open' with the parent's role, 'text' with raw text, 'break'."""
    stack: list[Element] = []
    count: Counter = Counter()  # open elements by tag: a tag that none waits for is not searched
    at, end = 0, len(page)

    def cut_to(i: int) -> None:
        count.subtract(e.tag for e in stack[i:])
        del stack[i:]

    while at < end:
        m = PIECE.match(page, at)
        at = m.end()
        if m[4] is not None:
            yield "text", stack[-1] if stack else None, m[4]
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                yield "break", None, None
            for i in range(len(stack) - 1, -1, -1) if count[tag] else ():
                if stack[i].tag == tag:
                    cut_to(i)
                    break
                if stack[i].tag in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        if tag not in INLINE:
            yield "break", None, None
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else end if tag in CODE else at
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag) or (None if tag in INLINE else {"p"})
        if ends and any(count[t] for t in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    cut_to(i)
                    if tag not in ("tr", "thead", "tbody"):
                        break
                elif stack[i].tag in CONTAINERS:
                    break
        parent = stack[-1] if stack else None
        element = opened(tag, m[3], parent, main_role)
        if tag not in INLINE:
            yield "open", element, parent
        stack.append(element)
        count[tag] += 1


def plain(raw: str) -> str:
    return entities.unescape(raw) if "&" in raw else raw


def main_text(page: str, main_role: int | None, template_texts: frozenset) -> str:
    """Text of the main role's elements; of article or main elements, or all, if there is no such role."""
    levels: dict[int, list[str]] = {0: [], 1: [], 2: []}  # all, semantic, main role
    for kind, element, data in walk(page, main_role):
        if kind == "break":
            for out in levels.values():
                out.append(" ")
        elif kind == "text" and (element is None or not element.apart):
            if element is not None and template_texts and run_key(element.role, data) in template_texts:
                continue
            levels[0].append(data)
            if element is not None:
                if element.semantic:
                    levels[1].append(data)
                if element.main:
                    levels[2].append(data)
    for level in (2, 1, 0):
        # Character references end with their run of text; a space inside a block is one space.
        text = " ".join("".join(plain(x) for x in levels[level]).split())
        if text:
            return text
    return ""


def run_key(role: int, raw: str) -> int:
    return xxhash.xxh64_intdigest(f"{role}>{' '.join(raw.split())}") >> 1


def host_of(url: str | None) -> str | None:
    m = HOST.match(url.strip()) if url else None
    return m[1].lower() if m else None


# Spark --------------------------------------------------------------------------------------

TOKENS = ("host string, token bigint, parent bigint, is_text boolean, semantic boolean, depth int, "
          "pages bigint, total bigint, vector bigint, mass bigint")


def _token_statistics(batches: Iterator) -> Iterator:
    """(page_id, url, html) rows to partial occurrence statistics of the tokens of each host."""
    import pyarrow as pa

    for batch in batches:
        found: dict[tuple, list] = {}
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            host = host_of(url)
            if host is None or not page:
                continue
            counts: dict[tuple, list] = {}
            parents: dict[int, int] = {}
            for kind, element, data in walk(page):
                if kind == "open" and not element.apart:
                    parents[element.role] = data.role if data else 0
                    entry = counts.setdefault((element.role, False), [parents[element.role], element.semantic, element.depth, 0, 0])
                    entry[3] += 1
                elif kind == "text" and element is not None and not element.apart and not data.isspace():
                    size, role = len(data.strip()), element.role
                    entry = counts.setdefault((run_key(role, data), True), [role, element.semantic, element.depth, 0, 0])
                    entry[3] += 1
                    entry[4] += size
                    while role:
                        if (role, False) in counts:
                            counts[role, False][4] += size
                        role = parents.get(role, 0)
            own = xxhash.xxh64_intdigest(f"{page_id}|{url}|{len(page)}") >> 1
            for (token, is_text), (parent, semantic, depth, n, mass) in counts.items():
                entry = found.setdefault((host, token, parent, is_text, semantic, depth), [0, 0, 0, 0])
                entry[0] += 1
                entry[1] += n
                entry[2] = (entry[2] + (own ^ n * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93) & 0x7FFFFFFFFFFFFFFF
                entry[3] += mass
        cols = list(zip(*(k + tuple(v) for k, v in found.items()))) or [()] * 10
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in TOKENS.split(", ")])


def token_classes(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, total, vector (hashed occurrence vector), mass, and its class's numbers."""
    part = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _token_statistics, TOKENS)
    # Partial sums fit 63 bits; they are added in halves, which cannot overflow, and put together again.
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("vector", 32)
    tokens = (part.groupBy("host", "token", "parent", "is_text").agg(
        F.max("semantic").alias("semantic"), F.max("depth").alias("depth"), F.sum("pages").alias("pages"),
        F.sum("total").alias("total"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("mass").alias("mass"))
        .filter(F.col("pages") >= SUPPORT))
    vector = F.xxhash64(F.pmod(F.col("high") + F.shiftright("low", 32), F.lit(1 << 31)), F.col("low").bitwiseAND(F.lit(0xFFFFFFFF)))
    return tokens.withColumn("vector", vector).drop("low", "high")


def templates(pages: DataFrame) -> DataFrame:
    """host, main_role, texts (keys of template text)."""
    tokens = cut(token_classes(pages))
    roles = tokens.filter("NOT is_text")
    host = Window.partitionBy("host")
    # The main role occurs at most once a page and on at least half of the host's pages.
    fit = (roles.withColumn("most_pages", F.max("pages").over(host))
           .filter((F.col("total") == F.col("pages")) & (2 * F.col("pages") >= F.col("most_pages")) & (F.col("mass") > 0))
           .withColumn("all_mass", F.max("mass").over(host))
           .withColumn("article_mass", F.max(F.when(F.col("semantic"), F.col("mass"))).over(host)))
    by_article = F.coalesce(F.col("article_mass") >= 0.3 * F.col("all_mass"), F.lit(False))
    fit = fit.filter(F.when(by_article, F.col("semantic") & (F.col("mass") >= MOST * F.col("article_mass")))
                     .otherwise(F.col("mass") >= MOST * F.col("all_mass")))
    nth = F.row_number().over(host.orderBy(F.when(F.col("semantic"), F.col("depth")).otherwise(-F.col("depth")), F.desc("mass"), "token"))
    main = fit.withColumn("nth", nth).filter("nth = 1").select(
        "host", F.col("token").alias("main_role"), F.col("semantic").alias("article"), F.col("pages").alias("main_pages"), F.col("mass").alias("main_mass"))
    # Text in the class of an element role: on just the pages, and as often, as a piece of the template.
    classes = roles.groupBy("host", "pages", "total", "vector").agg(F.max("semantic").alias("inside"))
    within = F.col("semantic") & F.col("inside") & (2 * F.col("pages") >= F.col("main_pages"))
    texts = (tokens.filter("is_text").join(classes, ["host", "pages", "total", "vector"]).join(main, "host")
             .filter(~F.col("article") | within)
             .groupBy("host").agg(F.collect_set("token").alias("texts"), F.sum("mass").alias("text_mass")))
    none = F.array().cast("array<bigint>")
    copies = F.col("article") & (2 * F.col("text_mass") > F.col("main_mass"))
    return (main.join(texts, "host", "left")
            .select("host", "main_role", F.when(copies, none).otherwise(F.coalesce("texts", none)).alias("texts")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    known = cut(templates(pages))
    size = known.agg(F.sum(F.length("host") + 16 + 8 * F.size("texts"))).first()[0] or 0
    known = known.withColumnRenamed("host", "of")
    host = F.lower(F.regexp_extract(F.trim("url"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("host", host)
    if size <= BROADCAST_BYTES:
        # Templates, a row per host, go to all tasks as one table while their measured size is small; page rows carry only the host.
        table = {r["of"]: (r["main_role"], np.array(r["texts"], dtype=np.int64)) for r in known.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(table)
        rows = rows.select("page_id", "url", "html", "host")
    else:
        shared = None
        rows = rows.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "host", "main_role", "texts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        met: dict[str, tuple] = {}  # by host, one entry for each met in a batch
        for batch in batches:
            met.clear()
            out = []
            for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in met:
                    if shared is not None:
                        role, texts = shared.value.get(host, (None, ()))
                        met[host] = role, frozenset(texts.tolist() if len(texts) else ())
                    else:
                        met[host] = batch.column(4)[i].as_py(), frozenset(batch.column(5)[i].as_py() or ())
                out.append(main_text(page, *met[host]) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, RESULT)
