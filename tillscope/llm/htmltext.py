"""Main text of web pages by consensus host paths.

Pages of one host share a template. Each page scores its containers by the text
they hold outside links, furthest from boilerplate; its best container votes for a
generalised path of tags and classes (numbers in class names count as one). Spark
adds up the votes per host, and every page is then extracted again with the paths
its host agreed on, in the order of their support: by the first that holds a fair share
of the text of the page's own best container. A page that none of them fits uses its
own best container, unless most pages of the host that have such a container refuse
it for another. Pages without a host don't vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.registry import query
from tillscope.operators.lookup import fits_broadcast
from tillscope.session import written

WHOLE = 0.8  # a parent with this share of its best child's score is the whole
FITS = 0.3  # an agreed path fits a page if it holds this share of the text of the page's best container
MIN_SUPPORT = 0.05  # a path needs this share of its host's votes, so a host keeps 20 paths at most

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, elements that break lines.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot"
    " th thead tr ul".split()
)
_CONTAINERS = frozenset("article body center dd div main section td".split())
_PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th figcaption".split())
# What an opening tag closes implicitly, and where the search for it stops.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
_SCOPES = frozenset("html body table td th article section main aside nav header footer form button div ul ol dl li dd blockquote".split())

# Elements that are never part of an article, and words in class, id or role that say the same.
_BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog search button select fieldset input object applet canvas audio video head".split()) | _RAW
_BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist"
    " complementary contentinfo cookie cookies consent dialog disclaimer discussion disqus footer gdpr header login masthead menu"
    " menus modal nav navbar navigation newsletter notice notices notification overlay pager paginator pagination popup promo promoted"
    " promotion related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors"
    " subscribe subscription teaser toc toolbar topbar tracking warning widget widgets alert recommended recommendations".split()
)
_BOILERPLATE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "navig", "newsletter", "promo", "sidebar", "sponsor", "subscri")
# An article element with one of these is no article: a reader's comment, a teaser, an advert.
_NO_ARTICLE = frozenset("ad ads comment comments promo promoted recommended related replies reply sponsored teaser".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ABOUT = re.compile(r"(?:has|with|without|no|is)[-_]", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in _RAW}

Event = tuple[str, str, str]  # ("open", tag, attributes), ("close", tag, "") or ("text", "", raw text)


def _tag_end(html: str, at: int, plain: set[str]) -> int:
    """Where the ``>`` of a tag stands, outside quotes; -1 if there is none at all.

    A quote that is never closed is a sign like any other. If every ``>`` up to the end
    of the page lies in quotes, the first of them ends the tag, and quotes count no more
    (``plain``): so no part of a page is looked through again and again.
    """
    position = at
    while (stop := _STOP.search(html, position)) is not None:
        sign = stop[0]
        if sign == ">":
            return stop.start()
        position = stop.end()
        if sign not in plain:
            close = html.find(sign, position)
            if close < 0:
                plain.add(sign)
            else:
                position = close + 1
    plain.update("\"'")
    return html.find(">", at)


def events(html: str) -> Iterator[Event]:
    """Tags and texts of a page in order, without comments and the content of scripts and the like, in one pass forward."""
    position = cursor = 0  # texts begin at the position; tags are looked for from the cursor
    plain: set[str] = set()
    while (start := html.find("<", cursor)) >= 0:
        tag_match = None
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            end = close + 3 if close >= 0 else len(html)
        elif html.startswith(("<!", "<?"), start):
            end = html.find(">", start + 2) + 1
        else:
            tag_match = _TAG.match(html, start)
            if tag_match is None:
                cursor = start + 1
                continue
            end = _tag_end(html, tag_match.end(), plain) + 1
        if end == 0:  # no > is left, so no tag is
            break
        if start > position:
            yield "text", "", html[position:start]
        position = cursor = end
        if tag_match is None:
            continue
        tag, inner = tag_match[2].lower(), html[tag_match.end() : end - 1]
        if tag_match[1]:
            yield "close", tag, ""
        elif tag in _RAW:
            found = _RAW_END[tag].search(html, position)
            close = html.find(">", found.end()) if found else -1
            position = cursor = close + 1 if close >= 0 else len(html)
        else:
            yield "open", tag, inner
            if tag in _VOID or inner.endswith("/") and tag not in _BLOCK:
                yield "close", tag, ""
    if position < len(html):
        yield "text", "", html[position:]


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in raw or raw.strip():
        for name, double, single, bare in _ATTRIBUTE.findall(raw):
            found.setdefault(name.lower(), unescape(double or single or bare))
    return found


_NEVER, _BY_NAME, _SIDE = 1, 2, 3  # boilerplate whatever it holds; by its name, unless its content says otherwise; what is about an article


def _is_boilerplate(tag: str, attributes: dict[str, str]) -> int:
    """How an element is boilerplate, 0 if it is not."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return _NEVER if tag not in ("body", "html", "main") else 0
    if tag == "form":
        return _BY_NAME
    if tag in _BOILERPLATE_TAGS:
        return _NEVER
    if not attributes or tag in ("body", "html", "main"):
        return 0
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.IGNORECASE):
        return _NEVER
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemtype"))
    # "has-sidebar" or "no-comments" describe the element around such a part, not the part.
    words = [w.lower() for name in named.split() if not _ABOUT.match(name) for w in _WORD.findall(name)]
    if any(w in _NO_ARTICLE or tag != "article" and w.startswith("comment") for w in words):
        return _SIDE
    return _BY_NAME if tag != "article" and any(w in _BOILERPLATE_WORDS or w.startswith(_BOILERPLATE_STARTS) for w in words) else 0


class Flagged:
    """An element that is boilerplate by its name, and what it holds outside surer boilerplate."""

    __slots__ = ("number", "side", "length", "main", "article")

    def __init__(self, number: int, side: bool) -> None:
        self.number, self.side, self.length, self.main, self.article = number, side, 0, False, False


class Container:
    """A container element with the text blocks directly or deeper in it."""

    __slots__ = ("path", "parent", "score", "first")

    def __init__(self, path: str, parent: Container | None, first: int) -> None:
        self.path, self.parent, self.score, self.first = path, parent, 0.0, first


class Page:
    """Blocks of a page outside boilerplate, and its scored containers.

    An element that is boilerplate only by its name, as a form or a wrapper called
    "content-with-sidebar", counts as a part like any other (``spared``, by number) if
    it holds the main element, or if no article or main element stands outside such
    elements and it holds an article or most of the paragraphs' text outside links.
    """

    def __init__(self, html: str, spared: frozenset[int] = frozenset()) -> None:
        root = Container("", None, 0)
        self.blocks: list[tuple[str, Container]] = []
        self.containers: list[Container] = [root]
        self._text: list[str] = []
        self._linked = 0
        self._here = root
        stack: list[tuple[str, bool, Container | None]] = []  # tag, starts boilerplate, the container to go back to
        hidden = links = number = length = 0
        paragraph = article = False
        flagged: list[Flagged] = []
        inside: list[Flagged | None] = []  # of the open hidden elements; None for sure boilerplate

        def pop_to(depth: int) -> None:
            nonlocal hidden, links
            while len(stack) > depth:
                tag, bad, back = stack.pop()
                if tag in _BLOCK:
                    self._flush(paragraph)
                hidden -= bad
                if bad:
                    inside.pop()
                links -= tag == "a"
                if back is not None:
                    self._here = back

        def find(tags: tuple[str, ...], stops: frozenset[str] | tuple[str, ...]) -> int:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in tags:
                    return depth
                if stack[depth][0] in stops:
                    return -1
            return -1

        for kind, tag, raw in events(html):
            if kind == "text":
                if not hidden:
                    self._text.append(raw)
                    if links:
                        self._linked += len(raw)
                if not links and (paragraph or len(raw) >= 80) and None not in inside:
                    size = len(raw.strip())
                    length += size
                    for part in inside:
                        part.length += size
                continue
            if kind == "close":
                if tag == "br":
                    self._text.append(" ")
                elif tag not in _VOID:
                    depth = find((tag,), () if tag in _BLOCK and tag != "p" else _SCOPES)
                    if depth >= 0:
                        pop_to(depth)
                    elif tag in _BLOCK:
                        self._flush(paragraph)
                continue
            if tag in _VOID:
                if tag in _BLOCK:
                    self._flush(paragraph)
                continue
            if tag in _BLOCK:
                depth = find(("p",), _SCOPES)
                if depth >= 0:
                    pop_to(depth)
            if tag in _CLOSES:
                depth = find(*_CLOSES[tag])
                if depth >= 0:
                    pop_to(depth)
            if tag in _BLOCK:
                self._flush(paragraph)
                paragraph = tag in _PARAGRAPHS
            attributes = _attributes(raw) if raw else {}
            how = _is_boilerplate(tag, attributes)
            number += 1
            bad = bool(how) and number not in spared
            if bad:
                inside.append(None if how == _NEVER else Flagged(number, how == _SIDE))
                flagged += [inside[-1]] if how != _NEVER and None not in inside else []
            elif tag in ("article", "main") and not how and None not in inside:
                article = article or not inside
                for part in inside:
                    # Articles in what is about an article are comments and teasers.
                    if not any(p.side for p in inside):
                        part.main, part.article = part.main or tag == "main", part.article or tag == "article"
            back = None
            if tag in _CONTAINERS and not (bad or hidden):
                names = ".".join(sorted({_NUMBER.sub("#", c) for c in attributes.get("class", "").split()}))
                back, step = self._here, tag + ("." + names if names else "")
                self._here = Container(f"{back.path}>{step}", back, len(self.blocks))
                self.containers.append(self._here)
            stack.append((tag, bad, back))
            hidden += bad
            links += tag == "a"
        pop_to(0)
        self._flush(paragraph)
        spare = {f.number for f in flagged if f.length and (f.main or not article and (f.article or f.length > length * (0.9 if f.side else 0.5)))}
        if spare and not spared:
            self.__init__(html, frozenset(spare))

    def _flush(self, paragraph: bool) -> None:
        """End the open block: keep it, and credit its text outside links to the containers around it."""
        if not self._text:
            return
        text = " ".join(unescape("".join(self._text)).split())
        if text:
            self.blocks.append((text, self._here))
            gain = max(0, len(text) - 2 * self._linked) + (25 if paragraph else 0)
            node, share = self._here, 1.0
            while node is not None and share > 0.05:
                node.score += gain * share
                node, share = node.parent, share / 2
        self._text, self._linked = [], 0

    def best(self) -> Container:
        """The container with the highest score, the first one of equals; the page itself if there is none.

        An article or main element around it holds the whole text, and so does a parent
        with nearly the same score, whose text is then spread over several parts.
        """
        best = max(self.containers, key=lambda c: c.score)
        around = []
        node = best
        while node is not None:
            around.append(node)
            node = node.parent
        for tag in ("article", "main"):
            for node in reversed(around):
                if node.path.rpartition(">")[2].partition(".")[0] == tag:
                    return node
        while best.parent is not None and best.parent.path and best.parent.score >= WHOLE * best.score:
            best = best.parent
        return best

    def refused(self) -> set[str]:
        """Paths of containers that neither are in the best one nor hold it."""
        best = self.best()
        return {c.path for c in self.containers if c.score > 0 and not self._inside(c, best) and not self._inside(best, c)} - {best.path}

    def text(self, paths: list[str], refused: list[str] = ()) -> str:
        """Blocks below the containers with the first of the paths that fits, else below the page's best one, or the first path that gives any if the host refuses that."""
        best = self.best()
        own = [text for text, owner in self.blocks if self._inside(owner, best)]
        needed = FITS * sum(map(len, own))
        spare = None
        for path in paths:
            found = [text for text, owner in self.blocks if self._below(owner, path)]
            if found and path not in refused and sum(map(len, found)) >= needed:
                return "\n\n".join(found)
            spare = spare or found
        return "\n\n".join(spare if spare and best.path in refused else own)

    @staticmethod
    def _below(owner: Container | None, path: str) -> bool:
        return owner is not None and (owner.path == path or owner.path.startswith(path + ">"))

    @staticmethod
    def _inside(owner: Container | None, container: Container) -> bool:
        while owner is not None:
            if owner is container:
                return True
            owner = owner.parent
        return False


def host_of(url: str) -> Column:
    """The host of a URL in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """_host, its agreed paths by falling support and the paths it refuses, from pages (_host, _html).

    A path is refused if some page chose it, but more pages that have it chose another
    part; as many pages as an agreed path needs, at least.

    Tasks add up votes per batch before the shuffle and Spark combines them before and
    after it, so a host with a third of all pages is a few rows per task.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list[float]] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html) if html else None
                best = page.best() if page else None
                if best is not None and best.score > 0:
                    votes.setdefault((host, best.path), [0, 0])[0] += 1
                    for path in page.refused():
                        votes.setdefault((host, path), [0, 0])[1] += 1
            yield pa.RecordBatch.from_pydict(
                {"_host": pa.array([k[0] for k in votes], pa.string()), "path": pa.array([k[1] for k in votes], pa.string()), "votes": pa.array([v[0] for v in votes.values()], pa.float64()), "against": pa.array([v[1] for v in votes.values()], pa.float64())}
            )

    cast = pages.where("_host <> ''").mapInArrow(vote, "_host string, path string, votes double, against double")
    votes = written(cast.groupBy("_host", "path").agg(F.sum("votes").alias("votes"), F.sum("against").alias("against")).where("votes > 0"), "host-votes")
    totals = votes.groupBy("_host").agg(F.sum("votes").alias("total"))
    least = F.col("total") * MIN_SUPPORT
    agreed = F.col("votes") >= least
    against = (F.col("against") > F.col("votes")) & (F.col("against") >= least)
    kept = votes.join(totals, "_host").where(agreed | against)
    ranked = F.sort_array(F.collect_list(F.when(agreed, F.struct((-F.col("votes")).alias("order"), "path"))))
    paths = F.transform(ranked, lambda x: x["path"]).alias("_paths")
    return written(kept.groupBy("_host").agg(paths, F.collect_list(F.when(against, F.col("path"))).alias("_refused")), "host-paths")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page.

    A null or empty html and a page without article text give an empty text. A null
    or odd url gives no host, and such a page uses its own best container. Null and
    repeated ids are kept row by row; an empty table gives no rows. Other columns are
    not read.
    """
    rows = pages.select(
        F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), host_of(url_column).alias("_host"), F.col(html_column).cast("string").alias("_html")
    )
    agreed = host_paths(rows.select("_host", "_html"))
    joined = rows.join(F.broadcast(agreed) if fits_broadcast(agreed) else agreed, "_host", "left").select("_id", "_url", "_html", "_paths", "_refused")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html).text(paths or [], refused or []) if html else "" for html, paths, refused in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"]
            )

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _url {rows.schema['_url'].dataType.simpleString()}, text string, n_chars long"
    return joined.mapInArrow(work, schema).withColumnsRenamed({"_id": id_column, "_url": url_column})


@query("op2_host_path_text")
def op2_host_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
