"""Main text of web pages by consensus of their hosts.

In a first pass each page's containers are scored and the page votes for the generalised tag-and-class paths of its
best ones. Votes are added up for each host, and each host keeps its best paths. In a second pass the pages are read
again and their text is taken from the containers at the host's winning paths. Pages aren't shuffled where
the winning paths fit in every task's memory, which is checked; else only pages of small hosts are.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Paths that a host keeps, in the order of their votes.
PATHS = 8
#: Winning paths of up to so many bytes go to every task.
BROADCAST = 64 << 20
#: Hosts with more than one page in so many are told to every task: there are so many of them at most.
HOT = 1000
#: Votes of a page for its best container; the next two with half of its score or more get half of these by their share.
VOTE = 1000

# How pages are written: names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label button select svg math img input canvas audio video object map picture embed".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
#: What an opening tag closes before it, and the elements beyond which it doesn't look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "body": (("head",), ()),
}
EDGES = frozenset("table td th caption object template html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre li dt dd td th tr tbody thead tfoot table blockquote figcaption figure ul ol dl caption summary address html body".split()) | HEADINGS | INLINE
#: Comments, elements of raw text, tags, other declarations, and what is left open at the end.
TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?--!?>|.*)|<(?:{RAW})(?=[\s/>])(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+>.*?(?:</(?:{RAW})(?=[\s/>])[^>]*+>|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*+)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>|<(?:[!?]|/(?![a-z]))[^>]*+>|<[a-z/!?].*""", re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# What isn't main text: elements, roles, and words in classes and ids.
LEFT_OUT = frozenset("head nav footer aside noscript template svg canvas audio video object embed map form button select input label fieldset dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot sponsor sponsored promo promos promoted promotion banner banners "
    "nav navbar navigation sidenav menu menus submenu breadcrumb breadcrumbs pagination pager footer copyright masthead topbar toolbar sidebar sidebars aside rail "
    "cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts popup modal overlay lightbox newsletter subscribe subscription signup login "
    "comment comments commentlist commenter disqus respond responses replies discussion feedback share sharing social related recommended recommendations trending popular skiplink form search searchform".split()
)
#: Whole classes and ids that tell the same, where their words alone don't; those of headers.
WHOLE, HEADERS = frozenset("widget widgets skip".split()), frozenset("header site-header page-header".split())
#: Words of classes that tell a page's state and not what an element is.
STATES = frozenset("no not has with without open closed free enabled disabled hide hidden count allowed js layout".split())
MAIN = frozenset("article content entry post story main".split())
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


def named_out(names: list[str]) -> bool:
    """Whether a class or id says that its element isn't main text; names that tell a page's state don't."""
    for name in names:
        parts = {p.lower() for p in WORD_PARTS.findall(name)}
        if (parts & NOT_MAIN and not parts & STATES) or name.lower() in WHOLE:
            return True
    return False


class Page:
    """A page as its containers and its blocks of text, in page order; what isn't main text is left out.

    Containers have a parent, a label and a prior; a block is (container, heading, text, characters outside of links).
    Inline elements don't break blocks. A heading in a header is kept where an article or main element is around it.
    """

    def __init__(self, source: str, forms: bool = False):
        self.parents, self.labels, self.priors = [-1], ["body"], [0.5]
        self.blocks: list[tuple[int, bool, str, int]] = []
        self.forms = forms
        # an open element: name, container, left out (2, or 1 where headings stay), in a heading, in a link, in an article
        self.stack: list[tuple[str, int, int, bool, bool, bool]] = [("html", 0, 0, False, False, False)]
        self.open: dict[str, list[int]] = defaultdict(list, html=[0])
        self.blocky, self.edges = [0], [0]
        self.pieces: list[str] = []
        self.outside = at = 0
        for found in TOKEN.finditer(source):
            begin = found.start()
            if begin > at:
                self.text(source[at:begin])
            at = found.end()
            close, name, attributes = found.groups()
            if name:
                name = name.lower()
                if close:
                    self.close(name)
                else:
                    self.start(name, attributes)
        self.text(source[at:])
        self.flush()

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not top[2] or (top[2] == 1 and top[3]):
            self.pieces.append(raw)
            if not top[4] and not top[2]:
                self.outside += len(raw) - raw.count(" ")

    def flush(self) -> None:
        if self.pieces:
            text = "".join(self.pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                top = self.stack[-1]
                self.blocks.append((top[1], top[3], text, min(self.outside, len(text))))
            self.pieces, self.outside = [], 0

    def pop_to(self, at: int) -> None:
        """Close the open elements from place at on."""
        stack, blocky, edges = self.stack, self.blocky, self.edges
        if blocky[-1] >= at:
            self.flush()
            while blocky[-1] >= at:
                blocky.pop()
            while edges[-1] >= at:
                edges.pop()
        while len(stack) > at:
            self.open[stack.pop()[0]].pop()

    def close(self, name: str) -> None:
        places = self.open.get(name)
        if not places:
            if name in ("br", "p"):
                self.flush()
            return
        at = places[-1]
        edge = self.blocky[-1] if name in INLINE and name not in LEFT_OUT else self.edges[-1]
        if at and (at > edge or (at == edge and name in EDGES) or name in ("table", "body")):
            self.pop_to(at)

    def start(self, name: str, attributes: str) -> None:
        inline = name in INLINE
        if not inline:
            if name in CLOSES_P:
                places = self.open.get("p")
                if places and places[-1] > self.edges[-1]:
                    self.pop_to(places[-1])
            if name in CLOSES:
                closed, beyond = CLOSES[name]
                limit = max((self.open[n][-1] for n in beyond if self.open.get(n)), default=-1)
                at = min((self.open[n][-1] for n in closed if self.open.get(n) and self.open[n][-1] > limit), default=0)
                if at:
                    self.pop_to(at)
            elif name in HEADINGS and self.stack[-1][0] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
            self.flush()
        if name in VOID:
            return
        _, container, out, heading, link, inside = self.stack[-1]
        if out == 2:
            if attributes.endswith("/") and (self.open.get("svg") or self.open.get("math")):
                return
        else:
            names, role, gone, said = self.told(attributes) if attributes and not attributes.isspace() else ([], "", False, "")
            if name in LEFT_OUT or gone or role in ROLES or (names and named_out(names)):
                if name not in ("html", "body", "main") and not (self.forms and name == "form"):
                    out = 2
            elif name == "header" or (names and name not in HEADINGS and any(n.lower() in HEADERS for n in names)):
                out = max(out, 1 if inside else 2)
            if out == 0 and name not in PARAGRAPHS:
                parts = {p.lower() for n in names for p in WORD_PARTS.findall(n)}
                prior = 2.0 if name in ("article", "main") or role in ("main", "article") else 1.5 if parts & MAIN else 1.0
                self.parents.append(container)
                self.labels.append(name + said)
                self.priors.append(prior)
                container = len(self.parents) - 1
                inside = inside or prior == 2.0
        place = len(self.stack)
        self.stack.append((name, container, out, heading or name in HEADINGS, link or name == "a", inside))
        self.open[name].append(place)
        if not inline:
            self.blocky.append(place)
            if name in EDGES:
                self.edges.append(place)

    def told(self, attributes: str) -> tuple[list[str], str, bool, str]:
        """Of an element's attributes: classes and ids, its role, whether it is hidden, and its generalised classes as a label."""
        names, role, gone, said = [], "", False, ""
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "class":
                names += value.split()
                said = "".join("." + DIGITS.sub("0", v) for v in value.replace("/", " ").split())
            elif key == "id":
                names += value.split()
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                gone = True
            elif key == "itemprop" and value == "articleBody":
                role = role or "main"
        return names, role, gone, said

    def scores(self) -> tuple[list[float], list[int]]:
        """Of each container: what its blocks are worth times its prior, and the number of its headings.

        A block is worth its characters outside of links less twice those inside.
        """
        worth, heads = [0.0] * len(self.parents), [0] * len(self.parents)
        for container, heading, text, outside in self.blocks:
            worth[container] += outside - 2 * max(0, len(text) - text.count(" ") - outside)
            heads[container] += heading
        for k in range(len(worth) - 1, 0, -1):
            worth[self.parents[k]] += worth[k]
            heads[self.parents[k]] += heads[k]
        return [w * p for w, p in zip(worth, self.priors)], heads

    def path(self, k: int) -> str:
        labels = []
        while k > 0:
            labels.append(self.labels[k])
            k = self.parents[k]
        return "/".join(labels[::-1])

    def best(self, scores: list[float], heads: list[int]) -> int:
        """The container with the highest score, or the innermost one in it with nine tenths of it and the same headings; the
        body where none is worth anything."""
        top = max(range(len(scores)), key=lambda k: (scores[k], k))
        if scores[top] <= 0:
            return 0
        raw = lambda k: scores[k] / self.priors[k]
        for k in range(top + 1, len(scores)):  # in page order, so a child comes after its parent
            if self.parents[k] == top and raw(k) >= 0.9 * raw(top) > 0 and heads[k] == heads[top]:
                top = k
        return top

    def taken(self, chosen: set[int]) -> str:
        """The text of the blocks in the containers chosen, in page order."""
        inside = [False] * len(self.parents)
        for k, parent in enumerate(self.parents):
            inside[k] = k in chosen or (k > 0 and inside[parent])
        return " ".join(text for container, _, text, _ in self.blocks if inside[container])


def parsed(source: str) -> Page:
    """The page; where nothing is left because a form holds all of it, with forms read like other elements."""
    page = Page(source)
    return page if page.blocks or "<form" not in source.lower() else Page(source, forms=True)


def votes_of(source: str) -> list[tuple[str, int]]:
    """The paths that a page votes for, and its votes for each."""
    page = parsed(source)
    scores, heads = page.scores()
    best = page.best(scores, heads)
    if scores[best] <= 0:
        return []
    share = {page.path(best): VOTE}
    for k in sorted((k for k in range(len(scores)) if 2 * scores[k] >= scores[best] and k != best), key=lambda k: (-scores[k], k))[:2]:
        share.setdefault(page.path(k), int(VOTE / 2 * min(1.0, scores[k] / scores[best])))
    return list(share.items())


def extract(source: str, winners: list[str]) -> str:
    """The text at the first winning path whose containers are worth a quarter of the page's own best one or more; else at its own best."""
    page = parsed(source)
    if not page.blocks:
        return ""
    scores, heads = page.scores()
    best = page.best(scores, heads)
    steps: dict[tuple[int, str], int] = {}  # winning paths as steps from path to longer path, so each container takes one look
    number = itertools.count(1)
    ends = {}
    for path in winners:
        at = 0
        for label in path.split("/") if path else ():
            if (at, label) not in steps:
                steps[at, label] = next(number)
            at = steps[at, label]
        ends.setdefault(at, path)
    reached = [0] * len(page.parents)
    matched: dict[str, set[int]] = {}
    for k, parent in enumerate(page.parents):
        reached[k] = (steps.get((reached[parent], page.labels[k]), -1) if reached[parent] >= 0 else -1) if k else 0
        if reached[k] in ends:
            matched.setdefault(ends[reached[k]], set()).add(k)
    raw = lambda k: scores[k] / page.priors[k]
    for path in winners:
        if path in matched and (4 * sum(map(raw, matched[path])) >= raw(best) > 0 or (scores[best] <= 0 and page.taken(matched[path]))):
            return page.taken(matched[path])
    return page.taken({best})


def host_of(url: str = "url"):
    """The host of a URL in small letters, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", paths: int = PATHS) -> DataFrame:
    """(host, n_pages, paths): each host's paths by votes, the best first, `paths` of them; ties go by the path.

    Votes are added up in each task first, and each task passes on its best paths of a host only, so a host with much of
    all pages is no single task's.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, path, votes) for host, source in zip(batch.column(0).to_pylist(), batch.column(1)) for path, votes in votes_of(source.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "path", "votes"])

    cast = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    voted = cast.mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    kept = voted.withColumn("rank", rank).where(F.col("rank") <= paths)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"])
    return kept.groupBy("host").agg(F.max("n").alias("n_pages"), ordered.alias("paths"))


def with_paths(pages: DataFrame, winners: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """pages(host, ...) with the `paths` of their hosts, null for hosts without."""
    size, voters = winners.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "/")) + 100), F.sum("n_pages")).first()
    told = winners.select("host", "paths")
    if (size or 0) <= broadcast:
        return pages.join(F.broadcast(told), "host", "left")
    hot = F.col("n_pages") > voters / HOT
    large = pages.join(F.broadcast(winners.where(hot).select("host", "paths")), "host", "left")
    # pages of hosts that every task knows are dealt by salts, which match nothing, so that no host is one task's
    key = F.when(F.col("paths").isNull(), F.concat(F.lit("="), "host")).otherwise(F.concat(F.lit("#"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")))
    rest = winners.where(~hot).select(F.concat(F.lit("="), "host").alias("_key"), F.col("paths").alias("_paths"))
    joined = large.withColumn("_key", key).join(rest, "_key", "left")
    return joined.select(*pages.columns, F.coalesce("paths", "_paths").alias("paths"))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text) of every page: the main text from the whole html, found where the host's pages agree that it is.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and comments by their
    elements, roles, classes and ids; headings in an article's header stay. Character references are decoded, white
    space in a block (a no-break space too) becomes one space, blocks are joined by one space. A null or empty html, and
    one without main text, gives an empty text. Pages without a host vote together. Null and repeated ids and
    repeated pages stay rows of their own; no pages give none; further columns are ignored, whatever their names.
    A task holds one batch of pages, and of a very long page about ten times its length.
    """
    spark = pages.sparkSession
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    winners = written(host_paths(picked), "host-paths")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(source.as_py() or "", paths or []) for source, paths in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    told = with_paths(picked.withColumn("host", host_of()), winners, broadcast)
    return told.select("page_id", "url", "html", "paths").mapInArrow(work, "page_id long, url string, text string")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length in code points."""
    return extract_main(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: Expected rows of the given pages: their main text is what their one article element holds, by the names of their tags.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br|div|li|ul)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&nbsp;', ' ') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
