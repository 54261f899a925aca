"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of element nodes (a node is the
path of tags and classes from the root). Two things are counted per node:

* presentations: how the children of the node are laid out, per page. A node
  that looks the same on every page has entropy 0.
* contents: on how many pages each text under the node occurs. A text that is on
  one page only says something (1), one that is on all pages says nothing (0).

With ``m`` distinct pages of the host, ``l`` presentations of the node, and both
entropies to the base m, a node's importance is
``(1 - DECAY**l) * presentation + DECAY**l * content``. Branches below
``LEAST`` are removed from each page. What markup itself declares to be menu,
header, footer, sidebar, notice, advert, form or comments has importance 0, and
what it declares to be the article or the main part has importance 1, so that
hosts with few pages, or with many copies of one page, come out right too. Names and forms
that wrap the article or nearly the whole page declare nothing. If a
page declares a main part or an article, only that is taken, without the branches
inside it that are below ``LEAST``. Nothing is removed inside a declared part that is
itself below ``LEAST`` on its host, as the pages then are versions of one article.

With less than ``FEWEST_PAGES`` distinct pages only branches that are equal on all
of them are removed, and only if the declared part, or else the body, is not below
``LEAST``. One page alone is judged by its markup. A node is judged as a whole: a repeated paragraph
among other paragraphs with the same tags and classes stays.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one line feed.

Rows: a null or empty page has an empty text; broken markup is read on to its
end; a null address belongs to no host, and such pages are judged by their
markup alone; repeated rows give one result each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasador.plans.joins import checked_join
from tasador.plans.lineage import cut_lineage

DECAY = 0.9
LEAST = 0.25
FEWEST_PAGES = 5
EQUAL = 1e-9

DROPPED = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|textarea|button|title"
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("head nav footer aside menu dialog header".split())
CONTROL_TAGS = frozenset("form label legend fieldset".split())
WRAPPER_SHARE, DECLARED_SHARE = 0.8, 0.5
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
ENDS_BEFORE = {  # an open element on the left ends where one on the right begins, unless one of the third is between
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{DROPPED})\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NOISE_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?"
    r"|sidebar|side-?bar|footer|masthead|site-?header|page-?header|cookies?|consent|notices?|newsletter|subscribe"
    r"|popup|modal|overlay|share|sharing|social|related|recommend\w*|comments?|comment-?list|disqus|replies|reply"
    r"|responses?|ad-?box|gdpr|top-?bar|login|signup|search|pagination|pager|toolbar|widgets?|skip-?links?)(?:$|[-_\s])",
    re.I,
)
_STATE = re.compile(r"(?:has|no|not|with|without|is|hide|show)[-_]", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_DIGITS = re.compile(r"\d+")

PARSED = (
    "blocks array<struct<path:string,text:string>>, looks array<struct<path:string,look:string>>"
)


def _node(tag: str, attrs: str, kept: bool) -> tuple[str, str]:
    """A node's name in the tree and what its markup declares: noise, doubtful, main, article or nothing.

    Names and forms are doubtful: they are judged by what is below them. Words such as ``has-sidebar`` or
    ``no-comments`` tell the state of a part, not what it is.
    """
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)} if attrs else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    name = tag
    if names:
        name += "." + ".".join(sorted({_DIGITS.sub("", n).replace("/", "") for n in names.split()}))
    role = found.get("role", "").lower()
    if tag in ("html", "body"):
        return name, ""
    if attrs and _HIDDEN.search(attrs):
        return name, "noise"
    own = " ".join(n for n in names.split() if not _STATE.match(n))
    if own and tag not in ("h1", "main") and _NOISE_NAME.search(own):
        return name, "doubtful"
    if tag == "main" or role == "main":
        return name, "main"
    if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
        return name, "article"
    if role in NOISE_ROLES or tag in NOISE_TAGS and not (kept and tag == "header"):
        return name, "doubtful" if tag == "form" or role in ("form", "search") else "noise"
    return name, "doubtful" if tag in CONTROL_TAGS else ""


def _settled(blocks: list[dict], looks: dict[str, list[str]]) -> tuple[list[dict], dict[str, list[str]]]:
    """Doubtful nodes (``?``) become noise (``!``), unless they wrap what the page is about.

    A page with a main part or an article outside of them needs none of them. Elsewhere a
    doubtful node is a plain one if it holds a first heading or ``WRAPPER_SHARE`` of the page's text
    that is no noise; half of it is enough around a main part or an article.
    """
    paths = [b["path"] for b in blocks]
    noise = re.compile("/[!?]")
    while not any(re.search("/[=+]", p) and not noise.search(p) for p in paths):
        sizes: dict[str, int] = {}
        holds: dict[str, str] = {}
        total = 0
        for p, b in zip(paths, blocks):
            if "/!" in p:
                continue
            total += len(b["text"])
            if "/?" in p:
                end = p.find("/", p.index("/?") + 1)
                outer = p if end < 0 else p[:end]
                sizes[outer] = sizes.get(outer, 0) + len(b["text"])
                holds[outer] = holds.get(outer, "") + p[len(outer) :] + "/"
        enough = {p: DECLARED_SHARE if re.search("/[=+]", below) else WRAPPER_SHARE for p, below in holds.items()}
        freed = [p for p in sizes if re.search(r"/h1[./]", holds[p]) or sizes[p] >= enough[p] * total]
        if not freed:
            break
        for old in freed:
            new = old.replace("/?", "/")
            again = lambda p, old=old, new=new: new + p[len(old) :] if p == old or p.startswith(f"{old}/") else p
            paths = [again(p) for p in paths]
            looks = {again(p): names for p, names in looks.items()}
    blocks = [{**b, "path": p.replace("/?", "/!")} for b, p in zip(blocks, paths)]
    return blocks, {p.replace("/?", "/!"): names for p, names in looks.items()}


def parse(page: str | None) -> tuple[list[dict], list[dict]]:
    """Blocks of text with their paths in page order, and how each node lays out its children.

    In a path, a node whose markup declares noise begins with ``!``, the main
    part with ``=``, an article with ``+``.
    """
    blocks: list[dict] = []
    looks: dict[str, list[str]] = {}
    open_tags: list[str] = []
    paths: list[str] = []
    held: list[str] = []
    held_path = ""

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append({"path": held_path, "text": text})
            held = []

    def close(count: int) -> None:
        if held and ("/!" in held_path or any("/?" in p[p.rfind("/") :] for p in paths[len(paths) - count :])):
            flush()  # noise inside a line ends there
        del open_tags[len(open_tags) - count :], paths[len(paths) - count :]

    def close_until(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for back in range(len(open_tags)):
            tag = open_tags[-1 - back]
            if tag in tags:
                close(back + 1)
                return
            if tag in stops:
                return

    def say(raw: str) -> None:
        nonlocal held_path
        if raw:
            if not held:
                held_path = paths[-1] if paths else ""
            held.append(html.unescape(raw) if "&" in raw else raw)

    at = 0
    for m in _MARKUP.finditer(page or ""):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ") if held else None
            continue
        if tag in BLOCKS:
            flush()
        if m["end"]:
            if tag in open_tags:
                close(len(open_tags) - (len(open_tags) - 1 - open_tags[::-1].index(tag)))
            continue
        if tag in BLOCKS and tag not in ("html", "body"):
            close_until(("p",), ("article", "section", "div", "td", "li", "blockquote", "body", "main"))
            if tag in ENDS_BEFORE:
                close_until(*ENDS_BEFORE[tag])
        parent = paths[-1] if paths else ""
        name, kind = _node(tag, m["attrs"], "/=" in parent or "/+" in parent)
        if kind == "doubtful" and tag in ("label", "legend", "fieldset") and "form" not in open_tags:
            kind = ""  # controls stand in forms, words of a sentence do not
        if kind in ("noise", "doubtful"):
            flush()
        looks.setdefault(parent, []).append(name)
        if tag not in VOID and not m["attrs"].endswith("/"):
            open_tags.append(tag)
            paths.append(f"{parent}/{ {'noise': '!', 'doubtful': '?', 'main': '=', 'article': '+'}.get(kind, '') }{name}")
    if page and at < len(page):
        say(page[at:])
    flush()
    if any("/?" in path for path in looks) or any("/?" in b["path"] for b in blocks):
        blocks, looks = _settled(blocks, looks)
    laid = []
    for path, names in looks.items():
        runs = [n for i, n in enumerate(names) if not i or names[i - 1] != n]
        laid.append({"path": path, "look": " ".join(runs)})
    return blocks, laid


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks and looks of every page; ``mark`` tells pages of different content apart."""

    @F.pandas_udf(PARSED)
    def parsed(series: pd.Series) -> pd.DataFrame:
        rows = [parse(page) for page in series]
        return pd.DataFrame({"blocks": [r[0] for r in rows], "looks": [r[1] for r in rows]}, dtype=object)

    host = F.lower(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.when(host != "", host).alias("host"),
        parsed(F.col("html").cast("string")).alias("_parsed"),
    ).select("page_id", "url", "host", "_parsed.*")
    return rows.withColumn("mark", F.xxhash64("blocks"))


def node_importance(parsed: DataFrame, decay: float = DECAY, fewest: int = FEWEST_PAGES) -> DataFrame:
    """Importance of every node of every host with at least ``fewest`` distinct pages: host, path, m, importance.

    Copies of a page count once. Only counts meet: a text's pages, then sums per
    node, then sums over the nodes below it.
    """
    known = parsed.where(F.col("host").isNotNull())
    pages = known.select("host", "mark").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    pages = pages.where(F.col("m") >= fewest)

    def per_path(column: str, value: str) -> DataFrame:
        one = known.select("host", "mark", F.explode(column).alias("x"))
        seen = one.select("host", "mark", F.col("x.path").alias("path"), F.xxhash64(f"x.{value}").alias("v")).distinct()
        n = seen.groupBy("host", "path", "v").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("host", "path").agg(
            F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count(F.lit(1)).alias("l")
        )

    steps = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")
    )
    contents = (
        per_path("blocks", "text")
        .select("host", F.explode(above).alias("path"), "total", "nlogn")
        .groupBy("host", "path")
        .agg(F.sum("total").alias("c_total"), F.sum("nlogn").alias("c_nlogn"))
    )
    looks = per_path("looks", "look")
    log_m = F.log("m")
    content = 1 - F.col("c_nlogn") / (F.col("c_total") * log_m)
    look = F.coalesce((F.log("total") - F.col("nlogn") / F.col("total")) / log_m, F.lit(0.0))
    fade = F.pow(F.lit(decay), F.coalesce("l", F.lit(0)))
    return (
        contents.join(looks, ["host", "path"], "left")
        .join(pages, "host")
        .select("host", "path", "m", ((1 - fade) * look + fade * content).alias("importance"))
    )


def removed_paths(parsed: DataFrame, least: float = LEAST) -> DataFrame:
    """host and the paths that are removed there; declared parts themselves are never among them."""
    nodes = cut_lineage(node_importance(parsed, fewest=2), "nodes")
    path, few = F.col("path"), F.col("m") < FEWEST_PAGES
    declared, body = F.regexp_extract(path, "^(.*/[=+][^/]*)/", 1), F.regexp_extract(path, "^(.*?/body[^/]*)/.", 1)
    told = nodes.select("*", (declared != "").alias("inside"), F.when(declared != "", declared).otherwise(body).alias("root"))
    low = F.when(few, F.col("importance") < EQUAL).otherwise(F.col("importance") < least)
    told = told.where(low & ~path.contains("/!") & ~path.rlike("/[=+][^/]*$") & (F.col("root") != ""))
    roots = nodes.select("host", F.col("path").alias("root"), F.col("importance").alias("whole"))
    told = told.join(roots, ["host", "root"]).where(~(F.col("inside") | few) | (F.col("whole") >= least))
    return told.groupBy("host").agg(F.collect_list("path").alias("removed"))


def main_text(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = parse_pages(pages)
    # texts are parsed a second time below rather than written: only hashes of them are counted
    counted = F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("text")))
    seen = cut_lineage(parsed.select("host", "mark", counted.alias("blocks"), "looks"), "seen")
    rows = parsed.select("page_id", "url", "host", "blocks", "mark")
    rows = checked_join(rows, removed_paths(seen, least), ["host"], "left", salt=["page_id", "mark"])
    left = F.filter(
        "blocks",
        lambda b: ~b["path"].contains("/!")
        & ~F.coalesce(
            F.exists(
                "removed",
                # a declared part stays where what is around it goes
                lambda r: (b["path"] == r)
                | b["path"].startswith(F.concat(r, F.lit("/")))
                & ~F.substring(b["path"], F.length(r) + 1, F.length(b["path"])).rlike("/[=+]"),
            ),
            F.lit(False),
        ),
    )
    rows = rows.select("page_id", "url", left.alias("_left"))

    def inside(mark: str) -> Column:
        return F.filter("_left", lambda b: b["path"].contains(mark))

    main, article = inside("/="), inside("/+")
    chosen = F.when(F.size(main) > 0, main).when(F.size(article) > 0, article).otherwise(F.col("_left"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
