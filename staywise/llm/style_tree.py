"""Main text of web pages with the site style tree.

The pages of one host are merged into a tree of styles: an element is its tag and classes below its parent's style. A style's content
importance is high where its texts differ from page to page and falls to 0 where every page repeats them (entropy of each
text over the pages that have the style); its presentation importance is the entropy of its child sequences. A branch combines both, and
branches below ``LEAST_IMPORTANCE`` seen on at least ``LEAST_PAGES`` pages of the host are removed from each page. What HTML itself says is
used first: elements that are never article text (scripts, forms, navigation, ...) or are named as such by role, class or id go, and where
a page marks its article, only that is kept. The headline and paragraphs of a marked article are never taken by the tree, since hosts also publish one article twice.

Counting is a shuffle of (host, style, text hash) with map-side sums, so a host with a third of all pages is no hot key; only
removed branches go back to the pages. Null and empty pages, and pages without text, give an empty text. Broken markup is read like a
browser would, as far as it goes. Pages with the same id are kept apart. Other columns are dropped.
"""
import hashlib
import html
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from .tables import per_batch, same, small, stage

LEAST_PAGES = 5
LEAST_IMPORTANCE = 0.2
CHILD_WEIGHT = 0.9
#: Element names and the words of roles, classes and ids.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "template", "svg", "math"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub"
    " sup time tt u var wbr".split()
)
NEVER_TEXT = set(
    "head script style noscript noembed noframes template iframe object canvas svg math nav aside footer form button select option textarea"
    " input dialog menu audio video map datalist fieldset title".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " header masthead topbar footer bottom sidebar sidebars aside widget widgets related recommended recommendations share sharing social cookie"
    " cookies consent gdpr notice notices notification alert disclaimer newsletter subscribe subscription signup popup modal overlay comment comments"
    " disqus respond reply replies form login search pagination pager toolbar skip copyright".split()
)
CLOSED_BY = {
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
             " main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
    **{h: {"h1", "h2", "h3", "h4", "h5", "h6"} for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
SCOPES = {"table", "body", "html", "article", "main", "section", "div", "ul", "ol", "dl"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "article", "main"}
TAG = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HARD, SOFT = 2, 1


class Page:
    """The elements of a page in order (parent, tag, style, noise) and its text segments (element, block, text)."""

    def __init__(self, source):
        self.parents, self.tags, self.styles, self.noise, self.cores = [-1], ["#"], [""], [0], []
        self.segments = []
        self._read(source or "")
        self._decide()

    def _open(self, tag, attributes):
        parent = self.stack[-1]
        noise, style, core = (HARD if tag in NEVER_TEXT else 0), tag, tag in ("article", "main")
        inside = any(self.tags[e] in ("article", "main") for e in self.stack)
        if tag == "header" and not inside:
            noise = SOFT
        if attributes:
            words = set()
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    words |= {w.lower() for w in NAME_WORD.findall(value)}
                    if name == "class":
                        style += "." + ".".join(sorted(set(re.sub(r"\d+", "", value).split())))
                elif name == "role":
                    noise = max(noise, SOFT if value.lower() in NOISE_ROLES else 0)
                    core = core or value.lower() == "main"
                elif name == "itemprop":
                    core = core or value.lower() == "articlebody"
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    noise = HARD
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    noise = HARD
            found = words & NOISE_WORDS
            if found and tag not in ("html", "body", "main"):
                if core and not found & {"comment", "comments", "reply", "replies"}:
                    found = set()
                if found:
                    noise, core = max(noise, SOFT), False
        self.parents.append(parent)
        self.tags.append(tag)
        self.styles.append(f"{self.styles[parent]}/{style}")
        self.noise.append(noise)
        if core:
            self.cores.append(len(self.tags) - 1)
        return len(self.tags) - 1

    def _read(self, source):
        self.stack, block, at = [0], 0, 0
        for match in TAG.finditer(source):
            if match.start() < at:
                continue
            if match.start() > at:
                self.segments.append((self.stack[-1], block, source[at : match.start()]))
            at = match.end()
            closing, name, rest = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if not name:
                continue
            tag = name.lower()
            if tag not in INLINE:
                block += 1
            if closing:
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.tags[self.stack[k]] == tag:
                        del self.stack[k:]
                        break
                continue
            for k in range(len(self.stack) - 1, 0, -1):
                own = self.tags[self.stack[k]]
                if tag in CLOSED_BY.get(own, ()):
                    del self.stack[k:]
                    if own == tag or own == "p":
                        break
                elif own in SCOPES:
                    break
            element = self._open(tag, rest)
            if tag in VOID or rest.endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            self.stack.append(element)
        if at < len(source):
            self.segments.append((self.stack[-1], block, source[at:]))

    def _decide(self):
        """Which elements may be shown, before the style tree has its say."""
        noise, parents = self.noise, self.parents
        inside_noise = [False] * len(parents)
        for e in range(1, len(parents)):
            inside_noise[e] = inside_noise[parents[e]] or noise[e] == HARD or (noise[e] and self.tags[e] == "article")
        cores = [e for e in self.cores if not inside_noise[e]]
        for e in cores:
            e = parents[e]
            while e > 0:
                noise[e] = 0 if noise[e] == SOFT else noise[e]
                e = parents[e]
        articles = [e for e in cores if self.tags[e] == "article"] or cores
        core, inside = set(articles), [not articles] * len(parents)
        self.shown = [True] * len(parents)
        self.protected = [False] * len(parents)
        for e in range(1, len(parents)):
            p = parents[e]
            inside[e] = inside[p] or e in core
            self.shown[e] = self.shown[p] and not noise[e]
            self.protected[e] = bool(articles) and inside[e] and (self.tags[e] in TEXT_TAGS or self.protected[p] and self.tags[e] in INLINE)
        self.inside = inside

    def blocks(self, removed=()):
        """(element, text) of every block that is shown and lies in no removed branch."""
        gone = [False] * len(self.parents)
        if removed:
            for e in range(1, len(self.parents)):
                gone[e] = gone[self.parents[e]] or (self.styles[e] in removed and not self.protected[e])
        out, last, element, parts = [], None, 0, []
        for e, block, text in [*self.segments, (0, -1, "")]:
            if block != last:
                text_of = " ".join(html.unescape("".join(parts)).split())
                if text_of:
                    out.append((element, text_of))
                last, element, parts = block, e, []
            if block >= 0 and self.shown[e] and self.inside[e] and not gone[e]:
                if not parts:
                    element = e
                parts.append(text)
        return out

    def features(self):
        """{(style, kind, hash)}: kind 0 texts, 1 child sequences, 2 the style itself, of the elements that may be shown."""
        found = set()
        children = {}
        for e in range(1, len(self.parents)):
            if self.shown[e] and self.inside[e]:
                children.setdefault(self.parents[e], []).append(self.styles[e].rpartition("/")[2])
                found.add((self.styles[e], 2, 0))
        for e, names in children.items():
            found.add((self.styles[e], 1, zlib.crc32(" ".join(names).encode())))
        for e, text in self.blocks():
            digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
            found.add((self.styles[e], 0, int.from_bytes(digest, "little", signed=True)))
        return found


def style_counts(pages):
    """(host, style, kind, hash, n): on how many pages of the host a style, text or child sequence occurs."""

    def count(batch):
        totals = Counter()
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            totals.update((host, *f) for f in Page(source).features())
        keys = list(totals)
        columns = zip(*keys, strict=True) if keys else ((), (), (), ())
        yield dict(zip(("host", "style", "kind", "hash", "n"), [*map(list, columns), list(totals.values())], strict=True))

    local = per_batch(pages.select("host", "html"), count, "host string, style string, kind int, hash long, n long")
    return local.groupBy("host", "style", "kind", "hash").agg(F.sum("n").alias("n"))


def low_branches(counts, least_pages=LEAST_PAGES, least_importance=LEAST_IMPORTANCE):
    """(host, style) of the branches to remove. ``counts`` should be a stored table."""
    seen = counts.where("kind = 2").select("host", "style", F.col("n").alias("pages"))
    joined = counts.where("kind < 2").join(seen, ["host", "style"])
    share, base = F.col("n") / F.col("pages"), F.log(F.greatest("pages", F.lit(2)))
    texts = F.col("kind") == 0
    of_style = joined.groupBy("host", "style").agg(
        F.sum(F.when(texts, 1 - F.log(F.col("n").cast("double")) / base)).alias("content"),
        F.count(F.when(texts, 1)).alias("texts"),
        F.sum(F.when(~texts, -share * F.log(share) / base)).alias("presentation"),
    )
    steps = F.expr("transform(sequence(2, size(split(style, '/'))), i -> array_join(slice(split(style, '/'), 1, i), '/'))")
    up = of_style.where("texts > 0").select("host", F.explode(steps).alias("style"), "content", "texts")
    branch = up.groupBy("host", "style").agg((F.sum("content") / F.sum("texts")).alias("content"))
    own = of_style.select("host", "style", F.coalesce("presentation", F.lit(0.0)).alias("presentation"))
    rated = branch.join(own, ["host", "style"], "left").join(seen, ["host", "style"])
    importance = CHILD_WEIGHT * F.col("content") + (1 - CHILD_WEIGHT) * F.coalesce("presentation", F.lit(0.0))
    return rated.where((F.col("pages") >= least_pages) & (importance < least_importance)).select("host", "style")


def main_text(pages, least_pages=LEAST_PAGES, least_importance=LEAST_IMPORTANCE):
    """(page_id, url, text, n_chars) of every page."""
    hosted = pages.select("page_id", "url", "html", F.coalesce(F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1), F.lit("")).alias("host"))
    counts = stage(style_counts(hosted), "style-counts")
    low = stage(low_branches(counts, least_pages, least_importance).groupBy("host").agg(F.collect_set("style").alias("removed")), "branches")
    listed = small(low.select("host", F.array_join("removed", "\n").alias("removed")), ["removed"])
    joined = hosted.join(listed, same(hosted["host"], listed["host"]), "left").select("page_id", "url", "html", "removed")

    def extract(batch):
        out = {"page_id": batch.column(0).to_pylist(), "url": batch.column(1).to_pylist(), "text": [], "n_chars": []}
        for source, removed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = Page(source)
            blocks = page.blocks(set(removed.split("\n")) if removed else ()) or page.blocks()
            text = " ".join(text for _, text in blocks)
            out["text"].append(text)
            out["n_chars"].append(len(text))
        yield out

    return per_batch(joined, extract, "page_id long, url string, text string, n_chars long")
