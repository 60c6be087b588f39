"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read as a row of tokens: text nodes, whose words each score the weight of where they stand, and tags, which
score at most -0.05; tags inside the parts named below score just that. Where a word stands is its nearest enclosing part of a menu, header, footer, sidebar, form, or an element
whose class or id is a name for adverts, notices, comments and the like, alone or with words of layout (ad-slot); else its nearest block element. No such name makes a part of an element that
is the page, its article or main element, or that holds body, main or the page's first article; nor does one with any other word in it (share-price, related-work, no-sidebar), which may name what
an article is about. An article's own header element is a header: a title that stands in it is left out. One linear scan finds the contiguous
region of the highest sum; its blocks, without those that stand in such parts, are the text. A page without a region is read again with these
class and id names taken for nothing. Scripts, styles and other raw text are never words.

Weights are log odds of standing in the content, counted over about sample_pages pages (by hash of the html, whole): of these, pages with one article or
main element teach, whose content is taken as the label. Places that the sample hasn't count as a few words of content, or of none for the parts above.

Blocks are text between block elements; character references are decoded, white space becomes one space, ends are trimmed, and blocks are joined by an empty line.

A tag ends at the first > outside quotes; where quotes don't end, at the first >; a tag that never ends takes the rest of the page with it, as in browsers. Reading
takes time in proportion to the page.

Defined results: null or empty html, or none that scores over 0, has an empty text; repeated rows each get a row; an empty table gives
no rows; other columns stay as they are, and where one is called _text the new one gets underscores after that name: it is always the last.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, table, unused

#: A comment, a declaration, or a tag up to its name.
OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
QUOTE_OR_END = re.compile("[>\"']")
#: The values of class, id and role.
NAMES = re.compile(r"""(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*))""")
RAW = frozenset("script style noscript template svg math iframe object textarea select option canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
APART = frozenset("nav header footer aside form menu button label legend fieldset dialog title head".split())
#: Elements that hold a page or its content as a whole.
WHOLE = frozenset("html head body article main".split())
CUE = re.compile(r"(?i)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|social|comments?|respond|replies|sidebar|menu|nav\w*|navigation|breadcrumbs?|header|footer|related|pagination)")
#: Parts of a name that say nothing about what an element holds: a name of a cue and these only is a cue, one with any other part (share-price, related-work, no-sidebar) isn't.
NEUTRAL = re.compile(
    r"(?i)(?:\d+|area|article|articles|aside|bar|block|blocks|body|bottom|box|btn|button|buttons|center|col|column|container|content|desktop|entry|form|global|group|holder|icon|icons|inner|item|items|layout|left|link|links|list|main|mobile|module|new|outer|page|panel|placement|post|posts|primary|region|right|row|secondary|section|signup|site|slot|small|sticky|stories|story|thread|title|top|unit|user|view|widget|widgets|wide|wp|wrap|wrapper|zone|js|c|l|o|u)"
)
#: An element that ends when one of these begins.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Tags:
    """Ends of a page's tags."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at `at`, or -1."""
        k = at
        while self.quotes:
            m = QUOTE_OR_END.search(self.page, k)
            if m and m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end()) if m else -1
            if close < 0:
                # Quotes that don't end, once found, mean nothing in the rest of the page: so no place is looked at many times.
                self.quotes = False
            k = close + 1
        return self.page.find(">", at)


def cued(attributes: str) -> bool:
    """Whether a class, id or role is a cue: made of cue words and neutral ones only."""
    for a, b, c in NAMES.findall(attributes):
        for name in (a or b or c).split():
            parts = [p for p in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if p]
            cues = [bool(CUE.fullmatch(p)) for p in parts]
            if any(cues) and all(cue or NEUTRAL.fullmatch(p) for p, cue in zip(parts, cues, strict=True)):
                return True
    return False


def read(page: str, cues: bool = True) -> list[tuple[str, str, str]]:
    """(tag, name, place) for tags and (text, place, text) for text nodes, in order. Names of end tags begin with /. Without cues, class, id and role say nothing."""
    out, holders = _read(page, cues, frozenset())
    return _read(page, cues, frozenset(holders))[0] if holders else out


def _read(page: str, cues: bool, plain: frozenset[int]) -> tuple[list[tuple[str, str, str]], list[int]]:
    """read's tokens, and where the cue elements begin that hold the page's content. Those that begin at plain are no cue elements."""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str]] = [("", "body")]  # name, and the place that words in it have
    opened: dict[str, list[int]] = {}  # by name, the elements of stack
    blocks: list[int] = []  # the block elements of stack
    cues_open: list[tuple[int, int]] = []  # cue elements: their place in stack, and where they begin
    holders: list[int] = []
    articles = 0
    at, n, tags = 0, len(page), Tags(page)

    def close(k: int) -> None:
        for name, _ in reversed(stack[k:]):
            opened[name].pop()
        del stack[k:]
        for places in (blocks, cues_open):
            while places and (places[-1] if places is blocks else places[-1][0]) >= k:
                places.pop()

    def text(s: str) -> None:
        if s and not s.isspace():
            out.append(("text", stack[-1][1], s))

    while at < n:
        m = OPEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else n
            continue
        end = tags.end(m.end()) if m[2] else page.find(">", m.end())
        if end < 0:
            break
        at, attributes = end + 1, page[m.end() : end]
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            out.append(("tag", "/" + name, stack[-1][1]))
            if opened.get(name):
                close(opened[name][-1])
            continue
        out.append(("tag", name, stack[-1][1]))
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if blocks and name in ENDS.get(stack[blocks[-1]][0], ()):
            close(blocks[-1])
        place = stack[-1][1]
        articles += name == "article"
        if cues_open and place[0] == "!" and (name in ("body", "main") or name == "article" and articles == 1):
            holders += [begin for _, begin in cues_open]
            cues_open.clear()
        cue = cues and attributes and name not in WHOLE and name not in APART and m.start() not in plain and cued(attributes)
        if place[0] != "!":
            place = "!" + name if name in APART else "!cue" if cue else name if name in BLOCK else place
        if cue:
            cues_open.append((len(stack), m.start()))
        if name in BLOCK:
            blocks.append(len(stack))
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, place))
    return out, holders


def labelled(tokens: list[tuple[str, str, str]]) -> range | None:
    """The tokens inside the page's one article or main element."""
    for name in ("article", "main"):
        begins, ends = ([k for k, t in enumerate(tokens) if t[0] == "tag" and t[1] == x] for x in (name, "/" + name))
        if len(begins) == len(ends) == 1 and begins[0] < ends[0]:
            return range(begins[0] + 1, ends[0])
    return None


def counts(page: str) -> Counter:
    """Of a page with a label: words by place and tags by name, inside its content and outside: (what, inside, name) with their number."""
    tokens = read(page)
    inside, out = labelled(tokens), Counter()
    if inside is not None:
        for k, (kind, name, s) in enumerate(tokens):
            if kind == "text":
                out["word", k in inside, name] += len(s.split())
            elif s[0] != "!":
                out["tag", k in inside, name] += 1
    return out


def weights_of(total: Counter) -> tuple[dict[str, float], dict[str, float], float]:
    """Weights of words by place and of tags by name, and that of an unknown tag."""
    words, tags = ({inside: Counter({n: k for (w, i, n), k in total.items() if w == what and i == inside}) for inside in (False, True)} for what in ("word", "tag"))
    place = {p: float(np.clip(np.log((words[1][p] + (1 if p[0] == "!" else 5)) / (words[0][p] + (5 if p[0] == "!" else 1))), -0.5 if p[0] == "!" else -4, 4)) for p in {*words[0], *words[1]}}
    tag = {}
    for t in {*tags[0], *tags[1]} - {x for r in RAW for x in (r, "/" + r)}:
        tag[t] = float(np.clip(np.log((tags[1][t] + 0.5) / (tags[0][t] + 0.5)), -3, -0.05))
        if t.lstrip("/") in WHOLE and not tags[1][t]:
            tag[t] = -1e6  # a boundary that no number of words makes up for
    return place, tag, -0.3


def learn(pages: DataFrame, sample_pages: int) -> tuple[dict[str, float], dict[str, float], float]:
    """The weights, counted where the pages are; a row a name comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for h in batch.column("html"):
                total.update(counts(h.as_py()))
        what, inside, name = (pa.array([k[i] for k in total], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string())))
        yield pa.RecordBatch.from_arrays([what, inside, name, pa.array(list(total.values()), pa.int64())], names=["what", "inside", "name", "n"])

    sample = bounded_sample(pages.where(F.length("html") > 0).select("html"), sample_pages)
    sums = sample.mapInArrow(count, "what string, inside boolean, name string, n long").groupBy("what", "inside", "name").agg(F.sum("n").alias("n")).collect()
    return weights_of(Counter({(r["what"], r["inside"], r["name"]): r["n"] for r in sums}))


def weight_of(tag: dict[str, float], unknown: float, name: str, place: str) -> float:
    return -0.05 if place[0] == "!" or name.lstrip("/") in RAW else tag.get(name, unknown)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of the highest sum over 0, the first and shortest of equals; an empty one if there is none."""
    best, total, begin, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, found = total, (begin, k + 1)
    return found


def extract(page: str | None, weights: tuple[dict[str, float], dict[str, float], float]) -> str:
    if not page:
        return ""
    place, tag, unknown = weights
    for cues in (True, False):
        tokens = read(page, cues)
        scores = [
            len(s.split()) * place.get(name, -0.5 if name[0] == "!" else 0.7) if kind == "text" else weight_of(tag, unknown, name, s)
            for kind, name, s in tokens
        ]
        begin, end = best_region(scores)
        if end and any(kind == "text" and name[0] != "!" for kind, name, _ in tokens[begin:end]):
            break
    blocks, now = [], []
    for kind, name, s in tokens[begin:end]:
        if kind == "text":
            if name[0] != "!":
                now.append(s)
        elif name.lstrip("/") in BLOCK:
            blocks.append("".join(now))
            now = []
        elif name in VOID:
            now.append(" ")
    blocks.append("".join(now))
    blocks = [" ".join(references.unescape(b).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, sample_pages: int = 500) -> DataFrame:
    """pages with _text, the last column."""
    sent = pages.sparkSession.sparkContext.broadcast(learn(pages, sample_pages))
    name = unused(pages.columns, "_text")
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, pa.array([extract(h.as_py(), sent.value) for h in batch.column("html")], pa.string()))

    return pages.mapInArrow(extracted, schema)


def op9_html_text(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
