"""Main text of web pages by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import once_each, with_package

MOST_PAGES = 2000  # labelled pages that the weights are taken from, at most
NEVER = -4.0  # elements with a weight from here down never stand in the main text

# Kinds of HTML elements.
RAW = "script|style|iframe|textarea"  # what follows is no markup up to the closing tag
UNSEEN = frozenset("audio button canvas head noscript object select svg template title video".split())
HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("aside dialog footer form menu nav".split())
WRAPPERS = frozenset("dialog form header".split())  # go by kind too, but some pages stand in one as a whole
HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead "
    "menu nav navbar navigation newsletter notice notices pagination popup promo related replies reply share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
# Elements that names say something about; ids of headings, paragraphs and sections are often made of their own words.
CONTAINERS = frozenset("a article center dd details div dl figure header li ol section span table tbody td tr ul".split())
ADVERTS = frozenset("ad ads advert adverts advertisement promo sponsor sponsored".split())
READERS = frozenset("comment comments disqus replies reply".split())
# Paragraphs with a class of these words alone go; of articles, of tables in the main text and of words in a sentence
# no other names say anything.
SURE = ADVERTS | READERS
TABLES = frozenset("center dd details dl figure table tbody td tr".split())
SENTENCES = frozenset("blockquote figcaption h1 h2 h3 h4 h5 h6 p".split())
# Words beside a hint in the id of a part of a page.
PARTS = frozenset(
    "area bar block bottom box button buttons container content field form item items left link links list main nav page panel post posts primary "
    "right secondary section site tags thread top wrap wrapper".split()
)
CONTENT = frozenset("article main".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Item:
    """A run of text or a tag, where it stands: a tag's name and its keys, a run's text and number of words."""

    tag: str = ""
    closing: bool = False
    keys: tuple[str, ...] = ()
    text: str = ""
    words: int = 0
    linked: bool = False
    dropped: bool = False
    content: bool = False
    unseen: bool = False  # in an element that shows no text, which gives no weights
    formula: bool = False
    element: int = -1  # the innermost element it lies in, by the place of that element's tag in the page's items
    parent: int = -1  # of a tag that begins an element: the element around it
    end: int = -1  # of such a tag: where the element ends


@dataclass
class Weights:
    word: float = 0.5
    linked: float = 0.05
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, item: Item) -> float:
        if item.dropped or item.unseen or item.formula:
            return 0.0
        if not item.tag:
            return item.words * (self.linked if item.linked else self.word)
        known = [self.tags[k] for k in item.keys if k in self.tags]
        return min(known) if known else -1.0

    def never(self, keys: tuple[str, ...]) -> bool:
        return any(self.tags.get(k, 0.0) <= NEVER for k in keys[1:])


def _hinted(names: list[str], ids: set[str], inside: bool, hints: frozenset[str] = HINTS) -> bool:
    """Whether a name says what the element is; names such as has-sidebar say what stands beside it, and ids
    with other words than hints, numbers and parts of a page, such as related-work, what the text is about."""
    for name in names:
        parts = {p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name)}
        if name in ids and any(p and not p.isdigit() for p in parts - HINTS - PARTS):
            continue
        if parts & hints and not parts & {"has", "no", "with", "without"} and not (inside and parts & HINTS == {"header"}):
            return True
    return False


def items(page: str, weights: Weights | None = None) -> list[Item]:
    """The page as runs and tags. Unclosed elements end with their parent; p and li also with the next of their kind.

    ``dropped`` marks what stands in an element that is no main text by its kind, by its class, id or role, or
    by the weights; ``content`` what stands in an article or main element. A head ends before the first thing that
    cannot stand in it; of the other UNSEEN elements those without a closing tag hold nothing. Neither names nor the
    kinds of WRAPPERS tell anything of an element that holds most of the page's words outside links.
    """
    plain: frozenset[int] = frozenset()
    out, unclosed, most = _walk(page, weights, frozenset(), plain)
    if unclosed:
        out, _, most = _walk(page, weights, unclosed, plain)
    while most - plain:  # what a wrapper holds is looked at once it is plain
        plain |= most
        out, _, most = _walk(page, weights, unclosed, plain)
    return out


def _walk(page: str, weights: Weights | None, empty: frozenset[int], plain: frozenset[int]) -> tuple[list[Item], frozenset[int], frozenset[int]]:
    """The items if the elements at the places ``empty`` hold nothing and the names of those at ``plain`` tell nothing;
    the places of UNSEEN elements that nothing closed, and of elements that go by name and hold most words."""
    out: list[Item] = []
    # Name; whether in dropped, content, link, unseen; where it began.
    stack: list[tuple[str, bool, bool, bool, bool, int]] = [("", False, False, False, False, -1)]
    unclosed: set[int] = set()
    by_name: dict[int, list[int]] = {}  # where elements that go by name began; how many words came before it and before its end
    wrapping: dict[int, list[int]] = {}  # the same for WRAPPERS
    seen, kinds = 0, 0  # words so far outside links and elements that go by kind; open elements that go by kind
    everything = 0  # words so far outside links, whatever they stand in
    tags: list[int] = [-1]  # for each open element the place of its tag in the items
    opened: Counter = Counter()
    place = 0

    def run(text: str) -> None:
        nonlocal seen, everything
        if text:
            text = html.unescape(text)
            if stack[-1][0] == "head" and text.strip():
                close("head")
            _, dropped, content, linked, unseen, _ = stack[-1]
            out.append(Item(text=text, words=len(text.split()), linked=linked, dropped=dropped, content=content, unseen=unseen, element=tags[-1]))
            if not (linked or kinds):
                seen += out[-1].words
            if not (linked or unseen):
                everything += out[-1].words

    def close(name: str, barrier: frozenset[str] = frozenset()) -> bool | None:
        """Ends the innermost element of the name; whether it was dropped."""
        nonlocal kinds
        if not opened[name]:
            return None
        k = len(stack) - 1
        while stack[k][0] != name:
            if stack[k][0] in barrier:
                return None
            k -= 1
        for closed in stack[k:]:
            opened[closed[0]] -= 1
            kinds -= closed[0] in OUTSIDE and closed[5] not in plain or closed[0] in UNSEEN
            if closed[5] in by_name:
                by_name[closed[5]][1] = seen
            if closed[5] in wrapping:
                wrapping[closed[5]][1] = everything
        for at in tags[k:]:
            out[at].end = len(out)
        del tags[k:]
        unclosed.update(closed[5] for closed in stack[k + 1 :] if closed[0] in UNSEEN - {"head", "title"})
        gone = stack[k][1]
        del stack[k:]
        return gone

    for m in _TOKEN.finditer(page):
        run(page[place : m.start()])
        place = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing = bool(m[2] or m[5])
        attributes = [*_NAMES.finditer(m[4] or m[7] or "")]
        ids = {n for a in attributes if a[1].lower() == "id" for n in (a[2] or a[3] or a[4] or "").split()}
        names = [n for a in attributes for n in (a[2] or a[3] or a[4] or "").split()]
        keys = (name, *(f"{name}.{n.lower()}" for n in names))
        alone = name in VOID or m.start() in empty
        if (m[4] or m[7] or "").endswith("/") and (name in UNSEEN - {"head", "title"} or name == "math" or opened["svg"] or opened["math"]):
            alone = True
        if not closing and stack[-1][0] in ("head", "title") and (name == "body" or name not in HEAD_PARTS and name != "head"):
            for ended in ("head", "title"):
                if name == "body" or name in BLOCKS or stack[-1][0] == "head":
                    close(ended)
        formula = bool(opened["math"]) or name == "math"
        gone = False
        if closing:
            gone = bool(close(name))
        elif name == "p" or name in BLOCKS and stack and stack[-1][0] == "p":
            close("p", frozenset({"div", "article", "section", "td", "li", "blockquote"}))
        elif name == "li":
            close("li", frozenset({"ul", "ol", "menu"}))
        _, dropped, inside, linked, unseen, _ = stack[-1]
        if not closing and not alone:
            off = m.start() not in plain and (name in OUTSIDE or (name == "header" and not inside)) or bool(weights and weights.never(keys))
            if name in WRAPPERS:
                wrapping[m.start()] = [everything, -1]
            if names and m.start() not in plain:
                in_sentence = name in ("a", "span") and any(opened[n] for n in SENTENCES)
                hints = SURE if name == "article" or inside and name in TABLES else ADVERTS if in_sentence else HINTS
                if name in CONTAINERS and _hinted(names, ids, inside, hints) or name == "p" and any(n not in ids and set(re.split("[-_]", n.lower())) <= SURE for n in names):
                    off = True
                    by_name[m.start()] = [seen, -1]
            off = off or name in UNSEEN
            stack.append((name, dropped or off, inside or name in CONTENT, linked or name == "a", unseen or name in UNSEEN, m.start()))
            opened[name] += 1
            kinds += name in OUTSIDE and m.start() not in plain or name in UNSEEN
        item = Item(tag=name, closing=closing, keys=keys, content=inside or stack[-1][2], dropped=gone or stack[-1][1], unseen=unseen or name in UNSEEN, formula=formula)
        item.element = tags[-1]
        if not closing and not alone:
            item.parent, item.element = tags[-1], len(out)
            tags.append(len(out))
        out.append(item)
    run(page[place:])
    unclosed.update(left[5] for left in stack if left[0] in UNSEEN - {"head", "title"})
    for at in tags[1:]:
        out[at].end = len(out)
    most = {at for at, (low, high) in by_name.items() if 2 * ((seen if high < 0 else high) - low) > seen}
    most |= {at for at, (low, high) in wrapping.items() if 2 * ((everything if high < 0 else high) - low) > everything}
    return out, frozenset(unclosed), frozenset(most)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last (exclusive) of the contiguous part with the largest sum, the first such; empty if none is above 0."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def grown(found: list[Item], low: int, high: int) -> tuple[int, int]:
    """The run, grown to the element around it where that is main text too.

    Tags cost more than a few words give, so short parts at the ends of an article fall out of the best run. The
    article or main element around the run is taken whole if half of its words lie in the run. Elsewhere the
    run grows from element to element around it, as long as an element has a third more words at most and
    fewer than half of the new ones in links.
    """
    words = [0] * (len(found) + 1)
    linked = [0] * (len(found) + 1)
    for k, item in enumerate(found):
        n = 0 if item.dropped or item.unseen else item.words
        words[k + 1], linked[k + 1] = words[k] + n, linked[k] + (n if item.linked else 0)
    in_run = [k for k in range(low, high) if found[k].words and not found[k].dropped]
    if not in_run:
        return low, high

    def around(at: int) -> list[int]:
        out = []
        while at >= 0:
            out.append(at)
            at = found[at].parent
        return out

    ends = set(around(found[in_run[-1]].element))
    both = [e for e in around(found[in_run[0]].element) if e in ends]  # from the inside out
    for k, e in enumerate(both):
        if found[e].tag in CONTENT:
            if 2 * (words[high] - words[low]) >= words[found[e].end] - words[e]:
                return min(low, e), max(high, found[e].end)
            both = both[:k]
            break
    for e in both:
        end = found[e].end
        more = words[end] - words[e] - (words[high] - words[low])
        in_links = linked[end] - linked[e] - (linked[high] - linked[low])
        if found[e].tag in ("body", "html") or 3 * more > words[high] - words[low] or 2 * in_links >= max(1, more) and more > 0:
            break
        low, high = min(low, e), max(high, end)
    return low, high


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of a page: blocks in page order with an empty line between, white space in them as one blank."""
    found = items(page or "", weights)
    low, high = grown(found, *best_run([weights.of(i) for i in found]))
    blocks: list[list[str]] = [[]]
    for item in found[low:high]:
        if item.tag in BLOCKS:
            blocks.append([])
        elif item.tag == "br":
            blocks[-1].append(" ")
        elif not item.tag and not item.dropped:
            blocks[-1].append(item.text)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def counted(page: str | None) -> Counter:
    """For a labelled page, one with a single article or main element, how often each key stands in and outside it."""
    found = items(page or "")
    out: Counter = Counter()
    if sum(i.tag in CONTENT and not i.closing for i in found) != 1:
        return out
    for i in found:
        if i.unseen or i.formula:
            continue
        if i.tag:
            for k in i.keys:
                out[k, i.content] += 1
        elif not i.dropped and i.words:
            out["#linked" if i.linked else "#word", i.content] += i.words
    return out


def learn(pages: DataFrame, most_pages: int = MOST_PAGES) -> Weights:
    """Weights from labelled pages among ``most_pages`` pages (the first by a hash of their html, copies of a page
    are one): the log-odds of each key in the main text and outside, words above zero, tags below. Without labelled
    pages, words outweigh tags by fixed values."""
    with_package(pages.sparkSession)
    first = pages.select(F.xxhash64("html").alias("h")).where("h is not null").distinct().orderBy("h").limit(most_pages)
    sample = pages.select(F.xxhash64("html").alias("h"), F.col("html").cast("string")).join(F.broadcast(first), "h")  # bounded
    sample = once_each(sample, "h").select("html")

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(counted(page))
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
                names=["key", "inside", "n"],
            )

    counts: dict[str, list[int]] = {}
    for r in sample.mapInArrow(of_batches, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.key, [0, 0])[r.inside] = r.n
    weights = Weights()
    total = [sum(n[k] for n in counts.values()) + 1 for k in (0, 1)]
    if total[1] == 1:
        return weights
    odds = {k: log((n[1] + 0.5) / total[1]) - log((n[0] + 0.5) / total[0]) for k, n in counts.items()}
    weights.word = max(0.1, odds.pop("#word", 0.5))
    weights.linked = min(weights.word, max(0.01, odds.pop("#linked", 0.05)))
    weights.tags = {k: min(-0.1, v) for k, v in odds.items() if not k.startswith("#")}
    return weights


def extract(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; see ``main_text``.

    A page is a sequence of runs of words and tags. Words score above zero and tags below, and the part with
    the largest sum, found in one scan and ``grown`` to the element around it, is the main text. Menus, adverts, forms, comments and the like score
    nothing and are cut out where they stand inside it. Null and empty pages, and pages without words, have
    an empty text; repeated rows come back repeated; other columns are ignored; an empty table gives an
    empty result.
    """
    weights = learn(pages, most_pages)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select("page_id", "url", F.col("html").cast("string"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(of_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
