"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks, stretches of text between block-level tags. Each block has
features of its ancestors (tags, words of class, id and role) and of its text. The field gives
every block a score for being article text and every pair of neighbours one for staying in or
out of the article; the Viterbi path marks the article. It is trained on labelled pages.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadshelf.llm.common import slices, type_of

# Labelled pages a model is fitted on, at most; they come to the driver.
MAX_TRAINING_PAGES = 600
TRAINING_STEPS = 150
SEED = 7

# Fixed values of HTML: elements without content, whose content is no markup, inline, and
# those that end an open element of the same group.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg select annotation annotation-xml".split())
MATHML = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts "
    "mprescripts mtable mtr mlabeledtr mtd mstyle merror mpadded mphantom mfenced menclose maction semantics annotation "
    "annotation-xml".split()
)
# Those that hold all that follows where their end tag is missing.
TO_THE_END = frozenset("script style title textarea".split())
INLINE = MATHML | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark object q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr br".split()
)
# The slash at the end belongs to an unquoted value.
_VALUE_SLASH = re.compile(r"""=\s*[^\s"']*/\Z""")
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
NO_BLOCKS = frozenset({"p"})
SCOPES = frozenset("ul ol dl table tr div section article main aside nav header footer form blockquote body td th".split())

# A quoted value may hold `<`, where what follows its end can follow a value. Broken quotes end at `>`.
_TAG = re.compile(
    r"""<(?:!--|[!?][^<>]*>|(/?)([a-zA-Z][\w:-]*)((?:[^<>"'=]|=(?!\s*["'])|=\s*"[^"<]*(?:"|<[^"]*"(?=[\s/>]))"""
    r"""|=\s*'[^'<]*(?:'|<[^']*'(?=[\s/>]))|"[^"<]*"|'[^'<]*')*|[^<>]*)>)"""
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Tags that cannot be in a drawing, unless it holds a page (the first alternative) before.
_NO_DRAWING = re.compile(r"<foreignObject\b|<(p|div|h[1-6]|ul|ol|li|dl|table|section|article|blockquote|pre)\b[^<>]*>", re.I)
_LETTERS = re.compile(r"[a-zA-Z]+")


class Path:
    """Names of an element and of those around it, shared with the element around it."""

    __slots__ = ("around", "own")

    def __init__(self, around: Path | None, own: set[str]):
        self.around, self.own = around, own

    def names(self) -> frozenset[str]:
        found: set[str] = set()
        path: Path | None = self
        while path:
            found |= path.own
            path = path.around
        return frozenset(found)


@dataclass
class Block:
    text: str
    around: Path
    leaf: str
    linked: float  # share of the characters inside links

    @property
    def path(self) -> frozenset[str]:
        return self.around.names()


class _Open:
    """The open elements of a page, known by place and by tag, so that no end tag has to look
    through them."""

    def __init__(self):
        self.tags, self.paths = [""], [Path(None, set())]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # places of the elements that are not inline
        self.names: set[str] = set()  # of all open elements

    def push(self, tag: str, names: set[str]) -> None:
        fresh = names - self.names
        self.names |= fresh
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(Path(self.paths[-1], fresh) if fresh else self.paths[-1])

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            path = self.paths.pop()
            if path is not self.paths[-1]:
                self.names -= path.own
            if self.blocks[-1] == len(self.tags):
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the last open element with one of the tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def links(self) -> bool:
        return bool(self.places.get("a"))

    def end(self, tag: str) -> None:
        """An end tag closes its element; an inline one only up to the block it is in."""
        place = self.last((tag,))
        if place > 0 and not (tag in INLINE and self.blocks[-1] > place):
            self.cut(place)

    def make_room(self, tag: str) -> None:
        """A block closes those that cannot hold it, up to the nearest element that shields them."""
        ends = ENDS.get(tag) or (NO_BLOCKS if tag not in VOID else frozenset())
        place = self.last(ends)
        if place > 0 and place > self.last(t for t in SCOPES if t not in ends):
            self.cut(place)


def _hints(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {"is:" + w.lower() for m in _NAMES.findall(attributes) for w in _LETTERS.findall("".join(m))}


def leaf_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, references decoded and white space made single.

    Takes time in proportion to the page, however elements are nested or left open.
    """
    opened = _Open()
    blocks: list[Block] = []
    pending: list[str] = []
    linked = 0
    ends: dict[str, tuple[int, int]] = {}  # the next end tag of elements without text; -1: none

    def flush() -> None:
        nonlocal pending, linked
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            if text:
                blocks.append(Block(text, opened.paths[-1], opened.tags[opened.blocks[-1]], min(1.0, linked / len(text))))
            pending, linked = [], 0

    def after(tag: str, at: int) -> int:
        """Where the page goes on behind an element whose content is no text."""
        if ends.get(tag, (-1, -1))[0] < at:
            end = re.compile(rf"</{tag}\b[^<>]*>", re.I).search(page, at)
            ends[tag] = end.span() if end else (len(page), -1)
        start, behind = ends[tag]
        if tag == "svg" and behind >= 0:
            # text of a page ends a drawing that is left open
            other = _NO_DRAWING.search(page, at, start)
            if other and other[1]:
                return other.start()
        if behind >= 0 or tag in TO_THE_END:
            return behind if behind >= 0 else len(page)
        # its end tag is missing: it ends where a block begins or ends
        return next((m.start() for m in _TAG.finditer(page, at) if m[2] and m[2].lower() not in INLINE), len(page))

    at = 0
    while True:
        found = _TAG.search(page, at)
        said = page[at : found.start() if found else len(page)]
        if said:
            pending.append(said)
            if opened.links():
                linked += len(said.strip())
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            continue
        tag = tag.lower()
        if found[1]:
            if tag not in INLINE:
                flush()
            opened.end(tag)
            continue
        if (tag == "svg" or tag in MATHML) and found[3].endswith("/") and not _VALUE_SLASH.search(found[3]):
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            at = after(tag, at)
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag not in INLINE:
            flush()
            opened.make_room(tag)
        if tag in VOID:
            continue
        opened.push(tag, {"in:" + tag} | _hints(found[3]) if tag not in INLINE else set())
    flush()
    return blocks


# Text features.


def _bucket(n: int) -> int:
    return min(8, n.bit_length())


def text_features(block: Block, place: int, count: int) -> list[str]:
    words = block.text.count(" ") + 1
    last = block.text[-1]
    found = [
        "leaf:" + block.leaf, f"words:{_bucket(words)}", f"link:{round(block.linked * 4)}",
        "end:" + ("stop" if last in ".!?…:;\"”»)" else "none"),
    ]
    if place == 0:
        found.append("first")
    if place == count - 1:
        found.append("last")
    if "©" in block.text or "(c)" in block.text[:8].lower():
        found.append("copyright")
    if words > 3 and sum(block.text.count(x) for x in ".,;") > 1:
        found.append("prose")
    return found


# Labelled pages.

# Names that pages give to their parts.
CONTENT_NAMES = "content post entry article story main text body post-content entry-content article-body main-content story-body page-content".split()
PART_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav site-nav pagination toc-nav".split(),
    "head": "header masthead site-header top banner-top page-header branding".split(),
    "foot": "footer site-footer bottom colophon copyright legal page-footer".split(),
    "side": "sidebar side aside widget widgets rail related recommended popular more-stories archive".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal banner warning cookie-notice paywall".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot ad-container banner-ad".split(),
    "form": "form search newsletter subscribe login signup contact-form search-form".split(),
    "comments": "comments comment comment-list discussion replies reply responses respond disqus reader-comments".split(),
    "share": "share social sharing share-buttons social-links tags meta byline-links".split(),
}
PART_TAGS = {
    "menu": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"],
    "notice": ["div", "section", "dialog", "aside"], "advert": ["div", "aside", "section"], "form": ["form", "div"],
    "comments": ["section", "div", "ol"], "share": ["div", "ul", "section"],
}
SYLLABLES = "an ba ce di el fo ga he in jo ka le mi no or pa re so ti un ver wi ya zu th st on ing ed ly".split()


class PageMaker:
    """Makes pages of varied build with their article's blocks; one seed makes one page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.article: list[str] = []

    def word(self) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w + (self.r.choice(["###", "%", "&", "***", "|"]) if self.r.random() < self.junk else "")

    def sentence(self, low: int = 4, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return (" ".join(words)).capitalize() + self.r.choice(["."] * 6 + ["?", "!", "…"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def label(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def shown(self, text: str, markup: bool = False) -> str:
        """The text as HTML, sometimes with inline tags in it."""
        out = entities.escape(text, quote=self.r.random() < 0.5)
        words = out.split(" ")
        if markup and len(words) > 3 and self.r.random() < 0.4:
            i = self.r.randrange(len(words) - 1)
            tag = self.r.choice(["b", "em", "a", "span", "i", "strong", "code"])
            words[i] = f'<{tag}{" href=/x" if tag == "a" else ""}>{words[i]}</{tag}>'
        return self.r.choice([" ", " ", " ", "\n", "  "]).join(words)

    def main(self, tag: str, text: str, markup: bool = True) -> str:
        """A block of the article."""
        self.article.append(" ".join(text.split()))
        end = "" if tag in ("p", "li") and self.r.random() < 0.25 else f"</{tag}>"
        if tag == "p" and self.r.random() < 0.1:
            return f"<p><b>{self.shown(text)}<br>"
        return f"<{tag}>{self.shown(text, markup)}{end}"

    def named(self, tag: str, names: list[str], inside: str, bare: float = 0.3) -> str:
        if tag not in ("div", "section", "ul", "ol", "td") and self.r.random() < bare:
            return f"<{tag}>{inside}</{tag}>"
        key = self.r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{self.r.choice(names)}">{inside}</{tag}>'

    def links(self, n: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.shown(self.label())}</a>'
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " &raquo; "]).join(item() for _ in range(n))

    def part(self, kind: str) -> str:
        r = self.r
        if kind in ("menu", "share"):
            inside = self.links(r.randint(2, 8))
        elif kind == "head":
            inside = f"<a href=/>{self.label()}</a>" + r.choice(["", f"<p>{self.shown(self.sentence())}</p>", f"<h2>{self.label()}</h2>"])
        elif kind == "foot":
            inside = f"<p>{r.choice(['&copy; ', '© ', '(c) ', ''])}{r.randint(1999, 2024)} {self.label()}</p>" + r.choice(["", self.links(3), self.shown(self.prose(1, 2))])
        elif kind == "side":
            inside = f"<h3>{self.label()}</h3>" + r.choice([self.links(r.randint(2, 6)), "".join(f"<p>{self.shown(self.prose(1, 2))}</p>" for _ in range(r.randint(1, 3)))])
        elif kind in ("notice", "advert"):
            inside = r.choice([self.shown(self.prose(1, 3)), f"<p>{self.shown(self.prose(1, 3))}</p>", f"<a href=/x>{self.shown(self.sentence())}</a>"])
        elif kind == "form":
            inside = f"<label>{self.label()}</label><input name=q><button>{self.label(1, 2)}</button>" + r.choice(["", f"<p>{self.shown(self.prose(1, 2))}</p>"])
        else:
            one = lambda: self.named(r.choice(["div", "li", "article", "p"]), ["comment", "reply", "comment-body"], f"<b>{self.label(1, 2)}</b>" + r.choice([" ", "<br>", "</p><p>"]) + self.shown(self.prose(1, 4)))
            inside = f"<h3>{self.label()}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
        return self.named(r.choice(PART_TAGS[kind]), PART_NAMES[kind], inside)

    def body(self) -> str:
        r, out = self.r, []
        paragraph = "p" if r.random() < 0.9 else "div"
        if r.random() < 0.85:
            out.append(self.main(r.choice(["h1", "h1", "h2"]), r.choice([self.label(2, 8), self.sentence(3, 10)]), False))
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                out.append(self.main(paragraph, self.prose() if r.random() < 0.8 else r.choice([self.label(1, 6), self.sentence(1, 3)])))
            elif x < 0.8:
                out.append(self.main(r.choice(["h2", "h3", "blockquote", "pre"]), r.choice([self.label(1, 6), self.sentence()])))
            elif x < 0.9:
                out.append("<ul>" + "".join(self.main("li", r.choice([self.sentence(), self.label(1, 5)])) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.93:
                out.append("<table><tr>" + "".join(self.main("td", self.label(1, 3)) for _ in range(r.randint(2, 4))) + "</tr></table>")
            else:
                out.append(self.part(r.choice(["advert", "share", "side", "form", "notice"])))
        if r.random() < 0.15 and len(out) > 2:
            cut = r.randint(1, len(out) - 1)
            out = [*out[:cut], "<section>", *out[cut:], "</section>"]
        return "".join(out)

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        self.junk = 0.3 if r.random() < 0.1 else 0.0
        before = ["menu"] + r.sample(["head", "notice", "advert", "form", "share", "side"], r.randint(0, 4))
        after = ["foot"] + r.sample(["comments", "side", "advert", "form", "menu", "notice", "share"], r.randint(0, 4))
        r.shuffle(before)
        after = after[1:] + after[:1]
        head = "".join(self.part(k) for k in before if r.random() < 0.9)
        x = r.random()
        if x < 0.45:
            main = self.named("article", CONTENT_NAMES, self.body(), 0.7)
        elif x < 0.6:
            main = self.named("main", CONTENT_NAMES, self.body(), 0.7)
        elif x < 0.9:
            main = self.named(r.choice(["div", "div", "section"]), CONTENT_NAMES, self.body())
        else:
            main = f"<div>{self.body()}</div>"
        if r.random() < 0.15:
            main = f"<main>{main}</main>"
        tail = "".join(self.part(k) for k in after if r.random() < 0.9)
        style = "<style>p{margin:0}</style><script>var t='</p>';</script>" if r.random() < 0.6 else ""
        title = f"<head><meta charset=utf-8><title>{self.label()}</title>{style}</head>"
        end = "</body></html>" if r.random() < 0.8 else ""
        note = "<!-- part -->" if r.random() < 0.3 else ""
        return f"<!DOCTYPE html><html>{title}<body>{head}{note}{main}{tail}{end}", self.article


def labelled_pages(spark: SparkSession, n: int = MAX_TRAINING_PAGES, seed: int = SEED) -> DataFrame:
    """(page_id, html, article): made pages of many builds with the blocks of their article."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [PageMaker(seed * 1_000_003 + i).page() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.list_(pa.string()))],
                names=["page_id", "html", "article"],
            )

    return spark.range(n).mapInArrow(make, "page_id long, html string, article array<string>")


# The field.


@dataclass
class Model:
    """Weights of features for the article against the rest, and of moves between the two."""

    weights: dict[str, float]
    moves: list[list[float]]  # from, to; 0 is the rest, 1 the article
    start: list[float]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels of a page's blocks, by Viterbi's algorithm."""
        if not blocks:
            return []
        weights, paths = self.weights, {}
        (stay0, go1), (go0, stay1) = self.moves
        out = inside = 0.0
        back: list[tuple[int, int]] = []
        for i, block in enumerate(blocks):
            score = paths.get(block.around)
            if score is None:
                score = paths[block.around] = sum(weights.get(f, 0.0) for f in block.path)
            score += sum(weights.get(f, 0.0) for f in text_features(block, i, len(blocks)))
            if i == 0:
                out, inside = self.start[0], self.start[1] + score
                continue
            to0, from1 = (out + stay0, 0), (inside + go0, 1)
            a = max(to0, from1)
            b = max((out + go1, 0), (inside + stay1, 1))
            back.append((a[1], b[1]))
            out, inside = a[0], b[0] + score
        label = int(inside > out)
        found = [label]
        for step in reversed(back):
            label = step[label]
            found.append(label)
        return [bool(x) for x in reversed(found)]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[str, list[str]]], steps: int = TRAINING_STEPS, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximum likelihood by gradient ascent over all pages at once.

    The expected labels and moves come from the forward and backward recursions.
    """
    names: dict[str, int] = {}
    rows, blocks_of = [], []
    for page, article in pages:
        blocks = leaf_blocks(page)
        if not blocks:
            continue
        wanted = set(article)
        blocks_of.append([int(b.text in wanted) for b in blocks])
        rows.append([[names.setdefault(f, len(names)) for f in (*sorted(b.path), *text_features(b, i, len(blocks)))] for i, b in enumerate(blocks)])
    if not rows:
        raise ValueError("no labelled page has any text")
    n, t = len(rows), max(map(len, rows))
    mask, truth = np.zeros((n, t), bool), np.zeros((n, t), int)
    where, which = [], []
    for i, (row, labels) in enumerate(zip(rows, blocks_of, strict=True)):
        mask[i, : len(row)], truth[i, : len(row)] = True, labels
        for j, features in enumerate(row):
            where += [i * t + j] * len(features)
            which += features
    where, which = np.array(where), np.array(which)
    theta = np.zeros(len(names) + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pair = mask[:, 1:]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (truth[:, :-1][pair], truth[:, 1:][pair]), 1)
    seen_start = np.bincount(truth[:, 0], minlength=2)
    for step in range(1, steps + 1):
        weights, moves, start = theta[: len(names)], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((n, t, 2))
        score[:, :, 1] = np.bincount(where, weights[which], n * t).reshape(n, t)
        forward, backward = np.empty((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = start + score[:, 0]
        for j in range(1, t):
            new = _logsumexp(forward[:, j - 1, :, None] + moves, 1) + score[:, j]
            forward[:, j] = np.where(mask[:, j, None], new, forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            new = _logsumexp(moves + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(mask[:, j + 1, None], new, 0.0)
        total = _logsumexp(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None])[:, :, 1] * mask
        both = np.exp(
            forward[:, :-1, :, None] + moves + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * pair[:, :, None, None]
        gradient = np.concatenate(
            [
                np.bincount(which, ((truth * mask) - single).reshape(-1)[where], len(names)),
                (seen_moves - both.sum(axis=(0, 1))).reshape(-1),
                seen_start - np.array([n - single[:, 0].sum(), single[:, 0].sum()]),
            ]
        ) / n - decay * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in names.items()}
    return Model(weights, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def fit_frame(labelled: DataFrame, most: int = MAX_TRAINING_PAGES) -> Model:
    """A model from (page_id, html, article); the `most` pages with the smallest ids are used."""
    rows = labelled.select("page_id", "html", "article").orderBy("page_id").limit(most).collect()
    return fit([(r["html"], r["article"]) for r in rows])


def article_text(page: str | None, model: Model) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, inside in zip(blocks, model.decode(blocks), strict=True) if inside)


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row: the article's blocks, one per line.

    A null or empty html has an empty text. Each page is judged by itself: no shuffle, repeated
    rows get equal texts.
    """
    schema = f"`{id_col}` {type_of(pages, id_col)}, `{url_col}` {type_of(pages, url_col)}, text string"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [article_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    rows = pages.select(id_col, url_col, F.col(html_col).cast("string"))
    return rows.mapInArrow(extract, schema).withColumn("n_chars", F.length("text").cast("long"))
