"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: The model learns from at most so many pages of the table, those with the least hash of their id, of at most LABELLED_BYTES and LABELLED_BLOCKS, and so many made ones.
LABELLED_PAGES, LABELLED_BYTES, LABELLED_BLOCKS, MADE_PAGES = 200, 60_000, 400, 500

# Elements that begin a block, that hold no text of the page, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
HIDDEN = frozenset("script style template noscript head title iframe object canvas audio video textarea noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these ends where one of its right side begins.
ENDS_BEFORE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody", "tfoot"}}

#: A comment, a declaration, a tag whose attributes hold neither < nor > between quotes, or the beginning of any other tag.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><\"']*)((?:\"[^\"<>]*\"|'[^'<>]*'|[^<>\"'])*+)>|<(/?)([a-zA-Z][^\s/><\"']*)", re.DOTALL)
QUOTES = re.compile(r"[\"'>]")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+|[0-9]+")


class Path:
    """The open elements about a block, one for equal paths of a page: the last one's descriptor (tag and name words), and what holds of them all.

    names are the features of their tags and words, shared with the elements above where nothing is new; if a vocabulary is given,
    only those in it, so that no path has more than the model knows, however deep it is.
    """

    __slots__ = ("above", "depth", "element", "features", "last", "names", "under", "vocabulary")

    def __init__(self, above: Path | None = None, element: str = "", vocabulary=None):
        self.above, self.element, self.under, self.features = above, element, {}, None
        self.depth, self.last, self.names, self.vocabulary = 0, "-", frozenset(), vocabulary
        if above is not None:
            tag, *words = element.split(" ")
            self.depth, self.vocabulary = above.depth + 1, above.vocabulary
            self.last = tag if tag in BLOCKS else above.last
            new = {f"in {tag}", *(f"named {w}" for w in words)} - above.names
            if self.vocabulary is not None:
                new = {f for f in new if f in self.vocabulary}
            self.names = above.names | new if new else above.names

    def enter(self, element: str) -> Path:
        if (found := self.under.get(element)) is None:
            found = self.under[element] = Path(self, element)
        return found

    def elements(self) -> list[str]:
        out, at = [], self
        while at.above is not None:
            out.append(at.element)
            at = at.above
        return out[::-1]


@dataclass
class Block:
    """A leaf block: its text, the open elements about it, the characters inside links, and a count of line breaks."""

    text: str
    path: Path
    linked: int
    breaks: int


class _Ends:
    """Where tags end whose attributes need more than a look: the first > outside quotes, else the first > at all. All of a page are found in one pass backwards."""

    def __init__(self, page: str):
        self.page, self.at, self.ends = page, [], []
        plain = double = single = -1
        for m in reversed(list(QUOTES.finditer(page))):
            c = m[0]
            if c == ">":
                plain = m.start()
            elif c == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.at.append(-m.start())
            self.ends.append(plain)
        self.at.reverse()
        self.ends.reverse()
        self.at = [-x for x in self.at]

    def after(self, place: int) -> int:
        k = bisect_left(self.at, place)
        found = self.ends[k] if k < len(self.at) else -1
        return found if found >= 0 else self.page.find(">", place) if k < len(self.at) else -1


def leaf_blocks(page: str, vocabulary=None) -> list[Block]:
    """The blocks of a page with any text, in page order; white space in a block is single spaces. The time is linear in the page's length, however it is nested or broken."""
    out: list[Block] = []
    open_elements: list[tuple[str, Path]] = []
    open_tags: Counter[str] = Counter()
    open_blocks: list[int] = []  # places of blocks in open_elements
    root = Path(vocabulary=vocabulary)
    texts: list[str] = []
    linked = breaks = 0
    where = root
    ends: _Ends | None = None
    found_at: dict[str, int] = {}  # the next end of a hidden element, or start of the body

    def finish() -> None:
        nonlocal linked, breaks
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, where, min(linked, len(text)), breaks))
            texts.clear()
        linked = breaks = 0

    def close(to: int) -> None:
        for tag, _ in open_elements[to:]:
            open_tags[tag] -= 1
            if tag in BLOCKS:
                finish()
        del open_elements[to:]
        while open_blocks and open_blocks[-1] >= to:
            open_blocks.pop()

    def add(raw: str) -> None:
        nonlocal linked, where
        if not texts:
            if not raw.strip():
                return
            where = open_elements[-1][1] if open_elements else root
        text = html.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if open_tags["a"]:
            linked += len(text.strip())

    def next_of(pattern: str, at: int) -> int:
        """The end of the first match from at on, or n + 1; each stretch of the page is searched once for a pattern."""
        if found_at.get(pattern, -1) < at:
            m = re.compile(pattern, re.IGNORECASE).search(page, at)
            found_at[pattern] = (m.start() if pattern.startswith("<body") else m.end()) if m else n + 1
        return found_at[pattern]

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[5]:
            ends = ends or _Ends(page)
            end = ends.after(at)
            if end < 0:
                add(m[0])
                continue
            tag, ending, attributes, at = m[5], m[4], page[at:end], end + 1
        elif m[2]:
            tag, ending, attributes = m[2], m[1], m[3]
        else:
            continue
        tag = tag.lower()
        if ending:
            if open_tags[tag] > 0:
                k = len(open_elements) - 1
                while open_elements[k][0] != tag:
                    k -= 1
                close(k)
            elif tag in BLOCKS:
                finish()
            continue
        if tag in HIDDEN:
            if not attributes.endswith("/"):
                end = next_of(rf"</{re.escape(tag)}\s*>", at)
                if tag == "head":  # may lack its end tag
                    end = min(end, next_of(r"<body\b", at))
                    at = end if end <= n else at
                else:
                    at = min(end, n)
            continue
        if tag in BLOCKS:
            finish()
            # A block ends an open paragraph of the same container, and list items, cells and rows end their like.
            while open_blocks:
                k = open_blocks[-1]
                name = open_elements[k][0]
                if name == "p" and tag not in ("option", "optgroup"):
                    close(k)
                    break
                if tag not in ENDS_BEFORE.get(name, ()):
                    break
                close(k)
                if tag != "tr":
                    break
        if tag == "br":
            if texts:
                texts.append(" ")
                breaks += 1
        elif tag not in VOID:
            if not attributes.endswith("/") or tag in BLOCKS:
                words = {w for found in NAMED.findall(attributes) for w in NAME_PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower())} if "=" in attributes else ()
                path = (open_elements[-1][1] if open_elements else root).enter(" ".join([tag, *sorted(words)]))
                if tag in BLOCKS:
                    open_blocks.append(len(open_elements))
                open_elements.append((tag, path))
                open_tags[tag] += 1
    finish()
    return out


def path_features(path: Path) -> tuple[str, ...]:
    """The tags and name words of the elements about a block, of the last element apart."""
    if path.features is None:
        out = {"bias", f"depth {min(path.depth, 8)}", f"last {path.last}", *path.names}
        if not {"in article", "in main"} & path.names:
            out.add("no article")
        path.features = tuple(sorted(out))
    return path.features


#: Marks that end a sentence, and what may stand after them.
ENDS, CLOSERS = tuple(".!?…。:;"), "\"'»”)]"


def text_features(block: Block, number: int, count: int) -> list[str]:
    """Features of a block's text and place in the page."""
    n, words = len(block.text), block.text.count(" ") + 1
    out = [f"size {min(n, 4000).bit_length()}", f"words {min(words, 255).bit_length()}", f"linked {round(4 * block.linked / n)}", "ends" if block.text.rstrip(CLOSERS).endswith(ENDS) else "open"]
    if number == 0:
        out.append("first")
    if number == count - 1:
        out.append("final")
    if "©" in block.text:
        out.append("copyright")
    if block.text.isupper():
        out.append("upper")
    return out


@dataclass
class Field:
    """Weights of a two-label field: of features by label, of label pairs, and of label pairs between blocks with the same elements about them."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    pairs: tuple = ((0.0, 0.0), (0.0, 0.0))
    same: tuple = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, blocks: list[Block], known: dict | None = None) -> list[int]:
        """The likeliest labels (Viterbi)."""
        known = {} if known is None else known
        scores, back = None, []
        for i, block in enumerate(blocks):
            features = path_features(block.path)
            if (about := known.get(features)) is None:
                found = [self.weights[f] for f in features if f in self.weights]
                about = known[features] = (sum(a for a, _ in found), sum(b for _, b in found))
            a, b = about
            for f in text_features(block, i, len(blocks)):
                if w := self.weights.get(f):
                    a += w[0]
                    b += w[1]
            if scores is None:
                scores = (a, b)
                continue
            (aa, ab), (ba, bb) = self.pairs
            if block.path is blocks[i - 1].path:
                (sa, sb), (ta, tb) = self.same
                aa, ab, ba, bb = aa + sa, ab + sb, ba + ta, bb + tb
            to_a, to_b = (scores[0] + aa, scores[1] + ba), (scores[0] + ab, scores[1] + bb)
            back.append((int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])))
            scores = (max(to_a) + a, max(to_b) + b)
        if scores is None:
            return []
        labels = [int(scores[1] > scores[0])]
        for pointer in reversed(back):
            labels.append(pointer[labels[-1]])
        return labels[::-1]


def fit_field(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.25, ridge: float = 1e-3) -> Field:
    """Penalised conditional likelihood by AdaGrad; forward and backward sums run over all pages at once, block by block."""
    pages = [(b, y) for b, y in pages if b]
    if not pages:
        return Field({"bias": (0.0, -1.0), "in article": (0.0, 2.0)})
    names: dict[str, int] = {}
    rows, columns, longest = [], [], max(len(b) for b, _ in pages)
    labels = np.zeros((len(pages), longest), np.int64)
    there, same = np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest))
    for p, (blocks, y) in enumerate(pages):
        labels[p, : len(y)], there[p, : len(y)] = y, True
        for i, block in enumerate(blocks):
            same[p, i] = i > 0 and block.path is blocks[i - 1].path
            for f in (*path_features(block.path), *text_features(block, i, len(blocks))):
                rows.append(p * longest + i)
                columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    cells, n = len(pages) * longest, len(names)
    gold = np.stack([labels == 0, labels == 1], -1) & there[..., None]
    gold_pairs = np.einsum("pia,pib->piab", gold[:, :-1].astype(float), gold[:, 1:].astype(float))
    w, t = np.zeros((n, 2)), np.zeros((2, 2, 2))
    grown = [np.full_like(w, 1e-4), np.full_like(t, 1e-4)]

    def add(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for _ in range(rounds):
        emit = np.stack([np.bincount(rows, w[columns, k], cells) for k in (0, 1)], -1).reshape(len(pages), longest, 2)
        step = t[0] + same[..., None, None] * t[1]
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for i in range(1, longest):
            forward[:, i] = np.where(there[:, i, None], add(forward[:, i - 1, :, None] + step[:, i], 1) + emit[:, i], forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            backward[:, i] = np.where(there[:, i + 1, None], add(step[:, i + 1] + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], 2), 0)
        total = add(forward[:, -1], 1)
        marginal = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        both = np.exp(forward[:, :-1, :, None] + step[:, 1:] + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        missing = (gold - marginal).reshape(cells, 2) / len(pages)
        off = (gold_pairs - both) / len(pages)
        slope = np.stack([np.bincount(columns, missing[rows, k], n) for k in (0, 1)], -1) - ridge * w
        slope_t = np.stack([off.sum((0, 1)), (off * same[:, 1:, None, None]).sum((0, 1))]) - ridge * t
        for x, g, s in ((w, slope, grown[0]), (t, slope_t, grown[1])):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Field({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, tuple(map(tuple, t[0].tolist())), tuple(map(tuple, t[1].tolist())))


#: Name words and elements that mark parts of a page which are not its article, also inside the article's element.
ASIDE = frozenset("ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice gdpr newsletter subscribe signup comment comments reply replies respond discussion share sharing social related recommended sidebar widget nav navigation menu breadcrumb breadcrumbs footer header masthead popup modal login search toolbar pagination pager tags disqus".split())
ASIDE_TAGS = frozenset("nav aside footer form button select dialog menu".split())


def labelled(page: str) -> tuple[list[Block], list[int]] | None:
    """The labels that the page's own markup gives: what is in its only article element, without parts named as something else."""
    blocks = leaf_blocks(page)
    if len(re.findall(r"<article\b", page, re.IGNORECASE)) != 1 or not 0 < len(blocks) <= LABELLED_BLOCKS:
        return None
    labels = []
    for block in blocks:
        elements = [e.split(" ") for e in block.path.elements()]
        inside = next((k for k, e in enumerate(elements) if e[0] == "article"), None)
        labels.append(int(inside is not None and not any(e[0] in ASIDE_TAGS or ASIDE.intersection(e[1:]) for e in elements[inside + 1 :])))
    return blocks, labels


def made_page(r: random.Random) -> tuple[list[Block], list[int]]:
    """A made page of many layouts, with labels: its parts carry a mark that tells article from other text."""
    syllables = ["an", "er", "the", "ti", "on", "re", "st", "in", "ed", "ou", "ble", "que", "ver", "ung", "ción", "é", "ñ", "ment"]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(least: int = 4, most: int = 25) -> str:
        return " ".join(word() for _ in range(r.randint(least, most))).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def text(least: int = 1, most: int = 5) -> str:
        return " ".join(sentence() for _ in range(r.randint(least, most)))

    def named(tag: str, *names: str) -> tuple[str, str]:
        name = r.choice(names)
        key = r.choice(["class", "id"])
        return f'<{tag} {key}="{name}{r.choice(["", "", "-1", "-box", " wrap"])}">', f"</{tag}>"

    def link_list(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li><a href='/{word()}'>\x01{word()}</a></li>" for _ in range(r.randint(1, 7))) + f"</{tag}>"

    def part(kinds: list[str]) -> str:
        kind = r.choice(kinds)
        if kind == "ad":
            a, z = named(r.choice(["div", "aside", "section"]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")
            return a + r.choice(["", "<p>"]) + "\x01" + text(1, 2) + z
        if kind == "comments":
            a, z = named(r.choice(["div", "section", "ol"]), "comments", "comment-list", "reader-comments", "discussion", "responses", "disqus_thread")
            heading = r.choice(["", f"<h{r.choice([2, 3])}>\x01{word()}</h3>"])
            each = "".join(r.choice(["<div class='comment'>", "<li class='comment'>", "<article class='comment'>", "<p class='comment-body'>"]) + r.choice(["", f"<b>\x01{word()}</b> "]) + f"<p>\x01{text(1, 3)}</p>" for _ in range(r.randint(1, 5)))
            return a + heading + each + z
        if kind == "form":
            a, z = r.choice([named("div", "newsletter", "subscribe", "signup", "login", "search"), ("", "")])
            return a + f"<form action='/x'><label>\x01{word()}</label><input name=q><p>\x01{text(1, 1)}</p><button>\x01{word()}</button><select><option>\x01{word()}<option>\x01{word()}</select></form>" + z
        if kind == "notice":
            a, z = named(r.choice(["div", "section", "aside", "dialog"]), "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "paywall")
            return a + f"<p>\x01{text(1, 2)}</p>" + r.choice(["", f"<button>\x01{word()}</button>"]) + z
        if kind == "sidebar":
            a, z = r.choice([("<aside>", "</aside>"), named(r.choice(["div", "aside", "section"]), "sidebar", "widget", "related", "recommended", "right-col", "trending")])
            return a + f"<h3>\x01{word()}</h3>" + r.choice([link_list(), f"<p>\x01{text(1, 3)}</p>"]) + z
        if kind == "share":
            a, z = named("div", "share", "social", "sharing", "tags", "breadcrumbs", "byline-links", "pagination")
            return a + "".join(f"<a href='#'>\x01{word()}</a> " for _ in range(r.randint(1, 5))) + z
        if kind == "nav":
            a, z = r.choice([("<nav>", "</nav>"), named("div", "nav", "menu", "navigation", "navbar", "topbar"), ("<nav class='menu'>", "</nav>")])
            return a + link_list() + z
        if kind == "header":
            a, z = r.choice([("<header>", "</header>"), named("div", "header", "masthead", "site-header", "top"), ("<header class='site-header'>", "</header>")])
            return a + r.choice([f"<div>\x01{word()}</div>", f"<p>\x01{sentence()}</p>", f"<h1>\x01{word()}</h1>", ""]) + r.choice(["", link_list()]) + z
        a, z = r.choice([("<footer>", "</footer>"), named("div", "footer", "site-footer", "bottom", "copyright"), ("<footer class='foot'>", "</footer>")])
        return a + r.choice([f"\x01&copy; {word()}", f"<p>\x01{text(1, 2)}</p>", link_list()]) + z

    def body() -> str:
        out = [f"<h1>\x02{sentence(2, 9)}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15 and out:
            out = ["<header>" + out[0] + "</header>"]
        for _ in range(r.randint(1, 9)):
            k = r.random()
            if k < 0.7:
                out.append(r.choice(["<p>", "<p>", "<p class='text'>", "<p><b>"]) + f"\x02{text()}" + r.choice(["</p>", "", "<br>"]))
            elif k < 0.78:
                out.append(f"<h{r.choice([2, 3])}>\x02{sentence(1, 6)}</h2>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>\x02{sentence()}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>\x02{text(1, 2)}</blockquote>")
            elif k < 0.91:
                out.append("<table><tr>" + "".join(f"<td>\x02{word()}" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.94:
                out.append(f"<figure><img src=x><figcaption>\x02{sentence()}</figcaption></figure>")
            elif k < 0.96:
                out.append(f"<p>\x02{sentence()} <a href='/y'>{word()}</a> {sentence()}</p>")
            else:
                out.append(part(["ad", "ad", "form", "share", "sidebar", "notice"]))
        if r.random() < 0.12:
            out.append(part(["comments", "share"]))
        return "".join(out)

    a, z = r.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div id='main'><article class='post'>", "</article></div>"), ("<div class='content'>", "</div>"), ("<div id='article'>", "</div>"), ("<div class='post-body entry-content'>", "</div>"), ("<section class='story'>", "</section>")])
    before = "".join(part(["nav", "header", "notice", "ad", "form", "share", "sidebar"]) for _ in range(r.randint(0, 4)))
    after = "".join(part(["comments", "sidebar", "ad", "form", "notice", "share", "nav"]) for _ in range(r.randint(0, 4))) + r.choice(["", part(["footer"])])
    blocks = leaf_blocks(f"<html><body>{before}{a}{body()}{z}{after}</body></html>")
    labels = [int("\x02" in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace("\x01", "").replace("\x02", "") or "-"
    return blocks, labels


def train(pages: DataFrame, labelled_pages: int = LABELLED_PAGES, made_pages: int = MADE_PAGES) -> Field:
    """Fit on pages that their own markup labels, at most `labelled_pages` of the table, and on made pages of other layouts."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.octet_length("html") <= LABELLED_BYTES)
    key = [F.xxhash64("page_id").alias("a"), F.xxhash64("html").alias("b")]
    chosen = F.broadcast(rows.select(*key).orderBy("a", "b").limit(labelled_pages).distinct())  # keys only, as many as the bound
    sample = rows.select(*key, "html").join(chosen, ["a", "b"]).dropDuplicates(["a", "b"]).orderBy("a", "b").select("html").collect()
    known = [x for x in (labelled(row["html"]) for row in sample) if x]
    r = random.Random(6)
    return fit_field(known + [made_page(r) for _ in range(made_pages)])


def _extract(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches, "html"):
            texts = []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page or "", model.weights)
                if len(known) > 50_000:
                    known.clear()
                texts.append("\n".join(b.text for b, label in zip(blocks, model.decode(blocks, known), strict=True) if label))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, labelled_pages: int = LABELLED_PAGES, made_pages: int = MADE_PAGES) -> DataFrame:
    """For every page: page_id, url, text (its article's blocks, one a line), n_chars.

    The field is fitted on the driver on a bounded number of pages; its weights, some hundred, go to the executors, and pages are read
    where they lie, whole and in linear time, without a shuffle. It is fitted on pages of at most LABELLED_BYTES and LABELLED_BLOCKS; all pages are read.
    A null or empty html, or one without an article, gives the empty text; an empty table gives an empty one. A line break element counts as white space. What
    browsers show in place of an element only (noscript, object, canvas, audio, video) is no text of the page; formulas and
    drawings have theirs. Repeated rows give repeated rows; only page_id, url and html are read.
    """
    small_batches(pages)
    model = train(pages, labelled_pages, made_pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
