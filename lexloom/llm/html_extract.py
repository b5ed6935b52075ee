"""HTML extraction: a linear-chain CRF over the leaf blocks of a page, decoded by Viterbi.

A page is read tag by tag into leaf blocks: text between two boundaries of block elements,
with the elements that enclose it. Scripts, styles, comments and the head are never text.
Each block has features of its ancestors' tags, of words in their class and id, and of its
text and links; the chain labels article blocks. Training pages are made by a generator of
layouts (page_samples), where each block's label is known; nothing of the tables is used.

Within a block character references are decoded, white space becomes one space and ends are
trimmed; a <br> is white space. A head without an end tag ends where the body's content begins; any other
hidden element hides nothing when it has no end tag before its parent's. Blocks of the article are joined by \\n in page order.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are read as
far as they go; repeated rows are extracted each; a null url or page_id stays null.
"""

from __future__ import annotations

import html as references
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.crf import ChainCRF, fit
from lexloom.llm.support import prepare

SCHEMA = "page_id long, url string, text string, n_chars long"
TRAIN_PAGES = 600

#: Elements that begin and end blocks, that have no end tag, and whose content is not text.
BLOCK = frozenset(
    "html body main article section nav aside header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table caption thead tbody tfoot tr td th "
    "form fieldset legend figure figcaption address details summary hr dialog menu center option select button label textarea".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
#: Of those, the ones whose content is read as elements, so that an end tag may be missing; what can stand in a head.
NESTED = frozenset("svg math object canvas audio video".split())
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
#: Elements that a following start tag ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P = BLOCK - {"button", "label", "select", "option", "textarea"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_RAW_END = re.compile(rf"</({'|'.join(sorted((HIDDEN - NESTED) | {'head'}))})\b", re.I)
_MAY_NEST = re.compile(rf"<(?:{'|'.join(sorted(NESTED))})\b", re.I)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Words in class, id and role that tell parts of pages, by feature.
HINTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs sitemap toc pagination pager tabs",
    "head": "header masthead topbar banner logo branding hero",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets complementary",
    "ad": "ad ads advert adverts advertisement advertising promo promoted sponsor sponsored adsense dfp banner",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay toast privacy warning message",
    "talk": "comment comments reply replies discussion respond disqus thread reader readers",
    "share": "share social sharing follow like likes related recommended recommendations more newsletter subscribe signup tags tag meta byline author trending popular",
    "form": "form search login contact input feedback poll",
    "main": "content article main post entry story body text page single markdown prose articlebody",
}
_HINT = {w: k for k, v in enumerate(HINTS.values()) for w in v.split()}
_TAGS = ["article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "table", "figure", "blockquote", "details"]
_OWN = ["p", "li", "div", "h1", "h2", "td", "pre", "blockquote", "button", "label", "option"]


@dataclass
class Block:
    text: str
    linked: int
    tags: tuple[str, ...]
    hints: frozenset[int]
    links: int


@dataclass
class _Open:
    tag: str
    hints: frozenset[int] = field(default_factory=frozenset)


class _Ends:
    """Places of the end tags of hidden elements, found in one pass when first asked for."""

    def __init__(self, page: str):
        self.page, self.places = page, None

    def after(self, tag: str, at: int) -> int | None:
        """Where the tag's next end tag from at on begins."""
        if self.places is None:
            self.places = defaultdict(list)
            for m in _RAW_END.finditer(self.page):
                self.places[m[1].lower()].append(m.start())
        found = self.places[tag]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else None


def _nested_ends(page: str, raw: _Ends) -> dict[int, int]:
    """Where each NESTED element ends, by the place of its start tag; those that their parent's end tag leaves open are not in it."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    at = 0
    for m in _TAG.finditer(page):
        name = m[2] or m[5]
        if m.start() < at or not name:
            continue
        tag, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in HIDDEN - NESTED - {"head"}:
            if not closing and not rest.rstrip().endswith("/") and (end := raw.after(tag, m.end())) is not None:
                at = end
        elif closing and (tag in NESTED or tag in BLOCK):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in NESTED:
                        ends[stack[k][1]] = m.end()
                    del stack[k:]
                    break
        elif (tag in NESTED and not rest.rstrip().endswith("/")) or (tag in BLOCK and tag not in VOID):
            stack.append((tag, m.start()))
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """All non-blank blocks of a page in order."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    state = {"links": 0, "linked": 0}
    in_link, hidden, at, skip = 0, "", 0, 0
    raw = _Ends(page)
    until = _nested_ends(page, raw) if _MAY_NEST.search(page) else {}
    in_head = False

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                hints = frozenset().union(*[o.hints for o in stack]) if stack else frozenset()
                out.append(Block(text, state["linked"], tuple(o.tag for o in stack), hints, state["links"]))
            parts.clear()
        state["links"] = state["linked"] = 0

    for m in _TAG.finditer(page):
        if m.start() < skip:
            continue
        if not hidden and not in_head and m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                state["linked"] += len(piece)
        at = max(at, m.end())
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if hidden:
            if closing and tag == hidden:
                hidden = ""
            continue
        if in_head and (tag in ("head", "body", "html") if closing else tag not in IN_HEAD):
            in_head = False
        if tag == "head":
            in_head = not closing and raw.after("head", at) is not None
            continue
        if tag in NESTED:
            at = skip = max(at, until.get(m.start(), 0))
            continue
        if tag in HIDDEN:
            if not closing and not rest.rstrip().endswith("/"):
                hidden = tag
                if raw.after(tag, at) is None:
                    hidden, at = "", (len(page) if tag in ("script", "style", "title") else at)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            state["links"] += not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if tag in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                in_link = 0
                continue
            ends = CLOSES.get(tag, frozenset())
            if stack and (stack[-1].tag in ends or (stack[-1].tag == "p" and tag in NO_P)):
                stack.pop()
            named = " ".join(x.strip("\"'") for x in _NAMED.findall(rest)) if rest else ""
            hints = frozenset(_HINT[w] for w in _WORDS.findall(named.lower()) if w in _HINT) if named else frozenset()
            stack.append(_Open(tag, hints))
    if not hidden and at < len(page):
        parts.append(page[at:])
    flush()
    return out


N_FEATURES = len(HINTS) + len(_TAGS) + len(_OWN) + 12


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: ancestors, hints, own element, text and links, place in the page."""
    out = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        row = out[i]
        for h in b.hints:
            row[h] = 1
        k = len(HINTS)
        for j, t in enumerate(_TAGS):
            row[k + j] = t in b.tags
        k += len(_TAGS)
        if b.tags and b.tags[-1] in _OWN:
            row[k + _OWN.index(b.tags[-1])] = 1
        k += len(_OWN)
        n = len(b.text)
        words = b.text.count(" ") + 1
        row[k : k + 12] = (
            np.log1p(n), np.log1p(words), min(1.0, b.linked / n), min(b.links, 5), b.text[-1] in ".!?…。", sum(map(b.text.count, ".,;:")) / words,
            "©" in b.text or "(c)" in b.text.lower(), b.text[:1].isupper(), i / len(blocks), b.linked >= 0.8 * n, "|" in b.text or "›" in b.text or "»" in b.text, "?" in b.text,
        )
    return out


def page_samples(n: int, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Made pages of many layouts, and for each block of them in order whether it belongs to the article."""
    rnd = random.Random(seed)
    syllables = ["an", "er", "on", "the", "tion", "re", "es", "in", "la", "de", "que", "ung", "zu", "ment", "le", "os", "ar", "ing", "st", "é", "ß", "ñ", "ra", "to"]

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def say(lo: int, hi: int, stop: bool = True) -> str:
        words = [word() + (rnd.choice([",", ".", ",", ";"]) if rnd.random() < 0.1 else "") for _ in range(rnd.randint(lo, hi))]
        noise = rnd.random()
        if noise < 0.04:
            words = [w + rnd.choice(["%%%", "$$$", "***", "###", "&amp;&amp;"]) for w in words]
        elif noise < 0.08:
            words = [w.upper() + "!!" for w in words]
        elif noise < 0.12:
            words = [words[0]] * rnd.randint(3, 30)
        elif noise < 0.15:
            words = [x for w in words for x in (w, "|")][:-1] or words
        return " ".join(words).capitalize() + ("." if stop and rnd.random() < 0.85 else "")

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    pages = []
    for _ in range(n):
        marks: list[bool] = []

        def block(body: str, good: bool, marks: list[bool] = marks) -> str:
            marks.append(good)
            return body

        def named(tag: str, names: list[str]) -> str:
            kind = rnd.random()
            name = rnd.choice(names)
            return f"<{tag}>" if kind < 0.15 else f'<{tag} class="{name}{rnd.choice(["", "", " box", "-wrap", " c1"])}">' if kind < 0.75 else f'<{tag} id="{name}">'

        def menu(tag: str) -> str:
            items = "".join("<li>" + block(link(say(1, 3, False)), False) + "</li>" for _ in range(rnd.randint(1, 8)))
            return f"<ul>{items}</ul>" if tag == "ul" else f"<{tag}><ul>{items}</ul></{tag}>" if tag == "nav" else named(tag, ["nav", "menu", "navbar", "breadcrumb"]) + f"<ul>{items}</ul></{tag}>"

        def paragraph(good: bool) -> str:
            text = say(1, 6) if rnd.random() < 0.2 else say(6, 120)
            kind = rnd.random()
            if kind < 0.12:
                parts = text.split(" ")
                k = rnd.randrange(len(parts))
                parts[k] = link(parts[k])
                text = " ".join(parts)
            elif kind < 0.24:
                return f"<p><b>{block(text, good)}<br>"
            elif kind < 0.3:
                return f"<p>{block(text, good)}"
            elif kind < 0.34:
                return f"<div>{block(text, good)}</div>"
            return f"<p>{block(text, good)}</p>"

        def article() -> str:
            out = [f"<h1>{block(say(1, 10, False), True)}</h1>"] if rnd.random() < 0.85 else []
            for _ in range(rnd.randint(1, 14)):
                kind = rnd.random()
                if kind < 0.78:
                    out.append(paragraph(True))
                elif kind < 0.84:
                    out.append(f"<h2>{block(say(1, 6, False), True)}</h2>")
                elif kind < 0.9:
                    out.append("<ul>" + "".join(f"<li>{block(say(1, 14), True)}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>")
                elif kind < 0.94:
                    out.append(f"<blockquote>{block(say(4, 40), True)}</blockquote>")
                elif kind < 0.97:
                    out.append("<table>" + "".join("<tr>" + "".join(f"<td>{block(say(1, 3, False), True)}</td>" for _ in range(2)) + "</tr>" for _ in range(rnd.randint(1, 3))) + "</table>")
                else:
                    out.append(advert())
            return "".join(out)

        def advert() -> str:
            body = say(3, 40)
            return named("div", ["ad", "advert", "promo", "sponsored", "ads"]) + (f"<p>{block(body, False)}</p>" if rnd.random() < 0.4 else block(body, False)) + "</div>"

        def notice() -> str:
            return named("div", ["cookie", "consent", "notice", "gdpr", "popup", "alert"]) + f"<p>{block(say(4, 30), False)}</p><button>{block(say(1, 2, False), False)}</button></div>"

        def side() -> str:
            tag = rnd.choice(["aside", "aside", "div"])
            inner = "".join(f"<p>{block(say(3, 40), False)}</p>" if rnd.random() < 0.5 else f"<li>{block(link(say(1, 6, False)), False)}</li>" for _ in range(rnd.randint(1, 6)))
            return (f"<{tag}>" if tag == "aside" and rnd.random() < 0.5 else named(tag, ["sidebar", "related", "widget", "side"])) + f"<h3>{block(say(1, 4, False), False)}</h3>{inner}</{tag}>"

        def talk() -> str:
            tag = rnd.choice(["section", "div", "ol"])
            inner = "".join(f"<{k}>{block(say(2, 60), False)}</{k}>" for k in [rnd.choice(["p", "li", "div"])] * rnd.randint(1, 6))
            return f'<{tag} {rnd.choice(["class", "id"])}="{rnd.choice(["comments", "replies", "discussion", "comment-list"])}"><h3>{block(say(1, 3, False), False)}</h3>{inner}</{tag}>'

        def form() -> str:
            return f'<form action="/{word()}"><label>{block(say(1, 3, False), False)}</label><input name="q"><button>{block(say(1, 1, False), False)}</button></form>'

        def foot() -> str:
            text = rnd.choice(["&copy; ", "", "Copyright "]) + word() + ".example.com" + rnd.choice([" &middot; ", " | ", " "]) + say(3, 25)
            return f"<footer>{block(text, False)}</footer>" if rnd.random() < 0.7 else f'<div class="{rnd.choice(["footer", "foot", "bottom"])}"><p>{block(text, False)}</p></div>'

        def head() -> str:
            return f"<header>{block(say(1, 6, False), False)}</header>" if rnd.random() < 0.6 else f'<div class="{rnd.choice(["header", "masthead", "banner"])}"><h2>{block(say(1, 5, False), False)}</h2></div>'

        def bar() -> str:
            return "<p>" + block(rnd.choice([" | ", " &middot; ", " "]).join(link(say(1, 2, False)) for _ in range(rnd.randint(2, 6))), False) + "</p>"

        bare = rnd.random() < 0.12  # an old page: paragraphs stand in the body itself
        parts = (bar, lambda: menu("ul"), advert) if bare else (head, lambda: menu(rnd.choice(["nav", "nav", "div"])), notice, advert, side, form)
        before = [f() for f in parts if rnd.random() < (0.3 if bare else 0.45)]
        kind = rnd.random()
        opening, closing = ("<article>", "</article>") if kind < 0.55 else ("<main>", "</main>") if kind < 0.7 else (f'<div class="{rnd.choice(["content", "post", "entry-content", "article-body", "story"])}">', "</div>")
        if bare:
            opening, closing = rnd.choice([("", ""), ("", ""), ("<center>", "</center>"), ("<table><tr><td>", "</td></tr></table>")])
        body = opening + article() + closing
        after = [f() for f in ((bar, advert, foot, bar) if bare else (talk, side, advert, form, lambda: menu("nav"), notice, foot, bar)) if rnd.random() < 0.4]
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", marks))
    return pages


def train(n: int = TRAIN_PAGES, seed: int = 7) -> ChainCRF:
    """The CRF of n made pages; the same arguments give the same model."""
    xs, ys, sizes = [], [], [0]
    for page, marks in page_samples(n, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(marks):
            continue
        xs.append(features(blocks))
        ys += marks
        sizes.append(sizes[-1] + len(marks))
    return fit(np.concatenate(xs), np.array(ys, np.int64), np.array(sizes), rounds=120)


_models: dict[int, ChainCRF] = {}


def model(n: int = TRAIN_PAGES) -> ChainCRF:
    if n not in _models:
        _models[n] = train(n)
    return _models[n]


def extract_pages(pages: list[str | None], crf: ChainCRF) -> list[str]:
    """Main texts of a batch of pages."""
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    offsets = np.r_[0, np.cumsum([len(b) for b in blocks])]
    flat = [b for page in blocks for b in page]
    if not flat:
        return [""] * len(pages)
    label = crf.viterbi(np.concatenate([features(b) for b in blocks if b]), offsets)
    return ["\n".join(b.text for b, y in zip(page, label[a:e], strict=True) if y) for page, a, e in zip(blocks, offsets[:-1], offsets[1:], strict=True)]


def extract(pages: DataFrame, crf: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    prepare(pages.sparkSession)
    crf = crf or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract_pages(batch.column(2).to_pylist(), crf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)
