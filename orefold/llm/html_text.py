"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 8)."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm.common import text_batches

# Elements by their part in a page's layout.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head template object svg math canvas audio video datalist".split())
RAW = set("script style title noscript iframe textarea xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Ancestors that an end tag or an implied end tag may not reach past.
WALLS = {"table", "ul", "ol", "dl", "select"}

FEATURES = 1 << 14
SEED, PAGES, STEPS = 5, 900, 90


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int  # code points inside links


_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"""(?>[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')|[="'])*+""")
#: Outermost and innermost ancestors that describe a block, of a path deeper than both.
OUTER = 64
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS, _HUMP = re.compile(r"[a-z]+"), re.compile(r"([a-z])([A-Z])")


@lru_cache(maxsize=1 << 14)
def _named(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, id, role and label."""
    return tuple(_WORDS.findall(_HUMP.sub(r"\1 \2", " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))).lower()))


class Tags:
    """The tags of a page, in order, each found from where the last one ended, in time linear in the page.

    A tag ends at the first ">" outside quoted values. Where quotes leave a tag open to the end of the page, this and all
    later tags end at the first ">" of any kind; without one the rest of the page is text.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def after(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, it is an end tag, name, attributes) of the first tag from ``at`` on; comments and declarations have no name."""
        m = _OPEN.search(self.page, at)
        if m is None:
            return None
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = self.page.find(mark, m.end())
            return m.start(), len(self.page) if end < 0 else end + len(mark), False, None, ""
        end = _ATTRIBUTES.match(self.page, m.end()).end() if self.quotes else len(self.page)
        if end == len(self.page):
            self.quotes, end = False, self.page.find(">", m.end())
        return None if end < 0 else (m.start(), end + 1, bool(m[1]), m[2].lower(), self.page[m.end(): end])


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order: runs of text between the tags of block elements.

    Tags may be missing or crossed: a paragraph ends where the next block begins, list items and cells where the next
    one does, an end tag closes what is open inside its element, and stray ones are ignored. Elements of raw content run
    to their own end tag, or to the end of the page. Of a path deeper than 2 * OUTER the middle is left out.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    hidden: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal parts, links, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = stack if len(stack) <= 2 * OUTER else stack[:OUTER] + stack[-OUTER:]
                found.append(Block(text, tuple(path), linked))
            parts = []
        links = linked = 0

    def say(data: str) -> None:
        nonlocal linked
        if data and not hidden:
            data = html.unescape(data) if "&" in data else data
            parts.append(data)
            linked += len(data) if links else 0

    tags, opened = Tags(page), Counter()

    def cut_stack(i: int) -> None:
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]

    def push(tag: str, attributes: str) -> None:
        stack.append((tag, _named(attributes) if attributes else ()))
        opened[tag] += 1

    while found_tag := tags.after(at):
        start, end, closing, tag, attributes = found_tag
        say(page[at: start])
        at = end
        if tag is None:
            continue
        if tag in RAW and not closing:
            until = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = until.end() if until else len(page)
            if not hidden:
                parts.append(" ")
        elif tag == "body" and not closing:
            hidden = []  # a head that was never ended ends here
            flush()
            push(tag, attributes)
        elif hidden:
            if tag == hidden[-1]:
                hidden.pop() if closing else hidden.append(tag)
        elif tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag == "hr":
            flush()
        elif tag in VOID:
            if tag in ("br", "img", "input"):
                parts.append(" ")
        elif tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                hidden.append(tag)
        elif tag in BLOCKS:
            flush()
            if closing:
                if opened[tag]:
                    cut_stack(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            else:
                if stack and stack[-1][0] == "p":
                    cut_stack(len(stack) - 1)
                if any(opened[t] for t in CLOSES.get(tag, ())):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in CLOSES[tag]:
                            cut_stack(i)
                            break
                        if stack[i][0] in WALLS:
                            break
                push(tag, attributes)
    say(page[at:])
    flush()
    return found


def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) % FEATURES


_slot = lru_cache(maxsize=1 << 16)(_slot)
_CUES = re.compile(r"©|\(c\)|copyright|rights reserved|cookies?|subscribe|newsletter|advert\w*|sponsored|log ?in|sign ?(?:in|up)|repl(?:y|ies)|comments?|share|read more|privacy|terms|related|search|menu")


@lru_cache(maxsize=1 << 14)
def _place(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    """Feature slots of a block's ancestors: tags, names, and the way down from the article, main or body."""
    tags = [t for t, _ in path]
    names = {"bias", f"own={tags[-1] if tags else '-'}", f"depth={min(len(tags), 8)}"}
    for t, words in path:
        names |= {f"in={t}"} | {f"name={w}" for w in words} | {f"{t}.{w}" for w in words}
    for container in ("article", "main", "body"):
        if container in tags:
            inner = tags[len(tags) - tags[::-1].index(container):]
            names.add(f"under={container}:{'/'.join(inner[:2])}")
            break
    return tuple(sorted({_slot(x) for x in names}))


def describe(page: list[Block]) -> list[list[int]]:
    """Feature slots of each block: of its ancestors, and of the form of its text."""
    out = []
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        end = b.text[-1]
        names = [f"len={min(n.bit_length(), 8)}", f"link={round(4 * min(1, b.linked / len(b.text)))}", f"end={end if end in '.!?:,;…»”' else '-'}", f"first={i == 0}", f"last={i == len(page) - 1}"]
        if n <= 40:
            names += {f"cue={c}" for c in _CUES.findall(b.text.lower())[:8]}
        out.append([*_place(b.path), *{_slot(x) for x in names}])
    return out


# --------------------------------------------------------------------------- labelled pages

def labelled_pages(count: int, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Invented pages with their main blocks: varied layouts, names, languages and broken markup around an article."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghlmnprstvz") + rng.choice("aeiouéüñ" if rng.random() < 0.1 else "aeiou") for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(k: int) -> str:
        return " ".join(phrase(3, 16).capitalize() + rng.choice([".", ".", ".", "!", "?", "".join(rng.choices("%#*~@$^|", k=3)), ""]) for _ in range(k))

    pick = lambda *x: rng.choice(x)
    named = lambda *x: pick(f' class="{pick(*x)}"', f' id="{pick(*x)}"', f' class="{pick(*x)} {word()}"')

    def aside_parts() -> dict:
        links = lambda n: "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(n))
        return {
            "nav": lambda: pick(f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", f"<div{named('menu', 'nav', 'navbar', 'navigation', 'topnav', 'breadcrumb', 'breadcrumbs')}><ul>{links(4)}</ul></div>", f"<ul{named('menu', 'nav', 'tabs')}>{links(5)}</ul>", f'<div role="navigation">{"".join(f"<a href=/{word()}>{word()}</a> " for _ in range(5))}</div>'),
            "header": lambda: pick(f"<header><h1>{phrase(1, 3)}</h1><p>{phrase(2, 8)}</p></header>", f"<div{named('header', 'masthead', 'banner', 'topbar', 'site-header', 'logo')}>{phrase(1, 6)}</div>", f"<header><a href=/>{word()}</a></header>"),
            "ad": lambda: pick(f"<div{named('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'banner-ad', 'sponsor', 'sponsored', 'promo', 'promotion')}>{sentences(rng.randint(1, 3))}</div>", f"<aside{named('ad', 'promo')}><p>{sentences(1)}</p></aside>", f"<section{named('ad', 'sponsored', 'advertisement')}><p>{sentences(2)}</p></section>"),
            "sidebar": lambda: pick(f"<aside><h3>{phrase(1, 3)}</h3><p>{sentences(rng.randint(1, 4))}</p></aside>", f"<div{named('sidebar', 'widget', 'related', 'side', 'recommended', 'popular', 'trending', 'more')}><h3>{phrase(1, 4)}</h3><ul>{links(4)}</ul><p>{sentences(2)}</p></div>", f"<aside><ul>{links(5)}</ul></aside>"),
            "notice": lambda: pick(f"<div{named('cookie', 'cookies', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'overlay', 'paywall', 'message')}><p>{pick('We use cookies. ', '', 'Your privacy matters. ')}{sentences(rng.randint(1, 3))}</p><button>{word()}</button></div>", f"<dialog{pick('', ' open')}><p>{sentences(2)}</p></dialog>", f'<div role="alert">{sentences(1)}</div>', f"<section{named('notice', 'cookie', 'consent', 'disclaimer')}>{sentences(2)}</section>"),
            "form": lambda: f"<form{pick('', named('search', 'newsletter', 'subscribe', 'signup', 'login'))}><label>{phrase(1, 4)}</label><input name=q>{pick('', f'<p>{sentences(1)}</p>')}<select><option>{word()}</option><option>{word()}<option>{word()}</select><button>{word()}</button></form>",
            "letter": lambda: pick(f"<div{named('newsletter', 'newsletter-box', 'subscribe', 'subscribe-box', 'signup', 'signup-form', 'cta', 'call-to-action')}>{pick('', f'<h3>{phrase(1, 4)}</h3>')}<p>{pick('Subscribe to our newsletter. ', 'Sign up. ', '')}{sentences(1)}</p></div>", f"<section{named('newsletter', 'subscribe', 'cta')}><p>{sentences(1)}</p></section>"),
            "crumbs": lambda: pick(f"<p{named('breadcrumb', 'breadcrumbs', 'crumbs', 'path')}><a href=/>{word()}</a> &gt; <a href=/x>{word()}</a></p>", f"<div>{' | '.join(f'<a href=/{word()}>{word()}</a>' for _ in range(rng.randint(3, 7)))}</div>", f"<table><tr>{''.join(f'<td><a href=/{word()}>{word()}</a></td>' for _ in range(rng.randint(2, 6)))}</tr></table>"),
            "share": lambda: f"<div{named('share', 'social', 'tags', 'toolbar', 'pagination', 'pager', 'author-links')}>{''.join(f'<a href=#>{word()}</a> ' for _ in range(4))}</div>",
            "script": lambda: pick(f'<script>var a = "<p>{word()}</p>"; if (a < 3) track("{word()}");</script>', f"<style>p {{ color: {word()} }}</style>", f"<!-- {sentences(1)} <p>{word()}</p> -->", f"<noscript><p>{phrase(2, 5)}</p></noscript>"),
            "comments": lambda: pick(f"<section{named('comments', 'comment-list', 'discussion', 'responses', 'replies', 'disqus', 'user-comments')}><h2>{pick('Comments', phrase(1, 2))}</h2>" + "".join(pick(f"<div{named('comment', 'reply', 'comment-body')}><b>{word()}</b><p>{sentences(rng.randint(1, 5))}</p></div>", f"<article{named('comment')}><p>{sentences(2)}</p></article>", f"<p>{sentences(2)}</p>") for _ in range(rng.randint(1, 4))) + "</section>", f"<div{named('comments', 'comment-thread', 'reader-comments', 'responses')}><ol>" + "".join(f"<li{named('comment', 'reply')}><p>{sentences(rng.randint(1, 6))}</p></li>" for _ in range(3)) + "</ol></div>"),
            "footer": lambda: pick(f"<footer>{pick('&copy; ', '© ', '')}{phrase(1, 4)} &middot; {sentences(1)}</footer>", f"<footer><p>{sentences(2)}</p><ul>{links(3)}</ul></footer>", f"<div{named('footer', 'site-footer', 'bottom', 'copyright', 'colophon', 'legal')}><p>{pick('Copyright ', '')}{sentences(1)}</p></div>"),
        }

    def article() -> tuple[str, list[str]]:
        parts, kept = [], []

        def add(tag: str, text: str, close: bool = True, inner: str | None = None) -> None:
            parts.append(f"<{tag}>{inner or text}" + (f"</{tag.split()[0]}>" if close else ""))
            kept.append(" ".join(text.split()))

        if rng.random() < 0.9:
            add(pick("h1", "h1", "h2", 'h1 class="title"'), phrase(1, 10))
        for _ in range(rng.randint(1, 12) if rng.random() < 0.9 else 0):
            text, r = sentences(rng.randint(1, 8)), rng.random()
            if r < 0.6:
                add("p", text, rng.random() < 0.85)
            elif r < 0.7:
                add("p", text, False, f"<b>{text}<br>")
            elif r < 0.8:
                add(pick("h2", "h3"), phrase(1, 6))
            elif r < 0.87:
                add("p", text, True, f'{text[:20]}<a href="/{word()}">{text[20:]}</a>')
            elif r < 0.93:
                parts.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    add("li", phrase(2, 12) + pick(".", ""))
                parts.append("</ul>")
            elif r < 0.96:
                add("blockquote", text)
            else:
                parts.append("<table><tr>")
                for _ in range(rng.randint(2, 5)):
                    add("td", phrase(1, 4))
                parts.append("</tr></table>")
            if rng.random() < 0.12:
                make = aside_parts()
                parts.append(make[pick("ad", "share", "script", "form", "sidebar", "notice", "letter", "letter")]())
        if rng.random() < 0.2:
            parts.append(aside_parts()["comments"]())
        whole = rng.random()
        if whole < 0.3 and len(parts) > 1:  # parts in sections or plain boxes of their own
            tag, cuts = pick("section", "section", "div"), sorted(rng.sample(range(1, len(parts)), min(len(parts) - 1, rng.randint(1, 3))))
            inner = pick("", named("section", "part", "chapter", "text-block", "block", "row", "col", "inner", "group"))
            return "".join(f"<{tag}{inner}>{''.join(parts[a:b])}</{tag}>" for a, b in zip([0, *cuts], [*cuts, len(parts)])), kept
        return "".join(parts), kept

    out = []
    for _ in range(count):
        make, (body, kept) = aside_parts(), article()
        wrap = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{named('content', 'article', 'post', 'entry', 'main', 'story', 'post-body', 'article-body', 'text')}>", "</div>"), ('<div id="main"><div class="post">', "</div></div>"))
        if rng.random() < 0.35:
            wrap = pick(("<main><section>", "</section></main>"), ("<main>", "</main>"), (f"<section{named('content', 'post', 'article', 'story', 'body', 'page')}>", "</section>"), ("<section>", "</section>"), ("<div>", "</div>"), ('<div class="container"><div class="row"><div class="col">', "</div></div></div>"), ("", ""),
                        (f"<table><tr><td>{''.join(f'<a href=/{word()}>{word()}</a><br>' for _ in range(4))}</td><td>", "</td></tr></table>"), (f"<table><tr><td{named('content', 'main', 'body')}>", "</td></tr></table>"), (f"<div{named('page', 'wrapper', 'container')}><main{named('content', 'main')}><section><div>", "</div></section></main></div>"))
        before = [make[k]() for k in ("header", "notice", "nav", "script", "ad", "form", "sidebar", "crumbs", "letter") if rng.random() < 0.4]
        after = [make[k]() for k in ("share", "comments", "sidebar", "form", "ad", "script", "letter") if rng.random() < 0.36]
        if rng.random() < 0.85:
            after.append(make["footer"]())
        rng.shuffle(before)
        page = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{phrase(1, 6)}</title>{make['script']()}</head><body>{''.join(before)}{wrap[0]}{body}{wrap[1]}{''.join(after)}" + pick("</body></html>", "</body></html>", "")
        out.append((page, kept))
    return out


# --------------------------------------------------------------------------- the chain

@dataclass
class Chain:
    """Weights of (feature, label) and of (label, next label); label 1 is main text."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, page: list[list[int]]) -> list[int]:
        """The labels of most probability (Viterbi)."""
        if not page:
            return []
        starts = np.cumsum([0, *map(len, page[:-1])])
        emit = np.add.reduceat(self.weights[np.concatenate(page)], starts, axis=0).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        (x, y), back = emit[0], []
        for e0, e1 in emit[1:]:
            to0, to1 = x + s00 < y + s10, x + s01 < y + s11
            back.append((to0, to1))
            x, y = max(x + s00, y + s10) + e0, max(x + s01, y + s11) + e1
        labels = [int(y > x)]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS) -> Chain:
    """Maximum likelihood of the labels given the features, by Adam over all pages at once (forward and backward sums)."""
    pages = [p for p in pages if p[0]]
    most, n = max(len(p[0]) for p in pages), len(pages)
    live = np.zeros((n, most), dtype=bool)
    gold = np.zeros((n, most), dtype=np.int64)
    page_of, at, slot = [], [], []
    for i, (f, y) in enumerate(pages):
        live[i, : len(f)], gold[i, : len(f)] = True, y
        for t, slots in enumerate(f):
            page_of += [i] * len(slots)
            at += [t] * len(slots)
            slot += slots
    cell, slot = np.array(page_of) * most + np.array(at), np.array(slot)
    want_steps = np.zeros((2, 2))
    both = live[:, 1:]
    np.add.at(want_steps, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    w, s = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(s)], [np.zeros_like(w), np.zeros_like(s)]
    rows = np.arange(n)
    lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    for step in range(1, steps + 1):
        emit = np.stack([np.bincount(cell, w[slot, k], n * most) for k in (0, 1)], -1).reshape(n, most, 2)
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, most):
            fwd[:, t] = np.where(live[:, t, None], lse(fwd[:, t - 1, :, None] + s, 1) + emit[:, t], fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], lse(s[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t + 1])
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        diff = p.copy()
        diff[rows[:, None], np.arange(most), gold] -= live
        flat = diff.reshape(-1, 2)
        g_w = np.stack([np.bincount(slot, flat[cell, k], FEATURES) for k in (0, 1)], -1) / n + 1e-4 * w
        pair = np.exp(fwd[:, :-1, :, None] + s + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        g_s = (pair.sum((0, 1)) - want_steps) / n + 1e-4 * s
        for i, (x, g) in enumerate(((w, g_w), (s, g_s))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.05 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Chain(w, s)


def gold_labels(page: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are the main ones, in order."""
    out, i = [], 0
    for b in page:
        hit = i < len(main) and b.text == main[i]
        out.append(int(hit))
        i += hit
    return out


@lru_cache(maxsize=2)
def model(pages: int = PAGES, seed: int = SEED) -> Chain:
    """The chain fitted on ``pages`` labelled pages (seconds on the driver; the size doesn't depend on the corpus)."""
    parsed = [(blocks(h), kept) for h, kept in labelled_pages(pages, seed)]
    return train([(describe(b), gold_labels(b, kept)) for b, kept in parsed])


def main_text(source: str, chain: Chain) -> str:
    page = blocks(source)
    return "\n\n".join(b.text for b, y in zip(page, chain.decode(describe(page))) if y)


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the blocks that the chain labels main, joined by blank lines.

    Character references are decoded and white space inside a block is one space. Hidden elements (scripts, styles, heads) hold no blocks.
    Null, empty and text-free pages give an empty text; markup may be broken anywhere. Repeated rows give their rows;
    extra columns are not read; url is null where the table has none.
    """
    sent = spark.sparkContext.broadcast(chain or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, "html"):
                text = [main_text(h, sent.value) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
