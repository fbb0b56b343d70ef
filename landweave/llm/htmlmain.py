"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A leaf block is the text between two block tags. Its features are its ancestors' tags and the words of
their class, id and role names, the landmark it lies in, and the length, links, ending and marks of its
text. Two labels, main text or not, with weights for each feature and each pair of neighbouring labels;
the weights are the regularised maximum of the conditional likelihood, the labels Viterbi's.

It is trained on pages that label themselves: blocks inside ``article`` (or ``main``, where a page has no
article) are main text, those in landmarks of other kinds are not. That alone would teach the tags and
nothing else, so each is also set anew in other layouts, with its own blocks as main text and blocks of
other pages as menus, notices, adverts, comments and so on, under tags and names of ``LAYOUTS`` or under
none. A fixed number of pages of made-up words is added, so that a table without labels has a model too.
The sample is bounded: ``labelled`` distinct pages of at most ``page_chars`` characters, least hash first.

Cases: null and empty html, and pages without main text, have an empty text; cut pages end their open
elements at the end, comments and scripts that never end take the rest; unknown references stay as they
are; repeated rows are repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, PAGE_CHARS, VARIANTS, FILLERS = 200, 16_384, 3, 60

# Element names.
_BLOCK = set(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
_EMPTY = set("area base br col embed frame hr img input link meta param source track wbr".split())
_DROPPED = set("iframe noembed noframes script style textarea title xmp".split())
_LANDMARKS = set("article main nav aside footer header form dialog noscript".split())
_ENDS_ITSELF = set("dd dt li option td th tr".split())
# Usual names of the parts of a page, as tag and attribute.
LAYOUTS = {
    "article": ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'section class="article-body"', 'div class="story"', 'div itemprop="articleBody"', 'div role="main"', 'div class="text"', "div", "section", 'article class="post"', 'div class="page-content"'],
    "menu": ["nav", 'div class="menu"', 'div id="navbar"', 'div class="navigation"', 'div class="breadcrumbs"', 'div class="top-links"', 'div role="navigation"', 'ul class="main-nav"', 'div class="tabs"', 'div class="pagination"', "ul", "ul", "div"],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div class="branding"', 'div role="banner"', 'div class="topbar"', 'div class="tagline"'],
    "footer": ["footer", 'div class="footer"', 'div id="bottom"', 'div class="copyright"', 'div role="contentinfo"', 'div class="site-footer"', 'div class="legal"', 'div id="colophon"', "div"],
    "sidebar": ["aside", 'div class="sidebar"', 'div class="widget"', 'div id="right-column"', 'div class="related"', 'div class="popular-posts"', 'div role="complementary"', 'section class="recommended"', 'div class="teaser"', 'div id="secondary"', 'div class="author-bio"'],
    "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="gdpr-banner"', 'div class="alert"', 'div class="popup"', 'div class="newsletter"', 'div class="modal"', "dialog", 'div role="alert"', 'div class="notification"', "noscript", 'div class="notice"', 'div class="paywall"', 'div class="disclaimer"', 'div class="cookies"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div class="ad-slot"', 'ins class="adsbygoogle"', 'div id="banner"', 'div class="promotion"', 'section class="sponsor"', 'aside class="ad"'],
    "form": ["form", 'form class="search"', 'div class="search-box"', 'form id="login"', 'div class="subscribe"', 'form class="contact"', 'div class="signup"', "form"],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="replies"', 'div id="disqus_thread"', 'div class="discussion"', 'div class="responses"', 'div class="user-comments"', 'article class="comment"', 'section id="reader-comments"', 'div class="feedback"'],
    "share": ['div class="share"', 'div class="social"', 'div class="toolbar"', 'ul class="share-buttons"', 'div class="tags"', 'div class="meta"'],
}
_INNER = ["div", 'div class="inner"', 'div class="row"', 'div class="column"', 'div class="block"']
# Marks in texts.
_MARKS = ("©", "|", "»", "@", "http", "cookie", "copyright", "all rights reserved", "privacy", "subscribe", "newsletter", "advert", "sponsored", "sign in", "log in", "share", "comment", "reply", "menu", "search", "skip to")

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>?|!--|[!?/])""")
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GOLD = re.compile(r'data-gold="([01])"')
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _DROPPED}


@dataclass
class Leaf:
    text: str
    features: list[str]
    gold: int | None


def _names(attributes: str) -> list[str]:
    """Words of class, id and role names, and their first six letters."""
    out = []
    for m in _NAMES.finditer(attributes):
        for w in _WORD.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            w = w[:-1] if len(w) > 2 and w.endswith("s") else w
            out += [w] if len(w) < 6 else [w, w[:6] + "-"]
    return out


def _text_features(text: str, linked: int) -> list[str]:
    words, low = text.count(" ") + 1, text.lower()
    return [f"words {min(words.bit_length(), 7)}", f"links {-(-3 * min(linked, len(text)) // len(text))}", "stops" if text[-1] in ".!?…" else "runs on"] + [f"mark {m}" for m in _MARKS if m in low]


class _Page:
    """The open elements of a page while it is read, and the features that they give to the leaves in them."""

    def __init__(self, known):
        self.known, self.leaves = known, []
        self.open, self.count, self.active = [], {}, {}
        self.landmarks, self.gold, self.named = ["none"], [None], [[]]
        self.parts, self.linked, self.link = [], 0, False

    def say(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            self.parts.append(text)
            if self.link:
                self.linked += len(text)

    def end_leaf(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                own = self.open[-1][0] if self.open else "none"
                features = [*self.active, *_text_features(text, self.linked), f"in {own}", f"near {self.landmarks[-1]}", *self.named[-1]]
                self.leaves.append(Leaf(text, features, self.gold[-1]))
            self.parts, self.linked = [], 0

    def push(self, tag: str, attributes: str, marked: bool) -> None:
        kind = "header in article" if tag == "header" and self.gold[-1] == 1 and not marked or tag == "header" and "article" in self.count else tag
        names = [] if tag in ("html", "body") or not attributes else _names(attributes)
        features = [f"under {kind}"] + [f"name {n}" for n in names]
        if self.known is not None:
            features = [f for f in features if f in self.known]
        for f in features:
            self.active[f] = self.active.get(f, 0) + 1
        gold = _GOLD.search(attributes) if marked else None
        if gold:
            self.gold.append(int(gold[1]))
        elif tag in _LANDMARKS:
            self.gold.append(self.gold[-1] if kind == "header in article" else int(tag in ("article", "main")))
        if tag in _LANDMARKS:
            self.landmarks.append(kind)
        if names:
            own = [f"own {n}" for n in names]
            self.named.append(own if self.known is None else [f for f in own if f in self.known])
        self.open.append((tag, features, bool(gold) or tag in _LANDMARKS, bool(names)))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        tag, features, gold, named = self.open.pop()
        for f in features:
            if self.active[f] == 1:
                del self.active[f]
            else:
                self.active[f] -= 1
        if gold:
            self.gold.pop()
        if tag in _LANDMARKS:
            self.landmarks.pop()
        if named:
            self.named.pop()
        if self.count[tag] == 1:
            del self.count[tag]
        else:
            self.count[tag] -= 1
        return tag


def leaves(page: str | None, known=None, marked: bool = False) -> list[Leaf]:
    """Leaf blocks in page order. ``known`` keeps the features of ancestors to a model's own, ``marked`` reads gold labels of layouts."""
    state, page = _Page(known), page or ""
    at, tag = 0, _TAG.search(page)
    while tag:
        state.say(page[at : tag.start()])
        at, name = tag.end(), tag[2]
        if name is None:
            mark = tag[0]
            close = page.find("-->", tag.start() + 2) if mark == "<!--" else page.find(">", at)
            if close < 0:
                at = len(page)
                break
            at = close + (3 if mark == "<!--" else 1)
        else:
            name = name.lower()
            if name in _DROPPED:
                if not tag[1]:
                    end = _CLOSING[name].search(page, at)
                    if end is None:
                        at = len(page)
                        break
                    at = end.start()
            elif name == "br":
                state.parts.append(" ")
            elif name == "a":
                state.link = not tag[1]
            elif name in _BLOCK or name == "ins" and "class" in tag[3]:
                state.end_leaf()
                if not tag[1]:
                    if state.open and state.open[-1][0] == "p":
                        state.pop()
                    if state.open and name in _ENDS_ITSELF and state.open[-1][0] == name:
                        state.pop()
                    if name not in _EMPTY:
                        state.push(name, tag[3], marked)
                else:
                    state.link = False
                    if name in state.count:
                        while state.pop() != name:
                            pass
            elif tag[1] and name in state.count:
                state.end_leaf()
                while state.pop() != name:
                    pass
        tag = _TAG.search(page, at)
    state.say(page[at:])
    state.end_leaf()
    return state.leaves


def gold_labels(found: list[Leaf]) -> list[int]:
    return [int(leaf.gold == 1) for leaf in found]


# Layouts


def _opened(kind: str, rng, gold: int) -> tuple[str, str]:
    choice = LAYOUTS[kind][rng.integers(len(LAYOUTS[kind]))]
    return f'<{choice} data-gold="{gold}">', f"</{choice.split()[0]}>"


def _prose(texts: list[str], rng, most: int = 60) -> str:
    words = texts[rng.integers(len(texts))].split()
    return entities.escape(" ".join(words[: 1 + int(rng.integers(min(len(words), most)))]))


def _boilerplate(kind: str, texts: list[str], rng) -> str:
    start, end = _opened(kind, rng, 0)
    short = lambda: _prose(texts, rng, 4)
    if kind in ("menu", "share") or kind in ("sidebar", "footer") and rng.random() < 0.5:
        inner = "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.integers(2, 7))) + "</ul>"
    elif kind == "form":
        inner = f'<label>{short()}</label><input name="q">' + (f"<select><option>{short()}<option>{short()}</select>" if rng.random() < 0.3 else "") + f"<button>{short()}</button>"
    elif kind == "comments":
        inner = "".join(f'<div class="comment"><p>{_prose(texts, rng)}</p></div>' if rng.random() < 0.4 else f"<p>{_prose(texts, rng)}</p>" for _ in range(rng.integers(1, 5)))
        inner = (f"<h3>{short()}</h3>" if rng.random() < 0.5 else "") + inner
    elif kind == "footer":
        inner = ("&copy; " if rng.random() < 0.6 else "") + _prose(texts, rng, 12)
    else:
        inner = _prose(texts, rng, 25)
        inner = inner if rng.random() < 0.5 else f"<p>{inner}</p>"
    return start + inner + end


def _body(texts: list[str], rng) -> list[str]:
    out = [f"<h1>{entities.escape(texts[0])}</h1>"]
    for t in texts[1:]:
        t, r = entities.escape(t), rng.random()
        if r < 0.08:
            out.append("<ul>" + "".join(f"<li>{w}</li>" for w in t.split()[:4]) + f"<li>{t}</li></ul>")
        elif r < 0.12:
            out.append(f"<table><tr><td>{t}</td><td>{t.split()[0]}</td></tr></table>")
        elif r < 0.3:
            out.append(rng.choice(["<blockquote>{}</blockquote>", "<h2>{}</h2>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<div>{}</div>", '<p>{} <a href="/y">{}</a></p>', '<p><a href="/y">{}</a></p>']).replace("{}", t))
        else:
            out.append(f"<p>{t}</p>")
    return out


def in_layout(texts: list[str], other: list[str], rng) -> str:
    """A page with ``texts`` as its article and texts of ``other`` in the parts around and in it, gold labels marked."""
    start, end = _opened("article", rng, 1)
    body = _body(texts, rng)
    if start.startswith("<article") and rng.random() < 0.2:
        body[0] = f'<header data-gold="1">{body[0]}</header>'
    for kind in ("advert", "sidebar", "notice", "form", "share", "menu", "comments"):
        if rng.random() < 0.35:
            body.insert(len(body) if kind == "comments" else int(rng.integers(1, len(body) + 1)), _boilerplate(kind, other, rng))
    if rng.random() < 0.3:
        body = [f"<{rng.choice(_INNER)}>", *body, "</div>"]
    before = [_boilerplate(k, other, rng) for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [_boilerplate(k, other, rng) for k in ("share", "comments", "advert", "sidebar", "form", "notice", "footer") if rng.random() < 0.5]
    page = "".join([*before, start, *body, end, *after])
    if rng.random() < 0.5:
        page = f'<div id="{rng.choice(["page", "wrapper", "container", "site"])}">{page}</div>'
    return f"<html><body>{page}</body></html>"


def _made_up(rng) -> list[str]:
    """Texts of one made-up page."""
    word = lambda: "".join(rng.choice(list("abcdeghiklmnoprstu"), rng.integers(1, 9)))
    return [" ".join(word() for _ in range(rng.integers(2, 9)))] + [" ".join(word() for _ in range(rng.integers(1, 60))) + "." for _ in range(rng.integers(1, 9))]


# Model


class Chain:
    """Weights of features for label 1 against label 0, of label pairs, and of the first label."""

    def __init__(self, names: list[str], weights: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = dict(zip(names, weights.tolist())), pairs, first

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the labels of greatest total weight; ties go to label 0."""
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b, back = float(self.first[0]), float(self.first[1]) + scores[0], []
        for s in scores[1:]:
            a0, a1, b0, b1 = a + p00, b + p10, a + p01, b + p11
            back.append((a1 > a0, b1 > b0))
            a, b = max(a0, a1), max(b0, b1) + s
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _likelihood(theta: np.ndarray, data, penalty: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood and its gradient, by forward and backward sums over all pages at once."""
    at, which, gold, position, page, size, m = data
    w, pairs, first = theta[:m], theta[m : m + 4].reshape(2, 2), theta[m + 4 :]
    score = np.bincount(at, weights=w[which], minlength=len(gold))
    n, most = len(size), int(size.max())
    emit = np.zeros((most, n, 2))
    emit[position, page, 1] = score
    alpha, beta = np.zeros((most, n, 2)), np.zeros((most, n, 2))
    alpha[0] = first + emit[0]
    for t in range(1, most):
        alpha[t] = np.logaddexp(alpha[t - 1, :, :1] + pairs[0], alpha[t - 1, :, 1:] + pairs[1]) + emit[t]
    for t in range(most - 2, -1, -1):
        ahead = beta[t + 1] + emit[t + 1]
        beta[t] = np.where((t + 1 < size)[:, None], np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1]), 0)
    total = np.logaddexp(*alpha[size - 1, np.arange(n)].T)
    inside = np.arange(most)[:, None] < size
    chance = np.exp(np.minimum(alpha + beta - total[:, None], 0)) * inside[..., None]
    grad = np.zeros_like(theta)
    grad[:m] = np.bincount(which, weights=(chance[position, page, 1] - gold)[at], minlength=m)
    grad[m + 4 :] = chance[0].sum(0)
    both = np.exp(np.minimum(alpha[:-1, :, :, None] + pairs + (beta + emit)[1:, :, None, :] - total[:, None, None], 0)) * inside[1:, :, None, None]
    grad[m : m + 4] = both.sum((0, 1)).ravel()
    starts = position == 0
    follow = np.flatnonzero(~starts)
    seen_pairs = np.bincount(2 * gold[follow - 1] + gold[follow], minlength=4)
    seen_first = np.bincount(gold[starts], minlength=2)
    grad[m : m + 4] -= seen_pairs
    grad[m + 4 :] -= seen_first
    value = total.sum() - score[gold == 1].sum() - (seen_pairs * pairs.ravel()).sum() - (seen_first * first).sum()
    return value + penalty * (theta @ theta) / 2, grad + penalty * theta


def _minimum(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps."""
    value, grad = f(x)
    past = []
    for _ in range(steps):
        d, coefficients = grad.copy(), []
        for s, y in reversed(past):
            coefficients.append(s @ d / (s @ y))
            d -= coefficients[-1] * y
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum())
        for (s, y), c in zip(past, reversed(coefficients)):
            d += (c - y @ d / (s @ y)) * s
        step = 1.0
        while True:
            new = x - step * d
            v, g = f(new)
            if v <= value - 1e-4 * step * (grad @ d) or step < 1e-9:
                break
            step /= 2
        if (new - x) @ (g - grad) > 1e-12:
            past = [*past, (new - x, g - grad)][-memory:]
        done = value - v < 1e-7 * abs(value)
        x, value, grad = new, v, g
        if done:
            break
    return x


def _arrays(pages: list[tuple[list[Leaf], list[int]]], number: dict[str, int]) -> tuple:
    blocks = [sorted({number[f] for f in leaf.features}) for found, _ in pages for leaf in found]
    size = np.array([len(found) for found, _ in pages])
    at = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    position = np.concatenate([np.arange(n) for n in size])
    gold = np.array([y for _, labels in pages for y in labels])
    page = np.searchsorted(np.cumsum(size), np.arange(len(blocks)), "right")
    return at, np.array([i for b in blocks for i in b]), gold, position, page, size, len(number)


def train(pages: list[tuple[list[Leaf], list[int]]], penalty: float = 0.1, steps: int = 100) -> Chain:
    """The chain fitted to blocks with labels, page by page."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for found, _ in pages for leaf in found for f in leaf.features})
    number = {f: i for i, f in enumerate(names)}
    groups: dict[int, list] = {}
    for p in pages:
        # Pages of like length are worked on together.
        groups.setdefault(len(p[0]).bit_length(), []).append(p)
    data = [_arrays(groups[k], number) for k in sorted(groups)]

    def objective(theta):
        parts = [_likelihood(theta, d, penalty / len(data)) for d in data]
        return sum(v for v, _ in parts), sum(g for _, g in parts)

    x = _minimum(objective, np.zeros(len(names) + 6), steps)
    return Chain(names, x[: len(names)], x[len(names) : len(names) + 4].reshape(2, 2), x[len(names) + 4 :])


def examples(pages: list[str], variants: int = VARIANTS, fillers: int = FILLERS, seed: int = 11) -> list[tuple[list[Leaf], list[int]]]:
    """Blocks and labels of pages that label themselves, and of their layouts."""
    rng, out, articles = np.random.default_rng(seed), [], []
    for page in pages:
        found = leaves(page)
        out.append((found, gold_labels(found)))
        texts = [leaf.text for leaf in found if leaf.gold == 1]
        if texts:
            articles.append(texts)
    articles += [_made_up(rng) for _ in range(fillers)]
    other = [t for texts in articles for t in texts]
    for i, texts in enumerate(articles):
        for _ in range(variants if i < len(articles) - fillers else 2 * variants):
            found = leaves(in_layout(texts, other, rng), marked=True)
            out.append((found, gold_labels(found)))
    return out


def sample(pages: DataFrame, html_col: str = "html", labelled: int = LABELLED, page_chars: int = PAGE_CHARS) -> list[str]:
    """The training pages: of those with an article or main element, ``labelled`` distinct ones of bounded size by least hash."""
    text = F.col(html_col)
    some = pages.where(text.rlike(r"(?i)<(article|main)[\s>]") & (F.char_length(text) <= page_chars)).select(text.alias("html"), F.xxhash64(text).alias("h"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(labelled).collect()]
    chosen = some.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html"))
    return [r.html for r in chosen.orderBy("h").collect()]


def fit(pages: DataFrame, html_col: str = "html", labelled: int = LABELLED, page_chars: int = PAGE_CHARS) -> Chain:
    return train(examples(sample(pages, html_col, labelled, page_chars)))


def extract_page(model: Chain, page: str | None) -> list[str]:
    """The main blocks of one page."""
    found = leaves(page, model.weights)
    return [leaf.text for leaf, y in zip(found, model.decode([model.score(leaf.features) for leaf in found])) if y]


def extract(pages: DataFrame, model: Chain, html_col: str = "html", out_col: str = "blocks") -> DataFrame:
    """``pages`` without their html, with the main blocks of each page in page order."""
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*kept, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = pa.array([extract_page(shared.value, h.as_py()) for h in b.column(len(kept))], pa.list_(pa.string()))
            yield pa.record_batch([*b.columns[: len(kept)], found], names=[*kept, out_col])

    return rows.mapInArrow(run, rows.drop(html_col).withColumn(out_col, F.array().cast("array<string>")).schema)


def digest(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    text = F.array_join("blocks", "\n\n")
    return extract(pages, fit(pages)).select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


#: The gold labels in SQL, for pages whose article element has headings and paragraphs with line breaks only: what the model has to find.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM a),
t AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&')) AS parts FROM b),
w AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS parts FROM t),
j AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM w)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM j
"""
