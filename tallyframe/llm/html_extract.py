"""Main text of web pages: a recurrent labeller decides block by block, reading the whole page both ways.

Each block is a vector: the mean of the vectors of its hashed tag-path tokens (tags and words of classes, ids
and roles of all open elements), the mean of those of its hashed words, and a few numbers. Two
long short-term memories in numpy, one from each end, give every block the context of the document; a logistic unit
tells main text from the rest.

The labeller is trained on a bounded sample of pages: as they are, labelled by the elements that
the markup itself names, and rebuilt from their paragraphs with menus, sidebars, notices, adverts, forms, comments
and wrappers of many names around them, where the label of each block is known.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.html_blocks import Block, blocks
from tallyframe.llm.sampling import thinned

SAMPLE_PAGES = 300
# Bytes of all pages that are trained on; where pages are so large that this is too little, fewer are drawn, one at least.
SAMPLE_BYTES = 32 * 1024 * 1024
# A training page with more blocks gives its start, its end and a part from anywhere, of so many blocks each.
WINDOW_BLOCKS = 120
REBUILT = 4  # rebuilt pages for each sampled one
BUCKETS = 4096
PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN = 20, 8, 4, 24
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
EPOCHS, BATCH, RATE = 8, 32, 0.01
# Blocks that are labelled at a time, over all pages of a batch; a longer page is labelled alone.
BLOCKS_AT_A_TIME = 8192

# Names that pages give to their parts.
MAIN_NAMES = "article content main post entry story body text article-body post-content entry-content main-content".split()
NOISE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb main-menu top-nav links".split(),
    "header": "header masthead banner site-header top logo".split(),
    "footer": "footer site-footer bottom copyright legal foot".split(),
    "aside": "sidebar aside widget related rail side-bar recommended trending more-stories".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsbox sponsor".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup subscribe-notice message warning".split(),
    "form": "newsletter signup search-form login contact-form subscribe".split(),
    "comments": "comments comment reader-comments discussion replies comment-list responses disqus".split(),
    "share": "share social tools byline meta tags author-box".split(),
}
_NOISE_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div"], "ad": ["div", "aside", "section"],
               "notice": ["div", "section", "aside"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
_NOISE_ELEMENTS = set("nav header footer aside form button select label dialog menu".split())
_NOISE_WORDS = {w for names in NOISE_NAMES.values() for name in names for w in name.split("-")} - set(MAIN_NAMES) - set("body text top bottom more links message side bar box list main site author meta tags".split())


def named_main(page: list[Block]) -> np.ndarray:
    """Labels from what the markup names: inside an article or main element, if there is one, and in no part that is named as noise."""

    def noise(block: Block) -> bool:
        inside = False
        for e in block.path:
            inside = inside or e.tag in ("article", "main")
            if (e.tag in _NOISE_ELEMENTS and not (e.tag == "header" and inside)) or any(t in _NOISE_WORDS for t in e.tokens[1:]):
                return True
        return False

    main = [any(e.tag in ("article", "main") for e in b.path) for b in page]
    return np.array([(m or not any(main)) and not noise(b) for b, m in zip(page, main)], bool)


def rebuilt(paragraphs: list[str], others: list[str], rng: random.Random) -> str:
    """A page around the given paragraphs; main text is marked ``data-mark=1`` and all else ``data-mark=0``."""

    def name(names: list[str]) -> str:
        chosen = rng.choice(names)
        if rng.random() < 0.3:
            chosen = "".join(w.title() if i else w for i, w in enumerate(chosen.split("-")))
        chosen = f"{rng.choice(['c', 'js', 'site', 'page', 'x'])}-{chosen}" if rng.random() < 0.15 else chosen
        return rng.choice([f' class="{chosen}"', f' id="{chosen}"', f" class='{chosen} wide'", f' class="{chosen}" role="x"'])

    def words(low: int, high: int) -> str:
        return escape(" ".join(rng.choice(others).split()[: rng.randint(low, high)]))

    def noise(kind: str) -> str:
        tag = rng.choice(_NOISE_TAGS[kind])
        attributes = name(NOISE_NAMES[kind])
        if tag in ("nav", "footer", "aside", "header", "form") and rng.random() < 0.4:
            attributes = ""
        inner = []
        for _ in range(rng.randint(1, 6)):
            if kind in ("nav", "share") or rng.random() < 0.2:
                inner.append(f'<li><a href="/x">{words(1, 4)}</a></li>')
            elif kind == "form":
                inner.append(rng.choice([f"<label>{words(1, 4)}</label><input>", f"<p>{words(3, 20)}</p>", f"<button>{words(1, 3)}</button>"]))
            elif kind == "comments":
                inner.append(rng.choice([f"<li><p>{words(3, 60)}</p></li>", f'<div class="comment"><b>{words(1, 2)}</b><p>{words(3, 60)}</p></div>', f"<p>{words(3, 60)}</p>"]))
            else:
                inner.append(rng.choice([f"<p>{words(3, 40)}</p>", words(3, 40) + "<br>", f"<h3>{words(2, 6)}</h3>", f"<div>{words(3, 30)}</div>", f'<a href="#">{words(2, 8)}</a>']))
        return f'<{tag}{attributes} data-mark="0">{"".join(inner)}</{tag}>'

    def some(kinds: list[str], chance: float) -> str:
        return "".join(noise(k) for k in kinds if rng.random() < chance)

    body = []
    for i, text in enumerate(paragraphs):
        raw = escape(text)
        if i == 0 and rng.random() < 0.8:
            body.append(f"<h1>{escape(text[:60])}</h1>")
        shape = rng.random()
        if shape < 0.6:
            body.append(f"<p>{raw}" + ("</p>" if rng.random() < 0.8 else ""))
        elif shape < 0.7:
            body.append(f"<p><b>{raw}<br>")
        elif shape < 0.78:
            body.append(f"<blockquote><p>{raw}</p></blockquote>")
        elif shape < 0.86:
            half = len(text) // 2
            body.append(f"<ul><li>{escape(text[:half])}</li><li>{escape(text[half:])}</li></ul>")
        elif shape < 0.92:
            body.append(f"<h2>{escape(text[:50])}</h2><p>{raw}</p>")
        else:
            body.append(f"<div>{raw}</div>")
        if rng.random() < 0.08:
            body.append(noise(rng.choice(["ad", "form", "share", "aside", "notice"])))
    form = rng.random()
    if form < 0.35:
        main = f'<article data-mark="1">{"".join(body)}</article>'
    elif form < 0.5:
        main = f'<main data-mark="1">{"".join(body)}</main>'
    elif form < 0.9:
        main = f'<{(t := rng.choice(["div", "section", "article", "main"]))}{name(MAIN_NAMES)} data-mark="1">{"".join(body)}</{t}>'
    else:
        main = f'<div data-mark="1">{"".join(body)}</div>'
    main += some(["comments"], 0.4)
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        main = f"<div{name(['wrap', 'container', 'row', 'page', 'layout', 'inner'])}>{some(['aside', 'ad'], 0.3)}{main}{some(['aside', 'share'], 0.3)}</div>"
    before, after = some(["notice", "header", "nav", "ad"], 0.5), some(["comments", "aside", "form", "notice", "footer"], 0.5)
    return f"<html><body>{before}{main}{after}</body></html>"


def marked(page: list[Block]) -> np.ndarray:
    """Labels of a rebuilt page: those of the nearest marked element."""
    return np.array([next((e.mark for e in reversed(b.path) if e.mark is not None), "0") == "1" for b in page], bool)


@dataclass
class Pages:
    """Hashed tokens and numbers of the blocks of some pages, one after the other."""

    path_ids: np.ndarray
    path_starts: np.ndarray
    word_ids: np.ndarray
    word_starts: np.ndarray
    numbers: np.ndarray
    lengths: list[int]


class Vectoriser:
    """Remembers words and paths that come again, up to a bound on what it holds."""

    # Words of up to so many characters, and tokens of paths, a token of a long name counting for several.
    LIMIT = 200_000
    LENGTH = 40

    def __init__(self):
        self.words: dict[str, int] = {}
        self.paths: dict[tuple, list[int]] = {}
        self.path_tokens = 0

    def _word(self, word: str) -> int:
        code = zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS
        if len(word) <= self.LENGTH:
            if len(self.words) >= self.LIMIT:
                self.words.clear()
            self.words[word] = code
        return code

    def _path(self, path: tuple) -> list[int]:
        key = tuple(e.tokens for e in path)
        if key in self.paths:
            return self.paths[key]
        tokens = [t for tokens in key for t in tokens] + [f"{a[0]}>{b[0]}" for a, b in zip(key, key[1:])] or ["-"]
        codes = [zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in tokens]
        size = sum(1 + len(t) // self.LENGTH for t in tokens)
        if self.path_tokens + size > self.LIMIT:
            self.paths.clear()
            self.path_tokens = 0
        if size <= self.LIMIT:
            self.paths[key] = codes
            self.path_tokens += size
        return codes

    def __call__(self, pages: list[list[Block]]) -> Pages:
        path_ids, path_starts, word_ids, word_starts, numbers = [], [], [], [], []
        known = self.words
        for page in pages:
            for block in page:
                path_starts.append(len(path_ids))
                path_ids += self._path(block.path)
                word_starts.append(len(word_ids))
                words = block.text.split()
                word_ids += [known[w] if w in known else self._word(w) for w in words]
                ends = block.text[-1] in ".!?:;\"'”»)"
                numbers.append((np.log1p(len(words)) / 4, block.link_chars / len(block.text), ends, 1.0))
        as_array = lambda x: np.array(x, np.int64)
        return Pages(as_array(path_ids), as_array(path_starts), as_array(word_ids), as_array(word_starts), np.array(numbers, np.float32).reshape(-1, NUMBERS), [len(p) for p in pages])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _means(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(starts, len(ids))).astype(np.float32)
    return np.add.reduceat(table[ids], starts, 0) / sizes[:, None], sizes


def _padded(flat: np.ndarray, lengths: list[int]) -> np.ndarray:
    out = np.zeros((len(lengths), max(lengths), flat.shape[1]), np.float32)
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _reversed(x: np.ndarray, lengths: list[int]) -> np.ndarray:
    out = np.zeros_like(x)
    for i, n in enumerate(lengths):
        out[i, :n] = x[i, :n][::-1]
    return out


def _lstm(x: np.ndarray, w: np.ndarray, bias: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (pages, blocks, HIDDEN) of one direction; with ``keep`` also what the way back needs."""
    h = c = np.zeros((len(x), HIDDEN), np.float32)
    from_input, states, steps = x @ w[:INPUT] + bias, np.empty((*x.shape[:2], HIDDEN), np.float32), []
    recurrent = w[INPUT:]
    for t in range(x.shape[1]):
        gates = from_input[:, t] + h @ recurrent
        i, f, o = np.split(_sigmoid(gates[:, : 3 * HIDDEN]), 3, 1)
        g = np.tanh(gates[:, 3 * HIDDEN :])
        before_h, before_c = h, c
        c = f * c + i * g
        tanh_c = np.tanh(c)
        h = o * tanh_c
        states[:, t] = h
        if keep:
            steps.append((i, f, o, g, before_h, before_c, tanh_c))
    return states, steps


def _lstm_back(x: np.ndarray, w: np.ndarray, steps: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input, the weights and the bias."""
    d_gates = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
    d_recurrent = np.zeros_like(w[INPUT:])
    d_h = d_c = np.zeros((len(x), HIDDEN), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, before_h, before_c, tanh_c = steps[t]
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * (1 - tanh_c**2)
        d = np.concatenate((d_c * g * i * (1 - i), d_c * before_c * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g**2)), 1)
        d_gates[:, t] = d
        d_recurrent += before_h.T @ d
        d_h = d @ w[INPUT:].T
        d_c = d_c * f
    flat = d_gates.reshape(-1, 4 * HIDDEN)
    d_w = np.concatenate((x.reshape(-1, INPUT).T @ flat, d_recurrent))
    return d_gates @ w[:INPUT].T, d_w, flat.sum(0)


class Labeller:
    """The weights by name, and the way from pages to the odds of each block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls) -> Labeller:
        r = np.random.default_rng(3)
        shapes = {
            "path": (BUCKETS, PATH_SIZE), "word": (BUCKETS, WORD_SIZE), "ahead": (INPUT + HIDDEN, 4 * HIDDEN),
            "back": (INPUT + HIDDEN, 4 * HIDDEN), "ahead_bias": (4 * HIDDEN,), "back_bias": (4 * HIDDEN,), "out": (2 * HIDDEN, 1), "out_bias": (1,),
        }
        w = {k: (r.standard_normal(s) * (0.3 if k in ("path", "word") else 0.15)).astype(np.float32) for k, s in shapes.items()}
        for k in ("ahead_bias", "back_bias"):
            w[k][:] = 0
            w[k][HIDDEN : 2 * HIDDEN] = 1
        return cls(w)

    def run(self, pages: Pages, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Odds (as logarithms) of the blocks, one after the other; every page has at least one block."""
        path, path_sizes = _means(self.w["path"], pages.path_ids, pages.path_starts)
        word, word_sizes = _means(self.w["word"], pages.word_ids, pages.word_starts)
        x = _padded(np.concatenate((path, word, pages.numbers), 1), pages.lengths)
        y = _reversed(x, pages.lengths)
        ahead, steps = _lstm(x, self.w["ahead"], self.w["ahead_bias"], keep)
        back, back_steps = _lstm(y, self.w["back"], self.w["back_bias"], keep)
        states = np.concatenate((ahead, _reversed(back, pages.lengths)), 2)
        odds = (states @ self.w["out"] + self.w["out_bias"])[..., 0]
        flat = np.concatenate([odds[i, :n] for i, n in enumerate(pages.lengths)])
        return flat, (x, y, steps, back_steps, states, path_sizes, word_sizes)

    def gradients(self, pages: Pages, labels: np.ndarray) -> dict[str, np.ndarray]:
        odds, (x, y, steps, back_steps, states, path_sizes, word_sizes) = self.run(pages, keep=True)
        d_odds = _padded(((_sigmoid(odds) - labels) / len(labels))[:, None].astype(np.float32), pages.lengths)
        g = {"out": states.reshape(-1, 2 * HIDDEN).T @ d_odds.reshape(-1, 1), "out_bias": d_odds.sum((0, 1))}
        d_states = d_odds @ self.w["out"].T
        d_x, g["ahead"], g["ahead_bias"] = _lstm_back(x, self.w["ahead"], steps, d_states[..., :HIDDEN])
        d_y, g["back"], g["back_bias"] = _lstm_back(y, self.w["back"], back_steps, _reversed(d_states[..., HIDDEN:], pages.lengths))
        d_x = d_x + _reversed(d_y, pages.lengths)
        flat = np.concatenate([d_x[i, :n] for i, n in enumerate(pages.lengths)])
        for name, ids, sizes, part in (
            ("path", pages.path_ids, path_sizes, flat[:, :PATH_SIZE]),
            ("word", pages.word_ids, word_sizes, flat[:, PATH_SIZE : PATH_SIZE + WORD_SIZE]),
        ):
            each = (part / sizes[:, None]).astype(np.float64)
            blocks_of = np.repeat(np.arange(len(sizes)), sizes.astype(int))
            g[name] = np.stack([np.bincount(ids, each[blocks_of, d], BUCKETS) for d in range(each.shape[1])], 1).astype(np.float32)
        return g

    def main_text(self, pages: list[list[Block]], vectoriser: Vectoriser) -> list[str]:
        """Main text of each page: its blocks that are more likely main text than not, joined by line breaks."""
        texts = [""] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            group = [order.pop()]  # the longest pages first, with those that fit beside them
            while order and (len(group) + 1) * len(pages[group[0]]) <= BLOCKS_AT_A_TIME:
                group.append(order.pop())
            odds, _ = self.run(vectoriser([pages[i] for i in group]))
            at = 0
            for i in group:
                texts[i] = "\n".join(b.text for b, odd in zip(pages[i], odds[at : at + len(pages[i])]) if odd > 0)
                at += len(pages[i])
        return texts


def windows(page: list[Block], labels: np.ndarray, size: int, rng: random.Random) -> list[tuple[list[Block], np.ndarray]]:
    """The page with its labels; of one with more than ``size`` blocks the start, the end and a part from anywhere."""
    if len(page) <= size:
        return [(page, labels)]
    last = len(page) - size
    return [(page[at : at + size], labels[at : at + size]) for at in sorted({0, rng.randint(0, last), last})]


def train(sample: list[str], window_blocks: int = WINDOW_BLOCKS) -> Labeller:
    """A labeller from sampled pages; without any block to learn from, one that was not trained."""
    rng = random.Random(17)
    real = [p for p in map(blocks, sample) if p]
    cases = [(p, named_main(p)) for p in real]
    paragraphs = [[b.text for b, main in zip(p, labels) if main and b.path and b.path[-1].tag != "h1"] for p, labels in cases]
    paragraphs = [p for p in paragraphs if p]
    others = [t for p in paragraphs for t in p]
    for texts in paragraphs:
        for _ in range(REBUILT):
            page = blocks(rebuilt(texts[: rng.randint(1, 30)], others, rng))
            cases.append((page, marked(page)))
    parts = random.Random(29)
    cases = [part for p, y in cases for part in windows(p, y, window_blocks, parts)]
    labeller = Labeller.fresh()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in labeller.w.items()}
    vectoriser, step = Vectoriser(), 0
    for epoch in range(EPOCHS):
        # Pages of like length make a batch, in random order.
        cases.sort(key=lambda c: len(c[0]) + 4 * rng.random())
        starts = list(range(0, len(cases), BATCH))
        rng.shuffle(starts)
        for at in starts:
            batch = cases[at : at + BATCH]
            step += 1
            g = labeller.gradients(vectoriser([p for p, _ in batch]), np.concatenate([y for _, y in batch]))
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, (m, v) in moments.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                labeller.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return labeller


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES, window_blocks: int = WINDOW_BLOCKS) -> Labeller:
    """A labeller from the ``sample_pages`` pages that come first by hash, whatever their size.

    Only so many of them are taken as have ``sample_bytes`` together, but one at least. A page of more than
    ``window_blocks`` blocks is learned by its start, its end and a part from anywhere.
    """
    keys = ["place", "page_id", "url"]
    known = pages.where("html IS NOT NULL").select(F.xxhash64("page_id", "url").alias("place"), "page_id", "url", "html")
    few = thinned(known, sample_pages, known.count(), "page_id", "url")
    sizes = few.groupBy(keys).agg(F.octet_length(F.min("html")).alias("size")).orderBy(keys).limit(sample_pages).collect()
    if not sizes:
        return train([], window_blocks)
    upto = np.cumsum([r["size"] for r in sizes])
    last = sizes[max(0, int(np.searchsorted(upto, sample_bytes, "right")) - 1)]["place"]
    chosen = few.where(F.col("place") <= last).groupBy(keys).agg(F.min("html").alias("html")).select("place", "html").collect()
    return train([r["html"] for r in sorted(chosen)], window_blocks)


def main_texts(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    ``text`` is the page's main text, ``n_chars`` its number of code points. A null, empty or textless
    page has an empty text. Repeated rows get equal results; other columns do not matter.
    """

    @F.pandas_udf("string")
    def extracted(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectoriser = Vectoriser()
        for series in html:
            out: list[str] = []
            for at in range(0, len(series), 256):
                out += labeller.main_text([blocks(h) for h in series[at : at + 256]], vectoriser)
            yield pd.Series(out, dtype=object)

    return pages.select("page_id", "url", extracted("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
