"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks. A block's vector holds its tag path with class and id words (hashed, the
nearer ancestors apart), the hashed words of its whole text, and a few figures such as length and share of link text.
A bidirectional LSTM in numpy reads the whole sequence and labels each block as main text or not. It is trained on
pages that a seeded generator lays out in many ways, with known labels; ``TRAINING_PAGES`` bounds that set. Training
takes seconds on the driver, the weights have a fixed size, and labelling is a map over the rows. A page of more than
``STEPS`` blocks is read in pieces, with the network's state carried from one to the next, and labelled the same.

Defined results: NULL or empty html, or a page without main text, gives an empty text. Markup that is cut off or
unclosed is read as far as it goes. Rows that repeat are extracted each for itself. Other columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.bilstm import BiLstm
from lumenlex.llm.htmlblocks import leaf_blocks

TAGS, NEAR, WORDS, FIGURES = 96, 48, 32, 8
FEATURES = TAGS + NEAR + WORDS + FIGURES
TRAINING_PAGES, HIDDEN, EPOCHS, RATE, SEED, THRESHOLD = 900, 16, 8, 0.01, 5, 0.5
STEPS = 30_000
WORD = re.compile(r"\w+")


class _Slots(dict):
    def __init__(self, size: int):
        self.size = size

    def __missing__(self, key: str) -> int:
        slot = zlib.crc32(key.encode("utf-8", "replace")) % self.size
        if len(self) < 300_000:
            self[key] = slot
        return slot


_TAG, _NEAR, _WORD = _Slots(TAGS), _Slots(NEAR), _Slots(WORDS)


def features(blocks: list[tuple[tuple[str, ...], str, float]], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each of these blocks of a page, which start at ``first`` of its ``total`` blocks."""
    total = total or len(blocks)
    x = np.zeros((len(blocks), FEATURES), np.float32)
    before: dict[tuple[str, ...], np.ndarray] = {}
    for row, (path, text, linked) in enumerate(blocks):
        head = before.get(path)
        if head is None:
            head = np.zeros(TAGS + NEAR, np.float32)
            for name in path:
                head[_TAG[name]] = 1
            for name in path[-3:]:
                head[TAGS + _NEAR[name]] = 1
            before[path] = head
        x[row, : TAGS + NEAR] = head
        words = WORD.findall(text.lower())
        n = len(words)
        if n:
            x[row, TAGS + NEAR : -FIGURES] = np.bincount([_WORD[w] for w in words], minlength=WORDS) / n
        stops = text.count(".") + text.count(",")
        ends, place = text[-1:] in ".!?", (first + row) / total
        x[row, -FIGURES:] = (
            min(n, 200) / 100, np.log1p(len(text)) / 8, linked, min(1, stops / (n + 1) * 4), ends, "©" in text, place, len(path) / 10,
        )
    return x


# ---- training pages: words of a seeded generator in layouts of known labels
KINDS = {
    "menu": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "links", "tabs"),
    "header": ("header", "masthead", "top", "site-header", "branding", "logo"),
    "footer": ("footer", "copyright", "bottom", "legal", "site-footer", "colophon"),
    "side": ("sidebar", "side", "aside", "related", "widget", "tags", "recommended", "popular", "archive", "author-box"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "banner", "popup", "modal", "alert", "overlay"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "affiliate"),
    "form": ("newsletter", "subscribe", "login", "search", "signup", "contact-form", "share", "social"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "respond", "disqus", "comment-body"),
}
HOMES = ("content", "post", "entry", "article", "article-body", "story", "post-content", "entry-content", "text", "body-text", "page-content", "main")
TAG_OF = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
CUES = {
    "menu": "home about contact news archive login help", "header": "welcome official site blog", "footer": "copyright rights reserved privacy terms imprint",
    "side": "related popular recent more tags follow", "notice": "we use cookies accept consent settings agree", "ad": "sponsored advertisement buy now offer sale deal",
    "form": "email subscribe search name password send sign up", "comments": "reply says comment posted agree thanks ago",
}


class Pages:
    """Seeded pages as (html, labels of the leaf blocks)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, of):
        return of[int(self.r.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        return "".join(self.pick(("the", "er", "on", "an", "re", "ing", "le", "que", "ung", "ch", "ci", "os", "la", "ti", "é", "ö", "ñ", "st", "in")) for _ in range(int(self.r.integers(1, 5))))

    def words(self, low: int, high: int, cue: str = "") -> str:
        out = [self.word() for _ in range(int(self.r.integers(low, high)))]
        if cue and self.chance(0.5):
            out[: len(out) // 2] = [self.pick(cue.split()) for _ in out[: len(out) // 2]]
        for i in range(len(out)):
            if self.chance(0.12):
                out[i] += self.pick((",", ".", "***", "!!", "&amp;"))
        return " ".join(out)

    def sentence(self, low: int = 3, high: int = 60) -> str:
        return self.words(low, high).capitalize() + self.pick((".", ".", ".", "!", "?", "", "$$$", "%%%"))

    def open(self, kind: str) -> tuple[str, str]:
        names = KINDS[kind]
        tag = TAG_OF[kind] if kind in TAG_OF and self.chance(0.6) else self.pick(("div", "div", "section", "ul") if kind == "menu" else ("div", "div", "section"))
        attr = f' {self.pick(("class", "class", "id"))}="{self.pick(names)}{self.pick(("", "", " box", " wide", "-1"))}"' if tag in ("div", "section", "ul") or self.chance(0.4) else ""
        return f"<{tag}{attr}>", f"</{tag}>"

    def boilerplate(self, kind: str) -> tuple[str, list[int]]:
        start, end = self.open(kind)
        cue, labels, inner = CUES[kind], [], ""
        if kind == "menu" or kind in ("side", "footer") and self.chance(0.4):
            n = int(self.r.integers(2, 9))
            items = "".join(f'<li><a href="/{i}">{self.words(1, 4, cue)}</a></li>' for i in range(n))
            inner, labels = (items if start.startswith("<ul") else f"<ul>{items}</ul>"), [0] * n
        elif kind == "form":
            inner, labels = f"<p>{self.words(2, 9, cue)}</p><label>{self.words(1, 3, cue)}</label><input name=q><button>{self.words(1, 3, cue)}</button>", [0, 0, 0]
        elif kind == "comments":
            n = int(self.r.integers(1, 6))
            inner, labels = f"<h3>{self.words(1, 4, cue)}</h3>", [0]
            for _ in range(n):
                inner += f'<div class="comment"><p>{self.sentence()}</p></div>' if self.chance(0.6) else f"<p>{self.sentence()}</p>"
                labels.append(0)
        else:
            n = int(self.r.integers(1, 4))
            for _ in range(n):
                text = self.words(2, 14, cue) if self.chance(0.5) else self.sentence(3, 25)
                inner += self.pick((f"<p>{text}</p>", f"<div>{text}</div>", f"<p>{text}</p>", f"<h3>{text}</h3>")) if n > 1 or self.chance(0.4) else text
                labels.append(0)
        if kind == "footer" and self.chance(0.5):
            inner, labels = f"&copy; {self.words(1, 4)} &middot; {self.sentence(2, 12)}", [0]
        return start + inner + end, labels

    def article(self) -> tuple[str, list[int]]:
        out, labels = "", []
        if self.chance(0.8):
            out, labels = f"<h1>{self.words(1, 12).capitalize()}</h1>", [1]
        for _ in range(int(self.r.integers(1, 14))):
            roll = self.r.random()
            if roll < 0.68:
                out += f"<p>{self.sentence(1, 120)}" + ("</p>" if self.chance(0.85) else "")
                labels.append(1)
            elif roll < 0.74:
                out += f"<p><b>{self.sentence(2, 12)}<br>"
                labels.append(1)
            elif roll < 0.82:
                out += f"<h2>{self.words(1, 7)}</h2>"
                labels.append(1)
            elif roll < 0.88:
                n = int(self.r.integers(1, 5))
                out += "<ul>" + "".join(f"<li>{self.sentence(2, 25)}</li>" for _ in range(n)) + "</ul>"
                labels += [1] * n
            elif roll < 0.92:
                out += f"<{(t := self.pick(('blockquote', 'pre')))}>{self.sentence(3, 40)}</{t}>"
                labels.append(1)
            else:
                more, zeros = self.boilerplate(self.pick(("ad", "form", "side", "ad")))
                out, labels = out + more, labels + zeros
        home = self.pick(("<article>", "<article>", "<main>", "<main><article>", "<div>", "named", "named", "named"))
        if home == "named":
            home = f'<{self.pick(("div", "div", "section", "article"))} {self.pick(("class", "id"))}="{self.pick(HOMES)}">'
        ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", home)))
        return home + out + ends, labels

    def page(self) -> tuple[str, list[int]]:
        parts: list[tuple[str, list[int]]] = []
        for kind, p in (("notice", 0.2), ("header", 0.35), ("menu", 0.8), ("notice", 0.1), ("ad", 0.45), ("side", 0.2)):
            if self.chance(p):
                parts.append(self.boilerplate(kind))
        parts.append(self.article())
        for kind, p in (("ad", 0.2), ("comments", 0.35), ("form", 0.25), ("side", 0.35), ("menu", 0.15), ("footer", 0.8), ("notice", 0.15)):
            if self.chance(p):
                parts.append(self.boilerplate(kind))
        title = self.words(1, 9)
        html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + "".join(h for h, _ in parts)
        return html + self.pick(("</body></html>", "</body></html>", "")), [0] + [x for _, labels in parts for x in labels]


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    out, mask = np.zeros((steps, len(xs), FEATURES)), np.zeros((steps, len(xs)), bool)
    for i, x in enumerate(xs):
        out[: len(x), i], mask[: len(x), i] = x, True
    return out, mask


def labelled(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    made, out = Pages(seed), []
    while len(out) < n:
        html, labels = made.page()
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels):  # a drawn word may vanish
            out.append((features(blocks), np.array(labels)))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLstm:
    model, data, batches = BiLstm(FEATURES, HIDDEN, seed), sorted(labelled(pages, seed), key=lambda d: len(d[1])), []
    for i in range(0, len(data), 30):
        x, mask = padded([d[0] for d in data[i : i + 30]])
        y = np.zeros(mask.shape)
        for j, d in enumerate(data[i : i + 30]):
            y[: len(d[1]), j] = d[1]
        batches.append((x, mask, y))
    model.fit(batches, epochs, RATE, seed)
    return model


def main_texts(pages: list[str | None], model: BiLstm) -> list[str]:
    """The main text of each page; pages of like length are labelled together."""
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
    at = 0
    while order and len(blocks[order[-1]]) > STEPS:  # a page alone is longer than a batch may be: piece by piece
        i = order.pop()
        part = lambda low, high, i=i: features(blocks[i][low:high], low, len(blocks[i]))
        chance = model.predict_long(part, len(blocks[i]), STEPS)
        out[i] = "\n\n".join(text for (_, text, _), p in zip(blocks[i], chance, strict=True) if p > THRESHOLD)
    while at < len(order):
        # As many pages as keep the padded batch within STEPS steps.
        end = at + 1
        while end < len(order) and len(blocks[order[end]]) * (end + 1 - at) <= STEPS:
            end += 1
        batch = order[at:end]
        chance = model.predict(*padded([features(blocks[i]) for i in batch]))
        for column, i in enumerate(batch):
            out[i] = "\n\n".join(text for (_, text, _), p in zip(blocks[i], chance[:, column], strict=False) if p > THRESHOLD)
        at = end
    return out


def extract(pages: DataFrame, model: BiLstm | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of column html as column out."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts: list[str] = []
            for i in range(0, len(b), 256):
                texts += main_texts(b.slice(i, 256).to_pylist(), shared.value)
            yield pa.array(texts, pa.string())

    return pages.withColumn(out, F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(html))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: page_id, url, text, n_chars for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
