"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between block-level tags, in page order, white space folded, references decoded.
A block is a vector: its path of tags, classes and ids hashed to `PATH` numbers, its words hashed to `WORDS`, and a few ratios.
A bidirectional LSTM in numpy reads the whole sequence both ways, so each block is judged with the page around it, and a logistic
unit says whether it is main text. Main blocks are joined by one space.

Learning, at the start of a run: at most `sample_pages` pages (those with the smallest hashes; a documented bound), of each a window of
at most `longest` blocks. Pages that mark their article teach by its elements: blocks in it are main, other blocks, and those under
elements named as boilerplate, are not. Each is seen several times, with blocks of boilerplate paths but any text put in, and with the
article renamed, so that paths the sample lacks are known too. If no sampled page marks an article, all blocks outside elements
named as boilerplate teach as main. Fixed seed; same input, same model.

Whole pages are read. Pages are judged in groups of at most `cells` padded blocks (a longer page alone), and their vectors are made
slice by slice, so memory follows the longest page's number of blocks by some hundred bytes each.

Null or empty html, or no main block: empty text; so is every text if no sampled page has a block. Repeated rows are extracted alike.
Empty table: no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import by_bytes, hash_share

PATH, WORDS, RATIOS = 96, 32, 6
DIM = PATH + WORDS + RATIOS

#: Comments, declarations, elements whose content is no text, and tags. An unclosed comment or script ends with the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(script|style|noscript|template|svg|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements without content, elements inside a line, elements closed by their own kind, and names of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
ARTICLE = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside form head title button select textarea dialog menu".split())
BOILER_NAMES = frozenset("ad ads advert advertisement banner sidebar menu nav navigation navbar footer header comment comments cookie cookies notice consent promo share social related newsletter popup modal breadcrumb breadcrumbs subscribe login search widget toolbar masthead disqus replies reply".split())
BOILER_PATHS = [
    "body nav ul li a", "body header h2", "body header .masthead p", "body footer p", "body footer", "body aside .sidebar p", "body .sidebar ul li", "body .sidebar p", "body .ad", "article .ad p", "body .advert",
    "body .cookie-notice p", "body .notice", "body #consent p", "body .banner", "body form label", "body form p", "article form", "body .comments p", "article .comments .comment p", "body #comments li p", "article section .comment-list li p",
    "article aside p", "article aside .related li a", "body .menu li a", "body #header p", "body #footer p", "body .newsletter p", "article .share a", "body .breadcrumb a", "main aside p", "main nav li a", "body .promo p", "body .popup p", "article .newsletter p", "body button", "body dialog p",
]
ARTICLE_PATHS = ["body article", "body main", "body main article", "body .content", "body .article", "body #content", "body #main", "body .post .entry-content", "body .article-body", "body .story", "body section article", "body .container article"]


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def attributes(tag: str, attrs: str) -> tuple[str, ...]:
    names = [tag]
    if "=" in attrs:
        for m in ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            mark = "#" if m[1].lower() == "id" else "."
            names += [mark + x for x in value.lower().split()]
    return tuple(names)


def blocks_of(page: str) -> list[Block]:
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    pieces: list[str] = []
    linked, in_link, past = 0, 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, tuple(x for tag, names in stack if tag not in INLINE for x in names), linked))
            pieces = []
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)

    for m in TOKEN.finditer(page):
        add(page[past : m.start()])
        past = m.end()
        tag = m[3]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag not in INLINE and tag != "br":
            flush()
        if tag == "br":
            add(" ")
        elif tag in VOID:
            continue
        elif closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            if tag in SELF_CLOSING:
                k = len(stack) - 1
                while k >= 0 and (stack[k][0] in INLINE):
                    k -= 1
                if k >= 0 and stack[k][0] == tag:
                    del stack[k:]
            if not m[4].endswith("/"):
                stack.append((tag, attributes(tag, m[4])))
        if tag == "a":
            in_link = int(not closing)
    add(page[past:])
    flush()
    return out


def bucket(name: str, n: int, cache: dict[str, tuple[int, float]]) -> tuple[int, float]:
    if name not in cache:
        h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
        cache[name] = (h >> 1) % n, 1.0 if h & 1 else -1.0
    return cache[name]


def path_names(path: tuple[str, ...]) -> list[str]:
    """Elements and names on the path, and the parts of compound names."""
    return [y for x in path for y in ([x] if x[0] not in ".#" else [x, *("." + z for z in re.split(r"[-_]", x[1:]) if z)])]


def vectors(blocks: list[Block], paths: dict, words: dict) -> np.ndarray:
    out = np.zeros((len(blocks), DIM), np.float32)
    for row, b in zip(out, blocks, strict=True):
        for name in dict.fromkeys(path_names(b.path)):
            i, sign = bucket(name, PATH, paths)
            row[i] += sign
        tokens = b.text.lower().split()
        at = np.array([bucket(w, WORDS, words)[0] for w in tokens])
        row[PATH : PATH + WORDS] = np.bincount(at, minlength=WORDS) / np.sqrt(len(tokens))
        n = len(b.text)
        row[PATH + WORDS :] = (np.log1p(n) / 5, min(1.0, b.linked / n), b.text[-1] in ".!?…", sum(map(b.text.count, ".,;:!?")) / n * 10, len(b.path) / 10, 1.0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output; weights in a dict, gates in the order input, forget, output, candidate."""

    def __init__(self, hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.15, (DIM, 4 * hidden))
            self.w["h" + d] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            self.w["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.w["out"], self.w["bias"] = rng.normal(0, 0.15, 2 * hidden), np.zeros(1)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """gates (time, page, 4 hidden): what the vectors give to the gates; mask (time, page). Padding leaves the state as it is."""
        steps, pages, n = len(gates), gates.shape[1], self.hidden
        h, c, out, past = np.zeros((pages, n)), np.zeros((pages, n)), np.zeros((steps, pages, n)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w["h" + d]
            s, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            c2 = f * c + i * g
            th = np.tanh(c2)
            m = mask[t][:, None]
            if keep:
                past.append((t, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out, past

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.w["x" + d] + self.w["c" + d]

    def judge(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        """Probability of main text of each block, from both directions' gates."""
        n = self.hidden
        logit = sum(self._run(gates[d], mask, d)[0] @ self.w["out"][k * n : (k + 1) * n] for k, d in enumerate("fb"))
        return sigmoid(logit + self.w["bias"])

    def _back(self, x: np.ndarray, d: str, past: list, grad: np.ndarray, into: dict) -> None:
        n = self.hidden
        dh, dc, dz_all = np.zeros_like(past[0][1]), np.zeros_like(past[0][1]), np.zeros((len(x), x.shape[1], 4 * n))
        for t, h, c, i, f, o, g, th, m in reversed(past):
            dh = dh + grad[t]
            dho = dh * m
            dct = dc * m + dho * o * (1 - th * th)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dho * th * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            into["h" + d] += h.T @ dz
            dh = dz @ self.w["h" + d].T + dh * (1 - m)
            dc = dct * f + dc * (1 - m)
        into["x" + d] += np.einsum("tpi,tpj->ij", x, dz_all)
        into["c" + d] += dz_all.sum(axis=(0, 1))

    def loss_gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        (hf, pf), (hb, pb) = (self._run(self.gates(x, d), mask, d, True) for d in "fb")
        both = np.concatenate([hf, hb], axis=2)
        p = sigmoid(both @ self.w["out"] + self.w["bias"])
        n = mask.sum()
        err = (p - y) * mask / n
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"], grads["bias"] = np.einsum("tp,tph->h", err, both), np.array([err.sum()])
        back = err[:, :, None] * self.w["out"]
        self._back(x, "f", pf, back[:, :, : self.hidden], grads)
        self._back(x, "b", pb, back[:, :, self.hidden :], grads)
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
        return float(loss), grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.02, seed: int = 7) -> float:
        rng = np.random.default_rng(seed)
        first, second = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}
        step, loss = 0, 0.0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
                x, mask = padded([pages[i][0] for i in some])
                y = padded([pages[i][1][:, None] for i in some])[0][:, :, 0]
                loss, grads = self.loss_gradient(x, mask, y)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return loss


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x, mask = np.zeros((longest, len(rows), rows[0].shape[1])), np.zeros((longest, len(rows)))
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def taught(blocks: list[Block], anywhere: bool = False) -> np.ndarray | None:
    """1 for main blocks, by the page's own elements; None if it marks no article. anywhere: no article element is asked for."""
    out = []
    for b in blocks:
        names = path_names(b.path)
        inside = anywhere or any(x in ARTICLE or x in (".articlebody", ".main") for x in names)
        boiler = any(x in BOILERPLATE or (x[0] in ".#" and x[1:] in BOILER_NAMES) for x in names) or ("header" in names and (anywhere or not inside))
        out.append(float(inside and not boiler))
    return np.array(out) if any(out) or (anywhere and out) else None


def examples(pages: list[str], times: int, seed: int = 7, longest: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    read = list(map(blocks_of, pages))
    parsed = [(b, y) for b in read if (y := taught(b)) is not None] or [(b, y) for b in read if (y := taught(b, anywhere=True)) is not None]
    texts = [b.text for bs, _ in parsed for b in bs[:longest]]
    out, caches = [], ({}, {})
    named = lambda path: ("html", *path.split())
    for bs, y in parsed:
        for k in range(times):
            rows = list(zip(bs, y, strict=True))
            if k:
                root = named(ARTICLE_PATHS[rng.integers(len(ARTICLE_PATHS))])
                cut = lambda p: next((i for i, x in enumerate(p) if x in ARTICLE), 0)
                rows = [(Block(b.text, (*root, *(x for x in b.path[cut(b.path) + 1 :])), b.linked), v) if v else (b, v) for b, v in rows]
                for _ in range(int(rng.integers(1, 6))):
                    path, n, at = named(BOILER_PATHS[rng.integers(len(BOILER_PATHS))]), int(rng.integers(1, 4)), int(rng.integers(len(rows) + 1))
                    rows[at:at] = [(Block(t, path, len(t) if path[-1] == "a" else 0), 0.0) for t in (texts[rng.integers(len(texts))] for _ in range(n))]
            start = int(rng.integers(max(1, len(rows) - longest + 1)))
            rows = rows[start : start + longest]
            out.append((vectors([b for b, _ in rows], *caches), np.array([v for _, v in rows])))
    return out


def learn(pages: DataFrame, sample_pages: int = 240, times: int = 4, epochs: int = 6) -> Labeller | None:
    """pages: (id, html). None if the sample has no block."""
    some = hash_share(pages.where(F.col("html").isNotNull()), ["id", "html"], 1.5 * sample_pages)
    rows = some.select(F.xxhash64("id").alias("h"), "id", "html").orderBy("h", "id").limit(sample_pages).collect()
    data = examples([r.html for r in rows], times)
    if not data:
        return None
    model = Labeller()
    model.fit(data, epochs)
    return model


def gates_of(pages: list[list[Block]], model: Labeller, caches: tuple[dict, dict], rows: int = 1024) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Both directions' gates of the pages, padded to the longest; the vectors themselves exist for `rows` blocks at a time."""
    longest = max(map(len, pages))
    gates = {d: np.zeros((longest, len(pages), 4 * model.hidden), np.float32) for d in "fb"}
    mask = np.zeros((longest, len(pages)), np.float32)
    for k, blocks in enumerate(pages):
        mask[: len(blocks), k] = 1
        for at in range(0, len(blocks), rows):
            x = vectors(blocks[at : at + rows], *caches)
            for d in "fb":
                gates[d][at : at + len(x), k] = model.gates(x, d)
    return gates, mask


def main_texts(pages: list[str], model: Labeller | None, cells: int = 4096) -> list[str]:
    parsed = [blocks_of(p or "") for p in pages]
    out, caches = [""] * len(pages), ({}, {})
    by = sorted((i for i, b in enumerate(parsed) if b and model), key=lambda i: len(parsed[i]))
    while by:  # from the longest page down: as many as fill the padded cells
        n = max(1, min(len(by), cells // len(parsed[by[-1]])))
        some, by = by[-n:], by[:-n]
        p = model.judge(*gates_of([parsed[i] for i in some], model, caches))
        for col, i in enumerate(some):
            out[i] = " ".join(b.text for b, q in zip(parsed[i], p[:, col], strict=False) if q >= 0.5)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 240) -> DataFrame:
    """pages without the html, with main_text; an earlier column of that name is replaced."""
    model = learn(pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")), sample_pages)
    rows = pages.drop("main_text").withColumn(html_col, F.col(html_col).cast("string"))
    fields = [f for f in rows.schema if f.name != html_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, html_col):
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(main_texts(part[html_col].to_pylist(), model), pa.string())], names=[*names, "main_text"])

    return rows.mapInArrow(run, StructType(fields).add("main_text", StringType()))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
