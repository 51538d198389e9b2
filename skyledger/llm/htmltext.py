"""Operator 1: main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks in page order. Each block gives two hashed vectors, one of the
tags (with class and id words) on its path and one of its words, and a few counts. A bidirectional
LSTM in numpy reads the sequence of a whole page, so that each block is judged in the light of all
others, and the blocks it labels as article are the text.

The labeller is trained here, on pages that a seeded generator lays out with known labels: their
layouts vary in tags, class names, order and nesting, their words are drawn at random, so what is
learned is layout. Training is bounded (TRAIN_PAGES), depends on no table, and gives the same weights
in every session.

Defined cases: null, empty and blank pages give an empty text; markup that is never closed or cut off
in the middle is read as far as it goes; a null page_id or url is kept; repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import MEMO, map_arrow, table

PATH_DIM, WORD_DIM, COUNTS = 96, 32, 6
DIM = PATH_DIM + WORD_DIM + COUNTS
HIDDEN = 16
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 1000, 18, 32, 0.02, 20240229
#: Their content is never text.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea button head title".split())
#: Their start and end break a block.
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag that closes an open element of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
#: What a head holds; any other tag ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_SILENT_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title")}
_SPACE = re.compile(r"\s+")


def _place(text: str, dim: int) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % dim


class _Places(dict):
    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        p = self[word] = _place(word, self.dim)
        return p


_WORDS = _Places(WORD_DIM)


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


@lru_cache(maxsize=4096)
def _names(tag: str, rest: str) -> tuple[str, ...]:
    """Path words of a start tag: the tag, and each word of class, id and role."""
    found = [tag]
    for m in _NAMES.finditer(rest):
        value = _html.unescape(m[1] or m[2] or m[3] or "")
        found += [f".{w.lower()}" for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))]
    return tuple(dict.fromkeys(found))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = links = silent = 0
    page = page or ""

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
            if text:
                out.append(Block(text, tuple(n for _, names in stack for n in names), linked))
            held, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a script or the like
        if m.start() > at and not silent:
            held.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and not silent:
                held.append(m[1].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if not m[2]:  # start
            if tag in _SILENT_END:
                end = _SILENT_END[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
                silent, links = _pop(stack, len(stack) - 1, silent, links)
            if tag in BREAKS:
                flush()
            if tag == "br":
                held.append(" ")
            if tag in VOID or m[4].endswith("/"):
                continue
            if tag in SELF_CLOSING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        silent, links = _pop(stack, k, silent, links)
                        break
                    if stack[k][0] in BREAKS:
                        break
            stack.append((tag, _names(tag, m[4].strip())))
            silent += tag in SILENT
            links += tag == "a"
        else:
            if tag in BREAKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    silent, links = _pop(stack, k, silent, links)
                    break
    if at < len(page) and not silent:
        held.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    flush()
    return out


def _pop(stack: list, k: int, silent: int, links: int) -> tuple[int, int]:
    for tag, _ in stack[k:]:
        silent -= tag in SILENT
        links -= tag == "a"
    del stack[k:]
    return silent, links


@lru_cache(maxsize=65536)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    x = np.zeros(PATH_DIM, np.float32)
    for depth, name in enumerate(path):
        x[_place(name, PATH_DIM)] = 1.0
        if depth == len(path) - 1:
            x[_place("leaf " + name, PATH_DIM)] += 0.5
    return x


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(found), DIM), np.float32)
    at, place = [], []
    for i, b in enumerate(found):
        words = b.text.lower().split(" ")
        x[i, :PATH_DIM] = _path_vector(b.path)
        at += [i] * len(words)
        place += map(_WORDS.__getitem__, words)
        n, chars = len(words), len(b.text)
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 4, min(1.0, b.linked / chars), b.text[-1] in ".!?…", sum(map(b.text.count, ",;:")) / n, sum(map(str.isdigit, b.text)) / chars, chars / n / 10)
    if at:
        counts = np.bincount(np.array(at) * WORD_DIM + np.array(place), minlength=len(found) * WORD_DIM).reshape(-1, WORD_DIM)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return x


# The network: for each direction a matrix for the input, one for the state, and a bias; gates in
# the order in, forget, out, candidate.


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, DIM**-0.5, (DIM, 4 * HIDDEN))
        p["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["o"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
    p["c"] = np.zeros(1)
    return p


def _scan(z: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of an LSTM over the first axis of z (steps, pages, gates)."""
    steps, n, _ = z.shape
    h, c = np.zeros((n, HIDDEN), z.dtype), np.zeros((n, HIDDEN), z.dtype)
    out = np.empty((steps, n, HIDDEN), z.dtype)
    for t in range(steps):
        a = z[t] + h @ wh
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's own steps in reverse order; padding stays behind."""
    steps = x.shape[0]
    at = np.arange(steps)[:, None]
    at = np.where(at < lengths, lengths - 1 - at, at)
    return np.take_along_axis(x, at[:, :, None], 0)


def _back(grad: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of wh."""
    steps, n, _ = grad.shape
    dz, dwh = np.empty((steps, n, 4 * HIDDEN)), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, g, tc = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz[t] = d
        dwh += h0.T @ d
        dh, dc = d @ wh.T, dc * f
    return dz, dwh


def _step(p: dict, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of a batch. x: (steps, pages, DIM)."""
    mask = np.arange(len(x))[:, None] < lengths
    kept: dict[str, list] = {"f": [], "b": []}
    xs = {"f": x, "b": _reverse(x, lengths)}
    hs = {d: _scan(xs[d] @ p["x" + d] + p["b" + d], p["h" + d], kept[d]) for d in "fb"}
    both = np.concatenate([hs["f"], _reverse(hs["b"], lengths)], 2)
    err = (_sigmoid(both @ p["o"] + p["c"]) - y) * mask / mask.sum()
    g = {"o": np.einsum("tn,tnk->k", err, both), "c": np.array([err.sum()])}
    dboth = err[:, :, None] * p["o"]
    for d, dh in (("f", dboth[:, :, :HIDDEN]), ("b", _reverse(dboth[:, :, HIDDEN:], lengths))):
        dz, g["h" + d] = _back(dh, kept[d], p["h" + d])
        g["x" + d] = np.tensordot(xs[d], dz, ([0, 1], [0, 1]))
        g["b" + d] = dz.sum((0, 1))
    return g


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """Weights of the labeller, as float32."""
    from .htmlpages import generate

    rng = np.random.default_rng(SEED)
    data = []
    for page, texts in generate(TRAIN_PAGES, SEED):
        found = blocks(page)
        data.append((vectors(found), np.array([b.text in texts for b in found], float)))
    p = _start(rng)
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        # Pages of like length together; batches in random order.
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]))
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(groups)):
            own = [data[i] for i in groups[k]]
            lengths = np.array([len(x) for x, _ in own])
            x, y = np.zeros((lengths.max(), len(own), DIM)), np.zeros((lengths.max(), len(own)))
            for j, (a, b) in enumerate(own):
                x[: len(a), j], y[: len(b), j] = a, b
            t += 1
            rate = RATE * (1 - t / (EPOCHS * len(groups) + 1))
            for name, grad in _step(p, x, y, lengths).items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    return {k: w.astype(np.float32) for k, w in p.items()}


def label(pages: list[list[Block]], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page the probability of each block to be article text. Pages of like length go
    through the network together, so padding stays small."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        # At most about 20,000 cells, one page at least.
        n = 1
        while n < len(order) and (n + 1) * len(pages[order[-1 - n]]) <= 20_000 and len(pages[order[-1]]) <= 2 * len(pages[order[-1 - n]]) + 8:
            n += 1
        own, order = order[-n:], order[:-n]
        lengths = np.array([len(pages[i]) for i in own])
        x = np.zeros((lengths.max(), n, DIM), np.float32)
        for j, i in enumerate(own):
            x[: lengths[j], j] = vectors(pages[i])
        back = _reverse(_scan(_reverse(x, lengths) @ p["xb"] + p["bb"], p["hb"]), lengths)
        z = np.concatenate([_scan(x @ p["xf"] + p["bf"], p["hf"]), back], 2) @ p["o"] + p["c"]
        for j, i in enumerate(own):
            out[i] = _sigmoid(z[: lengths[j], j])
    return out


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for every row of ``pages``."""
    weights = trained()

    def run(slices):
        for s in slices:
            found = [blocks(h) for h in s["html"]]
            kept = [[b.text for b, q in zip(f, p, strict=True) if q >= threshold] for f, p in zip(found, label(found, weights), strict=True)]
            text = ["\n".join(k) for k in kept]
            yield {"page_id": s["page_id"], "url": s["url"], "text": text, "n_chars": list(map(len, text)), "n_blocks": list(map(len, found)), "n_kept": list(map(len, kept))}

    return map_arrow(pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int")


def op1(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
