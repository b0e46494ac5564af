"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags and line breaks, without scripts, styles and other
unseen content. Each block becomes a vector of its hashed tag path (names, classes and ids of the open elements), its
hashed words and a few figures. A bidirectional LSTM in numpy reads the whole sequence of a page, so every block is judged
in the context of all others, and the blocks it marks as content are joined in page order. ``train_blocks.py`` makes the
weights from pages that it writes itself. Cutting takes time in proportion to the page, however deep its elements are and
however many tags stay open; the network reads long pages in runs of steps, forwards and backwards, with a state between them.

Defined cases: null and empty pages give an empty text; text without markup is one block; unclosed (also a head's) and stray tags are
tolerated; pages of any length are read whole; nothing is dropped or cut for length; repeated rows stay; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import html
import pkgutil
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.bytewords import U, buffers, parts, words

#: Elements of HTML by what the cutter does with them.
UNSEEN = frozenset("script style noscript template head svg iframe select datalist textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
RAW = frozenset("script style textarea title noscript template iframe".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[a-z]+")

PATH, WORDS, FIGURES = 96, 48, 8
WIDTH = PATH + WORDS + FIGURES


#: Steps (blocks times pages) of one run of the network.
RUN = 1 << 14
#: Weight of a mark that occurs a times on a path, b times among its last three elements, at a + 4 * b.
WEIGHT = np.minimum(0.7 * (np.arange(16) % 4) + 0.3 * (np.arange(16) // 4), 2).astype(np.float32)


@lru_cache(maxsize=20_000)
def _places(name: str, attributes: str) -> tuple[int, ...]:
    """Where the marks of an element count: its name, and the pieces of its classes, ids and roles."""
    found = [name]
    for m in NAMES.finditer(attributes):
        found += PIECES.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(zlib.crc32(mark.encode()) % PATH for mark in found)


#: Paths are known from page to page, up to about so many.
KNOWN = 50_000
_made = 0


class Path:
    """An open element and those around it; equal paths of a page are one object."""

    __slots__ = ("_code", "_counts", "depth", "outer", "places", "within")

    def __init__(self, places: tuple[int, ...], outer: Path | None):
        self.places, self.outer, self.depth = places, outer, outer.depth + 1 if outer else 0
        self.within: dict[tuple[int, ...], Path] = {}
        self._counts: np.ndarray | None = None
        self._code: np.ndarray | None = None

    def enter(self, places: tuple[int, ...]) -> Path:
        global _made
        found = self.within.get(places)
        if found is None:
            found = self.within[places] = Path(places, self)
            _made += 1
        return found

    def counts(self) -> np.ndarray:
        """How often each mark occurs, 3 at most."""
        chain, at = [], self
        while at._counts is None and at.outer:
            chain.append(at)
            at = at.outer
        counts = np.zeros(PATH, np.uint8) if at._counts is None else at._counts
        for at in reversed(chain):
            counts = at._counts = counts.copy()
            for place in at.places:
                if counts[place] < 3:
                    counts[place] += 1
        return counts

    def code(self) -> np.ndarray:
        if self._code is None:
            last, at = np.zeros(PATH, np.uint8), self
            for _ in range(3):
                if at.outer:
                    for place in at.places:
                        last[place] += last[place] < 3
                    at = at.outer
            self._code = self.counts() + 4 * last
        return self._code


_root = Path((), None)


def _fresh_root() -> Path:
    global _root, _made
    if _made > KNOWN:
        _root, _made = Path((), None), 0
    return _root


def cut(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters in links) of each leaf block. White space is one space; references are decoded."""
    out: list[tuple[Path, str, int]] = []
    root = _fresh_root()
    stack: list[tuple[str, Path, int]] = []  # name, path, place of the last element up to it that is not inline
    opened: dict[str, int] = {}
    held: list[str] = []
    path: Path | None = None
    unseen = links = linked = 0

    def flush() -> None:
        nonlocal path, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((path, text, min(linked, len(text))))
            held.clear()
        path, linked = None, 0

    def text(a: int, b: int) -> None:
        nonlocal path, linked
        if stack and stack[-1][0] == "head" and b > a and not page[a:b].isspace():
            leave(len(stack) - 1)  # text ends the head
        if b > a and not unseen:
            piece = page[a:b]
            if path is None and not piece.isspace():
                path = stack[-1][1] if stack else root
            held.append(piece)
            if links:
                linked += len(piece)

    def leave(n: int) -> None:
        nonlocal unseen, links
        while len(stack) > n:
            gone = stack.pop()[0]
            opened[gone] -= 1
            unseen -= gone in UNSEEN
            links -= gone == "a"

    at = begin = 0
    end, last = len(page), page.rfind(">")
    quoted = True  # until a quote is found open at the end of the page
    while at < end:
        start = page.find("<", at)
        if start < 0:
            break
        at = start + 1
        if page.startswith("!--", at):
            stop = page.find("-->", at + 3)
            text(begin, start)
            at = begin = stop + 3 if stop >= 0 else end
            continue
        if start > last:  # no tag ends any more, but a comment may come
            at = page.find("<!--", start)
            if at < 0:
                break
            continue
        if page.startswith(("!", "?"), at):
            text(begin, start)
            at = begin = page.index(">", at) + 1
            continue
        m = TAG.match(page, start) if quoted else LOOSE.match(page, start)
        if m is None and quoted and (m := LOOSE.match(page, start)):
            quoted = False
        if m is None:
            continue
        text(begin, start)
        at = begin = m.end()
        name = m[2].lower()
        if name not in INLINE:
            flush()
        if m[1]:
            if opened.get(name):
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                leave(i)
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            leave(len(stack) - 1)  # as does what is not allowed in it; </head> is optional
        if name in VOID:
            continue
        if name not in INLINE and stack and (i := stack[-1][2]) >= 0 and (stack[i][0] == "p" or stack[i][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            leave(i)  # an open paragraph or item ends where the next block starts
        if m[3].endswith("/") and name in ("svg", "path"):
            continue
        around = stack[-1][1] if stack else root
        own = around.enter(_places(name, m[3]))
        stack.append((name, own, len(stack) if name not in INLINE else stack[-1][2] if stack else -1))
        opened[name] = opened.get(name, 0) + 1
        unseen += name in UNSEEN
        links += name == "a"
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            at = begin = close.start() if close else end
    text(begin, end)
    flush()
    return out


def vectors(blocks: list[tuple[Path, str, int]]) -> np.ndarray:
    """One row of WIDTH for each block."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return x
    x[:, :PATH] = WEIGHT[np.stack([b[0].code() for b in blocks])]
    found, rows = words(*buffers(pa.array([b[1] for b in blocks], pa.large_string())))
    n = np.diff(rows)
    owner = np.repeat(np.arange(len(blocks)), n)
    counts = np.bincount(owner * WORDS + (found % U(WORDS)).astype(np.int64), minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = counts / np.maximum(n, 1)[:, None]
    size = np.array([len(b[1]) for b in blocks], np.float32)
    stops = np.array([b[1].count(".") + b[1].count(",") for b in blocks], np.float32)
    k = PATH + WORDS
    x[:, k] = np.log1p(size) / 5
    x[:, k + 1] = np.array([b[2] for b in blocks]) / size
    x[:, k + 2] = np.log1p(n) / 4
    x[:, k + 3] = np.minimum(stops / np.maximum(n, 1), 1)
    x[:, k + 4] = [b[1][-1] in ".!?:" for b in blocks]
    x[:, k + 5] = np.array([b[0].depth for b in blocks]) / 10
    x[:, k + 6] = ["©" in b[1] for b in blocks]
    x[:, k + 7] = 1
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def run_lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, back: bool, keep: bool = False, state: list[np.ndarray] | None = None):
    """States (steps, pages, units) of one direction; with ``keep`` also what training needs. ``state`` is where it starts, and then where it ends."""
    steps, pages, _ = x.shape
    units = wh.shape[0]
    drive = (x.reshape(-1, x.shape[2]) @ wx + b).reshape(steps, pages, 4 * units)
    h, c = state if state else (np.zeros((pages, units), x.dtype), np.zeros((pages, units), x.dtype))
    out = np.zeros((steps, pages, units), x.dtype)
    tape = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g = drive[t] + h @ wh
        s = _sigmoid(g[:, : 3 * units])
        i, f, o, u = s[:, :units], s[:, units : 2 * units], s[:, 2 * units :], np.tanh(g[:, 3 * units :])
        m = mask[t][:, None]
        new_c = f * c + i * u
        tc = np.tanh(new_c)
        if keep:
            tape.append((t, i, f, o, u, c, h, tc, m))
        c, h = np.where(m, new_c, c), np.where(m, o * tc, h)
        out[t] = h * m
    if state is not None:
        state[:] = h, c
    return (out, tape) if keep else out


class Labeller:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    @staticmethod
    def load() -> Labeller:
        return Labeller(dict(np.load(BytesIO(pkgutil.get_data(__package__, "blocks.npz")))))

    def probabilities(self, read: Callable[[int, int], tuple[np.ndarray, np.ndarray]], steps: int, run: int) -> np.ndarray:
        """(steps, pages). ``read`` gives the vectors (steps, pages, WIDTH) and the mask of some steps; runs of ``run`` steps are held at a time."""
        w, units = self.w, len(self.w["whf"])
        ends = [(a, min(a + run, steps)) for a in range(0, steps, run)]
        sums, held = [None] * len(ends), None
        for d, v in (("f", w["v"][:units]), ("b", w["v"][units:])):
            state: list[np.ndarray] = []
            for i in range(len(ends)) if d == "f" else reversed(range(len(ends))):
                if held is None or held[0] != i:
                    held = i, *read(*ends[i])
                own = run_lstm(*held[1:], w[f"wx{d}"], w[f"wh{d}"], w[f"b{d}"], d == "b", state=state) @ v
                sums[i] = own if sums[i] is None else sums[i] + own
        return _sigmoid(np.concatenate(sums) + w["c"])

    def texts(self, pages: list[str], least: float = 0.5, together: int = 64) -> list[str]:
        """The main text of each page."""
        cuts = [cut(p) for p in pages]
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if cuts[i]), key=lambda i: len(cuts[i]))
        while order:
            longest = len(cuts[order[-1]])
            own = order[-max(1, min(together, RUN // longest)) :]
            del order[-len(own) :]

            def read(a: int, b: int, own: list[int] = own) -> tuple[np.ndarray, np.ndarray]:
                some = [cuts[i][a:b] for i in own]
                x, mask = np.zeros((b - a, len(own), WIDTH), np.float32), np.zeros((b - a, len(own)), bool)
                found = np.split(vectors([block for blocks in some for block in blocks]), np.cumsum([len(blocks) for blocks in some])[:-1])
                for j, v in enumerate(found):
                    x[: len(v), j], mask[: len(v), j] = v, True
                return x, mask

            good = self.probabilities(read, longest, max(1, RUN // len(own))) >= least
            for j, i in enumerate(own):
                out[i] = " ".join(b[1] for b, ok in zip(cuts[i], good[:, j].tolist(), strict=False) if ok)
        return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row."""
    labeller = Labeller.load()  # some 100 KB, sent with the task
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2, 1 << 20):
                texts = labeller.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "u", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(page), F.lit("")).alias("h"))
    return rows.mapInArrow(run, f"k {kind}, u string, text string, n_chars long").toDF(key, url, "text", "n_chars")
