"""Main text of pages: a bidirectional LSTM in numpy labels every block by its tag path, its words and its neighbours."""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from sondage.llm.common import arrow_pass, col

# Pages that the model is fitted on at most (smallest hash of the id, none longer than SAMPLE_CHARS), and how often.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 200_000
EPOCHS, GROUP, STEP = 14, 24, 0.02
PATH_DIMS, TAIL_DIMS, WORD_DIMS, FIGURES = 96, 32, 32, 5
DIMS = PATH_DIMS + TAIL_DIMS + WORD_DIMS + FIGURES
HIDDEN = 16
# Blocks, padding included, that one step of the recurrence may hold.
PADDED = 40_000

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# Words that teach: elements, classes, ids and roles that mark a page's main part, and those that mark what is none of it.
MAIN = frozenset("article main content post entry story body-text articlebody article-body post-content entry-content main-content".split())
OTHER = frozenset(
    "nav header footer aside form button dialog script style title head noscript template iframe textarea select option svg figure-ad ad ads advert advertisement sponsor sponsored promo banner menu "
    "navigation navbar breadcrumb breadcrumbs sidebar cookie cookies consent notice alert popup modal comment comments reply replies disqus share social related recommended newsletter subscribe login search".split()
)

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

Path = tuple[str, ...]
Block = tuple[Path, str, float]


def blocks(page: str) -> list[Block]:
    """(path, text, share of linked characters) of each run of text between block-level marks, in page order.

    The path lists the open block-level elements, each as ``tag name name``. Comments, scripts and styles are no text;
    character references are decoded; white space is one space; unclosed elements end where HTML ends them.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    linked = at = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append((tuple(d for t, d in stack if t not in INLINE), text, min(1.0, linked / len(text))))
        run.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        run.append(text)
        if links:
            linked += len(text)

    find = _TAG.search
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                pop_to(k)
            elif name not in INLINE:
                flush()
            continue
        if name in CLOSES_P or name in CLOSES:
            shut = CLOSES.get(name, ("p",))
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in shut or stack[k][0] in ("table", "ul", "ol", "dl", "select", "article", "section", "div")), None)
            if k is not None and stack[k][0] in shut:
                while k and stack[k - 1][0] in shut:
                    k -= 1
                pop_to(k)
        if name not in INLINE:
            flush()
        if name in VOID or m[3].endswith("/") and name not in RAW:
            continue
        names = " ".join(x or y or z for x, y, z in _NAMES.findall(m[3])) if "=" in m[3] else ""
        stack.append((name, f"{name} {names.lower()}".strip()))
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if name in ("title", "textarea"):
                add(page[at:stop])
                flush()
            at = stop
            if not end:
                stack.pop()
    if at < len(page):
        add(page[at:])
    flush()
    return out


def teach(path: Path) -> bool:
    """Whether a path says main text: inside a main element and inside nothing that is marked as other."""
    names = {n for step in path for n in step.split()}
    parts = names | {p for n in names for p in re.split(r"[-_]", n)}
    return bool(names & MAIN) and not parts & OTHER


def _slot(text: str, dims: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % dims


class Vectors:
    """Blocks as vectors: hashed names of the path, of its last element, hashed words, and a few figures."""

    def __init__(self):
        self.paths: dict[Path, np.ndarray] = {}

    def path(self, path: Path) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH_DIMS + TAIL_DIMS, dtype=np.float32)
            for step in path:
                for n in step.split():
                    for p in {n, *re.split(r"[-_]", n)}:
                        v[_slot(p, PATH_DIMS)] = 1.0
            if path:
                v[PATH_DIMS + _slot(path[-1], TAIL_DIMS)] = 1.0
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[path] = v
        return v

    def page(self, found: list[Block]) -> np.ndarray:
        x = np.zeros((len(found), DIMS), dtype=np.float32)
        crc = zlib.crc32
        for k, (path, text, linked) in enumerate(found):
            x[k, : PATH_DIMS + TAIL_DIMS] = self.path(path)
            words = text.encode("utf-8", "surrogatepass").split()
            hashed = np.bincount(np.fromiter(map(crc, words), dtype=np.int64, count=len(words)) % WORD_DIMS, minlength=WORD_DIMS)
            x[k, PATH_DIMS + TAIL_DIMS : -FIGURES] = hashed / max(len(words), 1)
            x[k, -FIGURES:] = np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, linked, k / len(found), 1.0
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(z: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction; z holds the inputs' share of the gates (steps, pages, 4 * HIDDEN)."""
    steps, n, _ = z.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        g = z[t] + h @ wh
        s = sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        before, hb = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, u, before, tc, hb))
    return out, kept


def back_lstm(dout: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of z and of the recurrent weights."""
    steps, n, _ = dout.shape
    dz, dwh = np.empty((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, u, before, tc, hb = kept[t]
        d = dout[t] + dh
        dc = dc + d * o * (1 - tc**2)
        dz[t] = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - u**2)), axis=1)
        dwh += hb.T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * f
    return dz, dwh


def flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps backwards; padding stays behind."""
    t = np.arange(x.shape[0])[:, None]
    at = np.where(t < lengths, lengths - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


class Labeller:
    """Weights of both directions and of the output; ``probabilities`` labels whole pages."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.15, (DIMS, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.2, (2 * HIDDEN + 1,)).astype(np.float32)

    def forward(self, x: np.ndarray, lengths: np.ndarray):
        w = self.w
        hf, kf = run_lstm(x @ w["xf"], w["hf"])
        xb = flipped(x, lengths)
        hb, kb = run_lstm(xb @ w["xb"], w["hb"])
        both = np.concatenate((hf, flipped(hb, lengths), np.ones((*x.shape[:2], 1), np.float32)), axis=2)
        return sigmoid(both @ w["o"]), (x, xb, kf, kb, both)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(pages), GROUP):
                part = [pages[k] for k in order[at : at + GROUP]]
                x, lengths = padded([p[0] for p in part])
                y = np.zeros(x.shape[:2], np.float32)
                mask = np.arange(x.shape[0])[:, None] < lengths
                for k, p in enumerate(part):
                    y[: len(p[1]), k] = p[1]
                prob, (x, xb, kf, kb, both) = self.forward(x, lengths)
                err = np.where(mask, prob - y, 0).astype(np.float32) / max(mask.sum(), 1)
                g = {"o": np.tensordot(both, err, axes=([0, 1], [0, 1]))}
                d = err[:, :, None] * self.w["o"]
                dzf, g["hf"] = back_lstm(d[:, :, :HIDDEN], kf, self.w["hf"])
                dzb, g["hb"] = back_lstm(flipped(d[:, :, HIDDEN : 2 * HIDDEN], lengths), kb, self.w["hb"])
                g["xf"], g["xb"] = np.tensordot(x, dzf, axes=([0, 1], [0, 1])), np.tensordot(xb, dzb, axes=([0, 1], [0, 1]))
                step += 1
                rate = STEP * (1 - epoch / EPOCHS)
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Pages of like length together, no more padded blocks at a time than PADDED (a longer page goes alone)."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= PADDED:
                stop += 1
            x, lengths = padded([pages[k] for k in order[at:stop]])
            prob, _ = self.forward(x, lengths)
            for j, k in enumerate(order[at:stop]):
                out[k] = prob[: lengths[j], j]
            at = stop
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((int(lengths.max()), len(pages), DIMS), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, lengths


# Wrappers that a training copy of a page may carry instead of its own, and parts that it may be given.
WRAPPERS = ("article", "main", "div content", "div post-content", "section story", "div main", "div entry-content", "article post")
PARTS = ("aside", "div sidebar", "header", "header site-header", "form", "div cookie-notice", "div notice", "div ad", "div advert", "div banner", "section comments", "div comment", "footer", "nav menu", "div related", "div newsletter", "ul menu", "div share")


def varied(found: list[Block], rng: np.random.Generator) -> list[Block]:
    """A training copy of a page: another wrapper for its main part, and parts of other kinds put among its blocks."""
    wrap = WRAPPERS[rng.integers(len(WRAPPERS))]
    out = [(tuple(wrap if s.split()[0] in ("article", "main") else s for s in path), text, linked) for path, text, linked in found]
    texts = [b for b in found if len(b[1]) < 2_000]
    for _ in range(int(rng.integers(0, 4))):
        if not texts:
            break
        part = PARTS[rng.integers(len(PARTS))]
        at = int(rng.integers(len(out) + 1))
        near = out[min(at, len(out) - 1)][0]
        inside = [k for k, s in enumerate(near) if s == wrap]
        top = near[: inside[0] + 1] if inside and rng.random() < 0.5 else tuple(s for s in near[:2])
        some = [texts[rng.integers(len(texts))] for _ in range(int(rng.integers(1, 4)))]
        out[at:at] = [((*top, part, "p"), b[1], float(rng.random() < 0.3)) for b in some]
    return out


def fit_labeller(pages: DataFrame, page_id: str = "page_id", text: str = "html", sample: int = SAMPLE_PAGES) -> Labeller:
    """A labeller fitted on at most ``sample`` pages of bounded length, each as it is and in one varied copy.

    Labels come from the marks of the pages themselves (``teach``). Ids are drawn first, so tasks send no texts that are
    not used; a repeated id counts once, null ids not at all. Without any page the weights stay as drawn.
    """
    rows = pages.select(col(page_id).alias("page_id"), col(text).alias("html")).where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    ids = rows.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    got = rows.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()
    rng, vectors, made = np.random.default_rng(3), Vectors(), []
    for r in got:
        found = blocks(r["html"])
        for version in (found, varied(found, rng)) if found else ():
            made.append((vectors.page(version), np.array([teach(b[0]) for b in version], np.float32)))
    model = Labeller()
    if made:
        model.fit(made)
    return model


def extract(pages: DataFrame, model: Labeller, text: str = "html") -> DataFrame:
    """``row`` (the input row) with ``text`` (the main blocks in page order, joined by one space) and ``n_chars``.

    Every block of the whole page is labelled; those with a probability of one half or more are kept whole. Null and empty
    pages, and pages without a main block, give an empty text. Repeated pages get equal texts; other columns stay
    inside ``row``, whatever their names.
    """

    def make():
        vectors = Vectors()

        def fn(arrays):
            found = [blocks(t) if t else [] for t in arrays[0].to_pylist()]
            probs = model.probabilities([vectors.page(f) for f in found])
            texts = [" ".join(b[1] for b, p in zip(f, prob) if p >= 0.5) for f, prob in zip(found, probs)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return fn

    return arrow_pass(pages, make, {"html": col(text)}, [StructField("text", StringType()), StructField("n_chars", LongType())])
