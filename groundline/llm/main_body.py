"""The main body of web pages by minimum cut (problem 4).

A line is a node of its page's graph. A classifier (logistic regression, fitted on a bounded sample of labelled lines) gives the
probability that the line is main body; the costs of both labels are the capacities from the source and to the sink. Lines beside one
another and lines of the same kind close to one another (items of one list, rows of one table, entries of one menu: what is left of the page's
tree in its text) are joined by smoothness edges. Maximum flow gives the cheapest labelling of the whole page.

The classifier sees each line's character sequences (digits alike), shape, place, neighbours, and on what share of all pages the same line
stands. Its log odds are then averaged over all lines of the corpus with the same template (names and numbers left out; if the template is rare, its
first or last words), and the average is added with weight ``PULL``: a template stands in many places, most of which give it away.
The text is read once; the log odds, template keys and kinds of its lines are written to the shared folder, and averages and cut read them from there.
All counts and averages cover the whole corpus; only lines, words and templates on at least a fixed share of the pages are handed to the tasks, so
their number is at most the average number of lines (words) of a page divided by that share, whatever the size of the corpus.

Edge cases: null and empty texts have no lines. Blank lines take the label of the cut like any other and are never main body if the page has nothing else. Without labelled lines, or with one label only, every line keeps the
probability of that label (one half without any). Very long pages are labelled whole. Repeated rows give repeated results; a null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.runtime import cut, spread

#: At most so many labelled lines are fitted, whole pages in the order of their number.
SAMPLE_LINES = 20_000
#: Lines on at least this share of the pages, and on at least MIN_PAGES, count as common.
SHARE, MIN_PAGES = 1 / 2000, 3
#: The same for words that are no names, and for templates.
WORD_SHARE, TEMPLATE_SHARE = 1 / 500, 1 / 5000
#: Weight of a template's average, and the bound of the log odds in it.
PULL, CLIP = 2.0, 4.0
HASHED, GRAMS = 1 << 17, (2, 3, 4, 5)
ADJACENT, ALIKE, REACH = 0.3, 0.3, 2

_SHAPES = [
    r"^\s*[-–•] ", r"^\s*\* ", r"^\s*\d{1,2}[.)] ", r"^\s*©", r"^\s*#{1,6} ", r"^\s*\p{Lu}[\p{Lu}\s|·:]+$", r"[.!?。।！？…]['\"”»」)]*\s*$", r"[:：]\s*$",
    r"\(\s*\p{Nd}[\p{Nd}.,\s]*[^)]*\)\s*$", r"\s\|\s.*\p{Nd}|\p{Nd}.*\s\|\s", r"\s\|\s", r"[>»›]", r"\s/\s", r"\s[·•]\s", r"https?:|www\.", r"%", r"[\"“”„«»「」]", r"\p{Nd}$", r"\p{Nd}", r"^\s",
    r"^\p{Lu}?[^:：]{1,12}[:：]", r"\s–\s", r"@", r">>|→|\^|\[link\]|▸", r"^[^\p{Ll}\p{Lo}]*$", r"[?？;]\s*$", r"[,，、]", r"^[^.!?。।]*[.!?。।][^.!?。।]+[.!?。।]", r"^[^\s]+$", r"^[^,]+, [^,]+$",
]
#: Number of the shape of a line that ends a sentence.
ENDED = 6
#: Kinds of lines that lists, tables and menus repeat: these shapes, and lines with two bars.
KIND_SHAPES, BARS = (0, 1, 2), r"^[^|]*\|[^|]*\|"
#: White space in the sense of Unicode, which the shapes see as blanks.
WHITE = r"[\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DIGITS = re.compile(r"\d+")


UNCASED, RUNS = regex.compile(r"\p{Lo}"), re.compile(r"W( W)+")


class Model(NamedTuple):
    grams: np.ndarray
    flags: np.ndarray
    bias: float


@lru_cache(maxsize=100_000)
def line_hash(line: str) -> int:
    """Key of a line for counting: digits alike, white space and letter case left out."""
    return xxhash.xxh64_intdigest("".join(DIGITS.sub("0", line).lower().split())) - (1 << 63)


def gram_places(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the hashed weights of the character sequences of all lines, and the line of each."""
    clean = [" " + DIGITS.sub("0", x.strip()).lower() + "  " if x.strip() else "" for x in lines]
    size = np.fromiter(map(len, clean), np.int64, len(clean))
    a = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    line = np.repeat(np.arange(len(clean)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(a))  # characters to the end of the line
    places, owners = [], []
    h = a.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[: len(a) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + a[n - 1 :]
        if n in GRAMS:
            ok = left[: len(h)] >= n
            x = h[ok]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            places.append(((x >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64))
            owners.append(line[: len(h)][ok])
    return np.concatenate(places), np.concatenate(owners)


class Lines(NamedTuple):
    """The lines of some pages: the different ones, which of them each line is, its page, its place there, and the number of lines of the page."""

    texts: list[str]
    of: np.ndarray
    page: np.ndarray
    place: np.ndarray
    size: np.ndarray


def gathered(pages: list[list[str]]) -> Lines:
    index: dict[str, int] = {}
    of = np.array([index.setdefault(x, len(index)) for p in pages for x in p], np.int64)
    sizes = np.array([len(p) for p in pages], np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Lines(list(index), of, page, place, np.repeat(sizes, sizes))


def shapes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the shapes each text has, and its kind: list items and the like from 0, else -1 for whole sentences and -2."""
    clean = pa.compute.replace_substring_regex(pa.array([x.encode("utf-8", "replace").decode() for x in texts], pa.string()), WHITE, " ")
    has = np.empty((len(texts), len(_SHAPES)), bool)
    for i, x in enumerate(_SHAPES):
        has[:, i] = pa.compute.match_substring_regex(clean, x).to_numpy(zero_copy_only=False)
    kinds = [*(has[:, i] for i in KIND_SHAPES), pa.compute.match_substring_regex(clean, BARS).to_numpy(zero_copy_only=False), has[:, ENDED]]
    return has, np.select(kinds, [*range(len(kinds) - 1), -1], -2).astype(np.int8)


#: Features of a line alone (lengths, how common it is, shapes), and of its place in the page.
N_LENGTHS, N_COMMON, N_PLACES = 11, 4, 11


def own_features(texts: list[str], share_of) -> tuple[np.ndarray, np.ndarray]:
    """Features of the different lines, and their kinds."""
    has, kind = shapes_of(texts)
    words = np.array([len(x.split()) for x in texts], np.int64)
    chars = np.array([len(x.strip()) for x in texts], np.int64)
    share = np.array([share_of(x) for x in texts], np.float64)
    lengths = [chars == 0, *(chars < n for n in (8, 16, 30, 60, 120, 240)), *(words <= n for n in (1, 3, 6, 12))]
    common = [share >= n * SHARE for n in (1, 4, 16, 64)]
    return np.column_stack([*lengths, *common, has]).astype(np.float32).reshape(len(texts), -1), kind


def place_features(x: Lines) -> np.ndarray:
    i, n = x.place, x.size
    return np.column_stack([i == 0, i < 3, i < 6, i < 10, n - i <= 1, n - i <= 3, n - i <= 6, n - i <= 10, i * 4 < n, i * 2 < n, i * 4 >= 3 * n]).astype(np.float32)


def around(x: Lines, own: np.ndarray) -> np.ndarray:
    """Whether a whole sentence came before or comes after in the page, and how many whole sentences, common and short lines stand around."""
    first = np.arange(len(x.of)) - x.place
    last = first + x.size - 1
    said = own[:, N_LENGTHS + N_COMMON + ENDED] * (own[:, 5] < 1)
    out = []
    for k, c in enumerate((said, own[:, N_LENGTHS], own[:, 3])):
        total = np.r_[0.0, np.cumsum(c[x.of], dtype=np.float64)]
        between = lambda lo, hi, t=total: t[hi + 1] - t[lo]
        at = np.arange(len(x.of))
        if not k:
            out += [between(first, at - 1) > 0, between(at + 1, last) > 0]
        out.append(np.where(x.size >= 7, between(np.maximum(first, at - 3), np.minimum(last, at + 3)) / 7, between(first, last) / x.size))
    return np.column_stack([out[0], out[1], *out[2:]]).astype(np.float32).reshape(len(x.of), -1)


def moved(m: np.ndarray, x: Lines, by: int) -> np.ndarray:
    """Rows of the lines ``by`` places before (after, if negative) in their page, zeros where there is none."""
    out = np.zeros_like(m)
    at = np.flatnonzero((x.place >= by) & (x.place - by < x.size))
    out[at] = m[at - by]
    return out


NEAR = (1, 2, -1, -2)


def flags_of(x: Lines, own: np.ndarray) -> np.ndarray:
    """All features but the character sequences, one row per line."""
    m = np.hstack([own[x.of], place_features(x)])
    return np.hstack([m, *(moved(m, x, by) for by in NEAR), around(x, own)])


def flag_sums(x: Lines, own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``flags_of(x, own) @ w`` without the rows being made: what a line adds to its own and its neighbours' sums is computed once for equal lines."""
    n, k = own.shape[1] + N_PLACES, len(NEAR) + 1
    each = w[: n * k].reshape(k, n).T
    m = (own @ each[: own.shape[1]])[x.of] + place_features(x) @ each[own.shape[1] :]
    return m[:, 0] + sum(moved(m[:, i], x, by) for i, by in enumerate(NEAR, 1)) + around(x, own) @ w[n * k :]


def fit(pages: list[list[str]], labels: list[list[bool]], share_of, rounds: int = 300, l2: float = 2e-3) -> Model:
    """Logistic regression by gradient descent with momentum; each line is seen with and without its character sequences."""
    x = gathered(pages)
    lines = [x.texts[i] for i in x.of]
    y = np.array([v for p in labels for v in p], np.float64)
    flags = flags_of(x, own_features(x.texts, share_of)[0]) if len(y) else np.zeros((0, 1), np.float32)
    if not len(y) or y.min() == y.max():
        p = min(0.99, max(0.01, y.mean())) if len(y) else 0.5
        return Model(np.zeros(HASHED), np.zeros(flags.shape[1] if len(y) else 1), float(np.log(p / (1 - p))))
    place, owner = gram_places(lines)
    size = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(lines))))
    g, f, b = np.zeros(HASHED), np.zeros(flags.shape[1]), 0.0
    vg, vf, vb = g.copy(), f.copy(), 0.0
    n = len(y)
    for _ in range(rounds):
        from_grams = np.bincount(owner, g[place], minlength=n) / size
        from_flags = flags @ f + b
        e1 = 1 / (1 + np.exp(-(from_grams + from_flags))) - y
        e2 = 1 / (1 + np.exp(-from_flags)) - y
        dg = np.bincount(place, (e1 / size)[owner], minlength=HASHED) / n + l2 * 0.02 * g
        df = flags.T @ (e1 + 0.5 * e2) / n + l2 * f
        db = (e1 + 0.5 * e2).mean()
        vg, vf, vb = 0.9 * vg - 6.0 * dg, 0.9 * vf - 0.15 * df, 0.9 * vb - 0.15 * db
        g, f, b = g + vg, f + vf, b + vb
    return Model(g, f, float(b))


def scores(x: Lines, model: Model, share_of) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of main body of each line, and the kinds of the different lines."""
    if not len(x.of):
        return np.zeros(0), np.zeros(0, np.int8)
    own, kind = own_features(x.texts, share_of)
    place, owner = gram_places(x.texts)
    size = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(x.texts))))
    grams = np.bincount(owner, model.grams[place], minlength=len(x.texts)) / size
    known = len(model.flags) == (own.shape[1] + N_PLACES) * (len(NEAR) + 1) + 5
    return (flag_sums(x, own, model.flags) if known else 0.0) + model.bias + grams[x.of], kind


def edges_of(kind: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothness edges of pages: lines beside one another, and lines of one kind at most ``REACH`` apart."""
    parts = []
    for d in range(1, REACH + 1):
        a = np.flatnonzero(page[d:] == page[:-d]) if len(page) > d else np.zeros(0, np.int64)
        same = kind[a] == kind[a + d]
        w = np.where(same & (kind[a] >= 0), ALIKE, 0.0)
        if d == 1:
            w = w + np.where(same, ADJACENT, ADJACENT / 3)
        parts.append((a[w > 0], a[w > 0] + d, w[w > 0]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def cheapest(odds: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum cut of many graphs at once: True where a node stays on the source's side.

    A node whose log odds outweigh all its edges is on their side in every minimum cut. Such nodes are settled first, round by round, and
    stand for their label in the odds of their neighbours; the flow runs through what is left.
    """
    a, b, w = edges
    odds, side = odds.astype(np.float64).copy(), np.zeros(len(odds), np.int8)
    live = np.ones(len(a), bool)
    while True:
        pull = np.bincount(a[live], w[live], len(odds)) + np.bincount(b[live], w[live], len(odds))
        fresh = (side == 0) & (np.abs(odds) > pull + 1e-9)
        if not fresh.any():
            break
        side[fresh] = np.where(odds[fresh] > 0, 1, -1)
        for one, other in ((a, b), (b, a)):
            told = live & fresh[one] & (side[other] == 0)
            np.add.at(odds, other[told], w[told] * side[one[told]])
        live &= (side[a] == 0) & (side[b] == 0)
    rest = np.flatnonzero(side == 0)
    if len(rest):
        number = np.full(len(odds), -1)
        number[rest] = np.arange(len(rest))
        kept = min_cut(odds[rest], list(zip(number[a[live]].tolist(), number[b[live]].tolist(), w[live].tolist(), strict=True)))
        side[rest] = np.where(kept, 1, -1)
    return side > 0


def min_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """The cheapest labelling: True where a node stays on the source's side.

    A node with positive log odds has that capacity from the source, one with negative odds to the sink. Dinic's
    algorithm: breadth first from all nodes with capacity left, then a blocking flow along shortest ways.
    """
    n = len(odds)
    supply = [max(0.0, float(x)) for x in odds]
    demand = [max(0.0, -float(x)) for x in odds]
    to, cap, out = [], [], [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append(len(to))
        to.append(b)
        cap.append(w)
        out[b].append(len(to))
        to.append(a)
        cap.append(w)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > tiny)
        for i in queue:
            level[i] = 0
        order, ends = list(queue), False
        while queue:
            i = queue.popleft()
            if demand[i] > tiny:
                ends = True
                continue
            for e in out[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not ends:
            return np.array([x >= 0 for x in level], bool)
        at = [0] * n
        for s in order:
            while supply[s] > tiny:
                way, i = [], s
                while demand[i] <= tiny:
                    if at[i] < len(out[i]):
                        e = out[i][at[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            way.append(e)
                            i = to[e]
                        else:
                            at[i] += 1
                    elif way:
                        i = to[way.pop() ^ 1]
                        at[i] += 1
                    else:
                        break
                if demand[i] <= tiny:
                    break
                flow = min([supply[s], demand[i], *(cap[e] for e in way)])
                supply[s] -= flow
                demand[i] -= flow
                for e in way:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


class Told(NamedTuple):
    """What the tasks are told: the classifier and the common lines and words of the corpus."""

    model: Model
    common: dict[int, int]
    words: frozenset[int]
    total: int


@lru_cache(maxsize=100_000)
def cased(word: str) -> bool:
    """Whether the first letter of a word is a capital."""
    first = next((c for c in word if c.isalpha()), "")
    return first.isupper() or first.istitle()


@lru_cache(maxsize=100_000)
def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=100_000)
def templates_of(line: str, words: frozenset[int]) -> tuple[int, int, int]:
    """Hashes of a line's template, of its first two and of its last two words; names and numbers are alike.

    In scripts without letter case, where names can't be told, the first and last characters stand for the template.
    """
    t = DIGITS.sub("0", line.strip())
    if not t.isascii() and UNCASED.search(t):
        k = "".join(t.split())
        return hashed(f"{k[:5]}~{k[-5:]}"), hashed(f"{k[:3]}~"), hashed(f"~{k[-3:]}")
    w = [x if not cased(x) or hashed(x) in words else "W" + (x[-1] if not x[-1].isalnum() else "") for x in t.split()]
    w = RUNS.sub("W", " ".join(w)).lower().split()
    return hashed(" ".join(w)), hashed("^" + " ".join(w[:2])), hashed("$" + " ".join(w[-2:]))


def shares(common: dict[int, int], total: int, own: int):
    """The share of the pages on which a line stands, ``own`` pages left out."""

    def share(line: str) -> float:
        n = common.get(line_hash(line), 0) - own
        return n / total if n >= MIN_PAGES - 1 else 0.0

    return share


def batches_of(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part, gathered([t.split("\n") for t in part.column(column).to_pylist()])


def on_pages(x: Lines, keys: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and on how many pages each stands; the keys of different line i are keys[start[i] : start[i + 1]]."""
    known, number = np.unique(keys, return_inverse=True)
    many = np.diff(start)[x.of]
    at = np.repeat(start[x.of] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    seen = np.unique(np.repeat(x.page, many) * max(1, len(known)) + number[at])
    return known, np.bincount(seen % max(1, len(known)), minlength=len(known))


@lru_cache(maxsize=100_000)
def words_of(line: str) -> tuple[int, ...]:
    """Hashes of the words of a line that begin with a capital."""
    return tuple({hashed(w) for w in DIGITS.sub("0", line).split() if cased(w)})


def common_keys(texts: DataFrame) -> tuple[dict[int, int], frozenset[int], int]:
    """Pages with each common line, by its hash; the common words, by theirs; the number of pages. Counted over all pages."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in batches_of(batches, 0):
            lines, words = [(line_hash(t),) if t.strip() else () for t in x.texts], [words_of(t) for t in x.texts]
            for kind, own in enumerate((lines, words)):
                start = np.r_[0, np.cumsum([len(k) for k in own])].astype(np.int64)
                key, n = on_pages(x, np.array([h for k in own for h in k], np.int64), start)
                yield pa.record_batch([pa.array(key), pa.array(np.full(len(key), kind, np.int32)), pa.array(n.astype(np.int64))], names=["key", "kind", "n"])

    total = texts.count()
    counted = spread(texts).mapInArrow(keys, "key long, kind int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    least = [max(MIN_PAGES, int(np.ceil(total * x))) for x in (SHARE, WORD_SHARE)]
    rows = counted.where((F.col("n") >= least[0]) & (F.col("kind") == 0) | (F.col("n") >= least[1]) & (F.col("kind") == 1)).collect()
    return {r.key: r.n for r in rows if r.kind == 0}, frozenset(r.key for r in rows if r.kind == 1), total


def trained(labels: DataFrame, common: dict[int, int], total: int) -> Model:
    """The classifier from at most ``SAMPLE_LINES`` labelled lines (page_no, line_no, line, is_main)."""
    rows = labels.where("line IS NOT NULL AND is_main IS NOT NULL").select("page_no", "line_no", "line", "is_main").distinct().orderBy("page_no", "line_no", "line").limit(SAMPLE_LINES).collect()
    pages: dict[int, list] = {}
    for r in rows:
        pages.setdefault(r.page_no, []).append(r)
    return fit([[r.line for r in p] for p in pages.values()], [[r.is_main for r in p] for p in pages.values()], shares(common, total, 0))


def scored(pages: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep_text: bool) -> tuple[DataFrame, int]:
    """Every page with the log odds of its lines, the keys of their templates and their kinds, written once; and the number of pages.

    Everything that is read from the text is read here; averages, cut and labels need only what comes out.
    """
    texts = pages.where(f"{text_col} <> ''")
    common, words, total = common_keys(texts.select(text_col))
    told = pages.sparkSession.sparkContext.broadcast(Told(trained(labels, common, total), common, words, total))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        share = shares(own.common, own.total, 1)
        for part, x in batches_of(batches, 1):
            odds, kinds = scores(x, own.model, share)
            keys = np.array([templates_of(t, own.words) for t in x.texts], np.int64).reshape(-1, 3)[x.of]
            ends = np.flatnonzero(np.r_[x.page[1:] != x.page[:-1], True]) + 1
            split = lambda m, e=ends: pa.array([p.tobytes() for p in np.split(m, e[:-1])], pa.binary())
            columns = [part.column(0), split(odds.astype(np.float32)), split(keys), split(kinds[x.of]), part.column(1)]
            yield pa.record_batch(columns[: 5 if keep_text else 4], names=[id_col, "odds", "keys", "kinds", "text"][: 5 if keep_text else 4])

    rows = spread(texts.select(id_col, F.col(text_col).alias("text"))).mapInArrow(run, f"{id_col} {kind}, odds binary, keys binary, kinds binary" + (", text string" if keep_text else ""))
    return cut(rows), total


def joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def averages(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The templates on at least ``TEMPLATE_SHARE`` of the pages, ascending, and the average log odds of each, over all lines."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.clip(joined(batch.column(0), np.float32).astype(np.float64), -CLIP, CLIP)
            key, at, n = np.unique(joined(batch.column(1), np.int64), return_inverse=True, return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(np.bincount(at.ravel(), np.repeat(odds, 3), minlength=len(key))), pa.array(n.astype(np.int64))], names=["key", "odds", "n"])

    counted = rows.select("odds", "keys").mapInArrow(sums, "key long, odds double, n long").groupBy("key").agg(F.sum("odds").alias("odds"), F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(MIN_PAGES, int(np.ceil(total * TEMPLATE_SHARE)))).select("key", F.col("odds") / F.col("n")).toPandas()
    found = found.sort_values("key")
    return found.iloc[:, 0].to_numpy(np.int64), found.iloc[:, 1].to_numpy(np.float64)


def pulled(odds: np.ndarray, keys: np.ndarray, templates: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The log odds with the averages of the templates added: the whole template's, if it is rare those of its ends."""
    if not len(templates):
        return odds
    keys = keys.reshape(-1, 3)
    at = np.minimum(np.searchsorted(templates, keys), len(templates) - 1)
    known = templates[at] == keys
    own = np.where(known, mean[at], 0.0)
    pull = np.where(known[:, 0], own[:, 0], own[:, 1:].sum(1) / np.maximum(1, known[:, 1:].sum(1)))
    return odds + PULL * pull


def judged(pages: DataFrame, labels: DataFrame, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    """``columns`` of every page that ``make`` gives for a batch of pages, their lines' page and labels."""
    rows, total = scored(pages, labels, id_col, text_col, "body" in columns)
    told = pages.sparkSession.sparkContext.broadcast(averages(rows, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                kinds = joined(part.column("kinds"), np.int8)
                size = np.array([len(k) for k in part.column("kinds").to_pylist()], np.int64)
                page = np.repeat(np.arange(len(size)), size)
                odds = pulled(joined(part.column("odds"), np.float32).astype(np.float64), joined(part.column("keys"), np.int64), *told.value)
                yield make(part, page, size, cheapest(odds, edges_of(kinds, page)))

    return rows.mapInArrow(run, columns)


def labelled_lines(pages: DataFrame, labels: DataFrame, id_col: str = "pd_id", text_col: str = "text") -> DataFrame:
    """id_col, line_no and is_main of every line of every page."""

    def make(part: pa.RecordBatch, page: np.ndarray, size: np.ndarray, main: np.ndarray) -> pa.RecordBatch:
        no = np.arange(len(page)) - np.repeat(np.cumsum(size) - size, size)
        return pa.record_batch([part.column(0).take(pa.array(page)), pa.array(no, pa.int64()), pa.array(main, pa.bool_())], names=[id_col, "line_no", "is_main"])

    return judged(pages, labels, id_col, text_col, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, line_no long, is_main boolean", make)


def main_bodies(pages: DataFrame, labels: DataFrame, id_col: str = "pd_id", text_col: str = "text") -> DataFrame:
    """id_col and body: the main body of every page with a text, its lines joined by line feeds, empty where there is none."""

    def make(part: pa.RecordBatch, page: np.ndarray, size: np.ndarray, main: np.ndarray) -> pa.RecordBatch:
        own = np.split(main, np.cumsum(size)[:-1])
        body = ["\n".join(x for x, m in zip(t.split("\n"), k, strict=True) if m) for t, k in zip(part.column("text").to_pylist(), own, strict=True)]
        return pa.record_batch([part.column(0), pa.array(body, pa.string())], names=[id_col, "body"])

    return judged(pages, labels, id_col, text_col, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, body string", make)
