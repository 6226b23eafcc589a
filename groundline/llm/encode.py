"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

A split's texts are cut into words by the vocabulary's pattern; each distinct word is encoded once. The words of a flush
lie behind one another in one array of symbols with links to the next and previous symbol, and a pair occurrence index
maps the rank of each mergeable pair to all positions where the pair stands. The lowest active rank is taken, all its
positions are merged at once, and the lists of the pairs that arise to the left and right of them are extended; positions that
no longer hold their pair are dropped when their rank's turn comes.

Edge cases: null and empty texts give an empty list. Special tokens in a text are ordinary text. Blank and very long
texts (also one word of a million letters) are encoded whole. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text encoded together, and words kept between flushes of a split.
FLUSH_CHARS, KEPT_WORDS = 24_000_000, 400_000


class Merges(NamedTuple):
    """Pairs as left * 2**32 + right, ascending, with rank and resulting id; the ids of the 256 bytes."""

    pair: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    byte: np.ndarray


def byte_letters() -> list[str]:
    """The letter by which vocabulary files of this kind write each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def load_merges(path: str = VOCABULARY) -> Merges:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    code = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    order = np.argsort(code, kind="stable")
    return Merges(code[order], order.astype(np.int64), made[order], np.array([ids[c] for c in byte_letters()], np.int64))


def encode_words(words: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words behind one another, and how many each word has."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    sym = merges.byte[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(sym)
    word = np.repeat(np.arange(len(raw)), size)
    following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.cumsum(size)[size > 0] - 1
    following[last] = -1
    preceding[(last + 1)[:-1]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []
    by_rank = np.argsort(merges.rank)  # where the pair of a rank stands in merges.pair

    def add(at: np.ndarray) -> None:
        """Enter the pairs that begin at ``at`` into the index."""
        at = at[following[at] >= 0]
        code = (sym[at] << 32) | sym[following[at]]
        place = np.minimum(np.searchsorted(merges.pair, code), len(merges.pair) - 1)
        known = merges.pair[place] == code
        at, rank = at[known], merges.rank[place[known]]
        if len(at) == 1:
            groups = [(int(rank[0]), at)]
        else:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            groups = zip(rank[edge].tolist() if len(rank) else [], np.split(at, edge[1:]) if len(rank) else [], strict=False)
        for r, where in groups:
            if r in index:
                index[r].append(where)
            else:
                index[r] = [where]
                heapq.heappush(active, r)

    if n:
        add(np.arange(n))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        place = by_rank[r]
        left, right = merges.pair[place] >> 32, merges.pair[place] & 0xFFFFFFFF
        after = following[at]
        ok = alive[at] & (sym[at] == left) & (after >= 0)
        ok &= sym[after] == right
        at, after = at[ok], after[ok]
        if not len(at):
            continue
        if left == right and len(at) > 1:  # in a run of one symbol every second pair merges, from the left
            begins = np.r_[True, after[:-1] != at[1:]]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at, after = at[nth % 2 == 0], after[nth % 2 == 0]
        sym[at] = merges.made[place]
        alive[after] = False
        beyond = following[after]
        following[at] = beyond
        inner = beyond >= 0
        preceding[beyond[inner]] = at[inner]
        before = preceding[at]
        before = before[before >= 0]
        touched = np.concatenate([before, at]) if len(before) else at
        add(np.unique(touched) if len(touched) > 1 else touched)
    return sym[alive], np.bincount(word[alive], minlength=len(words))


def encode_texts(texts: list[str | None], merges: Merges, known: dict[str, np.ndarray], words_of) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts behind one another, and how many each text has. ``known`` keeps the ids of words."""
    place: dict[str, int] = {}
    said, per_text = [], []
    for t in texts:
        w = words_of(t) if t else []
        per_text.append(len(w))
        said += [place.setdefault(x, len(place)) for x in w]
    ids: list[np.ndarray | None] = [known.get(w) for w in place]
    new = [i for i, x in enumerate(ids) if x is None]
    words = list(place)
    flat, sizes = encode_words([words[i] for i in new], merges)
    for i, x in zip(new, np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1]) if new else [], strict=True):
        ids[i] = x
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
    known.update((words[i], ids[i].copy()) for i in new[:KEPT_WORDS])
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    start = np.cumsum(size) - size
    pool = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    said_at = np.array(said, np.int64)
    length = size[said_at] if len(said_at) else np.zeros(0, np.int64)
    ends = np.cumsum(length)
    offset = np.arange(int(length.sum())) - np.repeat(ends - length, length) + np.repeat(start[said_at] if len(said_at) else length, length)
    text_ends = np.r_[0, ends][np.cumsum(per_text, dtype=np.int64)] if per_text else np.zeros(0, np.int64)
    return pool[offset], np.diff(np.r_[0, text_ends])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """``id_col`` and ids, or n_tokens with ``count_only``, of every row."""
    merges = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary))  # as large as the vocabulary, whatever the input
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        words_of = regex.compile(PATTERN).findall

        def done(key: list[pa.Array], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            flat, sizes = encode_texts(texts, merges.value, known, words_of)
            keys = pa.concat_arrays(key)
            if count_only:
                yield pa.record_batch([keys, pa.array(sizes, pa.int32())], names=[id_col, "n_tokens"])
                return
            ends = np.r_[0, np.cumsum(sizes)]
            for lo in range(0, len(texts), 4000):
                hi = min(lo + 4000, len(texts))
                ids = pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo], pa.int32()), pa.array(flat[ends[lo] : ends[hi]], pa.int32()))
                yield pa.record_batch([keys[lo:hi], ids], names=[id_col, "ids"])

        key, texts, held = [], [], 0
        for batch in batches:
            key.append(batch.column(0))
            texts += batch.column(1).to_pylist()
            held += batch.column(1).nbytes
            if held > FLUSH_CHARS:
                yield from done(key, texts)
                key, texts, held = [], [], 0
        if texts:
            yield from done(key, texts)

    return spread(df.select(id_col, F.col(text_col).cast("string"))).mapInArrow(run, f"{id_col} {kind}, " + ("n_tokens int" if count_only else "ids array<int>"))
