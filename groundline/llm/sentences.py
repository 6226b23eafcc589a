"""Sentence units across languages and scripts (problem 5).

Every character of a line is tagged as boundary (the last of a unit) or inside by a linear-chain model with Viterbi decoding. A character
that is no closing mark (with the quotes and brackets after it) and in Thai no place between two letters can only be inside, so the chains are
decoded over the others; the last character of a line that is not blank is a boundary by definition.

Nobody labelled the texts; the model is trained on what they show themselves:

* the ends of lines are sure boundaries. For training, line ends are stripped: neighbouring lines are put together,
  so a line end looks like any other place between sentences;
* a mark before a small letter or after a word that never ends a line is surely inside.

A mark in a quotation after which the sentence goes on is inside by definition.

Thai has no marks. Its model (``train_thai``) is trained on text without blanks and line ends: every place between two Thai letters is tagged, and is a boundary where a
blank between letters or a line end stood before. It knows the letters on both sides only. When it is decoded, the weight of a blank, counted in training, is
added where the text has one; where it has none nothing can end (a rule of the texts: only a blank ends a Thai unit). ``thai_ends`` without that rule finds the boundaries of unbroken text.

How often each word ends a line before a mark, begins a line, and stands on either side of a mark within a line is counted over all texts; words on at least
``WORD_SHARE`` of all marks are handed to the tasks, at most 1 / WORD_SHARE for each side.

Edge cases: null, empty and blank texts have no units. A line without marks is one unit. Very long lines and texts are decoded
whole. Repeated rows give repeated units. Extra columns are ignored. Without any text to train on the fixed list of abbreviations decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.runtime import cut, spread

#: Texts the model is trained on, about: those whose hash of the id is below a threshold.
TRAIN_TEXTS = 6_000
#: The same for texts with Thai letters, and the bound of what the letters at one place can tell.
TRAIN_THAI, THAI_BOUND = 600, 5.0
WORD_SHARE, MIN_SEEN = 1 / 20_000, 8

CLOSERS, OPENERS = "\"'”’“»›」』)\\]）】", "\"'“„«‹「『(\\[（【¿¡‘"
#: A mark with what closes after it. A full stop counts only before white space or an end, marks of the scripts without blanks always.
MARK = regex.compile(rf"(?:[.!?…;]+[{CLOSERS}]*(?:[ \u00a0\u202f][»›])?(?=\s|\Z|[぀-ヿ一-鿿])|[。！？।॥؟｡]+[{CLOSERS}]*)")
QUOTED = regex.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』")
DIGITS = regex.compile(r"\p{Nd}+")
WIDE, THAI = regex.compile(r"[぀-ヿ㐀-鿿]"), regex.compile(r"\p{Thai}")
#: Rows of tables and items of lists, in which a Thai blank stands between names.
ROW = regex.compile(r"\s\|\s|^\s*[-–•*] ")
#: Words with a full stop that go on with a capital or a number.
ABBREVIATIONS = frozenset(
    "Mr Mrs Ms Dr Prof St No Nos Fig Figs Sec Ch Vol Art Rs Rev rev approx vs cf p pp ed eds al Inc Ltd Co Corp Jr Sr Gen Gov Sen Rep Capt Lt Col i.e e.g U.K U.S "
    "Sra Srta Dra Sres D Da pág págs núm aprox ej art cap ca Nr Hr Fr S vgl bzw z B d h u a usw inkl Abs Art Bd M MM Mme Mlle env ex av boul "
    "г гг стр табл рис см См т е д п пп ул им др руб коп тыс млн "
    "κ κα π.χ δηλ σελ αρ βλ κ.λπ डॉ रु श्री सं पृ พ.ศ ค.ศ น.ส".split()
)


#: Weights before training.
PRIOR = {"a<True": -3.0, "k>small": -3.0, "f<initial": -2.0, "m...": -0.5}


class Place(NamedTuple):
    """A place that may be a boundary."""

    end: int
    mark: str
    before: str
    after: str


class Thai(NamedTuple):
    """The model of text without marks: weights of the letters on both sides, the weight of a blank, and the turns."""

    weights: dict[str, float]
    blank: float
    turn: tuple[tuple[float, float], tuple[float, float]]


class Model(NamedTuple):
    weights: dict[str, float]
    words: dict[str, tuple[int, int]]  # word before a mark: at the end of a line, within it; words after with a leading blank
    turn: tuple[tuple[float, float], tuple[float, float]]
    thai: Thai


def kind_of(after: str) -> str:
    """What follows: capital, small, camel (a name as iFolio), digit, opener, wide, other, or end."""
    if not after:
        return "end"
    c = after[0]
    if c in "\"'“„«‹「『(（[【¿¡‘":
        return "opener" + (kind_of(after[1:]) if len(after) > 1 else "")
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "capital"
    if c.islower():
        return "camel" if any(x.isupper() for x in after[1:]) else "small"
    return "wide" if WIDE.match(c) else "letter" if c.isalpha() else "sign" + c


@lru_cache(maxsize=200_000)
def plain(word: str, left: bool) -> str:
    """A word for counting: digits alike, brackets and quotes off; of scripts without blanks the two letters at the mark."""
    w = DIGITS.sub("0", word).strip("\"'“”„«»‹›「」『』()（）[]【】,;:، ")
    edge = w[-1:] if left else w[:1]
    if edge and WIDE.search(edge):
        w = w[-2:] if left else w[:2]
    elif edge and THAI.search(edge):
        w = w[-4:] if left else w[:4]
    return w[-14:] if left else w[:14]


def quotations(line: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether the sentence goes on behind it, of each quotation of a line."""
    out = []
    for m in QUOTED.finditer(line):
        rest = line[m.end() :]
        nearest = rest.lstrip()
        goes_on = bool(nearest) and (nearest[0] in ",;:،，、" or kind_of(nearest.split(None, 1)[0]) in ("small", "letter", "wide") or not (line[m.end() - 2 : m.end() - 1].strip() and line[: m.end() - 1].rstrip()[-1] in ".!?。！？।…"))
        out.append((m.start(), m.end(), goes_on))
    return out


def places(line: str) -> list[Place]:
    """The places of a line that may be boundaries, its end left out."""
    out = []
    last = len(line.rstrip())
    spans = None
    for m in MARK.finditer(line):
        start, end = m.span()
        mark = m.group()
        if end >= last:
            break
        if ";" in mark and not (start and "Ͱ" <= line[start - 1] <= "Ͽ"):
            continue
        if mark[0] == "." and start and "฀" <= line[start - 1] <= "๿":
            continue  # Thai sentences have no full stop; it ends abbreviations
        at = max(line.rfind(" ", 0, start), line.rfind("\u00a0", 0, start)) + 1
        before = line[max(at, start - 24) : start]
        rest = line[end : end + 40].split(None, 1)
        if spans is None:
            spans = quotations(line) if QUOTED.search(line) else []
        # in a quotation after which the sentence goes on, its last mark included, nothing ends
        if not any(a < start < b and on for a, b, on in spans):
            out.append(Place(end, mark, before, rest[0] if rest else ""))
    return out


def shape(mark: str) -> str:
    core = mark.rstrip("\"'”’“»›」』)]）】   ")
    return ("..." if len(core) > 1 and set(core) <= {".", "…"} else core[:1]) + ("q" if len(core) < len(mark) and mark[-1] not in ")）]】" else "b" if len(core) < len(mark) else "")


def rate(seen: tuple[int, int] | None) -> str:
    """How often a word is at the end (beginning) of a line among all its places at marks, in steps."""
    if seen is None or sum(seen) < MIN_SEEN:
        return "?"
    r = seen[0] / sum(seen)
    return "0" if r < 0.002 else "1" if r < 0.02 else "2" if r < 0.08 else "3"


def side_features(word: str, left: bool, words: dict[str, tuple[int, int]]) -> list[str]:
    """Features of the word on one side of a mark."""
    w = plain(word, left)
    if left:
        bare = w.strip("(")
        form = "none" if not w else "initial" if len(w) == 1 and w.isupper() else "one" if len(w) == 1 else "number" if w.strip("0.,%°") == "" else "dotted" if "." in w else "short" if len(w) <= 4 else "long"
        return [f"w<{w}", f"f<{form}", f"r<{rate(words.get(w))}", f"fr<{form}{rate(words.get(w))}", f"a<{bare in ABBREVIATIONS}"]
    return [f"w>{w}", f"r>{rate(words.get(' ' + w))}", f"k>{kind_of(word)}"]


def joint_features(p: Place, words: dict[str, tuple[int, int]]) -> list[str]:
    """Features of the mark together with both sides."""
    k, s = kind_of(p.after), shape(p.mark)
    w = plain(p.before, True)
    a = w.strip("(") in ABBREVIATIONS
    digits = len(w) if w.strip("0") == "" else -1
    small_number = p.before.strip("(").isdigit() and len(p.before.strip("(")) <= 2
    return [f"m{s}", f"mk{s}{k}", f"ak{a}{k}", f"rk{rate(words.get(w))}{k}", f"dk{digits >= 0}{small_number}{k}{rate(words.get(' ' + plain(p.after, False)))}", f"mrk{s}{rate(words.get(w))}{rate(words.get(' ' + plain(p.after, False)))}"]


def features(p: Place, words: dict[str, tuple[int, int]]) -> list[str]:
    return [*side_features(p.before, True, words), *side_features(p.after, False, words), *joint_features(p, words)]


def sure(p: Place, words: dict[str, tuple[int, int]]) -> bool | None:
    """Whether a place within a line is surely a boundary (True), surely not (False), or neither (None)."""
    k = kind_of(p.after)
    w = plain(p.before, True)
    if k == "small" or k.startswith("sign") and p.mark[0] in ".…;":
        return False
    if p.mark[0] in "。！？।॥!?؟｡;":
        return True
    if w.strip("(") in ABBREVIATIONS and k != "opener":
        # an abbreviation that also ends lines may end a sentence
        return None if rate(words.get(w)) in "23" else False
    if len(w) == 1 and w.isalpha():
        return False
    after = rate(words.get(" " + plain(p.after, False)))
    if p.before.strip("(").isdigit() and len(p.before) <= 2 and k == "capital" and after in "01":
        return False  # an ordinal: day before a month
    before = rate(words.get(w))
    if before == "0" and len(w) <= 6:
        return False
    return True if before in "?123" or len(w) > 6 else None


def examples(texts: list[str], words: dict[str, tuple[int, int]]) -> Iterator[list[tuple[Place, bool]]]:
    """Chains of places with their labels: lines put together in pairs, so that a line end is one more place."""
    for text in texts:
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        for one, two in zip(lines, [*lines[1:], ""], strict=False):
            chain = [(p, sure(p, words)) for p in places(one)]
            if two:
                both = f"{one} {two}"
                chain += [(p, True) for p in places(both) if p.end == len(one)]
            yield [(p, v) for p, v in chain if v is not None]


def regression(index: dict[str, int], rows: list[int], owner: list[int], y: list[bool], prior: dict[str, float], rounds: int, l2: float) -> tuple[dict[str, float], float]:
    """Logistic regression (AdaGrad): weights by feature, those near zero left out, and the bias."""
    place, own, target = np.array(rows), np.array(owner), np.array(y, float)
    w, b, seen, seen_b = np.array([prior.get(x, 0.0) for x in index]), 0.0, np.full(len(index), 1e-8), 1e-8
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(np.bincount(own, w[place], minlength=len(y)) + b))) - target
        g = np.bincount(place, e[own], minlength=len(index)) / len(y) + l2 * w
        seen += g * g
        seen_b += e.mean() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * e.mean() / math.sqrt(seen_b)
    return {k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-4}, float(b)


def is_thai(c: str) -> bool:
    return "\u0e01" <= c <= "\u0e3a" or "\u0e40" <= c <= "\u0e5b"


def gaps(line: str) -> tuple[str, list[tuple[int, int, bool]]]:
    """The line without blanks, and every place between two Thai letters of it: place there, end in the line, whether a blank stood in it."""
    at = [i for i, c in enumerate(line) if c not in " \u00a0"]
    bare = "".join(line[i] for i in at)
    return bare, [(k, at[k] + 1, at[k + 1] > at[k] + 1) for k in range(len(at) - 1) if is_thai(bare[k]) and is_thai(bare[k + 1])]


def letter_features(bare: str, k: int) -> list[str]:
    """The letters before and after a place of text without blanks."""
    left, right = bare[max(0, k - 4) : k + 1], bare[k + 1 : k + 6]
    return [*(f"<{left[-n:]}" for n in range(1, 6)), *(f">{right[:n]}" for n in range(1, 6)), f"={left[-1:]}{right[:1]}", f"={left[-2:]}|{right[:2]}"]


def train_thai(texts: list[str], rounds: int = 60, l2: float = 1e-5) -> Thai:
    """The model of Thai from texts whose blanks and line ends are stripped."""
    index: dict[str, int] = {}
    rows, owner, y = [], [], []
    turns, blanks = np.ones((2, 2)), 0
    for text in texts:
        lines = [x.strip() for x in text.split("\n") if THAI.search(x) and not ROW.search(x)]
        bare, last = " ".join(lines), None
        for k, end, blank in (found := gaps(bare))[1]:
            f = [index.setdefault(x, len(index)) for x in letter_features(found[0], k)]
            rows += f
            owner += [len(y)] * len(f)
            y.append(blank)
            blanks += blank
            if last is not None:
                turns[int(last), int(blank)] += 1
            last = blank
    if not blanks:
        return Thai({}, THAI_BOUND + 1, ((0.0, 0.0), (0.0, 0.0)))
    weights, bias = regression(index, rows, owner, y, {}, rounds, l2)
    p = turns.sum(0) / turns.sum()
    t = np.log(turns / turns.sum(1, keepdims=True)) - np.log(p)
    # a blank between letters stood at a boundary ``blanks`` times and inside never (counted as half a time)
    return Thai(weights | {"b": bias}, math.log((blanks + 0.5) / 0.5) + THAI_BOUND, ((t[0, 0], t[0, 1]), (t[1, 0], t[1, 1])))


def thai_ends(line: str, model: Thai, at_blanks: bool = True) -> list[int]:
    """The boundaries between Thai letters of a line; with ``at_blanks`` only where a blank stands."""
    bare, found = gaps(line)
    if not found or at_blanks and not any(blank for *_, blank in found):
        return []
    get = model.weights.get
    scores = []
    for k, _, blank in found:
        s = sum(get(f, 0.0) for f in letter_features(bare, k)) + get("b", 0.0)
        scores.append(min(THAI_BOUND, max(-THAI_BOUND, s)) + model.blank if at_blanks and blank else -1e9 if at_blanks else s)
    return [end for (_, end, _), b in zip(found, viterbi(scores, model.turn), strict=True) if b]


def train(texts: list[str], words: dict[str, tuple[int, int]], thai: Thai, rounds: int = 60, l2: float = 1e-5) -> Model:
    """Weights by logistic regression, turns from the labels' counts."""
    index: dict[str, int] = {}
    rows, owner, y = [], [], []
    turns = np.ones((2, 2))
    for chain in examples(texts, words):
        last = None
        for p, v in chain:
            f = [index.setdefault(x, len(index)) for x in features(p, words)]
            rows += f
            owner += [len(y)] * len(f)
            y.append(v)
            if last is not None:
                turns[int(last), int(v)] += 1
            last = v
    if not y:
        return Model(PRIOR | {"b": 1.0}, words, ((0.0, 0.0), (0.0, 0.0)), thai)
    weights, bias = regression(index, rows, owner, y, PRIOR, rounds, l2)
    p = np.array([turns[:, 0].sum(), turns[:, 1].sum()]) / turns.sum()
    t = np.log(turns / turns.sum(1, keepdims=True)) - np.log(p)
    t = np.clip(0.3 * t, -0.5, 0.5)  # the places' own features already tell most of it
    return Model(PRIOR | weights | {"b": bias}, words, ((t[0, 0], t[0, 1]), (t[1, 0], t[1, 1])), thai)


class Tagger:
    """Scores of places with cached words, and the decoding."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[object, float] = {}

    def score(self, p: Place) -> float:
        get, words, cache = self.model.weights.get, self.model.words, self.cache
        left, right = (True, p.before), (False, p.after)
        for key in (left, right):
            if key not in cache:
                cache[key] = sum(get(f, 0.0) for f in side_features(key[1], key[0], words))
        joint = (p.mark, plain(p.before, True), plain(p.after, False), kind_of(p.after), p.before.strip("(").isdigit() and len(p.before.strip("(")) <= 2)
        if joint not in cache:
            cache[joint] = sum(get(f, 0.0) for f in joint_features(p, words))
        out = cache[left] + cache[right] + cache[joint] + get("b", 0.0)
        if len(cache) > 300_000:
            cache.clear()
        return out

    def units(self, text: str) -> list[int]:
        """The ends of the units of a text."""
        ends, at = [], 0
        for line in text.split("\n"):
            last = len(line.rstrip())
            if last:
                own = places(line)
                if own:
                    ends += [at + p.end for p, b in zip(own, viterbi([self.score(p) for p in own], self.model.turn), strict=True) if b]
                if THAI.search(line) and not ROW.search(line):
                    ends = sorted({*ends, *(at + e for e in thai_ends(line[:last], self.model.thai))})
                ends.append(at + last)
            at += len(line) + 1
        return ends


def viterbi(scores: list[float], turn: tuple[tuple[float, float], tuple[float, float]]) -> list[bool]:
    """The best labels of a chain: score for a boundary, 0 for inside, turn[a][b] from label a to b; a line begins after a boundary."""
    inside, boundary, back = turn[1][0], turn[1][1] + scores[0], []
    for s in scores[1:]:
        i = (inside + turn[0][0], boundary + turn[1][0])
        b = (inside + turn[0][1], boundary + turn[1][1])
        back.append((i[1] > i[0], b[1] > b[0]))
        inside, boundary = max(i), max(b) + s
    now = boundary > inside
    out = [now]
    for from_inside, from_boundary in reversed(back):
        now = from_boundary if now else from_inside
        out.append(now)
    return out[::-1]


def word_counts(texts: list[str]) -> Counter:
    """(word, at an end or beginning of a line) at marks; words after a mark have a leading blank."""
    out: Counter = Counter()
    for text in texts:
        for line in text.split("\n"):
            t = line.strip()
            if not t:
                continue
            for p in places(t):
                out[(plain(p.before, True), False)] += 1
                out[(" " + plain(p.after, False), False)] += 1
            m = MARK.search(t, max(0, len(t) - 6))
            while m and m.end() < len(t):
                m = MARK.search(t, m.end())
            if m:
                out[(plain(t[max(t.rfind(" ", 0, m.start()), t.rfind("\u00a0", 0, m.start())) + 1 : m.start()], True), True)] += 1
            if " | " not in t:
                out[(" " + plain(t.split(None, 1)[0][:40], False), True)] += 1
    return out


def counted_words(texts: DataFrame) -> dict[str, tuple[int, int]]:
    """Counts of the words on a share of at least WORD_SHARE of the marks, over all texts (a column of strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(word_counts(batch.column(0).to_pylist()))
            if len(total) > 500_000:
                yield out(total)
                total = Counter()
        yield out(total)

    def out(total: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k[0] for k in total], pa.string()), pa.array([n if k[1] else 0 for k, n in total.items()], pa.int64()), pa.array([0 if k[1] else n for k, n in total.items()], pa.int64())], names=["word", "outer", "inner"])

    counts = spread(texts).mapInArrow(run, "word string, outer long, inner long").groupBy("word").agg(F.sum("outer").alias("outer"), F.sum("inner").alias("inner"))
    # Names come once or twice; without them the sum over the words kept is still nearly the number of marks.
    common = cut(counts.where(F.col("outer") + F.col("inner") >= MIN_SEEN))
    total = common.agg(F.sum(F.col("outer") + F.col("inner"))).first()[0] or 0
    rows = common.where(F.col("outer") + F.col("inner") >= total * WORD_SHARE).collect()
    return {r.word: (r.outer, r.inner) for r in rows}


def sentence_units(records: DataFrame) -> DataFrame:
    """rec_table, rec_id and end_pos of every unit of ``records`` (rec_table, rec_id, text)."""
    texts = records.where("text IS NOT NULL").select("text")
    words = counted_words(texts)
    thai = F.col("text").rlike(r"\p{IsThai}")
    n, n_thai = texts.agg(F.count("*"), F.count_if(thai)).first()
    draw = F.shiftrightunsigned(F.xxhash64("rec_table", "rec_id"), 33)
    below = lambda most, of: draw < int(min(1.0, most / max(1, of)) * 2**31)
    present = records.where("text IS NOT NULL")
    sample = [r.text for r in present.where(below(TRAIN_TEXTS, n)).select("text").limit(2 * TRAIN_TEXTS).collect()]
    marked = [r.text for r in present.where(thai & below(TRAIN_THAI, n_thai)).select("text").limit(2 * TRAIN_THAI).collect()]
    told = records.sparkSession.sparkContext.broadcast(train(sample, words, train_thai(marked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(told.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ends = [tagger.units(t) for t in part.column(2).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(ends)), [len(e) for e in ends]))
                yield pa.record_batch([part.column(0).take(of), part.column(1).take(of), pa.array([x for e in ends for x in e], pa.int64())], names=["rec_table", "rec_id", "end_pos"])

    return spread(records.where("text IS NOT NULL").select("rec_table", "rec_id", "text")).mapInArrow(run, "rec_table string, rec_id string, end_pos long")
