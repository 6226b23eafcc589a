"""Texts that lost their end (problem 8).

Only the end of a text can be cut, so everything before its last word shows how words go on. From all texts come

* the vocabulary as a trie: a Spark table of its nodes, every prefix of every word, with whether a word ends there and how often that word was the end of a line without a mark
  and how often it went on (with a mark, a blank and more, or letters); the same for kinds of words (names, numbers and so on);
* the forms of list items and table rows (names and numbers left out), also as a trie, by words.

A last line is closed when it ends with a mark (quotes and brackets closed after it, and no word that never ends a line before it). Of a line of prose without a mark
the trie decides by its last word (``asked``): an unknown proper prefix of known words is cut, and so is a known word that in the corpus goes on (``GOES_ON`` of
its places at least); for words the trie doesn't have, their kind decides in the same way. Without a vocabulary nothing of this is cut.
A text that ends with a sign of omission or a broken character is cut. An open list item or row is cut if its form is an inner
node of the trie of forms only, or if its final word is unknown and a proper prefix of known words; a reference without its number and an address without a host too. Scripts
without marks are judged by the last letters: whether these ever end a unit.

Lengths add what the words can't show: where at least ``LIMIT_SHARE`` of a source's different texts have one length and most of these are open, that length
is a limit of the source, and open texts of that length are cut whatever their last line looks like.

Vocabulary, forms and lengths are counted over all texts. The nodes of the vocabulary and the lengths stay in Spark and are joined; words and forms on a fixed share of all lines, at most 1 / share of
them, are also handed to the tasks, for the forms.

Edge cases: null, empty and blank texts are no cases and count for no rate. A null source is a source of its own. Copies are judged alike. White space at the end is left out, but counts for the
length. Very long texts are read whole, though only their last line is judged. Repeated rows count as rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.runtime import cut, spread

WORD_SHARE, FORM_SHARE, MIN_SEEN = 1 / 50_000, 1 / 50_000, 3
#: Number of the counts of kinds of words.
CLASS = 3
#: Different open texts of one source and length (a share of the source's different texts, and at least so many), and the part of the texts of that length that is open, that make a limit.
LIMIT_SHARE, LIMIT_TEXTS, LIMIT_OPEN = 0.01, 4, 0.8

#: Share of a word's places without a mark at which more follows, from which on it can't be an end; copies of a node so that a frequent last word meets in several tasks.
GOES_ON, SALTS = 0.5, 16

#: Signs put after a cut text.
OMISSION = regex.compile(r"\s*(?:…|\.\.\.+|[\[(]\s*(?:…|\.\.\.+|more|truncated|continued|cut|mehr|suite|más|далее)\s*[\])]|�)+\s*$", regex.IGNORECASE)
CLOSED = regex.compile(r"[.!?。！？।॥؟｡]+[\"'”’“»›」』)\]）】]*(?:[ \u00a0\u202f][»›])?$")
QUESTION = regex.compile(r"\p{Greek}[^.!?;]*;$")
PAIRS = (("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("(", ")"), ("[", "]"), ("（", "）"))
DIGITS = regex.compile(r"\p{Nd}+(?:[.,\u00a0\u202f]\p{Nd}+)*")
THAI = regex.compile(r"\p{Thai}")
CAPITAL = regex.compile(r"^\P{L}*\p{Lu}")
EDGES = "\"'“”„«»‹›「」『』()（）[]【】,;:،、"


def kind_of(line: str) -> str:
    """item, row, reference, signature, address, bracket, or prose."""
    t = line.strip()
    if regex.match(r"[-–•*] |\p{Nd}{1,2}[.)] ", t):
        return "item"
    if " | " in t or t.endswith(" |"):
        return "row"
    if regex.match(r"\p{Lu}[\p{L}]{1,7}: ?[\p{Lu}\p{Nd}/_-]*$", t):
        return "reference"
    if t.startswith("—"):
        return "signature"
    if regex.match(r"(?:https?://|www\.)\S*$", t):
        return "address"
    if t.startswith("(") and t.endswith(")"):
        return "bracket"
    return "prose"


class Told(NamedTuple):
    """What the tasks are told: tries of the vocabulary and of the forms, endings of scripts without marks, words with a full stop."""

    words: dict[str, bool]  # node -> a word ends here
    forms: dict[str, bool]
    endings: dict[str, bool]  # last letters in scripts without marks -> they end units
    never_last: frozenset[str]
    classes: frozenset[str]  # kinds of words that go on


def class_of(word: str) -> str:
    """The kind of a word: the script of its first letter with capital or not, digits, or the sign itself."""
    c = word[:1]
    if c.isdigit():
        return "0"
    return "W" if c.isupper() else "w" if c.islower() else "L" if c.isalpha() else f"sign {c}"


def last_word(line: str) -> str:
    """The last word of a line without the marks around it, or its last sign."""
    last = line.split()[-1]
    return last.strip(EDGES).rstrip(".") or last[-1]


def trie(words: list[str], ends_of) -> dict[str, bool]:
    """The nodes of the trie of ``words``: every prefix (``ends_of`` gives them), with whether a word ends there."""
    nodes: dict[str, bool] = {}
    for w in words:
        for p in ends_of(w):
            nodes.setdefault(p, False)
        nodes[w] = True
    return nodes


def letters(word: str) -> Iterator[str]:
    return (word[:i] for i in range(1, len(word)))


def steps(form: str) -> Iterator[str]:
    parts = form.split(" ")
    return (" ".join(parts[:i]) for i in range(1, len(parts)))


def form_of(line: str, words: dict[str, bool]) -> str:
    """A line with its numbers as 0 and words that are not in the vocabulary as W."""
    out = []
    for w in DIGITS.sub("0", line.strip()).split():
        bare = w.strip(EDGES)
        out.append(w if not bare or not bare[0].isalpha() or words.get(bare) and not CAPITAL.match(bare) or words.get(bare) and len(bare) < 4 else "W")
    return " ".join(out)


def whole_lines(text: str) -> list[str]:
    """All lines but the last."""
    return [x.strip() for x in text.rstrip().split("\n")[:-1] if x.strip()]


def balanced(line: str) -> bool:
    """Whether every quotation and bracket opened in the line is closed."""
    if line.count('"') % 2:
        return False
    if line.count("„"):
        return line.count("„") <= line.count("“") + line.count("”")
    return all(line.count(a) <= line.count(b) for a, b in PAIRS)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def evidence(text: str, told: Told) -> str:
    """cut, closed, open (whole as far as its words show), or ask (prose without a mark: its last word is to be looked up)."""
    t = text.rstrip()
    sign = OMISSION.search(t)
    if sign:
        return "cut"
    line = t[t.rfind("\n") + 1 :].strip()
    kind = kind_of(line)
    if kind == "reference":
        return "open" if regex.search(r"\p{Nd}$", line) else "cut"
    if kind == "address":
        return "open" if regex.match(r"(?:https?://)?[^/]+\.\p{L}{2,}(?:[/?#:]|$)", line) else "cut"
    if kind in ("signature", "bracket"):
        return "open" if len(line) > 4 else "cut"
    if kind == "prose":
        if QUESTION.search(line):
            return "closed" if balanced(line) else "cut"
        if CLOSED.search(line):
            last = line.split()[-1]
            return "cut" if not balanced(line) or last in told.never_last else "closed"
        bare = line.rstrip("”“\"'»」)")
        if bare and THAI.search(bare[-1]):
            ends = told.endings.get(bare[-5:], True)  # letters never seen are a name's
            return ("closed" if bare != line else "open") if ends and balanced(line) else "cut"
        return "ask"
    if CLOSED.search(line) and kind == "item" and balanced(line):
        return "closed"
    last = line.split()[-1].strip(EDGES)
    if line[-1] in ",;|/-–:" or not last:
        return "cut"
    if last[0].isalpha() and not told.words.get(last):
        if last in told.words and not CAPITAL.match(last):
            return "cut"  # unknown, and a proper prefix of known words
        if kind == "item" and len(last) <= 3 and CAPITAL.match(last):
            return "cut"
    form = form_of(line, told.words)
    if told.forms.get(form):
        return "open"
    if form in told.forms:
        return "cut"
    head, _, tail = form.rpartition(" ")
    if tail == "W" and last[0].isalpha() and not CAPITAL.match(last) and head in told.forms and not any(told.forms.get(f"{head} {x}") for x in ("W",)):
        return "cut"
    return "open"


def learned(texts: DataFrame) -> tuple[Told, DataFrame]:
    """What the tasks are told of all texts (one column), and the words: key, n and ends."""
    sc = texts.sparkSession.sparkContext

    def counted(count, share: float) -> tuple[list[tuple[int, str, int]], DataFrame]:
        """(kind, key, n, ends) of the keys on at least ``share`` of all occurrences of their kind, and all of them. Tokens become words, words with a full stop and kinds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, ends, tokens = Counter(), Counter(), Counter()

            def out() -> pa.RecordBatch:
                for w, k in tokens.items():
                    bare = w.strip(EDGES)
                    if w[-1] == ".":
                        n[1, w] += k
                        bare = bare.rstrip(".")
                    if bare and bare[0].isalpha():
                        n[0, bare] += k
                    n[CLASS, class_of(bare or w[-1])] += k
                tokens.clear()
                keys = list(n)
                batch = pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64())], names=["kind", "key", "n", "ends"])
                n.clear()
                ends.clear()
                return batch

            for batch in batches:
                for text in batch.column(0).to_pylist():
                    count(text, n, ends, tokens)
                if len(n) + len(tokens) > 400_000:
                    yield out()
            yield out()

        sums = spread(texts).mapInArrow(run, "kind int, key string, n long, ends long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
        common = cut(sums.where((F.col("n") >= MIN_SEEN) | (F.col("kind") == CLASS)))
        totals = {r.kind: r.total for r in common.groupBy("kind").agg(F.sum("n").alias("total")).collect()}  # one row a kind
        enough = F.lit(False)
        for kind, total in totals.items():
            enough = enough | (F.col("kind") == kind) & (F.col("n") >= total * share)
        return [tuple(r) for r in common.where(enough | (F.col("kind") == CLASS)).select("kind", "key", "n", "ends").collect()], common

    def words(text: str, n: Counter, ends: Counter, tokens: Counter) -> None:
        lines = [x.strip() for x in text.rstrip().split("\n") if x.strip()]
        for line in lines[-1:]:
            tokens.update(line.split()[:-1])
        for line in lines[:-1]:
            parts = line.split()
            tokens.update(parts)
            last = parts[-1]
            if last[-1] == ".":
                ends[1, last] += 1
            elif kind_of(line) == "prose" and not CLOSED.search(line):
                bare = last.strip(EDGES)
                ends[0, bare] += 1
                ends[CLASS, class_of(bare or last[-1])] += 1
            if THAI.search(line):
                for i in range(4, len(line)):
                    if "฀" <= line[i] <= "๿":
                        last = i + 1 == len(line) or line[i + 1] in " ”" and (i + 2 >= len(line) or "฀" <= line[i + 2] <= "๿")
                        n[2, line[i - 4 : i + 1]] += 1
                        ends[2, line[i - 4 : i + 1]] += last

    rows, table = counted(words, WORD_SHARE)
    vocabulary = trie([key for kind, key, *_ in rows if kind == 0], letters)
    never_last = frozenset(key for kind, key, n, ends in rows if kind == 1 and n >= 20 and ends < 0.002 * n)
    endings = {key: n < 30 or ends >= 0.03 * n for kind, key, n, ends in rows if kind == 2}
    told = sc.broadcast(vocabulary)

    def forms(text: str, n: Counter, ends: Counter, tokens: Counter) -> None:
        for line in whole_lines(text):
            if kind_of(line) in ("item", "row"):
                n[0, form_of(line, told.value)] += 1

    found, _ = counted(forms, FORM_SHARE)
    goes_on = frozenset(key for kind, key, n, ends in rows if kind == CLASS and ends < (1 - GOES_ON) * n)
    return Told(vocabulary, trie([key for _, key, *_ in found], steps), endings, never_last, goes_on), table.where("kind = 0").select("key", "n", "ends")


def asked(seen: DataFrame, words: DataFrame) -> DataFrame:
    """``seen`` with the answers of the trie for the rows that ask for their last word: cut or open.

    Only the nodes of words that are asked for are kept; each stands ``SALTS`` times, so that the rows with a frequent last word are divided.
    """
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.struct(F.substring("key", F.lit(1), i).alias("word"), (i == F.length("key")).alias("whole"))))
    nodes = words.select("n", "ends", prefix.alias("node")).groupBy("node.word").agg(F.sum(F.when(F.col("node.whole"), F.col("n"))).alias("n"), F.sum(F.when(F.col("node.whole"), F.col("ends"))).alias("ends"))
    wanted = seen.where("evidence = 'ask'").select(F.col("last").alias("word")).distinct()
    nodes = nodes.join(wanted, "word", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("n").isNull() | (F.col("ends") < (1 - GOES_ON) * F.col("n"))
    nodes = nodes.select("word", "salt", on.alias("goes_on"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).withColumn("word", F.when(F.col("evidence") == "ask", F.col("last")))
    told = salted.join(nodes, ["word", "salt"], "left")
    answer = F.when(F.coalesce("goes_on", "class_goes_on"), "cut").otherwise("open")
    return told.withColumn("evidence", F.when(F.col("evidence") == "ask", answer).otherwise(F.col("evidence"))).drop("salt", "word", "last", "goes_on", "class_goes_on")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col, source and lost of every row with a text that is not blank."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source")).alias("row"), F.col(text_col).alias("text")).where(r"text RLIKE '(?U)\\S'")
    learnt, words = learned(rows.select("text"))
    told = docs.sparkSession.sparkContext.broadcast(learnt)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            judged = [evidence(t, own) if t.strip() else "blank" for t in texts]
            last = [last_word(t) if e == "ask" else None for t, e in zip(texts, judged, strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(np.fromiter(map(len, texts), np.int32, len(texts))), pa.array(judged, pa.string()), pa.array([hash_of(t) for t in texts], pa.int64()),
                    pa.array(last, pa.string()), pa.array([w is not None and class_of(w) in own.classes for w in last], pa.bool_()),
                ],
                names=["row", "length", "evidence", "hash", "last", "class_goes_on"],
            )

    seen = spread(rows).mapInArrow(run, f"row struct<id: {kind}, source: string>, length int, evidence string, hash long, last string, class_goes_on boolean").where("evidence <> 'blank'")
    seen = asked(cut(seen), words)
    seen = cut(seen.select(F.col("row.id").alias(id_col), F.col("row.source").alias("source"), "length", "evidence", "hash"))
    different = seen.groupBy("source", "length", "evidence", "hash").agg(F.lit(1).alias("one"))
    per_source = different.groupBy("source").agg(F.count("*").alias("texts"))
    lengths = different.groupBy("source", "length").agg(F.count("*").alias("n"), F.count_if(F.col("evidence") != "closed").alias("open"))
    limits = lengths.join(per_source, lengths.source.eqNullSafe(per_source.source)).where((F.col("open") >= LIMIT_TEXTS) & (F.col("open") >= F.col("texts") * LIMIT_SHARE) & (F.col("open") >= F.col("n") * LIMIT_OPEN))
    limits = limits.select(lengths.source.alias("of"), F.col("length").alias("limit"))
    at = seen.join(limits, seen.source.eqNullSafe(limits["of"]) & (F.col("length") == F.col("limit")), "left")
    return at.select(id_col, seen.source, ((F.col("evidence") == "cut") | (F.col("evidence") == "open") & F.col("limit").isNotNull()).alias("lost"))


def lost_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_col of every text that lost its end."""
    return judged(docs, id_col, text_col, source_col).where("lost").select(id_col)


def loss_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, texts, lost and rate."""
    return judged(docs, id_col, text_col, source_col).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("lost").alias("lost")).withColumn("rate", F.round(F.col("lost") / F.col("texts"), 4))
