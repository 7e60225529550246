"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding: lower case, marks and invisible characters dropped, accented, full-width, Cyrillic and Greek look-alikes to the Latin
letter, digits and signs that stand for letters to that letter, and i, l and 1 to one letter. Terms are folded in
the same way, so a disguised term equals the plain one. A term counts as a whole word that does not lie in an exception phrase.

In languages with marks, folding makes one term of words that differ (a toxic one with an acute, say, and a harmless one with a grave). Words with letters beyond
ASCII are therefore terms a second time as they are written, in lower case, with an automaton of their own; they are written with EXACT before them in the lexicon.

The lexicon is SEEDS and the words that labels teach: those of MIN_DOCS toxic training documents or more whose documents are toxic in at
least PRECISION of all cases. Of either label, documents that agree in all of MARKS minimum hashes of their words (copies, most near copies) count once. A term's weight is its smoothed log odds. The raw score is the sum of
the weights found per word of text (plus SMOOTH words); a logistic curve fitted to the training documents turns it into 0 to 1.

Fitted on all training documents: counts of a term cover all of them, and every term that passes is in the lexicon. The curve is fitted to
the raw scores of all of them, counted and averaged in bins of 1 / BINS. Every document is scored over its whole text.

Defined cases: a document with labels of both kinds teaches nothing; null or empty text has no hits and gets the score of none; without labels of both kinds the seeds and fixed curve decide;
repeated rows score equally; other columns are not read, and those named like a result give way to it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .words import mix

THRESHOLD = 0.7
BINS = 4096
MIN_DOCS = 4
MARKS = 4
PRECISION = 0.85
SMOOTH = 20
EXACT = "="
SEED_WEIGHT = 4.0

#: Words that insult a person or a group of readers, whatever the corpus.
SEEDS = (
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "scum", "scumbag", "trash", "worthless", "pathetic", "loser", "losers",
    "clown", "disgusting", "vermin", "filthy", "dumbass", "bastard", "bastards", "asshole", "bitch", "fuck", "fucking", "shit", "cunt",
    "whore", "slut", "retard", "subhuman", "parasite", "degenerate",
)
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown award", "pond scum", "soap scum", "host parasite", "parasite load", "idiot light", "idiot proof", "filthy water")

#: Look-alikes that no decomposition gives: Cyrillic, Greek and others, each over its Latin letter.
_ALIKE = (
    "аɑα a", "вβ b", "сϲ c", "ԁ d", "еєεё e", "ɡ g", "һн h", "іιїı i", "ј j", "кκ k", "ӏ l", "мμ m", "пη n", "оοσ o", "рρ p", "ԛ q", "гг r", "ѕ s",
    "тτ t", "υц u", "ѵν v", "ѡω w", "хχ x", "уγ y", "ʐ z",
)
#: Digits and signs that stand for a letter.
_DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "|": "l", "i": "l"}
_INVISIBLE = (*range(0x200B, 0x2010), 0x00AD, 0x2060, 0xFEFF)


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: None for c in (*range(0x300, 0x370), *_INVISIBLE)}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if plain != chr(c) and plain.isascii():
            table[c] = plain
    table |= {ord("ß"): "ss", ord("ø"): "o", ord("đ"): "d", ord("ł"): "l"}
    for line in _ALIKE:
        letters, plain = line.split(" ")
        table |= {ord(x): plain for x in letters}
    table |= {ord(k): v for k, v in _DIGITS.items()}
    for c, plain in list(table.items()):  # once more, for what folds to i or a digit
        if plain:
            table[c] = "".join(_DIGITS.get(x, x) for x in plain)
    return table


_FOLD = _fold_table()
_SIGNS = re.compile(r"[@$](?=[@$]*\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text as terms are matched in it."""
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.translate(_FOLD)


def written(text: str) -> str:
    """The text in which terms are matched as they are written."""
    return unicodedata.normalize("NFC", text.lower())


def terms_of(text: str) -> set[str]:
    """The words of a text that can be terms: folded, and those beyond ASCII as they are written too."""
    terms = {w for w in _WORD.findall(fold(text)) if 3 <= len(w) <= 40}
    if not text.isascii():
        terms |= {EXACT + w for w in _WORD.findall(written(text)) if 3 <= len(w) <= 40 and not w.isascii()}
    return terms


def mark_of(terms: set[str]) -> int:
    """A signature of MARKS minimum hashes of a text's terms, which texts that have a line or some words in common do not share."""
    if not terms:
        return 0
    own, out = np.array([zlib.crc32(t.encode()) for t in terms], np.uint64), np.zeros(1, np.uint64)
    for k in range(1, MARKS + 1):
        out = mix(out + mix(own + np.uint64(k << 32)).min())
    return int(out.view(np.int64)[0])


class Matcher:
    """The automata of a lexicon (term to weight), folded and as written, and of exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        folded = [(fold(phrase), 0.0) for phrase in exceptions] + [(t, float(w)) for t, w in lexicon.items() if not t.startswith(EXACT)]
        self.folded = self._automaton(folded)
        self.exact = self._automaton([(t.removeprefix(EXACT), float(w)) for t, w in lexicon.items() if t.startswith(EXACT)])

    @staticmethod
    def _automaton(words: list[tuple[str, float]]):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, weight in words:
            automaton.add_word(word, (len(word), weight))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    @staticmethod
    def _found(automaton, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every whole word or phrase found."""
        found, size = [], len(text)
        for end, (length, weight) in automaton.iter(text) if len(automaton) else ():
            start, end = end - length + 1, end + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end == size or not text[end].isalnum()):
                found.append((start, end, weight))
        return found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every term found, in the folded text, then in the text as written."""
        every = self._found(self.folded, fold(text))
        free = [h for h in every if not h[2]]
        hits = [h for h in every if h[2] and not any(a <= h[0] and h[1] <= b for a, b, _ in free)]
        return hits if text.isascii() else hits + self._found(self.exact, written(text))


def raw_score(matcher: Matcher, text: str | None) -> tuple[float, int]:
    """log(1 + weight per 1000 words), and the number of hits."""
    if not text:
        return 0.0, 0
    hits = matcher.hits(text)
    return (float(np.log1p(1000 * sum(h[2] for h in hits) / (len(text.split()) + SMOOTH))), len(hits)) if hits else (0.0, 0)


def _odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def _curve(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """A logistic curve by Newton's steps with a small ridge; the classes weigh alike, and a point as often as it is there."""
    w = times * np.where(y == 1, 0.5 / max(1, times[y == 1].sum()), 0.5 / max(1, times[y == 0].sum()))
    a, b = 0.0, 0.0
    m = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = m.T @ (w * (p - y)) + 1e-3 * np.array([0, b])
        h = (m * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ m + 1e-3 * np.diag([1e-3, 1])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    return float(a), float(max(b, 0.0))


def fit(docs: DataFrame, train: DataFrame, seeds=SEEDS, exceptions=EXCEPTIONS) -> dict:
    """lexicon, a, b: from the texts of docs and the ids and labels of train (doc_id, toxic: 0 or 1)."""
    sample = materialise(docs.select("doc_id", "text").join(train, "doc_id").select("toxic", "text"), "toxic-train")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    lexicon = {fold(s): SEED_WEIGHT for s in seeds}
    if not (n_toxic and n_clean):
        return {"lexicon": lexicon, "a": -3.0, "b": 1.0}

    def documents(label: int) -> DataFrame:
        """term, n: in how many documents of a label a term occurs, by their marks; the term "" is all of them."""

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[str, int]] = set()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    own = terms_of(text or "")
                    mark = mark_of(own)
                    seen.update((t, mark) for t in own)
                    seen.add(("", mark))
                    if len(seen) > 200_000:
                        yield rows(seen)
                        seen.clear()
            yield rows(seen)

        def rows(seen: set[tuple[str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([m for _, m in seen], pa.int64())], names=["term", "mark"])

        return sample.where(F.col("toxic") == label).select("text").mapInArrow(terms, "term string, mark long").groupBy("term").agg(F.countDistinct("mark").alias("n"))

    often = documents(1).where((F.col("n") >= MIN_DOCS) | (F.col("term") == ""))
    both = often.join(documents(0).withColumnRenamed("n", "_other"), "term", "left").withColumn("_other", F.coalesce("_other", F.lit(0)))
    # Only what can be in the lexicon comes to the driver.
    passes = (F.col("n") / (F.col("n") + F.col("_other")) >= PRECISION) | F.col("term").isin("", *lexicon)
    found = both.where(passes).collect()
    picked, other = {r["term"]: r["n"] for r in found}, {r["term"]: r["_other"] for r in found}
    n_toxic, n_clean = picked.pop(""), other.pop("")
    for s in list(lexicon):
        lexicon[s] = max(1.0, _odds(picked.get(s, 0), other.get(s, 0), n_toxic, n_clean)) if s in picked else SEED_WEIGHT
    # Folded terms first: what is found by them needs no term as written.
    for t in sorted((t for t, n in picked.items() if n / (n + other.get(t, 0)) >= PRECISION), key=lambda t: (t.startswith(EXACT), t)):
        if not (t.startswith(EXACT) and fold(t.removeprefix(EXACT)) in lexicon):
            lexicon.setdefault(t, _odds(picked[t], other.get(t, 0), n_toxic, n_clean))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon, exceptions)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([raw_score(m, t)[0] for t in batch.column("text").to_pylist()], pa.float64())], names=["toxic", "x"])

    bins = sample.mapInArrow(raw, "toxic int, x double").groupBy("toxic", F.floor(F.col("x") * BINS).alias("_bin")).agg(F.sum(F.round(F.col("x") * (1 << 40)).cast("decimal(38,0)")).alias("x"), F.count(F.lit(1)).alias("n"))
    points = sorted((r["toxic"], r["_bin"], int(r["x"]) / r["n"] / (1 << 40), r["n"]) for r in bins.collect())
    y, _, x, times = (np.array(c, float) for c in zip(*points))
    a, b = _curve(x, y, times)
    return {"lexicon": lexicon, "a": a, "b": b}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD, exceptions=EXCEPTIONS) -> DataFrame:
    """The columns of docs (which has text), then score, n_hits and predicted. No column but text is read."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # terms that pass

    @F.pandas_udf("struct<score:double,n_hits:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, a, b = Matcher(held.value["lexicon"], exceptions), held.value["a"], held.value["b"]
        for texts in batches:
            found = [raw_score(m, t) for t in texts]
            x = np.array([f[0] for f in found])
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-(a + b * x))), "n_hits": [f[1] for f in found]})

    kept = [c for c in docs.columns if c not in ("score", "n_hits", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], run(F.col("text").cast("string")).alias("__toxicity"))
    found = F.col("__toxicity")
    return out.select(*[F.col(f"`{c}`") for c in kept], found["score"].alias("score"), found["n_hits"].alias("n_hits"), (found["score"] >= threshold).cast("int").alias("predicted"))


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the documents that may be learned from, without those that have labels of both kinds; no text is moved for it."""
    each = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1))
    own = each.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("_most")).where(F.col(label) == F.col("_most")).drop("_most")
    return docs.select("doc_id").where(~held_out()).distinct().join(own, "doc_id")


def sampled(docs: DataFrame, train: DataFrame, label: str, most_0: int, most_1: int) -> DataFrame:
    """doc_id, text and label of at most so many training documents of each label, by hash of doc_id. The bounded ids go to the texts."""
    rank = F.xxhash64(F.lit(11), "doc_id")
    ids = [train.where(F.col(label) == v).orderBy(rank, "doc_id").limit(most) for v, most in ((0, most_0), (1, most_1))]
    return docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, then held_out, score, n_hits and predicted."""
    model = fit(docs, labelled(docs, labels, "toxic"))
    return score(docs.withColumn("held_out", held_out()), model, threshold)
