"""Language identification by interpolated Kneser-Ney character language models.

Text is lower-cased; letters stay, every run of other characters is one space, and a space stands at both ends.
For each language, counts of all ORDER-character windows over all its training documents give an interpolated Kneser-Ney
model: raw counts at the top, numbers of distinct left neighbours below, one absolute discount an order (n1 / (n1 + 2 n2)),
and a uniform floor. The interpolated log probabilities of every window that any language has are stored in arrays sorted by
the window's 64-bit key (16 bits a character, so the key of the last n - 1 characters is its low bits), a column for each
language; contexts have arrays of backoff weights alike. A window that no language has backs off through them.

A text's language is that of the lowest cross-entropy per window. Its score is the softmax of the negative
cross-entropies times a temperature times the root of the number of windows; the temperature is fitted to training documents.
A text whose lowest cross-entropy lies more than REJECT standard deviations above the training mean of that
language is marked as rejected and its score halved.

Counts cover all training documents, and all windows enter the model. Up to MAX_WINDOWS (language, window) rows are one model that is broadcast.
More are dealt into blocks of up to so many (or those of one pair of characters, if that alone has more) by the two characters before a window's last: all
that the higher orders need of a window lies in its block; lower counts, discounts and the alphabet are taken over all windows. Each block is
broadcast and sums the log probabilities of its own windows in one pass over the texts; the sums of equal texts (by MD5) are added up
in the order of the blocks, so the result is that of one model. At most MAX_FIT documents (by hash) fit the temperature and the rejection.

Defined cases: null text or text without a letter: `und`, score 0; ties of cross-entropy go to the first language by code point;
without training documents everything is `und`; repeated rows have equal results; other columns are not read, and those named like a result give way to it. Characters
beyond the basic plane share 6,400 private code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ORDER = 4
MAX_WINDOWS = 2_000_000
MAX_FIT = 10_000
REJECT = 6.0
CHUNK = 1 << 20
UND = "und"
_SPACE = 32
#: Orders under this one have their counts taken over all windows, not in a block.
SHARED = 3
_U = np.uint64
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter (folded into 16 bits), else space."""
    global _letters
    if _letters is None:
        t = np.array([c if chr(c).isalpha() else _SPACE for c in range(0x110000)], np.int64)
        beyond = t > 0xFFFF
        t[beyond] = 0xE000 + t[beyond] % 6400
        _letters = t.astype(np.uint16)
    return _letters


def windows(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The window keys of texts, one after another, and the offsets of each text's windows."""
    raw = "\x00".join((t or "").lower() for t in texts) + "\x00"
    code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(code == 0)
    if len(ends) != len(texts):  # a text holds NUL itself
        raw = "\x00".join((t or "").lower().replace("\x00", " ") for t in texts) + "\x00"
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(code == 0)
    own = letters()[code]
    blank = own == _SPACE
    # Of a run of blanks the first stays; the NUL that ends a text is blank. A text without a leading blank gets one.
    keep = ~blank | np.append(True, ~blank[:-1])
    lead = np.append(0, ends[:-1] + 1)
    bare = ~blank[lead]
    keep[lead] = True
    size = np.add.reduceat(keep, lead, dtype=np.int64)
    # A blank lead and the run after it are one run; so are the last blank of a text and its NUL.
    seq, whose = own[keep], np.repeat(np.arange(len(texts)), size)
    same = np.append(False, (seq[1:] == _SPACE) & (seq[:-1] == _SPACE) & (whose[1:] == whose[:-1]))
    seq, whose = seq[~same], whose[~same]
    seq = np.insert(seq, np.searchsorted(whose, np.flatnonzero(bare)), _SPACE).astype(_U)
    whose = np.sort(np.concatenate([whose, np.flatnonzero(bare)]))
    n = len(seq) - order + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    key = np.zeros(n, _U)
    for k in range(order):
        key = (key << _U(16)) | seq[k : k + n]
    inside = whose[:n] == whose[order - 1 :]
    return key[inside], np.searchsorted(whose[:n][inside], np.arange(len(texts) + 1))


def _sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(key) else value


def _lookup(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.searchsorted(sorted_keys, key)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == key


def place(key: np.ndarray) -> np.ndarray:
    """Where a window stands among the blocks: the character before its last, then the one before that."""
    return (key & _U(0xFFFF0000)) | ((key >> _U(32)) & _U(0xFFFF))


def _place(key: Column) -> Column:
    """place() of a column."""
    return key.bitwiseAND(F.lit(0xFFFF0000)).bitwiseOR(F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(0xFFFF).cast("long")))


def _discount(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


class Judge:
    """From cross-entropies to languages and scores."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.temperature, self.limit = 1.0, np.full(len(languages), np.inf)

    def posterior(self, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        z = -entropy * (self.temperature * np.sqrt(size))[:, None]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def decide(self, entropy: np.ndarray, size: np.ndarray, none: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of each text; none: without a letter."""
        if not self.languages:
            return [UND] * len(none), np.zeros(len(none)), np.ones(len(none), bool)
        best = entropy.argmin(1)
        p = self.posterior(entropy, size)[np.arange(len(none)), best]
        rejected = entropy[np.arange(len(none)), best] > self.limit[best]
        return [UND if n else self.languages[b] for n, b in zip(none, best)], np.where(none, 0.0, np.where(rejected, p / 2, p)), rejected | none

    def calibrate(self, entropy: np.ndarray, size: np.ndarray, truth: list[str]) -> None:
        """Fit the temperature to the likelihood of true languages, and the rejection to their cross-entropies."""
        want = np.array([self.languages.index(x) for x in truth], np.int64)
        use = size > 0
        entropy, size, want = entropy[use], size[use], want[use]
        if not len(want):
            return
        best = (np.inf, 1.0)
        for t in 2.0 ** np.arange(-6, 5):
            self.temperature = t
            p = self.posterior(entropy, size)[np.arange(len(want)), want]
            best = min(best, (float(-np.log(np.maximum(p, 1e-6)).mean()), float(t)))
        self.temperature = best[1]
        own = entropy[np.arange(len(want)), want]
        for j in range(len(self.languages)):
            if (want == j).sum() >= 10:
                self.limit[j] = own[want == j].mean() + REJECT * own[want == j].std()

class Whole:
    """What a block of the windows cannot tell: languages, discounts by (language, order), alphabet, and counts of the lower orders."""

    def __init__(self, languages: list[str], discount: dict[tuple[str, int], float], alphabet: int, low: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]):
        self.languages, self.discount, self.alphabet, self.low = languages, discount, alphabet, low


class Model(Judge):
    """Kneser-Ney models of several languages in common sorted arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, whole: Whole | None = None):
        """counts: for each language its window keys and their counts; with whole, those of a block."""
        super().__init__(whole.languages if whole else sorted(counts))
        self.order = order
        none = np.zeros(0, _U), np.zeros(0)
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        levels = {}  # of each language: order -> (keys, counts)
        for name in self.languages:
            k, c = _sum_by(*counts.get(name, none))
            levels[name] = {order: (k, c.astype(float))}
            for n in range(order - 1, 0, -1):
                low = k & _U((1 << 16 * n) - 1)
                k, c = _sum_by(low, np.ones(len(low)))
                if whole and n < SHARED:
                    k, c = _sum_by(*whole.low[n].get(name, none))
                levels[name][n] = (k, c)
        alphabet = max(2, len(np.unique(np.concatenate([v[1][0] for v in levels.values()]))) + 1) if levels else 2
        self.floor = -np.log(whole.alphabet if whole else alphabet)
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([levels[x][n][0] for x in self.languages])) if levels else np.zeros(0, _U)
            contexts = np.unique(keys >> _U(16)) if n > 1 else np.zeros(1, _U)
            logp, backoff = np.zeros((len(keys), len(self.languages))), np.zeros((len(contexts), len(self.languages)))
            lower = np.full((len(keys), len(self.languages)), self.floor) if n == 1 else self.score_keys(keys & _U((1 << 16 * (n - 1)) - 1), n - 1)
            for j, name in enumerate(self.languages):
                k, c = levels[name][n]
                if not len(k):
                    logp[:, j] = lower[:, j]
                    continue
                d = whole.discount[name, n] if whole else _discount((c == 1).sum(), (c == 2).sum())
                ck, total = _sum_by(k >> _U(16) if n > 1 else np.zeros(len(k), _U), c)
                _, types = _sum_by(k >> _U(16) if n > 1 else np.zeros(len(k), _U), np.ones(len(k)))
                at, there = _lookup(ck, contexts)
                gamma = np.where(there, d * types[at] / total[at], 1.0)
                backoff[:, j] = np.log(np.maximum(gamma, 1e-9))
                at, there = _lookup(k, keys)
                seen = np.where(there, np.maximum(c[at] - d, 0), 0.0)
                cx, cx_there = _lookup(ck, keys >> _U(16) if n > 1 else np.zeros(len(keys), _U))
                seen = np.where(cx_there, seen / np.maximum(total[cx], 1e-9), 0.0)
                gx, _ = _lookup(contexts, keys >> _U(16) if n > 1 else np.zeros(len(keys), _U))
                logp[:, j] = np.log(seen + np.exp(backoff[gx, j] + lower[:, j]))
            self.keys[n], self.logp[n] = keys, logp.astype(np.float32)
            self.contexts[n], self.backoff[n] = contexts, backoff.astype(np.float32)

    def score_keys(self, key: np.ndarray, n: int) -> np.ndarray:
        """Log probability of the last character of each n-character window, a column for each language."""
        at, there = _lookup(self.keys[n], key)
        out = self.logp[n][at] if len(self.keys[n]) else np.zeros((len(key), len(self.languages)), np.float32)
        miss = np.flatnonzero(~there)
        if len(miss):
            lost = key[miss]
            lower = self.score_keys(lost & _U((1 << 16 * (n - 1)) - 1), n - 1) if n > 1 else np.float32(self.floor)
            cx, known = _lookup(self.contexts[n], lost >> _U(16) if n > 1 else np.zeros(len(lost), _U))
            out[miss] = lower + np.where(known[:, None], self.backoff[n][cx], np.float32(0))
        return out

    def sums(self, texts: list[str | None], after: int = -1, last: int = (1 << 32) - 1) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities under each language of the windows of each text that stand after one place up to another, and the number of all its windows."""
        out, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        every = after < 0 and last >= (1 << 32) - 1
        first = 0
        while first < len(texts):
            end, held = first, 0
            while end < len(texts) and (end == first or held + len(texts[end] or "") <= CHUNK):
                held += len(texts[end] or "")
                end += 1
            key, cut = windows(texts[first:end], self.order)
            size[first:end] = np.diff(cut)
            if not every:
                at = place(key).astype(np.int64)
                mine = (at > after) & (at <= last)
                key, cut = key[mine], np.append(0, np.cumsum(mine))[cut]
            if len(key):
                some = np.flatnonzero(np.diff(cut))
                out[first + some] = np.add.reduceat(self.score_keys(key, self.order), cut[:-1][some], axis=0, dtype=np.float64)
            first = end
        return out, size

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability a window under each language, and the number of windows, of each text."""
        out, size = self.sums(texts)
        return np.where(size[:, None] > 0, -out / np.maximum(size, 1)[:, None], 0.0), size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of each text."""
        entropy, size = self.cross_entropy(texts) if self.languages else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
        return self.decide(entropy, size, without_letter(texts))


def without_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([not any(c.isalpha() for c in t or "") for t in texts], bool)


class Blocks(Judge):
    """A model in blocks: (broadcast Model, the place after which and up to which its windows stand)."""

    def __init__(self, languages: list[str], parts: list[tuple]):
        super().__init__(languages)
        self.parts = parts

    def judge(self) -> Judge:
        out = Judge(self.languages)
        out.temperature, out.limit = self.temperature, self.limit
        return out

    @staticmethod
    def mark() -> Column:
        return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))

    def entropies(self, docs: DataFrame) -> DataFrame:
        """mark, n, none, e: cross-entropies, number of windows and whether without a letter, of every distinct text."""
        texts, parts = docs.select(self.mark().alias("mark"), F.col("text").cast("string").alias("text")), None
        for block, (held, after, last) in enumerate(self.parts):

            def run(batches: Iterator[pa.RecordBatch], block=block, held=held, after=after, last=last) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own = batch.column("text").to_pylist()
                    s, n = held.value.sums(own, after, last)
                    yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array([block] * len(own), pa.int32()), pa.array(n, pa.int64()), pa.array(without_letter(own)), pa.array(list(s), pa.list_(pa.float64()))], names=["mark", "block", "n", "none", "s"])

            part = texts.mapInArrow(run, "mark binary, block int, n long, none boolean, s array<double>")
            parts = part if parts is None else parts.union(part)
        one = parts.groupBy("mark", "block").agg(*(F.first(c).alias(c) for c in ("n", "none", "s")))
        each = one.groupBy("mark").agg(F.first("n").alias("n"), F.first("none").alias("none"), F.sort_array(F.collect_list(F.struct("block", "s"))).alias("p"))
        total = [F.aggregate(F.transform("p", lambda x: x["s"][j]), F.lit(0.0), lambda a, x: a + x) for j in range(len(self.languages))]
        return each.select("mark", "n", "none", F.array(*(F.when(F.col("n") > 0, -t / F.col("n")).otherwise(0.0) for t in total)).alias("e"))


def window_counts(train: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, key, n: windows of all training documents (lang, text), summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, texts: list[str]) -> None:
            key, _ = windows(texts, order)
            key, n = np.unique(key, return_counts=True)
            if lang in held:
                key, n = _sum_by(np.append(held[lang][0], key), np.append(held[lang][1], n))
            held[lang] = (key, n)

        for batch in batches:
            waiting: dict[str, list[str]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text or "")
                if size[lang] > 4 * CHUNK:
                    add(lang, waiting.pop(lang))
                    size[lang] = 0
            for lang, texts in waiting.items():
                add(lang, texts)
            if sum(len(k) for k, _ in held.values()) > 3_000_000:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    def rows(held) -> pa.RecordBatch:
        names = [x for x, (k, _) in held.items() for _ in range(len(k))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([k for k, _ in held.values()]).view(np.int64)), pa.array(np.concatenate([n for _, n in held.values()]).astype(np.int64))], names=["lang", "key", "n"])

    return train.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _by_language(got: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    lang, key, n = got["lang"].to_numpy(), got["key"].to_numpy().view(_U) if len(got) else np.zeros(0, _U), got["n"].to_numpy()
    return {x: (key[lang == x], n[lang == x]) for x in sorted(set(lang))}


def in_blocks(counts: DataFrame, total: int, order: int) -> Blocks:
    """The model of more windows than go into one."""
    spark = counts.sparkSession
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << 16 * n) - 1).cast("long"))
        levels[n] = materialise(levels[n + 1].groupBy("lang", low.alias("key")).agg(F.count(F.lit(1)).alias("n")), f"lang-windows-{n}")
    seen = [(r["lang"], n, r["n1"], r["n2"]) for n, t in levels.items() for r in t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()]
    languages = sorted({x for x, *_ in seen})
    discount = {(x, n): _discount(n1, n2) for x, n, n1, n2 in seen}
    alphabet = max(2, levels[1].select(F.col("key").bitwiseAND(F.lit(0xFFFF).cast("long"))).distinct().count() + 1)
    # The error of a cut is a tenth of a block, so a block has up to 1.2 / 1.25 of MAX_WINDOWS.
    blocks = -(-5 * total // (4 * MAX_WINDOWS))
    cuts = counts.select(_place(F.col("key")).cast("double").alias("p")).approxQuantile("p", [i / blocks for i in range(1, blocks)], 0.1 / blocks)
    edges = sorted({-1, (1 << 32) - 1, *(int(x) for x in cuts)})
    first = _by_language(levels[1].toArrow()) if order > 1 else {}  # 65,536 rows a language at most
    parts = []
    for after, last in zip(edges, edges[1:]):
        low = {1: first}
        if order > 2:
            low[2] = _by_language(levels[2].where(F.shiftright("key", 16).between((after + 1) >> 16, last >> 16)).toArrow())
        own = _by_language(counts.where((_place(F.col("key")) > after) & (_place(F.col("key")) <= last)).toArrow())
        parts.append((spark.sparkContext.broadcast(Model(own, order, Whole(languages, discount, alphabet, low))), after, last))
    return Blocks(languages, parts)


def fit(train: DataFrame, order: int = ORDER) -> Model | Blocks:
    """A model of training documents (doc_id, text, lang, all languages non-null)."""
    counts = materialise(window_counts(train, order), "lang-windows")
    total = counts.count()
    model = in_blocks(counts, total, order) if total > MAX_WINDOWS and order > 1 else Model(_by_language(counts.toArrow()), order)
    if model.languages:
        rank = F.xxhash64("doc_id", "text")
        ids = train.select("doc_id", rank.alias("_r")).orderBy("_r", "doc_id").limit(MAX_FIT)
        sample = train.withColumn("_r", rank).join(F.broadcast(ids), ["doc_id", "_r"], "left_semi").where(F.col("lang").isin(model.languages)).select("lang", "text")
        if isinstance(model, Blocks):
            scored = sample.select("lang", model.mark().alias("mark")).join(model.entropies(sample), "mark").select("lang", "n", "e")
        else:
            held = train.sparkSession.sparkContext.broadcast(model)  # MAX_WINDOWS windows at most

            def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    e, n = held.value.cross_entropy(batch.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64()), pa.array(list(e), pa.list_(pa.float64()))], names=["lang", "n", "e"])

            scored = sample.mapInArrow(entropies, "lang string, n long, e array<double>")
        rows = sorted(scored.collect())
        if rows:
            model.calibrate(np.array([r["e"] for r in rows]), np.array([r["n"] for r in rows]), [r["lang"] for r in rows])
    return model


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, model: Model | Blocks) -> DataFrame:
    """The columns of docs (which has text), then lang_pred, score and rejected."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    result = "struct<lang_pred:string,score:double,rejected:boolean>"
    if isinstance(model, Blocks):
        judge = model.judge()

        @F.pandas_udf(result)
        def decide(e: pd.Series, n: pd.Series, none: pd.Series) -> pd.DataFrame:
            lang, score, rejected = judge.decide(np.stack(e.to_list()) if len(e) else np.zeros((0, len(judge.languages))), n.to_numpy(), none.to_numpy(bool))
            return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

        decided = model.entropies(docs).select(F.col("mark").alias("__mark"), decide("e", "n", "none").alias("__language"))
        out = docs.select(*kept, model.mark().alias("__mark")).join(decided, "__mark", "left")
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(result)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                lang, score, rejected = held.value.predict(list(texts))
                yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

        out = docs.select(*kept, run(F.col("text").cast("string")).alias("__language"))
    return out.select(*kept, *(F.col("__language")[c].alias(c) for c in ("lang_pred", "score", "rejected")))


def language_id(docs: DataFrame) -> DataFrame:
    """The columns of docs (doc_id, text, lang), then held_out, lang_pred, score and rejected."""
    train = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull())
    return identify(docs.withColumn("held_out", held_out()), fit(train))
