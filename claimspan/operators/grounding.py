"""Evidence filter: claims stay if their snippet stands in the source document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import DIGITS, window_jaccard
from ..functions.text import SHORT_SNIPPET, strip, tokens

# Fixed value: the similarity from which a snippet counts as found.
THRESHOLD = 0.65


def similarity(claims: DataFrame, texts: DataFrame, unicode: bool = True) -> DataFrame:
    """The columns of claims (doc_id, snippet, ...) with n_tokens and similarity of the snippet in its document (doc_id, text).

    A document is tokenised once, not once for each claim, and only where a claim that is not an exact hit needs it: exact hits are
    decided on the text, and the windows run over an array that the document brings along."""
    docs = texts.select("doc_id", F.lower("text").alias("_low"), tokens(F.col("text"), unicode).alias("_doc"))
    own = claims.withColumns({"_bare": strip(F.coalesce("snippet", F.lit("")), unicode), "_s": tokens(F.coalesce("snippet", F.lit("")), unicode)})
    both = own.join(docs, "doc_id", "left")
    exact = F.contains("_low", F.lower("_bare"))
    score = F.when((F.col("_bare") == "") | F.col("_low").isNull(), 0.0).when(exact, 1.0).otherwise(F.round(window_jaccard(F.col("_s"), F.col("_doc")), DIGITS))
    return both.select(*claims.columns, F.size("_s").alias("n_tokens"), score.alias("similarity"))


def ground(claims: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, strict: bool = False, unicode: bool = True) -> DataFrame:
    """similarity() with `kept`: a blank or too short snippet cannot be judged and stays, unless strict."""
    scored = similarity(claims, texts, unicode)
    blank = F.coalesce(strip(F.col("snippet"), unicode) == "", F.lit(True))
    short = blank | (F.col("n_tokens") < SHORT_SNIPPET)
    return scored.withColumn("kept", F.when(short, F.lit(not strict)).otherwise(F.col("similarity") >= threshold))


def report(grounded: DataFrame, category: str = "type") -> DataFrame:
    """doc_id, total_items, removed_items, removal_rate and the removed items in order (list, pos)."""
    gone = F.when(~F.col("kept"), F.struct("list", "pos", F.col(category).alias("category"), "value", F.col("snippet").alias("evidence_snippet"), "similarity"))
    out = grounded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_items"), F.count_if(~F.col("kept")).alias("removed_items"), F.array_sort(F.collect_list(gone)).alias("_g"))
    removals = F.transform("_g", lambda g: F.struct(g["category"].alias("category"), g["value"].alias("value"), g["evidence_snippet"].alias("evidence_snippet"), g["similarity"].alias("similarity")))
    return out.select("doc_id", "total_items", "removed_items", F.round(F.col("removed_items") / F.col("total_items"), 4).alias("removal_rate"), removals.alias("removals"))


#: Words of a passage by which documents that could hold it are found, and characters where it has no whole word.
KEY_WORDS, KEY_CHARS = 6, 3


def holds(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id: which documents (doc_id, text) hold which passages (item_id, text) as part of their text, letters compared without case.

    A document and a passage meet by a key that any document with the passage has: a hash of up to KEY_WORDS whole words of it (its first and last word can be
    parts of longer ones), or of its first characters where it has no word in between. A document gives the keys of the lengths that passages have;
    ids and hashes alone are exchanged for that, and a text is fetched once for each pair that has met. Empty passages and null texts hold and are held nowhere."""
    words = lambda c: F.split(c, r"\s+")
    items = passages.select("item_id", F.lower("text").alias("_i")).where(F.length("_i") > 0).withColumn("_w", words(F.col("_i")))
    whole = F.least(F.size("_w") - 2, F.lit(KEY_WORDS))
    first = F.substring("_i", 1, KEY_CHARS)
    items = items.withColumns({"_n": F.when(whole > 0, whole).otherwise(-F.length(first)), "_k": F.when(whole > 0, F.xxhash64(F.array_join(F.slice("_w", 2, F.greatest(whole, F.lit(0))), " "))).otherwise(F.xxhash64(first))})
    lengths = [r["_n"] for r in items.select("_n").distinct().collect()]  # from -KEY_CHARS to KEY_WORDS
    docs = texts.select("doc_id", F.lower("text").alias("_t"))

    def own(n: int) -> Column:
        """The keys of a document for passages of a length: of runs of n words, or of -n characters."""
        parts = F.col("_w" if n > 0 else "_t")
        size = F.size(parts) if n > 0 else F.length(parts)
        places = F.when(size >= abs(n), F.sequence(F.lit(1), size - abs(n) + 1))
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(parts, i, n), " ")) if n > 0 else F.xxhash64(F.substring(parts, i, F.lit(-n)))))

    none = F.array().cast("array<struct<n:int,k:bigint>>")
    tagged = [F.coalesce(F.transform(own(n), _tag(n)), none) for n in lengths]
    # The words are a column of their own, split once; the keys of each place only cut it.
    met = docs.withColumn("_w", words(F.col("_t"))).select("doc_id", F.explode(F.concat(none, *tagged)).alias("_x")).select("doc_id", F.col("_x.n").alias("_n"), F.col("_x.k").alias("_k"))
    pairs = met.join(items.select("_n", "_k", "item_id"), ["_n", "_k"]).select("doc_id", "item_id").distinct()
    both = pairs.join(docs, "doc_id").join(items.select("item_id", "_i"), "item_id")
    return both.where(F.contains("_t", F.col("_i"))).select("doc_id", "item_id").distinct()


def _tag(n: int):
    return lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"))
