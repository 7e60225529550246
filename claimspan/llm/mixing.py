"""Mixing sources to target weights, by packed blocks and pseudorandom index permutations.

The words of a source, in a fixed pseudorandom order of its documents, are packed into blocks of `block_words` words (the
last block of a source can be shorter). The mix is a sequence of slots in output shards. For each shard the number of
slots of every source is drawn from a multinomial distribution over what the sources have left, so shards are random mixes
while each source gets its total exactly: the driver draws for groups of shards, as many as the root of their number, and executors for the
shards of a group. Slot k of a source maps through that source's own index permutation (a keyed
Feistel network over its block numbers, another key in each epoch) to a block; slots and blocks join by (source, block).
A source that is oversampled starts a second epoch, so no block is taken more than twice. The last slot of a source stops
at the word where the target is met.

Targets: sources by code point, null last, weigh `weights` in turn and share `share` of all words; a target stops at
`most` times its source's words and the excess is shared again by weight until none is above.

Offsets in a source come from a two-level prefix sum over buckets of documents, so a source with a third of all rows is
never in one task. The driver holds a row for each source and for each group of shards and source; tables of up to BROADCAST sources are broadcast, larger ones joined.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its own; rows with equal
doc_id are documents of their own, in an order by their texts, so equal seeds give equal mixes however the rows are stored (which of several equal rows
gets which share is open); other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import ASCII_WS, blocks_of, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
BROADCAST = 100_000
BUCKET_ROWS = 4096
PART_SLOTS = 1 << 18
SEED = 20_240_601


def word_count(text: Column) -> Column:
    """Runs of characters outside [\\x20\\x09-\\x0D]."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(ASCII_WS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Word targets of sources in order. The source with the least room for its weight is full first, so one pass in that order shares all excess."""
    size = np.array(sizes, float)
    w = np.array(weights, float)[np.arange(len(size)) % len(weights)]
    out, rest, by = most * size, share * float(sum(sizes)), float(w.sum())
    order = np.argsort(size / w, kind="stable")
    for k, i in enumerate(order.tolist()):
        if rest * w[i] / by <= most * size[i]:
            open_ = order[k:]
            out[open_] = rest * w[open_] / w[open_].sum()
            break
        rest, by = rest - out[i], by - w[i]
    return out.tolist()


def _round_key(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(n) for each element: a 4-round Feistel network, walked until it falls in the range."""
    x, n, key = (np.asarray(v, np.uint64).copy() for v in (x, n, key))
    half = np.uint64(1) + np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(float)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k, y = half[todo], mask[todo], key[todo], x[todo]
        left, right = y >> h, y & m
        for r in range(4)[::-1] if inverse else range(4):
            salt = k + np.uint64((r + 1) * 0xD6E8FEB86659FD93 % 2**64)
            if inverse:
                left, right = right ^ (_round_key(left, salt) & m), left
            else:
                left, right = right, left ^ (_round_key(right, salt) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x


def epoch_key(seed: int, source: str | None, epoch: int) -> int:
    return zlib.crc32(f"{seed}|{epoch}|{'n' if source is None else 's' + source}".encode()) * 0x9E3779B97F4A7C15 % 2**63


def _plan(sources: list[tuple[str | None, int]], block: int, seed: int, **kw) -> list[dict]:
    """For each source: blocks, slots, and the words of its last slot."""
    out = []
    for (name, size), target in zip(sources, targets([s for _, s in sources], **kw)):
        want, n = round(target), -(-size // block)
        full, rest = divmod(want, size) if size else (0, 0)
        slots, last = full * n, block
        if rest:
            short = int(permute(np.array([n - 1]), np.array([n]), np.array([epoch_key(seed, name, full)]), inverse=True)[0])
            tail = size - (n - 1) * block
            words = lambda k: k * block - (block - tail) * (k > short)  # noqa: E731  of the first k slots of the epoch
            k = rest // block
            while words(k) < rest:
                k += 1
            slots, last = slots + k, rest - words(k - 1)
        out.append({"source": name, "size": size, "target": target, "blocks": n, "slots": slots, "last": last})
    return out


def shard_counts(slots: list[int], shard_slots: int, seed) -> list[tuple[int, int, int, int]]:
    """(shard, source, slots, first slot of the source): multinomial draws over what is left, until it is used up."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    done, out, shard = np.zeros(len(left), np.int64), [], 0
    while left.sum():
        room = min(shard_slots, int(left.sum()))
        got = np.zeros(len(left), np.int64)
        while room:
            draw = np.minimum(rng.multinomial(room, left / left.sum()), left)
            got, left, room = got + draw, left - draw, room - int(draw.sum())
        out += [(shard, int(i), int(got[i]), int(done[i])) for i in np.flatnonzero(got)]
        done += got
        shard += 1
    return out


def packed_blocks(docs: DataFrame, block: int) -> DataFrame:
    """_sx, _block, _row, _from, _words: which words of which document lie in each block; docs has _row, _sx, _order, _buckets, size."""
    b = docs.withColumn("_bucket", F.pmod("_order", "_buckets"))
    sums = b.groupBy("_sx", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_sx").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_sx", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_sx", "_bucket").orderBy("_order", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = b.where("size > 0").withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(base, ["_sx", "_bucket"]).withColumn("_off", F.col("_base") + F.col("_in"))
    first, last = F.floor(F.col("_off") / block), F.floor((F.col("_off") + F.col("size") - 1) / block)
    cut = placed.select("_sx", "_row", "_off", "size", F.explode(F.sequence(first, last)).alias("_block"))
    start = F.greatest(F.col("_off"), F.col("_block") * block)
    end = F.least(F.col("_off") + F.col("size"), (F.col("_block") + 1) * block)
    return cut.select("_sx", "_block", "_row", (start - F.col("_block") * block).alias("_from"), (start - F.col("_off")).alias("_doc_from"), (end - start).alias("_words"))


def _few(table: DataFrame, plan: list[dict]) -> DataFrame:
    """A table with a row for each source, broadcast if they are BROADCAST at most."""
    return F.broadcast(table) if len(plan) <= BROADCAST else table


def mix_slots(spark, plan: list[dict], block: int, shard_slots: int, seed: int) -> DataFrame:
    """_shard, _sx, _epoch, _block, _limit: the block that each slot takes, and how many of its words."""
    total = sum(p["slots"] for p in plan)
    wide = max(1, int(np.ceil(np.sqrt(total / shard_slots))))
    counts = shard_counts([p["slots"] for p in plan], shard_slots * wide, seed)
    about = spark.createDataFrame([(i, p["blocks"], p["slots"], p["last"], epoch_key(seed, p["source"], 0), epoch_key(seed, p["source"], 1)) for i, p in enumerate(plan) if p["slots"]], "_sx int, _blocks long, _slots long, _last long, _key0 long, _key1 long")

    def draw(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("_sx")
        source, first = group["_sx"].to_numpy(), group["_first"].to_numpy()
        rows = shard_counts(group["_n"].to_pylist(), shard_slots, [seed, key[0].as_py()])
        shard, at, n, done = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((),) * 4))
        return pa.table({"_shard": pa.array(shard + key[0].as_py() * wide, pa.int64()), "_sx": pa.array(source[at], pa.int32()), "_n": n, "_first": first[at] + done})

    groups = spark.createDataFrame(counts, "_group long, _sx int, _n long, _first long")
    drawn = groups.groupBy("_group").applyInArrow(draw, "_shard long, _sx int, _n long, _first long")
    # A named number of partitions: the rows are few, the slots that they become are many.
    drawn = drawn.repartition(blocks_of(total, PART_SLOTS), "_shard", "_sx")
    slots = drawn.select("_shard", "_sx", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("_k")).join(_few(about, plan), "_sx")

    @F.pandas_udf("long")
    def block_of(k: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(k.to_numpy(), n.to_numpy(), key.to_numpy()).astype(np.int64))

    epoch = F.floor(F.col("_k") / F.col("_blocks"))
    found = block_of(F.pmod("_k", "_blocks"), F.col("_blocks"), F.when(epoch == 0, F.col("_key0")).otherwise(F.col("_key1")))
    return slots.select("_shard", "_sx", epoch.alias("_epoch"), found.alias("_block"), F.when(F.col("_k") == F.col("_slots") - 1, F.col("_last")).otherwise(F.lit(block)).alias("_limit"))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",), parts: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: the columns to keep, then source, size, source_size, target, taken, a row for each row of docs; with `parts` also the document's
    spans in the order of the shards.
    spans: shard, source, epoch, block, doc_id, start, n_words: the words that each slot of the mix takes, in document order."""
    if not 0 < share <= most <= 2:
        raise ValueError("share must be positive and at most `most`, which is at most 2")
    spark = docs.sparkSession
    rest = [c for c in keep if c not in ("doc_id", "source")]
    # The order of documents in a source depends on their ids and texts alone, not on how the input was read.
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")).alias("_order")
    own = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), *(F.col(f"`{c}`").alias(f"_keep_{c}") for c in rest), word_count(F.col("text")).alias("size"), order).withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    found = own.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = _plan([(r["source"], r["size"]) for r in found], block_words, seed, weights=weights, share=share, most=most)
    sources = spark.createDataFrame([(i, p["source"], p["size"], float(p["target"]), -(-r["rows"] // BUCKET_ROWS)) for i, (p, r) in enumerate(zip(plan, found))], "_sx int, _source string, source_size long, target double, _buckets long")
    named = own.join(_few(sources, plan), F.col("source").eqNullSafe(F.col("_source")), "left")
    blocks = packed_blocks(named.select("_row", "_sx", "_order", "_buckets", "size"), block_words)
    slots = mix_slots(spark, plan, block_words, shard_slots, seed)
    taken = slots.join(blocks, ["_sx", "_block"]).withColumn("_got", F.least(F.col("_words"), F.col("_limit") - F.col("_from"))).where("_got > 0")
    span = [F.col("_shard").alias("shard"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_doc_from").alias("start"), F.col("_got").alias("n_words")]
    total = taken.groupBy("_row").agg(F.sum("_got").alias("_taken"), *([F.array_sort(F.collect_list(F.struct(*span))).alias("parts")] if parts else []))
    kept = [F.col(f"_keep_{c}").alias(c) if c in rest else F.col(c) for c in keep]
    out = named.join(total, "_row", "left").select(*kept, *(["source"] if "source" not in keep else []), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"), *(["parts"] if parts else []))
    spans = taken.join(named.select("_row", "doc_id", "source"), "_row").select(span[0], "source", span[1], span[2], "doc_id", span[3], span[4])
    return out, spans
