"""WARC records and a Merkle fixity audit of their replicas, in DataFrame operations.

`records` makes WARC/1.1 response records of pages and lays them out in segment files: a record is in the segment of its id, at the offset
where the records before it end. A stored replica has a row for each record: segment, seq, offset, record (bytes).

`merkle` builds a tree over each replica: the leaf of a record is the SHA-256 of its offset range and bytes; a node is the SHA-256 of
its children's offset ranges and digests in order, FANOUT children to a node; LEVELS levels make a segment's root, and further levels over segment
numbers, as many as the largest number needs, the replica's root. Every node says which offset range it covers.

`audit` compares roots and descends only below nodes that differ: a level's rows are joined with the differing parents alone. What it
reaches are the records that differ, each with its status: `corrupt`, `missing` (from the replica), `extra` or `moved` (right bytes at another offset).

Segments hold SEGMENT ids at most, so offsets are a running sum over a bounded group however many records there are, and no group of the tree
has more than FANOUT children.

Defined cases: null url or html count as empty; ids are taken as long; records without an id lie in segments below 0, by a hash of their bytes;
repeated rows are records of their own, told apart by their place; an empty table has no tree and no differences; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SEGMENT = 1024
FANOUT = 16
#: 16 ** 3 children of a segment's root: room for SEGMENT ids with some repeated.
LEVELS = 3


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.1 response record."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit("")).cast("binary")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ").cast("binary"), F.octet_length(body).cast("string").cast("binary"), F.lit("\r\n\r\n").cast("binary"), body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(block, 256),
        F.lit(">\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body (html) of a record that record_bytes made."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)[1]


def records(pages: DataFrame, segment: int = SEGMENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, segment, seq, offset, length, record: the layout of pages (page_id, url, html) in segment files; then the columns to keep. Records of one id are in one segment."""
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), record_bytes(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"), *keep)
    made = made.select(*keep, "page_id", F.coalesce(F.floor(F.col("page_id") / segment), -1 - F.pmod(F.xxhash64("record"), F.lit(1 << 20))).cast("long").alias("segment"), F.octet_length("record").cast("long").alias("length"), "record")
    order = Window.partitionBy("segment").orderBy("page_id", "record")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return made.select("page_id", "segment", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce(before, F.lit(0)).alias("offset"), "length", "record", *keep)


def _node(level: int, start: Column, end: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.lit(str(level)), start.cast("string"), end.cast("string"), digest)


def leaves(replica: DataFrame) -> DataFrame:
    """level 0 of the tree: segment, ix, start, end, digest, and the record's own digest."""
    own = F.sha2("record", 256)
    end = F.col("offset") + F.octet_length("record")
    return replica.select("segment", F.col("seq").alias("ix"), F.col("offset").alias("start"), end.alias("end"), F.sha2(_node(0, F.col("offset"), end, own), 256).alias("digest"), own.alias("record_sha256"))


def _up(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """The parents of a level within segments, or of segments."""
    ordered = F.array_sort(F.collect_list(F.struct("ix", "start", "end", "digest")))
    parents = nodes.groupBy("segment", F.floor(F.col("ix") / fanout).alias("_p")).agg(F.min("start").alias("start"), F.max("end").alias("end"), ordered.alias("_c"))
    child = lambda c: _node(level, c["start"], c["end"], F.concat_ws(":", c["ix"].cast("string"), c["digest"]))
    return parents.select("segment", F.col("_p").alias("ix"), "start", "end", F.sha2(F.array_join(F.transform("_c", child), ","), 256).alias("digest"))


def merkle(base: DataFrame, low: int, high: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of a replica's tree, from its leaves up: LEVELS of nodes within segments, then the segments' roots, numbered from `low`, and the
    levels over them that numbers up to `high` need."""
    out = [base]
    for level in range(1, LEVELS + 1):
        out.append(_up(out[-1], level, fanout))
    # A segment with more records than LEVELS have room for has several nodes here; they become one.
    top = _up(out[-1], LEVELS + 1, 1 << 40)
    out.append(top.select(F.lit(0).cast("long").alias("segment"), (F.col("segment") - low).alias("ix"), "start", "end", "digest"))
    width, level = high - low + 1, LEVELS + 2
    while width > 1:
        out.append(_up(out[-1], level, fanout))
        width, level = -(-width // fanout), level + 1
    return out


def audit(primary: list[DataFrame], replica: list[DataFrame], low: int, fanout: int = FANOUT) -> DataFrame:
    """segment, seq, start, end, other_start, other_end, status of the records that differ, found from the roots down."""
    where: DataFrame | None = None
    for level in range(len(primary) - 1, -1, -1):
        sides = []
        for tree, tag in ((primary, ""), (replica, "other_")):
            rows = tree[level].withColumnsRenamed({c: tag + c for c in ("start", "end", "digest", "record_sha256")})
            if where is not None:
                # The nodes of a segment lie below its root; all others below the node of their numbers.
                up = (F.lit(0).cast("long"), F.col("segment") - low) if level == LEVELS else (F.col("segment"), F.floor(F.col("ix") / fanout))
                rows = rows.withColumns({"_s": up[0], "_p": up[1]}).join(where, ["_s", "_p"], "left_semi").drop("_s", "_p")
            sides.append(rows)
        both = sides[0].join(sides[1], ["segment", "ix"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other_digest")))
        if level:
            where = materialise(both.select(F.col("segment").alias("_s"), F.col("ix").alias("_p")), "merkle-differs")
    status = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("record_sha256") == F.col("other_record_sha256"), "moved").otherwise("corrupt")
    return both.select("segment", F.col("ix").alias("seq"), "start", "end", "other_start", "other_end", status.alias("status"))


def store(rows: DataFrame, label: str) -> DataFrame:
    """A stored replica: written to the shared folder, and read from there from then on."""
    return materialise(rows, f"warc-{label}")


def fixity(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(leaves of the primary, differences) of two stored replicas."""
    ends = primary.select("segment").unionAll(replica.select("segment")).agg(F.min("segment"), F.max("segment")).first()
    low, high = (0, 0) if ends[0] is None else (int(ends[0]), int(ends[1]))
    # Leaves are small next to the records (digests and numbers) and kept, so that no level hashes records again.
    trees = [merkle(materialise(leaves(rows), f"merkle-{label}"), low, high, fanout) for rows, label in ((primary, "a"), (replica, "b"))]
    return trees[0][0], audit(*trees, low, fanout)
