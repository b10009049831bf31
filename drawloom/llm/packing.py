"""Sum-of-squares packing of documents into containers of fixed token capacity.

Every item goes where the sum over all gaps of (open containers with that gap)
squared becomes smallest: into an open container or a new one. A document over
capacity gives full containers and one rest; no other document is split.

Documents are dealt to groups of at most GROUP by a hash of doc_id, each packed
by one task, larger items first. The containers that a group leaves open are
emptied and packed once more, together with those of other groups, until one
group is left or the containers left open are no longer fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.sizing import VOCABULARY, with_tokens
from drawloom.llm.storage import stored

GROUP = 50_000
#: A container with at most this share of its capacity unused is closed for good after the first packing.
CLOSED = 0.0
PACKED = "grp int, bin int, doc_id bigint, piece int, tokens bigint, gap int"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, gap of each bin) for items in this order, all of 1..capacity.

    Equal outcomes go to the smaller gap, then to the older container of that gap.
    """
    open_ = np.zeros(capacity + 1, np.int64)  # open containers by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    gaps: list[int] = []
    far = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        # change of the sum when a container of gap g gets gap g - s; gap 0 is closed and not counted
        before = open_[s:]
        change = 2 * (open_[: capacity + 1 - s] - before) + 2
        change[0] = 1 - 2 * before[0]
        change = np.where(before > 0, change, far)
        g = int(np.argmin(change))
        fresh = 2 * int(open_[capacity - s]) + 1 if s < capacity else 0
        if change[g] <= fresh:
            old = g + s
            b = stacks[old].pop(0)
            open_[old] -= 1
            left = g
        else:
            b, left = len(gaps), capacity - s
            gaps.append(left)
        gaps[b] = left
        where[k] = b
        if left:
            stacks[left].append(b)
            open_[left] += 1
    return where, np.array(gaps, np.int64)


def pack_group(capacity: int):
    """Kernel: one group of items (doc_id, piece, tokens), larger first."""

    def run(table: pa.Table) -> pa.Table:
        doc, piece, tokens = (table.column(c).to_numpy() for c in ("doc_id", "piece", "tokens"))
        order = np.lexsort((piece, doc, -tokens))
        where, gaps = sum_of_squares(tokens[order], capacity)
        grp = table.column("grp")[0].as_py()
        n = len(order)
        cols = [np.full(n, grp, np.int32), where.astype(np.int32), doc[order], piece[order].astype(np.int32), tokens[order].astype(np.int64), gaps[where].astype(np.int32)]
        return pa.table([pa.array(c) for c in cols], names=["grp", "bin", "doc_id", "piece", "tokens", "gap"])

    return run


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, tokens): one item a document, or full pieces and a rest where it is over capacity.

    Documents without tokens are no items; of rows of one doc_id the longest counts.
    """
    some = sized.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    count = F.ceil(F.col("tokens") / capacity).cast("int")
    cut = some.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"))


def pack(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """(container, doc_id, piece, start, tokens, gap) of every piece of every document with tokens.

    start is the piece's first token within its document, gap what its container leaves unused.
    An empty table gives no containers. Null doc_ids are no documents.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = stored(with_tokens(documents.select("doc_id", "text"), vocabulary), "sized")
    items = pieces(sized, capacity)
    whole = items.where(F.col("tokens") == capacity)
    rest = stored(items.where(F.col("tokens") < capacity), "items")
    done, turn, before = [], 0, None
    while True:
        n = rest.count()
        groups = max(1, -(-n // group))
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(groups)).cast("int"))
        packed = stored(dealt.groupBy("grp").applyInArrow(pack_group(capacity), PACKED), "packed").withColumn("turn", F.lit(turn))
        left = packed.where(F.col("gap") > CLOSED * capacity).count()
        if groups == 1 or (before is not None and left > before / 2):
            done.append(packed)
            break
        done.append(packed.where(F.col("gap") <= CLOSED * capacity))
        rest, turn, before = packed.where(F.col("gap") > CLOSED * capacity).select("doc_id", "piece", "tokens"), turn + 1, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    named = out.select(F.concat_ws("-", "turn", "grp", "bin").alias("container"), "doc_id", "piece", "tokens", "gap")
    full = whole.select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "tokens", F.lit(0).alias("gap"))
    return named.unionByName(full).withColumn("start", F.col("piece").cast("bigint") * capacity)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens, the fewest containers these tokens could fill, and the unused share; nulls become 0 on no rows."""
    return packed.agg(
        F.countDistinct("container").alias("n_containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("tokens") / capacity), F.lit(0)).alias("least_containers"),
        F.countDistinct("doc_id").alias("n_documents"),
    ).withColumn("unused_share", F.round(1 - F.col("n_tokens") / F.nullif(F.col("n_containers") * capacity, F.lit(0)), 6))


def split_documents(packed: DataFrame) -> DataFrame:
    """doc_ids in more than one piece."""
    return packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
