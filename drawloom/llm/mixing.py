"""Mixing sources to target weights by balanced sampling (the cube method).

A source that has to give more than all its documents gives each of them the
same whole number of times; what is still missing is a sample in which every
document has the same inclusion probability. The flight phase moves the
probabilities along null-space directions of the constraints (tokens and number
of documents stay as they are) until all but two are 0 or 1. Groups of at most
GROUP documents fly beside each other. What they leave undecided is mostly the few
largest documents, which nothing can be set against; these are decided by lot,
and a reserve of about RESERVE ordinary documents a source, held back until
then, makes up for the difference in its own flight. The last two of these land
where the token total is met best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.sizing import VOCABULARY, source_key, with_tokens
from drawloom.llm.storage import stored

GROUP = 50_000
#: Rows of the target table that may be broadcast; more raise an error.
MAX_TARGETS = 100_000
#: Documents of at most average size held back of each source, about.
RESERVE = 256
SURE = 1e-9


def flight(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sum(p) and sum(p * x) unchanged, at most two strictly between 0 and 1."""
    p = p.astype(float).copy()
    x = x.astype(float)
    active: list[int] = []
    for k in np.flatnonzero((p > SURE) & (p < 1 - SURE)).tolist():
        active.append(k)
        if len(active) < 3:
            continue
        i, j, m = active
        u = (x[j] - x[m], x[m] - x[i], x[i] - x[j])
        if u[0] == 0 and u[1] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for q, v in zip(active, u):
            if v > 0:
                up, down = min(up, (1 - p[q]) / v), min(down, p[q] / v)
            elif v < 0:
                up, down = min(up, -p[q] / v), min(down, (p[q] - 1) / v)
        move = up if rng.random() * (up + down) < down else -down
        still = []
        for q, v in zip(active, u):
            p[q] = min(1.0, max(0.0, p[q] + move * v))
            if p[q] <= SURE:
                p[q] = 0.0
            elif p[q] >= 1 - SURE:
                p[q] = 1.0
            else:
                still.append(q)
        active = still
    return p


def land(x: np.ndarray, p: np.ndarray, wanted: float, rng: np.random.Generator) -> np.ndarray:
    """Decides the undecided (at most a few): the choice whose tokens come nearest to wanted, random among equals."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = np.array(np.meshgrid(*[[0.0, 1.0]] * len(open_))).reshape(len(open_), -1).T
        off = np.abs(choices @ x[open_].astype(float) - wanted)
        best = np.flatnonzero(off <= off.min() + SURE)
        p[open_] = choices[rng.choice(best)]
    return p


def settle(x: np.ndarray, p: np.ndarray, held: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides everything: the undecided by lot, then the held ones so that the token total comes near sum(p * x)."""
    wanted = float((p * x).sum())
    out = np.where(held, p, (rng.random(len(p)) < p).astype(float))
    weight = float(x[held].sum())
    if weight:
        # the held documents take on what the lot left over, as far as probabilities allow
        for _ in range(4):
            short = wanted - float((out * x).sum())
            free = held & ((out < 1) if short > 0 else (out > 0))
            if abs(short) < SURE or not free.any():
                break
            out[free] = (out[free] + short / float(x[free].sum())).clip(0, 1)
        out[held] = flight(x[held], out[held], rng)
    open_ = np.flatnonzero((out > 0) & (out < 1))
    fixed = float((out * x).sum()) - float((out[open_] * x[open_]).sum())
    return land(x, out, wanted - fixed, rng)


def fly(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").to_numpy()
        rng = np.random.default_rng([seed, table.column("target")[0].as_py(), table.column("grp")[0].as_py()])
        order = rng.permutation(len(doc))[np.argsort(np.argsort(doc))]  # a random order that does not depend on how rows came
        order = np.argsort(order)
        doc, x, p = (table.column(c).to_numpy()[order] for c in ("doc_id", "tokens", "p"))
        if last:
            p = settle(x.astype(float), p, table.column("held").to_numpy()[order], rng)
        else:
            p = flight(x, p, rng)
        return pa.table([table.column("target"), pa.array(doc), pa.array(x), pa.array(p)], names=["target", "doc_id", "tokens", "p"])

    return run


def plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """For every row of targets: what its source has, how often every document is used, and the probability of one more use.

    target_share and total_tokens of null count as 0, a null max_repeats as 1.
    """
    if targets.count() > MAX_TARGETS:
        raise ValueError("too many targets")
    have = sized.groupBy("key").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    rows = targets.withColumn("key", source_key("source")).join(have, "key", "left").orderBy("mix_id", "source").collect()
    out = []
    for k, r in enumerate(rows):
        wanted = (r.target_share or 0.0) * (r.total_tokens or 0)
        have_, repeats = r.have or 0, 1 if r.max_repeats is None else max(0, r.max_repeats)
        reachable = repeats * have_ >= wanted - 1e-6
        if not have_ or not reachable:
            base, p = repeats, 0.0
        else:
            base = min(repeats, int(wanted // have_))
            p = min(1.0, max(0.0, wanted / have_ - base)) if base < repeats else 0.0
        out.append({"target": k, "mix_id": r.mix_id, "source": r.source, "key": r.key, "target_share": r.target_share, "total_tokens": r.total_tokens,
                    "wanted": float(wanted), "have": int(have_), "docs": int(r.docs or 0), "base": base, "p": float(p), "reachable": bool(reachable)})
    return out


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 17, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares).

    drawn: (mix_id, source, doc_id, uses, tokens), uses > 0. shares: a row for
    each row of targets with the tokens and share it got and whether its target
    can be met. Sources alike but for case, outer blanks or a trailing slash are
    one; documents without source or text count nothing; a source without
    documents gives nothing. A mix that draws nothing has null shares.
    """
    spark = documents.sparkSession
    named = documents.where("doc_id is not null").select("doc_id", source_key("source").alias("key"), "text").where("key is not null and text is not null and text <> ''")
    sized = stored(with_tokens(named, vocabulary).where("tokens > 0"), "sized").dropDuplicates(["doc_id"])
    rows = plan(sized, targets)
    schema = "target int, mix_id string, source string, key string, target_share double, total_tokens bigint, wanted double, have bigint, docs bigint, base int, p double, reachable boolean"
    planned = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    facts = planned.select("target", "key", "base", "p", "docs", "have", F.greatest(F.lit(1), F.ceil(F.col("docs") / group)).cast("int").alias("groups"))
    fit = sized.join(F.broadcast(facts), "key")
    whole = fit.where("base > 0").select("target", "doc_id", "tokens", F.col("base").alias("uses"))
    dealt = fit.where("p > 0").withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("groups")).cast("int"))
    # about RESERVE of the documents of at most average size
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed + 7)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 2 * RESERVE / F.col("docs")
    dealt = dealt.withColumn("held", lot & (F.col("tokens") * F.col("docs") <= F.col("have"))).select("target", "grp", "doc_id", "tokens", "p", "held")
    out_schema = "target int, doc_id bigint, tokens bigint, p double"
    flown = stored(dealt.where("not held").groupBy("target", "grp").applyInArrow(fly(seed, False), out_schema), "flown")
    parts = [flown.where("p >= 1")]
    left = flown.where("p > 0 and p < 1")
    most = max([r["docs"] for r in rows], default=0)
    while most > group:  # each group leaves at most two
        most = 2 * -(-most // group)
        groups = max(1, -(-most // group))
        again = left.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed + most)), F.lit(groups)).cast("int"))
        flown = stored(again.groupBy("target", "grp").applyInArrow(fly(seed + most, False), out_schema), "flown")
        parts.append(flown.where("p >= 1"))
        left = flown.where("p > 0 and p < 1")
    ends = left.withColumn("held", F.lit(False)).unionByName(dealt.where("held").drop("grp"))
    landed = ends.withColumn("grp", F.lit(0)).groupBy("target", "grp").applyInArrow(fly(seed + 1, True), out_schema)
    parts.append(landed.where("p >= 1"))
    uses = whole
    for part in parts:
        uses = uses.unionByName(part.select("target", "doc_id", "tokens", F.lit(1).alias("uses")))
    total = uses.groupBy("target", "doc_id").agg(F.sum("uses").cast("int").alias("uses"), F.first("tokens").alias("tokens"))
    names = F.broadcast(planned.select("target", "mix_id", "source"))
    drawn = total.join(names, "target").select("mix_id", "source", "doc_id", "uses", "tokens", "target")
    got = drawn.groupBy("target").agg(F.sum(F.col("uses") * F.col("tokens")).alias("got"), F.sum("uses").alias("n_uses"))
    per_mix = planned.join(got, "target", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    sums = per_mix.groupBy("mix_id").agg(F.sum("got").alias("mix_got"))
    shares = per_mix.join(sums, "mix_id").select(
        "mix_id", "source", "target_share", "wanted", "have", "got", F.coalesce("n_uses", F.lit(0)).alias("n_uses"),
        (F.col("got") / F.nullif("mix_got", F.lit(0))).alias("actual_share"), "reachable",
    )
    return drawn.drop("target"), shares
