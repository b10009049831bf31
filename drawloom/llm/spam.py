"""Keyword-stuffed and link-list pages.

Every page becomes content and link features (page_features.py). Weak labels
come from plain rules that each speak only where they are sure; bagged decision
trees learn from them on a bounded sample and judge every page; the judgements
are then smoothed by the spam rate of the page's host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawloom.llm.collisions import hash_share
from drawloom.llm.page_features import NAMES, features_of
from drawloom.llm.sizing import source_key
from drawloom.llm.storage import busy, stored

#: Labelled pages of each class that the trees are fitted on, at most.
SAMPLE = 15_000
TREES, DEPTH, LEAF, CUTS = 30, 7, 4, 48
#: How much a host's log odds of spam count, and the pages a host is shrunk by.
HOST_WEIGHT, HOST_PRIOR = 0.25, 20.0
SPAM, HAM, UNKNOWN = 1, 0, -1


def weak_label(row: list[float]) -> int:
    """What the rules say of a page's features; UNKNOWN where none speaks or they disagree."""
    f = dict(zip(NAMES, row))
    n, open_ = np.expm1(f["words"]), f["record_share"] < 0.3
    spam = open_ and (
        f["junk_share"] > 0.6
        or n >= 8 and f["offer_rate"] > 0.22 and f["function_rate"] < 0.27
        or n >= 12 and f["function_rate"] < 0.3 and f["stuffed_sentences"] > 0.35 and f["top_pair"] > 0.15
        or n >= 20 and f["function_rate"] < 0.33 and f["top_triple"] > 0.15 and f["pair_repeats"] > 0.5
        or n >= 12 and f["function_rate"] < 0.33 and f["top_word"] > 0.25
        or f["disguised"] > 0.15 and f["pair_repeats"] > 0.3
    )
    ham = (
        f["prose_share"] + f["record_share"] >= 0.75 and f["junk_share"] < 0.3 and f["offer_rate"] < 0.15 and f["stuffed_sentences"] < 0.3
        and (f["top_word"] < 0.2 and f["top_pair"] < 0.1 or f["record_share"] > 0.5)
        or f["function_rate"] >= 0.3 and f["junk_share"] < 0.1 and f["offer_rate"] < 0.06 and f["top_word"] < 0.2 and f["top_triple"] < 0.12
        or f["record_share"] > 0.6 and f["offer_rate"] < 0.15
        or f["prose_share"] + f["record_share"] > 0.62 and f["junk_share"] < 0.4 and f["offer_rate"] < 0.1 and f["stuffed_sentences"] < 0.2
        and f["top_word"] < 0.12 and f["top_triple"] < 0.06
    )
    return UNKNOWN if spam == ham else SPAM if spam else HAM


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            inner = f >= 0
            at = np.where(inner, self.left[at] + (x[np.arange(len(x)), f.clip(0)] > self.cut[at]), at)
        return self.value[at]


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> Tree:
    """One tree by Gini impurity over quantile cuts, a random part of the features at each node.

    A leaf holds LEAF pages, or a sixteenth of all where that is less.
    """
    feature, cut, left, value = [], [], [], []
    tries = max(1, int(np.sqrt(x.shape[1]) * 1.5))
    leaf = max(1, min(LEAF, len(x) // 16))

    def node(rows):
        w = weight[rows]
        feature.append(-1), cut.append(0.0), left.append(-1), value.append(float((w * y[rows]).sum() / max(w.sum(), 1e-12)))
        return len(feature) - 1

    todo = [(node(np.arange(len(x))), np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        if depth >= DEPTH or len(rows) < 2 * leaf or value[at] in (0.0, 1.0):
            continue
        w, p = weight[rows], weight[rows] * y[rows]
        best = (1e-9, None, None)
        whole = w.sum() * value[at] * (1 - value[at])
        for k in rng.choice(x.shape[1], tries, replace=False):
            v = x[rows, k]
            cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS)))
            if len(cuts) < 2 and v.min() == v.max():
                continue
            order = np.argsort(v, kind="stable")
            cw, cp, sv = np.cumsum(w[order]), np.cumsum(p[order]), v[order]
            upto = np.searchsorted(sv, cuts, "right")
            fine = (upto >= leaf) & (upto <= len(v) - leaf)
            if not fine.any():
                continue
            lw, lp = cw[upto[fine] - 1], cp[upto[fine] - 1]
            rw, rp = cw[-1] - lw, cp[-1] - lp
            gain = whole - lp * (1 - lp / lw) - rp * (1 - rp / np.maximum(rw, 1e-12))
            g = int(np.argmax(gain))
            if gain[g] > best[0]:
                best = (gain[g], int(k), float(cuts[fine][g]))
        if best[1] is None:
            continue
        goes = x[rows, best[1]] > best[2]
        feature[at], cut[at] = best[1], best[2]
        a, b = node(rows[~goes]), node(rows[goes])
        left[at] = a
        todo += [(a, rows[~goes], depth + 1), (b, rows[goes], depth + 1)]
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))


def bagged(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Tree]:
    """Trees on bootstrap samples, both classes of equal weight."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(TREES):
        rows = rng.integers(0, len(x), len(x))
        share = y[rows].mean()
        weight = np.where(y[rows] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        out.append(grow(x[rows], y[rows], weight, rng))
    return out


def score(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([t.predict(x) for t in trees], axis=0) if len(x) else np.zeros(0)


def described(documents: DataFrame) -> DataFrame:
    """(doc_id, host, f, weak): features and weak label of every document; whole texts are read. Empty texts have label HAM."""
    narrow = busy(documents.where("doc_id is not null").select("doc_id", source_key("source").alias("host"), "text"))

    def run(batches):
        for batch in batches:
            rows = features_of(batch.column(2).to_pylist())
            weak = [weak_label(r) if any(r) else HAM for r in rows.tolist()]
            ends = pa.array(np.arange(batch.num_rows + 1) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1))), pa.array(weak, pa.int32())], names=["doc_id", "host", "f", "weak"])

    return narrow.mapInArrow(run, "doc_id bigint, host string, f array<double>, weak int")


def fit(pages: DataFrame, sample: int = SAMPLE, seed: int = 3) -> list[Tree] | None:
    """Trees from at most `sample` labelled pages of each class, the first by hash; None where no page of a class is labelled."""
    counts = {r.weak: r["count"] for r in pages.where("weak >= 0").groupBy("weak").count().collect()}
    if not counts.get(SPAM) or not counts.get(HAM):
        return None
    parts = [pages.where((F.col("weak") == k) & hash_share("doc_id", min(1.0, 1.1 * sample / counts[k]), seed)).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select("f", "weak") for k in (SPAM, HAM)]
    got = parts[0].union(parts[1]).toArrow()
    x = np.array(got.column(0).to_pylist(), float)
    y = got.column(1).to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return bagged(x[order], y[order], seed)


def judge(pages: DataFrame, trees: list[Tree] | None) -> DataFrame:
    """(doc_id, host, p): the probability of spam of every page; without trees what the weak label says, unknown being 0.5."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            weak = batch.column(3).to_numpy()
            if shared.value is None:
                p = np.where(weak == UNKNOWN, 0.5, weak).astype(float)
            else:
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                p = np.where(x.any(axis=1), score(shared.value, x), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "host", "p"])

    return pages.mapInArrow(run, "doc_id bigint, host string, p double")


def log_odds(p):
    clipped = F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
    return F.ln(clipped / (1 - clipped))


def smooth(judged: DataFrame, threshold: float = 0.5, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """judged (doc_id, host, p) with host_rate, smoothed and is_spam.

    smoothed adds to the log odds of p how far the host's mean p, shrunk by
    HOST_PRIOR pages, lies from that of all pages. Pages without host are not
    smoothed, and a page that is certainly no spam (p 0) stays so.
    """
    prior = judged.agg(F.avg("p")).first()[0] or 0.0
    hosts = judged.where("host is not null").groupBy("host").agg(((F.sum("p") + HOST_PRIOR * prior) / (F.count(F.lit(1)) + HOST_PRIOR)).alias("host_rate"))
    shift = F.coalesce(host_weight * (log_odds(F.col("host_rate")) - log_odds(F.lit(prior))), F.lit(0.0))
    odds = log_odds(F.col("p")) + shift
    smoothed = F.when(F.col("p") > 0, 1 / (1 + F.exp(-odds))).otherwise(F.lit(0.0))
    return judged.join(hosts, "host", "left").withColumn("smoothed", smoothed).withColumn("is_spam", F.col("smoothed") > threshold)


def spam_pages(documents: DataFrame, threshold: float = 0.5, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """(doc_id, host, p, host_rate, smoothed, is_spam) of every document.

    Null and empty texts are no spam; null doc_ids are left out; each row of a
    repeated text is judged; documents without source are not smoothed. An
    empty table gives no rows.
    """
    pages = stored(described(documents), "pages")
    return smooth(stored(judge(pages, fit(pages)), "judged"), threshold, host_weight)
