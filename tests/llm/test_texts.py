"""Problems 3, 6, 7 and 8."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawloom.llm import mixing as M
from drawloom.llm import packing as P
from drawloom.llm import page_features as T
from drawloom.llm import proportions as Q
from drawloom.llm import spam as S
from drawloom.llm.sizing import VOCABULARY, source_key, with_tokens

DOC = "doc_id bigint, text string, source string, tokens string, bin int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], DOC).repartition(3)


# sizes and packing


def test_token_counts(spark):
    rows = [(1, "a b c", None), (2, "", None), (3, None, None), (4, "x <|endoftext|> y", None), (5, "word " * 30000, None)]
    got = {r.doc_id: r.tokens for r in with_tokens(documents(spark, rows), VOCABULARY).collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 3 and got[5] >= 30000
    assert with_tokens(documents(spark, rows).where("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_sum_of_squares_by_hand(sizes):
    where, gaps = P.sum_of_squares(np.array(sizes, int), 30)
    # a plain version: try every open gap and a new container
    bins: list[list[int]] = []
    for k, s in enumerate(sizes):
        left = [30 - sum(sizes[i] for i in b) for b in bins]
        count = [left.count(g) for g in range(31)]
        options = []
        for g in sorted({g for g in left if g >= s}):
            after = count.copy()
            after[g] -= 1
            after[g - s] += 1
            options.append((sum(v * v for v in after[1:]), g - s, 0, left.index(g)))
        after = count.copy()
        after[30 - s] += 1
        options.append((sum(v * v for v in after[1:]), 30 - s, 1, len(bins)))
        old = [o for o in options if not o[2]]
        best = min(old, key=lambda o: o[:2]) if old and min(o[0] for o in old) <= options[-1][0] else options[-1]
        if best[2]:
            bins.append([k])
        else:
            bins[best[3]].append(k)
    assert len(gaps) == len(bins)
    for b in range(len(gaps)):
        assert gaps[b] == 30 - sum(sizes[k] for k in np.flatnonzero(where == b)) >= 0
    assert sorted(gaps.tolist()) == sorted(30 - sum(sizes[k] for k in b) for b in bins)


@pytest.mark.parametrize("group", [10, 50_000])
def test_packing_keeps_everything(spark, group):
    rng = np.random.default_rng(0)
    rows = [(i, "word " * int(rng.integers(1, 45)), None) for i in range(120)] + [(500, "word " * 333, None), (501, "", None), (502, None, None), (None, "word", None), (503, "word " * 200, None)]
    df = documents(spark, rows)
    packed = P.pack(df, 50, group=group).collect()
    sizes = {r.doc_id: r.tokens for r in with_tokens(df).collect() if r.tokens and r.doc_id is not None}
    fill, total, gap = {}, {}, {}
    for r in packed:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        gap.setdefault(r.container, set()).add(r.gap)
    assert total == sizes and max(fill.values()) <= 50
    assert all(gap[c] == {50 - fill[c]} for c in fill)
    pieces = {d: sorted((r.piece, r.start) for r in packed if r.doc_id == d) for d in sizes}
    assert all(len(p) == -(-sizes[d] // 50) and p == [(k, 50 * k) for k in range(len(p))] for d, p in pieces.items())
    assert {r.doc_id for r in P.split_documents(P.pack(df, 50, group=group)).collect()} == {d for d, n in sizes.items() if n > 50}
    least = -(-sum(sizes.values()) // 50)
    # groups of ten documents, each about half a container, cannot be packed as tightly
    assert len(fill) <= (1.3 if group == 10 else 1.15) * least + 1
    report = P.packing_report(P.pack(df, 50), 50).first()
    assert report.least_containers == least and report.n_documents == len(sizes)


def test_packing_nothing(spark):
    none = documents(spark, []).where("false")
    assert P.pack(none, 10).count() == 0
    assert P.packing_report(P.pack(none, 10), 10).first().n_containers == 0
    with pytest.raises(ValueError):
        P.pack(none, 0)


# mixing


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    x, p = rng.integers(1, 1000, 400), np.full(400, 0.3)
    out = M.flight(x, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * x).sum() == pytest.approx((p * x).sum())
    assert M.flight(np.full(9, 5), np.full(9, 1 / 3), rng).sum() == pytest.approx(3)


def test_flight_is_fair():
    x = np.array([1, 50, 3, 7, 20, 9, 4])
    mean = np.mean([M.settle(x.astype(float), np.full(7, 0.4), np.zeros(7, bool), np.random.default_rng(k)) for k in range(400)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.1


def test_source_names(spark):
    names = [" A.Example/ ", "a.example", None, "  ", "/", "b//"]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "s string").select(source_key("s").alias("k")).collect()]
    assert got == ["a.example", "a.example", None, None, None, "b"]


@pytest.mark.parametrize("group", [20, 50_000])
def test_mix(spark, group):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(1, 30)), ["Big/", "big", " BIG ", "Small"][min(i % 7, 3)]) for i in range(300)]
    rows += [(900, "word " * 400, "big"), (901, None, "big"), (902, "", "small"), (903, "word", None), (None, "word", "big"), (5, "word " * 9, "big")]
    df = documents(spark, rows)
    targets = [("m", 2000, "BIG", 0.6, 1), ("m", 2000, "small/", 0.4, 3), ("m", 2000, "none", 0.1, 2), ("n", 9000, "small", 0.9, 2), ("n", 100, "big", None, None)]
    wanted = spark.createDataFrame(targets, "mix_id string, total_tokens bigint, source string, target_share double, max_repeats int")
    drawn, shares = M.mix(df, wanted, group=group)
    drawn, got = drawn.collect(), {(r.mix_id, r.source): r for r in shares.collect()}
    assert got["m", "BIG"].got == pytest.approx(1200, abs=40) and got["m", "small/"].got == pytest.approx(800, abs=40)
    small = got["n", "small"]
    assert small.have * 2 < 8100 and not small.reachable and small.got == 2 * small.have
    assert not got["m", "none"].reachable and got["m", "none"].got == 0 and got["m", "BIG"].reachable and got["n", "big"].reachable
    assert len({(r.mix_id, r.source, r.doc_id) for r in drawn}) == len(drawn)
    assert max(r.uses for r in drawn if r.source == "BIG") == 1 and max(r.uses for r in drawn) <= 3
    assert {901, 902, 903, None} & {r.doc_id for r in drawn} == set()
    assert got["m", "BIG"].actual_share == pytest.approx(got["m", "BIG"].got / (got["m", "BIG"].got + got["m", "small/"].got))
    none, empty = M.mix(df.where("false"), wanted)
    assert none.count() == 0 and {r.reachable for r in empty.collect() if r.target_share} == {False}


# proportions


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.floats(0, 1), st.integers(0, 15)), min_size=1, max_size=4), st.integers(0, 90))
def test_swap_repair_is_optimal(rows, size):
    available, share, floor = (np.array(c) for c in zip(*rows))
    counts = Q.swap_repair(available, share, floor, size, np.random.default_rng(0))
    low = np.minimum(floor, available)
    n = min(size, available.sum())
    assert (counts >= low).all() and (counts <= available).all() and counts.sum() == max(n, low.sum())
    off = ((counts - share * n) ** 2).sum()
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and counts[a] > low[a] and counts[b] < available[b]:
                other = counts.copy()
                other[a] -= 1
                other[b] += 1
                assert ((other - share * n) ** 2).sum() >= off - 1e-6


def test_proportional_sample(spark):
    hot = lambda k: [1.0 if j == k else 0.0 for j in range(10)]
    rows = [(i, "train" if i % 10 else " TRAIN", None, hot(0 if i % 3 else 1), 1, "x") for i in range(900)]
    rows += [(2000, "train", None, hot(2), 1, "x"), (2000, "train", None, hot(3), 2, "x"), (2001, "test", None, hot(3), 1, "x"), (2002, "train", None, None, 1, "x"), (None, "train", None, hot(3), 1, "x"), (2003, None, None, hot(3), 1, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, split string, x array<float>, y array<float>, loaded_at int, label string").repartition(4)
    targets = [("p", 100, 0, 0.25, 1), ("p", 100, 1, 0.70, 1), ("p", 100, 3, 0.05, 2), ("q", 10, 0, 1.0, 0), (None, 10, 0, 1.0, 0), ("q", 10, 7, None, None)]
    wanted = spark.createDataFrame(targets, "plan_id string, sample_rows bigint, label int, target_share double, min_rows bigint")
    sample, report = Q.proportional_sample(df, wanted)
    got = sample.collect()
    count = lambda p, k: sum(r.plan_id == p and r.label == k for r in got)
    assert count("p", 3) == 1 and count("p", 0) + count("p", 1) == 99 and abs(count("p", 1) - 72) <= 1 and count("q", 0) == 10
    assert len({(r.plan_id, r.row_id) for r in got}) == len(got)
    assert {(r.plan_id, r.label) for r in report.collect() if not r.met} == {("p", 3)}
    assert {(r.plan_id, r.label): r.sampled for r in report.collect()}["q", 7] == 0
    sample, report = Q.proportional_sample(df.where("false"), wanted)
    assert sample.count() == 0 and not any(r.met for r in report.collect() if r.needed > 0)
    sample, report = Q.proportional_sample(df, wanted.where("false"))
    assert sample.count() == report.count() == 0


# spam


PROSE = ["The committee met on Tuesday and agreed that the bridge should be closed for repairs.", "We had measured the level of the river before it rained, but nobody wrote the figures down.",
         "In the end it was cheaper to build a new path along the old wall than to mend the steps.", "Ask the keeper for the key, and do not forget to bring it back before the gate is shut."]
LOG = ["12:01:07 worker=3 loss=0.4312 step=100", "12:01:09 worker=4 loss=0.4291 step=200", "12:01:15 worker=3 loss=0.4202 step=300"]
KEYS = ["garden hose", "water pump", "lawn mower", "patio heater", "steel bucket"]


def spam_and_ham(n, seed=0):
    rng = np.random.default_rng(seed)
    pick = lambda from_, k: [from_[i] for i in rng.integers(0, len(from_), k)]
    rows = []
    for i in range(n):
        kind = i % 6
        text = [
            lambda: " ".join(pick(PROSE, 6)),
            lambda: "\n".join(pick(LOG, 12)),
            lambda: ", ".join(pick(KEYS, 40)),
            lambda: " ".join(f'<a href="http://h{j}.test/{j}">cheap {k}</a>' for j, k in enumerate(pick(KEYS, 12))),
            lambda: " ".join(pick(PROSE, 5)) + "\n#garden #river",
            lambda: " | ".join(".".join(k.split(" ")[0]) + " " + k.split(" ")[1] for k in pick(KEYS, 30)),
        ][kind]()
        rows.append((i, text, f"host{i % 5}.test" if i % 11 else None, kind in (2, 3, 5)))
    return rows


def test_spam_is_told_from_prose_logs_and_tagged_texts(spark):
    rows = spam_and_ham(240)
    extra = [(1000, "", "host1.test"), (1001, None, None), (1002, ", ".join(KEYS * 4000), "host1.test"), (1003, rows[2][1], "other"), (None, rows[2][1], "other"), (1004, "w " * 3 + "​" * 9, None)]
    got = {r.doc_id: r for r in S.spam_pages(documents(spark, [r[:3] for r in rows] + extra)).collect()}
    assert len(got) == 245 and None not in got
    wrong = [r[0] for r in rows if got[r[0]].is_spam != r[3]]
    assert len(wrong) <= 4
    assert not got[1000].is_spam and not got[1001].is_spam and got[1002].is_spam and got[1003].is_spam


def test_held_out_pages():
    train, test = spam_and_ham(180, 1), spam_and_ham(180, 2)
    x, y = (np.array([f(r) for r in train], float) for f in (lambda r: T.features(r[1]), lambda r: r[3]))
    p = S.score(S.bagged(x, y), np.array([T.features(r[1]) for r in test]))
    assert ((p > 0.5) == [r[3] for r in test]).mean() > 0.98


def test_few_pages_are_judged_by_the_rules(spark):
    got = {r.doc_id: r.is_spam for r in S.spam_pages(documents(spark, [r[:3] for r in spam_and_ham(6)])).collect()}
    assert got[2] and not got[0]
    assert S.spam_pages(documents(spark, []).where("false")).count() == 0


def test_hosts_shift_doubtful_pages(spark):
    pages = [(i, "bad" if i % 2 else "good", 0.97 if i % 2 else 0.02) for i in range(200)]
    pages += [(500, "bad", 0.45), (501, "good", 0.55), (502, None, 0.55), (503, "bad", 0.0), (504, "bad", 0.1)]
    got = {r.doc_id: r.is_spam for r in S.smooth(spark.createDataFrame(pages, "doc_id bigint, host string, p double")).collect()}
    assert [got[i] for i in range(500, 505)] == [True, False, True, False, False]
    assert sum(got.values()) == 102


def test_disguises():
    assert T.plain("ch3@p g.p.u h​ours")[0] == "cheap gpu hours"
    assert T.plain("user12 saw 3.14 and w2 in v1.2.3, e.g. at 10")[0] == "user12 saw 3.14 and w2 in v1.2.3, e.g. at 10"
    assert T.features(None) == T.features("  ") == [0.0] * len(T.NAMES)
    assert len(T.features("x")) == len(T.NAMES)
