import pytest
from pyspark.sql import functions as F

from drawloom.operators import batching as B
from drawloom.operators import sampling as S


@pytest.mark.parametrize(("n", "pads", "batches"), [(500, 12, 16), (32, 0, 1), (1, 31, 1), (70, 26, 3), (0, 0, 0)])
def test_pads(spark, n, pads, batches):
    got = B.make_batches(spark.range(n).select(F.col("id").alias("row_id"), F.lit("x").alias("rn")), 32).collect()
    assert sum(r.is_pad for r in got) == pads
    assert len({(r.batch_id, r.pos) for r in got}) == len(got) == n + pads
    assert len({r.batch_id for r in got}) == batches
    real = [r.row_id for r in sorted(got, key=lambda r: (r.batch_id, r.pos)) if not r.is_pad]
    assert sorted(real) == list(range(n))
    if pads and n >= pads:
        assert [r.row_id for r in sorted(got, key=lambda r: (r.batch_id, r.pos)) if r.is_pad] == real[:pads]


def test_order_is_the_key_order_and_epochs_differ(spark):
    rows = spark.range(200).select(F.col("id").alias("row_id")).union(spark.createDataFrame([(5,), (None,)], "row_id bigint"))
    orders = []
    for epoch, reshuffle in ((0, True), (1, True), (1, False)):
        got = B.make_batches(rows, 8, epoch, reshuffle).where("not is_pad").collect()
        orders.append([r.row_id for r in sorted(got, key=lambda r: (r.batch_id, r.pos))])
    assert orders[0] == sorted(range(200), key=lambda i: ((i * 7919) % 1000003, i))
    assert orders[1] == sorted(range(200), key=lambda i: ((i * 7919 + 104729) % 1000003, i))
    assert orders[2] == orders[0]


@pytest.mark.parametrize(("limit", "kept"), [(0, 5), (1, 1), (3, 3), (9, 5)])
def test_limit(spark, limit, kept):
    b = spark.range(5).select(F.lit(0).alias("epoch"), F.col("id").cast("int").alias("batch_id"))
    assert B.limit_batches(b, limit).count() == kept


def test_places_heads_and_stack(spark):
    rows = [(0, 0, 0, 7, None), (0, 0, 0, 7, None), (0, 0, 1, 8, False), (0, 1, 0, 7, True)]
    b = spark.createDataFrame(rows, "epoch int, batch_id int, pos int, row_id bigint, is_pad boolean")
    places = B.distinct_places(b)
    assert sorted((r.batch_id, r.pos, r.is_pad) for r in places.collect()) == [(0, 0, False), (0, 1, False), (1, 0, True)]
    assert B.head_rows(places, 2, 2).count() == 2
    assert B.stack(b, b).count() == 8


def test_descriptors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "x array<float>, y array<float>")
    assert [tuple(r) for r in B.descriptors(df).orderBy("name").collect()] == [("data", 32, 2, "array<float>"), ("label", 32, 1, "array<float>")]


def test_samples(spark):
    rows = spark.range(20).select(F.col("id").alias("row_id"), F.lit(1).alias("draw"))
    got = S.with_replacement(rows, 50, seed=3).collect()
    assert sorted(r.draw for r in got) == list(range(50)) and {r.row_id for r in got} <= set(range(20))
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.with_replacement(rows, 50, seed=3).collect()))
    assert S.with_replacement(rows.where("false"), 5, seed=3).count() == 0
    assert len({r.row_id for r in S.without_replacement(rows, "row_id", 10).collect()}) == 10
    with pytest.raises(ValueError):
        S.without_replacement(rows, "row_id", 21)
