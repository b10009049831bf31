import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.functions import arrays as A
from drawloom.functions import losses as L
from drawloom.sources.tables import from_arrays, latest, latest_wide, read_table, to_arrays, write_table


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"a {kind}").select(expression(F.col("a")).alias("r")).first().r


def test_slice(spark):
    assert one(spark, [float(i) for i in range(200)], "array<float>", lambda a: A.columns_between(a, 150, 160)) == [float(i) for i in range(150, 160)]
    assert one(spark, [1.0], "array<float>", lambda a: A.columns_between(a, 3, 9)) == []
    assert one(spark, None, "array<float>", lambda a: A.columns_between(a, 0, 2)) is None
    with pytest.raises(ValueError):
        A.columns_between(F.col("a"), 5, 2)


def test_casts(spark):
    assert one(spark, [0.0, 1.0, 2.9, -2.9], "array<float>", A.as_ints) == [0, 1, 2, -2]
    assert one(spark, [0.0, 1.0], "array<float>", lambda a: A.as_floats(A.as_ints(a))) == [0.0, 1.0]
    assert one(spark, [float("nan"), None, 3e10], "array<float>", A.as_ints) == [None, None, None]


@pytest.mark.parametrize(
    ("value", "position"),
    [([1.0, 3.0, 3.0], 1), ([None, 2.0], 1), ([float("nan"), 9.0], 0), ([], None), (None, None), ([None], None)],
)
def test_argmax(spark, value, position):
    assert one(spark, value, "array<float>", A.argmax) == position


@pytest.mark.parametrize(
    ("y", "label"),
    [([0.0, 1.0, 0.0], 1), ([0.2, 0.5, 0.3], 1), ([1.0, 1.0, 0.0], None), ([0.0, 1.0], None), ([None, 1.0, 0.0], None), ([float("nan"), 1.0, 0.0], None), (None, None), ([], None)],
)
def test_class_id(spark, y, label):
    assert one(spark, y, "array<float>", lambda a: A.class_id(a, 3)) == label


def test_one_hot(spark):
    assert one(spark, 3, "int", A.one_hot) == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert one(spark, None, "int", A.one_hot) is None
    assert one(spark, 10, "int", A.one_hot) is None
    assert one(spark, 3, "int", lambda a: A.class_id(A.one_hot(a))) == 3


def test_grid(spark):
    assert one(spark, [1.0, 2.0, 3.0, 4.0], "array<float>", lambda a: A.to_grid(a, 2, 2)) == [[1, 2], [3, 4]]
    assert one(spark, [1.0, 2.0], "array<float>", lambda a: A.to_grid(a, 2, 2)) is None


def test_top_ids_and_rank(spark):
    scores = [0.1, 0.9, 0.9, 0.2]
    assert one(spark, scores, "array<double>", lambda a: A.top_ids(a, 3)) == [1, 2, 3]
    assert [one(spark, scores, "array<double>", lambda a, i=i: A.rank_of(a, F.lit(i))) for i in range(4)] == [3, 0, 1, 2]


def test_softmax_sums_to_one(spark):
    p = one(spark, [1000.0, 0.0, -1000.0], "array<double>", A.softmax)
    assert p[0] == 1.0 and sum(p) == 1.0


def test_titles_and_formats(spark):
    row = spark.createDataFrame([(2, 0, 1.23456)], "t int, p int, v double").select(A.title(F.col("t"), F.col("p")).alias("title"), A.fixed(F.col("v"), 2, "s").alias("v")).first()
    assert row.title == "num: 2,0" and row.v == "1.23s"


def test_losses(spark):
    hot = [1.0] + [0.0] * 9
    df = spark.createDataFrame([([0.1] * 10, hot, 0), ([1000.0] + [0.0] * 9, hot, 0), (None, hot, 0), ([float("nan")] * 10, hot, 0), ([0.1] * 9, hot, None)], "o array<double>, y array<double>, label int")
    l2 = [r.v for r in df.select(L.l2(F.col("o"), F.col("y")).alias("v")).collect()]
    assert l2[0] == pytest.approx(0.045) and l2[2:] == [None, None, None]
    ce = [r.v for r in df.select(L.softmax_ce(F.col("o"), F.col("label")).alias("v")).collect()]
    assert ce[0] == pytest.approx(math.log(10)) and ce[1] == 0.0 and ce[2:] == [None, None, None]


def test_latest(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (2, 0, "d"), (None, 5, "e"), (3, 1, "x"), (3, 1, "y")]
    df = spark.createDataFrame(rows, "row_id bigint, loaded_at int, v string")
    got = {r.row_id: r.v for r in latest(df).collect()}
    assert got[1] == "b" and got[2] == "d" and got[3] in "xy" and set(got) == {1, 2, 3}
    assert latest(df.where("false")).count() == 0
    wide = latest_wide(df.withColumn("top", F.lit(1)))
    assert sorted(map(tuple, wide.drop("top").collect())) == sorted(map(tuple, latest(df).collect())) and "top" in wide.columns
    assert latest_wide(df.where("false")).count() == 0


def test_round_trip_of_arrays(spark, tmp_path):
    x, y = np.arange(6.0).reshape(2, 3), np.eye(2)
    df = from_arrays(spark, x, y, "train", first_id=5)
    write_table(df, str(tmp_path / "examples.parquet"))
    back = read_table(spark, str(tmp_path), "examples")
    assert (to_arrays(back, "x") == x).all() and [r.row_id for r in back.orderBy("row_id").collect()] == [5, 6]
    with pytest.raises(ValueError):
        to_arrays(back, "x", limit_bytes=10)
    write_table(spark.createDataFrame([(1,)], "row_id bigint"), str(tmp_path / "params.parquet"))
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "params")
