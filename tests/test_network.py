import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.functions.losses import Loss
from drawloom.operators import evaluate as E
from drawloom.operators import gradients as G
from drawloom.operators import metrics as M
from drawloom.operators import network as N
from drawloom.operators import trainer as T
from drawloom.streaming.running_metrics import predictions_stream, running_accuracy, stream_to_table

RNG = np.random.default_rng(0)


def points(spark, n=60, dirty=True, extra=""):
    """Two blobs in three dimensions, one-hot labels."""
    rows = []
    for i in range(n):
        c = i % 2
        rows.append((i, [float(v) for v in RNG.normal(3 * c - 1.5, 1, 3)], [1.0 - c, float(c)]))
    if dirty:
        rows += [(n, None, [1.0, 0.0]), (n + 1, [1.0, 2.0], [1.0, 0.0]), (n + 2, [1.0, float("nan"), 2.0], [0.0, 1.0]), (n + 3, [1.0, 1.0, 1.0], None), (n + 4, [], [])]
    return spark.createDataFrame(rows, "row_id bigint, x array<float>, y array<float>")


def test_dense_by_hand(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), (None, 2), ([1.0], 3), ([1.0, None], 4), ([float("nan"), 1.0], 5)], "x array<float>, output int")
    net = [(np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([0.5, -1.0]), None)]
    for run in (N.forward, N.forward_columns):
        out = run(df, net)
        assert out.columns.count("output") == 1
        got = sorted((r.output for r in out.collect()), key=lambda v: v is None)
        assert got[0] == [1.5, 2.0] and got[1:] == [None] * 4


@pytest.mark.parametrize("act", N.ACTIVATIONS)
def test_both_forward_passes_agree(spark, act):
    df = points(spark)
    net = N.xavier([N.Dense(4, act), N.Dense(2)], 3, seed=2)
    a = {r.row_id: r.output for r in N.forward(df, net).collect()}
    b = {r.row_id: r.output for r in N.forward_columns(df, net).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or np.allclose(a[k], b[k])
    assert sum(v is None for v in a.values()) == 4
    assert N.forward(df.where("false"), net).count() == 0


def test_activations():
    assert N.activate(np.array([-1.0, 0.0, 2.0]), "relu").tolist() == [0, 0, 2]
    assert N.activate(np.array([0.0]), "sigmoid")[0] == 0.5
    with pytest.raises(ValueError):
        N.Dense(3, "tanh")


def test_params_round_trip(spark):
    net = N.xavier([N.Dense(5, "sigmoid"), N.Dense(2)], 4, seed=1)
    limit = np.sqrt(2.24 / 4.5)
    assert np.abs(net[0][0]).max() <= limit and not net[0][1].any()
    df = N.params_frame(spark, net, "r", 3)
    back = N.load_weights(df.union(df), "r")
    assert all(np.array_equal(a[0], b[0]) and a[2] == b[2] for a, b in zip(net, back))
    assert sorted((r.layer, r.units, r.width) for r in N.param_shapes(df).collect()) == [(0, 5, 4), (1, 2, 5)]
    with pytest.raises(ValueError):
        N.load_weights(df, "unknown")


def test_experiments_are_ten_outputs():
    assert all(layers[-1].units == 10 for layers, *_ in N.EXPERIMENTS.values()) and len(N.EXPERIMENTS) == 7


@pytest.mark.parametrize("loss", list(Loss))
@pytest.mark.parametrize("last", [None, "sigmoid"])
def test_gradient_is_numerical_gradient(loss, last):
    net = N.xavier([N.Dense(4, "sigmoid"), N.Dense(2, last)], 3, seed=4)
    x, y = RNG.normal(size=(5, 3)), np.eye(2)[[0, 1, 1, 0, 1]]
    _, grads = G.losses_and_gradients(x, y, net, loss)
    for k, (w, b, _) in enumerate(net):
        for index in np.ndindex(w.shape):
            up = [(a.copy(), c.copy(), d) for a, c, d in net]
            down = [(a.copy(), c.copy(), d) for a, c, d in net]
            up[k][0][index] += 1e-6
            down[k][0][index] -= 1e-6
            slope = (G.losses_and_gradients(x, y, up, loss)[0].sum() - G.losses_and_gradients(x, y, down, loss)[0].sum()) / 2e-6
            assert slope == pytest.approx(grads[k][0][index], abs=1e-6)


def test_two_equal_logits():
    net = [(np.zeros((2, 1)), np.zeros(2), None)]
    _, grads = G.losses_and_gradients(np.ones((1, 1)), np.array([[1.0, 0.0]]), net, Loss.SOFTMAX_CE)
    assert grads[0][1].tolist() == [-0.5, 0.5]


def test_relational_gradient_and_step(spark):
    df = points(spark)
    net = N.xavier([N.Dense(4, "relu"), N.Dense(2)], 3, seed=5)
    rows = G.gradient(df.repartition(3), net, Loss.SOFTMAX_CE)
    clean = [r for r in df.collect() if r.x is not None and len(r.x) == 3 and not np.isnan(r.x).any() and r.y is not None]
    _, grads = G.losses_and_gradients(np.array([r.x for r in clean], float), np.array([r.y for r in clean], float), net, Loss.SOFTMAX_CE)
    for r in rows.collect():
        assert np.allclose(r.dw, grads[r.layer][0][r.unit]) and r.n == len(clean)
    params = N.params_frame(spark, net, "r", 0).withColumn("n", F.lit(1))
    stepped = N.load_weights(G.sgd_step(params, rows, 0.1), "r")
    for got, want in zip(stepped, G.step(net, grads, 0.1, len(clean))):
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    assert G.gradient(df.where("false"), net, Loss.L2).count() == 0


def test_sgd_scale():
    got = G.step([(np.array([[1.0]]), np.array([0.0]), None)], [(np.array([[10.0]]), np.array([0.0]), None)], 0.01, 32)
    assert got[0][0][0, 0] == 0.996875


def test_minibatch_descent_equals_a_plain_loop(spark):
    df = points(spark, 40)
    nets = {"a": N.xavier([N.Dense(2)], 3, seed=6), "b": N.xavier([N.Dense(3, "sigmoid"), N.Dense(2)], 3, seed=7)}
    runs = {"a": (nets["a"], Loss.SOFTMAX_CE, 0.5), "b": (nets["b"], Loss.L2, 0.1)}
    rows = df.where("row_id < 42").selectExpr("explode(array(0, 1)) epoch", "cast(row_id div 8 as int) batch_id", "cast(row_id % 8 as int) pos", "x", "y")
    steps = T.train_minibatch(rows.repartition(5), runs, batch_limit=4).collect()
    data = {r.row_id: r for r in df.collect() if r.row_id < 40}
    for name, (net, loss, lr) in runs.items():
        losses = []
        for _ in range(2):
            for b in range(4):
                x, y = np.array([data[i].x for i in range(8 * b, 8 * b + 8)], float), np.array([data[i].y for i in range(8 * b, 8 * b + 8)], float)
                each, grads = G.losses_and_gradients(x, y, net, loss)
                losses.append(each.mean())
                net = G.step(net, grads, lr, 8)
        got = [r.loss for r in sorted((r for r in steps if r.run_id == name and not r.last), key=lambda r: (r.epoch, r.batch_id))]
        assert np.allclose(got, losses)
        last = [r for r in steps if r.run_id == name and r.last and r.epoch == 1 and r.layer == 0]
        assert np.allclose([r.w for r in sorted(last, key=lambda r: r.unit)], net[0][0])


def test_every_run_has_its_own_batches_and_epochs(spark):
    df = points(spark, 40)
    rows = df.selectExpr("explode(array(0, 1, 2)) epoch", "cast(row_id div 4 as int) batch_id", "cast(row_id % 4 as int) pos", "x", "y")
    runs = {f"r{k}": (N.xavier([N.Dense(2 + k), N.Dense(2)], 3, seed=k), Loss.L2, 0.1) for k in range(5)}
    limits, epochs = {f"r{k}": (0, 3, 4, 3, 0)[k] for k in range(5)}, {"r1": 1, "r4": 2}
    whole = T.train_minibatch(rows, runs, limits, epochs, lanes=3)
    got = {(r.run_id, r.epoch): r.num_batches for r in T.epoch_losses(whole).collect()}
    assert got == {(f"r{k}", e): limits[f"r{k}"] or 10 for k in range(5) for e in range(epochs.get(f"r{k}", 3))}
    alone = {(r.run_id, r.epoch, r.batch_id): r.loss for k in range(5) for r in T.train_minibatch(rows, {f"r{k}": runs[f"r{k}"]}, limits, epochs).where("not last").collect()}
    assert {(r.run_id, r.epoch, r.batch_id): r.loss for r in whole.where("not last").collect()} == alone
    assert all(r.seconds > 0 for r in whole.where("last").select("seconds").distinct().collect())


def test_experiments_have_their_recorded_epochs(spark, tmp_path):
    from drawloom.plans.queries import QUERIES

    x = np.random.default_rng(9).random((4, 784))
    examples = [(i, "train", [float(v) for v in x[i]], [float(j == i) for j in range(10)], 1) for i in range(4)]
    spark.createDataFrame(examples, "row_id bigint, split string, x array<float>, y array<float>, loaded_at int").write.parquet(f"{tmp_path}/examples.parquet")
    got = {}
    for r in QUERIES["q_train_experiments"](spark, str(tmp_path)).collect():
        got[r.run_id] = got.get(r.run_id, 0) + r.num_batches
    assert got == {f"E{k}": 5 if k == 3 else 10 for k in range(1, 8)}


def test_epoch_lines(spark):
    rows = [("r", 0, 0.04, 1.26, 3, 0.5, 0.75, 0.25, 1.0, [0.5, 0.25]), ("r", 1, None, 1.0, 3, 0.5, None, 0.25, 1.0, [])]
    h = spark.createDataFrame(rows, "run_id string, epoch int, avg_loss double, seconds double, num_batches int, train_acc double, train_top3 double, test_acc double, test_top3 double, some array<double>")
    got = [r.line for r in E.epoch_lines(h, 3, "some").where("epoch = 0").orderBy("line_no").collect()]
    assert got == [
        "Epoch 0 Loss: 0.04000 Time: 1.3s Num batches: 3", "Sample batch losses: [0.50000, 0.25000]",
        "Train_acc 0.50000, Train_top_3_accuracy 0.75000", "Test_acc 0.25000, Test_top_3_accuracy 1.00000",
    ]
    assert [r.line for r in E.epoch_lines(h).where("epoch = 1").collect()] == [None]
    with pytest.raises(ValueError):
        E.epoch_lines(h, 4)


def test_training_learns_and_repeats(spark):
    df = points(spark, 80)
    net = N.xavier([N.Dense(4, "sigmoid"), N.Dense(2)], 3, seed=8)
    _, lost = T.train_full_batch(df, net, Loss.SOFTMAX_CE, 1.0, 4)
    assert lost == sorted(lost, reverse=True) and lost[-1] < lost[0]
    with pytest.raises(ValueError):
        T.train_full_batch(df.where("false"), net, Loss.L2, 1.0, 1)


def test_history_modes(spark):
    x, y = np.eye(10), np.eye(10)
    rows = [(0, b, i, [float(v) for v in x[i]], [float(v) for v in y[i]]) for b in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "epoch int, batch_id int, pos int, x array<float>, y array<float>")
    df = df.union(df.withColumn("epoch", F.lit(1)))
    runs = {"r": (N.xavier([N.Dense(10)], 10, seed=1), Loss.SOFTMAX_CE, 1.0)}
    each = T.train_model(spark, df, {"test": df.where("pos < 5"), "train": df}, runs).orderBy("epoch").collect()
    blend = T.train_model(spark, df, {"test": df.where("pos < 5"), "train": df}, runs, metric_mode="cumulative").orderBy("epoch").collect()
    assert [r.num_batches for r in each] == [3, 3]
    assert blend[0].test_acc == each[0].test_acc
    assert blend[0].train_acc == pytest.approx((30 * each[0].test_acc + 60 * each[0].train_acc) / 90)


def test_metrics(spark):
    rows = [(1, [1.0, 0.0], [0.9, 0.1]), (2, [0.0, 1.0], [0.9, 0.1]), (3, [0.0, 1.0], [0.1, 0.9]), (4, [1.0, 0.0], [0.5, 0.5]), (5, None, [0.1, 0.9]), (6, [1.0, 0.0], None), (7, [1.0, 0.0], [float("nan"), 0.1]), (8, [0.5, 0.5], [0.1, 0.9])]
    df = spark.createDataFrame(rows, "row_id bigint, y array<float>, output array<double>")
    s = M.scored(df.withColumn("label", F.lit("x")), classes=2, k=1)
    m = M.composite(s).first()
    assert (m.n_rows, m.n_skipped, m.acc, m.top3) == (4, 4, 0.75, 0.75)
    assert M.composite(M.scored(df.where("false"), 2)).first().acc is None
    ten = df.select("row_id", F.expr("concat(y, array_repeat(0f, 8))").alias("y"), F.expr("concat(output, array_repeat(-9d, 8))").alias("output"))
    right, wrong = E.split_correct(ten)
    assert right.count() + wrong.count() == 4 and wrong.first().row_id == 2
    pct = E.accuracy_percent(ten).first()
    assert (pct.n_rows, pct.n_correct, pct.pct) == (4, 3, 75.0)
    assert E.accuracy_percent(ten.where("false")).first().pct is None
    assert sorted(r.title for r in E.plot_examples(ten.union(ten)).collect()) == ["num: 0,0", "num: 0,0", "num: 1,0", "num: 1,1"]


def test_cumulative(spark):
    evals = spark.createDataFrame([("r", 0, 4, 2, 3), ("r", 1, 8, 8, 8)], "run_id string, eval_seq int, n_rows int, n_correct int, n_top int")
    got = [r.run_acc for r in M.cumulative(evals, "run_id").orderBy("eval_seq").collect()]
    assert got == [0.5, pytest.approx(10 / 12)]


def test_mean_of_batch_means(spark):
    steps = spark.createDataFrame([("r", 0, 0, 2.0, False), ("r", 0, 1, 5.0, False)], "run_id string, epoch int, batch_id int, loss double, last boolean")
    assert T.epoch_losses(steps).first().avg_loss == 3.5


def test_stream_equals_table(spark, tmp_path):
    hot = [[1.0 if j == i else 0.0 for j in range(10)] for i in range(10)]
    rows = [(i, hot[i % 10], [float(v) for v in hot[(i + i // 15) % 10]]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id bigint, y array<float>, output array<double>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = stream_to_table(spark, predictions_stream(spark, str(tmp_path / "in")), "running", str(tmp_path / "check")).first()
    want = running_accuracy(df).first()
    assert (got.n_rows, got.acc, got.top3) == (want.n_rows, want.acc, want.top3) and got.acc == 0.5


def test_step_in_place_gives_the_same_bits_without_new_arrays():
    rng = np.random.default_rng(2)
    mine = N.xavier([N.Dense(6, "relu"), N.Dense(3)], 5, seed=1)
    theirs = [(w.copy(), b.copy(), act) for w, b, act in mine]
    held = [w for w, _, _ in theirs]
    for _ in range(5):
        x, y = rng.random((4, 5)), np.eye(3)[rng.integers(0, 3, 4)]
        mine = G.step(mine, G.losses_and_gradients(x, y, mine, "softmax_ce")[1], 0.1, 4)
        G.step_in_place(theirs, G.losses_and_gradients(x, y, theirs, "softmax_ce")[1], 0.1, 4)
    assert all((a == c).all() and (b == d).all() for (a, b, _), (c, d, _) in zip(mine, theirs))
    assert all(h is w for h, (w, _, _) in zip(held, theirs))
