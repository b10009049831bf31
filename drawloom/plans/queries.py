"""The registered queries over the canonical tables; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.functions import arrays as A
from drawloom.functions import losses as L
from drawloom.operators import batching as B
from drawloom.operators import evaluate as E
from drawloom.operators import gradients as G
from drawloom.operators import metrics as M
from drawloom.operators import network as N
from drawloom.operators import sampling as S
from drawloom.operators import trainer as T
from drawloom.sources.tables import latest, latest_wide, read_table, split_name
from drawloom.streaming.running_metrics import running_accuracy

CLASSES, WIDTH = 10, 784


def _examples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest delivery of every row_id, only the columns asked for."""
    pick = latest_wide if "x" in columns else latest
    return pick(read_table(spark, d, "examples").select("row_id", "loaded_at", *columns)).drop("loaded_at")


def _train(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _examples(spark, d, "split", *columns).where(split_name() == "train")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row a row_id: repeated rows are equal, so any of them serves."""
    return read_table(spark, d, "predictions").dropDuplicates(["row_id"])


def _places(spark: SparkSession, d: str) -> DataFrame:
    return B.distinct_places(read_table(spark, d, "batches"))


def _run(spark: SparkSession, d: str, which: str = "min") -> tuple[str, N.Weights]:
    params = read_table(spark, d, "params")
    run_id = params.agg(getattr(F, which)("run_id")).first()[0]
    return run_id, N.load_weights(params, run_id)


def _labelled(rows: DataFrame) -> DataFrame:
    """Rows with a label; y becomes its one-hot vector."""
    label = A.class_id(F.col("y"), CLASSES)
    return rows.withColumn("label", label).where("label is not null").withColumn("y", A.one_hot(F.col("label"), CLASSES))


# arrays and introspection


def q_shape_stats(spark, d):
    e = read_table(spark, d, "examples")
    return e.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("x").isNull()).alias("null_x"),
        F.min(F.size("x")).alias("min_x"),
        F.max(F.size("x")).alias("max_x"),
        F.count_if(F.col("y").isNull()).alias("null_y"),
        F.min(F.size("y")).alias("min_y"),
        F.max(F.size("y")).alias("max_y"),
    )


def q_dtypes(spark, d):
    kinds = dict(read_table(spark, d, "examples").dtypes)
    return spark.createDataFrame([(c, kinds[c]) for c in ("x", "y")], "name string, dtype string")


def q_descriptors(spark, d):
    return B.descriptors(read_table(spark, d, "examples"))


def q_param_shapes(spark, d):
    return N.param_shapes(read_table(spark, d, "params"))


def q_slice(spark, d):
    part = _examples(spark, d, "x").select("row_id", A.columns_between(F.col("x"), 150, 160).alias("part"))
    return part.select("row_id", F.size("part").alias("width"), A.element(F.col("part"), 0).cast("double").alias("first"), F.round(A.total(F.col("part")), 4).alias("total"))


def q_cast_roundtrip(spark, d):
    e = _examples(spark, d, "x", "y")
    ints = A.as_ints(F.col("x"))
    back = A.as_floats(ints)
    return e.select(
        "row_id",
        A.total(F.filter(back, lambda v: v.isNotNull())).alias("int_total"),
        (A.as_floats(A.as_ints(F.col("y"))) == F.col("y")).alias("y_kept"),
    )


def q_argmax(spark, d):
    return _predictions(spark, d).select("row_id", A.argmax(F.col("y")).alias("y_id"), A.argmax(F.col("output")).alias("output_id"))


def q_class_id(spark, d):
    return _examples(spark, d, "y").select("row_id", A.class_id(F.col("y"), CLASSES).alias("label"))


def q_one_hot(spark, d):
    label = A.class_id(F.col("y"), CLASSES)
    e = _examples(spark, d, "y").select("row_id", label.alias("label"), A.one_hot(label, CLASSES).alias("hot"))
    hot = e.where("label is not null").select("row_id", F.posexplode("hot").alias("i", "v"))
    return hot.select("row_id", "i", F.col("v").cast("double").alias("v"))


def q_reshape(spark, d):
    e = _examples(spark, d, "x").where(A.is_complete(F.col("x"), WIDTH))
    rows = e.select("row_id", F.posexplode(A.to_grid(F.col("x"), 28, 28)).alias("r", "line"))
    return rows.select("row_id", "r", F.round(A.total(F.col("line")), 4).alias("ink"))


def q_plot_titles(spark, d):
    return E.plot_examples(_predictions(spark, d)).select("row_id", "title")


# batches and samples


def q_batches(spark, d):
    return B.make_batches(_train(spark, d), 32, epoch=1)


def q_pad_rows(spark, d):
    rows = _examples(spark, d, "split").where(split_name() == "test")
    return B.make_batches(rows, 32, epoch=2).where("is_pad")


def q_batch_limit(spark, d):
    return B.limit_batches(_places(spark, d), 20).groupBy("epoch").agg(
        F.countDistinct("batch_id").alias("n_batches"), F.count(F.lit(1)).alias("n_rows"), F.count_if("is_pad").alias("n_pads")
    )


def q_first_batch(spark, d):
    return B.limit_batches(_places(spark, d), 1).select("epoch", "pos", "row_id")


def q_head_rows(spark, d):
    return B.head_rows(_places(spark, d), 100).select("batch_id", "pos", "row_id")


def q_stack(spark, d):
    e = _examples(spark, d, "split")
    stacked = B.stack(e.where(split_name() == "test").select("row_id"), e.where(split_name() == "valid").select("row_id"), _places(spark, d).select("row_id"))
    return stacked.groupBy("row_id").agg(F.count(F.lit(1)).alias("times"))


def q_sample_with_replacement(spark, d):
    return S.with_replacement(_examples(spark, d, "split"), 8, seed=7).select("draw", "row_id")


def q_sample_losses(spark, d):
    h = read_table(spark, d, "history").where(F.col("avg_loss").isNotNull() & ~F.isnan("avg_loss"))
    key = F.concat_ws("#", "run_id", F.col("epoch").cast("string"))
    return S.without_replacement(h.withColumn("k", key), "k", 10, seed=3).select("run_id", "epoch", "avg_loss")


# forward, losses


def _layer(spark, d, activation):
    _, nets = _run(spark, d)
    w, b, _ = nets[0]
    z = N.forward(_examples(spark, d, "x"), [(w, b, activation)], output="z").where("z is not null")
    return z.select("row_id", F.posexplode("z").alias("unit", "v")).select("row_id", "unit", F.round("v", 6).alias("z"))


def q_dense_linear(spark, d):
    return _layer(spark, d, None)


def q_dense_relu(spark, d):
    return _layer(spark, d, "relu")


def q_dense_sigmoid(spark, d):
    return _layer(spark, d, "sigmoid")


def q_forward2(spark, d):
    """Both runs' networks over one pass of the drawings."""
    (first, one), (second, two) = _run(spark, d, "min"), _run(spark, d, "max")
    both = N.forward(_examples(spark, d, "x"), one, output="one", keep=["row_id", "x"])
    both = N.forward(both, two, output="two", keep=["row_id", "one"])
    each = F.explode(F.array(F.struct(F.lit(first).alias("run_id"), F.col("one").alias("o")), F.struct(F.lit(second).alias("run_id"), F.col("two").alias("o")))).alias("e")
    out = both.select("row_id", each)
    return out.select("e.run_id", "row_id", A.argmax(F.col("e.o")).alias("predicted"), F.round(F.array_max("e.o"), 6).alias("top"))


def q_forward_columns(spark, d):
    """The column-expression path, over the embeddings, with weights from an integer formula."""
    import numpy as np

    u, i = np.arange(10)[:, None], np.arange(64)[None, :]
    w = ((u * 31 + i * 17) % 101 - 50) / 100.0
    o = N.forward_columns(read_table(spark, d, "embeddings"), [(w, np.arange(10) / 10.0, "relu")], x="embedding")
    return o.select("vec_id", F.posexplode("output").alias("unit", "v")).select("vec_id", "unit", F.round("v", 6).alias("z"))


def q_l2_loss(spark, d):
    return _predictions(spark, d).select("row_id", F.round(L.l2(F.col("output"), F.col("y")), 6).alias("loss"))


def q_softmax_ce(spark, d):
    return _predictions(spark, d).select("row_id", F.round(L.softmax_ce(F.col("output"), A.class_id(F.col("y"), CLASSES)), 6).alias("loss"))


def q_softmax(spark, d):
    p = _predictions(spark, d).where(A.is_complete(F.col("output"), CLASSES))
    return p.select("row_id", F.posexplode(A.softmax(F.col("output"))).alias("i", "v")).select("row_id", "i", F.round("v", 6).alias("p"))


def _batch_losses(spark, d):
    """Mean loss of each batch of the shortened pass under the first run's weights, pads included."""
    _, nets = _run(spark, d)
    rows = N.forward(_labelled(_train(spark, d, "x", "y")), nets, keep=["row_id", "label"])
    losses = rows.select("row_id", L.softmax_ce(F.col("output"), F.col("label")).alias("loss"))
    return _places(spark, d).join(losses, "row_id").groupBy("epoch", "batch_id").agg(F.avg("loss").alias("loss"), F.count("loss").alias("n_rows"))


def q_batch_mean_loss(spark, d):
    return _batch_losses(spark, d).select("epoch", "batch_id", "n_rows", F.round("loss", 6).alias("loss"))


def q_epoch_loss(spark, d):
    return _batch_losses(spark, d).groupBy("epoch").agg(F.round(F.avg("loss"), 6).alias("avg_loss"), F.count(F.lit(1)).alias("num_batches"))


def q_loss_dispatch(spark, d):
    """Each loss by its name: the vector for one, the class id for the other."""
    p = _predictions(spark, d).withColumn("label", A.class_id(F.col("y"), CLASSES))
    out = [p.select("row_id", F.lit(kind.value).alias("kind"), F.round(L.loss_column(kind, F.col("output"), F.col("y"), F.col("label")), 6).alias("loss")) for kind in L.Loss]
    return B.stack(*out)


def q_label_vectors(spark, d):
    """Class ids as vectors of one element."""
    p = _predictions(spark, d).select("row_id", A.as_vector(A.class_id(F.col("y"), CLASSES)).alias("label"))
    return p.select("row_id", F.size("label").alias("width"), A.element(F.col("label"), 0).alias("label"))


def q_initial_params(spark, d):
    """Shapes and bounds of the initial weights of every recorded configuration, widths following from the data."""
    width = read_table(spark, d, "examples").agg(F.max(F.size("x"))).first()[0]
    frames = [N.params_frame(spark, N.xavier(layers, width, seed=k), name, 0) for k, (name, (layers, *_)) in enumerate(N.EXPERIMENTS.items())]
    each = F.explode("w").alias("v")
    facts = B.stack(*frames).select("run_id", "layer", "unit", "b", F.size("w").alias("width"), each)
    return facts.groupBy("run_id", "layer").agg(
        F.countDistinct("unit").alias("units"),
        F.max("width").alias("width"),
        (F.max(F.abs("v")) <= F.sqrt(F.lit(2.24) / ((F.max("width") + F.countDistinct("unit")) / 2))).alias("within"),
        (F.max(F.abs("v")) > 0.9 * F.sqrt(F.lit(2.24) / ((F.max("width") + F.countDistinct("unit")) / 2))).alias("spread"),
        F.max(F.abs("b")).alias("bias"),
    )


# metrics


def q_accuracy(spark, d):
    return M.scored(_predictions(spark, d)).agg(F.round(M.accuracy(), 6).alias("acc"))


def q_top3(spark, d):
    return M.scored(_predictions(spark, d)).agg(F.round(M.accuracy("in_top"), 6).alias("top3"))


def q_top_ids(spark, d):
    p = _predictions(spark, d).where(A.is_complete(F.col("output"), CLASSES))
    return p.select("row_id", F.posexplode(A.top_ids(F.col("output"), 3)).alias("place", "class"))


def q_composite(spark, d):
    e = _examples(spark, d, "split").select("row_id", split_name().alias("split"))
    s = M.scored(_predictions(spark, d).join(e, "row_id"))
    return M.composite(s, "split").select("split", "n_rows", "n_skipped", F.round("acc", 6).alias("acc"), F.round("top3", 6).alias("top3"))


def q_evaluate(spark, d):
    """Forward pass of the first run's network over all drawings, scored by split in one aggregate."""
    _, nets = _run(spark, d)
    rows = _examples(spark, d, "split", "x", "y").withColumn("split", split_name())
    s = M.scored(N.forward(rows, nets, keep=["split", "y"]))
    return M.composite(s, "split").select("split", "n_rows", "n_skipped", F.round("acc", 6).alias("acc"), F.round("top3", 6).alias("top3"))


def q_evaluate_padded(spark, d):
    """Accuracy over the test batches with their pads counted, as an iterator hands them out."""
    _, nets = _run(spark, d)
    rows = _examples(spark, d, "split", "x", "y").where(split_name() == "test")
    padded = B.make_batches(rows.select("row_id"), 32, epoch=0).join(rows.select("row_id", "x", "y"), "row_id")
    m = E.evaluate_accuracy(padded.select("x", "y"), nets)
    return m.select("n_rows", "n_skipped", F.round("acc", 6).alias("acc"), F.round("top3", 6).alias("top3"))


def q_cumulative_metric(spark, d):
    """Running blends over the epochs of every run of history, test before train, as 1000 rows an evaluation."""
    h = read_table(spark, d, "history").groupBy("run_id", "epoch").agg(*[F.max(c).alias(c) for c in ("train_acc", "train_top3", "test_acc", "test_top3")])
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("test_acc").alias("a"), F.col("test_top3").alias("t")),
            F.struct(F.lit(1).alias("side"), F.col("train_acc").alias("a"), F.col("train_top3").alias("t")),
        )
    ).alias("e")
    fine = F.col("e.a").isNotNull() & ~F.isnan("e.a") & F.col("e.t").isNotNull() & ~F.isnan("e.t")
    evals = h.select("run_id", "epoch", sides).where(fine).select(
        "run_id",
        (F.col("epoch") * 2 + F.col("e.side")).alias("eval_seq"),
        F.lit(1000).alias("n_rows"),
        F.round(F.col("e.a") * 1000).alias("n_correct"),
        F.round(F.col("e.t") * 1000).alias("n_top"),
    )
    return M.cumulative(evals, "run_id").select("run_id", "eval_seq", F.round("run_acc", 6).alias("run_acc"), F.round("run_top3", 6).alias("run_top3"))


def q_running_accuracy(spark, d):
    """The streaming metric's aggregate, run over the table."""
    r = running_accuracy(_predictions(spark, d))
    return r.select("n_rows", F.round("acc", 6).alias("acc"), F.round("top3", 6).alias("top3"))


def q_correct(spark, d):
    return E.split_correct(_predictions(spark, d))[0].select("row_id", "label", "predicted")


def q_incorrect(spark, d):
    return E.split_correct(_predictions(spark, d))[1].select("row_id", "label", "predicted")


def q_accuracy_pct(spark, d):
    p = _predictions(spark, d)
    order = B.make_batches(p.select("row_id"), 32)
    return E.accuracy_percent(order.where(~F.col("is_pad")).join(p, "row_id"), n_rows=1000).select("n_rows", "n_correct", F.round("pct", 6).alias("pct"))


def _history(spark, d):
    """One row a run and epoch: repeated deliveries are equal but for nulls."""
    names = ("avg_loss", "seconds", "num_batches", "train_acc", "train_top3", "test_acc", "test_top3")
    return read_table(spark, d, "history").groupBy("run_id", "epoch").agg(*[F.max(c).alias(c) for c in names])


def q_history_lines(spark, d):
    """The line printed of every epoch."""
    return E.epoch_lines(_history(spark, d)).select("run_id", "epoch", "line")


def q_history_report(spark, d):
    """What is printed of every epoch, accuracies too."""
    return E.epoch_lines(_history(spark, d), verbose=2)


def q_epoch_times(spark, d):
    h = read_table(spark, d, "history").groupBy("run_id", "epoch").agg(F.max("seconds").alias("seconds"), F.max("num_batches").alias("n"))
    return h.groupBy("run_id").agg(F.round(F.sum("seconds"), 5).alias("seconds"), F.count(F.lit(1)).alias("epochs"), F.max("n").alias("num_batches"))


# gradients and training


def _gradient(spark, d, loss):
    _, nets = _run(spark, d)
    g = G.gradient(_labelled(_train(spark, d, "x", "y")), nets, loss)
    return g.select("layer", "unit", "n", F.round("db", 4).alias("db"), F.posexplode("dw").alias("i", "g")).select("layer", "unit", "i", "n", "db", F.round("g", 4).alias("dw"))


def q_grad_l2(spark, d):
    return _gradient(spark, d, L.Loss.L2).where("layer = 1")


def q_grad_ce(spark, d):
    return _gradient(spark, d, L.Loss.SOFTMAX_CE)


def q_sgd_step(spark, d):
    run_id, nets = _run(spark, d)
    g = G.gradient(_labelled(_train(spark, d, "x", "y")), nets, L.Loss.SOFTMAX_CE)
    params = N.params_frame(spark, nets, run_id, 0)
    s = G.sgd_step(params, g, 0.01)
    return s.select("layer", "unit", F.round("b", 6).alias("b"), F.round(A.total(F.col("w")), 6).alias("w_total"))


def q_train_steps(spark, d):
    """Exact mini-batch descent over the shortened pass for both runs' weights."""
    rows = _places(spark, d).join(_labelled(_train(spark, d, "x", "y")), "row_id").select("epoch", "batch_id", "pos", "x", "y")
    runs = {}
    for which in ("min", "max"):
        run_id, nets = _run(spark, d, which)
        runs[run_id] = (nets, L.Loss.SOFTMAX_CE, 0.0001)
    steps = T.train_minibatch(rows, runs)
    return steps.where(~F.col("last")).select("run_id", "epoch", "batch_id", "n", F.round("loss", 6).alias("loss"))


def q_train_experiments(spark, d):
    """The seven recorded configurations from seeded initial weights, each over its own number of batches an epoch (E7: all) and its own epochs."""
    most = max(epochs for *_, epochs in N.EXPERIMENTS.values())
    train = _labelled(_train(spark, d, "x", "y")).select("row_id", "x", "y")
    rows = B.epochs_of(_train(spark, d), most).join(train, "row_id").select("epoch", "batch_id", "pos", "x", "y")
    runs = {name: (N.xavier(layers, WIDTH, seed=k), L.Loss(loss), lr) for k, (name, (layers, loss, lr, _, _)) in enumerate(N.EXPERIMENTS.items())}
    limits = {name: limit for name, (_, _, _, limit, _) in N.EXPERIMENTS.items()}
    epochs = {name: n for name, (_, _, _, _, n) in N.EXPERIMENTS.items()}
    losses = T.epoch_losses(T.train_minibatch(rows, runs, limits, epochs, weights=False))
    return losses.select("run_id", "epoch", "num_batches", F.round("avg_loss", 6).alias("avg_loss"))


def _linear(spark, d):
    """Drawings as the ink of their 28 lines, two epochs of batches, and a linear layer with weights from an integer formula."""
    import numpy as np

    ink = F.transform(A.to_grid(F.col("x"), 28, 28), lambda line: A.total(line) / F.lit(7140.0))
    drawn = _labelled(_examples(spark, d, "split", "x", "y")).where(A.is_complete(F.col("x"), WIDTH))
    rows = drawn.select("row_id", split_name().alias("split"), ink.alias("x"), "y")
    batches = B.epochs_of(_train(spark, d), 2).join(rows.where("split = 'train'"), "row_id")
    u, i = np.arange(10)[:, None], np.arange(28)[None, :]
    runs = {"linear": ([(((u * 31 + i * 17) % 11 - 5) / 100.0, np.zeros(10), None)], L.Loss.L2, 0.5)}
    return rows, batches, runs


def q_train_linear(spark, d):
    """Exact mini-batch descent of a linear layer under the squared loss, batch by batch over two epochs."""
    _, batches, runs = _linear(spark, d)
    steps = T.train_minibatch(batches.select("epoch", "batch_id", "pos", "x", "y"), runs).where(~F.col("last"))
    return steps.select("epoch", "batch_id", "n", F.round("loss", 6).alias("loss"))


def q_train_linear_history(spark, d):
    """The history of that training: losses, and accuracies on test and train rows after each epoch."""
    rows, batches, runs = _linear(spark, d)
    evals = {name: rows.where(F.col("split") == name) for name in ("test", "train")}
    history = T.train_model(spark, batches.select("epoch", "batch_id", "pos", "x", "y"), evals, runs)
    return history.select("epoch", "num_batches", *[F.round(c, 6).alias(c) for c in ("avg_loss", "train_acc", "train_top3", "test_acc", "test_top3")])


def q_train_history(spark, d):
    """Train, then evaluate, with the metric that is never reset; x is scaled to 0..1 here."""
    e = _labelled(_examples(spark, d, "split", "x", "y")).withColumn("x", F.transform("x", lambda v: v / F.lit(255.0)))
    e = e.select("row_id", split_name().alias("split"), "x", "y")
    train = e.where("split = 'train'")
    rows = _places(spark, d).join(train.drop("split"), "row_id")
    nets = N.xavier([N.Dense(16, "sigmoid"), N.Dense(10)], WIDTH, seed=1)
    history = T.train_model(spark, rows, {"test": e.where("split = 'test'"), "train": train}, {"small": (nets, L.Loss.SOFTMAX_CE, 0.1)}, metric_mode="cumulative")
    return history.drop("seconds")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
