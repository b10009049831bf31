"""SQL for an independent engine, one text a query of plans.queries where SQL can say it."""

from __future__ import annotations

KEY = "((row_id * 7919 + {epoch} * 104729) % 1000003)"
COMPLETE = "({a} IS NOT NULL AND len({a}) = {n} AND len(list_filter({a}, lambda v: v IS NULL OR isnan(v))) = 0)"
ARGMAX = "(list_position({a}, list_max({a})) - 1)::INT"


def complete(a: str, n: int) -> str:
    return COMPLETE.format(a=a, n=n)


def argmax(a: str) -> str:
    return ARGMAX.format(a=a)


def class_id(y: str) -> str:
    return f"CASE WHEN {complete(y, 10)} AND len(list_filter({y}, lambda v: v = list_max({y}))) = 1 THEN {argmax(y)} END"


EX = "e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM examples) WHERE rn = 1)"
PR = "p AS (SELECT row_id, any_value(y) AS y, any_value(output) AS output FROM (SELECT DISTINCT ON (row_id) * FROM predictions) GROUP BY row_id)"
SC = f"""s AS (SELECT row_id, output, label, CASE WHEN label IS NOT NULL THEN {argmax('output')} END AS predicted,
  CASE WHEN label IS NOT NULL THEN len(list_filter(range(10), lambda i: output[i+1] > output[label+1] OR (output[i+1] = output[label+1] AND i < label))) < 3 END AS in_top
  FROM (SELECT row_id, output, CASE WHEN {complete('output', 10)} THEN {class_id('y')} END AS label FROM p))"""
PL = "b AS (SELECT epoch, batch_id, pos, min(row_id) AS row_id, coalesce(bool_and(is_pad), false) AS is_pad FROM batches GROUP BY epoch, batch_id, pos)"
RUN0 = "pa AS (SELECT * FROM params WHERE run_id = (SELECT min(run_id) FROM params) AND epoch = (SELECT max(epoch) FROM params WHERE run_id = (SELECT min(run_id) FROM params)))"
USABLE = complete("x", 784)
TRAIN = "lower(trim(split)) = 'train'"
LAB = f"t AS (SELECT row_id, x::DOUBLE[] AS x, label FROM (SELECT row_id, x, {class_id('y')} AS label FROM e WHERE {TRAIN}) WHERE label IS NOT NULL AND {USABLE})"
ACT = "CASE WHEN pa.activation = 'sigmoid' THEN 1 / (1 + exp(-({z}))) WHEN pa.activation = 'relu' THEN greatest({z}, 0) ELSE {z} END"
FWD = f"""h AS (SELECT row_id, list(v ORDER BY unit) AS h FROM (SELECT row_id, unit, {ACT.format(z='list_inner_product(t.x, pa.w) + pa.b')} AS v FROM t, pa WHERE layer = 0) GROUP BY row_id),
o AS (SELECT row_id, list(v ORDER BY unit) AS o FROM (SELECT row_id, unit, {ACT.format(z='list_inner_product(h.h, pa.w) + pa.b')} AS v FROM h, pa WHERE layer = 1) GROUP BY row_id)"""
CE = "ln(list_sum(list_transform(o, lambda v: exp(v - list_max(o))))) + list_max(o) - o[label + 1]"
ONE_HOT = "list_transform(range(10), lambda i: CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def dense(act: str) -> str:
    z = "list_inner_product(e.x::DOUBLE[], pa.w) + pa.b"
    v = {"linear": z, "relu": f"greatest({z}, 0::DOUBLE)", "sigmoid": f"1 / (1 + exp(-({z})))"}[act]
    return f"WITH {EX}, {RUN0} SELECT row_id, unit, round({v}, 6) AS z FROM e, pa WHERE layer = 0 AND {USABLE}"


def forward2(which: str) -> str:
    run = f"(SELECT {which}(run_id) FROM params)"
    return f"""SELECT {run} AS run_id, e.row_id, {argmax('o')} AS predicted, round(list_max(o), 6) AS top FROM e LEFT JOIN (
      WITH pa AS (SELECT * FROM params WHERE run_id = {run} AND epoch = (SELECT max(epoch) FROM params WHERE run_id = {run})),
      t AS (SELECT row_id, x::DOUBLE[] AS x FROM e WHERE {USABLE}), {FWD} SELECT * FROM o) f ON f.row_id = e.row_id"""


def ordered(rows: str, epoch: int) -> str:
    return f"""r AS (SELECT row_id, row_number() OVER (ORDER BY {KEY.format(epoch=epoch)}, row_id) - 1 AS ord FROM (SELECT DISTINCT row_id FROM e WHERE {rows})),
    c AS (SELECT count(*) AS n FROM r),
    m AS (SELECT ord, row_id, false AS is_pad FROM r UNION ALL SELECT n + ord, row_id, true FROM r, c WHERE ord < (32 - n % 32) % 32)"""


GRAD = f"""WITH {EX}, {RUN0}, {LAB}, {FWD},
a1 AS (SELECT max(activation) AS last FROM pa WHERE layer = 1),
d1 AS (SELECT row_id, label, x, h, {{delta}} AS d FROM o JOIN t USING (row_id) JOIN h USING (row_id), a1),
g1 AS (SELECT 1 AS layer, u::INT AS unit, i::INT AS i, d[u + 1] AS d, h[i + 1] AS v FROM d1, range(10) a(u), range(16) b(i)),
w1 AS (SELECT list(w ORDER BY unit) AS w FROM pa WHERE layer = 1),
a0 AS (SELECT max(activation) AS act FROM pa WHERE layer = 0),
d0 AS (SELECT row_id, x, list_transform(range(16), lambda i: list_inner_product(d, list_transform(w, lambda r: r[i + 1]))
   * CASE WHEN act = 'sigmoid' THEN h[i + 1] * (1 - h[i + 1]) WHEN act = 'relu' THEN CASE WHEN h[i + 1] > 0 THEN 1 ELSE 0 END ELSE 1 END) AS d FROM d1, w1, a0),
x0 AS (SELECT row_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM d0),
e0 AS (SELECT row_id, unnest(d) AS d, generate_subscripts(d, 1) - 1 AS unit FROM d0),
g0 AS (SELECT 0 AS layer, unit::INT AS unit, i::INT AS i, d, v FROM e0 JOIN x0 USING (row_id)),
g AS (SELECT layer, unit, i, sum(d * v) AS dw, sum(d) AS db, count(*) AS n FROM (SELECT * FROM g1 {{both}}) GROUP BY layer, unit, i)"""
#: Slope of the last layer, which may lack an activation.
LAST = "(CASE WHEN last = 'sigmoid' THEN o[i + 1] * (1 - o[i + 1]) ELSE 1 END)"
HIT = "CASE WHEN i = label THEN 1 ELSE 0 END"
DELTA_CE = f"list_transform(range(10), lambda i: (exp(o[i + 1] - list_max(o)) / list_sum(list_transform(o, lambda v: exp(v - list_max(o)))) - {HIT}) * {LAST})"
DELTA_L2 = f"list_transform(range(10), lambda i: (o[i + 1] - {HIT}) / 10.0::DOUBLE * {LAST})"
BL = f"""WITH {EX}, {RUN0}, {LAB}, {FWD}, {PL}, l AS (SELECT row_id, {CE} AS loss FROM o JOIN t USING (row_id)),
bl AS (SELECT epoch, batch_id, count(*) AS n_rows, avg(loss) AS loss FROM b JOIN l USING (row_id) GROUP BY epoch, batch_id)"""


#: Two epochs of batches, and exact descent of a linear layer on the ink of 28 lines: one recursion a batch, a row a unit.
LINEAR = f"""WITH RECURSIVE {EX}, {LAB}, f AS MATERIALIZED (SELECT row_id, label, list_transform(range(28), lambda r: list_sum(x[r * 28 + 1 : r * 28 + 28]) / 7140.0::DOUBLE) AS f FROM t),
r AS (SELECT ep, row_id, row_number() OVER (PARTITION BY ep ORDER BY {KEY.format(epoch='ep')}, row_id) - 1 AS ord FROM (SELECT DISTINCT row_id FROM e WHERE {TRAIN}), range(2) q(ep)),
c AS (SELECT count(*) AS n FROM r WHERE ep = 0),
m AS (SELECT ep, ord, row_id FROM r UNION ALL SELECT ep, n + ord, row_id FROM r, c WHERE ord < (32 - n % 32) % 32),
g AS (SELECT ep, ord // 32 AS batch_id, list(f ORDER BY ord) AS fs, list(label ORDER BY ord) AS ls, count(*) AS n FROM m JOIN f USING (row_id) GROUP BY ALL),
s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ep, batch_id) AS step FROM g),
w AS (SELECT 0::BIGINT AS step, u, list_transform(range(28), lambda i: ((u * 31 + i * 17) % 11 - 5)::DOUBLE / 100.0::DOUBLE) AS w, 0.0::DOUBLE AS b, 0.0::DOUBLE AS sq FROM range(10) a(u)
  UNION ALL SELECT step, u, list_transform(range(28), lambda i: w[i + 1] - 0.05::DOUBLE / n * list_sum(list_transform(range(n), lambda k: errs[k + 1] * fs[k + 1][i + 1]))),
    b - 0.05::DOUBLE / n * list_sum(errs), list_sum(list_transform(errs, lambda v: v * v)) FROM (
    SELECT s.step, u, w, b, fs, n, list_transform(range(n), lambda k: list_inner_product(w, fs[k + 1]) + b - CASE WHEN ls[k + 1] = u THEN 1 ELSE 0 END) AS errs FROM w JOIN s ON s.step = w.step + 1)),
bl AS (SELECT ep, batch_id, any_value(n) AS n, 0.05::DOUBLE * sum(sq) / any_value(n) AS loss FROM w JOIN s USING (step) GROUP BY ep, batch_id)"""
XAVIER = [(name, k, units, width) for name, sizes in (("E1", [128, 10]), ("E2", [128, 10]), ("E3", [128, 10]), ("E4", [128, 10]), ("E5", [512, 256, 128, 64, 10]), ("E6", [512, 256, 128, 64, 10]), ("E7", [512, 256, 128, 64, 10]))
          for k, (units, width) in enumerate(zip(sizes, ["(SELECT max(len(x)) FROM examples)", *map(str, sizes)]))]
HISTORY = "h AS (SELECT run_id, epoch, max(avg_loss) AS l, max(seconds) AS s, max(num_batches) AS n, max(train_acc) AS ra, max(train_top3) AS rt, max(test_acc) AS ta, max(test_top3) AS tt FROM history GROUP BY ALL)"
#: The portable generator's value in [0, 1) for a draw.
UNIFORM = "((((draw + 1) * 48271 + {seed} * 104729) % 2147483647 * 48271 % 2147483647) + ((((draw + 1) * 48271 + {seed} * 104729) % 2147483647 * 48271 % 2147483647) * 48271 + 12345) % 2147483647 / 2147483647.0::DOUBLE) / 2147483647.0::DOUBLE"


def fixed(c: str, digits: int) -> str:
    return f"CASE WHEN isnan({c}) THEN 'NaN' ELSE printf('%.{digits}f', {c}) END"


EPOCH_LINE = f"'Epoch ' || epoch || ' Loss: ' || {fixed('l', 5)} || ' Time: ' || {fixed('s', 1)} || 's Num batches: ' || n"


def grad(delta: str, both: bool) -> str:
    return GRAD.format(delta=delta, both="UNION ALL SELECT * FROM g0" if both else "")


ORACLE = {
    "q_shape_stats": "SELECT count(*) AS n_rows, count_if(x IS NULL)::BIGINT AS null_x, min(len(x))::INT AS min_x, max(len(x))::INT AS max_x, count_if(y IS NULL)::BIGINT AS null_y, min(len(y))::INT AS min_y, max(len(y))::INT AS max_y FROM examples",
    "q_dtypes": "SELECT 'x' AS name, CASE any_value(typeof(x)) WHEN 'FLOAT[]' THEN 'array<float>' END AS dtype FROM examples UNION ALL SELECT 'y', CASE any_value(typeof(y)) WHEN 'FLOAT[]' THEN 'array<float>' END FROM examples",
    "q_descriptors": "SELECT 'data' AS name, 32 AS rows, max(len(x))::INT AS width, 'array<float>' AS dtype FROM examples UNION ALL SELECT 'label', 32, max(len(y))::INT, 'array<float>' FROM examples",
    "q_param_shapes": "SELECT run_id, epoch, layer, count(DISTINCT unit) AS units, max(len(w))::INT AS width, max(activation) AS activation FROM params GROUP BY ALL",
    "q_slice": f"WITH {EX} SELECT row_id, len(x[151:160])::INT AS width, x[151:160][1]::DOUBLE AS first, round(CASE WHEN len(list_filter(x[151:160], lambda v: v IS NULL)) = 0 THEN coalesce(list_sum(x[151:160]::DOUBLE[]), CASE WHEN x IS NOT NULL THEN 0 END) END, 4) AS total FROM e",
    "q_cast_roundtrip": f"WITH {EX} SELECT row_id, CASE WHEN x IS NOT NULL THEN coalesce(list_sum(list_transform(list_filter(x, lambda v: v IS NOT NULL AND NOT isnan(v)), lambda v: trunc(v)::DOUBLE)), 0) END AS int_total, "
    "CASE WHEN y IS NOT NULL THEN len(list_filter(y, lambda v: v IS NOT NULL AND (isnan(v) OR trunc(v) <> v))) = 0 END AS y_kept FROM e",
    "q_argmax": f"WITH {PR} SELECT row_id, {argmax('y')} AS y_id, {argmax('output')} AS output_id FROM p",
    "q_class_id": f"WITH {EX} SELECT row_id, {class_id('y')} AS label FROM e",
    "q_one_hot": f"WITH {EX}, c AS (SELECT row_id, {class_id('y')} AS label FROM e) SELECT row_id, i::INT AS i, CASE WHEN i = label THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM c, range(10) r(i) WHERE label IS NOT NULL",
    "q_reshape": f"WITH {EX} SELECT row_id, r::INT AS r, round(list_sum(x[r * 28 + 1 : r * 28 + 28]::DOUBLE[]), 4) AS ink FROM e, range(28) a(r) WHERE {USABLE}",
    "q_plot_titles": f"WITH {PR}, {SC} SELECT row_id, 'num: ' || label || ',' || predicted AS title FROM s WHERE label IS NOT NULL ORDER BY {KEY.format(epoch=0)}, row_id LIMIT 8",
    "q_batches": f"WITH {EX}, {ordered(TRAIN, 1)} SELECT 1 AS epoch, (ord // 32)::INT AS batch_id, (ord % 32)::INT AS pos, row_id, is_pad FROM m",
    "q_pad_rows": f"WITH {EX}, {ordered(TRAIN.replace('train', 'test'), 2)} SELECT 2 AS epoch, (ord // 32)::INT AS batch_id, (ord % 32)::INT AS pos, row_id, is_pad FROM m WHERE is_pad",
    "q_batch_limit": f"WITH {PL} SELECT epoch, count(DISTINCT batch_id) AS n_batches, count(*) AS n_rows, count_if(is_pad)::BIGINT AS n_pads FROM b WHERE batch_id < 20 GROUP BY epoch",
    "q_first_batch": f"WITH {PL} SELECT epoch, pos, row_id FROM b WHERE batch_id = 0",
    "q_head_rows": f"WITH {PL} SELECT batch_id, pos, row_id FROM b WHERE batch_id * 32 + pos < 100",
    "q_stack": f"WITH {EX}, {PL} SELECT row_id, count(*) AS times FROM (SELECT row_id FROM e WHERE lower(trim(split)) = 'test' UNION ALL SELECT row_id FROM e WHERE lower(trim(split)) = 'valid' UNION ALL SELECT row_id FROM b) GROUP BY row_id",
    "q_dense_linear": dense("linear"),
    "q_dense_relu": dense("relu"),
    "q_dense_sigmoid": dense("sigmoid"),
    "q_forward2": f"WITH {EX} {forward2('min')} UNION ALL {forward2('max')}",
    "q_forward_columns": "SELECT vec_id, u::INT AS unit, round(greatest(list_inner_product(embedding::DOUBLE[], list_transform(range(64), lambda i: ((u * 31 + i * 17) % 101 - 50)::DOUBLE / 100.0::DOUBLE)) + u::DOUBLE / 10.0::DOUBLE, 0::DOUBLE), 6) AS z FROM embeddings, range(10) a(u)",
    "q_l2_loss": f"WITH {PR} SELECT row_id, round(CASE WHEN {complete('output', 10)} AND {complete('y', 10)} THEN 0.5::DOUBLE * list_sum(list_transform(list_zip(output, y::DOUBLE[]), lambda q: pow(q[1] - q[2], 2))) / 10 END, 6) AS loss FROM p",
    "q_softmax_ce": f"WITH {PR}, c AS (SELECT row_id, output AS o, CASE WHEN {complete('output', 10)} THEN {class_id('y')} END AS label FROM p) SELECT row_id, round(CASE WHEN label IS NOT NULL THEN {CE} END, 6) AS loss FROM c",
    "q_softmax": f"WITH {PR} SELECT row_id, i::INT AS i, round(exp(output[i + 1] - list_max(output)) / list_sum(list_transform(output, lambda v: exp(v - list_max(output)))), 6) AS p FROM p, range(10) a(i) WHERE {complete('output', 10)}",
    "q_batch_mean_loss": BL + " SELECT epoch, batch_id, n_rows, round(loss, 6) AS loss FROM bl",
    "q_epoch_loss": BL + " SELECT epoch, round(avg(loss), 6) AS avg_loss, count(*) AS num_batches FROM bl GROUP BY epoch",
    "q_accuracy": f"WITH {PR}, {SC} SELECT round(avg(CASE WHEN label IS NOT NULL THEN (predicted = label)::INT END), 6) AS acc FROM s",
    "q_top3": f"WITH {PR}, {SC} SELECT round(avg(in_top::INT), 6) AS top3 FROM s",
    "q_top_ids": f"WITH {PR}, r AS (SELECT row_id, i::INT AS class, (row_number() OVER (PARTITION BY row_id ORDER BY output[i + 1] DESC, i) - 1)::INT AS place FROM p, range(10) a(i) WHERE {complete('output', 10)}) SELECT row_id, place, class FROM r WHERE place < 3",
    "q_composite": f"WITH {EX}, {PR}, {SC} SELECT lower(trim(split)) AS split, count(label) AS n_rows, count_if(label IS NULL)::BIGINT AS n_skipped, round(avg((predicted = label)::INT), 6) AS acc, round(avg(in_top::INT), 6) AS top3 FROM s JOIN e USING (row_id) GROUP BY 1",
    "q_evaluate": f"WITH {EX}, {RUN0}, t AS (SELECT row_id, x::DOUBLE[] AS x FROM e WHERE {USABLE}), {FWD}, p AS (SELECT e.row_id, e.y, o.o AS output, lower(trim(split)) AS split FROM e LEFT JOIN o USING (row_id)), {SC} SELECT split, count(label) AS n_rows, count_if(label IS NULL)::BIGINT AS n_skipped, round(avg((predicted = label)::INT), 6) AS acc, round(avg(in_top::INT), 6) AS top3 FROM s JOIN (SELECT row_id, split FROM p) USING (row_id) GROUP BY split",
    "q_cumulative_metric": """WITH h AS (SELECT run_id, epoch, max(train_acc) AS ra, max(train_top3) AS rt, max(test_acc) AS ta, max(test_top3) AS tt FROM history GROUP BY ALL),
      v AS (SELECT run_id, epoch * 2 AS eval_seq, ta AS a, tt AS t FROM h UNION ALL SELECT run_id, epoch * 2 + 1, ra, rt FROM h),
      w AS (SELECT run_id, eval_seq, round(a * 1000) AS a, round(t * 1000) AS t FROM v WHERE a IS NOT NULL AND NOT isnan(a) AND t IS NOT NULL AND NOT isnan(t))
      SELECT run_id, eval_seq, round(sum(a) OVER q / (1000 * count(*) OVER q), 6) AS run_acc, round(sum(t) OVER q / (1000 * count(*) OVER q), 6) AS run_top3 FROM w WINDOW q AS (PARTITION BY run_id ORDER BY eval_seq ROWS UNBOUNDED PRECEDING)""",
    "q_running_accuracy": f"WITH {PR}, {SC} SELECT count(label) AS n_rows, round(avg(CASE WHEN label IS NOT NULL THEN (predicted = label)::INT END), 6) AS acc, round(avg(in_top::INT), 6) AS top3 FROM s",
    "q_correct": f"WITH {PR}, {SC} SELECT row_id, label, predicted FROM s WHERE predicted = label",
    "q_incorrect": f"WITH {PR}, {SC} SELECT row_id, label, predicted FROM s WHERE predicted <> label",
    "q_accuracy_pct": f"WITH {PR}, {SC}, r AS (SELECT *, row_number() OVER (ORDER BY {KEY.format(epoch=0)}, row_id) AS rn FROM s) SELECT count(label) AS n_rows, count_if(predicted = label)::BIGINT AS n_correct, round(100.0::DOUBLE * count_if(predicted = label) / count(label), 6) AS pct FROM r WHERE rn <= 1000",
    "q_history_lines": f"WITH {HISTORY} SELECT run_id, epoch, {EPOCH_LINE} AS line FROM h",
    "q_history_report": f"WITH {HISTORY} SELECT run_id, epoch, 0 AS line_no, {EPOCH_LINE} AS line FROM h"
    f" UNION ALL SELECT run_id, epoch, 1, 'Train_acc ' || {fixed('ra', 5)} || ', Train_top_3_accuracy ' || {fixed('rt', 5)} FROM h"
    f" UNION ALL SELECT run_id, epoch, 2, 'Test_acc ' || {fixed('ta', 5)} || ', Test_top_3_accuracy ' || {fixed('tt', 5)} FROM h",
    "q_sample_with_replacement": f"WITH {EX}, r AS (SELECT row_id, row_number() OVER (ORDER BY {KEY.format(epoch=7)}, row_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT row_id FROM e)), "
    f"d AS (SELECT draw::INT AS draw, {UNIFORM.format(seed=7)} AS u FROM range(8) a(draw)) SELECT draw, row_id FROM d JOIN r ON r.rn = least(floor(u * n)::BIGINT, n - 1) + 1",
    "q_sample_losses": "WITH k AS (SELECT DISTINCT run_id || '#' || epoch AS k, run_id, epoch, avg_loss FROM history WHERE avg_loss IS NOT NULL AND NOT isnan(avg_loss)) SELECT run_id, epoch, avg_loss FROM k ORDER BY md5('3#' || k), k LIMIT 10",
    "q_loss_dispatch": f"WITH {PR}, c AS (SELECT row_id, y, output AS o, CASE WHEN {complete('output', 10)} THEN {class_id('y')} END AS label FROM p) SELECT row_id, 'softmax_ce' AS kind, round(CASE WHEN label IS NOT NULL THEN {CE} END, 6) AS loss FROM c"
    f" UNION ALL SELECT row_id, 'l2', round(CASE WHEN {complete('o', 10)} AND {complete('y', 10)} THEN 0.5::DOUBLE * list_sum(list_transform(list_zip(o, y::DOUBLE[]), lambda q: pow(q[1] - q[2], 2))) / 10 END, 6) FROM c",
    "q_label_vectors": f"WITH {PR} SELECT row_id, 1 AS width, {class_id('y')} AS label FROM p",
    "q_initial_params": " UNION ALL ".join(f"SELECT '{n}' AS run_id, {k} AS layer, {u}::BIGINT AS units, {w}::INT AS width, true AS within, true AS spread, 0.0::DOUBLE AS bias" for n, k, u, w in XAVIER),
    "q_evaluate_padded": f"WITH {EX}, {RUN0}, {ordered(TRAIN.replace('train', 'test'), 0)}, t AS (SELECT row_id, x::DOUBLE[] AS x FROM e WHERE {USABLE}), {FWD}, p AS (SELECT e.row_id, e.y, o.o AS output FROM e LEFT JOIN o USING (row_id)), {SC} "
    "SELECT count(label) AS n_rows, count_if(label IS NULL)::BIGINT AS n_skipped, round(avg((predicted = label)::INT), 6) AS acc, round(avg(in_top::INT), 6) AS top3 FROM m JOIN s USING (row_id)",
    "q_train_linear": LINEAR + " SELECT ep::INT AS epoch, batch_id::INT AS batch_id, n::INT AS n, round(loss, 6) AS loss FROM bl",
    "q_train_linear_history": LINEAR + f""", last AS (SELECT ep, max(step) AS step FROM s GROUP BY ep), v AS (SELECT last.ep, list(w ORDER BY u) AS ws, list(b ORDER BY u) AS bs FROM last JOIN w USING (step) GROUP BY last.ep),
      a AS (SELECT row_id, lower(trim(split)) AS split, {class_id('y')} AS label, list_transform(range(28), lambda r: list_sum(x[r * 28 + 1 : r * 28 + 28]::DOUBLE[]) / 7140.0::DOUBLE) AS f FROM e WHERE {USABLE}),
      z AS (SELECT ep, split, label, list_transform(range(10), lambda u: list_inner_product(ws[u + 1], f) + bs[u + 1]) AS z FROM a, v WHERE label IS NOT NULL AND split IN ('test', 'train')),
      k AS (SELECT ep, split, len(list_filter(range(10), lambda i: z[i + 1] > z[label + 1] OR (z[i + 1] = z[label + 1] AND i < label))) AS before FROM z),
      q AS (SELECT ep, split, avg((before < 1)::INT) AS acc, avg((before < 3)::INT) AS top3 FROM k GROUP BY ALL)
      SELECT h.ep::INT AS epoch, h.n::INT AS num_batches, round(h.l, 6) AS avg_loss, round(r.acc, 6) AS train_acc, round(r.top3, 6) AS train_top3, round(t.acc, 6) AS test_acc, round(t.top3, 6) AS test_top3
      FROM (SELECT ep, count(*) AS n, avg(loss) AS l FROM bl GROUP BY ep) h JOIN q r ON r.ep = h.ep AND r.split = 'train' JOIN q t ON t.ep = h.ep AND t.split = 'test'""",
    "q_epoch_times": "SELECT run_id, round(sum(s), 5) AS seconds, count(*) AS epochs, max(n) AS num_batches FROM (SELECT run_id, epoch, max(seconds) AS s, max(num_batches) AS n FROM history GROUP BY ALL) GROUP BY run_id",
    "q_grad_l2": grad(DELTA_L2, False) + " SELECT layer, unit, i, n, round(db, 4) AS db, round(dw, 4) AS dw FROM g",
    "q_grad_ce": grad(DELTA_CE, True) + " SELECT layer, unit, i, n, round(db, 4) AS db, round(dw, 4) AS dw FROM g",
    "q_sgd_step": grad(DELTA_CE, True)
    + " SELECT pa.layer, pa.unit, round(any_value(pa.b) - 0.01::DOUBLE / any_value(g.n) * any_value(g.db), 6) AS b, round(sum(pa.w[g.i + 1] - 0.01::DOUBLE / g.n * g.dw), 6) AS w_total FROM pa JOIN g ON g.layer = pa.layer AND g.unit = pa.unit GROUP BY pa.layer, pa.unit",
}
