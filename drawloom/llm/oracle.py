"""SQL for an independent engine, where it can say what a query of this subpackage finds; brute force over all pairs."""

from __future__ import annotations

USABLE = "len(x) = 784 AND len(list_filter(x, lambda v: v IS NULL OR isnan(v))) = 0 AND list_max(x) > list_min(x)"
DRAWINGS = f"""u AS (SELECT row_id, any_value(lower(trim(split)) = 'train') AS train, any_value(x)::DOUBLE[] AS x FROM examples WHERE x IS NOT NULL AND {USABLE} GROUP BY row_id),
n AS (SELECT *, sqrt(list_inner_product(x, x)) AS len FROM u)"""
LABEL = """CASE WHEN y IS NOT NULL AND len(y) = 10 AND len(list_filter(y, lambda v: v IS NULL OR isnan(v))) = 0
  AND len(list_filter(y, lambda v: v = list_max(y))) = 1 THEN list_position(y, list_max(y)) - 1 END"""

#: (eval_id, train_id) of pairs that are one drawing at some displacement of at most one pixel.
SAME = f"""{DRAWINGS}, d AS (SELECT a.down, b.right_ FROM (VALUES (-1), (0), (1)) a(down), (VALUES (-1), (0), (1)) b(right_)),
  m AS (SELECT row_id, len, list_transform(range(784), lambda i: CASE WHEN i // 28 - down BETWEEN 0 AND 27 AND i % 28 - right_ BETWEEN 0 AND 27
    THEN x[i - down * 28 - right_ + 1] ELSE 0 END) AS x FROM n, d WHERE NOT train),
  same AS (SELECT DISTINCT m.row_id AS eval_id, n.row_id AS train_id FROM m, n
    WHERE n.train AND list_inner_product(m.x::DOUBLE[], n.x) / (m.len * n.len) > 0.96)"""
#: Smallest row_id within so many steps; chains of the small tables, on which SQL is run, are shorter.
ROUNDS = "l0 AS (SELECT row_id, row_id AS low FROM t), " + ", ".join(
    f"l{k} AS MATERIALIZED (SELECT e.a AS row_id, min(l{k - 1}.low) AS low FROM e JOIN l{k - 1} ON l{k - 1}.row_id = e.b GROUP BY e.a)" for k in range(1, 9)
)

ORACLE = {
    "p1_found": f"WITH {SAME} SELECT least(eval_id, train_id) AS row_a, greatest(eval_id, train_id) AS row_b FROM same",
    "p1_report": f"""WITH {SAME}, e AS (SELECT row_id, arg_max(lower(trim(split)), loaded_at) AS split, coalesce(arg_max(coalesce(lower(trim(source)), ''), loaded_at), '') AS source FROM examples GROUP BY row_id)
      SELECT split, source, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_eval, count(DISTINCT train_id) AS n_train FROM same JOIN e ON e.row_id = eval_id GROUP BY split, source""",
    "p3_found": f"""WITH e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM examples) WHERE rn = 1),
      c AS (SELECT label, count(*) AS n FROM (SELECT {LABEL} AS label FROM e WHERE lower(trim(split)) = 'train') WHERE label IS NOT NULL GROUP BY label)
      SELECT t.plan_id, t.label FROM class_targets t LEFT JOIN c ON c.label = t.label
      WHERE coalesce(c.n, 0) < greatest(t.min_rows::DOUBLE, round(t.target_share * t.sample_rows, 6))""",
    "p3_report": f"""WITH e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) AS rn FROM examples) WHERE rn = 1),
      c AS (SELECT label, count(*) AS n FROM (SELECT {LABEL} AS label FROM e WHERE lower(trim(split)) = 'train') WHERE label IS NOT NULL GROUP BY label)
      SELECT t.plan_id, t.label, t.sample_rows, t.target_share, t.min_rows, greatest(t.min_rows::DOUBLE, round(t.target_share * t.sample_rows, 6)) AS needed, coalesce(c.n, 0) AS available,
      coalesce(c.n, 0) >= greatest(t.min_rows::DOUBLE, round(t.target_share * t.sample_rows, 6)) AS met FROM class_targets t LEFT JOIN c ON c.label = t.label""",
    "p5_sizes": f"""WITH {DRAWINGS}, t AS (SELECT * FROM n WHERE train),
      e AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM t a JOIN t b ON list_inner_product(a.x, b.x) / (a.len * b.len) >= 0.71 OR a.row_id = b.row_id),
      {ROUNDS} SELECT low AS cluster_row, count(*) AS size FROM l8 GROUP BY low""",
    "p4_found": f"""WITH {DRAWINGS}, s AS (SELECT a.row_id AS a, b.row_id AS b, round(list_inner_product(a.x, b.x) / (a.len * b.len), 6) AS c FROM n a JOIN n b ON a.row_id <> b.row_id),
      r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM s WHERE c >= 0.71)
      SELECT DISTINCT least(a, b) AS row_a, greatest(a, b) AS row_b FROM r WHERE place <= 5""",
    "p5_found": f"""WITH {DRAWINGS}, t AS (SELECT * FROM n WHERE train),
      e AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM t a JOIN t b ON list_inner_product(a.x, b.x) / (a.len * b.len) >= 0.71 OR a.row_id = b.row_id),
      {ROUNDS} SELECT row_id, low AS cluster_row FROM l8""",
}
