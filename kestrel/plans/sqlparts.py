"""Shared DuckDB CTEs of the oracle SQL (the stand-in fixtures, in SQL)."""

# class scores: embedding[1..10], truth = label, prediction = first arg-max
CLS = """cls AS (
  SELECT vec_id, t, s, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS p
  FROM (SELECT vec_id, label AS t, CAST(embedding[1:10] AS DOUBLE[]) AS s FROM embeddings))"""

CLS_COUNTS = CLS + """,
cnt AS (SELECT t, p, count(*) AS n FROM cls GROUP BY t, p)"""

# aspects: scores embedding[4i+1..4i+4], truth (label+i) % 4; label: embedding[17..19], label % 3
ASP = """asp AS (
  SELECT vec_id,
    [CAST(label % 4 AS INTEGER), CAST((label + 1) % 4 AS INTEGER),
     CAST((label + 2) % 4 AS INTEGER), CAST((label + 3) % 4 AS INTEGER)] AS t_aspects,
    [CAST(list_position(e[1:4], list_max(e[1:4])) - 1 AS INTEGER),
     CAST(list_position(e[5:8], list_max(e[5:8])) - 1 AS INTEGER),
     CAST(list_position(e[9:12], list_max(e[9:12])) - 1 AS INTEGER),
     CAST(list_position(e[13:16], list_max(e[13:16])) - 1 AS INTEGER)] AS p_aspects,
    CAST(label % 3 AS INTEGER) AS t_label,
    CAST(list_position(e[17:19], list_max(e[17:19])) - 1 AS INTEGER) AS p_label,
    e[1:16] AS aspect_scores, e[17:19] AS label_scores
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
asp_long AS (
  SELECT vec_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS aspect, unnest(t_aspects) AS t, unnest(p_aspects) AS p
  FROM asp)"""

# evaluation registry: one record per day of events
REG = """reg AS (
  SELECT CAST(date_diff('day', min(d) OVER (), d) + 1 AS INTEGER) AS version, 'cls' AS task,
         acc, avg_f1, CAST(date_diff('day', min(d) OVER (), d) + 1 AS BIGINT) AS key
  FROM (SELECT CAST(ts AS DATE) AS d,
               ((2 * sum(CAST(round(value * 100) AS BIGINT)) * 10000 + count(*)) // (2 * count(*))) / 1000000.0
                 AS avg_f1,
               ((2 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 1000000 + count(*))
                 // (2 * count(*))) / 1000000.0 AS acc
        FROM events GROUP BY CAST(ts AS DATE))),
art AS (SELECT task, version FROM reg WHERE version % 7 <> 0)"""

# postings: documents left join labels
POST = """post AS (
  SELECT d.doc_id AS recruitment_id, d.lang AS title, d.text AS body, d.source AS company_name,
         d.n_chars AS vacancy,
         CAST(CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 2
                   WHEN l.quality = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
post2 AS (SELECT *, CASE WHEN label IS NOT NULL THEN 'label ' || CAST(label AS VARCHAR) END AS explanation
          FROM post)"""

# posting details from part
DETAIL = """det AS (
  SELECT p_partkey AS id,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 89 END AS user_id,
    p_name AS title,
    CASE p_partkey % 4 WHEN 0 THEN 'Thỏa thuận'
      WHEN 1 THEN CAST(p_size AS VARCHAR) || '.000.000 - ' || CAST(p_size + 5 AS VARCHAR) || '.000.000 VNĐ'
      WHEN 2 THEN 'Từ ' || CAST(p_size AS VARCHAR) || '.000.000'
      ELSE 'Đến ' || CAST(p_size + 5 AS VARCHAR) || '.000.000' END AS price_display,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey * 7919 + 100000000 AS VARCHAR) || '.0' END AS phone,
    p_brand, p_type, p_size, p_name
  FROM part)"""

# request / response pairs from events
REQRESP = """req AS (SELECT event_id AS correlation_id, ts AS sent_at, event_type AS config FROM events),
resp AS (SELECT event_id AS correlation_id,
                ts + to_microseconds(CAST(round(value * 1000) AS BIGINT) * 1000) AS answered_at
         FROM events WHERE event_id % 10 <> 0)"""

# text pairs from conversations: reference tokens and candidate without every 7th
PAIRS = """pairs AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS pair_id, ref,
         list_filter(ref, lambda x, i: i % 7 <> 0) AS cand
  FROM (SELECT conv_id, turn,
               list_filter(regexp_split_to_array(text, '""" + r"""[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+""" + """'), lambda x: x <> '') AS ref
        FROM conversations))"""

# ordered stream: orders numbered by key
ORD = """ord AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn,
                 count(*) OVER () AS total FROM orders)"""


def softmax(w: str, b: str) -> str:
    """Expression of the class probabilities of row ``r`` under head ``h``."""
    z = f"list_transform({w}[h], lambda wc, c: list_inner_product(wc, r.x) + {b}[h][c])"
    return f"list_transform(list_transform([{z}], lambda s: list_transform(s, lambda v: exp(v - list_max(s)))), lambda s: list_transform(s, lambda v: v / list_sum(s)))[1]"


def softmax_step(rows: str, w: str, b: str, lr: float, heads: int, classes: int) -> tuple[str, str]:
    """Expressions of the weights and biases after one full-batch step on a list of ``{x, ys}`` rows.

    ``w`` is a list (heads) of lists (classes) of vectors, ``b`` one of lists.
    """
    e = softmax(w, b)
    off = f"list_transform({rows}, lambda r: list_transform({e}, lambda p, c: p - CASE WHEN r.ys[h] = c - 1 THEN 1.0 ELSE 0.0 END))"
    # the rows' errors per head, then a sum per class and dimension
    new_w = (f"list_transform(range(1, {heads + 1}), lambda h: list_transform([{off}], lambda o: list_transform({w}[h], lambda wc, c: list_transform(wc, lambda v, j: "
             f"v - {lr} * list_sum(list_transform({rows}, lambda r, i: o[i][c] * r.x[j])) / len({rows}))))[1])")
    new_b = (f"list_transform(range(1, {heads + 1}), lambda h: list_transform([{off}], lambda o: list_transform({b}[h], lambda v, c: "
             f"v - {lr} * list_sum(list_transform(o, lambda p: p[c])) / len({rows})))[1])")
    return new_w, new_b


def head_metrics(dev: str, w: str, b: str, heads: int, classes: int) -> str:
    """Expression of ``{acc, pre, rec, f1}``: macro metrics on a list of ``{x, ys}`` rows, averaged over the heads."""
    s = f"list_transform({w}[h], lambda wc, c: list_inner_product(wc, r.x) + {b}[h][c])"
    preds = f"list_transform({dev}, lambda r: list_transform([{s}], lambda s: list_position(s, list_max(s)) - 1)[1])"
    pairs = f"list_transform(list_zip({dev}, {preds}), lambda q: {{'t': q[1].ys[h], 'p': q[2]}})"
    per = (f"list_filter(list_transform(range(0, {classes}), lambda c: {{'tp': len(list_filter(q, lambda x: x.t = c AND x.p = c)), "
           "'s': len(list_filter(q, lambda x: x.t = c)), 'p': len(list_filter(q, lambda x: x.p = c))}), lambda m: m.s + m.p > 0)")
    one = (f"list_transform(list_transform([{pairs}], lambda q: {per}), lambda ms: {{'acc': list_sum(list_transform(ms, lambda m: m.tp)) / list_sum(list_transform(ms, lambda m: m.s)), "
           "'pre': list_avg(list_transform(ms, lambda m: CASE WHEN m.p > 0 THEN m.tp / m.p ELSE 0 END)), "
           "'rec': list_avg(list_transform(ms, lambda m: CASE WHEN m.s > 0 THEN m.tp / m.s ELSE 0 END)), "
           "'f1': list_avg(list_transform(ms, lambda m: 2.0 * m.tp / (m.s + m.p)))})[1]")
    each = f"list_transform(range(1, {heads + 1}), lambda h: {one})"
    mean = ", ".join(f"'{k}': list_avg(list_transform(a, lambda x: x.{k}))" for k in ("acc", "pre", "rec", "f1"))
    return f"list_transform([{each}], lambda a: {{{mean}}})[1]"


def vector_rows(heads: int) -> str:
    """CTE ``vr``: id, vector, codes per head, and a code for each (the label, or the four aspects)."""
    ys = "[CAST(label AS INTEGER)]" if heads == 1 else "[CAST((label + i) % 4 AS INTEGER) FOR i IN [0, 1, 2, 3]]"
    return f"vr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, {ys} AS ys FROM embeddings)"


def centroids(heads: int, classes: int) -> str:
    """CTEs up to ``start(w, b)``: the class centroids of every head (needs ``vr``)."""
    return f"""lab AS (SELECT x, unnest(range(1, {heads + 1})) AS h, unnest(ys) AS c FROM vr),
dims AS (SELECT h, c, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM lab),
means AS (SELECT h, c, list(m ORDER BY j) AS m FROM (SELECT h, c, j, avg(v) AS m FROM dims GROUP BY ALL) GROUP BY h, c),
start AS (SELECT list(m ORDER BY h) AS w, [[0.0::DOUBLE FOR i IN range({classes})] FOR h IN range({heads})] AS b
          FROM (SELECT h, list(m ORDER BY c) AS m FROM means GROUP BY h))"""


def online_sql(task: str, strategy: str, n: int, m: int, lr: float, heads: int, classes: int) -> str:
    """The evaluation records of an online run over ``embeddings``, trigger by trigger."""
    base = "" if strategy == "continue" else "best_"
    first = f"CASE WHEN t % {m} = 0 THEN t - {m} + 1 ELSE t END" if strategy == "replay" else "t"
    kind = f"CASE WHEN t % {m} = 0 THEN 'replay' ELSE 'own' END" if strategy == "replay" else "'own'"
    new_w, new_b = softmax_step("rs", "w0", "b0", lr, heads, classes)
    better = "f.f1 > best_f1"
    return f"""WITH RECURSIVE {vector_rows(heads)}, {centroids(heads, classes)},
num AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // {n} + 1 AS bt, count(*) OVER () // {n} AS full_ones FROM vr),
bat AS (SELECT bt, list({{'x': x, 'ys': ys}}) AS rs FROM num WHERE bt <= full_ones GROUP BY bt),
trig AS (SELECT t, flatten(list(bat.rs ORDER BY bt)) AS rs FROM (SELECT bt AS t FROM bat) a JOIN bat ON bat.bt BETWEEN {first} AND a.t GROUP BY t),
dev AS (SELECT list({{'x': x, 'ys': ys}}) AS d FROM vr),
run AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS n_rows, NULL::BIGINT AS base, w, b, f, w AS best_w, b AS best_b, f.f1 AS best_f1, 0::BIGINT AS best_t
  FROM (SELECT w, b, {head_metrics('d', 'w', 'b', heads, classes)} AS f FROM start, dev)
  UNION ALL
  SELECT t, n_rows, base, w, b, f, CASE WHEN {better} THEN w ELSE best_w END, CASE WHEN {better} THEN b ELSE best_b END, greatest(best_f1, f.f1), CASE WHEN {better} THEN t ELSE best_t END
  FROM (SELECT *, {head_metrics('d', 'w', 'b', heads, classes)} AS f FROM (
    SELECT trig.t, len(rs) AS n_rows, w0, base, {new_w} AS w, {new_b} AS b, best_w, best_b, best_f1, best_t, d FROM (
      SELECT t + 1 AS nt, {base}w AS w0, {base}b AS b0, {'t' if strategy == 'continue' else 'best_t'} AS base, best_w, best_b, best_f1, best_t FROM run) r
    JOIN trig ON trig.t = r.nt, dev)))
SELECT CAST(t + 1 AS INTEGER) AS version, '{task}' AS task, 'given vectors' AS pretrained, 'linear' AS classifier, 'dev' AS split, t AS trigger_id,
  CASE WHEN t = 0 THEN 'start' ELSE {kind} END AS kind, n_rows AS rows, CAST(base + 1 AS INTEGER) AS start_version,
  round(f.acc, 6) AS acc, round(f.pre, 6) AS avg_pre, round(f.rec, 6) AS avg_recall, round(f.f1, 6) AS avg_f1,
  'task={task}/version=' || (t + 1) AS artefact FROM run"""


def history_sql(heads: int, classes: int, epochs: int, lr: float) -> str:
    """Loss and accuracy of every epoch of gradient descent from zero weights over ``embeddings``."""
    new_w, new_b = softmax_step("rs", "w", "b", lr, heads, classes)
    p = softmax("w", "b")
    stats = (f"list_transform(range(1, {heads + 1}), lambda h: list_transform([list_transform(rs, lambda r: {{'p': {p}, 'y': r.ys[h]}})], lambda q: "
             "{'loss': list_avg(list_transform(q, lambda x: -ln(greatest(x.p[x.y + 1], 1e-300)))), "
             "'acc': list_avg(list_transform(q, lambda x: CASE WHEN list_position(x.p, list_max(x.p)) = x.y + 1 THEN 1.0 ELSE 0.0 END))})[1])")
    return f"""WITH RECURSIVE {vector_rows(heads)}, rows_ AS (SELECT list({{'x': x, 'ys': ys}}) AS rs, max(len(x)) AS d FROM vr),
run AS (
  SELECT 1 AS epoch, [[[0.0::DOUBLE FOR j IN range(d)] FOR c IN range({classes})] FOR h IN range({heads})] AS w,
         [[0.0::DOUBLE FOR c IN range({classes})] FOR h IN range({heads})] AS b FROM rows_
  UNION ALL SELECT epoch + 1, {new_w}, {new_b} FROM run, rows_ WHERE epoch < {epochs}),
st AS (SELECT epoch, unnest(range(0, {heads})) AS head, unnest({stats}) AS s, len(rs) AS n FROM run, rows_)
SELECT epoch, CAST(head AS INTEGER) AS head, round(s.loss, 6) AS loss, round(s.acc, 6) AS acc, CAST(n AS BIGINT) AS n FROM st"""


#: predictions of the centroid heads of both tasks: ``scored`` with p_label and p_aspects
STORED = """lv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
hd AS (SELECT x, unnest([0, 1, 2, 3, 4]) AS h, unnest([label % 3, label % 4, (label + 1) % 4, (label + 2) % 4, (label + 3) % 4]) AS c FROM lv),
hm AS (SELECT h, c, list(m ORDER BY j) AS m FROM (
         SELECT h, c, j, avg(v) AS m FROM (SELECT h, c, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM hd) GROUP BY ALL) GROUP BY h, c),
hw AS (SELECT h, list(m ORDER BY c) AS ms FROM hm GROUP BY h),
hp AS (SELECT vec_id, h, list_transform(ms, lambda m: list_inner_product(m, x)) AS s FROM lv, hw),
scored AS (SELECT vec_id, max(p) FILTER (h = 0) AS p_label, list(p ORDER BY h) FILTER (h > 0) AS p_aspects FROM (
             SELECT vec_id, h, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS p FROM hp) GROUP BY vec_id)"""
