"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code from the operator definitions:
plain SQL over the pre-registered views, list lambdas for vector math,
``lgamma`` for the expected mutual information, and brute-force forms
(full hypergeometric range, pairwise comparisons) where Spark uses a
scalable rewrite. Doubles are rounded to 6 places like the Spark side.
"""

from __future__ import annotations

EPS64 = "2.220446049250313e-16"
HASH_DIM = 64
RUNS = 5
SPLIT = r"'[^\p{L}\p{N}]+'"
WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP = f"'^{WS}+|{WS}+$'"
PROMPT_PRE = "Summarize the following sentences: "
PROMPT_POST = ". If you come across some abbreviations, expand them. Please respond in English."


# ------------------------------------------------------------ expression helpers

def sq(a):
    return f"list_sum(list_transform({a}, lambda q_: q_ * q_))"


def dot(a, b):
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i_: {a}[i_] * {b}[i_]))"


def sqd(a, b):
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i_: ({a}[i_] - {b}[i_]) * ({a}[i_] - {b}[i_])))")


def scale(a, f):
    return f"list_transform({a}, lambda q_: q_ * ({f}))"


def artanh(x):
    cl = f"least(greatest({x}, -1.0 + 1e-7), 1.0 - 1e-7)"
    return f"(0.5 * ln((1.0 + {cl}) / (1.0 - {cl})))"


def tail(a):
    return f"list_slice({a}, 2, len({a}))"


def mdot(x, y):
    return f"(-({x}[1] * {y}[1]) + {dot(tail(x), tail(y))})"


def bucket(tok, mod):
    return f"((('0x' || substr(md5({tok}), 1, 8))::BIGINT) % {mod})"


def explode(table, ids, arr):
    return (f"SELECT {ids}, unnest(range(len({arr}))) AS pos, round(unnest({arr}), 6) AS x "
            f"FROM {table}")


def exp0(v):
    n = f"greatest(sqrt({sq(v)}), 1e-5)"
    return scale(v, f"tanh({n}) / {n}")


def acosh_dist(x, y, xx, yy):
    return (f"acosh(greatest(1.0 + 2.0 * {sqd(x, y)} / ((1.0 - {xx}) * (1.0 - {yy}) + 1e-10), "
            f"1.0 + 1e-10))")


# ------------------------------------------------------------ shared CTEs

MSGS = """msgs AS (
  SELECT e.event_id AS msg_id, d.text, CAST(e.ts AS TIMESTAMP) AS created_at,
         e.event_type AS event, d.doc_id
  FROM events e JOIN documents d ON e.event_id % (SELECT count(*) FROM documents) = d.doc_id
  WHERE d.text IS NOT NULL AND e.ts IS NOT NULL AND e.event_type IS NOT NULL)"""

BLOCKS = MSGS + """,
t0 AS (SELECT min(created_at) AS t0 FROM msgs),
flag AS (SELECT m.*, m.created_at < t0.t0 + INTERVAL 7 DAY AS is_offline
         FROM msgs m, t0),
dates AS (SELECT d, CAST(dense_rank() OVER (ORDER BY d) AS BIGINT) AS bid
          FROM (SELECT DISTINCT CAST(created_at AS DATE) AS d FROM flag WHERE NOT is_offline) q),
blocks AS (SELECT f.*, CAST(COALESCE(dates.bid, 0) AS BIGINT) AS block_id,
                  'M' || CAST(COALESCE(dates.bid, 0) AS VARCHAR) AS block_name
           FROM flag f LEFT JOIN dates ON NOT f.is_offline AND CAST(f.created_at AS DATE) = dates.d)"""

POS = """pos AS (SELECT b.*, row_number() OVER (PARTITION BY block_id ORDER BY created_at, msg_id) - 1 AS i,
               count(*) OVER (PARTITION BY block_id) AS n FROM blocks b)"""


def split_sql(cuts, names):
    parts = []
    for c, nm in zip(cuts, names):
        parts.append(f"WHEN i < trunc(n * ({c})) THEN '{nm}'")
    return f"CASE {' '.join(parts)} ELSE '{names[-1]}' END"


CUT_CFG = ("0.7::DOUBLE", "(0.7::DOUBLE + 0.1::DOUBLE)")
CUT_7 = ("0.7::DOUBLE", "0.9::DOUBLE")
CUT_8 = ("0.8::DOUBLE",)

PROMPT = f"('{PROMPT_PRE}' || text || '{PROMPT_POST}')"


def mock(p):
    body = f"regexp_replace(split_part(string_split({p}, 'sentences:')[-1], '.', 1), {STRIP}, '', 'g')"
    return f"CASE WHEN contains(lower({p}), 'sentences:') THEN '[Summarized] ' || {body} ELSE {p} END"


TOKS = f"regexp_split_to_array(lower(text), {SPLIT})"

HASHED = f"""dtok AS (SELECT doc_id, unnest({TOKS}) AS tok FROM documents),
hb AS (SELECT doc_id, {bucket('tok', HASH_DIM)} AS b FROM dtok WHERE length(tok) > 0),
hc AS (SELECT doc_id, b, count(*)::DOUBLE AS c FROM hb GROUP BY ALL),
hn AS (SELECT doc_id, sqrt(sum(c * c)) AS nr FROM hc GROUP BY ALL),
hgrid AS (SELECT doc_id, r.range AS pos FROM documents, range({HASH_DIM}) r),
hx AS (SELECT g.doc_id, g.pos, COALESCE(hc.c / hn.nr, 0.0) AS x
       FROM hgrid g LEFT JOIN hc ON g.doc_id = hc.doc_id AND g.pos = hc.b
       LEFT JOIN hn ON g.doc_id = hn.doc_id),
dvec AS (SELECT doc_id, array_agg(x ORDER BY pos) AS tv FROM hx GROUP BY doc_id)"""

TIME_D = ("CAST(CAST(floor(epoch_us(created_at)::DOUBLE / 86400000000.0::DOUBLE) AS DOUBLE)"
          " / 100000.0::DOUBLE AS FLOAT)::DOUBLE")
TIME_S = ("CAST((hour(created_at) * 3600 + minute(created_at) * 60 + second(created_at))::DOUBLE"
          " / 86400.0::DOUBLE AS FLOAT)::DOUBLE")

EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS = EMB + ", pr AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"

LABEL_MEANS = EMB + """,
lex AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM e),
lm AS (SELECT label AS cluster, array_agg(mx ORDER BY pos) AS center
       FROM (SELECT label, pos, avg(x) AS mx FROM lex GROUP BY ALL) q GROUP BY label)"""

NEAREST = LABEL_MEANS + f""",
dd AS (SELECT e.vec_id, e.label, lm.cluster, {sqd('e.v', 'lm.center')} AS d FROM e, lm),
nearest AS (SELECT vec_id, label, CAST(cluster AS BIGINT) AS pred, d FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM dd) q
  WHERE rn = 1)"""

POINCARE_MEANS = EMB + f""",
pe AS (SELECT vec_id, label, {exp0('v')} AS p FROM e),
pex AS (SELECT label, unnest(range(len(p))) AS pos, unnest(p) AS x FROM pe),
pm0 AS (SELECT label, pos, avg(x) AS mx FROM pex GROUP BY ALL),
pmn AS (SELECT label, sqrt(sum(mx * mx)) AS nr FROM pm0 GROUP BY label),
pm AS (SELECT pm0.label AS cluster, pos,
              CASE WHEN nr > 1.0 - 1e-5 THEN mx * ((1.0 - 1e-5) / nr) ELSE mx END AS x
       FROM pm0 JOIN pmn USING (label)),
pmc AS (SELECT cluster, array_agg(x ORDER BY pos) AS center FROM pm GROUP BY cluster)"""


def scores_sql(pairs_cte: str, group: str | None, select: str, average: str = "arithmetic"):
    """All scores from ``pairs(g, y_true, y_pred)``; ``select`` picks columns."""
    g = group or "1"
    avg = {"arithmetic": "(h_true + h_pred) / 2.0", "geometric": "sqrt(h_true * h_pred)",
           "min": "least(h_true, h_pred)", "max": "greatest(h_true, h_pred)"}[average]
    return f"""{pairs_cte},
sp AS (SELECT {g} AS g, y_true, y_pred FROM pairs),
cont AS (SELECT g, y_true, y_pred, count(*)::DOUBLE AS n FROM sp GROUP BY ALL),
ma AS (SELECT g, y_true, sum(n) AS a FROM cont GROUP BY ALL),
mb AS (SELECT g, y_pred, sum(n) AS b FROM cont GROUP BY ALL),
ta AS (SELECT g, sum(a) AS "N", count(*) AS "R", sum(a * ln(a)) AS sal, sum(a * a) AS sa2
       FROM ma GROUP BY ALL),
tb AS (SELECT g, count(*) AS "C", sum(b * ln(b)) AS sbl, sum(b * b) AS sb2 FROM mb GROUP BY ALL),
terms AS (SELECT cont.g, cont.n,
            (cont.n / ta."N") * (ln(cont.n) - ln(ta."N"))
            + (cont.n / ta."N") * (-ln(ma.a * mb.b) + ln(ta."N") + ln(ta."N")) AS t
          FROM cont JOIN ma USING (g, y_true) JOIN mb USING (g, y_pred) JOIN ta USING (g)),
mi0 AS (SELECT g, sum(CASE WHEN abs(t) < {EPS64} THEN 0.0 ELSE t END) AS mi_raw,
               sum(n * n) AS sn2 FROM terms GROUP BY g),
sza AS (SELECT g, a, count(*) AS m_a FROM ma GROUP BY ALL),
szb AS (SELECT g, b, count(*) AS m_b FROM mb GROUP BY ALL),
emi_pairs AS (SELECT sza.g, a, m_a, b, m_b, ta."N" AS nn,
                unnest(range(CAST(greatest(1, a + b - ta."N") AS BIGINT),
                             CAST(least(a, b) AS BIGINT) + 1)) AS nij
              FROM sza JOIN szb USING (g) JOIN ta USING (g)),
emi AS (SELECT g, sum(m_a * m_b * (nij / nn) * (ln(nn * nij) - ln(a) - ln(b)) * exp(
          lgamma(a + 1) + lgamma(b + 1) + lgamma(nn - a + 1) + lgamma(nn - b + 1) - lgamma(nn + 1)
          - lgamma(nij + 1) - lgamma(a - nij + 1) - lgamma(b - nij + 1)
          - lgamma(nn - a - b + nij + 1))) AS emi FROM emi_pairs GROUP BY g),
base AS (SELECT ta.g, ta."N" AS nn, ta."R" AS r, tb."C" AS c, sal, sa2, sbl, sb2, sn2,
           CASE WHEN ta."R" <= 1 THEN 0.0 ELSE ln(ta."N") - sal / ta."N" END AS h_true,
           CASE WHEN tb."C" <= 1 THEN 0.0 ELSE ln(ta."N") - sbl / ta."N" END AS h_pred,
           CASE WHEN ta."R" <= 1 OR tb."C" <= 1 THEN 0.0 ELSE greatest(mi_raw, 0.0) END AS mi,
           COALESCE(emi.emi, 0.0) AS emi
         FROM ta JOIN tb USING (g) JOIN mi0 USING (g) LEFT JOIN emi USING (g)),
sc1 AS (SELECT *,
  CASE WHEN (r = 1 AND c = 1) OR nn = 0 THEN 1.0 WHEN mi = 0 THEN 0.0 ELSE mi / ({avg}) END AS nmi,
  (h_true + h_pred) / 2.0 - emi AS den0,
  sn2 - nn AS tp, sb2 - sn2 AS fp, sa2 - sn2 AS fn, nn * nn - (sb2 - sn2) - (sa2 - sn2) - sn2 AS tn,
  CASE WHEN h_true = 0 THEN 1.0 ELSE mi / h_true END AS homogeneity,
  CASE WHEN h_pred = 0 THEN 1.0 ELSE mi / h_pred END AS completeness
  FROM base),
sc AS (SELECT g, nmi, homogeneity, completeness,
  CASE WHEN (r = 1 AND c = 1) OR nn = 0 THEN 1.0 ELSE (mi - emi) / (CASE WHEN den0 < 0
       THEN least(den0, -{EPS64}) ELSE greatest(den0, {EPS64}) END) END AS ami,
  CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * tn - fn * fp)
       / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari,
  CASE WHEN tp = 0 THEN 0.0 ELSE sqrt(tp / (sb2 - nn)) * sqrt(tp / (sa2 - nn)) END AS fmi,
  CASE WHEN homogeneity + completeness = 0 THEN 0.0
       ELSE 2.0 * homogeneity * completeness / (homogeneity + completeness) END AS v_measure
  FROM sc1)
SELECT {select} FROM sc"""


ALL7 = ", ".join(f"round({m}, 6) AS {m}" for m in
                 ("nmi", "ami", "ari", "fmi", "v_measure", "homogeneity", "completeness"))


def _block_vectors(time=True, text=True):
    if text and time:
        vec = f"list_concat(dv.tv, [{TIME_D}, {TIME_S}])"
    elif text:
        vec = "dv.tv"
    else:
        vec = f"[{TIME_D}, {TIME_S}]"
    return f"""{BLOCKS},
{HASHED},
bv AS (SELECT b.msg_id, b.block_id, b.block_name, b.created_at, b.event, {vec} AS vec
       FROM blocks b JOIN dvec dv USING (doc_id)),
bk AS (SELECT block_id, count(DISTINCT event) AS k FROM bv GROUP BY block_id)"""


def _assign(points: str, centers: str, keys: str):
    """Nearest centre within ``keys``; lowest cluster id wins ties."""
    on = " AND ".join(f"p.{k} = c.{k}" for k in keys.split(", "))
    sel = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""(SELECT * EXCLUDE (rn) FROM (
  SELECT p.msg_id, {sel}, p.event, c.cluster AS pred,
         row_number() OVER (PARTITION BY {sel}, p.msg_id
                            ORDER BY {sqd('p.vec', 'c.center')}, c.cluster) AS rn
  FROM {points} p JOIN {centers} c ON {on}) q WHERE rn = 1)"""


def block_pred_sql(time=True, text=True):
    return _block_vectors(time, text) + f""",
cen AS (SELECT block_id, cluster, center FROM (
  SELECT bv.block_id, CAST(row_number() OVER (PARTITION BY bv.block_id
                                              ORDER BY created_at, msg_id) - 1 AS BIGINT) AS cluster,
         vec AS center FROM bv) q JOIN bk USING (block_id) WHERE cluster < k),
bp AS {_assign('bv', 'cen', 'block_id')}"""


RUN_SCORES = _block_vectors() + f""",
runs AS (SELECT range AS run FROM range({RUNS})),
rv AS (SELECT bv.*, runs.run FROM bv, runs),
rcen AS (SELECT run, block_id, cluster, center FROM (
  SELECT run, block_id, CAST(row_number() OVER (PARTITION BY run, block_id ORDER BY
           md5(CAST(msg_id AS VARCHAR) || '-' || CAST(run AS VARCHAR))) - 1 AS BIGINT) AS cluster,
         vec AS center FROM rv) q JOIN bk USING (block_id) WHERE cluster < k),
rp AS {_assign('rv', 'rcen', 'run, block_id')},
pairs AS (SELECT run || ':' || block_id AS gk, run, block_id, event AS y_true, pred AS y_pred FROM rp)"""


def run_scores_sql():
    sc = scores_sql("WITH " + RUN_SCORES, "gk", "g, nmi, ami")
    return f"""WITH rs0 AS ({sc}),
rs AS (SELECT CAST(split_part(g, ':', 1) AS BIGINT) AS run, CAST(split_part(g, ':', 2) AS BIGINT)
       AS block_id, 'M' || split_part(g, ':', 2) AS block_name, nmi, ami FROM rs0),
lng AS (SELECT run, block_id, block_name, 'nmi' AS metric, nmi AS value FROM rs
        UNION ALL SELECT run, block_id, block_name, 'ami', ami FROM rs)"""


def _seeded_sql(k: int, seed: int = 42, oversample: int = 4) -> str:
    """k-means|| from one row: two rounds of draws by md5, weights by the nearest candidate, k weighted picks."""
    bits = lambda rnd: f"CAST('0x' || substr(md5(vec_id || ':{seed}:{rnd}'), 1, 15) AS BIGINT)"
    u = lambda rnd: f"({bits(rnd)}::DOUBLE + 0.5) / {1 << 60}::DOUBLE"                            # noqa: E731
    p = 2147483647
    sql = f"""
    WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    f AS MATERIALIZED (SELECT * FROM e ORDER BY {u(0)}, vec_id LIMIT 1),
    d0 AS MATERIALIZED (SELECT e.*, list_distance(e.v, f.v) ** 2 AS d FROM e, f),
    s1 AS MATERIALIZED (SELECT vec_id, v FROM d0 WHERE {u(1)} < {oversample * k} / (SELECT sum(d) FROM d0) * d),
    d1 AS MATERIALIZED (SELECT d0.vec_id, any_value(d0.v) AS v,
                               least(any_value(d0.d), coalesce(min(list_distance(d0.v, s1.v) ** 2), 1e300)) AS d
                        FROM d0 LEFT JOIN s1 ON true GROUP BY d0.vec_id),
    s2 AS MATERIALIZED (SELECT vec_id, v FROM d1 WHERE {u(2)} < {oversample * k} / (SELECT sum(d) FROM d1) * d),
    pool AS (SELECT 0 AS r, * FROM f UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2),
    own AS (SELECT e.vec_id, arg_min(pool.vec_id, (list_distance(e.v, pool.v), pool.r, pool.vec_id)) AS c FROM e, pool GROUP BY ALL),
    n0 AS MATERIALIZED (SELECT vec_id, v, weight, h % {p} AS a, h // {p} AS b, 1.0::DOUBLE AS near
      FROM (SELECT vec_id, v, weight, {bits(-1)} AS h FROM pool JOIN (SELECT c, count(*) AS weight FROM own GROUP BY c) ON c = vec_id))"""
    for t in range(k):
        x = f"((a + {(t + 1) * 40503}) % {p})"
        pick = f"((({x} * {x}) % {p} * 48271 + b) % {p} + 0.5) / {p}::DOUBLE"
        near = "z.d" if t == 0 else "least(near, z.d)"
        sql += f""",
    p{t} AS MATERIALIZED (SELECT {t}::BIGINT AS cluster, vec_id, weight, v FROM n{t} WHERE near > 0
                          ORDER BY -ln({pick}) / (weight * near), vec_id LIMIT 1),
    n{t + 1} AS MATERIALIZED (SELECT vec_id, v, weight, a, b, CASE WHEN vec_id = z.i THEN 0 ELSE {near} END AS near
      FROM (SELECT n.*, p.vec_id AS i, list_distance(n.v, p.v) ** 2 AS d FROM n{t} n, p{t} p) z)"""
    return sql + " UNION ALL ".join(f" SELECT cluster, vec_id, weight::BIGINT AS weight FROM p{t}" for t in range(k))


def _silhouette_by_k_sql() -> str:
    """Nearest of the first k label means; mean squared distances between rows, pair by pair."""
    return """
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT label::BIGINT AS cluster, list(x ORDER BY i) AS c FROM (
            SELECT label, i, avg(v[i]) AS x FROM e, generate_series(1, 64) t(i) GROUP BY ALL) GROUP BY label),
    p AS MATERIALIZED (
      SELECT k, vec_id, v, arg_min(cluster, (list_distance(v, c), cluster)) AS pred
      FROM e, m, generate_series(2, 9) s(k) WHERE cluster < k GROUP BY ALL),
    s AS (SELECT k, pred, count(*) AS n FROM p GROUP BY ALL),
    d AS (SELECT a.k, a.vec_id, a.pred, b.pred AS other, sum(list_distance(a.v, b.v) ** 2) AS t
          FROM p a JOIN p b ON a.k = b.k GROUP BY ALL),
    x AS (SELECT d.k, vec_id, s.n AS own,
                 sum(CASE WHEN d.pred = other THEN t / greatest(s.n - 1, 1) END) AS a,
                 min(CASE WHEN d.pred <> other THEN t / o.n END) AS b
          FROM d JOIN s ON s.k = d.k AND s.pred = d.pred JOIN s o ON o.k = d.k AND o.pred = other GROUP BY ALL)
    SELECT x.k::BIGINT AS k, (SELECT count(*) FROM s WHERE s.k = x.k) AS clusters,
           round(avg(CASE WHEN own <= 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
    FROM x GROUP BY x.k"""


def oracle_sql() -> dict:
    q: dict = {}
    q["load_clean"] = f"""WITH {MSGS} SELECT msg_id, created_at, event, doc_id,
        CAST(length(text) AS BIGINT) AS text_chars FROM msgs"""
    q["block_assign"] = f"WITH {BLOCKS} SELECT msg_id, block_id, block_name, is_offline FROM blocks"
    q["block_stats"] = f"""WITH {BLOCKS} SELECT block_id, block_name, is_offline,
        min(created_at) AS start_ts, max(created_at) AS end_ts, count(*) AS num_messages,
        count(DISTINCT event) AS num_events FROM blocks GROUP BY ALL"""
    q["block_sketches"] = f"""WITH {BLOCKS}, b AS (SELECT *, min(created_at) OVER (PARTITION BY block_id) AS s FROM blocks),
        p AS (SELECT 'block' AS scope, block_id::VARCHAR AS part, * FROM b
              UNION ALL SELECT 'week', date_trunc('week', s)::DATE::VARCHAR, * FROM b UNION ALL SELECT 'total', 'all', * FROM b)
        SELECT scope, part, min(created_at) AS start_ts, max(created_at) AS end_ts, count(*) AS num_messages,
               count(DISTINCT event) AS num_events, TRUE AS within_5_percent FROM p GROUP BY ALL"""
    q["table_stats"] = f"""WITH {MSGS} SELECT count(*) AS num_messages,
        count(DISTINCT event) AS num_events, min(created_at) AS first_ts,
        max(created_at) AS last_ts FROM msgs"""
    q["block_table_stats"] = f"""WITH {BLOCKS} SELECT COALESCE(block_id, -1) AS block_id,
        CASE WHEN grouping(block_id) = 0 THEN 'block' ELSE 'total' END AS scope,
        min(created_at) AS start_ts,
        max(created_at) AS end_ts, count(*) AS num_messages, count(DISTINCT event) AS num_events
        FROM blocks GROUP BY GROUPING SETS ((block_id), ())"""
    q["block_fetch"] = f"WITH {BLOCKS} SELECT msg_id, created_at, event FROM blocks WHERE block_name = 'M3'"
    q["label_encode"] = f"""WITH {BLOCKS},
        ids AS (SELECT block_id, event, CAST(dense_rank() OVER (PARTITION BY block_id ORDER BY event) - 1
                AS BIGINT) AS label_id FROM (SELECT DISTINCT block_id, event FROM blocks) q)
        SELECT b.msg_id, b.block_id, ids.label_id FROM blocks b JOIN ids USING (block_id, event)"""
    q["label_encode_union"] = f"""WITH {BLOCKS}, {POS},
        sp AS (SELECT msg_id, block_id, event, {split_sql(CUT_7, ('train', 'val', 'test'))} AS split
               FROM pos),
        fit AS (SELECT * FROM sp WHERE split IN ('train', 'val')),
        ids AS (SELECT block_id, event, CAST(dense_rank() OVER (PARTITION BY block_id ORDER BY event) - 1
                AS BIGINT) AS label_id FROM (SELECT DISTINCT block_id, event FROM fit) q)
        SELECT f.msg_id, f.block_id, f.split, ids.label_id FROM fit f JOIN ids USING (block_id, event)"""
    for name, cuts, names in (("split_config", CUT_CFG, ("train", "val", "test")),
                              ("split_70_20_10", CUT_7, ("train", "val", "test")),
                              ("split_80_20", CUT_8, ("train", "test"))):
        q[name] = f"""WITH {BLOCKS}, {POS}
            SELECT msg_id, block_id, {split_sql(cuts, names)} AS split FROM pos"""
    q["prompt_build"] = f"""WITH {MSGS} SELECT msg_id, md5({PROMPT}) AS prompt_md5,
        CAST(length({PROMPT}) AS BIGINT) AS prompt_chars FROM msgs"""
    q["mock_summary"] = f"WITH {MSGS} SELECT msg_id, {mock(PROMPT)} AS summary FROM msgs"
    cache = """cache AS (SELECT DISTINCT sha256(text) AS key FROM blocks WHERE block_id = 0 AND doc_id % 2 = 0)"""
    q["cache_misses"] = f"""WITH {BLOCKS}, {cache},
        onl AS (SELECT DISTINCT sha256(text) AS key, CAST(length(text) AS BIGINT) AS text_chars
                FROM blocks WHERE block_id > 0)
        SELECT key, text_chars FROM onl WHERE key NOT IN (SELECT key FROM cache)"""
    q["cache_apply"] = f"""WITH {BLOCKS}, {cache}
        SELECT msg_id, sha256(text) IN (SELECT key FROM cache) AS from_cache,
               {mock(PROMPT)} AS summary FROM msgs"""
    q["time_features"] = f"""WITH {MSGS} SELECT msg_id, round({TIME_D}, 6) AS t_days,
        round({TIME_S}, 6) AS t_secs FROM msgs"""
    q["hashed_embed"] = f"WITH {HASHED} SELECT doc_id, pos, round(x, 6) AS x FROM hx"
    q["word_vector_mean"] = f"""WITH nemb AS (SELECT count(*) AS n FROM embeddings),
        vocab AS (SELECT DISTINCT tok AS token FROM (SELECT unnest({TOKS}) AS tok FROM benchmark) q
                  WHERE length(tok) > 0),
        wv AS (SELECT v.token, e.embedding::DOUBLE[] AS vector FROM vocab v, nemb
               JOIN embeddings e ON e.vec_id = {bucket('v.token', 'nemb.n')}),
        dt AS (SELECT doc_id, unnest({TOKS}) AS token FROM documents),
        hit AS (SELECT dt.doc_id, wv.vector FROM dt JOIN wv USING (token)),
        ex AS (SELECT doc_id, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM hit),
        mx AS (SELECT doc_id, pos, avg(x) AS x FROM ex GROUP BY ALL),
        grid AS (SELECT doc_id, r.range AS pos FROM documents, range(64) r)
        SELECT g.doc_id, g.pos, round(COALESCE(mx.x, 0.0), 6) AS x FROM grid g
        LEFT JOIN mx ON g.doc_id = mx.doc_id AND g.pos = mx.pos"""
    q["concat_vectors"] = f"""WITH {MSGS}, {HASHED},
        ts AS (SELECT doc_id, sum(x) AS s FROM hx GROUP BY doc_id)
        SELECT msg_id, CAST({HASH_DIM} + 2 AS BIGINT) AS dim, round(ts.s, 6) AS text_sum,
               round({TIME_D}, 6) AS t_days, round({TIME_S}, 6) AS t_secs
        FROM msgs JOIN ts USING (doc_id)"""

    # ---- hyperbolic
    q["poincare_exp0"] = f"WITH {EMB}, p AS (SELECT vec_id, {exp0('v')} AS p FROM e) " + \
        explode("p", "vec_id", "p")
    n_p = "greatest(sqrt(" + sq("p") + "), 1e-5)"
    q["poincare_log0"] = (f"WITH {EMB}, p AS (SELECT vec_id, {exp0('v')} AS p FROM e), "
                          f"l AS (SELECT vec_id, {scale('p', artanh(n_p) + ' / ' + n_p)} AS l "
                          f"FROM p) " + explode("l", "vec_id", "l"))
    mob_pre = f"""WITH {PAIRS}, xy AS (SELECT vec_id, {exp0('v')} AS x, {exp0('w')} AS y FROM pr)"""

    def mobius(x, y):
        x2, y2, xy = sq(x), sq(y), dot(x, y)
        den = f"greatest(1.0 + 2.0 * {xy} + {x2} * {y2}, 1e-5)"
        ax = f"((1.0 + 2.0 * {xy} + {y2}) / {den})"
        ay = f"((1.0 - {x2}) / {den})"
        return f"list_transform(range(1, len({x}) + 1), lambda j_: {ax} * {x}[j_] + {ay} * {y}[j_])"

    q["mobius_add"] = (mob_pre + f", z AS (SELECT vec_id, {mobius('x', 'y')} AS z FROM xy) "
                       + explode("z", "vec_id", "z"))
    q["poincare_distance"] = (mob_pre + f""", nx AS (SELECT vec_id, list_transform(x, lambda q_: -q_)
        AS mx, y FROM xy), df AS (SELECT vec_id, {mobius('mx', 'y')} AS z FROM nx)
        SELECT vec_id, round(2.0 * {artanh('greatest(sqrt(' + sq('z') + '), 1e-5)')}, 6) AS d FROM df""")
    q["poincare_distance_acosh"] = (mob_pre + f""" SELECT vec_id,
        round({acosh_dist('x', 'y', sq('x'), sq('y'))}, 6) AS d FROM xy""")
    nv = f"greatest(sqrt({sq('v')}), 1e-5)"
    q["poincare_project"] = (f"""WITH {EMB}, p AS (SELECT vec_id, CASE WHEN {nv} > 1.0 - 1e-5
        THEN {scale('v', '(1.0 - 1e-5) / ' + nv)} ELSE v END AS p FROM e) """
                             + explode("p", "vec_id", "p"))

    def hexp(v):
        n = f"greatest(sqrt({sq(v)}), 1e-5)"
        return f"list_concat([cosh({n})], {scale(v, 'sinh(' + n + ') / ' + n)})"

    hpairs = f"WITH {PAIRS}, hxy AS (SELECT vec_id, {hexp('v')} AS x, {hexp('w')} AS y FROM pr)"
    q["minkowski_dot"] = hpairs + f" SELECT vec_id, round({mdot('x', 'y')}, 6) AS mdot FROM hxy"
    q["minkowski_norm"] = (f"WITH {EMB} SELECT vec_id, round(sqrt(greatest(abs({mdot('v', 'v')}),"
                           f" 1e-5)), 6) AS mnorm FROM e")
    q["hyperboloid_exp0"] = (f"WITH {EMB}, h AS (SELECT vec_id, {hexp('v')} AS h FROM e) "
                             + explode("h", "vec_id", "h"))
    sn = f"greatest(sqrt({sq(tail('h'))}), 1e-5)"
    q["hyperboloid_log0"] = (f"""WITH {EMB}, h AS (SELECT vec_id, {hexp('v')} AS h FROM e),
        l AS (SELECT vec_id, {scale(tail('h'), 'acosh(greatest(h[1], 1.0 + 1e-5)) / ' + sn)} AS l
              FROM h) """ + explode("l", "vec_id", "l"))
    q["hyperboloid_distance"] = hpairs + (f" SELECT vec_id, round(acosh(greatest(-{mdot('x', 'y')},"
                                          f" 1.0 + 1e-5)), 6) AS d FROM hxy")
    q["hyperboloid_project"] = (f"""WITH {EMB}, h AS (SELECT vec_id,
        list_concat([sqrt(1.0 + {sq(tail('v'))})], {tail('v')}) AS h FROM e) """
                                + explode("h", "vec_id", "h"))
    q["hyperbolic_mean"] = f"WITH {POINCARE_MEANS} SELECT cluster, pos, round(x, 6) AS x FROM pm"
    q["nearest_center"] = f"WITH {NEAREST} SELECT vec_id, pred FROM nearest"
    q["hyperbolic_assign"] = f"""WITH {POINCARE_MEANS},
        hd AS (SELECT pe.vec_id, pmc.cluster,
               {acosh_dist('pe.p', 'pmc.center', sq('pe.p'), sq('pmc.center'))} AS d FROM pe, pmc)
        SELECT vec_id, CAST(cluster AS BIGINT) AS pred FROM (SELECT *, row_number() OVER
          (PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM hd) q WHERE rn = 1"""
    q["inertia"] = f"WITH {NEAREST} SELECT round(sum(d), 6) AS inertia FROM nearest"
    q["cluster_sizes"] = f"""WITH {NEAREST}, s AS (SELECT pred, count(*) AS n FROM nearest GROUP BY pred)
        SELECT min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size FROM s"""
    ibk = f"""{LABEL_MEANS},
        ks AS (SELECT CAST(cluster + 1 AS BIGINT) AS k FROM lm WHERE cluster >= 1),
        kd AS (SELECT ks.k, e.vec_id, min({sqd('e.v', 'lm.center')}) AS d
               FROM ks, e, lm WHERE lm.cluster < ks.k GROUP BY ALL),
        ik AS (SELECT k, sum(d) AS inertia FROM kd GROUP BY k)"""
    q["inertia_by_k"] = f"WITH {ibk} SELECT k, round(inertia, 6) AS inertia FROM ik"
    q["elbow_k"] = f"""WITH {ibk},
        w AS (SELECT k, lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k)
              AS d2, row_number() OVER (ORDER BY k) AS i FROM ik)
        SELECT CAST(CASE WHEN (SELECT count(*) FROM ik) >= 3
               THEN (SELECT k FROM w WHERE d2 IS NOT NULL ORDER BY d2 DESC, i LIMIT 1)
               ELSE (SELECT min(k) FROM ik) END AS BIGINT) AS best_k"""
    q["silhouette_squared"] = f"""WITH {NEAREST},
        pd AS (SELECT a.vec_id, a.pred, b.pred AS other, {sqd('ea.v', 'eb.v')} AS d
               FROM nearest a JOIN e ea ON a.vec_id = ea.vec_id, nearest b
               JOIN e eb ON b.vec_id = eb.vec_id WHERE a.vec_id <> b.vec_id),
        per AS (SELECT vec_id, pred, other, avg(d) AS md FROM pd GROUP BY ALL),
        sizes AS (SELECT pred, count(*) AS n FROM nearest GROUP BY pred),
        ab AS (SELECT n.vec_id, n.pred,
                 max(CASE WHEN per.other = n.pred THEN per.md END) AS a,
                 min(CASE WHEN per.other <> n.pred THEN per.md END) AS b
               FROM nearest n LEFT JOIN per ON per.vec_id = n.vec_id GROUP BY ALL)
        SELECT round(avg(CASE WHEN sizes.n <= 1 OR b IS NULL THEN 0.0
                            ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_squared
        FROM ab JOIN sizes USING (pred)"""
    q["hyperbolic_lloyd_2steps"] = _lloyd_sql()
    blk = _block_lloyd_sql()
    q["block_kmeans_centers"] = blk + " " + explode("c2", "block_id, cluster", "center")
    q["block_kmeans_inertia"] = blk + f""" SELECT block_id, round(sum(d), 4) AS inertia, CAST(2 AS BIGINT) AS n_iter
        FROM a2 GROUP BY block_id"""
    q["block_kmeans_predict"] = blk + f""", a3 AS {_near('c2')}
        SELECT block_id, cluster AS pred, count(*) AS rows FROM a3 GROUP BY ALL"""

    q["kmeans_seeded"] = _seeded_sql(8)
    q["silhouette_by_k"] = _silhouette_by_k_sql()

    # ---- scores
    emb_pairs = f"WITH {NEAREST}, pairs AS (SELECT CAST(label AS BIGINT) AS y_true, pred AS y_pred FROM nearest)"
    q["contingency"] = emb_pairs + " SELECT y_true, y_pred, count(*) AS n_ij FROM pairs GROUP BY ALL"
    for m in ("nmi", "ami", "ari", "fmi", "homogeneity", "completeness", "v_measure"):
        q[m] = scores_sql(emb_pairs, None, f"round({m}, 6) AS {m}")
    for avg in ("geometric", "min", "max"):
        q[f"nmi_{avg}"] = scores_sql(emb_pairs, None, f"round(nmi, 6) AS nmi_{avg}", avg)
    q["scores_all"] = scores_sql(emb_pairs, None, ALL7)
    q["scores_quality_toxic"] = scores_sql(
        "WITH pairs AS (SELECT quality AS y_true, toxic AS y_pred FROM labels)", None, ALL7)
    q["scores_per_block"] = scores_sql(
        "WITH " + block_pred_sql() + ", pairs AS (SELECT block_id, event AS y_true, pred AS y_pred FROM bp)",
        "block_id", "g AS block_id, " + ALL7)

    # ---- results over runs
    rs = run_scores_sql()
    q["runs_mean_std"] = rs + """ SELECT metric, round(avg(value), 6) AS mean,
        round(stddev_pop(value), 6) AS std FROM lng WHERE block_id = 0 GROUP BY metric"""
    q["blocks_mean_std"] = rs + """ SELECT block_name, metric, round(avg(value), 6) AS mean,
        round(stddev_pop(value), 6) AS std FROM lng GROUP BY ALL"""
    q["block_table"] = rs + """, bm AS (SELECT block_name, metric, avg(value) AS mean,
        stddev_pop(value) AS std FROM lng GROUP BY ALL)
        SELECT block_name, CAST(substr(block_name, 2) AS BIGINT) AS block_order,
          round(max(CASE WHEN metric = 'nmi' THEN mean END), 6) AS nmi_mean,
          round(max(CASE WHEN metric = 'nmi' THEN std END), 6) AS nmi_std,
          round(max(CASE WHEN metric = 'ami' THEN mean END), 6) AS ami_mean,
          round(max(CASE WHEN metric = 'ami' THEN std END), 6) AS ami_std
        FROM bm GROUP BY block_name"""
    q["run_block_average"] = rs + """ SELECT run, metric, round(avg(value), 6) AS mean,
        round(stddev_pop(value), 6) AS std FROM lng GROUP BY ALL"""
    q["runs_of_blocks"] = rs + """, per AS (SELECT run, metric, avg(value) AS value FROM lng
        GROUP BY ALL) SELECT metric, round(avg(value), 6) AS mean,
        round(stddev_pop(value), 6) AS std FROM per GROUP BY metric"""
    q["format_paper_style"] = rs + """, ms AS (SELECT metric, avg(value) AS mean,
        stddev_pop(value) AS std FROM lng WHERE block_id = 0 GROUP BY metric)
        SELECT metric, printf('.%02d±.%02d', CAST(trunc(mean * 100.0) AS INTEGER),
                              CAST(trunc(std * 100.0) AS INTEGER)) AS formatted FROM ms"""
    q["best_epoch"] = rs + """ SELECT run AS epoch, round(value, 6) AS value FROM lng
        WHERE block_id = 0 AND metric = 'nmi' ORDER BY value DESC, run LIMIT 1"""
    cfg_parts = []
    for name, tm, tx in (("text+time", True, True), ("text", False, True), ("time", True, False)):
        sc = scores_sql("WITH " + block_pred_sql(tm, tx) + ", pairs AS (SELECT block_id, event AS "
                        "y_true, pred AS y_pred FROM bp)", "block_id", "nmi, ami")
        cfg_parts.append(f"SELECT '{name}' AS config, avg(nmi) AS nmi, avg(ami) AS ami FROM ({sc}) q")
    q["compare_configs"] = ("SELECT config, round(nmi, 6) AS nmi, round(ami, 6) AS ami FROM ("
                            + " UNION ALL ".join(cfg_parts) + ") z")
    iso = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    cell = "date_trunc('second', ts)"
    q["standardize"] = f"""WITH r AS (SELECT event_id AS msg_id,
          CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE 'text ' || event_id END AS text,
          CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN {cell}
               WHEN event_id % 19 = 0 THEN {cell} - INTERVAL 2 HOUR WHEN event_id % 23 = 0 THEN NULL
               ELSE CAST({iso} AS TIMESTAMP) END AS created_at,
          CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END AS event FROM events)
        SELECT * FROM r WHERE text IS NOT NULL AND created_at IS NOT NULL AND event IS NOT NULL"""
    q["summary_stats"] = f"""SELECT count(*) AS rows, count(*) FILTER (length({PROMPT}) % 10 <> 0) AS succeeded
        FROM documents WHERE text IS NOT NULL"""
    q["model_names"] = """SELECT event_id, (['llama3.1:8b', 'qwen2.5:7b', 'gemma2:9b', 'own:1b', 'llama3.1:8b'])[event_id % 5 + 1]
        AS model FROM events"""
    q["summary_defaults"] = """WITH m AS (SELECT 'm' || (event_id % 2) AS metric, round(avg(value), 6) AS mean,
          round(stddev_pop(value), 6) AS std FROM events GROUP BY 1)
        SELECT w.metric, coalesce(mean, 0.0) AS mean, coalesce(std, 0.0) AS std
        FROM (VALUES ('m0'), ('m1'), ('absent')) w(metric) LEFT JOIN m USING (metric)"""

    # ---- encoder with weights by formula
    def layer(x, fin, fout, n, act):
        z = (f"0.1 * cos(j_ + {n}) + list_sum(list_transform(range(1, {fin} + 1), "
             f"lambda i_: {x}[i_] * 0.3 * sin(7 * (i_ - 1) + 3 * j_ + {n})))")
        return f"list_transform(range(0, {fout}), lambda j_: {f'greatest({z}, 0.0)' if act else z})"

    mlp = f"WITH {EMB}, a AS (SELECT vec_id, {layer('v', 64, 6, 0, True)} AS a FROM e), " \
          f"u AS (SELECT vec_id, {layer('a', 6, 4, 1, False)} AS u FROM a)"
    lin = f"WITH {EMB}, u AS (SELECT vec_id, {layer('v', 64, 4, 0, False)} AS u FROM e)"

    def ball(c):
        n = f"greatest(sqrt({sq('u')}), 1e-5)"
        y = scale("u", f"tanh(sqrt({c}) * {n}) / (sqrt({c}) * {n})")
        yn = f"greatest(sqrt({sq('y')}), 1e-5)"
        m = f"((1.0 - 1e-5) / sqrt({c}))"
        return (f", y AS (SELECT vec_id, {y} AS y FROM u), h AS (SELECT vec_id, CASE WHEN {yn} > {m} THEN "
                f"{scale('y', f'{m} / {yn}')} ELSE y END AS h FROM y) ")

    hn = f"greatest(sqrt({sq('u')}), 1e-5)"
    q["linear_fixed"] = lin + ball(1.0) + explode("h", "vec_id", "h")
    q["encode_fixed_poincare"] = mlp + ball(2.0) + explode("h", "vec_id", "h")
    q["encode_euclidean_fixed"] = mlp + " " + explode("u", "vec_id", "u")
    q["encode_fixed_hyperboloid"] = (mlp + f", s AS (SELECT vec_id, {scale('u', f'sinh({hn} / sqrt(0.5)) / {hn}')} AS s FROM u), "
                                     f"h AS (SELECT vec_id, list_concat([sqrt(2.0 + {sq('s')})], s) AS h FROM s) "
                                     + explode("h", "vec_id", "h"))

    # ---- hyperbolic functions over curvatures and norms
    grid = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    k AS (SELECT c::DOUBLE AS c, s::DOUBLE AS scale FROM (VALUES (0.5), (1.0), (2.0)) a(c), (VALUES (0.0), (0.01), (1.0), (50.0)) b(s)),
    x AS (SELECT a.vec_id, c, scale, list_transform(a.e, lambda t_: t_ * scale) AS v, list_transform(b.e, lambda t_: t_ * 0.5) AS w
          FROM e a JOIN e b ON b.vec_id = a.vec_id + 1, k),"""
    nv_, nw_ = (f"greatest(sqrt({sq(t)}), 1e-5)" for t in "vw")
    np_ = f"greatest(sqrt({sq('p0')}), 1e-5)"
    rad = "((1.0 - 1e-5) / sqrt(c))"
    x2, y2, xy = sq("p"), sq("q"), dot("p", "q")

    def add(sign):
        a = f"((1.0 + 2.0 * c * {sign}{xy} + c * {y2}) / greatest(1.0 + 2.0 * c * {sign}{xy} + c * c * {x2} * {y2}, 1e-5))"
        b = f"((1.0 - c * {x2}) / greatest(1.0 + 2.0 * c * {sign}{xy} + c * c * {x2} * {y2}, 1e-5))"
        return f"list_transform(range(1, 65), lambda j_: {sign}{a} * p[j_] + {b} * q[j_])"

    nh, ng = "greatest(sqrt(" + sq("vh") + "), 1e-5)", "greatest(sqrt(" + sq("q") + "), 1e-5)"
    ht = f"greatest(sqrt({sq(tail('h'))}), 1e-5)"
    nl = f"greatest(sqrt({sq('p')}), 1e-5)"
    q["hyperbolic_grid"] = grid + f"""
    y AS (SELECT *, {scale('v', f'tanh(sqrt(c) * {nv_}) / (sqrt(c) * {nv_})')} AS p0,
             {scale('w', f'tanh(sqrt(c) * {nw_}) / (sqrt(c) * {nw_})')} AS q, list_transform(v, lambda t_: t_ * 0.1) AS vh FROM x),
    z AS (SELECT *, CASE WHEN {np_} > {rad} THEN {scale('p0', f'{rad} / {np_}')} ELSE p0 END AS p FROM y),
    u AS (SELECT vec_id, c, scale, p, q, {add('')} AS m, {add('-')} AS df,
             {scale('p', artanh(f'sqrt(c) * {nl}') + f' / (sqrt(c) * {nl})')} AS l,
             list_concat([cosh({nh} / sqrt(c))], {scale('vh', f'sinh({nh} / sqrt(c)) / {nh}')}) AS h,
             list_concat([cosh({ng} / sqrt(c))], {scale('q', f'sinh({ng} / sqrt(c)) / {ng}')}) AS g FROM z)
    SELECT vec_id, c, scale, round(list_sum(p), 6) AS p_sum, round(list_sum(l), 6) AS l_sum, round(list_sum(m), 6) AS m_sum,
      round(2.0 / sqrt(c) * {artanh('sqrt(c) * greatest(sqrt(' + sq('df') + '), 1e-5)')}, 4) AS d,
      round(acosh(greatest(1.0 + 2.0 * c * {sqd('p', 'q')} / ((1.0 - c * {x2}) * (1.0 - c * {y2}) + 1e-10), 1.0 + 1e-10)) / sqrt(c), 4)
        AS d_acosh,
      round(list_sum(h) / h[1], 6) AS h_rel,
      round(list_sum({scale(tail('h'), f'acosh(greatest(h[1], 1.0 + 1e-5)) * sqrt(c) / {ht}')}), 6) AS hl_sum,
      round(acosh(greatest(-{mdot('h', 'g')}, 1.0 + 1e-5)) / sqrt(c), 4) AS hd,
      round(sqrt(1.0 / c + {sq(tail('h'))}) / h[1], 6) AS hp_rel FROM u"""
    q["update_rule"] = f"""WITH {BLOCKS}, w AS (SELECT unnest([1, 2, 3, 4, 5, 1000])::BIGINT AS window)
        SELECT b.block_id, w.window, b.block_id % w.window = 0 AS update
        FROM (SELECT DISTINCT block_id FROM blocks) b, w"""
    q["stream_daily_blocks"] = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n
        FROM events WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
              <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL"""
    q["stream_daily_stats"] = """SELECT CAST(ts AS DATE) AS day, min(ts) AS start_ts, max(ts) AS end_ts,
        count(*) AS num_messages, count(DISTINCT event_type) AS num_events
        FROM events WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
              <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1"""
    q["stream_assign"] = q["nearest_center"]
    q["stream_kmeans"] = f"""WITH {NEAREST},
        px AS (SELECT n.pred, unnest(range(len(e.v))) AS pos, unnest(e.v) AS x FROM nearest n JOIN e ON n.vec_id = e.vec_id),
        ps AS (SELECT pred, pos, sum(x) AS s, count(*) AS n FROM px GROUP BY ALL),
        cx AS (SELECT CAST(cluster AS BIGINT) AS cluster, unnest(range(len(center))) AS pos, unnest(center) AS x FROM lm)
        SELECT cluster, CAST(10.0 + coalesce(n, 0) AS DOUBLE) AS weight, cx.pos AS pos,
               round((10.0 * x + coalesce(s, 0)) / (10.0 + coalesce(n, 0)), 6) AS x
        FROM cx LEFT JOIN ps ON cx.cluster = ps.pred AND cx.pos = ps.pos"""
    return q


def _near(centers):
    """Every row of ``bv`` with its nearest centre of its block and the squared distance."""
    return f"""(SELECT block_id, msg_id, vec, cluster, d FROM (
  SELECT p.block_id, p.msg_id, p.vec, c.cluster, {sqd('p.vec', 'c.center')} AS d,
         row_number() OVER (PARTITION BY p.msg_id ORDER BY {sqd('p.vec', 'c.center')}, c.cluster) AS rn
  FROM bv p JOIN {centers} c ON p.block_id = c.block_id) q WHERE rn = 1)"""


def _block_lloyd_sql():
    """Two Euclidean k-means steps in every block from its first k messages."""
    sql = "WITH " + block_pred_sql() + ", c0 AS (SELECT block_id, cluster, center FROM cen)"
    for n in (1, 2):
        sql += f""",
    a{n} AS {_near(f'c{n - 1}')},
    x{n} AS (SELECT block_id, cluster, unnest(range(len(vec))) AS pos, unnest(vec) AS x FROM a{n}),
    m{n} AS (SELECT block_id, cluster, pos, avg(x) AS mx FROM x{n} GROUP BY ALL),
    k{n} AS (SELECT block_id, cluster, array_agg(mx ORDER BY pos) AS center FROM m{n} GROUP BY ALL),
    c{n} AS (SELECT c.block_id, c.cluster, COALESCE(k.center, c.center) AS center FROM c{n - 1} c
             LEFT JOIN k{n} k ON c.block_id = k.block_id AND c.cluster = k.cluster)"""
    return sql


def _lloyd_sql():
    """Two hyperbolic k-means steps from the 10 rows with the smallest md5(id)."""
    start = f"""{EMB},
    p AS (SELECT vec_id, {exp0('v')} AS p FROM e),
    c0 AS (SELECT CAST(row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS BIGINT)
           AS cluster, p AS center FROM p ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT 10)"""

    def step(prev, nxt):
        return f""",
    a_{nxt} AS (SELECT vec_id, p, cluster FROM (SELECT p.vec_id, p.p, c.cluster,
        row_number() OVER (PARTITION BY p.vec_id ORDER BY
          {acosh_dist('p.p', 'c.center', sq('p.p'), sq('c.center'))}, c.cluster) AS rn
        FROM p, {prev} c) q WHERE rn = 1),
    x_{nxt} AS (SELECT cluster, unnest(range(len(p))) AS pos, unnest(p) AS x FROM a_{nxt}),
    m_{nxt} AS (SELECT cluster, pos, avg(x) AS mx FROM x_{nxt} GROUP BY ALL),
    n_{nxt} AS (SELECT cluster, sqrt(sum(mx * mx)) AS nr FROM m_{nxt} GROUP BY cluster),
    k_{nxt} AS (SELECT m.cluster, array_agg(CASE WHEN nr > 1.0 - 1e-5 THEN mx * ((1.0 - 1e-5) / nr)
                ELSE mx END ORDER BY pos) AS center FROM m_{nxt} m JOIN n_{nxt} USING (cluster)
                GROUP BY m.cluster),
    {nxt} AS (SELECT c.cluster, COALESCE(k.center, c.center) AS center FROM {prev} c
              LEFT JOIN k_{nxt} k USING (cluster))"""

    body = "WITH " + start + step("c0", "c1") + step("c1", "c2")
    return body + " " + explode("c2", "cluster", "center")
