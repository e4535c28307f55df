"""DuckDB SQL for the queries of :mod:`.whole`: dense V x V grids wherever V allows, recursion for sampling."""

from __future__ import annotations

from ..config import PINS as P
from .oracle import PAT, SEED, SRC, V, csv, r6, r9, tok, uniform
from .oracle import with_ as _with

EVERY = "SELECT 0 AS src, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, text FROM conversations WHERE text IS NOT NULL"


def corpus(n_words: int) -> list[str]:
    """CTEs: vocabulary, pair counts of both models (tp, sp), the shared back-off (uu) and contexts (tc, sc)."""
    size = n_words + 3
    number = lambda w, v: f"CASE WHEN {w} = ' b' THEN 1 WHEN {w} = ' e' THEN 2 ELSE coalesce({v}.tok, 3) END"
    return [
        f"wds AS (SELECT src, regexp_extract_all(text, '{PAT}', 1) AS w FROM ({EVERY}))",
        f"voc AS (SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 3)::INTEGER AS tok FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM wds) GROUP BY word ORDER BY n DESC, word LIMIT {n_words}))",
        "bw AS (SELECT src, w1, w2, count(*) AS n FROM (SELECT src, unnest([' b'] || w) AS w1, unnest(w || [' e']) AS w2 FROM wds) GROUP BY ALL)",
        f"bp AS (SELECT src, {number('w1', 'x')} AS ctx, {number('w2', 'y')} AS tok, sum(n)::BIGINT AS n FROM bw LEFT JOIN voc x ON x.word = w1 LEFT JOIN voc y ON y.word = w2 GROUP BY ALL)",
        "tp AS (SELECT ctx, tok, sum(n)::BIGINT AS n FROM bp GROUP BY ctx, tok)",
        "sp AS (SELECT ctx, tok, n FROM bp WHERE src = 1)",
        "tc AS (SELECT ctx, sum(n)::BIGINT AS n FROM tp GROUP BY ctx)",
        "sc AS (SELECT ctx, sum(n)::BIGINT AS n FROM sp GROUP BY ctx)",
        f"uu AS (SELECT r.tok, (coalesce(c.n, 0) + {P.unigram_k}) / ((SELECT sum(n) FROM tp) + {P.unigram_k} * {size}) AS u FROM range(1, {size} + 1) r(tok) LEFT JOIN (SELECT tok, sum(n) AS n FROM tp GROUP BY tok) c ON c.tok = r.tok)",
    ]


DENSE = [
    *corpus(P.n_words),
    f"""dn AS (SELECT g.ctx, uu.tok, (coalesce(tp.n, 0) + {P.teacher_alpha} * u) / (coalesce(tc.n, 0) + {P.teacher_alpha}) AS p,
               (coalesce(sp.n, 0) + {P.student_alpha} * u) / (coalesce(sc.n, 0) + {P.student_alpha}) AS s
        FROM range(1, {V} + 1) g(ctx) CROSS JOIN uu LEFT JOIN tp ON tp.ctx = g.ctx AND tp.tok = uu.tok LEFT JOIN sp ON sp.ctx = g.ctx AND sp.tok = uu.tok
        LEFT JOIN tc ON tc.ctx = g.ctx LEFT JOIN sc ON sc.ctx = g.ctx)""",
    """dd AS (SELECT ctx, sum(p * (ln(p) - ln(s))) AS kl_ts, sum(s * (ln(s) - ln(p))) AS kl_st,
               sum(0.5 * m * (ln(m) - ln(p)) + 0.25 * m * (ln(m) - ln(s))) AS jsd_ref, sum((s - p) * (s - p)) AS gap2
        FROM (SELECT *, (p + s) / 2 AS m FROM dn) GROUP BY ctx)""",
]


#: CTEs: examples as words (wx), shuffled, sharded and batched by plain windows (wb), positions' contexts (wp), step weights (ww).
POSITIONS = [
    f"wx AS (SELECT id, split, regexp_extract_all({SRC} || output, '{PAT}', 1) AS w FROM ins_s WHERE len(regexp_extract_all({SRC} || output, '{PAT}', 1)) < {P.model_max_length})",
    f"wi AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'train' THEN md5('{SEED}:' || id) END, id) - 1 AS idx, count(*) OVER (PARTITION BY split) AS n FROM wx)",
    f"wq AS (SELECT * FROM wi UNION ALL SELECT * REPLACE (idx + n AS idx) FROM wi WHERE idx < ceil(n / {P.world_size}.0) * {P.world_size} - n)",
    f"wb AS (SELECT id, split, w, n, (idx % {P.world_size})::INTEGER AS rank, (idx // {P.world_size} // {P.batch_size})::BIGINT AS batch_no FROM wq)",
    "wp AS (SELECT split, rank, batch_no, n, coalesce(voc.tok, 3) AS ctx FROM (SELECT split, rank, batch_no, n, unnest(w[:-2]) AS word FROM wb) LEFT JOIN voc USING (word))",
    f"""ws AS (SELECT rank, ctx, (e.epoch * ceil(ceil(n / {P.world_size}.0) / {P.batch_size}) + batch_no)::BIGINT AS step FROM wp, range({P.epochs}) e(epoch) WHERE split = 'train')""",
    f"""ww AS (SELECT step, ctx, sum(k / ({P.world_size}.0 * t)) AS w FROM (SELECT step, rank, ctx, count(*) AS k FROM ws GROUP BY ALL)
           JOIN (SELECT step, rank, count(*) AS t FROM ws GROUP BY ALL) USING (step, rank) GROUP BY step, ctx)""",
]


def whole(*ctes: str, names: tuple[str, ...] = (), recursive: bool = False) -> str:
    """WITH clause of the shared CTEs ``names`` followed by ``ctes``."""
    head = _with(*names, recursive=recursive).rstrip() + ",\n" if names else ("WITH RECURSIVE " if recursive else "WITH ")
    return head + ",\n".join(ctes) + "\n"


# A row's texts, each preceded by its length.
CONTENT_KEY = "md5(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("instruction", "input", "output")) + ")"


# Summary of a sparse model: what no context has seen adds up in closed form.
def _summary(model: str, pairs: str, contexts: str, alpha: float) -> str:
    p = f"((n + {alpha} * u) / (nc + {alpha}))"
    return f"""SELECT '{model}' AS model, ctx, nc AS n_ctx, count(*) AS n_pairs, {r6(f'{alpha} / (nc + {alpha})')} AS lam,
        {r6(f"-(sum({p} * ln({p})) + {alpha} / (nc + {alpha}) * (ln({alpha} / (nc + {alpha})) * (1 - sum(u)) + (SELECT sum(u * ln(u)) FROM uu) - sum(u * ln(u))))")} AS entropy
        FROM (SELECT q.ctx, q.n, c.n AS nc, u FROM {pairs} q JOIN {contexts} c ON c.ctx = q.ctx JOIN uu ON uu.tok = q.tok) GROUP BY ctx, nc"""


LARGE_WORDS = 32_000
_OBSERVED = [
    f"""ob AS (SELECT ctx, lt, ls, sum(p * (ln(p) - ln(s))) AS a, sum(s * (ln(s) - ln(p))) AS b, sum(0.5 * m * (ln(m) - ln(p)) + 0.25 * m * (ln(m) - ln(s))) AS j, greatest(0, 1 - sum(u)) AS rest
        FROM (SELECT *, (p + s) / 2 AS m FROM (
          SELECT k.ctx, u, {P.teacher_alpha} / (coalesce(tc.n, 0) + {P.teacher_alpha}) AS lt, {P.student_alpha} / (coalesce(sc.n, 0) + {P.student_alpha}) AS ls,
                 (coalesce(tp.n, 0) + {P.teacher_alpha} * u) / (coalesce(tc.n, 0) + {P.teacher_alpha}) AS p,
                 (coalesce(sp.n, 0) + {P.student_alpha} * u) / (coalesce(sc.n, 0) + {P.student_alpha}) AS s
          FROM (SELECT ctx, tok FROM tp UNION SELECT ctx, tok FROM sp) k JOIN uu ON uu.tok = k.tok LEFT JOIN tp ON tp.ctx = k.ctx AND tp.tok = k.tok
          LEFT JOIN sp ON sp.ctx = k.ctx AND sp.tok = k.tok LEFT JOIN tc ON tc.ctx = k.ctx LEFT JOIN sc ON sc.ctx = k.ctx)) GROUP BY ctx, lt, ls)""",
    """od AS (SELECT ctx, a + lt * rest * ln(lt / ls) AS kl_ts, b + ls * rest * ln(ls / lt) AS kl_st,
                 j + (lt + ls) / 2 * rest * (0.5 * ln((lt + ls) / 2 / lt) + 0.25 * ln((lt + ls) / 2 / ls)) AS jsd_ref FROM ob)""",
    "om AS (SELECT split, rank, batch_no, avg(coalesce(kl_ts, 0)) AS kl_ts, avg(coalesce(kl_st, 0)) AS kl_st, avg(coalesce(jsd_ref, 0)) AS jsd_ref FROM wp LEFT JOIN od USING (ctx) GROUP BY ALL)",
]

# ---- models that read two ids back ----
_BACK = [
    f"qs AS (SELECT src, [1] || {tok('text')} || [2] AS s FROM ({EVERY}), vm)",
    "q3 AS (SELECT src, CASE WHEN i > 1 THEN s[i - 1] ELSE 0 END AS a, s[i] AS b, s[i + 1] AS v, count(*) AS n FROM (SELECT src, s, unnest(range(1, len(s))) AS i FROM qs) GROUP BY ALL)",
    # model 0 is the teacher (both corpora), model 1 the student
    "qm AS (SELECT 0 AS model, a, b, v, sum(n) AS n FROM q3 GROUP BY ALL UNION ALL SELECT 1, a, b, v, n FROM q3 WHERE src = 1)",
    f"qa AS (SELECT 0 AS model, {P.teacher_alpha}::DOUBLE AS alpha UNION ALL SELECT 1, {P.student_alpha}::DOUBLE)",
    f"""qu AS (SELECT qa.model, r.v, (coalesce(c.n, 0) + {P.unigram_k}) / (t.n + {P.unigram_k} * {V}) AS u FROM qa CROSS JOIN range(1, {V} + 1) r(v)
          LEFT JOIN (SELECT model, v, sum(n) AS n FROM qm GROUP BY ALL) c ON c.model = qa.model AND c.v = r.v JOIN (SELECT model, sum(n) AS n FROM qm GROUP BY ALL) t ON t.model = qa.model)""",
    f"""qb AS (SELECT qa.model, g.b, qu.v, (coalesce(c.n, 0) + alpha * u) / (coalesce(t.n, 0) + alpha) AS p FROM qa CROSS JOIN range(1, {V} + 1) g(b) JOIN qu ON qu.model = qa.model
          LEFT JOIN (SELECT model, b, v, sum(n) AS n FROM qm GROUP BY ALL) c ON c.model = qa.model AND c.b = g.b AND c.v = qu.v
          LEFT JOIN (SELECT model, b, sum(n) AS n FROM qm GROUP BY ALL) t ON t.model = qa.model AND t.b = g.b)""",
    "qt AS (SELECT model, a, b, sum(n) AS n FROM qm WHERE a > 0 GROUP BY ALL)",
]


def _three(contexts: str) -> str:
    """P(v | a, b) of the model's rows of ``contexts`` (model, a, b)."""
    return f"""SELECT k.model, k.a, k.b, qb.v, (coalesce(c.n, 0) + alpha * qb.p) / (coalesce(t.n, 0) + alpha) AS p
        FROM ({contexts}) k JOIN qa ON qa.model = k.model JOIN qb ON qb.model = k.model AND qb.b = k.b
        LEFT JOIN qt t ON t.model = k.model AND t.a = k.a AND t.b = k.b LEFT JOIN qm c ON c.model = k.model AND c.a = k.a AND c.b = k.b AND c.v = qb.v"""


_CDF = f"""qc AS (SELECT a, b, v, CASE WHEN v = {V} THEN 1.0 ELSE round(sum(p) OVER (PARTITION BY a, b ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 12) END AS hi
    FROM (SELECT a, b, v, p FROM ({_three('SELECT model, a, b FROM qt WHERE model = 1')}) UNION ALL SELECT 0, b, v, p FROM qb WHERE model = 1))"""


def _walk(name: str, rows: str) -> str:
    """Sampling by recursion; ``rows``: id, ids, budget."""
    return f"""{name} AS (SELECT id, 0 AS step, coalesce(ids[len(ids) - 1], 1) AS a, ids[len(ids)] AS b, budget FROM ({rows})
      UNION ALL
      SELECT s.id, s.step + 1, s.b, min(c.v), s.budget
      FROM {name} s LEFT JOIN (SELECT a, b FROM qt WHERE model = 1) t ON t.a = s.a AND t.b = s.b
      JOIN qc c ON c.a = coalesce(t.a, 0) AND c.b = s.b
      WHERE s.step < s.budget AND s.b <> CASE WHEN s.step = 0 THEN -1 ELSE 2 END AND c.hi > {uniform(f"'{SEED}:' || s.id || ':' || (s.step + 1)")}
      GROUP BY s.id, s.step, s.b, s.budget)"""


def _judged(budget: str, scope: str) -> list[str]:
    """CTEs: sampled text of the online batches (f), judged positions (j) and batch means (m)."""
    first = "CASE WHEN i >= len(ids) THEN true ELSE ids[i + 1] <> 2 END" if scope == "all" else "i >= len(ids)"
    return [
        _walk("qw", f"SELECT DISTINCT id, ids, {budget} AS budget FROM pb"),
        "qn AS (SELECT id, coalesce(list(b ORDER BY step) FILTER (WHERE step > 0), []) AS new_ids FROM qw GROUP BY id)",
        "qf AS (SELECT pb.rank, pb.batch_no, pb.ids, pb.ids || qn.new_ids AS f FROM pb JOIN qn USING (id))",
        f"qj AS (SELECT rank, batch_no, CASE WHEN i > 1 THEN f[i - 1] ELSE 1 END AS a, f[i] AS b FROM (SELECT *, unnest(range(1, len(f))) AS i FROM qf) WHERE f[i + 1] <> 0 AND {first})",
        f"qp AS ({_three('SELECT model, a, b FROM (SELECT DISTINCT a, b FROM qj), qa')})",
        """qd AS (SELECT a, b, sum(p * (ln(p) - ln(s))) AS kl_ts, sum(s * (ln(s) - ln(p))) AS kl_st, sum(0.5 * m * (ln(m) - ln(p)) + 0.25 * m * (ln(m) - ln(s))) AS jsd_ref
            FROM (SELECT t.a, t.b, t.p, s.p AS s, (t.p + s.p) / 2 AS m FROM qp t JOIN qp s ON s.a = t.a AND s.b = t.b AND s.v = t.v WHERE t.model = 0 AND s.model = 1) GROUP BY a, b)""",
        "qx AS (SELECT rank, batch_no, count(*)::BIGINT AS n_positions, avg(kl_ts) AS kl_ts, avg(kl_st) AS kl_st, avg(jsd_ref) AS jsd_ref FROM qj JOIN qd USING (a, b) GROUP BY rank, batch_no)",
    ]


def _onpolicy(budget: str, scope: str) -> str:
    return whole(*_BACK, _CDF, *_judged(budget, scope), names=("vm", "pb"), recursive=True)


_MEANS = f"SELECT rank, batch_no, n_positions, {r6('kl_ts')} AS kl_ts, {r6('kl_st')} AS kl_st, {r6('jsd_ref')} AS jsd_ref FROM qx"

QUERIES: dict[str, str] = {
    "sparse_lm": whole(*corpus(LARGE_WORDS)) + _summary("teacher", "tp", "tc", P.teacher_alpha) + " UNION ALL " + _summary("student", "sp", "sc", P.student_alpha),
    "sparse_divergence": whole(*DENSE)
    + f"SELECT ctx, {r6('kl_ts')} AS kl_ts, {r6('kl_st')} AS kl_st, {r6('jsd_ref')} AS jsd_ref, {r6('gap2')} AS gap2 FROM dd WHERE ctx IN (SELECT ctx FROM tc UNION SELECT ctx FROM sc)",
    "evaluate_sparse": whole(*corpus(LARGE_WORDS), *POSITIONS, *_OBSERVED, names=("ins_s",))
    + f"""SELECT split, metric, {r6('avg(v)')} AS value, count(*)::BIGINT AS n_batches FROM (SELECT split, unnest(['reverse_kl', 'forward_kl', 'jsd_p_q']) AS metric, unnest([kl_ts, kl_st, jsd_ref]) AS v FROM om) GROUP BY split, metric""",
    "gradient_steps": whole(*DENSE, *POSITIONS, names=("ins_s",))
    + f"SELECT step, ctx, {r9('sqrt(sum(w * w * (s - p) * (s - p)))')} AS l2, {r9('sum(w * abs(s - p))')} AS l1 FROM ww JOIN dn USING (ctx) GROUP BY step, ctx",
    "gradient_norms": whole(*DENSE, *POSITIONS, names=("ins_s",))
    + f"""SELECT step, {r9('loss')} AS loss, {r9('norm')} AS grad_norm, {r9('least(1.0, 0.005 / (norm + 1e-6))')} AS clip_factor
          FROM (SELECT step, sum(w * kl_ts) AS loss, sqrt(sum(w * w * gap2)) AS norm FROM ww JOIN dd USING (ctx) GROUP BY step)""",
    "sample_prefix_model": whole(*_BACK, _CDF, _walk("qw", f"SELECT id, ids, greatest(0, {P.max_tokens} - n_tokens) AS budget FROM prm_f"), names=("vm", "prm_f"), recursive=True)
    + f"SELECT id, len(x)::BIGINT AS n_new, {csv('x')} AS new_ids FROM (SELECT id, coalesce(list(b ORDER BY step) FILTER (WHERE step > 0), []) AS x FROM qw GROUP BY id)",
    "onpolicy_score_mapped": _onpolicy("budget_batch", "all") + _MEANS,
    "onpolicy_score_generated": _onpolicy("budget", "generated") + _MEANS,
    "evaluate_onpolicy": _onpolicy("budget_batch", "all")
    + f"""SELECT 'val/' || metric AS name, {r6('avg(v)')} AS value, count(*)::BIGINT AS n_ranks FROM (
            SELECT rank, metric, avg(v) AS v FROM (SELECT rank, unnest(['reverse_kl', 'forward_kl', 'jsd_p_q']) AS metric, unnest([kl_ts, kl_st, jsd_ref]) AS v FROM qx WHERE batch_no <= {P.eval_cap})
            GROUP BY rank, metric) GROUP BY metric""",
    "scores_divergence": _with("epair_div")
    + f"""SELECT (pair_id // 8)::BIGINT AS id, count(*)::BIGINT AS n_positions, {r6('avg(kl_ts)')} AS kl_ts, {r6('avg(kl_st)')} AS kl_st, {r6('avg(jsd_ref)')} AS jsd_ref
          FROM epair_div GROUP BY pair_id // 8""",
    "scores_rejects": """SELECT reason, count(*)::BIGINT AS n_positions FROM (
          SELECT 'no_student' AS reason FROM embeddings t WHERE NOT EXISTS (SELECT 1 FROM embeddings s WHERE s.vec_id = t.vec_id + 1)
          UNION ALL SELECT 'no_teacher' FROM embeddings s WHERE NOT EXISTS (SELECT 1 FROM embeddings t WHERE t.vec_id = s.vec_id - 1)) GROUP BY reason""",
    "metrics_log": f"SELECT event_type AS run_id, count(*)::BIGINT AS n_rows, max(event_id // 10)::BIGINT AS last_step, {r6('avg(value)')} AS mean_value FROM events GROUP BY event_type",
    "snapshot_log": whole(*corpus(P.n_words))
    + "SELECT step, step IS NULL AS is_final, (SELECT count(*) FROM sp)::BIGINT AS n_rows, (SELECT sum(n) FROM sp)::BIGINT AS n FROM (VALUES (1::BIGINT), (2::BIGINT), (NULL)) x(step)",
    "tokenize_large": whole(*corpus(LARGE_WORDS)[:2])
    + f"""SELECT doc_id, count(word)::BIGINT AS n_tokens, md5(coalesce(string_agg(coalesce(tok, 3)::VARCHAR, ',' ORDER BY i) FILTER (word IS NOT NULL), '')) AS ids_md5
          FROM (SELECT d.doc_id, x.word, x.i FROM documents d LEFT JOIN LATERAL (SELECT unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT regexp_extract_all(d.text, '{PAT}', 1) AS w)) x ON true)
          LEFT JOIN voc USING (word) GROUP BY doc_id""",
    "instructions_without_id": _with("ins")
    + f"SELECT row_number() OVER (ORDER BY {CONTENT_KEY}) - 1 AS id, instruction, input, output FROM ins",
    "ordered_index": "SELECT l_orderkey, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last, count(*)::BIGINT AS n FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS idx FROM lineitem) GROUP BY l_orderkey",
}
