"""DuckDB-runnable SQL for the registered queries (the correctness oracle).

Written independently of the Spark plans: windows (lag/lead, global
row_number) where the Spark side uses joins and bucket offsets, so that the
check compares two different derivations of the same result. CTEs are
defined once and pulled in with their dependencies.
"""

from __future__ import annotations

from ..config import PINS

P = PINS
PAT = "([A-Za-zÀ-ÿ]+|[0-9]+|[^ \\t\\n\\r])"
THRESH = "028f5c29"  # 1 % of 2^32, as 8 hex digits
SEED = P.seed
V = P.vocab_size


def tok(expr: str) -> str:
    """Token ids of a text expression (needs CTE ``vm`` in FROM)."""
    bos = "[1] || " if P.add_bos else ""
    return f"({bos}list_transform(regexp_extract_all({expr}, '{PAT}', 1), lambda w: coalesce(vm.m[w], 3)))"


def csv(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 12))::BIGINT / 281474976710656.0)"


def r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


SRC = (
    "'[INST] ' || CASE WHEN coalesce(input, '') <> '' THEN instruction || chr(10) || input "
    "ELSE instruction END || ' [/INST]' || ' '"
)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    # ---- S1 adapter: lag/lead over turns ------------------------------------
    "ins": (
        """SELECT ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn)::BIGINT AS id,
              CASE WHEN prev_role = 'system' THEN prev_text ELSE text END AS instruction,
              CASE WHEN prev_role = 'system' THEN text ELSE '' END AS input,
              next_text AS output
           FROM (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text,
                        lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
                 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
           WHERE role = 'user' AND next_role = 'assistant'""",
        (),
    ),
    # ---- vocabulary: top words by (count desc, word asc) ----------------------
    "vocab": (
        f"""SELECT word, (rn + 3)::INTEGER AS tok FROM (
              SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS rn FROM (
                SELECT word, count(*) AS cnt FROM (
                  SELECT unnest(regexp_extract_all(text, '{PAT}', 1)) AS word FROM conversations)
                GROUP BY word))
            WHERE rn <= {P.n_words}""",
        (),
    ),
    "vm": ("SELECT map_from_entries(list(struct_pack(k := word, v := tok))) AS m FROM vocab", ("vocab",)),
    # ---- prompts (P1-P3, P5) ---------------------------------------------------
    "prm": (f"SELECT id, {SRC} AS text FROM ins", ("ins",)),
    "prm_tok": (
        f"SELECT id, text, ids, len(ids)::BIGINT AS n_tokens FROM (SELECT id, text, {tok('text')} AS ids FROM prm, vm)",
        ("prm", "vm"),
    ),
    "prm_f": (f"SELECT * FROM prm_tok WHERE n_tokens < {P.prompt_limit}", ("prm_tok",)),
    # ---- offline examples (B1 split, P4, P5, F2, P6, P7) ------------------------
    "ins_s": (
        f"SELECT *, CASE WHEN substr(md5('{SEED}:' || id), 1, 8) < '{THRESH}' THEN 'test' ELSE 'train' END AS split FROM ins",
        ("ins",),
    ),
    "ex1": (
        f"""SELECT id, split, {tok('src')}[1:2048] AS source_ids, {tok('src || output')}[1:2048] AS ids
            FROM (SELECT id, split, output, {SRC} AS src FROM ins_s), vm""",
        ("ins_s", "vm"),
    ),
    "ex": (
        f"""SELECT id, split, ids AS input_ids, len(ids)::BIGINT AS n_tokens, source_len,
                   CASE WHEN split = 'test'
                        THEN list_transform(ids, lambda x, i: CASE WHEN i <= source_len THEN -100 ELSE x END)
                        ELSE ids END AS labels
            FROM (SELECT *, len(list_filter(source_ids, lambda x: x <> 2))::BIGINT AS source_len FROM ex1)
            WHERE len(ids) < {P.model_max_length}""",
        ("ex1",),
    ),
    # ---- B2-B4 per split --------------------------------------------------------
    "ex_idx": (
        f"""SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:' || id), id) - 1 AS idx
              FROM ex WHERE split = 'train'
            UNION ALL
            SELECT *, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS idx
              FROM ex WHERE split <> 'train'""",
        ("ex",),
    ),
    "ex_cnt": ("SELECT split, count(*) AS n FROM ex GROUP BY split", ("ex",)),
    "ex_pad": (
        f"""SELECT i.*, false AS is_pad FROM ex_idx i
            UNION ALL
            SELECT i.* REPLACE (i.idx + c.n AS idx), true AS is_pad FROM ex_idx i JOIN ex_cnt c USING (split)
            WHERE i.idx < ceil(c.n / {P.world_size}.0) * {P.world_size} - c.n""",
        ("ex_idx", "ex_cnt"),
    ),
    "ex_b": (
        f"""SELECT *, (idx % {P.world_size})::INTEGER AS rank, (idx // {P.world_size})::BIGINT AS slot,
                   (idx // {P.world_size} // {P.batch_size})::BIGINT AS batch_no,
                   (idx // {P.world_size} % {P.batch_size})::INTEGER AS pos_in_batch
            FROM ex_pad""",
        ("ex_pad",),
    ),
    "ex_col": (
        f"""SELECT *, list_transform(pids, lambda x: x <> 2) AS mask FROM (
              SELECT *, input_ids || list_transform(range(width - len(input_ids)), lambda x: 2) AS pids,
                        labels || list_transform(range(width - len(labels)), lambda x: -100) AS plabels
              FROM (SELECT *, (max(len(input_ids)) OVER (PARTITION BY split, rank, batch_no))::INTEGER AS width FROM ex_b))""",
        ("ex_b",),
    ),
    "ex_ep": (
        f"""SELECT b.*, e.epoch::INTEGER AS epoch,
                   (e.epoch * ceil(ceil(c.n / {P.world_size}.0) / {P.batch_size}) + b.batch_no)::BIGINT AS step
            FROM ex_b b JOIN ex_cnt c USING (split), (SELECT unnest(range({P.epochs})) AS epoch) e
            WHERE b.split = 'train'""",
        ("ex_b", "ex_cnt"),
    ),
}


def _lm(name: str, corpus: str, alpha: float) -> dict[str, tuple[str, tuple[str, ...]]]:
    k = P.unigram_k
    return {
        f"bg_{name}": (
            f"""SELECT s[i] AS ctx, s[i + 1] AS tok, count(*) AS n
                FROM (SELECT [1] || {tok('text')} || [2] AS s FROM ({corpus}), vm), unnest(range(1, len(s))) AS r(i)
                GROUP BY 1, 2""",
            ("vm",),
        ),
        f"lm_{name}": (
            f"""SELECT g.ctx::INTEGER AS ctx, g.tok::INTEGER AS tok,
                       ln((coalesce(b.n, 0) + {alpha} * (coalesce(u.n, 0) + {k}) / (tot.n + {k} * {V}))
                          / (coalesce(c.n, 0) + {alpha})) AS logp
                FROM (SELECT c.ctx, t.tok FROM range(1, {V} + 1) c(ctx), range(1, {V} + 1) t(tok)) g
                LEFT JOIN bg_{name} b ON b.ctx = g.ctx AND b.tok = g.tok
                LEFT JOIN (SELECT ctx, sum(n) AS n FROM bg_{name} GROUP BY ctx) c ON c.ctx = g.ctx
                LEFT JOIN (SELECT tok, sum(n) AS n FROM bg_{name} GROUP BY tok) u ON u.tok = g.tok,
                (SELECT sum(n) AS n FROM bg_{name}) tot""",
            (f"bg_{name}",),
        ),
    }


CTES.update(_lm("t", "SELECT text FROM documents WHERE lang = 'en' UNION ALL SELECT text FROM conversations", P.teacher_alpha))
CTES.update(_lm("s", "SELECT text FROM conversations WHERE conv_id % 2 = 0", P.student_alpha))
CTES.update(
    {
        "cdiv": (
            f"""SELECT ctx, sum(exp(lp) * (lp - lq)) AS kl_ts, sum(exp(lq) * (lq - lp)) AS kl_st,
                       0.5 * sum(exp(lm) * (lm - lp)) + 0.25 * sum(exp(lm) * (lm - lq)) AS jsd_ref
                FROM (SELECT t.ctx, t.logp AS lp, s.logp AS lq, ln(0.5 * exp(t.logp) + 0.5 * exp(s.logp)) AS lm
                      FROM lm_t t JOIN lm_s s ON s.ctx = t.ctx AND s.tok = t.tok)
                GROUP BY ctx""",
            ("lm_t", "lm_s"),
        ),
        "pos": (
            """SELECT id, split, rank, batch_no, (i - 1)::INTEGER AS pos, input_ids[i] AS ctx, input_ids[i + 1] AS next_tok
               FROM (SELECT *, unnest(range(1, len(input_ids))) AS i FROM ex_b)
               WHERE input_ids[i + 1] <> 2""",
            ("ex_b",),
        ),
        "bdiv": (
            """SELECT split, rank, batch_no, count(*)::BIGINT AS n_positions,
                      avg(kl_ts) AS kl_ts, avg(kl_st) AS kl_st, avg(jsd_ref) AS jsd_ref
               FROM pos JOIN cdiv USING (ctx) GROUP BY split, rank, batch_no""",
            ("pos", "cdiv"),
        ),
        "els": (
            """SELECT vec_id, i, x - lse AS lp FROM (
                 SELECT vec_id, i, x, mx + ln(sum(exp(x - mx)) OVER w) AS lse FROM (
                   SELECT vec_id, i, x::DOUBLE AS x, max(x::DOUBLE) OVER (PARTITION BY vec_id) AS mx
                   FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, i))
                 WINDOW w AS (PARTITION BY vec_id))""",
            (),
        ),
        "epair": (
            """SELECT t.vec_id AS pair_id, t.i, t.lp, s.lp AS lq, ln(0.5 * exp(t.lp) + 0.5 * exp(s.lp)) AS lm,
                      ln(%(b)s * exp(t.lp) + (1 - %(b)s) * exp(s.lp)) AS lmb
               FROM els t JOIN els s ON s.vec_id = t.vec_id + 1 AND s.i = t.i""" % {"b": P.jsd_beta},
            ("els",),
        ),
        "epair_div": (
            f"""SELECT pair_id, sum(exp(lp) * (lp - lq)) AS kl_ts, sum(exp(lq) * (lq - lp)) AS kl_st,
                       0.5 * sum(exp(lm) * (lm - lp)) + 0.25 * sum(exp(lm) * (lm - lq)) AS jsd_ref,
                       {P.jsd_beta} * sum(exp(lp) * (lp - lmb)) + (1 - {P.jsd_beta}) * sum(exp(lq) * (lq - lmb)) AS jsd_beta
                FROM epair GROUP BY pair_id""",
            ("epair",),
        ),
    }
)


def _sampler(name: str, stop: bool) -> dict[str, tuple[str, tuple[str, ...]]]:
    stop_sql = "AND s.ctx <> 2" if stop else ""
    return {
        name: (
            f"""SELECT id, 0 AS step, ids[len(ids)] AS ctx, greatest(0, {P.max_tokens} - n_tokens) AS budget FROM prm_f
                UNION ALL
                SELECT s.id, s.step + 1, min(c.tok), s.budget
                FROM {name} s JOIN cdf c ON c.ctx = s.ctx
                WHERE s.step < s.budget {stop_sql}
                  AND c.hi > {uniform(f"'{SEED}:' || s.id || ':' || (s.step + 1)")}
                GROUP BY s.id, s.step, s.budget""",
            ("prm_f", "cdf"),
        ),
        f"{name}_agg": (
            f"""SELECT p.id, coalesce(list(s.ctx ORDER BY s.step) FILTER (WHERE s.step > 0), []) AS new_ids
                FROM prm_f p LEFT JOIN {name} s ON s.id = p.id GROUP BY p.id""",
            (name,),
        ),
    }


CTES.update(
    {
        "cdf": (
            f"""SELECT ctx, tok, CASE WHEN tok = {V} THEN 1.0 ELSE round(sum(exp(logp)) OVER (
                       PARTITION BY ctx ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 12) END AS hi
                FROM lm_s""",
            ("lm_s",),
        ),
        "pidx": ("SELECT id, ids, n_tokens, row_number() OVER (ORDER BY id) - 1 AS idx FROM prm_f", ("prm_f",)),
        "pb": (
            f"""SELECT *, (idx % {P.world_size})::INTEGER AS rank, (idx // {P.world_size} // {P.batch_size})::BIGINT AS batch_no,
                       greatest(0, {P.max_tokens} - n_tokens)::INTEGER AS budget,
                       greatest(0, {P.max_tokens} - max(n_tokens) OVER (PARTITION BY idx % {P.world_size}, idx // {P.world_size} // {P.batch_size}))::INTEGER AS budget_batch
                FROM (SELECT *, false AS is_pad FROM pidx
                      UNION ALL
                      SELECT p.* REPLACE (p.idx + c.n AS idx), true FROM pidx p, (SELECT count(*) AS n FROM prm_f) c
                      WHERE p.idx < ceil(c.n / {P.world_size}.0) * {P.world_size} - c.n)""",
            ("pidx",),
        ),
    }
)
CTES.update(_sampler("samp", True))
CTES.update(_sampler("raw", False))
CTES.update(
    {
        "onp": (
            """SELECT b.id, b.rank, b.batch_no, b.is_pad, b.ids || a.new_ids AS full_ids, len(a.new_ids) AS n_new
               FROM pb b JOIN samp_agg a USING (id)""",
            ("pb", "samp_agg"),
        ),
        "onp_pos": (
            """SELECT id, rank, batch_no, full_ids[i] AS ctx
               FROM (SELECT *, unnest(range(1, len(full_ids))) AS i FROM onp) WHERE full_ids[i + 1] <> 0""",
            ("onp",),
        ),
    }
)


def r9(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 9) + 0.0)"


CTES.update(
    {
        "man0": (
            """SELECT DISTINCT user_id AS run_id, CASE WHEN event_type = 'signup' THEN NULL ELSE event_id // 10 END AS step,
                      event_type = 'signup' AS is_final FROM events""",
            (),
        ),
        "man": (
            "SELECT *, 'run-' || run_id || '/step-' || coalesce(step::VARCHAR, 'final') AS path FROM man0",
            ("man0",),
        ),
        "rmean": (
            """SELECT step, metric, avg(v) AS value, count(*)::BIGINT AS n_ranks FROM (
                 SELECT event_id // 10 AS step, user_id % 2 AS rank, event_type AS metric, avg(value) AS v
                 FROM events GROUP BY 1, 2, 3) GROUP BY step, metric""",
            (),
        ),
        "tr0": ("SELECT rank, ctx FROM pos WHERE split = 'train' AND batch_no = 0", ("pos",)),
        "wc": (
            f"""SELECT ctx, sum(cnt / ({P.world_size}.0 * n)) AS w
                FROM (SELECT rank, ctx, count(*) AS cnt FROM tr0 GROUP BY rank, ctx) a
                JOIN (SELECT rank, count(*) AS n FROM tr0 GROUP BY rank) b USING (rank) GROUP BY ctx""",
            ("tr0",),
        ),
        "sls": (
            """SELECT ctx, tok, logp AS logit, (logp - mx) - ln(sum(exp(logp - mx)) OVER (PARTITION BY ctx)) AS ls
               FROM (SELECT *, max(logp) OVER (PARTITION BY ctx) AS mx FROM lm_s)""",
            ("lm_s",),
        ),
        "gj": (
            """SELECT s.ctx, s.tok, s.logit, s.ls, t.logp AS lp, coalesce(w.w, 0) AS w,
                      ln(0.5 * exp(t.logp) + 0.5 * exp(s.ls)) AS lm
               FROM sls s JOIN lm_t t ON t.ctx = s.ctx AND t.tok = s.tok LEFT JOIN wc w ON w.ctx = s.ctx""",
            ("sls", "lm_t", "wc"),
        ),
        "g_rkl": (
            "SELECT ctx, tok, logit, w * (exp(ls) - exp(lp)) AS g, w * exp(lp) * (lp - ls) AS lt FROM gj",
            ("gj",),
        ),
        "g_jsd": (
            """SELECT ctx, tok, w * exp(ls) * (d - sum(exp(ls) * d) OVER (PARTITION BY ctx)) AS g FROM (
                 SELECT *, 0.25 * (lm - lp + 1) + 0.125 * (lm - ls + 1) - 0.25 * exp(lm) / exp(ls) AS d FROM gj)""",
            ("gj",),
        ),
        "clip": (
            "SELECT sqrt(sum(g * g)) AS norm, least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS f, sum(lt) AS loss FROM g_rkl",
            ("g_rkl",),
        ),
        "adam1": (
            f"""SELECT ctx, tok, logit * (1 - {P.learning_rate} * {P.weight_decay})
                         - ({P.learning_rate} / (1 - 0.9)) * m / (sqrt(v) / sqrt(1 - 0.999) + 1e-8) AS logit, m, v
                FROM (SELECT ctx, tok, logit, (1 - 0.9) * g * clip.f AS m, (1 - 0.999) * (g * clip.f) * (g * clip.f) AS v
                      FROM g_rkl, clip)""",
            ("g_rkl", "clip"),
        ),
    }
)


def with_(*names: str, recursive: bool = False) -> str:
    """WITH clause holding ``names`` and everything they depend on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n"


def doc_tokens() -> str:
    return f"SELECT doc_id, {tok('text')} AS ids FROM documents, vm"


QUERIES: dict[str, str] = {
    "instructions": with_("ins") + "SELECT id, instruction, input, output FROM ins",
    "user_content": with_("ins")
    + "SELECT id, CASE WHEN coalesce(input, '') <> '' THEN instruction || chr(10) || input ELSE instruction END AS content FROM ins",
    "render_prompt": with_("prm") + "SELECT id, text FROM prm",
    "build_prompts": with_("prm_tok") + "SELECT id, text, n_tokens FROM prm_tok",
    "build_examples": with_("ins")
    + f"SELECT id, {SRC} AS source, {SRC} || output AS example FROM ins",
    "tokenize": with_("vm")
    + f"SELECT doc_id, len(ids)::BIGINT AS n_tokens, coalesce(list_sum(ids), 0)::BIGINT AS id_sum, {csv('ids[1:2048]')} AS ids FROM ({doc_tokens()})",
    "tokenize_plugin": with_("vm")
    + f"SELECT doc_id, len(ids)::BIGINT AS n_tokens, coalesce(list_sum(ids), 0)::BIGINT AS id_sum, {csv('ids[1:2048]')} AS ids FROM ({doc_tokens()})",
    "filter_prompt_length": with_("prm_f") + "SELECT id, n_tokens FROM prm_f",
    "truncate_ids": with_("prm_tok") + f"SELECT id, {csv(f'ids[1:{P.truncate_len}]')} AS ids FROM prm_tok",
    "filter_example_length": with_("ex") + "SELECT id, split, n_tokens FROM ex",
    "token_count": with_("ex") + "SELECT id, source_len FROM ex",
    "mask_source": with_("ex") + f"SELECT id, split, {csv('labels')} AS labels FROM ex",
    "split_hash": f"SELECT doc_id, CASE WHEN substr(md5('{SEED}:' || doc_id), 1, 8) < '{THRESH}' THEN 'test' ELSE 'train' END AS split FROM documents",
    "split_exact": f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id)
                              <= ceil(0.01 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents""",
    "shuffle_index": f"SELECT doc_id, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1)::BIGINT AS idx FROM documents",
    "shard": with_("ex_b") + "SELECT id, split, idx::BIGINT AS idx, rank, slot, is_pad FROM ex_b",
    "assign_batches": with_("ex_b") + "SELECT id, split, rank, batch_no, pos_in_batch, is_pad FROM ex_b",
    "collate_rows": with_("ex_col")
    + f"""SELECT id, split, rank, batch_no, pos_in_batch, width, {csv('pids')} AS input_ids, {csv('plabels')} AS labels,
                 array_to_string(list_transform(mask, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS attention_mask
          FROM ex_col""",
    "attention_mask": with_("ex_col")
    + """SELECT id, split, rank, batch_no, pos_in_batch,
                array_to_string(list_transform(mask, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS attention_mask,
                len(list_filter(mask, lambda x: x))::BIGINT AS n_attended
         FROM ex_col""",
    "collate_batches": with_("ex_col")
    + f"""SELECT split, rank, batch_no, count(*)::BIGINT AS n_rows, max(width) AS width,
                 string_agg({csv('pids')}, ';' ORDER BY pos_in_batch) AS input_ids
          FROM ex_col GROUP BY split, rank, batch_no""",
    "epochs": with_("ex_ep") + "SELECT id, rank, batch_no, pos_in_batch, epoch, step FROM ex_ep",
    "skip_batches": with_("ex_ep") + f"SELECT id, rank, batch_no, epoch, step FROM ex_ep WHERE batch_no >= {P.skip_batches}",
    "limit_eval_batches": with_("ex_b") + f"SELECT id, split, rank, batch_no FROM ex_b WHERE batch_no <= {P.eval_cap}",
    "limit_steps": with_("ex_ep") + f"SELECT id, rank, epoch, step FROM ex_ep WHERE step < {P.max_steps}",
    "log_softmax": with_("els") + f"SELECT vec_id, (i - 1)::INTEGER AS pos, {r6('lp')} AS value FROM els",
    "kl_teacher_student": with_("epair_div") + f"SELECT pair_id, {r6('kl_ts')} AS value FROM epair_div",
    "kl_student_teacher": with_("epair_div") + f"SELECT pair_id, {r6('kl_st')} AS value FROM epair_div",
    "jsd_reference": with_("epair_div") + f"SELECT pair_id, {r6('jsd_ref')} AS value FROM epair_div",
    "jsd_beta": with_("epair_div") + f"SELECT pair_id, {r6('jsd_beta')} AS value FROM epair_div",
    "batch_divergence": with_("epair_div")
    + f"""SELECT (pair_id % {P.world_size})::INTEGER AS rank, (pair_id // {P.world_size} // {P.batch_size})::BIGINT AS batch_no,
                 count(*)::BIGINT AS n_positions, {r6('avg(kl_ts)')} AS kl_ts, {r6('avg(kl_st)')} AS kl_st,
                 {r6('avg(jsd_ref)')} AS jsd_ref
          FROM epair_div GROUP BY 1, 2""",
    "table_lm": with_("lm_t", "lm_s")
    + f"SELECT 'teacher' AS model, ctx, tok, {r6('logp')} AS logp FROM lm_t UNION ALL SELECT 'student', ctx, tok, {r6('logp')} FROM lm_s",
    "align_positions": with_("pos") + "SELECT * FROM pos",
    "score_teacher": with_("pos", "lm_t")
    + f"""SELECT id, split, rank, batch_no, pos, {r6('t.logp')} AS teacher_logp
          FROM pos p JOIN lm_t t ON t.ctx = p.ctx AND t.tok = p.next_tok""",
    "score_pair": with_("pos", "cdiv")
    + f"""SELECT id, split, pos, {r6('t.logp')} AS teacher_logp, {r6('s.logp')} AS student_logp,
                 {r6('d.kl_ts')} AS kl_ts, {r6('d.kl_st')} AS kl_st, {r6('d.jsd_ref')} AS jsd_ref
          FROM pos p JOIN lm_t t ON t.ctx = p.ctx AND t.tok = p.next_tok
          JOIN lm_s s ON s.ctx = p.ctx AND s.tok = p.next_tok JOIN cdiv d ON d.ctx = p.ctx""",
    "score_pair_mapped": with_("pos", "cdiv")
    + f"""SELECT id, split, pos, {r6('d.kl_ts')} AS kl_ts, {r6('d.kl_st')} AS kl_st, {r6('d.jsd_ref')} AS jsd_ref
          FROM pos p JOIN cdiv d ON d.ctx = p.ctx""",
    "offline_batch_divergence": with_("bdiv")
    + f"SELECT split, rank, batch_no, n_positions, {r6('kl_ts')} AS kl_ts, {r6('kl_st')} AS kl_st, {r6('jsd_ref')} AS jsd_ref FROM bdiv",
    "evaluate_mean_of_means": with_("bdiv")
    + f"""SELECT split, metric, {r6('avg(v)')} AS value, count(*)::BIGINT AS n_batches FROM (
            SELECT split, 'reverse_kl' AS metric, kl_ts AS v FROM bdiv UNION ALL
            SELECT split, 'forward_kl', kl_st FROM bdiv UNION ALL
            SELECT split, 'jsd_p_q', jsd_ref FROM bdiv) GROUP BY split, metric""",
    "evaluate_weighted": with_("bdiv")
    + f"""SELECT split, metric, {r6('sum(v * n_positions) / sum(n_positions)')} AS value, count(*)::BIGINT AS n_batches FROM (
            SELECT split, n_positions, 'weighted_reverse_kl' AS metric, kl_ts AS v FROM bdiv UNION ALL
            SELECT split, n_positions, 'weighted_forward_kl', kl_st FROM bdiv UNION ALL
            SELECT split, n_positions, 'weighted_jsd_p_q', jsd_ref FROM bdiv) GROUP BY split, metric""",
    "generation_budget": with_("pb") + "SELECT id, rank, batch_no, is_pad, budget, budget_batch FROM pb",
    "sample_continuations": with_("samp_agg", recursive=True)
    + f"SELECT id, len(new_ids)::BIGINT AS n_new, {csv('new_ids')} AS new_ids FROM samp_agg",
    "truncate_after_eos": with_("raw_agg", recursive=True)
    + f"""SELECT id, len(t)::BIGINT AS n_new, {csv('t')} AS new_ids FROM (
            SELECT id, CASE WHEN list_position(new_ids, 2) > 0 THEN new_ids[1:list_position(new_ids, 2)] ELSE new_ids END AS t
            FROM raw_agg)""",
    "onpolicy_mask": with_("onp", recursive=True)
    + """SELECT id, rank, batch_no, is_pad, len(full_ids)::BIGINT AS n_total,
                array_to_string(list_transform(full_ids, lambda x: CASE WHEN x <> 0 THEN '1' ELSE '0' END), '') AS mask
         FROM onp""",
    "onpolicy_divergence": with_("onp_pos", "cdiv", recursive=True)
    + f"""SELECT rank, batch_no, count(*)::BIGINT AS n_positions, {r6('avg(kl_ts)')} AS kl_ts, {r6('avg(kl_st)')} AS kl_st,
                 {r6('avg(jsd_ref)')} AS jsd_ref
          FROM onp_pos JOIN cdiv USING (ctx) GROUP BY rank, batch_no""",
    "generation_stats": with_("onp", recursive=True)
    + f"""SELECT rank, batch_no, count(*)::BIGINT AS n_rows, sum(n_new)::BIGINT AS new_tokens,
                 sum(CASE WHEN list_contains(full_ids[len(full_ids) - n_new + 1:], 2) THEN 1 ELSE 0 END)::BIGINT AS n_finished,
                 {r6('sum(CASE WHEN list_contains(full_ids[len(full_ids) - n_new + 1:], 2) THEN 1 ELSE 0 END) / count(*)')} AS completed_share
          FROM onp GROUP BY rank, batch_no""",
    "rank_mean": with_("rmean") + f"SELECT step, metric, {r6('value')} AS value, n_ranks FROM rmean",
    "prefix_metric": with_("rmean") + f"SELECT step, 'train/' || metric AS name, {r6('value')} AS value FROM rmean",
    "latest_snapshot": with_("man")
    + """SELECT run_id, step, is_final, path FROM (
           SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY is_final DESC, step DESC NULLS LAST) AS rn FROM man)
         WHERE rn = 1""",
    "expired_snapshots": with_("man")
    + """SELECT run_id, step, path FROM (
           SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM man WHERE NOT is_final)
         WHERE rn > 3""",
    "gradient_rkl": with_("g_rkl") + f"SELECT ctx, tok, {r9('g')} AS grad FROM g_rkl",
    "gradient_jsd": with_("g_jsd") + f"SELECT ctx, tok, {r9('g')} AS grad FROM g_jsd",
    "clip_gradient": with_("clip") + f"SELECT {r9('norm')} AS grad_norm, {r9('f')} AS clip_factor, {r9('loss')} AS loss FROM clip",
    "clip_gradient_tight": with_("clip")
    + f"SELECT {r9('norm')} AS grad_norm, {r9('least(1.0, 0.005 / (norm + 1e-6))')} AS clip_factor, {r9('norm * least(1.0, 0.005 / (norm + 1e-6))')} AS clipped_norm FROM clip",
    "instruction_rejects": """SELECT count(*)::BIGINT AS n_rows,
           coalesce(sum(CASE WHEN instruction IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS no_instruction,
           coalesce(sum(CASE WHEN output IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS no_output
         FROM (SELECT CASE WHEN s.conv_id IS NOT NULL THEN s.text ELSE u.text END AS instruction, a.text AS output
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
               LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system'
               WHERE u.role = 'user')
         WHERE instruction IS NULL OR output IS NULL""",
    "adamw_step": with_("adam1") + f"SELECT ctx, tok, {r9('logit')} AS logit, {r9('m')} AS m, round(v, 15) AS v FROM adam1",
    "lr_schedule": with_("ex_ep")
    + f"""SELECT DISTINCT step, {r9(f"CASE WHEN step < {P.warmup_steps} THEN {P.learning_rate} * step / {float(max(1, P.warmup_steps))} ELSE {P.learning_rate} END")} AS lr FROM ex_ep""",
    "prepared_roundtrip": with_("ex")
    + "SELECT split, count(*)::BIGINT AS n_rows, sum(n_tokens)::BIGINT AS n_tokens, sum(id)::BIGINT AS id_sum FROM ex GROUP BY split",
    "stream_prepare": with_("prm_tok")
    + f"""SELECT id, CASE WHEN substr(md5('{SEED}:' || id), 1, 8) < '{THRESH}' THEN 'test' ELSE 'train' END AS split, n_tokens
          FROM prm_tok WHERE n_tokens < {P.prompt_limit}""",
}
