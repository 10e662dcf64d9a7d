"""SQL that replays training: parameters folded over the rows of every shard, one row a step,
in the order of md5, and averaged after every round by a recursive query.

A parameter vector is a list of the coefficients with the intercept last; a row's vector has
1 there. Rounds are folded to the end of the setting for every alpha; where patience ran
out is decided afterwards, from the losses.
"""

from __future__ import annotations

# Fixed values, as in the settings: step size, damping of the intercept, shards of a bank,
# rounds, patience, seed of the orders, least fall of a loss that the baseline counts.
STEP = 0.01
INTERCEPT_DECAY = 0.01
SHARDS = 4
ROUNDS = 30
PATIENCE = 3
SEED = 42
BASELINE_IMPROVEMENT = 1e-12
ALPHAS = (1e-5, 1e-3)

N_NUMERIC = 6
# Steps that refer to themselves.
RECURSIVE = {"federated", "baseline"}


def _fold(rows: str, start: str, alpha: str) -> str:
    """Parameters after one pass over ``rows``, a list of structs (x, y), from ``start``."""
    z = "list_dot_product(acc.x, r.x)"
    step = f"{STEP} * (1 / (1 + exp(-({z}))) - r.y)"
    new = f"""list_transform(list_zip(acc.x, r.x), lambda p, k: CASE WHEN k < len(acc.x)
        THEN p[1] * greatest(0.0, 1 - {STEP} * {alpha}) - g * p[2] ELSE p[1] - g * {INTERCEPT_DECAY} END)"""
    # The step is bound once a row, as the only element of a list.
    bound = f"list_transform([{step}], lambda g: {new})[1]"
    return f"list_reduce({rows}, lambda acc, r: {{'x': {bound}, 'y': 0.0::DOUBLE}}, {{'x': {start}, 'y': 0.0::DOUBLE}}).x"


def _averaged(keys: str, source: str) -> str:
    """(keys, w, n_train): the mean of w by n."""
    return f"""
    SELECT {keys}, list_transform(range(1, len(ws[1].w) + 1), lambda k:
               list_sum(list_transform(ws, lambda m: m.w[k] * m.n)) / n_train) AS w, n_train
    FROM (SELECT {keys}, list({{'w': w, 'n': n}}) AS ws, sum(n) AS n_train FROM {source} GROUP BY {keys})"""


def ctes(probability, loss_sums) -> dict[str, tuple[tuple[str, ...], str]]:
    """The steps, on top of ``encoded`` and ``plan``; ``probability`` and ``loss_sums`` give
    the SQL of a score and of weighted losses."""
    dot = "list_dot_product(m.w, e.x)"
    grid = ", ".join(f"({i}, CAST({a!r} AS DOUBLE))" for i, a in enumerate(ALPHAS))

    def scored(models: str, keys: str, banks: str) -> str:
        return f"""SELECT {keys}, e.bank_id, e.split, e.y, {probability(dot)} AS score
            FROM vectors e JOIN {models} m ON {banks}"""

    def stopped(log: str, keys: str, better: str) -> str:
        """Rounds up to where patience ran out, with the best so far."""
        return f"""SELECT * FROM (SELECT *, min(CASE WHEN round - best_round >= {PATIENCE} THEN round END)
                OVER (PARTITION BY {keys}) AS last_round
              FROM (SELECT *, max(CASE WHEN {better} THEN round END) OVER (PARTITION BY {keys} ORDER BY round) AS best_round,
                      min(loss) OVER (PARTITION BY {keys} ORDER BY round) AS best_loss
                    FROM (SELECT *, min(loss) OVER (PARTITION BY {keys} ORDER BY round
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_before FROM {log})))
            WHERE last_round IS NULL OR round <= last_round"""

    return {
        "grid": ((), f"SELECT * FROM (VALUES {grid}) AS t(alpha_order, alpha)"),
        "vectors": (
            ("encoded", "plan"),
            f"""SELECT acct_id, bank_id, split, y, list_concat(num, list_transform(
                       range({N_NUMERIC}, (SELECT count(*) FROM plan)),
                       lambda k: CASE WHEN cat = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), [1.0::DOUBLE]) AS x
                FROM encoded""",
        ),
        "shard_rows": (
            ("vectors",),
            f"""SELECT bank_id, shard, round, count(*) AS n,
                       list({{'x': x, 'y': y::DOUBLE}} ORDER BY md5('{SEED}:' || round || ':1:' || acct_id)) AS rows
                FROM (SELECT *, ('0x' || substr(md5('shard:' || acct_id), 1, 8))::BIGINT % {SHARDS} AS shard
                      FROM vectors WHERE split = 'train'),
                     (SELECT unnest(range(1, {ROUNDS} + 1)) AS round)
                GROUP BY bank_id, shard, round""",
        ),
        "zeros": (
            ("plan",),
            "SELECT list_transform(range(0, count(*) + 1), lambda k: 0.0::DOUBLE) AS w FROM plan",
        ),
        "first_pass": (
            ("shard_rows", "zeros", "grid"),
            f"""SELECT g.alpha, s.bank_id, s.shard, s.n, {_fold('s.rows', 'z.w', 'g.alpha')} AS w
                FROM shard_rows s, zeros z, grid g WHERE s.round = 1""",
        ),
        "first_local": (("first_pass",), _averaged("alpha, bank_id", "first_pass")),
        "federated": (
            ("shard_rows", "zeros", "grid"),
            f"""SELECT 0 AS round, g.alpha, z.w, 0::HUGEINT AS n_train FROM zeros z, grid g
                UNION ALL
                {_averaged('round, alpha', f'''(
                    SELECT s.round::INTEGER AS round, f.alpha, s.n, {_fold('s.rows', 'f.w', 'f.alpha')} AS w
                    FROM federated f JOIN shard_rows s ON s.round = f.round + 1)''')}""",
        ),
        "federated_scores": (
            ("federated", "vectors"),
            f"""SELECT m.alpha, m.round, e.bank_id, e.y, {probability(dot)} AS score
                FROM vectors e, federated m WHERE m.round > 0 AND e.split = 'val'""",
        ),
        "federated_losses": (("federated_scores",), loss_sums("federated_scores", "alpha, round, bank_id")),
        "federated_log": (
            ("federated_losses",),
            """SELECT alpha, round, sum(wloss_sum) / sum(w_sum) AS loss FROM federated_losses GROUP BY alpha, round""",
        ),
        "federated_path": (
            ("federated_log",),
            stopped("federated_log", "alpha", "least_before IS NULL OR loss < least_before"),
        ),
        "federated_best": (
            ("federated_path", "federated", "grid"),
            """SELECT f.alpha, f.round, f.w FROM federated f JOIN (
                 SELECT p.alpha, p.round FROM federated_path p JOIN grid g ON g.alpha = p.alpha
                 ORDER BY p.loss, g.alpha_order, p.round LIMIT 1) b
               ON b.alpha = f.alpha AND b.round = f.round""",
        ),
        "baseline_start": (
            ("vectors", "zeros", "grid"),
            f"""SELECT 0 AS round, g.alpha, v.bank_id, {_fold('v.rows', 'z.w', 'g.alpha')} AS w, 0::HUGEINT AS n_train
                FROM (SELECT bank_id, [first({{'x': x, 'y': y::DOUBLE}} ORDER BY md5('{SEED}:' || acct_id))] AS rows
                      FROM vectors WHERE split = 'train' GROUP BY bank_id) v, zeros z, grid g""",
        ),
        "baseline": (
            ("shard_rows", "baseline_start"),
            f"""SELECT round, alpha, bank_id, w, n_train FROM baseline_start
                UNION ALL
                {_averaged('round, alpha, bank_id', f'''(
                    SELECT s.round::INTEGER AS round, f.alpha, f.bank_id, s.n, {_fold('s.rows', 'f.w', 'f.alpha')} AS w
                    FROM baseline f JOIN shard_rows s ON s.round = f.round + 1 AND s.bank_id = f.bank_id)''')}""",
        ),
        "baseline_scores": (
            ("baseline", "vectors"),
            f"""SELECT m.alpha, m.round, e.bank_id, e.y, {probability(dot)} AS score
                FROM vectors e JOIN baseline m ON m.bank_id = e.bank_id WHERE m.round > 0 AND e.split = 'val'""",
        ),
        "baseline_losses": (("baseline_scores",), loss_sums("baseline_scores", "alpha, round, bank_id")),
        "baseline_log": (
            ("baseline_losses",),
            "SELECT alpha, round, bank_id, wloss_sum / w_sum AS loss FROM baseline_losses",
        ),
        "baseline_path": (
            ("baseline_log",),
            stopped(
                "baseline_log", "alpha, bank_id", f"least_before IS NULL OR loss < least_before - {BASELINE_IMPROVEMENT}"
            ),
        ),
        "baseline_best": (
            ("baseline_path", "baseline", "grid"),
            """SELECT b.bank_id, b.alpha, b.round, b.loss, m.w FROM (
                 SELECT p.*, row_number() OVER (PARTITION BY p.bank_id ORDER BY p.loss, g.alpha_order, p.round) AS place
                 FROM baseline_path p JOIN grid g ON g.alpha = p.alpha) b
               JOIN baseline m ON m.alpha = b.alpha AND m.bank_id = b.bank_id AND m.round = b.round
               WHERE b.place = 1""",
        ),
        # What the reports score, under the names that the metric steps read.
        "kept_models": (
            ("federated_best", "baseline_best"),
            """SELECT 'federated' AS model, b.bank_id, f.w FROM federated_best f, (SELECT DISTINCT bank_id FROM baseline_best) b
               UNION ALL SELECT 'local', bank_id, w FROM baseline_best""",
        ),
        "kept_scores": (
            ("kept_models", "vectors"),
            scored("kept_models", "m.model", "m.bank_id = e.bank_id"),
        ),
        # Every round's global model, and the local ones that were averaged into it.
        "round_passes": (
            ("federated", "shard_rows"),
            f"""SELECT s.round, f.alpha, s.bank_id, s.n, {_fold('s.rows', 'f.w', 'f.alpha')} AS w
                FROM federated f JOIN shard_rows s ON s.round = f.round + 1""",
        ),
        "round_locals": (("round_passes",), _averaged("round, alpha, bank_id", "round_passes")),
        "round_models": (
            ("federated", "round_locals"),
            """SELECT 'global' AS model, f.round::INTEGER AS round, f.alpha, b.bank_id, f.w
               FROM federated f, (SELECT DISTINCT bank_id FROM round_locals) b WHERE f.round > 0
               UNION ALL SELECT 'local', round::INTEGER, alpha, bank_id, w FROM round_locals""",
        ),
        "round_scores": (
            ("round_models", "vectors"),
            f"""SELECT m.model, m.alpha, m.round, e.bank_id, e.y, {probability(dot)} AS score
                FROM vectors e JOIN round_models m ON m.bank_id = e.bank_id WHERE e.split = 'val'""",
        ),
    }
