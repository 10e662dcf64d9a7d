"""Plain SQL for every query that SQL can express, composed from shared CTEs.

The statements are written from the definition of each result, not from the Spark
plans: memberships as IN, ranks as one window over the whole stratum, curves as one
window over the whole bank.
"""

from __future__ import annotations

from ledgerweave.catalog import fixed_models as fixed
from ledgerweave.catalog import training_sql as training

BANKS = ("bank_l", "bank_m", "bank_s")
SECRET = "shared test secret"
MASK_ROUND = 3
SEED = 42
NUMERIC = (
    "initial_deposit",
    "out_sum",
    "in_sum",
    "net_flow",
    "in_max_daily_sum",
    "out_max_daily_sum",
)
METRICS = ("ap", "auc", "p", "r")
COMPARED = {
    "p": "test_p",
    "r": "test_r",
    "ap": "test_ap",
    "auc": "test_roc_auc",
    "wlogloss": "test_wlogloss",
    "f1": "test_f1",
}


def _features(ledger: str) -> str:
    """Account features over a ledger CTE."""
    return f"""
    SELECT a.acct_id, a.bank_id, a.initial_deposit, a.state,
           a.acct_id IN (SELECT acct_id FROM sar WHERE is_sar_text = 'YES') AS is_sar,
           CAST(coalesce(o.cnt, 0) AS BIGINT) AS out_cnt,
           CAST(coalesce(o.total, 0) AS DOUBLE) AS out_sum,
           CAST(coalesce(o.peers, 0) AS BIGINT) AS out_nuniq_bene,
           CAST(coalesce(n.cnt, 0) AS BIGINT) AS in_cnt,
           CAST(coalesce(n.total, 0) AS DOUBLE) AS in_sum,
           CAST(coalesce(n.peers, 0) AS BIGINT) AS in_nuniq_orig,
           CAST(coalesce(n.total, 0) - coalesce(o.total, 0) AS DOUBLE) AS net_flow,
           CAST(coalesce(ob.cnt, 0) AS BIGINT) AS out_max_daily_cnt,
           CAST(coalesce(ob.total, 0) AS DOUBLE) AS out_max_daily_sum,
           CAST(coalesce(nb.cnt, 0) AS BIGINT) AS in_max_daily_cnt,
           CAST(coalesce(nb.total, 0) AS DOUBLE) AS in_max_daily_sum
    FROM accounts a
    LEFT JOIN (SELECT orig_acct AS id, count(*) AS cnt, sum(base_amt) AS total,
                      count(DISTINCT bene_acct) AS peers FROM {ledger} GROUP BY 1) o
           ON o.id = a.acct_id
    LEFT JOIN (SELECT bene_acct AS id, count(*) AS cnt, sum(base_amt) AS total,
                      count(DISTINCT orig_acct) AS peers FROM {ledger} GROUP BY 1) n
           ON n.id = a.acct_id
    LEFT JOIN (SELECT id, max(c) AS cnt, max(s) AS total FROM (
                 SELECT orig_acct AS id, count(*) AS c, sum(base_amt) AS s FROM {ledger}
                 GROUP BY orig_acct, date_trunc('day', tran_timestamp)) GROUP BY 1) ob
           ON ob.id = a.acct_id
    LEFT JOIN (SELECT id, max(c) AS cnt, max(s) AS total FROM (
                 SELECT bene_acct AS id, count(*) AS c, sum(base_amt) AS s FROM {ledger}
                 GROUP BY bene_acct, date_trunc('day', tran_timestamp)) GROUP BY 1) nb
           ON nb.id = a.acct_id"""


def _numbers(values) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"


def _logit(coef: str, intercept: str) -> str:
    """Same order of additions as the scores it checks."""
    z = intercept
    for position in range(len(NUMERIC)):
        z = f"({z} + num[{position + 1}] * {coef}[{position + 1}])"
    return f"({z} + coalesce({coef}[cat + 1], 0))"


def _probability(z: str) -> str:
    p = f"1 / (1 + exp(-greatest(-30, least(30, {z}))))"
    return f"greatest(1e-6, least(1 - 1e-6, {p}))"


def _loss(p: str, y: str) -> str:
    q = f"greatest(1e-6, least(1 - 1e-6, {p}))"
    return f"-(CASE WHEN {y} = 1 THEN ln({q}) ELSE ln(1 - {q}) END)"


def _weight(n: str, pos: str, size: str) -> str:
    return f"CASE WHEN {pos} > 0 AND {pos} < {n} THEN {n} / (2.0 * ({size})) ELSE 1.0 END"


def _loss_sums(source: str, keys: str) -> str:
    """(keys, n, pos, wloss_sum, w_sum)."""
    w_pos, w_neg = _weight("n", "pos", "pos"), _weight("n", "pos", "n - pos")
    return f"""
    SELECT {keys}, n, pos, ({w_pos}) * lp + ({w_neg}) * ln_ AS wloss_sum,
           ({w_pos}) * pos + ({w_neg}) * (n - pos) AS w_sum
    FROM (SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos,
                 coalesce(sum(CASE WHEN y = 1 THEN {_loss('score', 'y')} END), 0) AS lp,
                 coalesce(sum(CASE WHEN y = 0 THEN {_loss('score', 'y')} END), 0) AS ln_
          FROM {source} GROUP BY {keys})"""


def _curve(source: str, keys: str) -> str:
    return f"""
    SELECT {keys}, score, pos, neg,
           CAST(sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS BIGINT) AS tp,
           CAST(sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC) AS BIGINT) AS fp,
           CAST(sum(pos) OVER (PARTITION BY {keys}) AS BIGINT) AS n_pos,
           CAST(sum(neg) OVER (PARTITION BY {keys}) AS BIGINT) AS n_neg
    FROM (SELECT {keys}, score, CAST(sum(y) AS BIGINT) AS pos,
                 CAST(sum(1 - y) AS BIGINT) AS neg FROM {source} GROUP BY {keys}, score)"""


def _rates(source: str) -> str:
    return f"""
    SELECT *, CASE WHEN precision + recall > 0
                   THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
                 CASE WHEN n_pos > 0 THEN tp / CAST(n_pos AS DOUBLE) ELSE 0 END AS recall
          FROM {source})"""


AP = "CASE WHEN sum(pos) > 0 THEN sum(pos * tp / CAST(tp + fp AS DOUBLE)) / sum(pos) ELSE 0 END"
AUC = (
    "CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN "
    "sum(neg * (2 * tp - pos) / 2.0) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) END"
)


def _best(source: str, keys: str) -> str:
    return f"""
    SELECT {keys}, score AS thr, precision, recall, f1 FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(f1, 12) DESC,
               round(precision, 12) DESC, round(recall, 12) DESC, score DESC) AS place
      FROM {source}) WHERE place = 1"""


def _uniform(digest: str, start: int) -> str:
    return f"((('0x' || substr({digest}, {start}, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _mask(me: str, other: str, tag: str) -> str:
    text = (
        f"'{SECRET}' || '|' || least({me}, {other}) || '|' || greatest({me}, {other})"
        f" || '|{MASK_ROUND}|' || {tag}"
    )
    digest = f"sha256({text})"
    normal = f"sqrt(-2 * ln({_uniform(digest, 1)})) * cos(2 * pi() * {_uniform(digest, 14)})"
    return f"(CASE WHEN {me} < {other} THEN 1000.0 ELSE -1000.0 END * {normal})"


def _masked(part: str) -> str:
    total = " + ".join(
        f"CASE WHEN bank_id <> '{b}' THEN {_mask('bank_id', chr(39) + b + chr(39), f'(metric || {chr(39)}_{part}{chr(39)})')} ELSE 0 END"
        for b in BANKS
    )
    return f"round(CAST({part} AS DOUBLE) + ({total}), 6)"


def _per_numeric(template: str) -> str:
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(NUMERIC))


def _path_rows() -> str:
    rows = [
        f"(CAST({a!r} AS DOUBLE), {r}, {_numbers(p['coef'])}, CAST({p['intercept'][0]!r} AS DOUBLE))"
        for a, r, p in fixed.path_models()
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(alpha, round, coef, intercept)"


def _fixed_rows() -> str:
    shared = fixed.shared_params()
    rows = [("global", b, shared) for b in BANKS]
    rows += [("local", b, fixed.local_params(b)) for b in BANKS]
    values = [
        f"('{m}', '{b}', {_numbers(p['coef'])}, CAST({p['intercept'][0]!r} AS DOUBLE))"
        for m, b, p in rows
    ]
    return f"SELECT * FROM (VALUES {', '.join(values)}) AS t(model, bank_id, coef, intercept)"


def _gradient(members: str, source: str) -> str:
    """One step of 0.5 from zero for each member, all positions present."""
    keys = members.split(", ")
    same = " AND ".join(f"g.{k} = w.{k}" for k in keys)
    named = ", ".join(f"w.{k}" for k in keys)
    return f"""
    SELECT {named}, w.n_train, CASE WHEN w.idx < 0 THEN 'intercept' ELSE 'coef' END AS key,
           CAST(greatest(w.idx, 0) AS INTEGER) AS pos,
           0 - 0.5 * (coalesce(g.total, 0) / w.n_train) AS value
    FROM (SELECT {members}, count(*) AS n_train, unnest(range(-1, (SELECT count(*) FROM plan))) AS idx
          FROM {source} GROUP BY {members}) w
    LEFT JOIN (SELECT {members}, idx, sum((0.5 - y) * value) AS total FROM (
                 SELECT {members}, y, -1 AS idx, 1.0 AS value FROM {source}
                 UNION ALL SELECT {members}, y, unnest(range(0, {len(NUMERIC)})), unnest(num) FROM {source}
                 UNION ALL SELECT {members}, y, cat, 1.0 FROM {source} WHERE cat IS NOT NULL)
               GROUP BY {members}, idx) g
      ON {same} AND g.idx = w.idx"""


def _tested(prefix: str, scores: str) -> str:
    """Test metrics per model and bank at the threshold chosen on validation, from the steps
    of :func:`_metric_steps`."""
    best, losses, ranking = f"{prefix}best", f"{prefix}losses", f"{prefix}ranking"
    return f"""SELECT *, CASE WHEN test_p + test_r > 0 THEN 2 * test_p * test_r / (test_p + test_r)
                          ELSE 0 END AS test_f1
           FROM (SELECT l.model, l.bank_id, l.n AS test_n, l.pos AS test_pos,
                        v.thr AS val_threshold, v.precision AS val_p, v.recall AS val_r,
                        v.f1 AS val_f1, r.ap AS test_ap, r.auc AS test_roc_auc,
                        CASE WHEN h.hits > 0 THEN h.tp / CAST(h.hits AS DOUBLE) ELSE 0 END AS test_p,
                        CASE WHEN l.pos > 0 THEN h.tp / CAST(l.pos AS DOUBLE) ELSE 0 END AS test_r,
                        l.wloss_sum / l.w_sum AS test_wlogloss
                 FROM {losses} l JOIN {ranking} r USING (model, bank_id, split)
                 JOIN {best} v ON v.model = l.model AND v.bank_id = l.bank_id AND v.split = 'val'
                 JOIN (SELECT s.model, s.bank_id, count(*) FILTER (WHERE s.score >= t.thr) AS hits,
                              count(*) FILTER (WHERE s.score >= t.thr AND s.y = 1) AS tp
                       FROM {scores} s JOIN {best} t
                         ON t.model = s.model AND t.bank_id = s.bank_id AND t.split = 'val'
                       WHERE s.split = 'test' GROUP BY 1, 2) h
                   ON h.model = l.model AND h.bank_id = l.bank_id
                 WHERE l.split = 'test')"""


def _metric_steps(prefix: str, scores: str, keys: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Curve, rates, best threshold, losses and ranking metrics of scored rows."""
    curve, rated = f"{prefix}curve", f"{prefix}rated"
    return {
        curve: ((scores,), _curve(scores, keys)),
        rated: ((curve,), _rates(curve)),
        f"{prefix}best": ((rated,), _best(rated, keys)),
        f"{prefix}losses": ((scores,), _loss_sums(scores, keys)),
        f"{prefix}ranking": ((curve,), f"SELECT {keys}, {AP} AS ap, {AUC} AS auc FROM {curve} GROUP BY {keys}"),
    }


# name -> (CTEs it reads, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "accounts": (
        (),
        """SELECT c_custkey AS acct_id, c_acctbal AS initial_deposit, n_name AS state,
                  CASE WHEN c_custkey % 20 < 11 THEN 'bank_l'
                       WHEN c_custkey % 20 < 17 THEN 'bank_m' ELSE 'bank_s' END AS bank_id
           FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "transactions": (
        (),
        """SELECT l_orderkey * 8 + l_linenumber AS tran_id, o_custkey AS orig_acct,
                  (l_partkey * 131 + l_suppkey * 17) % (SELECT count(*) FROM customer) AS bene_acct,
                  CAST(l_extendedprice AS DECIMAL(18,2)) AS base_amt, l_shipdate AS tran_timestamp
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "ledger": (("transactions",), "SELECT DISTINCT * FROM transactions"),
    "events_ledger": (
        (),
        """SELECT DISTINCT event_id AS tran_id, user_id AS orig_acct,
                  (event_id * 7 + 3) % 150 AS bene_acct,
                  CAST(value AS DECIMAL(18,2)) AS base_amt, ts AS tran_timestamp FROM events""",
    ),
    "sar": (
        (),
        """SELECT DISTINCT c_custkey AS acct_id,
                  CASE WHEN c_acctbal > 9200 THEN 'YES' ELSE 'NO' END AS is_sar_text
           FROM customer WHERE c_acctbal > 9000""",
    ),
    "views": (
        ("ledger", "accounts"),
        " UNION ALL ".join(
            f"""SELECT '{b}' AS bank_id, *,
                orig_acct IN (SELECT acct_id FROM accounts WHERE bank_id = '{b}')
                  AND bene_acct IN (SELECT acct_id FROM accounts WHERE bank_id = '{b}') AS internal
                FROM ledger
                WHERE orig_acct IN (SELECT acct_id FROM accounts WHERE bank_id = '{b}')
                   OR bene_acct IN (SELECT acct_id FROM accounts WHERE bank_id = '{b}')"""
            for b in BANKS
        ),
    ),
    "features": (("accounts", "ledger", "sar"), _features("ledger")),
    "event_features": (("accounts", "events_ledger", "sar"), _features("events_ledger")),
    "activity": (
        ("events_ledger",),
        """SELECT acct_id, direction, day, count(*) AS daily_cnt, sum(base_amt) AS daily_sum
           FROM (SELECT orig_acct AS acct_id, 'out' AS direction,
                        date_trunc('day', tran_timestamp) AS day, base_amt FROM events_ledger
                 UNION ALL SELECT bene_acct, 'in', date_trunc('day', tran_timestamp), base_amt
                 FROM events_ledger) GROUP BY 1, 2, 3""",
    ),
    # The split: quotas by largest remainder in exact integers, ranks over whole strata.
    "classes": (
        ("features",),
        """SELECT bank_id, CAST(is_sar AS INTEGER) AS label, CAST(count(*) AS HUGEINT) AS n
           FROM features GROUP BY 1, 2""",
    ),
    "first_quota": (
        ("classes",),
        """SELECT *, CASE WHEN by_label THEN base + (place <= n_train - sum(base) OVER (PARTITION BY bank_id))::INT
                          ELSE n_train END AS train_quota
           FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY rest DESC, label) AS place
                 FROM (SELECT *, (n_train * n) // total AS base, (n_train * n) % total AS rest
                       FROM (SELECT *, total - CAST(ceil(total * 0.3::DOUBLE - 1e-9) AS HUGEINT) AS n_train
                             FROM (SELECT *, sum(n) OVER (PARTITION BY bank_id) AS total,
                                          count(*) OVER (PARTITION BY bank_id) >= 2
                                            AND min(n) OVER (PARTITION BY bank_id) >= 2 AS by_label
                                   FROM classes))))""",
    ),
    "ranked": (
        ("features", "first_quota"),
        f"""SELECT *, nth <= train_quota AS in_train
            FROM (SELECT f.*, CAST(f.is_sar AS INTEGER) AS label, q.by_label, q.train_quota, q.total,
                         q.n_train,
                         row_number() OVER (PARTITION BY f.bank_id,
                             CASE WHEN q.by_label THEN q.label ELSE -1 END
                             ORDER BY md5('{SEED}:' || f.acct_id), f.acct_id) AS nth
                  FROM features f JOIN first_quota q
                    ON q.bank_id = f.bank_id AND q.label = CAST(f.is_sar AS INTEGER))""",
    ),
    "second_quota": (
        ("ranked",),
        """SELECT *, CASE WHEN by_label THEN base + (place <= n_val - sum(base) OVER (PARTITION BY bank_id))::INT
                          ELSE n_val END AS val_quota
           FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY rest DESC, label) AS place
                 FROM (SELECT *, (n_val * n) // held AS base, (n_val * n) % held AS rest
                       FROM (SELECT *, held - CAST(ceil(held * 0.5::DOUBLE - 1e-9) AS HUGEINT) AS n_val
                             FROM (SELECT *, sum(n) OVER (PARTITION BY bank_id) AS held,
                                          count(*) OVER (PARTITION BY bank_id) >= 2
                                            AND min(n) OVER (PARTITION BY bank_id) >= 2 AS by_label
                                   FROM (SELECT bank_id, label, CAST(count(*) AS HUGEINT) AS n
                                         FROM ranked WHERE NOT in_train GROUP BY 1, 2)))))""",
    ),
    "parts": (
        ("ranked", "second_quota"),
        f"""SELECT acct_id, bank_id, is_sar, label AS y, state, {', '.join(NUMERIC)},
                   CASE WHEN in_train THEN 'train' WHEN after <= val_quota THEN 'val'
                        ELSE 'test' END AS split
            FROM (SELECT r.*, q.val_quota,
                         row_number() OVER (PARTITION BY r.bank_id, r.in_train,
                             CASE WHEN q.by_label THEN q.label ELSE -1 END
                             ORDER BY md5('{SEED}:' || r.acct_id), r.acct_id) AS after
                  FROM ranked r LEFT JOIN second_quota q
                    ON q.bank_id = r.bank_id AND q.label = r.label)""",
    ),
    "train": (("parts",), "SELECT * FROM parts WHERE split = 'train'"),
    "vocab": (
        ("train",),
        "SELECT DISTINCT bank_id, 'state' AS col, state AS value FROM train WHERE state IS NOT NULL",
    ),
    "sums": (
        ("train",),
        _per_numeric(
            "SELECT bank_id, '{c}' AS col, {i} AS slot, count({c}) AS n, sum({c}) AS total, "
            "sum({c} * {c}) AS squares FROM train GROUP BY bank_id"
        ),
    ),
    "scaling": (
        ("sums",),
        """SELECT col, slot, CASE WHEN n > 1 THEN total / n ELSE 0 END AS mean,
                  CASE WHEN n > 1 AND squares / n - (total / n) * (total / n) > 0
                       THEN sqrt(squares / n - (total / n) * (total / n)) ELSE 1 END AS std
           FROM (SELECT col, slot, sum(n) AS n, sum(total) AS total, sum(squares) AS squares
                 FROM sums GROUP BY col, slot)""",
    ),
    "positions": (
        ("vocab",),
        """SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS pos
           FROM (SELECT DISTINCT col, value FROM vocab)""",
    ),
    "plan": (
        ("scaling", "positions"),
        f"""SELECT CAST(slot AS INTEGER) AS idx, 'num' AS kind, col, CAST(NULL AS VARCHAR) AS value, mean, std,
                   'num__' || col AS name FROM scaling
            UNION ALL SELECT CAST(pos + {len(NUMERIC)} AS INTEGER), 'cat', col, value, NULL, NULL,
                   'cat__' || col || '_' || value FROM positions""",
    ),
    "scaled": (
        ("parts", "scaling"),
        "SELECT p.*, "
        + ", ".join(
            f"(p.{c} - s.m[{i + 1}]) / s.d[{i + 1}] AS z_{c}" for i, c in enumerate(NUMERIC)
        )
        + " FROM parts p, (SELECT list(mean ORDER BY slot) AS m, list(std ORDER BY slot) AS d FROM scaling) s",
    ),
    "encoded": (
        ("scaled", "positions"),
        f"""SELECT e.acct_id, e.bank_id, e.split, e.y,
                   [{', '.join(f'z_{c}' for c in NUMERIC)}] AS num, v.pos + {len(NUMERIC)} AS cat
            FROM scaled e LEFT JOIN positions v ON v.value = e.state""",
    ),
    "enc_train": (("encoded",), "SELECT *, acct_id % 4 AS part FROM encoded WHERE split = 'train'"),
    "models": ((), _fixed_rows()),
    "scores": (
        ("encoded", "models"),
        f"""SELECT m.model, e.bank_id, e.split, e.acct_id, e.y,
                   {_probability(_logit('m.coef', 'm.intercept'))} AS score
            FROM encoded e JOIN models m ON m.bank_id = e.bank_id""",
    ),
    "shared": (("scores",), "SELECT * FROM scores WHERE model = 'global'"),
    "val_scores": (("scores",), "SELECT * FROM scores WHERE split = 'val'"),
    **_metric_steps("", "scores", "model, bank_id, split"),
    "validated": (
        ("best", "losses", "ranking"),
        """SELECT l.model, l.bank_id, l.n, l.pos, r.ap, r.auc, b.thr, b.precision AS p,
                  b.recall AS r, b.f1, l.wloss_sum, l.w_sum
           FROM losses l JOIN ranking r USING (model, bank_id, split)
           JOIN best b USING (model, bank_id, split) WHERE l.split = 'val'""",
    ),
    "tested": (("best", "losses", "ranking", "scores"), _tested("", "scores")),
    "compared": (
        ("tested",),
        "SELECT f.bank_id, "
        + ", ".join(
            f"b.{c} AS base_{s}, f.{c} AS fl_{s}, f.{c} - b.{c} AS delta_{s}"
            for s, c in COMPARED.items()
        )
        + """, b.bank_id IS NOT NULL AS has_baseline,
            coalesce(b.test_n <> f.test_n OR b.test_pos <> f.test_pos, false) AS split_differs
            FROM (SELECT * FROM tested WHERE model = 'global') f
            LEFT JOIN (SELECT * FROM tested WHERE model = 'local' AND bank_id <> 'bank_s') b
              ON b.bank_id = f.bank_id""",
    ),
    "fractions": (
        ("validated",),
        "SELECT bank_id, model || '_val_wlogloss' AS metric, CAST(wloss_sum AS DOUBLE) AS num, "
        "CAST(w_sum AS DOUBLE) AS den FROM validated"
        + "".join(
            f" UNION ALL SELECT bank_id, model || '_val_{m}', coalesce({m}, 0) * "
            f"CASE WHEN {m} IS NULL THEN 0 ELSE n END, CASE WHEN {m} IS NULL THEN 0 ELSE n END "
            "FROM validated"
            for m in METRICS
        ),
    ),
    "path": ((), _path_rows()),
    "path_scores": (
        ("encoded", "path"),
        f"""SELECT m.alpha, m.round, e.bank_id, e.y,
                   {_probability(_logit('m.coef', 'm.intercept'))} AS score
            FROM encoded e, path m WHERE e.split = 'val'""",
    ),
    "path_losses": (("path_scores",), _loss_sums("path_scores", "alpha, round, bank_id")),
    "log": (
        ("path_losses",),
        "SELECT alpha, round, sum(wloss_sum) / sum(w_sum) AS loss FROM path_losses GROUP BY 1, 2",
    ),
    "replayed": (
        ("log",),
        """SELECT *, round - best_round AS no_improve FROM (
             SELECT *, max(CASE WHEN better THEN round END) OVER w AS best_round,
                    min(loss) OVER w AS best_loss
             FROM (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY alpha ORDER BY round
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM log)
             WINDOW w AS (PARTITION BY alpha ORDER BY round))""",
    ),
    "stopped": (
        ("replayed",),
        """SELECT * FROM (SELECT *, min(CASE WHEN no_improve >= 2 THEN round END)
             OVER (PARTITION BY alpha) AS stopped_at FROM replayed)
           WHERE stopped_at IS NULL OR round <= stopped_at""",
    ),
    "bank_step": (("enc_train", "plan"), _gradient("bank_id", "enc_train")),
    "part_step": (("enc_train", "plan"), _gradient("bank_id, part", "enc_train")),
    "averaged": (
        ("part_step",),
        """SELECT key, pos, sum(n_train * value) / sum(n_train) AS value,
                  CAST(sum(n_train) AS BIGINT) AS n_train FROM part_step GROUP BY key, pos""",
    ),
    "untidy": (
        (),
        """SELECT l_orderkey, l_linenumber, l_linenumber AS k, l_orderkey AS id,
                  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_shipdate AS moment FROM lineitem""",
    ),
    "local_scaling": (
        ("sums",),
        """SELECT bank_id, col, CASE WHEN n > 1 THEN total / n ELSE 0 END AS mean,
                  CASE WHEN n > 1 AND squares / n - (total / n) * (total / n) > 0
                       THEN sqrt(squares / n - (total / n) * (total / n)) ELSE 1 END AS std
           FROM sums""",
    ),
}

CTES |= training.ctes(_probability, _loss_sums)
CTES |= _metric_steps("kept_", "kept_scores", "model, bank_id, split")
CTES |= _metric_steps("round_", "round_scores", "model, alpha, round, bank_id")
CTES |= {
    "kept_tested": (("kept_best", "kept_losses", "kept_ranking", "kept_scores"), _tested("kept_", "kept_scores")),
    "round_validated": (
        ("round_best", "round_losses", "round_ranking"),
        """SELECT l.model, l.alpha, l.round, l.bank_id, l.n, r.ap, r.auc, b.precision AS p, b.recall AS r,
                  l.wloss_sum, l.w_sum
           FROM round_losses l JOIN round_ranking r USING (model, alpha, round, bank_id)
           JOIN round_best b USING (model, alpha, round, bank_id)""",
    ),
}

SPLIT_COLUMNS = "acct_id, bank_id, is_sar, split"
SIG = "CAST(printf('%.9e', {0}) AS DOUBLE) AS {0}"


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _significant(*names: str) -> str:
    return ", ".join(SIG.format(n) for n in names)


TEST_COLUMNS = _rounded(
    "val_threshold", "val_p", "val_r", "val_f1", "test_ap", "test_roc_auc", "test_p",
    "test_r", "test_f1", "test_wlogloss",
)
LEDGER_COLUMNS = (
    "tran_id, strftime(tran_timestamp, '%Y-%m-%d %H:%M:%S') AS tran_timestamp, orig_acct, "
    "bene_acct, CAST(base_amt AS DOUBLE) AS base_amt"
)
STEP = "key, pos, round(value, 9) AS value"

# name -> (CTEs it reads, final SELECT)
FINALS: dict[str, tuple[tuple[str, ...], str]] = {
    "scan_csv": (("ledger",), f"SELECT {LEDGER_COLUMNS} FROM ledger"),
    "sink_views": (
        ("views",),
        "SELECT bank_id, internal, count(*) AS n, CAST(sum(base_amt) AS DOUBLE) AS amount "
        "FROM views GROUP BY 1, 2",
    ),
    "sink_features": (("features",), "SELECT * FROM features"),
    "scan_features": (
        ("features",),
        "SELECT acct_id, bank_id, state, is_sar, out_cnt, in_cnt, net_flow FROM features "
        "WHERE bank_id = 'bank_m'",
    ),
    "round_metrics": (("log",), f"SELECT alpha, round, {_rounded('loss')} FROM log"),
    "params_roundtrip": (("averaged",), f"SELECT {STEP}, '1' AS rounds FROM averaged"),
    "plan_roundtrip": (
        ("plan",),
        f"SELECT idx, kind, col, value, {_significant('mean', 'std')}, name FROM plan",
    ),
    "dataset_guard": (
        ("encoded", "plan"),
        """SELECT bank_id, count(*) AS data_used_n, """
        + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_n" for s in ("train", "val", "test"))
        + ", "
        + ", ".join(
            f"count(*) FILTER (WHERE split = '{s}' AND y = 1) AS {s}_pos"
            for s in ("train", "val", "test")
        )
        + """, 'v1' AS schema_version, CAST((SELECT count(*) FROM plan) AS INTEGER) AS feature_dim
           FROM encoded GROUP BY bank_id""",
    ),
    "sink_modes": (
        ("accounts",),
        """SELECT t.step, a.bank_id, t.refused,
                  a.n * t.whole + CASE WHEN a.bank_id = 'bank_s' THEN a.half * t.halves ELSE a.n * t.halves END AS stored
           FROM (SELECT bank_id, count(*) AS n, count(*) FILTER (WHERE acct_id % 2 = 0) AS half
                 FROM accounts GROUP BY bank_id) a
           CROSS JOIN (VALUES ('1 overwrite', 1, 0, false), ('2 overwrite', 0, 1, false), ('3 append', 1, 1, false),
                              ('4 errorifexists', 1, 1, true)) AS t(step, whole, halves, refused)""",
    ),
    "dataset_refusals": (
        ("accounts",),
        """SELECT t.*, CASE WHEN t."case" = 'own plan' THEN (SELECT count(*) FROM accounts) ELSE 0 END AS loaded
           FROM (VALUES ('own plan', 'none'), ('other plan', 'dataset has no dataset for plan two'),
                        ('plan not stated', 'dataset does not say which plan it was encoded with'))
                AS t("case", refusal)""",
    ),
    "split_observed": (
        ("features", "parts"),
        """SELECT 'features' AS observed, 'rows' AS counted, count(*) AS n FROM features
           UNION ALL SELECT 'features', 'without_id', count(*) FILTER (WHERE acct_id IS NULL) FROM features
           UNION ALL SELECT 'features', 'reported', count(*) FILTER (WHERE is_sar) FROM features
           UNION ALL SELECT 'split', 'rows', count(*) FROM parts
           UNION ALL SELECT 'split', 'without_id', count(*) FILTER (WHERE acct_id IS NULL) FROM parts
           UNION ALL SELECT 'split', 'reported', count(*) FILTER (WHERE is_sar) FROM parts
           UNION ALL SELECT 'split', 'unassigned', count(*) FILTER (WHERE split IS NULL) FROM parts""",
    ),
    "write_modes": (
        ("sar",),
        """SELECT t.step, (SELECT count(*) FROM sar) * t.times AS stored, t.refused
           FROM (VALUES ('1 overwrite', 1, false), ('2 overwrite', 1, false), ('3 append', 2, false),
                        ('4 errorifexists', 2, true)) AS t(step, times, refused)""",
    ),
    "project_accounts": (("accounts",), "SELECT acct_id, initial_deposit, state FROM accounts"),
    "coerce_numeric": (
        ("untidy",),
        """SELECT l_orderkey, l_linenumber, CASE WHEN k IN (3, 4, 5) THEN NULL ELSE id END AS id,
                  CASE WHEN k IN (1, 2, 3) THEN NULL ELSE CAST(price AS DOUBLE) END AS amount
           FROM untidy""",
    ),
    "coerce_timestamp": (
        ("untidy",),
        """SELECT l_orderkey, l_linenumber, strftime(CASE WHEN k = 1 THEN NULL
                    WHEN k = 2 THEN date_trunc('day', moment)
                    WHEN k = 3 THEN date_trunc('day', moment) + INTERVAL 210 MINUTE
                    ELSE date_trunc('second', moment) END, '%Y-%m-%d %H:%M:%S') AS at FROM untidy""",
    ),
    "bank_accounts": (("accounts",), "SELECT * FROM accounts WHERE bank_id = 'bank_s'"),
    "sar_confirmed": (("sar",), "SELECT acct_id FROM sar WHERE is_sar_text = 'YES'"),
    "trainval": (
        ("parts",),
        "SELECT acct_id, bank_id, split FROM parts WHERE split IN ('train', 'val')",
    ),
    "dedupe_tx": (
        ("transactions",),
        f"""SELECT {LEDGER_COLUMNS} FROM (SELECT DISTINCT * FROM (SELECT * FROM transactions
              UNION ALL SELECT * FROM transactions WHERE tran_id % 97 = 0))""",
    ),
    "sar_label": (("features",), "SELECT acct_id, bank_id, is_sar FROM features"),
    "bank_view_tx": (
        ("views",),
        "SELECT bank_id, tran_id, orig_acct, bene_acct, CAST(base_amt AS DOUBLE) AS base_amt, "
        "internal FROM views",
    ),
    "tx_mix": (
        ("views",),
        """SELECT bank_id, count(*) AS tx_total, count(*) FILTER (WHERE internal) AS tx_internal,
                  count(*) FILTER (WHERE NOT internal) AS tx_cross,
                  round(count(*) FILTER (WHERE internal) / CAST(count(*) AS DOUBLE), 6) AS internal_share,
                  round(count(*) FILTER (WHERE NOT internal) / CAST(count(*) AS DOUBLE), 6) AS cross_share
           FROM views GROUP BY bank_id""",
    ),
    "bank_sar": (
        ("sar", "accounts"),
        "SELECT s.acct_id, s.is_sar_text, a.bank_id FROM sar s "
        "JOIN (SELECT DISTINCT acct_id, bank_id FROM accounts) a ON a.acct_id = s.acct_id",
    ),
    "bank_overview": (
        ("views", "accounts", "sar"),
        """SELECT a.bank_id, a.accounts, coalesce(s.sar_yes, 0) AS sar_yes, v.tx_total,
                  v.tx_internal, v.tx_total - v.tx_internal AS tx_cross,
                  round(coalesce(s.sar_yes, 0) / CAST(a.accounts AS DOUBLE), 6) AS sar_rate,
                  round(v.tx_total / CAST(a.accounts AS DOUBLE), 6) AS tx_per_acct,
                  round((v.tx_total - v.tx_internal) / CAST(v.tx_total AS DOUBLE), 6) AS cross_ratio
           FROM (SELECT bank_id, count(DISTINCT acct_id) AS accounts FROM accounts GROUP BY 1) a
           LEFT JOIN (SELECT bank_id, count(DISTINCT s.acct_id) AS sar_yes FROM sar s
                      JOIN accounts a ON a.acct_id = s.acct_id WHERE is_sar_text = 'YES' GROUP BY 1) s
             USING (bank_id)
           JOIN (SELECT bank_id, count(*) AS tx_total, count(*) FILTER (WHERE internal) AS tx_internal
                 FROM views GROUP BY 1) v USING (bank_id)""",
    ),
    "integrity_checks": (
        ("accounts", "events_ledger", "sar"),
        """SELECT 'sar_without_account' AS "check", count(*) AS failures FROM sar
             WHERE acct_id NOT IN (SELECT acct_id FROM accounts WHERE bank_id = 'bank_l')
           UNION ALL SELECT 'transfer_without_account', count(*) FROM events_ledger
             WHERE orig_acct NOT IN (SELECT acct_id FROM accounts WHERE bank_id = 'bank_l')
               AND bene_acct NOT IN (SELECT acct_id FROM accounts WHERE bank_id = 'bank_l')
           UNION ALL SELECT 'account_without_features', 0
           UNION ALL SELECT 'features_without_account', count(*) FROM accounts WHERE bank_id <> 'bank_l'
           UNION ALL SELECT 'repeated_account_id', count(*) FROM (SELECT acct_id FROM accounts
             WHERE bank_id = 'bank_l' GROUP BY acct_id HAVING count(*) > 1)""",
    ),
    "account_features": (("features",), "SELECT * FROM features"),
    "event_features": (("event_features",), "SELECT * FROM event_features"),
    "out_features": (
        ("ledger",),
        "SELECT orig_acct AS acct_id, count(*) AS out_cnt, CAST(sum(base_amt) AS DOUBLE) AS out_sum, "
        "count(DISTINCT bene_acct) AS out_nuniq_bene FROM ledger GROUP BY 1",
    ),
    "in_features": (
        ("ledger",),
        "SELECT bene_acct AS acct_id, count(*) AS in_cnt, CAST(sum(base_amt) AS DOUBLE) AS in_sum, "
        "count(DISTINCT orig_acct) AS in_nuniq_orig FROM ledger GROUP BY 1",
    ),
    "daily_activity": (
        ("activity",),
        "SELECT acct_id, direction, strftime(day, '%Y-%m-%d') AS day, daily_cnt, "
        "CAST(daily_sum AS DOUBLE) AS daily_sum FROM activity",
    ),
    "burst_features": (
        ("activity",),
        "SELECT acct_id, "
        + ", ".join(
            f"CAST(coalesce(max(daily_{w}) FILTER (WHERE direction = '{d}'), 0) AS {t}) AS {d}_max_daily_{w}"
            for d in ("out", "in")
            for w, t in (("cnt", "BIGINT"), ("sum", "DOUBLE"))
        )
        + " FROM activity GROUP BY acct_id",
    ),
    "split_assign": (("parts",), f"SELECT {SPLIT_COLUMNS} FROM parts"),
    "split_by_cuts": (("parts",), f"SELECT {SPLIT_COLUMNS} FROM parts"),
    "split_counts": (
        ("parts",),
        "SELECT bank_id, split, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM parts GROUP BY 1, 2",
    ),
    "category_vocab": (("vocab",), "SELECT * FROM vocab"),
    "numeric_stats": (
        ("sums",),
        "SELECT bank_id, col, n, CAST(printf('%.9e', total) AS DOUBLE) AS sum, "
        "CAST(printf('%.9e', squares) AS DOUBLE) AS sumsq FROM sums",
    ),
    "global_numeric": (("scaling",), f"SELECT col, {_significant('mean', 'std')} FROM scaling"),
    "global_vocab": (("positions",), "SELECT * FROM positions"),
    "feature_names": (("plan",), "SELECT idx, name FROM plan"),
    "plan_hash": (
        ("plan",),
        """SELECT plan_hash, substr(plan_hash, 1, 8) AS plan_id, width FROM (
             SELECT sha1('v1' || chr(10) || string_agg(text, chr(10) ORDER BY nr)) AS plan_hash,
                    CAST(sum(n) AS BIGINT) AS width
             FROM (SELECT nr // 4096 AS nr, sha1(string_agg(text, chr(10) ORDER BY nr)) AS text, sum(n) AS n
                   FROM (SELECT idx // 4096 AS nr, sha1(string_agg(line, chr(10) ORDER BY idx)) AS text, count(*) AS n
                         FROM (SELECT idx, idx || '|' || kind || '|' || col || '|' || coalesce(value, '') || '|' ||
                                 coalesce(printf('%.9e', mean), '') || '|' || coalesce(printf('%.9e', std), '') AS line
                               FROM plan) GROUP BY idx // 4096)
                   GROUP BY nr // 4096))""",
    ),
    "standardize": (
        ("scaled",),
        f"SELECT acct_id, bank_id, {_rounded(*(f'z_{c}' for c in NUMERIC))} FROM scaled",
    ),
    "one_hot": (
        ("parts", "positions"),
        "SELECT p.acct_id, p.bank_id, 'cat__state_' || v.value AS name FROM parts p "
        "JOIN positions v ON v.value = p.state",
    ),
    "encode_long": (
        ("encoded",),
        f"""SELECT acct_id, bank_id, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value FROM (
              SELECT acct_id, bank_id, unnest(range(0, {len(NUMERIC)})) AS idx, unnest(num) AS value FROM encoded
              UNION ALL SELECT acct_id, bank_id, cat, 1.0 FROM encoded WHERE cat IS NOT NULL)""",
    ),
    "local_encode": (
        ("parts", "local_scaling", "vocab"),
        _per_numeric(
            "SELECT p.acct_id, p.bank_id, 'num__{c}' AS name, round((p.{c} - s.mean) / s.std, 6) AS value "
            "FROM parts p JOIN local_scaling s ON s.bank_id = p.bank_id AND s.col = '{c}'"
        )
        + " UNION ALL SELECT p.acct_id, p.bank_id, 'cat__state_' || p.state, 1.0 FROM parts p "
        "JOIN vocab v ON v.bank_id = p.bank_id AND v.value = p.state",
    ),
    "predict_scores": (
        ("shared",),
        "SELECT acct_id, bank_id, split, y, round(score, 6) AS p FROM shared",
    ),
    "class_weights": (
        ("encoded",),
        f"""SELECT bank_id, split, n, pos, round({_weight('n', 'pos', 'pos')}, 6) AS w_pos,
                   round({_weight('n', 'pos', 'n - pos')}, 6) AS w_neg
            FROM (SELECT bank_id, split, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos
                  FROM encoded GROUP BY 1, 2)""",
    ),
    "weighted_logloss": (
        ("losses",),
        f"SELECT bank_id, split, n, pos, {_rounded('wloss_sum', 'w_sum')} FROM losses "
        "WHERE model = 'global'",
    ),
    "pr_curve": (
        ("curve",),
        "SELECT bank_id, split, round(score, 9) AS p, pos, neg, tp, fp, n_pos, n_neg FROM curve "
        "WHERE model = 'global'",
    ),
    "average_precision": (
        ("ranking",),
        f"SELECT model, bank_id, split, {_rounded('ap')} FROM ranking",
    ),
    "roc_auc": (("ranking",), f"SELECT model, bank_id, split, {_rounded('auc')} FROM ranking"),
    "best_f1_threshold": (
        ("best",),
        f"SELECT model, bank_id, split, {_rounded('thr', 'precision', 'recall', 'f1')} FROM best",
    ),
    "confusion_at_threshold": (
        ("scores",),
        f"SELECT model, bank_id, split, tp, fp, fn, {_rounded('precision', 'recall', 'f1')} FROM ("
        + _rates(
            """(SELECT model, bank_id, split, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp,
                 count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp,
                 count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, sum(y) AS n_pos
               FROM scores GROUP BY 1, 2, 3)"""
        )
        + ")",
    ),
    "val_metrics": (
        ("validated",),
        "SELECT model, bank_id, n, pos, "
        + _rounded("ap", "auc", "thr", "p", "r", "f1", "wloss_sum", "w_sum")
        + " FROM validated",
    ),
    "weighted_metric_mean": (
        ("validated",),
        "SELECT model, "
        + ", ".join(
            f"round(sum({m} * n) / sum(CASE WHEN {m} IS NOT NULL THEN n END), 6) AS {m}"
            for m in METRICS
        )
        + " FROM validated GROUP BY model",
    ),
    "test_report": (
        ("tested",),
        f"SELECT model, bank_id, test_n, test_pos, {TEST_COLUMNS} FROM tested",
    ),
    "compare_models": (
        ("compared",),
        "SELECT bank_id, "
        + _rounded(*(f"{side}_{s}" for s in COMPARED for side in ("base", "fl", "delta")))
        + ", has_baseline, split_differs FROM compared",
    ),
    "delta_report": (
        ("compared",),
        "SELECT bank_id, "
        + ", ".join(
            f"coalesce(printf('%+.3f', delta_{s}), 'NA') AS delta_{s}" for s in COMPARED
        )
        + ", round(-delta_wlogloss, 6) AS wlogloss_improvement FROM compared",
    ),
    "pairwise_masks": (
        ("accounts",),
        f"""SELECT a.bank_id, b.bank_id AS other,
                   round({_mask('a.bank_id', 'b.bank_id', "'val_loss_num'")}, 6) AS mask
            FROM (SELECT DISTINCT bank_id FROM accounts) a
            JOIN (SELECT DISTINCT bank_id FROM accounts) b ON a.bank_id <> b.bank_id""",
    ),
    "masked_metrics": (
        ("fractions",),
        f"""SELECT bank_id, CAST(1e-5 AS DOUBLE) AS alpha, {MASK_ROUND} AS round, metric,
                   {_masked('num')} AS num_masked, {_masked('den')} AS den_masked FROM fractions""",
    ),
    "secure_metric_mean": (
        ("fractions",),
        f"""SELECT {MASK_ROUND} AS round, metric, round(sum(num) / sum(den), 6) AS value
            FROM fractions GROUP BY metric""",
    ),
    "missing_clients": (
        ("parts", "accounts"),
        """SELECT DISTINCT bank_id FROM accounts WHERE bank_id NOT IN (
             SELECT bank_id FROM parts WHERE split = 'val' GROUP BY bank_id HAVING sum(y) >= 10)""",
    ),
    "guards": (
        ("fractions",),
        """SELECT 'complete' AS "case", CAST(count(DISTINCT metric) AS INTEGER) AS "values",
                  CAST(NULL AS VARCHAR) AS reason, false AS refused FROM fractions
           UNION ALL SELECT v.name, 0, v.why, true FROM (VALUES
             ('bank missing', 'banks without a report'),
             ('field missing', 'masked field missing'),
             ('weights not positive', 'sum of weights is not positive'),
             ('update without rows', 'update without n_train'),
             ('empty secret', 'no secure aggregation secret')) AS v(name, why)""",
    ),
    "early_stopping": (
        ("stopped",),
        f"SELECT alpha, round, {_rounded('loss', 'best_loss')}, best_round, no_improve, stopped_at "
        "FROM stopped",
    ),
    "select_best_model": (
        ("stopped",),
        f"SELECT alpha, round, {_rounded('loss')} FROM stopped ORDER BY stopped.loss, alpha, round LIMIT 1",
    ),
    "gd_round": (("bank_step",), f"SELECT bank_id, n_train, {STEP} FROM bank_step"),
    "fedavg": (("averaged",), f"SELECT {STEP}, n_train FROM averaged"),
    "local_update": (
        ("first_local",),
        f"""SELECT alpha, bank_id, CASE WHEN k = len(w) THEN 'intercept' ELSE 'coef' END AS key,
                  CAST(CASE WHEN k = len(w) THEN 0 ELSE k - 1 END AS INTEGER) AS pos,
                  round(w[k], 9) AS value, CAST(n_train AS BIGINT) AS n_train
           FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM first_local)
           WHERE alpha = {training.ALPHAS[0]!r}""",
    ),
    "federated_round": (
        ("federated_path",),
        f"""SELECT alpha, CAST(round AS BIGINT) AS round, round(loss, 6) AS avg_val_wlogloss,
                  round(best_loss, 6) AS best_loss, CAST(round - best_round AS BIGINT) AS no_improve
           FROM federated_path WHERE round = 1 AND alpha = {training.ALPHAS[0]!r}""",
    ),
    "federated_train": (
        ("kept_tested", "federated_best"),
        f"""SELECT t.bank_id, t.test_n, t.test_pos, {TEST_COLUMNS}, b.alpha, b.round
           FROM kept_tested t, federated_best b WHERE t.model = 'federated'""",
    ),
    "federated_resume": (
        ("federated_path", "federated_best"),
        """SELECT p.alpha, p.round, round(p.loss, 6) AS avg_val_wlogloss, round(p.best_loss, 6) AS best_loss,
                  CAST(p.round - p.best_round AS INTEGER) AS no_improve,
                  p.alpha = b.alpha AND p.round = b.round AS kept
           FROM federated_path p, federated_best b""",
    ),
    "round_evaluation": (
        ("round_validated", "federated_path"),
        "SELECT v.alpha, v.round, v.model || '_val_wlogloss' AS metric, "
        "round(sum(v.wloss_sum) / sum(v.w_sum), 6) AS value FROM round_validated v "
        "JOIN federated_path f ON f.alpha = v.alpha AND f.round = v.round GROUP BY v.alpha, v.round, v.model"
        + "".join(
            f" UNION ALL SELECT v.alpha, v.round, v.model || '_val_{m}', round(sum(v.{m} * v.n) / "
            f"sum(CASE WHEN v.{m} IS NOT NULL THEN v.n END), 6) FROM round_validated v "
            "JOIN federated_path f ON f.alpha = v.alpha AND f.round = v.round GROUP BY v.alpha, v.round, v.model"
            for m in METRICS
        ),
    ),
    "local_baseline": (
        ("baseline_best", "kept_tested", "kept_losses", "kept_ranking"),
        f"""SELECT b.bank_id, b.alpha AS selected_alpha, b.round AS selected_round,
                  round(b.loss, 6) AS val_wlogloss_best, l.n AS val_n, l.pos AS val_pos,
                  round(r.ap, 6) AS val_ap, round(l.wloss_sum / l.w_sum, 6) AS val_wlogloss,
                  t.test_n, t.test_pos, {TEST_COLUMNS}
           FROM baseline_best b
           JOIN kept_tested t ON t.model = 'local' AND t.bank_id = b.bank_id
           JOIN kept_losses l ON l.model = 'local' AND l.bank_id = b.bank_id AND l.split = 'val'
           JOIN kept_ranking r ON r.model = 'local' AND r.bank_id = b.bank_id AND r.split = 'val'""",
    ),
    "round1_compare": (
        ("round_losses",),
        "SELECT alpha, round, "
        + ", ".join(
            f"round(sum(wloss_sum) FILTER (WHERE model = '{m}') / sum(w_sum) FILTER (WHERE model = '{m}'), 6) "
            f"AS avg_{m}_val_wlogloss"
            for m in ("local", "global")
        )
        + f" FROM round_losses WHERE round = 1 AND alpha = {training.ALPHAS[0]!r} GROUP BY alpha, round",
    ),
    "study": (
        ("kept_tested",),
        "SELECT f.bank_id, "
        + ", ".join(
            f"round(b.{c}, 6) AS base_{s}, round(f.{c}, 6) AS fl_{s}, round(f.{c} - b.{c}, 6) AS delta_{s}"
            for s, c in COMPARED.items()
        )
        + """, true AS has_baseline,
            coalesce(b.test_n <> f.test_n OR b.test_pos <> f.test_pos, false) AS split_differs
            FROM (SELECT * FROM kept_tested WHERE model = 'federated') f
            JOIN (SELECT * FROM kept_tested WHERE model = 'local') b ON b.bank_id = f.bank_id""",
    ),
}

FINALS["stats_documents"] = FINALS["numeric_stats"]
FINALS["summary_csv"] = (
    FINALS["bank_overview"][0],
    f"SELECT CAST(row_number() OVER (ORDER BY bank_id) AS INTEGER) AS place, * FROM ({FINALS['bank_overview'][1]})",
)


def _with(needed: tuple[str, ...], final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needed:
        visit(name)
    clauses = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    recursive = " RECURSIVE" if training.RECURSIVE & set(order) else ""
    return f"WITH{recursive} {clauses}\n{final}"


ORACLES: dict[str, str] = {name: _with(*parts) for name, parts in FINALS.items()}
