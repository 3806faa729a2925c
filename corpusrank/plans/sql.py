"""DuckDB SQL fragments shared by the oracle queries.

Conventions that make both engines agree value by value: doubles rounded to 6
places, ties broken by the id *after* rounding, counts cast to BIGINT."""

from __future__ import annotations

from corpusrank.plans.common import TD


def md5_key(id_expr: str, salt: str) -> str:
    return f"md5('{salt}:' || CAST({id_expr} AS VARCHAR))"


def unit_vectors_cte() -> str:
    """emb_unit(doc_id, label, v): L2-normalised embeddings."""
    return """
emb_raw AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
emb_nrm AS (SELECT doc_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM emb_raw),
emb_unit AS (SELECT doc_id, label,
                    list_transform(e, lambda x: x / CASE WHEN nrm = 0 THEN 1 ELSE nrm END) AS v
             FROM emb_nrm)"""


def doc_times_cte(src: str = "emb_raw", seed: int = TD.seed) -> str:
    """emb_time(doc_id, doc_time): synthetic index in the seeded corpus order."""
    return f"""
emb_time AS (SELECT doc_id,
                    CAST(row_number() OVER (ORDER BY {md5_key('doc_id', str(seed))}, doc_id) - 1 AS DOUBLE) AS doc_time
             FROM {src})"""


# ---------------------------------------------------------------- text
def sql_normalize(expr: str) -> str:
    from corpusrank.functions.text import EMAIL_PATTERN, NOT_WHITELIST_PATTERN, NUM_PATTERN, URL_PATTERN
    s = f"lower(coalesce(CAST({expr} AS VARCHAR), ''))"
    s = f"regexp_replace({s}, '{URL_PATTERN}', ' URL ', 'gi')"
    s = f"regexp_replace({s}, '{EMAIL_PATTERN}', ' EMAIL ', 'gi')"
    s = f"regexp_replace({s}, '{NUM_PATTERN}', ' NUM ', 'g')"
    s = f"regexp_replace({s}, '{NOT_WHITELIST_PATTERN}', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def sql_tokenize(clean: str, cap: int = 0) -> str:
    s = f"list_filter(string_split({clean}, ' '), lambda t: length(t) >= 2)"
    if cap and cap > 0:
        s = f"{s}[1:{int(cap)}]"
    return s


def sql_vector_tokens(clean: str) -> str:
    from corpusrank.functions.text import VECTOR_TOKEN_PATTERN
    return f"regexp_extract_all({clean}, '{VECTOR_TOKEN_PATTERN}')"


def sql_stop_list() -> str:
    from corpusrank.functions.text import english_stop_words
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words()) + "]"


def sql_remove_stop(toks: str) -> str:
    return f"list_filter({toks}, lambda t: NOT list_contains({sql_stop_list()}, t))"


def sql_bigrams(toks: str) -> str:
    """unigrams + bigrams of a list column named ``toks`` (zip of shifted slices)."""
    return (f"list_concat({toks}, list_transform(list_zip({toks}[1:len({toks}) - 1], {toks}[2:len({toks})]), "
            f"lambda p: p[1] || ' ' || p[2]))")


# ---------------------------------------------------------------- corpus / splits
def corpus_ctes(opts=TD) -> str:
    """corpus(doc_id, text, label, y): documents joined to labels."""
    return f"""
corpus AS (SELECT d.doc_id, coalesce(CAST(d.text AS VARCHAR), '') AS text, CAST(l.{opts.label_col} AS INTEGER) AS label,
                  CAST(l.{opts.label_col} = {int(opts.pos_class)} AS INTEGER) AS y
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def folds_cte(src: str = "corpus", k: int = TD.outer_folds, seed: int = TD.seed, name: str = "folds") -> str:
    """{name}(doc_id, y, fold) over {src}(doc_id, y)."""
    return f"""
{name}_rk AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {md5_key('doc_id', str(seed))}, doc_id) AS rk FROM {src}),
{name}_off AS (SELECT y, coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
               FROM (SELECT y, count(*) AS n FROM {src} GROUP BY y)),
{name} AS (SELECT doc_id, y, CAST((off + rk - 1) % {k} + 1 AS INTEGER) AS fold FROM {name}_rk JOIN {name}_off USING (y))"""


def splits_cte(folds: str = "folds", k: int = TD.outer_folds, seed: int = TD.seed,
               val_size: float = TD.inner_val_size, name: str = "splits") -> str:
    """{name}(fold, doc_id, y, split) from {folds}(doc_id, y, fold)."""
    return f"""
{name}_x AS (SELECT f.fold AS fold, x.doc_id, x.y, x.fold AS own FROM {folds} x, (SELECT unnest(generate_series(1, {k})) AS fold) f),
{name}_cnt AS (SELECT fold, y, count(*) AS n_c FROM {name}_x WHERE own <> fold GROUP BY fold, y),
{name}_q1 AS (SELECT fold, y, n_c, sum(n_c) OVER (PARTITION BY fold) AS n_part FROM {name}_cnt),
{name}_q2 AS (SELECT *, CAST(ceil({float(val_size)!r} * n_part) AS BIGINT) AS n_val FROM {name}_q1),
{name}_q3 AS (SELECT *, CAST(n_c AS DOUBLE) / CAST(n_part AS DOUBLE) * CAST(n_val AS DOUBLE) AS cont FROM {name}_q2),
{name}_q4 AS (SELECT *, CAST(floor(cont) AS BIGINT) AS flo FROM {name}_q3),
{name}_q5 AS (SELECT *, n_val - sum(flo) OVER (PARTITION BY fold) AS need, cont - flo AS rem FROM {name}_q4),
{name}_q AS (SELECT fold, y, flo + CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY rem DESC, y) <= need THEN 1 ELSE 0 END AS quota FROM {name}_q5),
{name}_r AS (SELECT fold, doc_id, y, row_number() OVER (PARTITION BY fold, y ORDER BY md5(CAST({seed} + fold AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
             FROM {name}_x WHERE own <> fold),
{name} AS (SELECT r.fold, r.doc_id, r.y, CASE WHEN r.rk <= q.quota THEN 'val' ELSE 'train' END AS split
           FROM {name}_r r JOIN {name}_q q USING (fold, y)
           UNION ALL SELECT fold, doc_id, y, 'test' AS split FROM {name}_x WHERE own = fold)"""


# ---------------------------------------------------------------- metrics
def dbl(x: float) -> str:
    """An exact double literal for DuckDB (plain decimals would be DECIMAL)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def fixture_cte(name: str = "fx") -> str:
    """{name}(variant, doc_id, y, score): the score fixture on `embeddings`:
    (1 + cos(embedding, centroid of label 0)) / 2 rounded to 6 places
    ('r6') and to 2 places ('r2', with ties); y = (label = 0)."""
    return f"""
{name}_c AS (SELECT list(m ORDER BY i) AS c FROM (
    SELECT i, avg(x) AS m FROM (
        SELECT unnest(generate_series(1, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x
        FROM embeddings WHERE label = 0) GROUP BY i)),
{name}_cos AS (SELECT vec_id AS doc_id, CAST(label = 0 AS INTEGER) AS y,
       (1 + list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)))) / 2 AS s
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), {name}_c),
{name} AS (SELECT 'r6' AS variant, doc_id, y, round(s, 6) AS score FROM {name}_cos
           UNION ALL SELECT 'r2' AS variant, doc_id, y, round(s, 2) AS score FROM {name}_cos)"""


def events_fixture_cte(name: str = "evx") -> str:
    """{name}(variant, doc_id, y, score): a large-pool fixture on `events`
    (more than 800 distinct scores): y = (event_type = 'purchase'),
    score = value / 500 rounded to 6 places."""
    return f"""
{name} AS (SELECT 'events' AS variant, event_id AS doc_id, CAST(event_type = 'purchase' AS INTEGER) AS y,
                  round(value / {dbl(500.0)}, 6) AS score FROM events)"""


def stats_cte(src: str, name: str = "st", keys: str = "variant") -> str:
    """{name}(keys, score, pos, neg, cum_pos, cum_neg, P, N, n_distinct)."""
    return f"""
{name}_a AS (SELECT {keys}, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {src} GROUP BY {keys}, score),
{name} AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
                  sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
                  sum(pos) OVER (PARTITION BY {keys}) AS P, sum(neg) OVER (PARTITION BY {keys}) AS N,
                  count(*) OVER (PARTITION BY {keys}) AS n_distinct
           FROM {name}_a)"""


def auc_ap_select(st: str = "st", keys: str = "variant") -> str:
    return f"""SELECT {keys},
       CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * (cum_pos - pos + pos / 2.0)) / (max(P) * max(N)) END AS roc_auc,
       CASE WHEN max(P) > 0 THEN sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / max(P) ELSE 0.0 END AS pr_auc
FROM {st} GROUP BY {keys}"""


def sweep_cte(st: str = "st", name: str = "sw", keys: str = "variant", grid: str | None = None) -> str:
    """{name}(keys, thr, tp, fp, fn, f1) at the distinct scores (groups with
    at least 2) or, when ``grid`` names a (keys, thr) table, at those thresholds
    via as-of lookup."""
    small = f"""SELECT {keys}, score AS thr, cum_pos AS tp, cum_neg AS fp, P FROM {st}
                WHERE n_distinct >= 2"""
    parts = [small]
    if grid:
        parts = []
        parts.append(f"""SELECT g.{keys}, g.thr,
                   coalesce((SELECT max(s.cum_pos) FROM {st} s WHERE s.{keys} = g.{keys} AND s.score >= g.thr), 0) AS tp,
                   coalesce((SELECT max(s.cum_neg) FROM {st} s WHERE s.{keys} = g.{keys} AND s.score >= g.thr), 0) AS fp,
                   (SELECT max(P) FROM {st} s WHERE s.{keys} = g.{keys}) AS P
                   FROM {grid} g""")
    body = "\n UNION ALL ".join(parts)
    return f"""
{name}_r AS ({body}),
{name} AS (SELECT {keys}, thr, tp, fp, P - tp AS fn,
                  CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2.0 * tp / (2 * tp + fp + (P - tp)) ELSE 0.0 END AS f1
           FROM {name}_r)"""


def best_cte(sw: str = "sw", st: str = "st", name: str = "best", keys: str = "variant") -> str:
    return f"""
{name}_r AS (SELECT {keys}, thr, f1, row_number() OVER (PARTITION BY {keys} ORDER BY f1 DESC, thr) AS rk FROM {sw}),
{name} AS (SELECT k.{keys}, coalesce(b.thr, 0.5) AS thr, b.f1
           FROM (SELECT DISTINCT {keys} FROM {st}) k LEFT JOIN {name}_r b ON b.{keys} = k.{keys} AND b.rk = 1)"""


def confusion_select(src: str, thr: str, keys: str = "variant") -> str:
    """tp, fp, tn, fn per group at thresholds {thr}(keys, thr)."""
    return f"""SELECT s.{keys}, max(t.thr) AS thr,
       CAST(sum(CASE WHEN s.score >= t.thr AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN s.score >= t.thr AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN s.score < t.thr AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN s.score < t.thr AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM {src} s JOIN {thr} t ON s.{keys} = t.{keys} GROUP BY s.{keys}"""


def rates_select(conf: str, keys: str = "variant") -> str:
    return f"""SELECT *,
  CASE WHEN tp + fp + tn + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) ELSE 0.0 END AS acc,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
       THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
            / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2
       WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn)
       WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END AS bal_acc
FROM {conf}"""


def ece_bin_sql(p: str, n_bins: int = 15) -> str:
    from corpusrank.operators.metrics import ece_edges
    e = ece_edges(n_bins)
    parts = [f"WHEN {p} < {dbl(e[0])} THEN -1"]
    for i in range(len(e) - 1):
        parts.append(f"WHEN {p} < {dbl(e[i + 1])} THEN {i}")
    return "CASE " + " ".join(parts) + f" ELSE {len(e) - 1} END"


def reliability_bin_sql(p: str, n_bins: int = 15) -> str:
    from corpusrank.operators.metrics import ece_edges
    inner = ece_edges(n_bins)[1:-1]
    return "(" + " + ".join(f"CASE WHEN {p} > {dbl(e)} THEN 1 ELSE 0 END" for e in inner) + ")"


# ---------------------------------------------------------------- tf-idf
def tfidf_ctes(opts=TD, docs: str = "documents") -> str:
    """tf(doc_id, term, tf), dfq(term, df, cnt), voc(term, df, cnt, idx), idf(term, idf), tfw(doc_id, term, tf, weight)."""
    toks = sql_remove_stop(sql_vector_tokens(sql_normalize("text")))
    limit = f"ORDER BY cnt DESC, term LIMIT {opts.tfidf_max_features}" if opts.tfidf_max_features else ""
    return f"""
docs_t AS (SELECT doc_id, {sql_bigrams('toks')} AS g FROM (SELECT doc_id, {toks} AS toks FROM {docs})),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM docs_t) GROUP BY doc_id, term),
dfq AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cnt FROM tf GROUP BY term),
voc AS (SELECT term, df, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, term) - 1 AS INTEGER) AS idx
        FROM (SELECT * FROM dfq WHERE df >= {opts.tfidf_min_df} {limit})),
nd AS (SELECT count(*) AS n FROM {docs}),
idf AS (SELECT term, idx, ln((CAST(n AS DOUBLE) + 1.0) / (CAST(df AS DOUBLE) + 1.0)) + 1.0 AS idf FROM voc, nd),
tfw0 AS (SELECT doc_id, term, idx, tf, tf * idf AS w FROM tf JOIN idf USING (term)),
tfn AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM tfw0 GROUP BY doc_id),
tfw AS (SELECT doc_id, term, idx, tf, CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END AS weight FROM tfw0 JOIN tfn USING (doc_id))"""
