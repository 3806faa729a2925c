"""Registered retrieval queries on `embeddings` (+ `events` for many users)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.operators import retrieval as R
from corpusrank.plans.common import TD, emb_labels, emb_vectors
from corpusrank.plans.registry import query
from corpusrank.plans.sql import doc_times_cte, md5_key, unit_vectors_cte

H = TD.topk_history_size
K = TD.topk_k
THETA = TD.topk_theta

_SINGLE_USER_CTES = f"""WITH {unit_vectors_cte()},
{doc_times_cte()},
hist AS (SELECT doc_id FROM (
           SELECT doc_id, row_number() OVER (ORDER BY {md5_key('doc_id', f'history{TD.seed}')}, doc_id) AS r
           FROM emb_raw)
         WHERE r <= least({H}, (SELECT count(*) - 1 FROM emb_raw))),
hv AS (SELECT unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM emb_unit JOIN hist USING (doc_id)),
pm AS (SELECT i, avg(x) AS m FROM hv GROUP BY i),
pn AS (SELECT sqrt(sum(m * m)) AS nrm FROM pm),
prof AS (SELECT list(m / CASE WHEN nrm = 0 THEN 1 ELSE nrm END ORDER BY i) AS q FROM pm, pn),
nowt AS (SELECT max(doc_time) AS now FROM emb_time),
scored AS (SELECT u.doc_id, u.label, list_dot_product(u.v, prof.q) AS cosine, t.doc_time,
                  exp(-{THETA} * greatest(nowt.now - t.doc_time, 0)) AS time_weight
           FROM emb_unit u JOIN emb_time t USING (doc_id), prof, nowt)"""


def _single_user(spark, sf):
    vec = emb_vectors(spark, sf)
    hist = R.sampled_history(vec, TD)
    return vec, hist


@query("topk_time_decay", sql=_SINGLE_USER_CTES + f""",
ranked AS (SELECT *, cosine * time_weight AS score,
                  row_number() OVER (ORDER BY cosine * time_weight DESC, doc_id) AS rk
           FROM scored WHERE doc_id NOT IN (SELECT doc_id FROM hist))
SELECT CAST(0 AS BIGINT) AS user_id, CAST(rk AS BIGINT) AS rank, doc_id, round(score, 6) AS score,
       round(cosine, 6) AS cosine, round(time_weight, 6) AS time_weight, doc_time, label
FROM ranked WHERE rk <= {K}""")
def topk_time_decay(spark, sf):
    """F8: one simulated user (seeded history), top-20 by cosine x decay."""
    vec, hist = _single_user(spark, sf)
    recs = R.top_k_time_aware(vec, hist, TD)
    return R.join_payload(recs, emb_labels(spark, sf), ["label"])


def _events_history(spark, sf):
    """Interaction log from `events`: item = event_id mod (number of vectors)."""
    from corpusrank.plans.common import table
    n = table(spark, sf, "embeddings").count()
    ev = table(spark, sf, "events").select("user_id", (F.col("event_id") % F.lit(n)).alias("doc_id"), "ts")
    return R.user_history(ev, TD)


_EVENTS_HIST = f"""
ev AS (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS doc_id, ts FROM events),
per AS (SELECT user_id, doc_id, max(ts) AS last_ts FROM ev GROUP BY user_id, doc_id),
uhist AS (SELECT * FROM (SELECT user_id, doc_id,
            row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, doc_id) AS hist_rank FROM per)
          WHERE hist_rank <= {H})"""

_MULTI_PROFILE = f"""
uhv AS (SELECT h.user_id, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM emb_unit u JOIN uhist h USING (doc_id)),
upm AS (SELECT user_id, i, avg(x) AS m FROM uhv GROUP BY user_id, i),
upn AS (SELECT user_id, sqrt(sum(m * m)) AS nrm FROM upm GROUP BY user_id),
uprof AS (SELECT user_id, i, m / CASE WHEN nrm = 0 THEN 1 ELSE nrm END AS x FROM upm JOIN upn USING (user_id))"""


@query("user_history", sql=f"""WITH {_EVENTS_HIST}
SELECT user_id, CAST(hist_rank AS BIGINT) AS hist_rank, doc_id FROM uhist""")
def user_history(spark, sf):
    """latest H distinct items per user from the interaction log."""
    return _events_history(spark, sf).select("user_id", "hist_rank", "doc_id")


@query("user_profile", sql=f"""WITH {unit_vectors_cte()}, {_EVENTS_HIST}, {_MULTI_PROFILE}
SELECT user_id, CAST(i - 1 AS BIGINT) AS i, round(x, 6) AS x FROM uprof""")
def user_profile(spark, sf):
    """Renormalised mean of each user's history vectors (long form)."""
    prof = R.user_profiles(_events_history(spark, sf), emb_vectors(spark, sf))
    return prof.select("user_id", F.posexplode("profile").alias("i", "x")).select(
        "user_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("l2_normalize", sql=f"""WITH {unit_vectors_cte()}
SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, round(x, 6) AS x
FROM (SELECT doc_id, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM emb_unit)""")
def l2_normalize(spark, sf):
    """C14: unit vectors (long form)."""
    v = emb_vectors(spark, sf)
    return v.select("doc_id", F.posexplode("vec").alias("i", "x")).select(
        "doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("time_decay", sql=f"""WITH {unit_vectors_cte()}, {doc_times_cte()},
nowt AS (SELECT max(doc_time) AS now FROM emb_time)
SELECT doc_id, doc_time, round(exp(-{THETA} * greatest(now - doc_time, 0)), 6) AS time_weight FROM emb_time, nowt""")
def time_decay(spark, sf):
    """F1 + D24 + F5: synthetic time index, now = max time, decay weights."""
    docs, _ = R.prepare_docs(emb_vectors(spark, sf), TD)
    return docs.select("doc_id", "doc_time", F.round("time_weight", 6).alias("time_weight"))


@query("cosine", sql=_SINGLE_USER_CTES + """
SELECT doc_id, round(cosine, 6) AS cosine FROM scored""")
def cosine(spark, sf):
    """cosine of every document to the simulated user's profile (one
    user, so the output is linear in the documents)."""
    vec, hist = _single_user(spark, sf)
    profile = R.user_profiles(hist, vec).first()["profile"]
    return R.cosines(vec, profile).select("doc_id", F.round("cosine", 6).alias("cosine"))


@query("topk_all_users", sql=f"""WITH {unit_vectors_cte()}, {doc_times_cte()}, {_EVENTS_HIST},
uhv AS (SELECT h.user_id, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM emb_unit u JOIN uhist h USING (doc_id)),
upm AS (SELECT user_id, i, avg(x) AS m FROM uhv GROUP BY user_id, i),
upn AS (SELECT user_id, sqrt(sum(m * m)) AS nrm FROM upm GROUP BY user_id),
prof AS (SELECT user_id, list(m / CASE WHEN nrm = 0 THEN 1 ELSE nrm END ORDER BY i) AS q FROM upm JOIN upn USING (user_id) GROUP BY user_id),
nowt AS (SELECT max(doc_time) AS now FROM emb_time),
scored AS (SELECT p.user_id, u.doc_id, list_dot_product(u.v, p.q) AS cosine, t.doc_time,
                  exp(-{THETA} * greatest(nowt.now - t.doc_time, 0)) AS time_weight
           FROM prof p, emb_unit u, emb_time t, nowt
           WHERE u.doc_id = t.doc_id
             AND NOT EXISTS (SELECT 1 FROM uhist h WHERE h.user_id = p.user_id AND h.doc_id = u.doc_id)),
ranked AS (SELECT *, cosine * time_weight AS score,
           row_number() OVER (PARTITION BY user_id ORDER BY cosine * time_weight DESC, doc_id) AS rk FROM scored)
SELECT user_id, CAST(rk AS BIGINT) AS rank, doc_id, round(score, 6) AS score, round(cosine, 6) AS cosine,
       round(time_weight, 6) AS time_weight, doc_time FROM ranked WHERE rk <= {K}""")
def topk_all_users(spark, sf):
    """R2: every user of the interaction log, newest documents first."""
    vec = emb_vectors(spark, sf)
    return R.top_k_time_aware(vec, _events_history(spark, sf).select("user_id", "doc_id"), TD)


@query("history_table", sql=_SINGLE_USER_CTES + """
SELECT CAST(0 AS BIGINT) AS user_id, h.doc_id, t.doc_time, u.label
FROM hist h JOIN emb_time t USING (doc_id) JOIN emb_unit u USING (doc_id)""")
def history_table(spark, sf):
    """The simulated user's history with times, ordered by time."""
    vec, hist = _single_user(spark, sf)
    docs, _ = R.prepare_docs(vec, TD)
    payload = docs.join(emb_labels(spark, sf), "doc_id")
    return R.history_table(hist, payload, ["label"]).select("user_id", "doc_id", "doc_time", "label")


# Fixed value: a decay that leaves documents a month apart in order though every score rounds to 0.
THETA_SECONDS = 1e-5


@query("topk_real_time", sql=_SINGLE_USER_CTES + f""",
ts AS (SELECT event_id % (SELECT count(*) FROM embeddings) AS doc_id, max(epoch_us(ts)) / 1e6 AS t FROM events GROUP BY 1),
nowr AS (SELECT max(t) AS now FROM ts),
rs AS (SELECT s.doc_id, s.cosine, ts.t AS doc_time, exp(-{THETA_SECONDS} * greatest(nowr.now - ts.t, 0)) AS w
       FROM scored s JOIN ts USING (doc_id), nowr WHERE s.doc_id NOT IN (SELECT doc_id FROM hist)),
ranked AS (SELECT *, row_number() OVER (ORDER BY cosine * w DESC, doc_id) AS rk FROM rs)
SELECT CAST(rk AS BIGINT) AS rank, doc_id, round(cosine, 6) AS cosine, round(doc_time, 3) AS doc_time FROM ranked WHERE rk <= {K}""")
def topk_real_time(spark, sf):
    """F1 with real times (epoch seconds of each item's newest event) and a
    strong decay: ranks follow the unrounded score."""
    from corpusrank.plans.common import table
    vec = emb_vectors(spark, sf)
    n = vec.count()
    t = (table(spark, sf, "events").groupBy((F.col("event_id") % F.lit(n)).alias("doc_id"))
         .agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / F.lit(1e6)).alias("t")))
    o = TD.replace(topk_use_real_time=True, topk_theta=THETA_SECONDS)
    recs = R.top_k_time_aware(vec.join(t, "doc_id"), R.sampled_history(vec, TD), o, time_col="t")
    return recs.select("rank", "doc_id", "cosine", F.round("doc_time", 3).alias("doc_time"))
