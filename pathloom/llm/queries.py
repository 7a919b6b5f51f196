"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trips import plausible_positions
from ..plans.registry import Registry, sql_haversine, table
from ..session import materialize
from .clusters import cluster_members, place_clusters
from .leakage import leaked_items
from .packing import fill_report, pack, token_counts
from .runs import read_states, repeated_runs
from .spans import shared_pairs, shared_report

R = Registry()

CAPACITY = 2048
STATES = ["stationary", "transition"]


def _state_runs(spark, d, **how):
    return repeated_runs(table(spark, d, "processed_gps"), "subid", "time", "processed_id", "movement_state", lambda c: read_states(c, STATES), least=5, **how)


_RUNS = """
WITH c AS (SELECT subid, processed_id, time, CASE WHEN lower(regexp_replace(movement_state, '[^A-Za-z]', '', 'g')) LIKE 'sta%' THEN 'stationary' ELSE 'transition' END AS state FROM processed_gps WHERE movement_state IS NOT NULL),
g AS (SELECT *, CASE WHEN state = lag(state) OVER w AND time - lag(time) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS part FROM c WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)),
s AS (SELECT *, sum(part) OVER (PARTITION BY subid ORDER BY time, processed_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
"""


@R.query("p6_found", _RUNS + "SELECT subid, arg_min(processed_id, (time, processed_id)) AS start_id, arg_max(processed_id, (time, processed_id)) AS end_id FROM s GROUP BY subid, run HAVING count(*) >= 5")
def p6_found(spark, d):
    return _state_runs(spark, d).select("subid", "start_id", "end_id")


@R.query("p6_runs", _RUNS + "SELECT subid, min(state) AS state, min(time) AS start_time, max(time) AS end_time, epoch(max(time)) - epoch(min(time)) AS duration_s, count(*) AS n_events FROM s GROUP BY subid, run HAVING count(*) >= 5")
def p6_runs(spark, d):
    return _state_runs(spark, d).select("subid", "state", "start_time", "end_time", "duration_s", "n_events")


@R.query("p6_near")
def p6_near(spark, d):
    # a boundary costs as much as a deviating event, so single events that deviate within a run are absorbed
    return _state_runs(spark, d, penalty=1.0).select("subid", "state", "start_id", "end_id", "duration_s", "n_events", "n_other")


@R.query("p8_packing")
def p8_packing(spark, d):
    return pack(token_counts(table(spark, d, "documents"), "doc_id"), "doc_id", "n_tokens", CAPACITY)


@R.query("p8_fill")
def p8_fill(spark, d):
    return fill_report(p8_packing(spark, d), CAPACITY)


@R.query("p8_identities", "SELECT count(*) FILTER (WHERE text <> '') AS n_placed, 0::BIGINT AS n_overfull, 0::BIGINT AS n_cut_without_need, 0::BIGINT AS n_tokens_lost FROM documents")
def p8_identities(spark, d):
    """What must hold of any packing: every text with tokens is placed whole, nothing is too full or cut without need."""
    sizes = materialize(token_counts(table(spark, d, "documents"), "doc_id"))
    placed = materialize(pack(sizes, "doc_id", "n_tokens", CAPACITY))
    over = placed.groupBy("container_id").agg(F.sum("length").alias("n")).filter(F.col("n") > CAPACITY).agg(F.count("*").alias("n_overfull"))
    held = placed.groupBy("doc_id").agg(F.sum("length").alias("held"), F.count("*").alias("pieces"))
    t = sizes.join(held, "doc_id", "left").agg(F.count("held").alias("n_placed"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("n_cut_without_need"), F.sum(F.abs(F.col("n_tokens") - F.coalesce("held", F.lit(0)))).alias("n_tokens_lost"))
    return t.crossJoin(F.broadcast(over)).select("n_placed", "n_overfull", "n_cut_without_need", "n_tokens_lost")


# every window of 300 characters of every text, by its hash
_SPANS = "WITH w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))"


@R.query("p10_found", f"{_SPANS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b USING (h) WHERE a.doc_id < b.doc_id")
def p10_found(spark, d):
    return shared_pairs(table(spark, d, "documents"))


@R.query(
    "p10_shared",
    f"""{_SPANS}, s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), c AS (SELECT doc_id, i, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS n FROM w SEMI JOIN s USING (h)),
    t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id), p AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n FROM w a JOIN w b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id)
    SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.text) AS class_id, coalesce(p.n, 0) AS n_partners, CAST(coalesce(t.n, 0) AS BIGINT) AS shared_chars, round(coalesce(t.n / nullif(length(d.text), 0), 0), 9) AS shared_share FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN p USING (doc_id) WHERE d.text IS NOT NULL""",
)
def p10_shared(spark, d):
    return shared_report(table(spark, d, "documents")).withColumn("shared_share", F.round("shared_share", 9))


@R.query("p9_found")
def p9_found(spark, d):
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@R.query("p4_found")
def p4_found(spark, d):
    gps = plausible_positions(table(spark, d, "processed_gps"))
    return cluster_members(gps, place_clusters(gps))


# over all fixes, so that SQL can say it: whatever is within 80 m of a member is within 50 m and has the same surroundings
_SET_OFF = f"""
WITH p AS (SELECT a.processed_id AS f, b.processed_id AS g, {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 50 AS near FROM processed_gps a JOIN processed_gps b ON a.subid = b.subid AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.002 AND a.lon + 0.002 WHERE {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 80),
n AS (SELECT f, count(*) AS n, bool_and(near) AS narrow, min(g) AS low, sum(g) AS total FROM p GROUP BY f)
SELECT a.low AS cluster_key, a.f AS processed_id FROM n a JOIN p ON a.f = p.f JOIN n b ON p.g = b.f WHERE a.n >= 10 GROUP BY a.f, a.low HAVING bool_and(b.narrow AND b.n = a.n AND b.low = a.low AND b.total = a.total)
"""


@R.query("p4_all_fixes", _SET_OFF)
def p4_all_fixes(spark, d):
    gps = table(spark, d, "processed_gps")
    return cluster_members(gps, place_clusters(gps))


@R.query("p4_clusters")
def p4_clusters(spark, d):
    return place_clusters(plausible_positions(table(spark, d, "processed_gps"))).select("subid", "cluster_key", "size", "n_components", "typical")
