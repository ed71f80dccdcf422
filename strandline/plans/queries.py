"""Queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import events, fusion, grid, query, reports, stats, temporal, windows
from ..sources.jsonl import with_timestamp
from ..sources.tables import PROCESSES, frames, micros, processes, records, sensor_events, streams, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_REC = """records AS (SELECT event_id AS seq, event_id // 128 + 1 AS pulse_id, user_id % 8 AS worker_id, epoch_us(ts) AS ts_us, ts, 'S' || (user_id % 20) AS session_id, user_id,
    event_type AS operator, value, least(value / 100.0, 1.0) AS score, least(value / 100.0, 1.0) <= 0.5 AS success,
    CASE WHEN value > 100 THEN [event_type, 'HIGH'] ELSE [event_type] END AS flags FROM events)"""
_STR = (
    _REC
    + """, streams AS (SELECT CASE operator WHEN 'error' THEN 'vision' WHEN 'click' THEN 'input' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'gamepad' WHEN 'signup' THEN 'process' END AS modality,
    seq AS ord, ts_us, score, operator, user_id FROM records UNION ALL SELECT 'activity', seq, ts_us, score, operator, user_id FROM records WHERE value > 100)"""
)
_ANC = (
    _STR
    + """, found AS (SELECT seq, ts_us, operator AS anchor_type, score, 0 AS pos FROM records WHERE operator = 'error' AND score > 0.5
      UNION ALL SELECT seq, ts_us, 'peak', score, 1 FROM records WHERE score > 0.7),
    anchors AS (SELECT seq AS anchor_id, ts_us AS anchor_us, anchor_type, score FROM (SELECT *, row_number() OVER (PARTITION BY round(ts_us / 1000000.0, 3) ORDER BY seq, pos) AS rn FROM found) WHERE rn = 1)"""
)
_BLK = (
    _ANC
    + """, probes AS (SELECT anchor_id, score, frame, anchor_us + frame * 120000000 AS p_us, m.modality FROM anchors, (SELECT unnest(range(-6, 7)) AS frame) f, (SELECT DISTINCT modality FROM streams) m),
    before AS (SELECT p.anchor_id, p.frame, p.modality, s.t AS b_us, s.hi AS b_ord FROM probes p ASOF JOIN (SELECT modality, ts_us AS t, max(ord) AS hi FROM streams GROUP BY 1, 2) s ON s.modality = p.modality AND p.p_us > s.t),
    after AS (SELECT p.anchor_id, p.frame, p.modality, s.t AS a_us, s.lo AS a_ord FROM probes p ASOF JOIN (SELECT modality, ts_us AS t, min(ord) AS lo FROM streams GROUP BY 1, 2) s ON s.modality = p.modality AND p.p_us <= s.t),
    hits AS (SELECT p.*, b_us, b_ord, a_us, a_ord, coalesce(p_us - b_us <= a_us - p_us, b_us IS NOT NULL) AS back FROM probes p LEFT JOIN before b USING (anchor_id, frame, modality) LEFT JOIN after a USING (anchor_id, frame, modality)),
    near AS (SELECT anchor_id, frame, modality, CASE WHEN back THEN b_us ELSE a_us END AS t, CASE WHEN back THEN b_ord ELSE a_ord END AS o, p_us FROM hits),
    slices AS (SELECT anchor_id, frame, modality, CASE WHEN frame = 0 AND modality = 'vision' THEN p_us WHEN abs(t - p_us) <= 300000000 THEN t END AS near_us, CASE WHEN frame = 0 AND modality = 'vision' THEN anchor_id WHEN abs(t - p_us) <= 300000000 THEN o END AS ord FROM near),
    parts AS (SELECT anchor_id, count(near_us) AS filled, coalesce(bool_or(frame < 0 AND modality IN ('gamepad', 'input') AND near_us IS NOT NULL), false) AS pre_input, coalesce(bool_or(frame < 0 AND modality = 'network' AND near_us IS NOT NULL), false) AS pre_network,
      coalesce(bool_or(frame > 0 AND modality IN ('gamepad', 'input') AND near_us IS NOT NULL), false) AS post_input,
      coalesce(bool_or(frame = 0 AND modality = 'vision' AND near_us IS NOT NULL), false) AS at_vision, coalesce(bool_or(frame > 0 AND modality = 'network' AND near_us IS NOT NULL), false) AS post_network FROM slices GROUP BY 1),
    blocks AS (SELECT *, round(filled / 78.0, 6) AS alignment, round((pre_input::INT + at_vision::INT + post_network::INT) / 3.0, 6) AS coherence, pre_input AND post_network AS chain FROM parts)"""
)
_FRM = """frames AS (SELECT vec_id // 30 AS window_id, vec_id % 30 AS frame_id, list_transform(embedding, lambda x: greatest(least(floor((x::DOUBLE + 0.25) / 0.05), 9), 0)::INT) AS grid FROM embeddings),
    seqd AS (SELECT *, lag(grid) OVER w AS last, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY window_id) AS n FROM frames WINDOW w AS (PARTITION BY window_id ORDER BY frame_id)),
    cells AS (SELECT window_id, frame_id, i, n, k, k // 8 AS y, k % 8 AS x, grid[k + 1] AS v, last[k + 1] AS p FROM seqd, (SELECT unnest(range(64)) AS k))"""


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, prelude: str = "") -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"WITH {prelude} {sql}" if prelude else sql


def _rec(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(records(spark, d))


_FULL = ("seq", "pulse_id", "session_id", "operator", "score")
_FULL_SQL = "seq, pulse_id, session_id, operator, score"

# stored windows: filters, series, counts
_add("session_summaries", _rec(query.session_summaries), """SELECT session_id, sum(k)::BIGINT AS n, round(sum(s) / sum(k), 6) AS avg_score, max(top) AS max_score, sum(m)::BIGINT AS manipulated, sum(h)::BIGINT AS high_confidence,
    round(100.0 * sum(m) / sum(k), 6) AS manipulation_rate, round(100.0 * sum(h) / sum(k), 6) AS high_rate, string_agg(operator || '=' || k, ',' ORDER BY operator || '=' || k) AS operators
    FROM (SELECT session_id, operator, count(*) AS k, sum(score) AS s, max(score) AS top, count_if(score > 0.5) AS m, count_if(score > 0.75) AS h FROM records GROUP BY 1, 2) GROUP BY 1""", _REC)
_add("flag_filter", _rec(lambda r: query.where_flag(r, "HIGH").select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE list_contains(flags, 'HIGH')", _REC)
_add("flag_and_score", _rec(lambda r: query.windows_with_flag(r, "click", 0.75).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE list_contains(flags, 'click') AND score > 0.75", _REC)
_add("time_range", lambda s, d: _time_range(records(s, d)), f"SELECT {_FULL_SQL} FROM records, (SELECT min(ts_us) AS lo FROM records) WHERE ts_us BETWEEN lo + 86400000000 AND lo + 2 * 86400000000", _REC)
_add("recent_window", lambda s, d: _recent(records(s, d)), f"SELECT {_FULL_SQL} FROM records, (SELECT max(ts_us) AS hi FROM records) WHERE ts_us BETWEEN hi - 86400000000 AND hi AND score > 0.5", _REC)
_add("score_above", _rec(lambda r: query.score_above(r, 0.75).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE coalesce(score, 0) > 0.75", _REC)
_add("score_below", _rec(lambda r: query.score_below(r, 0.1).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE coalesce(score, 0) <= 0.1", _REC)
_add("success_split", _rec(query.success_split), "SELECT count(*) AS n, count_if(success)::BIGINT AS ok, count_if(NOT success)::BIGINT AS failed, round(100.0 * count_if(success) / count(*), 6) AS ok_pct FROM records", _REC)
_add("by_session", _rec(lambda r: query.where(r, "session_id = 'S7'").select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE session_id = 'S7'", _REC)
_add("success_only", _rec(lambda r: query.success_only(r).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE success", _REC)
_add("failures_only", _rec(lambda r: query.failures_only(r).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE NOT success", _REC)
_add("record_count", _rec(query.count), "SELECT count(*) AS n FROM records", _REC)
_add("event_by_id", _rec(lambda r: query.event_by_id(r, 77).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE seq = 77", _REC)
_add("manipulation_since", lambda s, d: _since(records(s, d)), f"SELECT {_FULL_SQL} FROM records, (SELECT max(ts_us) AS hi FROM records) WHERE ts_us >= hi - 3600000000 - 1800000000 AND score > 0.5", _REC)
_add("events_in_range", lambda s, d: _ranged(records(s, d)), f"SELECT {_FULL_SQL} FROM records, (SELECT min(ts_us) AS lo FROM records) WHERE ts_us BETWEEN lo AND lo + 86400000000 AND operator = 'error' AND list_has_all(flags, ['error', 'HIGH'])", _REC)
_SUM = "session_id, count(*) AS n, round(avg(score), 6) AS avg_score, max(score) AS max_score, count_if(score > 0.5)::BIGINT AS manipulated, count_if(score > 0.75)::BIGINT AS high_confidence, round(100.0 * count_if(score > 0.5) / count(*), 6) AS manipulation_rate, round(100.0 * count_if(score > 0.75) / count(*), 6) AS high_rate"
_add("session_summary", _rec(lambda r: query.session_summary(r, "S7").drop("operators").unionByName(query.session_summary(r, "none").drop("operators"))), f"SELECT {_SUM} FROM records WHERE session_id = 'S7' GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0, 0", _REC)
_add("first_sessions", _rec(lambda r: query.all_sessions(r, 5).drop("operators")), f"SELECT {_SUM}, min(seq) AS first_seq FROM records GROUP BY 1 ORDER BY first_seq LIMIT 5", _REC)
_add("by_pulse", _rec(lambda r: query.where(r, F.col("pulse_id") == 3).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE pulse_id = 3", _REC)
_add("extract_series", _rec(query.time_series), "SELECT ts_us, coalesce(score, 0) AS score FROM records", _REC)
_add("events_all_tags", _rec(lambda r: query.with_all_tags(r, ["error", "HIGH"]).select(*_FULL)), f"SELECT {_FULL_SQL} FROM records WHERE list_has_all(flags, ['error', 'HIGH'])", _REC)
_add("flag_frequency", _rec(query.flag_frequency), "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM records) GROUP BY 1", _REC)
_add("operator_frequency", _rec(lambda r: reports.frequency(r, "operator")), "SELECT operator, count(*) AS n FROM records GROUP BY 1", _REC)
_add("score_stats", _rec(query.score_stats), "SELECT coalesce(min(score), 0) AS min_score, coalesce(max(score), 0) AS max_score, round(coalesce(avg(score), 0), 6) AS mean_score, count(*) AS n FROM records", _REC)
_add("session_counts", _rec(query.session_counts), "SELECT coalesce(session_id, 'unknown') AS session_id, count(*) AS n FROM records GROUP BY 1", _REC)
_add("recent_events", _rec(lambda r: r.orderBy(F.desc("ts_us"), F.desc("seq")).limit(50).select("seq", "ts_us", "operator")), "SELECT seq, ts_us, operator FROM records ORDER BY ts_us DESC, seq DESC LIMIT 50", _REC)
_add("top_windows", _rec(lambda r: query.top_k(r, 10, ["session_id"], [F.desc("score"), F.asc("seq")]).select("session_id", "rank", "seq", "score")),
     "SELECT session_id, rn AS rank, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq) AS rn FROM records) WHERE rn <= 10", _REC)
_add("pulse_batches", _rec(reports.pulse_batches), "SELECT pulse_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT worker_id) AS workers FROM records GROUP BY 1", _REC)


def _time_range(r: DataFrame) -> DataFrame:
    lo = r.agg(F.min("ts_us").alias("lo"))
    return query.time_range(r.crossJoin(F.broadcast(lo)), F.col("lo") + 86_400_000_000, F.col("lo") + 2 * 86_400_000_000).select(*_FULL)  # one row


def _since(r: DataFrame) -> DataFrame:
    hi = r.agg(F.max("ts_us").alias("hi"))
    return query.manipulation_since(r.crossJoin(F.broadcast(hi)), F.col("hi") - 1_800_000_000, 60).select(*_FULL)  # one row


def _ranged(r: DataFrame) -> DataFrame:
    lo = r.agg(F.min("ts_us").alias("lo"))
    return query.events_in_range(r.crossJoin(F.broadcast(lo)), F.col("lo"), F.col("lo") + 86_400_000_000, "error", ["error", "HIGH"]).select(*_FULL)  # one row


def _recent(r: DataFrame) -> DataFrame:
    hi = r.agg(F.max("ts_us").alias("hi"))
    return query.last_n_minutes(r.crossJoin(F.broadcast(hi)), F.col("hi"), 1440, 0.5).select(*_FULL)  # one row


# windows over rows
_BURST = """SELECT {by} min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, max(score) AS peak, string_agg(DISTINCT operator, ',' ORDER BY operator) AS operators FROM (
    SELECT *, sum(new) OVER ({over} ORDER BY ts_us, seq) AS island FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER ({over} ORDER BY ts_us, seq) <= {gap} THEN 0 ELSE 1 END AS new FROM records WHERE score > 0.75))
    GROUP BY {by} island HAVING count(*) >= {least}"""
_add("bursts", _rec(lambda r: query.bursts(r, 0.75, 1_800_000_000, 3)), _BURST.format(by="", over="", gap=1800000000, least=3), _REC)
_add("record_bursts", _rec(lambda r: query.bursts(r, 0.75, 1_800_000_000, 3, record_order=True, bucket_rows=700)), """SELECT arg_min(ts_us, seq) AS start_us, arg_max(ts_us, seq) AS end_us, count(*) AS n, max(score) AS peak, string_agg(DISTINCT operator, ',' ORDER BY operator) AS operators FROM (
    SELECT *, sum(new) OVER (ORDER BY seq) AS island FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (ORDER BY seq) <= 1800000000 THEN 0 ELSE 1 END AS new FROM records WHERE score > 0.75)) GROUP BY island HAVING count(*) >= 3""", _REC)
_add("session_bursts", _rec(lambda r: query.bursts(r, 0.75, 14_400_000_000, 2, ["session_id"])), _BURST.format(by="session_id,", over="PARTITION BY session_id", gap=14400000000, least=2), _REC)
_add("capsule", _rec(lambda r: windows.capsules(r, "user_id").select("seq", F.array_join(F.transform("before", lambda x: x.cast("string")), ",").alias("before"), F.array_join(F.transform("after", lambda x: x.cast("string")), ",").alias("after"), "span_us")),
     """SELECT seq, coalesce(array_to_string(list_reverse(list(seq) OVER (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), ','), '') AS before,
     coalesce(array_to_string(list(seq) OVER (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), ','), '') AS after,
     max(ts_us) OVER w - min(ts_us) OVER w AS span_us FROM records WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""", _REC)
_add("cross_stream_capsule", lambda s, d: _cross(records(s, d)), """SELECT a.seq AS anchor_id, r.operator AS source, count(*) AS n, min(r.ts_us) AS first_us, max(r.ts_us) AS last_us
     FROM records a JOIN records r ON r.ts_us BETWEEN a.ts_us - 600000000 AND a.ts_us + 600000000 WHERE a.operator = 'error' AND a.score > 0.75 GROUP BY 1, 2""", _REC)
_add("chain_events", lambda s, d: reports.chain_events(table(s, d, "orders").withColumnRenamed("o_orderkey", "chain"), table(s, d, "lineitem").withColumnRenamed("l_orderkey", "chain"), "chain", ["l_shipdate", "l_linenumber"]).select("chain", "place", "l_linenumber", "o_custkey", "l_shipdate"),
     "SELECT o_orderkey AS chain, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber)::INT AS place, l_linenumber, o_custkey, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
_add("chain_bounds", lambda s, d: reports.chain_bounds(table(s, d, "lineitem"), "l_orderkey", "l_shipdate"),
     "SELECT l_orderkey, count(*) AS events, min(l_shipdate) AS starts, max(l_shipdate) AS ends, ((max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) // 1000000)::BIGINT AS seconds FROM lineitem GROUP BY 1")
_NEAR = """SELECT p.seq AS probe_id, h.ts_us AS near_us, h.seq AS near_id FROM records p LEFT JOIN LATERAL (SELECT c.ts_us, c.seq FROM records c WHERE c.operator = 'click' AND abs(c.ts_us - p.ts_us) {op} {tol}
     ORDER BY abs(c.ts_us - p.ts_us), c.ts_us, CASE WHEN c.ts_us < p.ts_us THEN -c.seq ELSE c.seq END LIMIT 1) h ON true WHERE p.operator = 'error'"""
_add("nearest_asof", lambda s, d: _nearest(records(s, d), 600_000_000, False), _NEAR.format(op="<=", tol=600000000), _REC)
_add("nearest_asof_strict", lambda s, d: _nearest(records(s, d), 300_000_000, True), _NEAR.format(op="<", tol=300000000), _REC)
_add("modality_overlap", lambda s, d: temporal.interval_overlap(streams(s, d)), """SELECT a.modality AS first, b.modality AS second, greatest(a.lo, b.lo) < least(a.hi, b.hi) AS overlaps, abs(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS micros
     FROM s a JOIN s b ON a.modality < b.modality""", _STR + ", s AS (SELECT modality, min(ts_us) AS lo, max(ts_us) AS hi FROM streams GROUP BY 1)")


def _cross(r: DataFrame) -> DataFrame:
    a = r.where("operator = 'error' and score > 0.75").select(F.col("seq").alias("anchor_id"), F.col("ts_us").alias("anchor_us"))
    return temporal.band_join(a, r.select("ts_us", "operator"), 600_000_000).groupBy("anchor_id", F.col("operator").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def _nearest(r: DataFrame, tolerance: int, strict: bool) -> DataFrame:
    p = r.where("operator = 'error'").select(F.col("seq").alias("probe_id"), "ts_us")
    c = r.where("operator = 'click'").select("ts_us", F.col("seq").alias("ord"), F.col("seq").alias("payload"))
    return temporal.nearest_join(p, c, tolerance, strict=strict).select("probe_id", "near_us", F.col("payload").alias("near_id"))


# anchors, blocks, analyses
def _anchors(s, d):
    return fusion.anchors(records(s, d), ("error",))


def _slices(s, d):
    return fusion.slices(_anchors(s, d), streams(s, d), 120_000_000, 300_000_000)


def _blocks(s, d):
    return fusion.block_scores(_slices(s, d))


_add("anchors", _anchors, "SELECT * FROM anchors", _ANC)
_add("anchor_distribution", lambda s, d: reports.anchor_distribution(_anchors(s, d)), "SELECT anchor_type, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score, min(score) AS min_score FROM anchors GROUP BY 1", _ANC)
_add("anchor_flags", lambda s, d: reports.anchor_flags(_anchors(s, d), records(s, d)), "SELECT anchor_type, flag, count(*) AS n FROM (SELECT anchor_type, unnest(flags) AS flag FROM anchors JOIN records ON seq = anchor_id) GROUP BY 1, 2", _ANC)
_add("fusion_slices", lambda s, d: _slices(s, d).select("anchor_id", "frame", "modality", "near_us", F.col("payload.ord").alias("ord")), "SELECT anchor_id, frame::INT AS frame, modality, near_us, ord FROM slices", _BLK)
_add("block_scores", _blocks, "SELECT anchor_id, filled, pre_input, pre_network, post_input, at_vision, post_network, alignment, coherence, chain FROM blocks", _BLK)
_add("modality_coverage", lambda s, d: fusion.modality_coverage(_slices(s, d)), "SELECT modality, count(*) AS slices, count(near_us) AS filled, round(100.0 * count(near_us) / count(*), 6) AS pct FROM slices GROUP BY 1", _BLK)
_PAT = ("pre_input", "pre_network", "post_network", "post_input", "chain")
_add("temporal_patterns", lambda s, d: fusion.temporal_patterns(_blocks(s, d)), "SELECT count(*) AS blocks, " + ", ".join(f"count_if({c})::BIGINT AS {c}, round(100.0 * count_if({c}) / count(*), 6) AS {c}_pct" for c in _PAT) + " FROM blocks", _BLK)
_add("block_anomalies", lambda s, d: fusion.block_anomalies(_blocks(s, d), _anchors(s, d)), """SELECT * FROM (SELECT b.anchor_id, anchor_us, anchor_type, concat_ws(',', CASE WHEN at_vision AND score > 0.7 THEN 'HIGH_EOMM_SCORE:' || round_even(score::DECIMAL(20, 10), 2)::DECIMAL(20, 2) END,
     CASE WHEN alignment < 0.1 THEN 'LOW_ALIGNMENT:' || round_even(alignment::DECIMAL(20, 10), 2)::DECIMAL(20, 2) END, CASE WHEN coherence < 0.2 THEN 'LOW_COHERENCE:' || round_even(coherence::DECIMAL(20, 10), 2)::DECIMAL(20, 2) END) AS issues
     FROM blocks b JOIN anchors a ON a.anchor_id = b.anchor_id) WHERE issues <> ''""", _BLK)
_add("block_alignment", lambda s, d: fusion.alignment(_slices(s, d)).select("anchor_id", "alignment", F.array_join(F.transform(F.array_sort(F.map_keys("coverage")), lambda k: F.concat_ws("=", k, F.round(13 * F.col("coverage")[k]).cast("int").cast("string"))), ",").alias("coverage")),
     """SELECT anchor_id, round(sum(k) / 78.0, 6) AS alignment, coalesce(string_agg(modality || '=' || k, ',' ORDER BY modality) FILTER (k > 0), '') AS coverage FROM (SELECT anchor_id, modality, count(near_us) AS k FROM slices GROUP BY 1, 2) GROUP BY 1""", _BLK)
_add("fusion_blocks", lambda s, d: fusion.blocks(_anchors(s, d), _slices(s, d)).select("block_id", "anchor_id", F.size("frames").alias("frames"), F.expr("aggregate(frames, 0, (a, f) -> a + coalesce(size(map_keys(f.events)), 0))").alias("events"), F.expr("frames[6].events['vision'].payload.ord").alias("centre")),
     """SELECT printf('block_%06d_%s', row_number() OVER (ORDER BY anchor_us, a.anchor_id) - 1, anchor_type) AS block_id, a.anchor_id, 13 AS frames, filled::INT AS events, a.anchor_id AS centre FROM anchors a JOIN parts p ON p.anchor_id = a.anchor_id""", _BLK)
_add("blocks_by_hour", lambda s, d: reports.by_hour(_anchors(s, d)), "SELECT (anchor_us // 3600000000 % 24)::INT AS hour, count(*) AS n, count_if(score > 0.9)::BIGINT AS high FROM anchors GROUP BY 1", _ANC)
_add("network_top", lambda s, d: reports.most_common(streams(s, d).where("modality = 'network'"), "user_id", 10),
     "SELECT user_id, n FROM (SELECT user_id::VARCHAR AS user_id, count(*) AS n, min(ord) AS first FROM streams WHERE modality = 'network' GROUP BY 1) ORDER BY n DESC, first LIMIT 10", _STR)
_NET = """, net AS (SELECT ord, 'p' || (user_id % 5) AS process, ['ESTABLISHED', 'LISTEN', 'TIME_WAIT'][ord % 3 + 1] AS state, CASE WHEN user_id % 2 = 0 THEN 'TCP' END AS protocol, user_id % 12 AS port FROM streams WHERE modality = 'network')"""
_add("network_activity", lambda s, d: reports.network_activity(_connections(s, d)), """SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first) AS rn FROM (SELECT kind, value, count(*) AS n, min(ord) AS first FROM (
     SELECT ord, 'process' AS kind, process AS value FROM net UNION ALL SELECT ord, 'state', state FROM net UNION ALL SELECT ord, 'protocol', coalesce(protocol, 'unknown') FROM net UNION ALL SELECT ord, 'port', port::VARCHAR FROM net WHERE port <> 0) GROUP BY 1, 2)) WHERE rn <= 10 OR kind IN ('state', 'protocol')""", _STR + _NET)
_add("activity_context", lambda s, d: reports.activity_context(_focus(s, d)), """SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first) AS rn FROM (SELECT kind, value, count(*) AS n, min(ord) AS first FROM (
     SELECT ord, 'app' AS kind, operator AS value FROM streams WHERE modality = 'activity' UNION ALL SELECT ord, 'title', repeat('w' || user_id || ' ', 12)[:50] FROM streams WHERE modality = 'activity' AND user_id % 7 <> 0) GROUP BY 1, 2)) WHERE rn <= 10 OR kind = 'app'""", _STR)
_add("timeline_stats", lambda s, d: reports.timeline_stats(streams(s, d)),
     "SELECT modality, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, round(count(*) * 1e6 / nullif(max(ts_us) - min(ts_us), 0), 6) AS per_second FROM streams GROUP BY 1", _STR)
_SEN = (
    _REC
    + """, sensed AS (SELECT CASE operator WHEN 'error' THEN 'vision' WHEN 'click' THEN 'input' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'gamepad' WHEN 'signup' THEN 'process' END AS source, ts_us // 3600000000 AS window_key, seq AS ord,
    ['key_press', 'mouse_move', 'mouse_click'][seq % 3 + 1] AS key_type, ['stick', 'button'][seq % 2 + 1] AS pad_type, score, [['AIM_RESISTANCE', 'CROSSHAIR_LOCK', 'HITBOX_DRIFT'][seq % 3 + 1]] AS flags, floor(value)::BIGINT AS sent, 'p' || (user_id % 5) AS process_name, value, user_id FROM records),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key, source ORDER BY ord) AS rn FROM sensed WHERE source IS NOT NULL) WHERE rn <= 1000),
    fused AS (SELECT window_key, count_if(source = 'vision')::BIGINT AS vision_events, first(score ORDER BY score DESC, ord) FILTER (source = 'vision') AS vision_score, first(flags ORDER BY score DESC, ord) FILTER (source = 'vision') AS vf, (30 * count_if(source = 'vision'))::BIGINT AS frame_count,
      count_if(source = 'input')::BIGINT AS input_events, count_if(source = 'input' AND key_type = 'key_press')::BIGINT AS key_presses, count_if(source = 'input' AND key_type = 'mouse_move')::BIGINT AS mouse_moves, count_if(source = 'input' AND key_type = 'mouse_click')::BIGINT AS mouse_clicks,
      count_if(source = 'network')::BIGINT AS network_events, coalesce(sum(sent) FILTER (source = 'network'), 0)::BIGINT AS bytes_sent, coalesce(sum(100 * sent) FILTER (source = 'network'), 0)::BIGINT AS bytes_recv, count_if(source = 'network')::BIGINT AS packets,
      count_if(source = 'gamepad')::BIGINT AS gamepad_events, count_if(source = 'gamepad' AND pad_type = 'stick')::BIGINT AS stick_events, count_if(source = 'gamepad' AND pad_type = 'button')::BIGINT AS button_events,
      count_if(source = 'process')::BIGINT AS process_events, count(DISTINCT process_name) FILTER (source = 'process')::INT AS unique_processes, round(avg(value) FILTER (source = 'process'), 6) AS cpu_avg, round(avg(user_id) FILTER (source = 'process'), 6) AS memory_avg FROM kept GROUP BY 1)"""
)
_add("fused_windows", lambda s, d: _fused(fusion.fused_windows(sensor_events(s, d), 3600)), """SELECT * EXCLUDE (vf), array_to_string(vf, ',') AS vision_flags,
     concat_ws(',', CASE WHEN vision_events > 0 THEN 'vision' END, CASE WHEN input_events > 0 THEN 'input' END, CASE WHEN network_events > 0 THEN 'network' END, CASE WHEN gamepad_events > 0 THEN 'gamepad' END, CASE WHEN process_events > 0 THEN 'process' END) AS sources_present,
     concat_ws(',', CASE WHEN input_events > 0 AND vision_score > 0.7 AND list_contains(vf, 'AIM_RESISTANCE') AND mouse_moves < 5 THEN 'AIM_LOCK_NO_INPUT' END, CASE WHEN network_events > 0 AND vision_score > 0.7 AND bytes_recv > 10000 THEN 'MANIPULATION_STABLE_NETWORK' END,
     CASE WHEN gamepad_events > 0 AND stick_events < 3 AND (list_contains(vf, 'AIM_RESISTANCE') OR list_contains(vf, 'CROSSHAIR_LOCK')) THEN 'AIM_WITHOUT_GAMEPAD' END, CASE WHEN input_events > 0 AND list_contains(vf, 'HITBOX_DRIFT') AND key_presses < 2 THEN 'HITBOX_DRIFT_NO_REACTION' END) AS correlations FROM fused""", _SEN)


def _fused(w: DataFrame) -> DataFrame:
    return w.withColumns({**{c: F.array_join(c, ",") for c in ("vision_flags", "sources_present", "correlations")}, **{c: F.round(c, 6) for c in ("cpu_avg", "memory_avg")}})


# statistics
_TEN = "w10 AS (SELECT ts_us // 600000000 * 600000000 AS start_us, count(*) AS n, max(score) AS peak FROM records GROUP BY 1)"


def _ten(r: DataFrame) -> DataFrame:
    return r.groupBy((F.floor(F.col("ts_us") / 600_000_000) * 600_000_000).alias("start_us")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("peak"))


_add("cooccurrence", _rec(lambda r: stats.cooccurrence(r.withColumn("w", F.floor(F.col("ts_us") / 600_000_000)), "w", "operator")), "SELECT a.operator AS first, b.operator AS second, sum(CASE WHEN a.operator = b.operator THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END)::BIGINT AS pairs, round(100.0 * sum(CASE WHEN a.operator = b.operator THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END) / (SELECT count(DISTINCT w) FROM o), 6) AS pct FROM o a JOIN o b ON a.w = b.w AND a.operator <= b.operator GROUP BY 1, 2 HAVING pairs > 0",
     _REC + ", o AS (SELECT ts_us // 600000000 AS w, operator, count(*) AS c FROM records GROUP BY 1, 2)")
_add("cascades", _rec(lambda r: stats.cascades(_ten(r), 600_000_000)), "SELECT *, next_us - start_us AS duration_us, n + next_n AS total FROM (SELECT start_us, n, lead(start_us) OVER (ORDER BY start_us) AS next_us, lead(n) OVER (ORDER BY start_us) AS next_n FROM w10) WHERE n >= 2 AND next_n >= 1 AND next_us - start_us <= 600000000", _REC + ", " + _TEN)
_add("fingerprint_stats", _rec(reports.fingerprint_stats),
     "SELECT operator, round(avg(score), 6) AS mean, max(score) AS most, min(score) AS least, count_if(score > 0)::BIGINT AS triggered, count_if(score > 0.9)::BIGINT AS extreme, arg_max(ts_us, seq) - arg_min(ts_us, seq) AS span_us FROM records GROUP BY 1", _REC)
_add("signature_rates", _rec(lambda r: reports.signature_rates(_ten(r), "peak", 0.9)), "SELECT count(*) AS n, count_if(peak > 0.9)::BIGINT AS events, round(count_if(peak > 0.9) / count(*), 6) AS rate, round(any_value(m), 6) AS mean, round(any_value(s), 6) AS deviation, count_if(s > 0 AND peak > m + 2 * s)::BIGINT AS outliers FROM w10, (SELECT avg(peak) AS m, stddev_samp(peak) AS s FROM w10)", _REC + ", " + _TEN)
_DET = ", w AS (SELECT ts_us // 600000000 AS w, max(score) AS feature, list({'operator': operator, 'confidence': score}) AS detections, count(*) AS n FROM records GROUP BY 1)"
_add("signature_events", _rec(lambda r: reports.signature_events(_detections(r), "feature", "error", 0.9).select("w", F.col("detection.confidence").alias("confidence"))),
     "SELECT w, x.confidence AS confidence FROM (SELECT w, unnest(detections) AS x FROM w WHERE feature > 0.9) WHERE x.operator = 'error'", _REC + _DET)
_add("high_activity", _rec(lambda r: reports.high_activity(r.withColumn("w", F.floor(F.col("ts_us") / 600_000_000)), "w").select("w", "detections", F.array_join("operators", ",").alias("operators"), "overall")),
     "SELECT ts_us // 600000000 AS w, count(*) AS detections, string_agg(operator, ',' ORDER BY operator) AS operators, max(score) AS overall FROM records GROUP BY 1 HAVING count(*) >= 3", _REC)
_add("signature_outliers", _rec(lambda r: stats.outliers(_ten(r).select("start_us", "n"), "n")), "SELECT start_us, n FROM w10, (SELECT avg(n) AS m, stddev_samp(n) AS s FROM w10) WHERE s > 0 AND n > m + 2 * s", _REC + ", " + _TEN)
_QUANT = "round((v[least(greatest({k} * (len(v) + 1) // {n}, 1), len(v) - 1)] * ({n} - ({k} * (len(v) + 1) - least(greatest({k} * (len(v) + 1) // {n}, 1), len(v) - 1) * {n})) + v[least(greatest({k} * (len(v) + 1) // {n}, 1), len(v) - 1) + 1] * ({k} * (len(v) + 1) - least(greatest({k} * (len(v) + 1) // {n}, 1), len(v) - 1) * {n})) / {n}, 6)"
_add("profile_quantiles", _rec(lambda r: stats.profile(r, "user_id", "value")), f"SELECT user_id, n, mean, deviation, least, most, {_QUANT.format(n=2, k=1)} AS median, {_QUANT.format(n=4, k=1)} AS p25, {_QUANT.format(n=4, k=3)} AS p75, CASE WHEN n < 10 THEN most ELSE {_QUANT.format(n=10, k=9)} END AS p90, non_zero, round(non_zero / n, 6) AS rate FROM g",
     _REC + ", g AS (SELECT user_id, count(value) AS n, count_if(value > 0)::BIGINT AS non_zero, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS deviation, min(value) AS least, max(value) AS most, list_sort(list(value)) AS v FROM records GROUP BY 1)")
_add("operator_fingerprints", _rec(lambda r: reports.operator_fingerprints(r, ["value", "user_id"])), """SELECT operator, metric, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS deviation, min(v) AS least, max(v) AS most FROM (
     SELECT operator, unnest(['score', 'value', 'user_id']) AS metric, unnest([score, value, user_id::DOUBLE]) AS v FROM records) GROUP BY 1, 2""", _REC)
_add("operator_flags", _rec(reports.operator_flags), "SELECT operator, flag, count(*) AS n FROM (SELECT operator, unnest(flags) AS flag FROM records) GROUP BY 1, 2", _REC)
_add("thresholds", _rec(lambda r: stats.thresholds(r.where("user_id % 2 = 0"), r.where("user_id % 2 = 1"), "operator", "score", ["value"])),
     """SELECT operator, metric, CASE WHEN metric = 'confidence' THEN round_even((me + mh) / 2, 2) ELSE round_even(((me + se) + (mh - sh)) / 2, 3) END AS threshold FROM (SELECT operator, metric, avg(v) FILTER (user_id % 2 = 0) AS me, coalesce(stddev_samp(v) FILTER (user_id % 2 = 0), 0) AS se, avg(v) FILTER (user_id % 2 = 1) AS mh,
     coalesce(stddev_samp(v) FILTER (user_id % 2 = 1), 0) AS sh FROM (SELECT operator, user_id, unnest(['confidence', 'value']) AS metric, unnest([score, value]) AS v FROM records) GROUP BY 1, 2) WHERE me IS NOT NULL AND mh IS NOT NULL""", _REC)
_add("transition", _rec(lambda r: windows.transition(r, "user_id", ["ts_us", "seq"], "score")), """SELECT user_id, first_index, CASE WHEN first_index IS NOT NULL THEN 'mixed' WHEN mean < 0.4 THEN 'easy' ELSE 'hard' END AS side FROM (SELECT user_id, min(CASE WHEN i >= 1 AND i < n - 10 AND gain > 0.3 THEN i END) AS first_index, avg(score) AS mean FROM (SELECT user_id, score, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
     avg(score) OVER (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) - avg(score) OVER (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS gain FROM records WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, seq)) GROUP BY 1)""", _REC)
_add("combat_report", _rec(reports.combat_report),
     "SELECT session_id, count(*) AS n, min(score) AS least, round(avg(score), 6) AS mean, max(score) AS most, count_if(score >= 0.7)::BIGINT AS high, count_if(score >= 0.4 AND score < 0.7)::BIGINT AS medium, count_if(score < 0.4)::BIGINT AS low, max(ts_us) - min(ts_us) AS span_us, round(count(*) * 1e6 / nullif(max(ts_us) - min(ts_us), 0), 6) AS per_second FROM records GROUP BY 1", _REC)
_add("combat_flags", _rec(reports.combat_flags), "SELECT session_id, flag, n, round(100.0 * n / total, 6) AS pct, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, flag)::INT AS place FROM (SELECT session_id, flag, count(*) AS n FROM (SELECT session_id, unnest(flags) AS flag FROM records) GROUP BY 1, 2) JOIN (SELECT session_id, count(*) AS total FROM records GROUP BY 1) USING (session_id)", _REC)
_WEIGHTS = {"click": 0.3, "error": 0.3, "purchase": 0.25, "view": 0.15}
_add("composite_score", _rec(lambda r: stats.composite(r, _WEIGHTS, "pulse_id")), """SELECT pulse_id, composite, composite >= 0.5 AS manipulation, composite >= 0.75 AS high_confidence, flags FROM (SELECT r.pulse_id, round(CASE WHEN sum(w) > 0 THEN greatest(0, least(1, sum(score * w) / sum(w))) ELSE 0 END, 6) AS composite, any_value(fl.flags) AS flags
     FROM (SELECT *, CASE operator WHEN 'click' THEN 0.3::DOUBLE WHEN 'error' THEN 0.3::DOUBLE WHEN 'purchase' THEN 0.25::DOUBLE WHEN 'view' THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS w FROM records) r
     JOIN (SELECT pulse_id, string_agg(DISTINCT f, ',' ORDER BY f) AS flags FROM (SELECT pulse_id, unnest(flags) AS f FROM records) GROUP BY 1) fl ON fl.pulse_id = r.pulse_id GROUP BY 1)""", _REC)
_add("seal_sessions", _rec(lambda r: reports.seal_sessions(r).select("session_id", "n", "peak", F.array_join(F.transform("offenders", lambda o: o["seq"].cast("string")), ",").alias("offenders"))), "SELECT session_id, count(*) AS n, max(score) AS peak, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS offenders FROM records WHERE score >= 0.7 GROUP BY 1 HAVING count(*) >= 3", _REC)
_add("evidence", _rec(lambda r: reports.evidence(r).select("session_id", "n", "mean", F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("findings", lambda o: o["seq"].cast("string")), ",").alias("findings"))),
     """SELECT session_id, any_value(n) AS n, any_value(mean) AS mean, any_value(fl) AS flags, string_agg(seq::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 20) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS rn FROM records WHERE score > 0.5)
     JOIN (SELECT session_id, count(*) AS n, round(avg(score), 6) AS mean FROM records WHERE score > 0.5 GROUP BY 1) USING (session_id) JOIN (SELECT session_id, string_agg(DISTINCT f, ',' ORDER BY f) AS fl FROM (SELECT session_id, unnest(flags) AS f FROM records WHERE score > 0.5) GROUP BY 1) USING (session_id) GROUP BY 1""", _REC)
_add("daily_usage", _rec(lambda r: reports.daily_usage(r, "ts", "value").withColumn("severity", scalar.disk_severity(F.lit(3000), F.col("mean_bytes")))), """SELECT *, CASE WHEN 3000 < mean_bytes THEN 'critical' WHEN 3000 < 3 * mean_bytes THEN 'warning' END AS severity FROM (
     SELECT dt, bytes, floor(avg(bytes) OVER (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::BIGINT AS mean_bytes FROM (SELECT strftime(ts, '%Y%m%d') AS dt, sum(floor(value))::BIGINT AS bytes FROM records GROUP BY 1))""", _REC)


def _connections(s, d) -> DataFrame:
    n = streams(s, d).where("modality = 'network'")
    state = F.get(F.array(*[F.lit(x) for x in ("ESTABLISHED", "LISTEN", "TIME_WAIT")]), (F.col("ord") % 3).cast("int"))
    return n.select("ts_us", "ord", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("process"), state.alias("state"), F.when(F.col("user_id") % 2 == 0, "TCP").alias("protocol"), (F.col("user_id") % 12).alias("port"))


def _focus(s, d) -> DataFrame:
    title = F.when(F.col("user_id") % 7 != 0, F.repeat(F.concat(F.lit("w"), F.col("user_id").cast("string"), F.lit(" ")), 12))
    return streams(s, d).where("modality = 'activity'").select("ts_us", "ord", F.col("operator").alias("process"), title.alias("title"))


def _detections(r: DataFrame) -> DataFrame:
    w = F.floor(F.col("ts_us") / 600_000_000).alias("w")
    return r.groupBy(w).agg(F.max("score").alias("feature"), F.collect_list(F.struct("operator", F.col("score").alias("confidence"))).alias("detections"))


# ordered changes and folds
_add("change_only", _rec(lambda r: windows.change_only(r, "user_id", ["ts_us", "seq"], ["operator"]).select("user_id", "seq", "operator")), "SELECT user_id, seq, operator FROM (SELECT *, lag(operator) OVER w AS o, row_number() OVER w AS rn FROM records WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, seq)) WHERE rn = 1 OR o IS DISTINCT FROM operator", _REC)
_add("first_seen", _rec(lambda r: windows.first_seen(r, "user_id", ["ts_us", "seq"]).select("user_id", "seq", "ts_us")), "SELECT user_id, seq, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS rn FROM records) WHERE rn = 1", _REC)
_add("monotone_clamp", _rec(lambda r: windows.monotone_clamp(r, "session_id", ["seq"], "value").select("seq", "clock")), "SELECT seq, max(value) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS clock FROM records", _REC)
_add("dead_band", _rec(lambda r: windows.dead_band(r, "user_id", ["ts_us", "seq"], "value", 10.0).select("user_id", "seq", "value")), """SELECT user_id, x.seq AS seq, x.value AS value FROM (SELECT user_id, unnest(r.out) AS x FROM (SELECT user_id, list_reduce(list({'last': value, 'out': [{'seq': seq, 'value': value}]} ORDER BY ts_us, seq),
     lambda a, x: CASE WHEN abs(x.last - a.last) > 10 THEN {'last': x.last, 'out': list_concat(a.out, x.out)} ELSE a END) AS r FROM records GROUP BY 1))""", _REC)
_FOLD = """SELECT {key}, r.n AS n, r.rej AS rejected, round(r.mean, 6) AS mean, round(CASE WHEN r.n >= 2 THEN sqrt(r.m2 / (r.n - 1)) ELSE 0 END, 6) AS deviation, r.n >= {warm} AS warmed_up FROM (SELECT {key}, list_reduce(list_prepend({{'v': 0.0::DOUBLE, 'n': 0::BIGINT, 'mean': 0.0::DOUBLE, 'm2': 0.0::DOUBLE, 'rej': 0::BIGINT}},
     list({{'v': {value}::DOUBLE, 'n': 0::BIGINT, 'mean': 0.0::DOUBLE, 'm2': 0.0::DOUBLE, 'rej': 0::BIGINT}} ORDER BY {order})), lambda a, x: CASE WHEN a.n >= {warm} AND a.m2 > 0 AND abs(x.v - a.mean) > {z} * sqrt(greatest(a.m2, 0) / greatest(a.n - 1, 1))
     THEN {{'v': 0.0::DOUBLE, 'n': a.n, 'mean': a.mean, 'm2': a.m2, 'rej': a.rej + 1}} ELSE {{'v': 0.0::DOUBLE, 'n': a.n + 1, 'mean': a.mean + (x.v - a.mean) / (a.n + 1), 'm2': a.m2 + (x.v - a.mean) * (x.v - (a.mean + (x.v - a.mean) / (a.n + 1))), 'rej': a.rej}} END) AS r FROM {table} GROUP BY 1)"""
_LINES = ["l_shipdate", "l_orderkey", "l_linenumber"]
_add("baseline_fold", lambda s, d: windows.welford(table(s, d, "lineitem"), "l_suppkey", _LINES, "l_quantity", 1.6), _FOLD.format(key="l_suppkey", value="l_quantity", order=", ".join(_LINES), table="lineitem", warm=5, z=1.6))
for _rule, (_z, _warm) in windows.RULES.items():
    _add(f"baseline_{_rule}", _rec(lambda r, z=_z, warm=_warm: windows.welford(r, "user_id", ["ts_us", "seq"], "value", z, warm)), _FOLD.format(key="user_id", value="value", order="ts_us, seq", table="records", warm=_warm, z=_z), _REC)
_add("baseline_scores", _rec(lambda r: windows.baseline_scores(r, "user_id", ["ts_us", "seq"], "value", 1e9).select("user_id", "seq", "z")),
     "SELECT user_id, seq, round(CASE WHEN k >= 2 AND sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(*) OVER w AS k FROM records WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", _REC)
_add("chain_links", _rec(lambda r: windows.verify_chain(windows.chained(r.withColumn("line", F.concat_ws("|", F.col("seq").cast("string"), "operator")), "user_id", ["seq"], "line"), "user_id", ["seq"], "line").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("valid").alias("valid"), F.max_by("_sha", "seq").alias("head"))),
     """SELECT user_id, count(*) AS n, true AS valid, list_reduce(list_prepend(repeat('0', 64), list(seq || '|' || operator ORDER BY seq)), lambda a, x: sha256(a || x)) AS head FROM records GROUP BY 1""", _REC)
_add("pulse_numbers", _rec(lambda r: _pulses(r)),
     "SELECT worker_id, pulse_id, count(*) AS n, min(place)::BIGINT AS first FROM (SELECT worker_id, (row_number() OVER (PARTITION BY worker_id ORDER BY ts_us, seq) - 1) // 105 + 1 AS pulse_id, row_number() OVER (PARTITION BY worker_id ORDER BY ts_us, seq) AS place FROM records) GROUP BY 1, 2", _REC)
_add("warnings_throttled", _rec(lambda r: windows.throttled(r.withColumn("severity", F.when(F.col("score") > 0.5, "high").otherwise("low")), "user_id", "ts_us", "severity", 0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))), "SELECT user_id, count(*) AS n FROM records GROUP BY 1", _REC)
_add("mirror_buffer", _rec(lambda r: windows.mirrored(r, "worker_id", ["ts_us", "seq"], "ts_us", 3600.0).groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))),
     "SELECT worker_id, count(*) AS n, min(seq) AS first FROM (SELECT *, max(ts_us) OVER (PARTITION BY worker_id) AS newest FROM records) WHERE ts_us >= newest - 3600000000 GROUP BY 1", _REC)
_add("hash_chain", _rec(lambda r: windows.hash_chain(r.withColumn("line", F.concat_ws("|", F.col("seq").cast("string"), "operator")), "user_id", ["seq"], "line")), """SELECT user_id, n::INT AS n, head FROM (SELECT user_id, count(*) AS n, list_reduce(list_prepend(repeat('0', 64), list(seq || '|' || operator ORDER BY seq)), lambda a, x: sha256(a || x)) AS head FROM records GROUP BY 1)""", _REC)
_add("idle_islands", _rec(lambda r: windows.quiet_islands(r, "user_id", ["ts_us", "seq"], "value", 2, 3).groupBy("user_id", "state").agg(F.count(F.lit(1)).alias("n"), F.max("quiet").alias("longest"))),
     """SELECT user_id, CASE WHEN quiet >= 3 THEN 'stalled' WHEN quiet >= 2 THEN 'idle' ELSE 'active' END AS state, count(*) AS n, max(quiet)::INT AS longest FROM (SELECT *, row_number() OVER (PARTITION BY user_id, isle ORDER BY ts_us, seq) - 1 AS quiet FROM (SELECT *, sum(grew) OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS isle FROM (
     SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, seq) OR lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, seq) IS NULL THEN 1 ELSE 0 END AS grew FROM records))) GROUP BY 1, 2""", _REC)
_add("record_mapping", _rec(lambda r: _mapped(r)), """SELECT seq, pulse_id, worker_id, round(ts_us / 1e6, 3) AS timestamp, score <= 0.5 AS success, CASE WHEN score > 0.5 THEN 'eomm_above_threshold' END AS failure_reason, session_id, 1000::BIGINT AS window_duration_ms, array_to_string(list_sort(flags), ',') AS flags, operator AS operators,
     user_id % 3 = 0 AS is_benchmark, user_id % 5 = 0 AS is_baseline_bot, user_id % 3 <> 0 AND user_id % 5 <> 0 AS is_human FROM records""", _REC)


def _mapped(r: DataFrame) -> DataFrame:
    user = F.col("user_id")
    w = r.withColumns({"end_us": F.col("ts_us") + 1_000_000, "operators": F.array("operator", "operator"), "source": F.when(user % 3 == 0, "benchmark"), "bot_difficulty": F.when(user % 5 == 0, "easy")})
    return reports.record_of_window(w).withColumns({"timestamp": F.round("timestamp", 3), "flags": F.array_join("flags", ","), "operators": F.array_join("operators", ",")})


def _pulses(r: DataFrame) -> DataFrame:
    p = windows.pulse_numbers(r.select("worker_id", "ts_us", "seq", F.col("ts_us").alias("at"), F.lit(5_000).alias("size")).withColumnRenamed("seq", "row"), "worker_id", ["ts_us", "row"], "at", "size", micros=10**18)
    return p.groupBy("worker_id", "pulse_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))  # 105 rows of 5,000 bytes fill a pulse


# grids
_grid = lambda f: lambda s, d: f(frames(s, d))
_add("grid_palette", lambda s, d: frames(s, d).select(F.explode("grid").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "SELECT v AS cell, count(*) AS n FROM cells GROUP BY 1", _FRM)
_add("flicker", _grid(grid.flicker), "SELECT window_id, round(ratio, 6) AS ratio, round(least(1.0, ratio / 0.5), 6) AS confidence FROM (SELECT window_id, count_if(f >= 3) / count(*) AS ratio FROM (SELECT window_id, k, count_if(abs(v - p) >= 2) AS f FROM cells WHERE n >= 3 AND p IS NOT NULL GROUP BY 1, 2) GROUP BY 1) WHERE ratio > 0.05", _FRM)
_add("hud_stability", _grid(grid.hud_stability), """SELECT window_id, round(greatest(b, t), 6) AS instability, round(least(1.0, greatest(b, t) / 0.1), 6) AS confidence, concat_ws(',', CASE WHEN b > 0.02 THEN 'bottom' END, CASE WHEN t > 0.02 THEN 'top' END) AS unstable FROM (
     SELECT window_id, avg(CASE WHEN y = 7 THEN (v <> p)::INT END) AS b, avg(CASE WHEN y = 0 THEN (v <> p)::INT END) AS t FROM cells WHERE p IS NOT NULL GROUP BY 1) WHERE greatest(b, t) > 0.02""", _FRM)
_wide = lambda f: lambda s, d: f(frames(s, d, 3))  # noqa: E731  24 x 24, each cell shown three times either way
_SIDE = grid.Shape(24, 24)
_F24 = _FRM + """, wide AS (SELECT window_id, frame_id, i, n, k // 24 AS y, k % 24 AS x, grid[k // 72 * 8 + k % 24 // 3 + 1] AS v, last[k // 72 * 8 + k % 24 // 3 + 1] AS p FROM seqd, (SELECT unnest(range(576)) AS k))"""
_EDGE = """SELECT window_id, avg((abs(v - p) >= 3)::INT) FILTER (y < 3) AS t, avg((abs(v - p) >= 3)::INT) FILTER (y >= 21) AS b, avg((abs(v - p) >= 3)::INT) FILTER (y >= 3 AND y < 21 AND x < 3) AS l, avg((abs(v - p) >= 3)::INT) FILTER (y >= 3 AND y < 21 AND x >= 21) AS r,
     avg((abs(v - p) >= 3)::INT) FILTER (y < 3 OR y >= 21 OR x < 3 OR x >= 21) AS w FROM wide WHERE p IS NOT NULL GROUP BY 1"""
_add("peripheral_flash", _wide(lambda f: grid.peripheral_flash(f, shape=_SIDE)), f"""SELECT window_id, round(greatest(t, b, l, r), 6) AS flash, round(w, 6) AS overall, CASE greatest(t, b, l, r) WHEN t THEN 'top' WHEN b THEN 'bottom' WHEN l THEN 'left' ELSE 'right' END AS edge, round(least(1.0, greatest(t, b, l, r) / 0.03), 6) AS confidence
     FROM ({_EDGE}) WHERE greatest(t, b, l, r) > 0.03""", _F24)
_EMD = """SELECT window_id, round(emd, 6) AS emd, round(mean_step, 6) AS mean_frame_emd, round(max_step, 6) AS max_frame_emd, round(least(1.0, emd / {alert}), 6) AS confidence FROM (SELECT window_id, sum(abs(u)) AS emd FROM (SELECT window_id, bin, sum(d) OVER (PARTITION BY window_id ORDER BY bin) AS u FROM (
     SELECT window_id, bin, count_if(v = bin AND i < n // 2) / (count_if(i < n // 2)) - count_if(v = bin AND i >= n // 2) / (count_if(i >= n // 2)) AS d FROM cells, (SELECT unnest(range(10)) AS bin) WHERE n >= 10 GROUP BY 1, 2)) GROUP BY 1)
     JOIN (SELECT window_id, avg(e) AS mean_step, max(e) AS max_step FROM (SELECT window_id, i, sum(abs(u)) AS e FROM (SELECT window_id, i, sum(d) OVER (PARTITION BY window_id, i ORDER BY bin) AS u FROM (SELECT window_id, i, bin, (count_if(v = bin) - count_if(p = bin)) / 64.0 AS d FROM cells, (SELECT unnest(range(10)) AS bin) WHERE p IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY 1) USING (window_id) WHERE emd > {alert}"""
_add("color_shift", _grid(grid.color_shift), _EMD.format(alert=0.3), _FRM)
_add("color_shift_low", _grid(lambda f: grid.color_shift(f, 0.1)), _EMD.format(alert=0.1), _FRM)
_add("flicker_base", _grid(grid.flicker_base), "SELECT window_id, round(ratio, 6) AS ratio, round(least(1.0, ratio * 10), 6) AS confidence FROM (SELECT window_id, count_if(f >= 3) / count(*) AS ratio FROM (SELECT window_id, k, count_if(abs(v - p) >= 2) AS f FROM cells WHERE n >= 3 AND p IS NOT NULL GROUP BY 1, 2) GROUP BY 1) WHERE ratio > 0.05", _FRM)
_MOT = """cen AS (SELECT window_id, i, coalesce(sum(v * y) FILTER (m) / nullif(sum(v) FILTER (m), 0), 24) AS cy, coalesce(sum(v * x) FILTER (m) / nullif(sum(v) FILTER (m), 0), 24) AS cx FROM (SELECT *, y BETWEEN 8 AND 14 AND x BETWEEN 8 AND 14 AS m FROM wide WHERE n >= 5) GROUP BY 1, 2),
    stp AS (SELECT *, sqrt(pow(cy - lag(cy) OVER w, 2) + pow(cx - lag(cx) OVER w, 2)) AS d FROM cen WINDOW w AS (PARTITION BY window_id ORDER BY i)),
    trn AS (SELECT *, lag(d) OVER (PARTITION BY window_id ORDER BY i) AS q FROM stp),
    mot AS (SELECT window_id, 1 / (1 + var_pop(d)) AS s, count_if(d > 5) / count(d) AS sn, count_if(d > 0.5 AND q > 0.5 AND abs(d - q) > 1) / greatest(1, count(d) - 1) AS tt, avg(d) AS m, count_if(d > 5) AS c FROM trn GROUP BY 1),
    moc AS (SELECT *, greatest(CASE WHEN s > 0.95 THEN (s - 0.95) / 0.05 ELSE 0 END, CASE WHEN sn > 0.1 THEN least(1.0, 5 * sn) ELSE 0 END) AS confidence FROM mot WHERE s > 0.95 OR sn > 0.1)"""
_add("crosshair_motion", _wide(lambda f: grid.crosshair_motion(f, shape=_SIDE)), "SELECT window_id, round(s, 6) AS smoothness, round(sn, 6) AS snap_score, round(tt, 6) AS stutter_score, round(m, 6) AS mean_motion, c::BIGINT AS snap_count, round(confidence, 6) AS confidence FROM moc", _F24 + ", " + _MOT)
_LOCK = """aim AS (SELECT window_id, i, count_if((y - 12) * (y - 12) + (x - 12) * (x - 12) <= 1 AND v BETWEEN 5 AND 9) / 5.0 > 0.2 AS o, count_if((y - 12) * (y - 12) + (x - 12) * (x - 12) <= 1 AND v = 9) / 5.0 > 0.1 AS h,
      coalesce(sum(v * y) / nullif(sum(v), 0), 12) AS cy, coalesce(sum(v * x) / nullif(sum(v), 0), 12) AS cx FROM wide WHERE n >= 5 GROUP BY 1, 2),
    aims AS (SELECT *, sqrt(pow(cy - lag(cy) OVER w, 2) + pow(cx - lag(cx) OVER w, 2)) AS d FROM aim WINDOW w AS (PARTITION BY window_id ORDER BY i)),
    lck AS (SELECT window_id, count(*) AS f, count_if(o) AS k, count_if(h) AS h, avg(d) AS m, CASE WHEN count(d) >= 5 AND avg(d) FILTER (NOT o) > 0 THEN avg(d) FILTER (o) / avg(d) FILTER (NOT o) END AS r FROM aims GROUP BY 1 HAVING count_if(o) >= 3),
    lcs AS (SELECT *, coalesce(CASE WHEN r < 0.7 THEN (0.7 - r) / 0.7 WHEN r > 1 THEN least(1.0, r - 1) END, 0) AS res, CASE WHEN k > 5 AND h / k < 0.2 THEN (0.2 - h / k) / 0.2 WHEN k > 5 AND h / k > 0.6 THEN (h / k - 0.6) / 0.4 ELSE 0 END AS eff FROM lck)"""
_add("crosshair_lock", _wide(lambda f: grid.crosshair_lock(f, _SIDE)), """SELECT window_id, k AS on_target, h::BIGINT AS hits, round(k / f, 6) AS intersection, round(h / k, 6) AS efficiency, round(res, 6) AS resistance, round(m, 6) AS mean_motion, round(least(1.0, greatest(res, eff)), 6) AS confidence,
     concat_ws(',', CASE WHEN res > 0.3 THEN 'AIM_RESISTANCE' END, CASE WHEN eff > 0.5 THEN 'HITBOX_DRIFT' END) AS flags FROM lcs""", _F24 + ", " + _LOCK)
_add("hit_registration", _wide(lambda f: grid.hit_registration(f, _SIDE)), """SELECT window_id, m AS markers, g AS ghosts, round(g / m, 6) AS ghost_ratio, round(coalesce(gap, 0), 6) AS mean_gap, c AS confirmed_frames, round(CASE WHEN g / m > 0.3 THEN (g / m - 0.3) / 0.7 ELSE 0 END, 6) AS confidence,
     concat_ws(',', CASE WHEN g / m > 0.3 THEN 'GHOST_HITS' END, CASE WHEN g / m > 0.5 THEN 'DAMAGE_SUPPRESSION' END) AS flags FROM (
     SELECT window_id, count_if(marker)::BIGINT AS m, count_if(marker AND NOT conf)::INT AS g, count_if(seen)::BIGINT AS c, avg(i - last_marker) FILTER (marker) AS gap FROM (SELECT *, max(CASE WHEN marker THEN i END) OVER (PARTITION BY window_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_marker,
     max(seen::INT) OVER (PARTITION BY window_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS conf FROM (SELECT window_id, i, avg((v = 9)::INT) FILTER (z <= 9) > 0.05 AS marker,
     avg((v IN (7, 8))::INT) > 0.02 OR coalesce(avg((v <> p)::INT) FILTER (z > 16) > 0.1, false) AS seen FROM (SELECT *, (y - 12) * (y - 12) + (x - 12) * (x - 12) AS z FROM wide WHERE n >= 5) GROUP BY 1, 2)) GROUP BY 1) WHERE m > 0""", _F24)
_DEATH = """SELECT window_id, dmg AS damage_frames, fst AS first_hit, dth AS death_frame, dth - fst AS frames_to_death, fl AS flinches, round(coalesce(strength, 0), 6) AS flinch_strength, round(CASE WHEN fl > 10 THEN least(1.0, fl / 20) ELSE 0 END, 6) AS confidence,
     CASE WHEN fl > 10 THEN 'INCOMING_DAMAGE_SPIKE' ELSE '' END AS flags FROM (SELECT window_id, count_if(hurt)::BIGINT AS dmg, min(CASE WHEN hurt THEN i END)::INT AS fst, min(CASE WHEN dead THEN i END)::INT AS dth, count_if(coalesce(shake, 0) > 0.1)::BIGINT AS fl, avg(shake) FILTER (shake > 0.1) AS strength FROM (
     SELECT *, min(CASE WHEN dead THEN i END) OVER (PARTITION BY window_id) AS e FROM (SELECT window_id, i, greatest(count_if(y < 2 AND v IN (7, 8)), count_if(y >= 22 AND v IN (7, 8)), count_if(x < 2 AND v IN (7, 8)), count_if(x >= 22 AND v IN (7, 8))) / 48.0 > 0.05 AS hurt, avg(abs(v - p)) / 9.0 AS shake,
     var_pop(v) < 2 OR count_if((y < 2 OR y >= 22) AND (x < 2 OR x >= 22) AND v = {screen}) > 0.4 AS dead FROM wide WHERE n >= 5 GROUP BY 1, 2)) WHERE e IS NULL OR i <= e GROUP BY 1) WHERE dmg > 0"""
_add("death_event", _wide(lambda f: grid.death_event(f, _SIDE)), _DEATH.format(screen=9), _F24)
_add("death_event_plain", _wide(lambda f: grid.death_event(f, _SIDE, screen=99)), _DEATH.format(screen=99), _F24)
_ENTRY = """ent AS (SELECT window_id, n, i, unnest([avg((v >= 5)::INT) FILTER (y < 3) - avg((p >= 5)::INT) FILTER (y < 3), avg((v >= 5)::INT) FILTER (y >= 21) - avg((p >= 5)::INT) FILTER (y >= 21), avg((v >= 5)::INT) FILTER (y BETWEEN 3 AND 20 AND x < 3) - avg((p >= 5)::INT) FILTER (y BETWEEN 3 AND 20 AND x < 3),
      avg((v >= 5)::INT) FILTER (y BETWEEN 3 AND 20 AND x >= 21) - avg((p >= 5)::INT) FILTER (y BETWEEN 3 AND 20 AND x >= 21)]) AS d, unnest(['rear', 'front', 'side', 'side']) AS zone FROM wide WHERE n >= 3 AND p IS NOT NULL GROUP BY 1, 2, 3),
    enr AS (SELECT window_id, count(*) AS k, count_if(zone = 'rear') AS rear, count_if(zone = 'front') AS front, count_if(zone = 'side') AS side, (max(i) - min(i)) / nullif(count(*) - 1, 0) AS gap FROM ent WHERE d > 0.05 GROUP BY 1),
    dur AS (SELECT window_id, (max(vec_id * 1000000 // 30) - min(vec_id * 1000000 // 30)) / 1000000.0 AS sec FROM (SELECT vec_id, vec_id // 30 AS window_id FROM embeddings) GROUP BY 1),
    ens AS (SELECT enr.*, coalesce(gap, 0) AS g, CASE WHEN sec > 0 THEN k / sec ELSE 0 END AS rate FROM enr JOIN dur USING (window_id))"""
_add("edge_entry", _wide(lambda f: grid.edge_entry(f, _SIDE)), """SELECT window_id, k::BIGINT AS entries, rear::BIGINT AS rear, front::BIGINT AS front, side::BIGINT AS side, round(rate, 6) AS rate, round(g, 6) AS mean_gap, (g < 5 AND k > 3)::INT AS clustered,
     round(least(1.0, greatest(CASE WHEN rear / k > 0.4 THEN (rear / k - 0.4) / 0.6 ELSE 0 END, CASE WHEN rate > 3 THEN least(1.0, (rate - 3) / 3) ELSE 0 END, CASE WHEN g < 5 AND k > 3 THEN 0.5 ELSE 0 END)), 6) AS confidence,
     concat_ws(',', CASE WHEN rear / k > 0.4 THEN 'SPAWN_PRESSURE' END, CASE WHEN rate > 3 THEN 'SPAWN_BIAS' END) AS flags FROM ens""", _F24 + ", " + _ENTRY)
_FIVE = f"""fl AS (SELECT window_id, least(1.0, r / 0.5) AS c FROM (SELECT window_id, count_if(f >= 3) / count(*) AS r FROM (SELECT window_id, y, x, count_if(abs(v - p) >= 2) AS f FROM wide WHERE n >= 3 AND p IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1) WHERE r > 0.05),
    hu AS (SELECT window_id, least(1.0, greatest(b, t) / 0.1) AS c FROM (SELECT window_id, avg((v <> p)::INT) FILTER (y >= 21) AS b, avg((v <> p)::INT) FILTER (y < 3) AS t FROM wide WHERE p IS NOT NULL GROUP BY 1) WHERE greatest(b, t) > 0.02),
    pf AS (SELECT window_id, least(1.0, greatest(t, b, l, r) / 0.03) AS c FROM ({_EDGE}) WHERE greatest(t, b, l, r) > 0.03),
    cs AS (SELECT window_id, least(1.0, emd / 0.3) AS c FROM (SELECT window_id, sum(abs(u)) AS emd FROM (SELECT window_id, bin, sum(d) OVER (PARTITION BY window_id ORDER BY bin) AS u FROM (SELECT window_id, bin, count_if(v = bin AND i < n // 2) / (count_if(i < n // 2)) - count_if(v = bin AND i >= n // 2) / (count_if(i >= n // 2)) AS d FROM cells, (SELECT unnest(range(10)) AS bin) WHERE n >= 10 GROUP BY 1, 2)) GROUP BY 1) WHERE emd > 0.3)"""
_add("grid_fingerprint", _wide(lambda f: grid.fingerprint(f, _SIDE)), """SELECT window_id, round(coalesce(fl.c, 0), 6) AS flicker, round(coalesce(hu.c, 0), 6) AS hud, round(coalesce(mo.confidence, 0), 6) AS crosshair, round(coalesce(pf.c, 0), 6) AS flash, round(coalesce(cs.c, 0), 6) AS color, round(greatest(coalesce(fl.c, 0), coalesce(hu.c, 0), coalesce(mo.confidence, 0), coalesce(pf.c, 0), coalesce(cs.c, 0)), 6) AS overall,
     concat_ws(',', CASE WHEN fl.c IS NOT NULL THEN 'flicker' END, CASE WHEN hu.c IS NOT NULL THEN 'hud_stability' END, CASE WHEN mo.confidence IS NOT NULL THEN 'crosshair_motion' END, CASE WHEN pf.c IS NOT NULL THEN 'peripheral_flash' END, CASE WHEN cs.c IS NOT NULL THEN 'color_shift' END) AS detections
     FROM (SELECT DISTINCT window_id FROM frames) LEFT JOIN fl USING (window_id) LEFT JOIN hu USING (window_id) LEFT JOIN moc mo USING (window_id) LEFT JOIN pf USING (window_id) LEFT JOIN cs USING (window_id)""", _F24 + ", " + _MOT + ", " + _FIVE)
_add("run_detectors", _wide(lambda f: grid.run_all(f, [grid.crosshair_lock_of(_SIDE), grid.crosshair_motion_of(_SIDE), grid.edge_entry_of(_SIDE)]).withColumn("flags", F.array_join("flags", ","))),
     """SELECT window_id, 'crosshair_lock' AS operator, round(least(1.0, greatest(res, eff)), 6) AS confidence, concat_ws(',', CASE WHEN res > 0.3 THEN 'AIM_RESISTANCE' END, CASE WHEN eff > 0.5 THEN 'HITBOX_DRIFT' END) AS flags FROM lcs UNION ALL SELECT window_id, 'crosshair_motion', round(confidence, 6), '' FROM moc
     UNION ALL SELECT window_id, 'edge_entry', round(least(1.0, greatest(CASE WHEN rear / k > 0.4 THEN (rear / k - 0.4) / 0.6 ELSE 0 END, CASE WHEN rate > 3 THEN least(1.0, (rate - 3) / 3) ELSE 0 END, CASE WHEN g < 5 AND k > 3 THEN 0.5 ELSE 0 END)), 6), concat_ws(',', CASE WHEN rear / k > 0.4 THEN 'SPAWN_PRESSURE' END, CASE WHEN rate > 3 THEN 'SPAWN_BIAS' END) FROM ens""", _F24 + ", " + _LOCK + ", " + _MOT + ", " + _ENTRY)
_add("count_windows", lambda s, d: grid.count_windows(table(s, d, "embeddings").select(F.col("label").alias("source"), F.col("vec_id").alias("seq")), 30, "source", "seq").groupBy("source", "window_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")),
     "SELECT source, window_id, count(*) AS n, min(seq) AS first, max(seq) AS last FROM (SELECT label AS source, vec_id AS seq, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 30 AS window_id FROM embeddings) GROUP BY 1, 2 HAVING count(*) = 30")

# more reports
_add("timeline_merge", lambda s, d: events.numbered(streams(s, d), ["ord", "modality"], "place").select("modality", "ord", "ts_us", "place"),
     "SELECT modality, ord, ts_us, row_number() OVER (ORDER BY ts_us, ord, modality) AS place FROM streams", _STR)
_add("event_records", lambda s, d: events.as_records(_created(s, d)).select("pulse_id", "seq", "task_id", "success", "engine_id", "transform_id", F.round("timestamp", 3).alias("timestamp"), F.get_json_object("params", "$.tags[0]").alias("tag"), F.get_json_object("context", "$.user").alias("user_id")),
     "SELECT counter AS pulse_id, counter AS seq, operator AS task_id, true AS success, 'event_pipeline_v1' AS engine_id, 'sensor_event' AS transform_id, round(ts_us / 1e6, 3) AS timestamp, flags[1] AS tag, user_id::VARCHAR AS user_id FROM (SELECT *, row_number() OVER (ORDER BY ts_us, seq) AS counter FROM records)", _REC)
_add("event_creation", lambda s, d: _created(s, d).select("event_id", "counter", "ts_us", "source_id", F.array_join("tags", ",").alias("tags"), F.element_at("metadata", "user").alias("user_id")), """SELECT printf('evt_%08d', counter) AS event_id, counter, ts_us, source_id, tags, user_id FROM (SELECT row_number() OVER (ORDER BY ts_us, seq) AS counter, ts_us, operator AS source_id, array_to_string(flags, ',') AS tags, user_id::VARCHAR AS user_id FROM records)""", _REC)
_add("streams_retained", _rec(lambda r: events.retained(r, "operator", ["ts_us", "seq"], 300, 1000).select("operator", "seq")), "SELECT operator, seq FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY ts_us DESC, seq DESC) AS rn FROM records) WHERE rn <= 300 ORDER BY ts_us DESC, seq DESC LIMIT 1000", _REC)
_add("monotone_guard", _rec(lambda r: events.monotone_guard(r, "operator", ["seq"]).groupBy("operator").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))), "SELECT operator, count(*) AS n, count_if(ts_us < before)::BIGINT AS late FROM (SELECT *, lag(ts_us) OVER (PARTITION BY operator ORDER BY seq) AS before FROM records) GROUP BY 1", _REC)
_add("sync_timestamps", _rec(lambda r: events.synchronised(r, r.groupBy("session_id").agg(F.min("ts_us").alias("session_us"))).select("seq", F.round("event_offset_ms", 3).alias("event_offset_ms"), "timestamp_iso")), "SELECT seq, round((ts_us - min(ts_us) OVER (PARTITION BY session_id)) / 1000.0, 3) AS event_offset_ms, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp_iso FROM records", _REC)
_add("polls_sampled", _rec(lambda r: events.sampled(r.select("operator", "ts_us").distinct(), "operator", 0.001)), "SELECT operator, min(ts_us) AS ts_us FROM records GROUP BY operator, ts_us // 1000000000", _REC)
_add("topics_bounded", _rec(lambda r: events.drop_oldest(r, "operator", ["ts_us", "seq"])), "SELECT operator, count(*) AS published, greatest(0, count(*) - 1024) AS dropped, least(1024, count(*)) AS kept FROM records GROUP BY 1", _REC)
_add("overall_overlap", lambda s, d: temporal.overall_overlap(streams(s, d)), "SELECT max(lo) AS start_us, min(hi) AS end_us, count(*) AS modalities, max(lo) < min(hi) AS overlaps, abs(min(hi) - max(lo)) AS micros FROM (SELECT modality, min(ts_us) AS lo, max(ts_us) AS hi FROM streams GROUP BY 1)", _STR)
_add("entry_gaps", _rec(lambda r: reports.gaps(r, "user_id", "seq")), "SELECT user_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round((max(seq) - min(seq)) / (count(*) - 1), 6) ELSE 0 END AS mean_gap FROM records GROUP BY 1", _REC)
_add("window_summary", _rec(lambda r: _summed(r)), """SELECT pulse_id, round(CASE WHEN sum(w) > 0 THEN greatest(0, least(1, sum(score * w) / sum(w))) ELSE 0 END, 3) AS composite, CASE WHEN sum(w) > 0 THEN sum(score * w) / sum(w) >= 0.5 ELSE false END AS manipulation, any_value(len(string_split(fl.flags, ',')))::INT AS flag_count, any_value(fl.flags) AS flags, count(*)::INT AS operator_count
     FROM (SELECT *, CASE operator WHEN 'click' THEN 0.3::DOUBLE WHEN 'error' THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS w FROM records) JOIN (SELECT pulse_id, string_agg(DISTINCT f, ',' ORDER BY f) AS flags FROM (SELECT pulse_id, unnest(flags) AS f FROM records) GROUP BY 1) fl USING (pulse_id) GROUP BY 1""", _REC)
_KIN = """, probes AS (SELECT seq, ts_us FROM records WHERE operator = 'view' AND score >= 0.8), logs AS (SELECT *, ['a', 'b', 'c', 'd', 'e', 'f', 'g'][user_id % 7 + 1] AS word FROM records WHERE operator IN ('click', 'error')),
    near AS (SELECT p.seq AS probe, k.operator, h.* EXCLUDE (operator) FROM probes p, (SELECT unnest(['click', 'error']) AS operator) k, LATERAL (SELECT c.seq, c.value, c.user_id, c.word, c.operator FROM logs c WHERE c.operator = k.operator AND abs(c.ts_us - p.ts_us) < 300000000
      ORDER BY abs(c.ts_us - p.ts_us), c.ts_us, CASE WHEN c.ts_us < p.ts_us THEN -c.seq ELSE c.seq END LIMIT 1) h)"""
_add("correlation_summary", _rec(lambda r: _correlated(r)), """SELECT 'input' AS kind, unnest(['mean_idle', 'keys', 'clicks', 'movement']) AS value, round(unnest([avg(user_id), sum(user_id)::DOUBLE, sum(seq)::DOUBLE, sum(value)]), 4) AS n FROM near WHERE operator = 'click'
     UNION ALL SELECT 'state', word, count(*)::DOUBLE FROM near WHERE operator = 'error' GROUP BY 2
     UNION ALL (SELECT 'process', word, n FROM (SELECT word, count(*)::DOUBLE AS n, min(seq) AS first FROM near WHERE operator = 'error' GROUP BY 1) ORDER BY n DESC, first LIMIT 3)
     UNION ALL (SELECT 'title', word, n FROM (SELECT word, count(*)::DOUBLE AS n, min(seq) AS first FROM near WHERE operator = 'click' GROUP BY 1) ORDER BY n DESC, first LIMIT 5)""", _REC + _KIN)
_add("window_caps", lambda s, d: query.top_k(streams(s, d), 100, ["modality"], [F.desc("ts_us"), F.desc("ord")]).select("modality", "ord", "rank"),
     "SELECT modality, ord, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY ts_us DESC, ord DESC) AS rn FROM streams) WHERE rn <= 100", _STR)
_add("overview_bands", _rec(reports.score_bands),
     "SELECT operator, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(score), 6) AS mean FROM records GROUP BY 1, 2", _REC)
_add("activity_top", lambda s, d: reports.most_common(streams(s, d).where("modality = 'activity'"), "operator", 10),
     "SELECT operator, n FROM (SELECT operator, count(*) AS n, min(ord) AS first FROM streams WHERE modality = 'activity' GROUP BY 1) ORDER BY n DESC, first LIMIT 10", _STR)
_add("in_window", lambda s, d: _in_window(s, d), "SELECT anchor_type, count_if(anchor_us BETWEEN lo + 86400000000 AND lo + 10 * 86400000000)::BIGINT AS inside, count_if(NOT anchor_us BETWEEN lo + 86400000000 AND lo + 10 * 86400000000)::BIGINT AS outside FROM anchors, (SELECT min(ts_us) AS lo FROM records) GROUP BY 1", _ANC)
_add("log_correlation", lambda s, d: _log_correlation(s, d), """SELECT p.session_id, count(*) AS windows, count(h.seq) AS matched, round(coalesce(sum(h.score), 0), 6) AS clicks FROM records p LEFT JOIN LATERAL (SELECT c.seq, c.score FROM records c WHERE c.operator = 'click' AND abs(c.ts_us - p.ts_us) < 300000000
     ORDER BY abs(c.ts_us - p.ts_us), c.ts_us, CASE WHEN c.ts_us < p.ts_us THEN -c.seq ELSE c.seq END LIMIT 1) h ON true WHERE p.operator = 'view' AND p.score >= 0.8 GROUP BY 1""", _REC)
_add("validators", lambda s, d: _validated(table(s, d, "events")), """SELECT event_type, count(*) AS n, count_if(json_extract_string(props, '$.k') IS NULL)::BIGINT AS without_k, count_if(value IS NULL OR value < 0)::BIGINT AS bad_value FROM events GROUP BY 1""")
_add("recent_pulses", _rec(reports.recent_pulses), """SELECT worker_id, count(*) AS n, count_if(NOT success)::BIGINT AS failed, round(100.0 * count_if(NOT success) / count(*), 6) AS failed_pct, count(DISTINCT operator) AS operators, array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS flags
     FROM records, (SELECT max(pulse_id) - 5 AS lo FROM records) WHERE pulse_id > lo GROUP BY 1""", _REC)
_add("conversation_chains", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_distinct("role").alias("roles")),
     "SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
_add("motion_trend", _rec(lambda r: reports.motion_trend(r, "session_id", 86_400_000_000)),
     "SELECT session_id, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, max(score) AS most FROM (SELECT *, max(ts_us) OVER (PARTITION BY session_id) AS newest FROM records) WHERE ts_us >= newest - 86400000000 GROUP BY 1", _REC)


def _created(s: SparkSession, d: str) -> DataFrame:
    r = records(s, d).select("ts_us", "seq", F.col("operator").alias("source_id"), F.col("flags").alias("tags"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"))
    return events.created(r, ["seq"])


def _summed(r: DataFrame) -> DataFrame:
    w = r.withColumn("weight", F.when(F.col("operator").isin("click", "error"), 0.3).otherwise(0.0))
    return reports.window_summary(w, "pulse_id", {"click": ["value"], "error": ["value", "user_id"]}).withColumn("flags", F.array_join("flags", ",")).drop("operators")


def _correlated(r: DataFrame) -> DataFrame:
    word = F.get(F.array(*[F.lit(x) for x in "abcdefg"]), (F.col("user_id") % 7).cast("int"))
    log = lambda op: r.where(F.col("operator") == op).withColumnRenamed("seq", "ord")
    inputs = log("click").select("ts_us", "ord", F.col("user_id").alias("idle"), F.col("user_id").alias("keys"), F.col("ord").alias("clicks"), F.col("value").alias("movement"))
    network = log("error").select("ts_us", "ord", word.alias("state"), word.alias("process"))
    out = reports.correlation_summary(r.where("operator = 'view'"), inputs, network, log("click").select("ts_us", "ord", word.alias("title")), 0.8, 300_000_000)
    return out.withColumn("n", F.round("n", 4))

_PRO = (
    _REC
    + ", kinds AS (SELECT * FROM (VALUES "
    + ", ".join("(" + str(k) + ", " + ", ".join(f"'{x}'" for x in p) + ")" for k, p in enumerate(PROCESSES))
    + f") AS k(k, name, parent, account, path, command)), processes AS (SELECT seq, kinds.* FROM records JOIN kinds ON user_id % {len(PROCESSES)} = k)"
)
_add("process_origins", lambda s, d: _processes(s, d), """SELECT origin, suspicious, noise, count(*) AS n FROM (SELECT CASE WHEN upper(account) IN ('SYSTEM', 'LOCAL SERVICE', 'NETWORK SERVICE', 'NT AUTHORITY\\SYSTEM') THEN 'system_service'
     WHEN contains(lower(parent), 'explorer.exe') OR contains(path, 'Users\\') AND contains(path, '\\AppData\\') THEN 'user_initiated' WHEN contains(lower(parent), 'services.exe') THEN 'system_service' WHEN parent = '' THEN 'external_triggered' ELSE 'unknown' END AS origin,
     regexp_matches(upper(parent), 'WINWORD|EXCEL|POWERPNT|OUTLOOK') AND ends_with(lower(name), '.exe') OR regexp_matches(lower(parent), 'chrome|firefox|msedge|iexplore') AND lower(name) IN ('powershell.exe', 'cmd.exe', 'wscript.exe', 'cscript.exe')
     OR contains(path, '\\Temp\\') OR contains(path, '\\Downloads\\') OR contains(lower(name), 'powershell') AND contains(lower(command), '-enc') AS suspicious, name = 'svchost.exe' AS noise FROM processes) GROUP BY 1, 2, 3""", _PRO)
_add("idle_resets", _rec(lambda r: windows.resets(r, "user_id", ["ts_us", "seq"], "value").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))),
     "SELECT user_id, count(*) AS n, max(seq) AS last FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS b FROM records) WHERE value < b GROUP BY 1", _REC)
_add("nth_window", _rec(lambda r: query.nth(r, 3, ["session_id"], [F.asc("ts_us"), F.asc("seq")]).select(*_FULL)), f"SELECT {_FULL_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS rn FROM records) WHERE rn = 3", _REC)
_add("multi_read", _rec(lambda r: query.read_many(r, "seq", [40, 7, 40, -1, 0]).select("place", *_FULL)), f"SELECT place::INT AS place, {_FULL_SQL} FROM records JOIN (VALUES (0, 40), (1, 7), (2, 40), (3, -1), (4, 0)) AS w(place, k) ON seq = k", _REC)
_add("filled_timestamps", _rec(lambda r: with_timestamp(r.select("seq", (F.floor(F.col("ts_us") / 1_000_000)).cast("double").alias("t_start"), F.when(F.col("seq") % 3 == 0, "kept").alias("timestamp"))).select("seq", "timestamp")),
     "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'kept' ELSE strftime(make_timestamp(ts_us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') END AS timestamp FROM records", _REC)


def _processes(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    p = processes(s, d).select(scalar.process_origin(c("parent"), c("account"), c("path")).alias("origin"), scalar.suspicious(c("name"), c("parent"), c("path"), c("command")).alias("suspicious"), scalar.is_noise(c("name")).alias("noise"))
    return p.groupBy("origin", "suspicious", "noise").agg(F.count(F.lit(1)).alias("n"))


def _in_window(s: SparkSession, d: str) -> DataFrame:
    lo = records(s, d).agg(F.min("ts_us").alias("lo"))
    inside = F.col("anchor_us").between(F.col("lo") + 86_400_000_000, F.col("lo") + 10 * 86_400_000_000)
    return _anchors(s, d).crossJoin(F.broadcast(lo)).groupBy("anchor_type").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))  # one row


def _log_correlation(s: SparkSession, d: str) -> DataFrame:
    r = records(s, d)
    p = r.where("operator = 'view' and score >= 0.8").select(F.struct("seq", "session_id").alias("probe_id"), "ts_us")
    c = r.where("operator = 'click'").select("ts_us", F.col("seq").alias("ord"), F.col("score").alias("payload"))
    near = temporal.nearest_join(p, c, 300_000_000, strict=True)
    return near.groupBy("probe_id.session_id").agg(F.count(F.lit(1)).alias("windows"), F.count("near_us").alias("matched"), F.round(F.coalesce(F.sum("payload"), F.lit(0.0)), 6).alias("clicks"))


def _validated(e: DataFrame) -> DataFrame:
    v = F.col("value")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("without_k"), F.count_if(v.isNull() | (v < 0)).alias("bad_value"))
