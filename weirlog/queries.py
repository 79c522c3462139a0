"""Registered queries over the test tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import canonical_key, evaluation_key, semantic_type, strip_text, template_key
from .operators import analysis, audit, buckets, clustering, events, metrics, patterns, replay, similarity
from .plans import mining
from .sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Messages of the events table; both dialects read it but for the JSON field.
_LINE = "'user ' || CAST(user_id AS STRING) || ' did ' || event_type || ' k=' || {k}"
_K = {"spark": "get_json_object(props, '$.k')", "duck": "(props ->> '$.k')"}
_N, _A, _B, _P = "CAST(event_id AS STRING)", "CAST(user_id % 250 AS STRING)", "CAST(event_id % 250 AS STRING)", "CAST(1024 + event_id % 60000 AS STRING)"
#: Messages in the manner of many systems, so that every rule has something to mask.
_SHAPES = [
    f"'Received block blk_-' || {_N} || ' src: /10.250.' || {_A} || '.' || {_B} || ':50010 dest: /10.0.0.1:' || {_P}",
    f"'proxy.cse.example.hk:' || {_P} || ' close, ' || {_N} || ' bytes (1.2 KB) sent, 10 MB received, lifetime <1 sec (IPv6) 12:34:56'",
    f"'sshd[' || {_N} || ']: Failed password for user' || {_A} || ' from 1.2.3.' || {_B} || ' port ' || {_P} || ' ssh2 (uid=' || {_A} || ') ()'",
    f"'authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=host' || {_A} || ' user=root'",
    f"'Task attempt_2015_0001_m_' || {_N} || ' done on host-' || {_A} || '.example.com/10.1.2.' || {_B} || ':' || {_P} || ' 0xdeadbeef 12/34 obj@1a2b'",
    f"'shutting down ' || {_N} || ' error = broken pipe [myid:' || {_A} || '] [main:' || {_P} || ']'",
    f"'program /usr/bin/app' || {_A} || ' exited mc=ff R' || CAST(10 + user_id % 90 AS STRING) || ' Target=' || {_N} || ' Status(0) chdir(/tmp) Source file=a.c Function=main end'",
    f"'Wake reason: EC.' || {_N}",
    f"'Sandbox: app.name(' || {_N} || ') deny(1) network-outbound en0: URL: http://a.b/c?x=' || {_A} || ' source path:/a/b 00:11:22:33:44:55 disk0s2 IPv4'",
    f"'type=3,' || {_A} || ' action:android.intent packageName = com.app steps12mLastReport3 1##2##3 REPORT : 1 2 3 totalSteps=1Calories:2Floor:3Distance:4.5'",
    f"'node-' || {_A} || ' R3i2n1x ib0[' || {_N} || '] /var/log/x.log 10.2.3.4:80'",
    f"'name=instance-' || {_N} || ' HTTP/1.1 req-01234567-89ab-cdef-0123-456789abcdef 512MB pci_stats=[a, b] 1.2.3.4,5.6.7.8 2.5'",
    f"'Running task 0.0 in stage 1.0 (TID ' || {_N} || ') executor ' || {_A} || ' block rdd_2_' || {_B} || ' broadcast_3_piece0 5.1 MB 12 ms hdfs://h/p shuffle_1_2_3'",
    f"'Expiring session 0x14f05578bd80' || {_A} || ', timeout of 10000ms exceeded (n.leader) 5 (my state)'",
    f"'crond startup succeeded DHCPREQUEST for 1.2.3.4 (5.6.7.8) via eth0: (root) CMD (run ' || {_N} || ') 2005-11-09 [CPU1] user root by (uid=0) map_list = ff'",
    f"'client ' || {_A} || '   has  spaces  [client 1.2.3.' || {_B} || '] maps to host.x, but user bob from 9 ' || {_N}",
]
_SHAPED = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """(idx, event_type, user_id, line, masked) of the events table."""
    line = F.expr(_LINE.format(k=_K["spark"]))
    return _events(spark, sf).select(F.col("event_id").alias("idx"), "event_type", "user_id", line.alias("line")).withColumn("masked", F.regexp_replace("line", r"\bk=\d+", "k=<*>"))


_LINES_SQL = f"lines AS (SELECT event_id AS idx, event_type, user_id, {_LINE.format(k=_K['duck'])} AS line FROM events), m AS (SELECT *, regexp_replace(line, '\\bk=\\d+', 'k=<*>', 'g') AS masked FROM lines)"
_TOKENS_SQL = _LINES_SQL + r", t AS (SELECT *, list_filter(string_split_regex(masked, '\s+'), lambda x: x <> '') AS tokens FROM m)"
_POS_SQL = _TOKENS_SQL + ", p AS (SELECT idx, i - 1 AS pos, tokens[i] AS token FROM t, (SELECT unnest(range(1, 11)) AS i) WHERE i <= len(tokens)), c AS (SELECT pos, token, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT pos, messages, -sum(n / messages * log2(n / messages)) + 0.0 AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY pos) AS messages FROM c) GROUP BY ALL)"


def _q(s: str) -> str:
    return s.replace("'", "''")


#: Rules with look-around, as SQL without: (pattern, replacement) by the rule's own pattern.
_PLAIN = {
    r"(?<=program )[^\s]+": (r"(program )[^\s]+", r"\1<*>"), r"(?<=maps to )[^\s,]+": (r"(maps to )[^\s,]+", r"\1<*>"), r"(?<=for )[^\s]+(?= from)": (r"(for )[^\s]+( from)", r"\1<*>\2"),
    r"(?<=user )[^\s]+(?= from| by)": (r"(user )[^\s]+( from| by)", r"\1<*>\2"), r"^[a-zA-Z0-9]+: (?=from=)": (r"^[a-zA-Z0-9]+: (from=)", r"<*>: \1"),
    r"(?<=data source name ).*": (r"(data source name ).*", r"\1<*>"), r"[a-zA-Z0-9_x]+\s+(?=\(n\.[a-zA-Z]+\)|\(my state\))": (r"[a-zA-Z0-9_x]+\s+(\(n\.[a-zA-Z]+\)|\(my state\))", r"<*> \1"),
}


def _mask_sql(name: str) -> str:
    expr = "line"
    for r in config.RULES[name]:
        pattern, repl = _PLAIN.get(r.pattern, (r.pattern, r.replacement))
        expr = f"regexp_replace({expr}, '{_q(pattern.replace(chr(92) + '@', '@'))}', '{_q(repl)}', '{'gi' if 'IGNORECASE' in r.flags else 'g'}')"
    return f"SELECT idx, trim({expr}) AS masked FROM (SELECT event_id AS idx, {_SHAPED} AS line FROM events)"


def _mask_query(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        lines = _events(spark, sf).select(F.col("event_id").alias("idx"), F.expr(_SHAPED).alias("Content"))
        return mining.masked_rows(lines, name).select("idx", "masked")

    run.__name__ = f"mask_{name}"
    query(_mask_sql(name))(run)


for _name in config.RULES:
    _mask_query(_name)


@query(f"WITH {_TOKENS_SQL} SELECT idx, len(tokens)::INTEGER AS n FROM t")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.items(_lines(spark, sf)).select("idx", F.size("tokens").alias("n"))


@query(f"WITH {_POS_SQL} SELECT pos::INTEGER AS pos, token, n FROM c")
def token_position_freq(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.position_counts(buckets.items(_lines(spark, sf)), 10)


@query(f"WITH {_POS_SQL} SELECT pos::INTEGER AS pos, messages::BIGINT AS messages, round(entropy, 6) + 0.0 AS entropy FROM h")
def positional_entropy(spark: SparkSession, sf: str) -> DataFrame:
    h = buckets.positional_entropy(buckets.items(_lines(spark, sf)), 10)
    return h.select("pos", "messages", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query(f"WITH {_POS_SQL} SELECT pos::INTEGER AS pos FROM h WHERE entropy < 2.5 - 1e-12")
def anchor_positions(spark: SparkSession, sf: str) -> DataFrame:
    h = buckets.positional_entropy(buckets.items(_lines(spark, sf)), 10)
    return h.where(F.col("entropy") < 2.5 - 1e-12).select("pos")


@query(f"WITH {_POS_SQL} SELECT 'P0:' || tokens[1] || '_P2:' || tokens[3] || '_P3:' || tokens[4] || CASE WHEN len(tokens) > 4 THEN '_P4:' || tokens[5] ELSE '' END AS bucket, count(*) AS n, min(idx) AS first_idx FROM t GROUP BY 1")
def bucket_sizes(spark: SparkSession, sf: str) -> DataFrame:
    items = buckets.items(_lines(spark, sf))
    places = buckets.anchors(buckets.positional_entropy(items, 10), 2.5)
    return buckets.bucket_sizes(buckets.with_bucket(items, places))


_TOP_SQL = _LINES_SQL + ", f AS (SELECT masked, count(*) AS n, min(idx) AS first_idx FROM m GROUP BY 1), top AS (SELECT (row_number() OVER (ORDER BY n DESC, first_idx) - 1)::BIGINT AS idx, masked, n FROM f QUALIFY idx < {k})"


@query(f"WITH {_TOP_SQL.format(k=200)} SELECT * FROM top")
def freq_topk(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.top_strings(_lines(spark, sf), 200)


_TRAIN_SQL = _TOP_SQL.format(k=200) + r", tr AS (SELECT idx, 'P0:user_P2:did' AS bucket, list_distinct(list_filter(string_split_regex(masked, '\s+'), lambda x: x <> '')) AS s FROM top), pr AS (SELECT a.bucket, a.idx AS i, b.idx AS j, CASE WHEN len(list_distinct(a.s || b.s)) = 0 THEN 1.0 ELSE 1.0 - len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) END AS d FROM tr a JOIN tr b ON a.bucket = b.bucket AND a.idx < b.idx)"


def _training(spark: SparkSession, sf: str, top: int = 200) -> DataFrame:
    """Training strings: the most frequent ones, counted over the whole table, are what is clustered."""
    items = buckets.items(buckets.top_strings(_lines(spark, sf), top))
    return buckets.with_bucket(items, [0, 2])


@query(f"WITH {_TRAIN_SQL} SELECT bucket, i, j, round(d, 9) AS d FROM pr")
def pair_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.pair_distances(_training(spark, sf)).withColumn("d", F.round("d", 9))


@query(f"""WITH {_TRAIN_SQL}, s AS (SELECT bucket, d, row_number() OVER (PARTITION BY bucket ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n, min(d) OVER (PARTITION BY bucket) AS lo, max(d) OVER (PARTITION BY bucket) AS hi FROM pr),
e AS (SELECT *, round(abs(k * (hi - lo) - (d - lo) * (n - 1)), 9) AS far FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY far DESC, k) AS r FROM e)
SELECT bucket, n::BIGINT AS pairs, round(CASE WHEN n = 1 THEN d ELSE least(d, 0.4) END, 6) AS cutoff FROM b WHERE r = 1""")
def elbow_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    c = similarity.elbow_cutoffs(similarity.pair_distances(_training(spark, sf)), 0.6)
    return c.select("bucket", "pairs", F.round("cutoff", 6).alias("cutoff"))


@query()
def mined_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters, aligned templates and their messages of the most frequent strings, as many as a model is trained on."""
    return clustering.number_clusters(clustering.mine_clusters(_training(spark, sf, mining.TOP_STRINGS), clustering.Mining()))


_TYPE_SQL = _TOKENS_SQL + ", w AS (SELECT idx, i - 1 AS pos, tokens[i] AS token, event_type AS cluster FROM t, (SELECT unnest(range(1, 6)) AS i) WHERE i <= len(tokens))"


@query(f"""WITH {_TYPE_SQL}, d AS (SELECT cluster, pos, token, count(*) AS n, min(idx) AS seen FROM w GROUP BY ALL),
ty AS (SELECT *, CASE WHEN regexp_matches(token, '^-?\\d+(\\.\\d+)?$') THEN 'number' ELSE 'literal' END AS type FROM d),
g AS (SELECT cluster, pos, count(DISTINCT type) AS types, sum(n) AS messages, count(*) AS vals, first(type) AS type, arg_max(token, n * 1000000000 - seen) AS value FROM ty GROUP BY ALL),
r AS (SELECT *, CASE WHEN types > 1 OR (type = 'number' AND vals > 1) OR (type = 'literal' AND vals / messages > 0.3) THEN '<*>' ELSE value END AS tok FROM g)
SELECT cluster, max(messages)::BIGINT AS log_count, string_agg(tok, ' ' ORDER BY pos) AS template FROM r GROUP BY 1""")
def pattern_templates(spark: SparkSession, sf: str) -> DataFrame:
    items = buckets.items(_lines(spark, sf)).join(_lines(spark, sf).select(F.col("idx").alias("i"), F.col("event_type").alias("cluster_id")), F.col("idx") == F.col("i"))
    return patterns.mine_patterns(items.select("idx", "tokens", "cluster_id")).withColumnRenamed("cluster_id", "cluster")


_TPL_SQL = _LINES_SQL + ", tp AS (SELECT (row_number() OVER (ORDER BY event_type, b))::INTEGER AS cluster_id, n AS log_count, CASE WHEN b = 0 THEN 'Did ' || event_type ELSE 'did [' || event_type || ']' END AS template FROM (SELECT event_type, user_id % 2 AS b, count(*) AS n FROM m GROUP BY ALL))"


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = _lines(spark, sf).groupBy("event_type", (F.col("user_id") % 2).alias("b")).agg(F.count("*").alias("log_count"))
    t = t.withColumn("cluster_id", F.row_number().over(W.orderBy("event_type", "b")))
    return t.select("cluster_id", "log_count", F.when(F.col("b") == 0, F.concat(F.lit("Did "), "event_type")).otherwise(F.concat(F.lit("did ["), "event_type", F.lit("]"))).alias("template"))


_EVENT_SQL = _TPL_SQL + ", ke AS (SELECT *, lower(regexp_replace(template, '[^a-zA-Z0-9*]', '', 'g')) AS key FROM tp), be AS (SELECT key, log_count, cluster_id, template, row_number() OVER (PARTITION BY key ORDER BY log_count DESC, cluster_id) AS r FROM ke), na AS (SELECT key, row_number() OVER (ORDER BY log_count DESC, cluster_id) AS event_ord, template AS event_template FROM be WHERE r = 1), ev AS (SELECT cluster_id, event_ord::INTEGER AS event_ord, 'E' || event_ord AS event_id, event_template FROM ke JOIN na USING (key))"


@query(f"WITH {_EVENT_SQL} SELECT * FROM ev")
def event_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return events.number_events(_templates(spark, sf))


_MODEL_SQL = _TOP_SQL.format(k=100) + ", ev AS (SELECT event_type, ('E' || row_number() OVER (ORDER BY event_type)) AS event_id, (row_number() OVER (ORDER BY event_type))::INTEGER AS event_ord, 'user <*> did ' || event_type || ' k=<*>' AS event_template FROM (SELECT DISTINCT event_type FROM m)), st AS (SELECT top.masked, ev.event_id, (top.idx + 1)::INTEGER AS cluster_id FROM top JOIN (SELECT DISTINCT masked, event_type FROM m) x USING (masked) JOIN ev USING (event_type))"


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, trained strings, events): a model made by rule, so that replay alone is what is compared."""
    from pyspark.sql import Window as W

    lines = _lines(spark, sf)
    kinds = lines.select("event_type").distinct().withColumn("event_ord", F.row_number().over(W.orderBy("event_type")))
    ev = kinds.select("event_type", F.concat(F.lit("E"), F.col("event_ord").cast("string")).alias("event_id"), "event_ord", F.concat(F.lit("user <*> did "), "event_type", F.lit(" k=<*>")).alias("event_template"))
    top = buckets.top_strings(lines, 100).select("masked", (F.col("idx") + 1).cast("int").alias("cluster_id"))
    kind = lines.select(F.col("masked").alias("x"), "event_type").distinct()
    trained = top.join(kind, F.col("masked") == F.col("x")).join(ev.select("event_type", "event_id"), "event_type").select("masked", "event_id", "cluster_id")
    return lines, trained, ev.select("event_ord", "event_id", "event_template")


_NEAR_SQL = r", es AS (SELECT *, list_distinct(string_split(event_template, ' ')) AS e FROM ev), ss AS (SELECT DISTINCT masked, list_distinct(list_filter(string_split_regex(masked, '\s+'), lambda x: x <> '')) AS s FROM {rows}), sc AS (SELECT masked, event_id, event_ord, len(list_intersect(s, e)) / len(list_distinct(s || e)) AS score FROM ss, es WHERE abs(len(s) - len(e)) <= 12), nb AS (SELECT masked, coalesce(arg_min(event_id, CASE WHEN score {op} 0.85 THEN event_ord END), arg_min(event_id, CASE WHEN score > 0 THEN event_ord - 1000 * round(score, 9) * 1000 END)) AS event_id FROM sc GROUP BY 1)"


@query(f"WITH {_MODEL_SQL}{_NEAR_SQL.format(rows='(SELECT masked FROM m WHERE masked NOT IN (SELECT masked FROM st))', op='>')} SELECT idx, coalesce(st.event_id, nb.event_id, 'E99') AS event_id, CASE WHEN st.event_id IS NOT NULL THEN 'exact' ELSE 'nearest' END AS source FROM m LEFT JOIN st ON st.masked = m.masked LEFT JOIN nb ON nb.masked = m.masked")
def replay_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(*_model(spark, sf)).select("idx", "event_id", "source")


_CANON_SQL = r"array_to_string(list_transform(list_filter(string_split_regex({x}, '\s+'), lambda t: t <> ''), lambda t: CASE WHEN contains(t, '/') THEN '<*>' ELSE regexp_replace(t, '\d+', '<*>', 'g') END), ' ')"


@query(f"WITH {_LINES_SQL} SELECT idx, {_CANON_SQL.format(x='line')} AS canonical FROM m")
def canonical_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("idx", canonical_key(F.col("line")).alias("canonical"))


_CANON_REPLAY_SQL = f"""{_MODEL_SQL}, ck AS (SELECT {_CANON_SQL.format(x='masked')} AS k, arg_min(event_id, cluster_id) AS e2 FROM st GROUP BY 1),
x AS (SELECT m.idx, m.masked, st.event_id AS e1, {_CANON_SQL.format(x='m.masked')} AS k FROM m LEFT JOIN st ON st.masked = m.masked),
y AS (SELECT x.*, ck.e2 FROM x LEFT JOIN ck ON ck.k = x.k),
fi AS (SELECT k, min(idx) AS first_idx, arg_min(masked, idx) AS masked FROM y WHERE e1 IS NULL AND e2 IS NULL GROUP BY 1){_NEAR_SQL.format(rows='fi', op='>=')},
z AS (SELECT y.idx, coalesce(e1, e2, nb.event_id, 'E99') AS event_id, CASE WHEN e1 IS NOT NULL THEN 'exact' WHEN e2 IS NOT NULL THEN 'canonical' WHEN y.idx = first_idx THEN 'nearest' ELSE 'memo' END AS source FROM y LEFT JOIN fi ON fi.k = y.k AND e1 IS NULL AND e2 IS NULL LEFT JOIN nb ON nb.masked = fi.masked)"""


@query(f"WITH {_CANON_REPLAY_SQL} SELECT * FROM z")
def replay_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_canonical(*_model(spark, sf)).select("idx", "event_id", "source")


@query(f"WITH {_CANON_REPLAY_SQL} SELECT count(*) AS rows, count(*) FILTER (source <> 'nearest') AS cache_hits, count(*) FILTER (source = 'nearest') AS fallbacks FROM z")
def replay_counters(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_counters(replay.replay_canonical(*_model(spark, sf)))


@query(f"""WITH {_MODEL_SQL}, d AS (SELECT DISTINCT masked, list_filter(string_split_regex(masked, '\\s+'), lambda t: t <> '') AS s FROM m),
sq AS (SELECT array_to_string(list_filter(string_split_regex(masked, '\\s+'), lambda t: t <> ''), ' ') AS prefix, arg_max(event_id, cluster_id) AS event_id FROM st GROUP BY 1),
e AS (SELECT masked, len(s) AS n, i AS matched, array_to_string(s[1:i], ' ') AS prefix FROM d, (SELECT unnest(range(1, 12)) AS i) WHERE i <= len(s)),
b AS (SELECT masked, arg_max(event_id, matched) AS event_id, max(matched) AS matched FROM e JOIN sq USING (prefix) WHERE matched >= 0.5 * n GROUP BY 1)
SELECT d.masked, b.event_id, coalesce(b.matched, 0)::INTEGER AS matched, len(s)::INTEGER AS n FROM d LEFT JOIN b ON b.masked = d.masked""")
def trie_prefix(spark: SparkSession, sf: str) -> DataFrame:
    lines, trained, _ = _model(spark, sf)
    return replay.prefix_matches(lines.select("masked").distinct(), trained)


#: Ground truth is the event type; the prediction merges two types and splits one, by rule.
_PRED = "CASE WHEN event_type IN ('click', 'view') THEN 'did <A> look' WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'did purchase even' ELSE 'Did ' || event_type END"
_TRUTH = "'did ' || event_type"
_KEY_SQL = "lower(regexp_replace(regexp_replace({x}, '<[^>\n]*>', '*', 'g'), '[^a-zA-Z0-9*]', '', 'g'))"
_PAIR_SQL = f"{_LINES_SQL}, al AS (SELECT idx AS id, {_KEY_SQL.format(x=_TRUTH)} AS gt, {_KEY_SQL.format(x=_PRED)} AS pred FROM m), ct AS (SELECT gt, pred, count(*) AS n FROM al GROUP BY ALL)"


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(F.col("idx").cast("string").alias("LineId"), F.col("line").alias("Content"), F.expr(_TRUTH).alias("EventTemplate"), "idx")


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(F.col("idx").cast("string").alias("LineId"), F.col("line").alias("Content"), F.expr(_PRED).alias("EventTemplate"), "idx")


@query(f"WITH {_PAIR_SQL} SELECT * FROM ct")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.contingency(metrics.align(_truth(spark, sf), _predicted(spark, sf)))


@query(f"""WITH {_PAIR_SQL}, k AS (SELECT *, sum(n) OVER (PARTITION BY gt) AS g, sum(n) OVER (PARTITION BY pred) AS p FROM ct),
o AS (SELECT sum(n)::BIGINT AS rows, count(DISTINCT gt) AS gt_clusters, count(DISTINCT pred) AS pred_clusters, count(*) FILTER (n = g AND n = p) AS matched_clusters, count(*) FILTER (gt = pred AND n = p) AS matched_templates,
 coalesce(sum(n) FILTER (gt = pred), 0)::DOUBLE AS eq, coalesce(sum(n) FILTER (n = g AND n = p), 0)::DOUBLE AS gr FROM k)
SELECT rows, gt_clusters, pred_clusters, matched_clusters, matched_templates, eq / rows AS "PA", gr / rows AS "GA", matched_clusters / pred_clusters AS "PGA", matched_clusters / gt_clusters AS "RGA",
 2.0::DOUBLE * matched_clusters / (pred_clusters + gt_clusters) AS "FGA", matched_templates / pred_clusters AS "PTA", matched_templates / gt_clusters AS "RTA", 2.0::DOUBLE * matched_templates / (pred_clusters + gt_clusters) AS "FTA" FROM o""")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(_truth(spark, sf), _predicted(spark, sf))


@query("SELECT 'missing' AS side, event_id::VARCHAR AS id FROM events WHERE event_type = 'click' UNION ALL SELECT 'extra', event_id::VARCHAR FROM events WHERE event_type = 'purchase'")
def align_missing_extra(spark: SparkSession, sf: str) -> DataFrame:
    """The truth lacks one type of event, the prediction another."""
    return metrics.difference(_truth(spark, sf).where("EventTemplate <> 'did purchase'"), _predicted(spark, sf).where("not Content like '% did click %'"))


@query("SELECT true AS order_equal, true AS increasing")
def line_order(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.order_report(_truth(spark, sf), _predicted(spark, sf))


@query("SELECT count(*) AS rows, (SELECT string_agg(i, ',' ORDER BY o) FROM (SELECT event_id AS o, event_id::VARCHAR AS i FROM events ORDER BY o LIMIT 3)) AS first_ids, (SELECT string_agg(i, ',' ORDER BY o) FROM (SELECT event_id AS o, event_id::VARCHAR AS i FROM events ORDER BY o DESC LIMIT 3)) AS last_ids FROM events")
def id_samples(spark: SparkSession, sf: str) -> DataFrame:
    """First and last ids: a report, so a limit is the feature."""
    r = metrics.id_samples(_truth(spark, sf))
    return r.select("rows", F.array_join("first_ids", ",").alias("first_ids"), F.array_join("last_ids", ",").alias("last_ids"))


_ERR_SQL = f"{_LINES_SQL}, j AS (SELECT idx, line, {_TRUTH} AS gt_template, {_PRED} AS pred_template, {_KEY_SQL.format(x=_TRUTH)} = {_KEY_SQL.format(x=_PRED)} AS correct FROM m)"


@query(f"WITH {_ERR_SQL} SELECT gt_template, pred_template, count(*) AS errors, arg_min(line, idx) AS sample FROM j WHERE NOT correct GROUP BY ALL")
def error_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.error_pairs(analysis.joined_errors(_truth(spark, sf), _predicted(spark, sf)))


@query(f"WITH {_ERR_SQL} SELECT pred_template AS pred_id, count(DISTINCT gt_template) AS different, count(*) AS n FROM j GROUP BY 1 HAVING count(DISTINCT gt_template) > 1")
def over_merged(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.spread_groups(analysis.joined_errors(_truth(spark, sf), _predicted(spark, sf)), "pred_id", "gt_id")


@query(f"WITH {_ERR_SQL} SELECT gt_template AS gt_id, count(DISTINCT pred_template) AS different, count(*) AS n FROM j GROUP BY 1 HAVING count(DISTINCT pred_template) > 1")
def over_split(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.spread_groups(analysis.joined_errors(_truth(spark, sf), _predicted(spark, sf)), "gt_id", "pred_id")


@query(f"WITH {_ERR_SQL}, w AS (SELECT pred_template AS pred_id, count(DISTINCT gt_template) AS different, count(*) AS n FROM j GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1), f AS (SELECT pred_id, different, gt_template, min(idx) AS seen FROM j JOIN w ON pred_template = pred_id GROUP BY ALL ORDER BY seen LIMIT 3) SELECT pred_id, different, string_agg(gt_template, ' | ' ORDER BY seen) AS templates FROM f GROUP BY ALL")
def worst_merge(spark: SparkSession, sf: str) -> DataFrame:
    w = analysis.worst_group(analysis.joined_errors(_truth(spark, sf), _predicted(spark, sf)), "pred_id", "gt_id", "gt_template")
    return w.withColumn("templates", F.array_join("templates", " | "))


#: Results of runs, made from the events: a data set per event type, a variant per remainder of the user.
_RUNS = "SELECT event_type AS Dataset, 'V' || CAST(user_id % 3 AS STRING) AS Variant, CAST(count(*) % 97 AS DOUBLE) / 97 AS FGA, CAST(count(*) % 89 AS DOUBLE) / 89 AS PA, CAST(count(*) % 83 AS DOUBLE) / 83 AS GA, CASE WHEN user_id % 3 = 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(count(*) % 79 AS DOUBLE) / 79 END AS FTA, CAST(count(*) AS DOUBLE) AS EPS FROM {events} GROUP BY event_type, user_id % 3"
_RUNS_SQL = "r AS (" + _RUNS.format(events="events") + ")"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_RUNS.format(events="{events}"), events=_events(spark, sf))


@query(f'WITH {_RUNS_SQL} SELECT round(avg("PA"), 9) AS "PA", round(avg("GA"), 9) AS "GA", round(avg("FGA"), 9) AS "FGA", round(avg("FTA"), 9) AS "FTA", round(avg("EPS"), 9) AS "EPS", count("FTA") AS with_fta, count(*) AS runs FROM r')
def mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = analysis.mean_metrics(_runs(spark, sf))
    return m.select(*[F.round(c, 9).alias(c) for c in ("PA", "GA", "FGA", "FTA", "EPS")], "with_fta", "runs")


@query(f'WITH {_RUNS_SQL} SELECT "Dataset", "Variant", round(CASE WHEN "PA" > 0 THEN "EPS" / "PA" ELSE 0 END, 2) AS eps FROM r')
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("Dataset", "Variant", analysis.throughput(F.col("EPS"), F.col("PA")).alias("eps"))


@query(f"WITH {_RUNS_SQL}, j AS (SELECT a.FGA AS x, b.FGA AS y, a.EPS AS u, b.EPS AS v FROM r a JOIN r b ON a.Dataset = b.Dataset WHERE a.Variant = 'V0' AND b.Variant = 'V2') SELECT count(*) AS both, count(*) FILTER (x > y) AS \"FGA_wins\", round(avg(x - y), 9) AS \"FGA_gain\", count(*) FILTER (u > v) AS \"EPS_wins\", round(avg(u - v), 9) AS \"EPS_gain\" FROM j")
def compare_variants(spark: SparkSession, sf: str) -> DataFrame:
    r = _runs(spark, sf)
    return analysis.compare_runs(r.where("Variant = 'V0'"), r.where("Variant = 'V2'")).withColumns({"FGA_gain": F.round("FGA_gain", 9), "EPS_gain": F.round("EPS_gain", 9)})


@query(f'WITH {_RUNS_SQL} SELECT "Variant", round(avg("FGA"), 9) AS "mean_FGA" FROM r GROUP BY 1')
def variant_means(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.variant_means(_runs(spark, sf)).withColumn("mean_FGA", F.round("mean_FGA", 9))


@query(f"WITH {_RUNS_SQL} SELECT \"Variant\", coalesce(max(\"FGA\") FILTER (\"Dataset\" = 'click'), 0.0::DOUBLE) AS click, coalesce(max(\"FGA\") FILTER (\"Dataset\" = 'view'), 0.0::DOUBLE) AS view, coalesce(max(\"FGA\") FILTER (\"Dataset\" = 'none'), 0.0::DOUBLE) AS \"none\" FROM r GROUP BY 1")
def pivot_metric(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.pivot_metric(_runs(spark, sf), ["click", "view", "none"])


@query(f"WITH {_RUNS_SQL} SELECT a.\"Variant\", a.\"Dataset\", round(b.\"FGA\" - a.\"FGA\", 9) AS fall, CASE WHEN b.\"FGA\" = 0 THEN 0.0 ELSE round((b.\"FGA\" - a.\"FGA\") / b.\"FGA\" * 100, 6) END AS percent FROM r a JOIN r b ON a.\"Dataset\" = b.\"Dataset\" WHERE a.\"Variant\" <> 'V0' AND b.\"Variant\" = 'V0'")
def fga_drop(spark: SparkSession, sf: str) -> DataFrame:
    d = analysis.drop_from_baseline(_runs(spark, sf), "V0")
    return d.withColumns({"fall": F.round("fall", 9), "percent": F.round("percent", 6)})


@query(f"WITH {_LINES_SQL}, k AS (SELECT {_KEY_SQL.format(x=_TRUTH)} AS key FROM m) SELECT count(*) AS rows, count(DISTINCT user_id) AS unique_ids, count(*) - count(DISTINCT user_id) AS repeated_ids, count(DISTINCT event_type) AS unique_events, (SELECT count(DISTINCT key) FROM k) AS unique_templates, (SELECT string_agg(u, ',' ORDER BY u) FROM (SELECT DISTINCT user_id::VARCHAR AS u FROM events ORDER BY u LIMIT 3)) AS smallest FROM events")
def csv_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("EventTemplate", F.expr(_TRUTH))
    return audit.table_inventory(rows, ids="user_id", event="event_type").withColumn("smallest", F.array_join("smallest", ","))


@query(f"WITH {_LINES_SQL}, t AS (SELECT {_TRUTH} AS tpl, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS templates, sum(n)::BIGINT AS occurrences, count(DISTINCT {_KEY_SQL.format(x='tpl')}) AS unique_templates, count(*) - count(DISTINCT {_KEY_SQL.format(x='tpl')}) AS collisions, sum(n) = (SELECT count(*) FROM events) AS complete FROM t")
def occurrence_check(spark: SparkSession, sf: str) -> DataFrame:
    lines = _truth(spark, sf)
    t = lines.groupBy("EventTemplate").agg(F.count("*").alias("Occurrences"))
    return audit.occurrence_check(t, lines.count())


@query("SELECT sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id) || chr(10)) AS digest, count(*) AS rows FROM events")
def order_digest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.order_digest(_events(spark, sf), "event_id", "event_id")


@query("SELECT sha256(string_agg(d, chr(10) ORDER BY b) || chr(10)) AS digest, sum(n)::BIGINT AS rows FROM (SELECT event_id // 4096 AS b, sha256(string_agg(event_type, chr(10) ORDER BY event_id) || chr(10)) AS d, count(*) AS n FROM events GROUP BY 1)")
def block_digest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.block_digest(_events(spark, sf), "event_type", "event_id")


@query("SELECT event_id FROM events WHERE event_id IN (SELECT round_even(i * 9999 / 299, 0)::BIGINT FROM (SELECT unnest(range(0, 300)) AS i))")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """An evenly spaced sample is the feature here."""
    return audit.even_sample(_events(spark, sf).select("event_id"), 300, "event_id")


@query(f"WITH {_RUNS_SQL}, n AS (SELECT \"Dataset\", \"FGA\" + 1 AS \"FGA\", \"FTA\" FROM r WHERE \"Variant\" = 'V2' AND \"Dataset\" < 'm') SELECT \"Dataset\", \"FGA\", NULL::DOUBLE AS \"FTA\" FROM r WHERE \"Variant\" = 'V0' AND \"Dataset\" NOT IN (SELECT \"Dataset\" FROM n) UNION ALL SELECT \"Dataset\", \"FGA\", \"FTA\" FROM n")
def upsert_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = _runs(spark, sf)
    new = r.where("Variant = 'V2' and Dataset < 'm'").select("Dataset", (F.col("FGA") + 1).alias("FGA"), "FTA")
    return writers.upsert(r.where("Variant = 'V0'").select("Dataset", "FGA"), new, ["Dataset"])


@query(r"""WITH t AS (SELECT conv_id, turn, 'The miner ' || CASE conv_id % 3 WHEN 0 THEN 'demonstrates strong generalization' WHEN 1 THEN 'is not generalizable' ELSE 'works out-of-the-box' END || ' in case ' || turn::VARCHAR AS text FROM conversations),
p AS (SELECT * FROM (VALUES ('out_of_box', '(?is)The miner[^.\n]{0,160}(?:is|works?|operates?|provides?|achieves?|supports?|offers?)[^.\n]{0,80}out[- ]of[- ]the[- ]box'), ('generalization', '(?is)The miner[^.\n]{0,160}(?:generalizes?|generalizable|(?:demonstrates?|proves?|shows?|supports?|achieves?|offers?)[^.\n]{0,80}generaliz(?:ation|ability|able|es?))')) v(claim, pat)),
x AS (SELECT claim, CASE claim WHEN 'out_of_box' THEN regexp_extract(text, '(?is)The miner[^.\n]{0,160}(?:is|works?|operates?|provides?|achieves?|supports?|offers?)[^.\n]{0,80}out[- ]of[- ]the[- ]box') ELSE regexp_extract(text, '(?is)The miner[^.\n]{0,160}(?:generalizes?|generalizable|(?:demonstrates?|proves?|shows?|supports?|achieves?|offers?)[^.\n]{0,80}generaliz(?:ation|ability|able|es?))') END AS found FROM t, p)
SELECT claim, found, count(*) AS n FROM x WHERE found <> '' AND NOT regexp_matches(found, '(?i)\b(?:not|no|never|without|cannot|can''t|doesn''t|does not|do not|did not|rather than|outside)\b') GROUP BY ALL""")
def claim_audit(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    said = F.expr("'The miner ' || CASE conv_id % 3 WHEN 0 THEN 'demonstrates strong generalization' WHEN 1 THEN 'is not generalizable' ELSE 'works out-of-the-box' END || ' in case ' || CAST(turn AS STRING)")
    return audit.audit_claims(t.select(said.alias("text")), "The miner").groupBy("claim", "found").agg(F.count("*").alias("n"))


@query(f"WITH {_POS_SQL}, k AS (SELECT token, lower(regexp_replace(token, '[^a-zA-Z0-9*]', '', 'g')) AS key, trim(token) AS stripped, CASE WHEN regexp_matches(token, '^-?\\d+(\\.\\d+)?$') THEN 'number' ELSE 'literal' END AS type, {_KEY_SQL.format(x='token')} AS eval_key FROM c) SELECT DISTINCT * FROM k")
def token_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Types and keys of every different token."""
    t = buckets.position_counts(buckets.items(_lines(spark, sf)), 10).select("token").distinct()
    c = F.col("token")
    return t.select("token", template_key(c).alias("key"), strip_text(c).alias("stripped"), semantic_type(c).alias("type"), evaluation_key(c).alias("eval_key"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'Received block <*> from <*>', 'E1', 'Received block <*> from <*>'), (1, 'Received block <*> from <*>', 'E1', 'Received block <*> from <*>'), (2, 'Deleted block <*> on <*>', 'E2', 'Deleted block <*> on <*>'), (3, 'Deleted block <*> on <*>', 'E2', 'Deleted block <*> on <*>')) t(idx, masked, event_id, event_template)")
def quick_demo(spark: SparkSession, sf: str) -> DataFrame:
    """Four messages, mined from masking to events."""
    lines = ["Received block blk_123 from 10.0.0.1:50010", "Received block blk_456 from 10.0.0.2:50010", "Deleted block blk_123 on /data/node-a", "Deleted block blk_456 on /data/node-b"]
    df = spark.createDataFrame(list(enumerate(lines)), "idx long, Content string")
    return mining.parse(df, "hdfs").select("idx", "masked", "event_id", "event_template")


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(F.col("event_id").alias("idx"), F.col("event_id").cast("string").alias("LineId"), F.expr(_SHAPED).alias("Content"), (F.col("event_id") % 16).cast("string").alias("shape"))


@query()
def parse_spark_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way for the shaped messages: mask, fit on their most frequent strings or all of them, and replay."""
    return mining.parse(_shaped(spark, sf), "spark").select("idx", "masked", "event_id", "event_template")


def _variant_query(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = mining.variant(name, "spark")
        rows = mining.stage(mining.masked_rows(_shaped(spark, sf), s.format), "masked")
        model = mining.fit(rows, s)
        return mining.transform(model, rows).select("idx", "event_id", "event_template")

    run.__name__ = "variant_" + name.lower()
    query()(run)


for _name in mining.VARIANTS:
    _variant_query(_name)


def _quadrant_query(cell: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = mining.quadrant("spark", cell)
        rows = mining.stage(mining.masked_rows(_shaped(spark, sf), s.format), "masked")
        got = mining.transform(mining.fit(rows, s), rows)
        a = got.select(F.col("idx").alias("id"), F.col("shape").alias("gt"), evaluation_key(F.col("event_template")).alias("pred"))
        return metrics.scores(metrics.contingency(a)).withColumn("quadrant", F.lit(cell))

    run.__name__ = "quadrant_" + cell.replace("-", "_").lower()
    query()(run)


for _cell in ("U-U", "U-T", "T-U", "T-T"):
    _quadrant_query(_cell)


@query()
def entropy_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Scores at two entropy limits that are not done yet."""
    return mining.sweep(_shaped(spark, sf).withColumn("EventTemplate", F.col("shape")), "spark", [0.5, 1.5, 3.0], "EventTemplate", done=[3.0])
