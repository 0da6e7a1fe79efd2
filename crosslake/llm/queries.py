"""Queries p6 to p10 over the tables of the domain, each over its whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch, local_rows, same_id, table
from crosslake.llm.mixing import MOST_TARGETS, exponential_key, mix, source_name
from crosslake.llm.packing import fill_report, pack
from crosslake.llm.quality import scorer, train, usual_weight
from crosslake.llm.quantiles import SKETCH_K, exact_percentiles, merge_percentile_states, percentile_states, percentiles, rank_check, rank_error
from crosslake.llm.spans import SharedSpans, shared_runs
from crosslake.llm.tokens import token_counts
from crosslake.llm.topn import top_n

CAPACITY = 2048
SPAN = 200
TOP = 3

# --- 6


def _values(spark: SparkSession, d: str) -> DataFrame:
    """The durations; a row delivered twice counts once, in its first load."""
    runs = table(spark, d, "query_history").where("id is not null").groupBy(same_id("id").alias("id"), same_id("organization_id").alias("item"), same_id("status").alias("status"))
    runs = runs.agg(F.max("execution_time_ms").alias("ms"), F.min("load_no").alias("load_no")).select(F.lit("query_history").alias("source_table"), "item", "status", "load_no", "ms")
    checks = table(spark, d, "quality_check_runs").where("id is not null").groupBy(same_id("id").alias("id"), same_id("check_id").alias("item"))
    checks = checks.agg(F.max("duration_ms").alias("ms"), F.min("load_no").alias("load_no")).select(F.lit("quality_check_runs").alias("source_table"), "item", F.lit(None).cast("string").alias("status"), "load_no", "ms")
    return runs.unionByName(checks)


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """The state of each load's durations."""
    return percentile_states(_values(spark, d), ["source_table", "item", "status", "load_no"], "ms")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p50, p90, p95 and p99 per organization and status, and per check, merged from the states of single loads."""
    return percentiles(merge_percentile_states(_durations(spark, d), ["source_table", "item", "status"]))


def p6_by_load(spark: SparkSession, d: str) -> DataFrame:
    """The same for single loads."""
    return percentiles(_durations(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles against exact ranks: percentiles asked, whether those without a bound are exact, and whether the bound holds for at least 99 of 100 others."""
    keys = ["source_table", "item", "status"]
    values = Scratch(spark, "durations").write(_values(spark, d))
    found = percentiles(merge_percentile_states(percentile_states(values, [*keys, "load_no"], "ms"), keys))
    ranks = rank_check(values, found, keys, "ms").withColumn("exact", F.col("n_values") <= SKETCH_K)
    return ranks.groupBy("source_table").agg(F.count(F.lit(1)).alias("percentiles"), (F.count_if(F.col("exact") & (F.col("off") > 1 / F.col("n_values"))) == 0).alias("small_exact"), (F.count_if(~F.col("exact") & (F.col("off") > rank_error())) <= 0.01 * F.count(F.lit(1)) + 1).alias("bound_kept"))


def p6_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of a fractional column, actual_value by status; groups here exceed the sketch, so only what is exact comes out, as its SQL asks; ``p6_fractions_all`` has every group."""
    got = percentiles(percentile_states(table(spark, d, "quality_check_runs").withColumn("status", same_id("status")), ["check_id", "status"], "actual_value"))
    return got.where("n_values <= 512").select("check_id", "status", "n_values", "p50", "p99")


def p6_fractions_all(spark: SparkSession, d: str) -> DataFrame:
    """The same for groups of any size, all by exact ranks."""
    return exact_percentiles(table(spark, d, "quality_check_runs").withColumn("status", same_id("status")), ["check_id", "status"], "actual_value", (0.5, 0.99))


# --- 7


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _top(spark: SparkSession, d: str) -> DataFrame:
    ok = (same_id("status") == "success") & F.col("execution_time_ms").between(1, 86_400_000)
    runs = table(spark, d, "query_history").where(ok & F.col("id").isNotNull())
    slow = top_n(runs, F.concat(same_id("organization_id"), F.lit(" "), _month("executed_at")), TOP, F.col("execution_time_ms"), [F.col("executed_at"), same_id("id")], {"item_id": F.col("id")})
    users = table(spark, d, "users").where("id is not null").groupBy(same_id("id").alias("user")).agg(F.min(same_id("organization_id")).alias("org"))
    shares = table(spark, d, "dataset_shares").where("active and id is not null").select("id", "created_at", "access_count", same_id("created_by").alias("user")).join(users, "user")
    read = top_n(shares, F.concat("org", F.lit(" "), _month("created_at")), TOP, F.col("access_count"), [same_id("id")], {"item_id": F.col("id")})
    return slow.withColumn("item_table", F.lit("query_history")).unionByName(read.withColumn("item_table", F.lit("dataset_shares")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("item_table", "item_id")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with organization and month, score and rank."""
    who = F.split("group_key", " ")
    return _top(spark, d).select("item_table", who[0].alias("organization_id"), who[1].alias("month"), "rank", "score", "item_id")


# --- 8


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = Scratch(spark, "tokens").write(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each piece of one that is longer than a container."""
    return _packed(spark, d)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, how many of them are whole in their pieces, pieces of documents divided without need, and containers above the capacity."""
    sizes = Scratch(spark, "tokens").write(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    got = Scratch(spark, "packed").write(pack(sizes, "doc_id", "n_tokens", CAPACITY))
    per = got.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("start").alias("starts"), F.max(F.col("start") + F.col("size")).alias("end"))
    whole = (F.col("size") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("pieces") == F.col("starts"))
    one = sizes.join(per, "doc_id", "left").agg(F.count(F.lit(1)).alias("documents"), F.count_if(whole).alias("whole"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("divided_without_need"))
    full = got.groupBy("container_id").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), (F.count(F.lit(1)) <= 1.05 * F.ceil(F.sum("used") / CAPACITY) + 1).alias("near_least"))
    return one.crossJoin(full)  # one row each


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(_packed(spark, d), CAPACITY)


# --- 9


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    bits = scorer(train(docs, "text"))
    sized = Scratch(spark, "mix").write(token_counts(docs.withColumn("source", source_name(F.col("source"))), "doc_id", "text", keep=("source",), score=("bits", bits)))
    wanted = targets.select(source_name(F.col("source")).alias("source")).distinct()
    usual = sized.join(wanted, "source", "left_semi").groupBy("source").agg(F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("deviation"), F.sum("n_tokens").alias("n"))
    found = usual.limit(MOST_TARGETS).collect()  # a row for each target; mix refuses more of them
    usual = local_rows(spark, found, "source string, mean double, deviation double, n bigint").drop("n")
    weight = usual_weight(F.col("bits"), F.col("mean"), F.col("deviation"))
    keyed = sized.join(F.broadcast(usual), "source")
    return mix(keyed.select(F.col("doc_id").alias("id"), "source", "n_tokens", exponential_key(F.col("doc_id"), weight).alias("key")), targets, tokens={r.source: r.n for r in found})


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their number of uses."""
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, d)[1]


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Each target: whether its share of what all sources with texts are to give is met within 1 % (or 100 tokens), and no text is used more than max_repeats times."""
    chosen, report = _mixed(spark, d)
    most = chosen.groupBy("source").agg(F.max("uses").alias("most"))
    every = Window.partitionBy(F.lit(1))  # a row for each target
    live = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every)
    due = F.when(F.col("tokens") > 0, F.col("target_share") / live).otherwise(0.0)
    r = report.withColumn("due", due).join(most, "source", "left")
    return r.select("source", (F.abs(F.col("chosen_tokens") - F.col("due") * F.sum("chosen_tokens").over(every)) <= F.greatest(F.lit(100.0), 0.01 * F.col("due") * F.sum("chosen_tokens").over(every))).alias("share_met"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"))


# --- 10


def _spans(spark: SparkSession, d: str) -> SharedSpans:
    return SharedSpans(table(spark, d, "documents"), "doc_id", "text", SPAN)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).pairs().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The pairs without their square: classes of documents that share a span, by number, and their documents."""
    return _spans(spark, d).classes().select(F.concat_ws("-", F.hex("cls0"), F.hex("cls1")).alias("class_id"), F.col("id").alias("doc_id"), F.col("n").alias("documents"))


def p10_linked(spark: SparkSession, d: str) -> DataFrame:
    """Each document that shares a span with another: how many, and the first of them; by the pairs, from classes."""
    p = _spans(spark, d).pairs()
    both = p.select(F.col("id_a").alias("doc_id"), F.col("id_b").alias("other")).unionByName(p.select(F.col("id_b").alias("doc_id"), F.col("id_a").alias("other")))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"), F.min("other").alias("first_link"))


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each document that shared spans cover; where spans overlap or adjoin, the stretch as a whole may lie in no other document."""
    return _spans(spark, d).spans().withColumnRenamed("id", "doc_id")


def p10_runs(spark: SparkSession, d: str) -> DataFrame:
    """The shared spans themselves: the longest runs of each document that lie as a whole in another one."""
    return shared_runs(table(spark, d, "documents"), "doc_id", "text", SPAN).withColumnRenamed("id", "doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the share of its characters that also lies in others."""
    return _spans(spark, d).shares().withColumnRenamed("id", "doc_id")


QUERIES = {
    "p6_percentiles": p6_percentiles, "p6_by_load": p6_by_load, "p6_check": p6_check, "p6_fractions": p6_fractions, "p6_fractions_all": p6_fractions_all,
    "p7_found": p7_found, "p7_ranked": p7_ranked,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_check": p9_check,
    "p10_found": p10_found, "p10_classes": p10_classes, "p10_linked": p10_linked, "p10_spans": p10_spans, "p10_shares": p10_shares, "p10_runs": p10_runs,
}

_TOP = f"""
WITH h AS (SELECT DISTINCT id, lower(trim(organization_id)) AS org, strftime(executed_at, '%Y-%m') AS month, execution_time_ms AS score, executed_at FROM query_history WHERE lower(trim(status)) = 'success' AND execution_time_ms BETWEEN 1 AND 86400000 AND organization_id IS NOT NULL),
u AS (SELECT lower(trim(id)) AS k, min(lower(trim(organization_id))) AS org FROM users WHERE id IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT d.id, u.org, strftime(d.created_at, '%Y-%m') AS month, d.access_count AS score FROM dataset_shares d JOIN u ON u.k = lower(trim(d.created_by)) WHERE d.active AND u.org IS NOT NULL),
r AS (
  SELECT 'query_history' AS item_table, org, month, score, id, row_number() OVER (PARTITION BY org, month ORDER BY score DESC, executed_at, lower(trim(id))) AS rn FROM h
  UNION ALL SELECT 'dataset_shares', org, month, score, id, row_number() OVER (PARTITION BY org, month ORDER BY score DESC, lower(trim(id))) FROM s)"""
_WINDOWS = f"""
WITH w AS (SELECT doc_id, i, substring(text, i, {SPAN}) AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN} + 2)) AS i FROM documents WHERE length(text) >= {SPAN})),
m AS (SELECT x FROM w GROUP BY x HAVING count(DISTINCT doc_id) > 1), hit AS (SELECT w.* FROM w JOIN m USING (x))"""

_MS = """
WITH v AS (
  SELECT 'query_history' AS source_table, lower(trim(organization_id)) AS item, lower(trim(status)) AS status, max(execution_time_ms) AS ms FROM query_history WHERE id IS NOT NULL GROUP BY lower(trim(id)), 2, 3
  UNION ALL SELECT 'quality_check_runs', lower(trim(check_id)), NULL, max(duration_ms) FROM quality_check_runs WHERE id IS NOT NULL GROUP BY lower(trim(id)), 2)"""
# runs that lie in another document: equal windows on one diagonal of two documents follow each other
_DIAGONALS = f"""{_WINDOWS}, p AS (SELECT a.doc_id, a.i, b.doc_id AS other, b.i - a.i AS diagonal FROM hit a JOIN hit b ON a.x = b.x AND a.doc_id <> b.doc_id),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY i) AS island FROM p),
e AS (SELECT DISTINCT doc_id, min(i) - 1 AS s, max(i) + {SPAN - 1} AS e FROM k GROUP BY doc_id, other, diagonal, island)"""

SQL = {
    "p6_check": f"{_MS} SELECT source_table, CAST(4 * count(*) AS BIGINT) AS percentiles, TRUE AS small_exact, TRUE AS bound_kept FROM (SELECT source_table, item, status FROM v WHERE ms IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1",
    "p6_fractions": """WITH v AS (SELECT check_id, lower(trim(status)) AS status, actual_value AS x, row_number() OVER (PARTITION BY check_id, lower(trim(status)) ORDER BY actual_value NULLS LAST) AS rn, count(actual_value) OVER (PARTITION BY check_id, lower(trim(status))) AS n FROM quality_check_runs)
      SELECT check_id, status, max(n) AS n_values, max(x) FILTER (rn = greatest(1, ceil(0.5 * n))) AS p50, max(x) FILTER (rn = greatest(1, ceil(0.99 * n))) AS p99 FROM v WHERE n <= 512 GROUP BY 1, 2""",
    "p6_fractions_all": """WITH v AS (SELECT check_id, lower(trim(status)) AS status, CASE WHEN NOT isnan(actual_value) THEN actual_value END AS x FROM quality_check_runs),
      r AS (SELECT *, row_number() OVER (PARTITION BY check_id, status ORDER BY x NULLS LAST) AS rn, count(x) OVER (PARTITION BY check_id, status) AS n FROM v)
      SELECT check_id, status, max(n) AS n_values, max(x) FILTER (rn = greatest(1, ceil(0.5 * n))) AS p50, max(x) FILTER (rn = greatest(1, ceil(0.99 * n))) AS p99 FROM r GROUP BY 1, 2""",
    "p8_check": "SELECT count(*) AS documents, count(*) AS whole, CAST(0 AS BIGINT) AS divided_without_need, CAST(0 AS BIGINT) AS overfull, TRUE AS near_least FROM documents",
    "p9_check": "SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source, TRUE AS share_met, TRUE AS cap_kept FROM mix_targets WHERE source IS NOT NULL",
    "p10_linked": f"{_WINDOWS}, p AS (SELECT DISTINCT a.doc_id, b.doc_id AS other FROM hit a JOIN hit b ON a.x = b.x AND a.doc_id <> b.doc_id) SELECT doc_id, count(*) AS links, min(other) AS first_link FROM p GROUP BY 1",
    "p10_runs": f"""{_DIAGONALS} SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.doc_id = e.doc_id AND o.s <= e.s AND o.e >= e.e AND (o.s < e.s OR o.e > e.e))""",
    "p7_found": f"{_TOP} SELECT item_table, id AS item_id FROM r WHERE rn <= {TOP}",
    "p7_ranked": f"{_TOP} SELECT item_table, org AS organization_id, month, CAST(rn AS INTEGER) AS rank, score, id AS item_id FROM r WHERE rn <= {TOP}",
    "p10_found": f"{_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM hit a JOIN hit b ON a.x = b.x AND a.doc_id < b.doc_id",
    "p10_spans": f"""{_WINDOWS}, g AS (SELECT *, i - coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) > {SPAN} AS fresh FROM hit), k AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM g)
      SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) + {SPAN - 1} AS INTEGER) AS "end" FROM k GROUP BY doc_id, no""",
    "p10_shares": f"""{_WINDOWS}, g AS (SELECT doc_id, least({SPAN}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000000)) AS n FROM hit), c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1)
      SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0.0 END AS share FROM documents LEFT JOIN c USING (doc_id)""",
}
