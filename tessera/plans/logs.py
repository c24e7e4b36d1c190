"""Queries over evaluation logs and over the event stream's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import mentioned_periods, mentioned_words
from tessera.operators import runlog as rl
from tessera.operators import requests as req
from tessera.operators.financial import METRICS
from tessera.session import table
from tessera.streaming import windows as win


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evaluation_cases").dropDuplicates(["case_id"])


def log_case_order(spark: SparkSession, sf: str) -> DataFrame:
    """Cases in the order in which they are run: by the session's number, then the turn."""
    n = F.regexp_extract("source_session_id", r"(\d+)$", 1).cast("int")
    return _cases(spark, sf).select("case_id", n.alias("session_no"), "expected_turn_id").orderBy("session_no", "expected_turn_id", "case_id")


def log_batch_status(spark: SparkSession, sf: str) -> DataFrame:
    return rl.batch_status(_cases(spark, sf))


def log_ready_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out sessions whose questions are turns; a turn is done where its item id is even."""
    t = table(spark, sf, "heldout_items").withColumn("status", F.when(F.col("item_id") % 2 == 0, "completed").otherwise("pending"))
    return rl.prior_turns_done(t, "session_id", "turn_id", "status").select("item_id", "ready")


def log_turn_check(spark: SparkSession, sf: str) -> DataFrame:
    return rl.turns_contiguous(table(spark, sf, "heldout_items"), "session_id", "turn_id")


def log_recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    return rl.recent_turns(table(spark, sf, "heldout_items"), "session_id", "turn_id", 2).select("item_id", "session_id", "turn_id")


def log_messages(spark: SparkSession, sf: str) -> DataFrame:
    return rl.session_messages(table(spark, sf, "heldout_items"), "session_id", "turn_id", "question", "passage")


def log_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rl.session_summary(_cases(spark, sf).where("started_at IS NOT NULL"), "batch_id", "case_id", "question", "started_at")


def log_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of runs, latest first."""
    return rl.page(_cases(spark, sf).select("run_id", "case_id", "started_at"), [F.col("started_at").desc_nulls_last(), F.col("case_id")], 20, 20)


def log_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each company and type: an upsert by key."""
    e = table(spark, sf, "event_records")
    return rl.last_wins(e, ["company_id", "event_type"], [F.col("announcement_date"), F.col("event_id")]).select("company_id", "event_type", "event_id", "announcement_date")


def log_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two partial logs of cases, each with its own gaps, merged by case."""
    c = _cases(spark, sf)
    a = c.where("status <> 'pending'").select("case_id", "run_id", F.lit(None).cast("string").alias("error_message"))
    b = c.where("attempt_count > 0").select("case_id", F.lit("").alias("run_id"), "error_message")
    return rl.merge_logs(a, b, "case_id", ["run_id", "error_message"])


def log_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Batches with their cases as an array, and back."""
    c = _cases(spark, sf)
    runs = table(spark, sf, "evaluation_batches").select("batch_id")
    nested = rl.nested_runs(runs, c, "batch_id", "case_id", ["case_id", "status"], "cases")
    return rl.unpack_children(nested, "batch_id", "cases")


def log_state(spark: SparkSession, sf: str) -> DataFrame:
    """The last topic known up to each claim of a company: state carried across."""
    c = table(spark, sf, "research_claims").dropDuplicates(["claim_id"]).withColumn("at", F.struct("publish_date", "claim_id"))
    return rl.carry_forward(c, "company_id", "at", "topic").select("claim_id", "known_topic")


def log_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Periods and metrics that questions name."""
    words = {m[1]: m[0] for m in METRICS}
    q = _cases(spark, sf)
    days = F.transform(mentioned_periods(F.col("question")), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return q.select("case_id", F.array_join(F.array_sort(days), ",").alias("periods"), F.array_join(mentioned_words(F.col("question"), words), ",").alias("metrics"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of cases, with the company they are about, and of held-out items, without one."""
    cases = _cases(spark, sf).select(F.concat(F.lit("case-"), "case_id").alias("id"), "question", F.array_compact(F.array(F.get_json_object("annotation_json", "$.company_id"))).alias("entities"))
    held = table(spark, sf, "heldout_items").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"), "question", F.array().cast("array<string>").alias("entities"))
    return cases.unionByName(held)


def log_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of task each question is and what it names."""
    r = req.read_questions(_questions(spark, sf), entities="entities")
    joined = {c: F.array_join(c, ",") for c in ("metrics", "people", "institutions", "document_types", "event_types", "topics", "claim_types")}
    return r.select("id", "family", "comparison", *[v.alias(k) for k, v in joined.items()])


def log_answerable(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each question can be answered, what it lacks, the operation that answers it directly, and those tried else."""
    return req.read_questions(_questions(spark, sf), entities="entities").select("id", "status", "missing", "direct", "steps")


def log_review(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch whether its runs brought evidence: a case that has a run counts as evidence, one with an error as failed."""
    c = _cases(spark, sf).select("batch_id", F.col("error_message").isNull().alias("succeeded"), F.when(F.col("run_id").isNotNull(), 1).otherwise(0).alias("n_evidence"))
    return req.review_evidence(c, ["batch_id"])


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def _labels(rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{k}' END" for k, w in rules) + "], lambda x: x IS NOT NULL), ',')"


def _read_sql() -> str:
    """Parts, flags and decisions of ``requests.read_questions`` in SQL, as the table ``t``."""
    holders = "list_concat(list_filter(list_transform(regexp_extract_all(q, '{}', 1), lambda x: trim(x, '的 了')), lambda x: length(x) BETWEEN 2 AND 30), list_filter(regexp_extract_all(q, '{}', 1), lambda x: x NOT IN ('公司持有', '股东持')))".format(*req.HOLDER_PATTERNS)
    # in order of their first place
    people = "list_filter(hs, lambda x, i: list_position(hs, x) = i)"
    n = lambda c: f"CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ',')) END"
    end = lambda pattern, tail: f"list_transform(regexp_extract_all(q, '(?:^|\\D)(\\d{{4}})年?(?:{pattern})', 1), lambda x: x || '{tail}')"
    periods = "list_concat(regexp_extract_all(q, '(?:^|\\D)(\\d{4}-\\d{2}-\\d{2})', 1), list_transform(regexp_extract_all(q, '(?:^|\\D)(\\d{4}年\\d{1,2}月\\d{1,2}日)', 1), lambda x: strftime(strptime(x, '%Y年%m月%d日'), '%Y-%m-%d')), " + ", ".join(end(*k) for k in (("年报|年度报告|年度", "-12-31"), ("半年报|半年度|中报", "-06-30"), ("一季报|第一季度", "-03-31"), ("三季报|前三季度", "-09-30"))) + ")"
    lists = {"metrics": req.METRIC_WORDS, "document_types": req.DOCUMENT_WORDS, "event_types": req.EVENT_WORDS, "topics": req.TOPIC_WORDS, "claim_types": req.CLAIM_WORDS}
    return f"""WITH {_C}, q0 AS (SELECT 'case-' || case_id AS id, coalesce(question, '') AS q, CASE WHEN json_extract_string(annotation_json, '$.company_id') IS NULL THEN 0 ELSE 1 END AS n_entities FROM c
UNION ALL SELECT 'item-' || item_id, coalesce(question, ''), 0 FROM heldout_items),
q1 AS (SELECT *, {holders} AS hs, regexp_extract_all(q, '{req.INSTITUTION_PATTERN}', 1) AS ins, len(list_distinct({periods})) AS n_periods, {", ".join(f"{_labels(r)} AS {k}" for k, r in lists.items())}, {", ".join(f"{_any(w)} AS {k}" for k, w in req.FLAGS.items())} FROM q0),
q2 AS (SELECT *, array_to_string({people}, ',') AS people, array_to_string({people.replace("hs", "ins")}, ',') AS institutions FROM q1),
q3 AS (SELECT *, {n("metrics")} AS n_metrics, {n("people")} AS n_people FROM q2),
q4 AS (SELECT *, {req.case_sql(req.FAMILIES, "'unknown'")} AS family FROM q3),
t AS (SELECT *, {req.case_sql(req.COMPARISON, "'ambiguous'")} AS comparison, {req.list_sql(req.MISSING)} AS missing, {req.list_sql(req.STEPS)} AS steps FROM q4)"""


def st_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return win.tumbling(table(spark, sf, "events"), "1 hour", ["event_type"])


def st_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return win.sliding(table(spark, sf, "events"), "2 hours", "1 hour", ["event_type"])


def st_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return win.sessions(table(spark, sf, "events"), "30 minutes", "user_id")


def _strip_words() -> tuple[str, str]:
    """SQL for the words of METRICS, longest first, each taken out before the next is looked for."""
    rest, parts = "question", []
    for code, word in sorted(((m[0], m[1]) for m in METRICS), key=lambda x: len(x[1]), reverse=True):
        parts.append(f"CASE WHEN contains({rest}, '{word}') THEN '{code}' END")
        rest = f"replace({rest}, '{word}', '|')"
    return ", ".join(parts), rest


_C = "c AS (SELECT DISTINCT ON (case_id) * FROM evaluation_cases)"
SQL = {
    "log_case_order": rf"WITH {_C} SELECT case_id, CAST(regexp_extract(source_session_id, '(\d+)$', 1) AS INT) AS session_no, expected_turn_id FROM c",
    "log_batch_status": f"""WITH {_C}, b AS (SELECT batch_id, count(*) AS n_cases, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'running') AS n_running FROM c GROUP BY 1)
SELECT *, CASE WHEN n_completed = n_cases THEN 'completed' WHEN n_pending + n_running > 0 AND n_completed + n_failed > 0 THEN 'running' WHEN n_failed = n_cases THEN 'failed' WHEN n_completed + n_failed = n_cases THEN 'partial' ELSE 'pending' END AS status FROM b""",
    "log_ready_turns": "SELECT item_id, coalesce(sum(CASE WHEN item_id % 2 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ready FROM heldout_items",
    "log_turn_check": "SELECT session_id, count(*) AS n_turns, min(turn_id) = 1 AND max(turn_id) = count(*) AND count(DISTINCT turn_id) = count(*) AS contiguous FROM heldout_items GROUP BY 1",
    "log_recent_turns": "SELECT item_id, session_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS n FROM heldout_items) WHERE n <= 2",
    "log_messages": "SELECT session_id, turn_id * 2 - 1 AS position, 'user' AS role, question AS text FROM heldout_items UNION ALL SELECT session_id, turn_id * 2, 'assistant', passage FROM heldout_items",
    "log_sessions": f"WITH {_C} SELECT batch_id, arg_min(question, case_id) AS title, min(started_at) AS created_at, max(started_at) AS updated_at, count(*) AS n_turns FROM c WHERE started_at IS NOT NULL GROUP BY 1",
    "log_page": f"WITH {_C} SELECT run_id, case_id, started_at FROM c ORDER BY started_at DESC NULLS LAST, case_id LIMIT 20 OFFSET 20",
    "log_upsert": "SELECT company_id, event_type, event_id, announcement_date FROM (SELECT *, row_number() OVER (PARTITION BY company_id, event_type ORDER BY announcement_date DESC NULLS LAST, event_id DESC) AS n FROM event_records) WHERE n = 1",
    "log_merge": f"WITH {_C}, a AS (SELECT case_id, run_id FROM c WHERE status <> 'pending'), b AS (SELECT case_id, error_message FROM c WHERE attempt_count > 0) SELECT coalesce(a.case_id, b.case_id) AS case_id, nullif(run_id, '') AS run_id, nullif(error_message, '') AS error_message FROM a FULL JOIN b ON a.case_id = b.case_id",
    "log_nested": f"WITH {_C} SELECT c.batch_id, CAST(row_number() OVER (PARTITION BY c.batch_id ORDER BY case_id) AS INT) AS sequence, case_id, c.status FROM c JOIN evaluation_batches b ON b.batch_id = c.batch_id",
    "log_state": "WITH c AS (SELECT DISTINCT ON (claim_id) * FROM research_claims) SELECT claim_id, last_value(topic IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY publish_date, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_topic FROM c",
    "log_requests": rf"""WITH {_C}, p AS (SELECT case_id, question, list_concat(
  list_transform(regexp_extract_all(question, '(?:^|\D)(\d{{4}}-\d{{2}}-\d{{2}})', 1), lambda x: x), list_transform(regexp_extract_all(question, '(?:^|\D)(\d{{4}}年\d{{1,2}}月\d{{1,2}}日)', 1), lambda x: strftime(strptime(x, '%Y年%m月%d日'), '%Y-%m-%d')),
  list_transform(regexp_extract_all(question, '(?:^|\D)(\d{{4}})年?(?:年报|年度报告|年度)', 1), lambda x: x || '-12-31'), list_transform(regexp_extract_all(question, '(?:^|\D)(\d{{4}})年?(?:半年报|半年度|中报)', 1), lambda x: x || '-06-30'),
  list_transform(regexp_extract_all(question, '(?:^|\D)(\d{{4}})年?(?:一季报|第一季度)', 1), lambda x: x || '-03-31'), list_transform(regexp_extract_all(question, '(?:^|\D)(\d{{4}})年?(?:三季报|前三季度)', 1), lambda x: x || '-09-30')) AS d FROM c)
SELECT case_id, array_to_string(list_sort(list_distinct(d)), ',') AS periods, array_to_string(list_sort(list_distinct(list_filter([{_strip_words()[0]}], lambda x: x IS NOT NULL))), ',') AS metrics FROM p""",
    "log_tasks": _read_sql() + " SELECT id, family, comparison, metrics, people, institutions, document_types, event_types, topics, claim_types FROM t",
    "log_answerable": _read_sql()
    + f" SELECT id, {req.case_sql(req.STATUS, "'routeable'")} AS status, missing, CASE WHEN {req.INVESTIGATION} OR realtime OR (n_entities > 1 AND family IN ('document_retrieval', 'event_query', 'ownership_snapshot')) THEN NULL ELSE {req.case_sql(req.DIRECT)} END AS direct, steps FROM t",
    "log_review": f"""WITH {_C}, a AS (SELECT batch_id, count(*) AS n_calls, count(*) FILTER (error_message IS NOT NULL) AS n_failed, count(*) FILTER (error_message IS NULL AND run_id IS NULL) AS n_empty, count(*) FILTER (error_message IS NULL AND run_id IS NOT NULL) AS n_covered FROM c GROUP BY 1)
SELECT *, CASE WHEN n_covered = 0 THEN 'insufficient' WHEN n_failed + n_empty = 0 THEN 'sufficient' ELSE 'partial' END AS review, CASE WHEN n_covered = 0 THEN 'insufficient_evidence' WHEN n_failed + n_empty = 0 THEN 'answered' ELSE 'partially_answered' END AS answer_status FROM a""",
    "st_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "st_sliding": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
    "st_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM k GROUP BY user_id, k.n""",
}
QUERIES = {k: globals()[k] for k in SQL}
