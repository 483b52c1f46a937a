"""Registered queries: one per operator of the inventory, each over whole driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the pre-registered driver views) describe the same result.  Aggregated
doubles are rounded to 4 places on both sides; per-row doubles are computed
with the same operation order on both sides and compared exactly.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import fixtures as fx
from chatloom import sqlcheck as S
from chatloom.config import DEFAULT
from chatloom.functions import scoring
from chatloom.functions.content import WS
from chatloom.operators import interactions as I
from chatloom.operators import pairing as P
from chatloom.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = dt.datetime(2024, 2, 1)
LAST_TRAINING = dt.datetime(2024, 1, 20)
LAST_DPO = dt.datetime(2024, 1, 10)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


INTERACTION_COLS = (
    "id, conversation_id, \"timestamp\", model_line, user_message, assistant_response, user_message_length, "
    "assistant_response_length, sentiment, weight, is_golden, is_refusal, truncated"
)

# ---------------------------------------------------------------- scoring / pairing


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(P.pair_turns(fx.fx_turns(spark, sf_dir)), "user_message")


@register(
    "entry_feedback_by_class",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte())
    + f"""SELECT CASE WHEN sentiment > 0.3 THEN 'positive' WHEN sentiment < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_class,
       count(*) AS interactions,
       round(avg(weight), 4) AS mean_weight,
       CAST(sum(CASE WHEN is_golden THEN 1 ELSE 0 END) AS BIGINT) AS golden
FROM {S.score_sql('fx_pairs')} GROUP BY 1""",
)
def q_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: turns -> feedback pairs (P2) -> lexicon score (E1/E2/E6/E7) -> per-class summary."""
    s = scored_pairs(spark, sf_dir)
    return s.groupBy(scoring.sentiment_class(F.col("sentiment")).alias("sentiment_class")).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.round(F.avg("weight"), 4).alias("mean_weight"),
        F.count_if(F.col("is_golden")).alias("golden"),
    )


@register(
    "p2_pair_turns",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + "SELECT conv_id, turn, user_message, assistant_response FROM fx_pairs",
)
def q_p2(spark, sf_dir):
    return P.pair_turns(fx.fx_turns(spark, sf_dir)).select("conv_id", "turn", "user_message", "assistant_response")


@register(
    "e2_score_pairs",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte())
    + f"SELECT conv_id, turn, user_message, sentiment, weight, is_golden FROM {S.score_sql('fx_pairs')}",
)
def q_e2(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("conv_id", "turn", "user_message", "sentiment", "weight", "is_golden")


def _e1_sql() -> str:
    from chatloom.functions import lexicon as L

    low = "lower(user_message)"
    cols = ", ".join(f"{L.sql_family_count(low, fam)} AS {fam}" for fam in L.FAMILIES)
    return with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + f"SELECT conv_id, turn, {cols} FROM fx_pairs"


@register("e1_lexicon_counts", _e1_sql())
def q_e1(spark, sf_dir):
    pairs = P.pair_turns(fx.fx_turns(spark, sf_dir))
    return scoring.with_lexicon_counts(pairs, "user_message").select(
        "conv_id", "turn", "strong_pos", "strong_neg", "mod_pos", "mod_neg", "instruction"
    )


@register(
    "e8_sentiment_flags",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte())
    + f"""SELECT conv_id, turn, sentiment > 0.3 AS is_positive, sentiment < -0.3 AS is_negative,
               abs(sentiment) <= 0.3 AS is_neutral FROM {S.score_sql('fx_pairs')}""",
)
def q_e8(spark, sf_dir):
    s = scored_pairs(spark, sf_dir)
    flags = scoring.sentiment_flags(F.col("sentiment"))
    return s.select("conv_id", "turn", *[v.alias(k) for k, v in flags.items()])


@register(
    "p3_drop_prompt_like",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte(drop_prompt_like=True).replace(
        "text AS user_message", f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS user_message"))
    + "SELECT conv_id, turn, user_message, assistant_response FROM fx_pairs",
)
def q_p3(spark, sf_dir):
    turns = P.drop_prompt_like_users(fx.fx_turns(spark, sf_dir))
    return P.pair_turns(turns).select("conv_id", "turn", "user_message", "assistant_response")


def _gated_pairs_sql() -> str:
    return f"""gated AS (
  SELECT conv_id, turn, ts, is_refusal, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS user_message, assistant_response FROM (
    SELECT *,
      last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS assistant_response,
      lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
      lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
    FROM (SELECT * FROM fx_turns WHERE NOT (role = 'user' AND regexp_matches(text, '^{WS}*###'))))
  WHERE role = 'user' AND assistant_response IS NOT NULL
    AND next_role = 'assistant' AND length(next_text) > 0 AND length(assistant_response) > 0
)"""


@register(
    "p4_storage_gate",
    with_ctes(S.fx_turns_cte(), _gated_pairs_sql()) + "SELECT conv_id, turn, user_message, assistant_response FROM gated",
)
def q_p4(spark, sf_dir):
    turns = P.drop_prompt_like_users(fx.fx_turns(spark, sf_dir))
    return P.storage_gate(P.pair_turns(turns, with_next=True)).select("conv_id", "turn", "user_message", "assistant_response")


def _interaction_sql_from(src: str, extra: str = "") -> str:
    return f"""SELECT {extra}CAST(conv_id AS VARCHAR) || '_' || CAST(epoch_us(ts) AS VARCHAR) AS id,
       CAST(conv_id AS VARCHAR) AS conversation_id, ts AS "timestamp",
       CASE WHEN length(user_message) > 60000 THEN substring(user_message, 1, 60000) || '...[TRUNCATED]' ELSE user_message END AS user_message,
       CASE WHEN length(assistant_response) > 60000 THEN substring(assistant_response, 1, 60000) || '...[TRUNCATED]' ELSE assistant_response END AS assistant_response,
       CAST(length(user_message) AS INTEGER) AS user_message_length,
       CAST(length(assistant_response) AS INTEGER) AS assistant_response_length,
       sentiment, weight, is_golden, is_refusal,
       length(user_message) > 60000 OR length(assistant_response) > 60000 AS truncated
FROM {S.score_sql(src)}"""


@register("p6_capture_pipeline", with_ctes(S.fx_turns_cte(), _gated_pairs_sql()) + _interaction_sql_from("gated"))
def q_p6(spark, sf_dir):
    return P.capture_pipeline(fx.fx_turns(spark, sf_dir)).drop("document")


@register("i1_build_interactions", with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + _interaction_sql_from("fx_pairs"))
def q_i1(spark, sf_dir):
    s = scored_pairs(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("ts").alias("timestamp"),
        "user_message", "assistant_response", "sentiment", "weight", "is_golden", "is_refusal",
    )
    return I.build_interactions(s).drop("document")


# ---------------------------------------------------------------- interaction table

FXI = S.fx_interactions_cte()


def fxi(spark, sf_dir):
    return fx.fx_interactions(spark, sf_dir)


@register(
    "i2_interactions_since",
    with_ctes(FXI)
    + f"SELECT {INTERACTION_COLS} FROM fx_interactions WHERE \"timestamp\" > TIMESTAMP '2024-01-25 00:00:00' "
    "ORDER BY \"timestamp\" DESC, id DESC LIMIT 100",
)
def q_i2(spark, sf_dir):
    return I.interactions_since(fxi(spark, sf_dir), dt.datetime(2024, 1, 25), 100)


@register(
    "i3_top_by_weight",
    with_ctes(FXI) + f"SELECT {INTERACTION_COLS} FROM fx_interactions WHERE NOT is_golden "
    "ORDER BY coalesce(weight, 1.0) DESC, \"timestamp\", id LIMIT 1000",
)
def q_i3(spark, sf_dir):
    return I.top_by_weight(fxi(spark, sf_dir), 1000, exclude_golden=True)


@register("i4_golden_examples", with_ctes(FXI) + f"SELECT {INTERACTION_COLS} FROM fx_interactions WHERE is_golden")
def q_i4(spark, sf_dir):
    return I.golden_examples(fxi(spark, sf_dir))


def _error_ids(spark, sf_dir) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "error").select(F.col("event_id").cast("string").alias("id"))


@register(
    "i5_lookup",
    with_ctes(FXI) + f"SELECT {INTERACTION_COLS} FROM fx_interactions WHERE id IN "
    "(SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error')",
)
def q_i5(spark, sf_dir):
    return I.lookup(fxi(spark, sf_dir), _error_ids(spark, sf_dir))


@register(
    "i6_apply_updates",
    with_ctes(FXI)
    + """SELECT f.id, f.conversation_id, f."timestamp", f.model_line, f.user_message, f.assistant_response,
       f.user_message_length, f.assistant_response_length,
       CASE WHEN event_type = 'error' THEN CAST(-1.0 AS DOUBLE) ELSE f.sentiment END AS sentiment,
       CASE WHEN value > 400 THEN CAST(5.0 AS DOUBLE) ELSE f.weight END AS weight,
       CASE WHEN event_type = 'error' THEN false WHEN value > 400 THEN true ELSE f.is_golden END AS is_golden, f.is_refusal, f.truncated
FROM fx_interactions f JOIN events e ON f.id = CAST(e.event_id AS VARCHAR)""",
)
def q_i6(spark, sf_dir):
    return I.apply_updates(fxi(spark, sf_dir), event_updates(spark, sf_dir))


def event_updates(spark, sf_dir):
    """Two waves of updates: large values get weight and golden, then errors a sentiment and no golden."""
    ev = read_table(spark, sf_dir, "events")
    key, none = F.col("event_id").cast("string").alias("id"), F.lit(None).cast("double")
    first = ev.where(F.col("value") > 400).select(
        key, none.alias("sentiment"), F.lit(5.0).alias("weight"), F.lit(True).alias("is_golden"), F.lit(1).alias("seq"))
    then = ev.where(F.col("event_type") == "error").select(
        key, F.lit(-1.0).alias("sentiment"), none.alias("weight"), F.lit(False).alias("is_golden"), F.lit(2).alias("seq"))
    return first.unionByName(then)


@register(
    "i7_toggle_golden",
    with_ctes(FXI)
    + """SELECT id, conversation_id, "timestamp", model_line, user_message, assistant_response, user_message_length,
       assistant_response_length, sentiment, weight,
       CASE WHEN id IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE value > 300) THEN NOT is_golden ELSE is_golden END AS is_golden,
       is_refusal, truncated FROM fx_interactions""",
)
def q_i7(spark, sf_dir):
    ids = read_table(spark, sf_dir, "events").where(F.col("value") > 300).select(F.col("event_id").cast("string"))
    return I.toggle_golden(fxi(spark, sf_dir), ids)


@register(
    "i8_reevaluate_golden",
    with_ctes(FXI)
    + """SELECT count(*) FILTER (WHERE is_golden) AS total_golden,
       count(*) FILTER (WHERE is_golden AND NOT still) AS removed,
       count(*) FILTER (WHERE is_golden AND still) AS kept
FROM (SELECT *, (coalesce(weight, 1.0) >= 5.0 OR sentiment >= 0.7
        OR (abs(sentiment) >= 0.3 AND (contains(lower(user_message), 'from now on') OR contains(lower(user_message), 'going forward')
             OR contains(lower(user_message), 'in the future') OR contains(lower(user_message), 'always do')
             OR contains(lower(user_message), 'never do') OR contains(lower(user_message), 'remember to')))
        OR (sentiment < -0.6 AND length(user_message) > 300)) AS still FROM fx_interactions)""",
)
def q_i8(spark, sf_dir):
    return I.golden_reevaluation_report(I.reevaluate_golden(fxi(spark, sf_dir)))


@register(
    "i9_delete_ids",
    with_ctes(FXI) + f"SELECT {INTERACTION_COLS} FROM fx_interactions WHERE id NOT IN "
    "(SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error')",
)
def q_i9(spark, sf_dir):
    return I.delete_ids(fxi(spark, sf_dir), _error_ids(spark, sf_dir))


@register(
    "i10_prune_by_age",
    with_ctes(FXI) + f"SELECT {INTERACTION_COLS} FROM fx_interactions "
    "WHERE NOT (\"timestamp\" < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY AND NOT is_golden)",
)
def q_i10(spark, sf_dir):
    return I.prune_by_age(fxi(spark, sf_dir), NOW, 20)[0]


@register(
    "i11_prune_by_weight",
    with_ctes(FXI) + f"SELECT {INTERACTION_COLS} FROM fx_interactions WHERE NOT (coalesce(weight, 1.0) < 0.5 AND NOT is_golden)",
)
def q_i11(spark, sf_dir):
    return I.prune_by_weight(fxi(spark, sf_dir), 0.5)[0]


@register(
    "i12_prune_lowest",
    with_ctes(FXI)
    + f"""SELECT {INTERACTION_COLS} FROM (
  SELECT *, row_number() OVER (ORDER BY coalesce(weight, 1.0), "timestamp", id) - 1 AS rk FROM fx_interactions WHERE NOT is_golden)
WHERE rk >= (SELECT CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) FROM fx_interactions WHERE NOT is_golden)
UNION ALL SELECT {INTERACTION_COLS} FROM fx_interactions WHERE is_golden""",
)
def q_i12(spark, sf_dir):
    return I.prune_lowest(fxi(spark, sf_dir), 0.1)[0]


@register(
    "i14_list_interactions",
    with_ctes(FXI)
    + """SELECT id, "timestamp", conversation_id, substring(user_message, 1, 200) AS user_message,
       substring(assistant_response, 1, 200) AS assistant_response,
       CAST(round(CAST(CAST(sentiment AS VARCHAR) AS DECIMAL(38, 17)), 3) AS DOUBLE) AS sentiment,
       CAST(round(CAST(CAST(weight AS VARCHAR) AS DECIMAL(38, 17)), 2) AS DOUBLE) AS weight, is_golden,
       count(*) OVER () AS total
FROM fx_interactions
WHERE sentiment < -0.3 AND "timestamp" >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 240 HOUR
ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 10""",
)
def q_i14(spark, sf_dir):
    return I.list_interactions(fxi(spark, sf_dir), now=NOW, sentiment_filter="negative", hours=240, skip=10, limit=50)


@register(
    "i15_recent",
    with_ctes(FXI)
    + """SELECT id, "timestamp", conversation_id, user_message, assistant_response,
       CAST(round(CAST(CAST(sentiment AS VARCHAR) AS DECIMAL(38, 17)), 3) AS DOUBLE) AS sentiment,
       CAST(round(CAST(CAST(weight AS VARCHAR) AS DECIMAL(38, 17)), 2) AS DOUBLE) AS weight, is_golden,
       (SELECT count(*) FROM fx_interactions) AS total,
       least(20, (SELECT count(*) FROM fx_interactions)) AS returned
FROM fx_interactions ORDER BY "timestamp" DESC, id DESC LIMIT 20""",
)
def q_i15(spark, sf_dir):
    return I.recent(fxi(spark, sf_dir), 20)


# ---------------------------------------------------------------- rewriting

from chatloom.operators import rewrite as R  # noqa: E402

# Fixed rule set of the rewrite queries: group references, a literal '$', a disabled
# rule, an invalid pattern, a missing priority, equal priorities, 'all', role-specific
# rules, a missing role list (system only) and a rule that only sees an earlier rule's output.
DEMO_RULES = [
    {"id": "swap", "pattern": "(Th)(e)", "replacement": "\\g<2>\\1", "target_roles": ["user"], "priority": 10},
    {"id": "dollar", "pattern": " and ", "replacement": " & $AND ", "target_roles": ["all"], "priority": 20},
    {"id": "off", "pattern": "of", "replacement": "XX", "target_roles": ["all"], "enabled": False, "priority": 1},
    {"id": "broken", "pattern": "(unclosed", "replacement": "x", "target_roles": ["all"], "priority": 5},
    {"id": "chained", "pattern": "eTh", "replacement": "[ETH]", "target_roles": ["user"]},
    {"id": "assistant_only", "pattern": "tion", "replacement": "TION", "target_roles": ["assistant"], "priority": 20},
    {"id": "system_default", "pattern": "\\n", "replacement": " "},
]


def _rules_sql(src: str, ignore_roles: bool = False) -> tuple[str, list]:
    compiled = R.compile_rules(DEMO_RULES)
    cur = src
    for r in compiled:
        pat = S.q(r.source)
        rep = S.q(R.to_re2_replacement(r.tokens))
        if ignore_roles or "all" in r.roles:
            cond = "text IS NOT NULL"
        else:
            cond = "role IN (" + ", ".join(S.q(x) for x in r.roles) + ") AND text IS NOT NULL"
        cur = f"(SELECT * REPLACE (CASE WHEN {cond} THEN regexp_replace(text, {pat}, {rep}, 'g') ELSE text END AS text) FROM {cur})"
    return cur, compiled


def _r2_sql() -> str:
    body, _ = _rules_sql("fx_turns")
    return with_ctes(S.fx_turns_cte()) + f"SELECT conv_id, turn, role, text FROM {body}"


# Sample rules for the compilation itself: order, filters, and meanings in which regex engines differ.
COMPILE_RULES = [
    {"id": "end", "pattern": r"\.$", "replacement": "<end>", "priority": 200},
    {"id": "spaces", "pattern": r"\s+", "replacement": "_"},
    {"id": "off", "pattern": "e", "replacement": "x", "enabled": False},
    {"id": "marks", "pattern": r"[^\w\s]", "replacement": "*"},
    {"id": "broken", "pattern": "(", "replacement": "x", "priority": 0},
    {"id": "first", "pattern": r"(?P<a_1>\w)(\w*)$", "replacement": r"\2\g<a_1>1", "priority": 1},
    {"id": "dots", "pattern": "e.", "replacement": "$0"},
]
COMPILE_TAILS = ["end.\r\n", "end.\n", "e\u2028e\x1ce\x85", "²³ ½.", "e\re\n", "naïve\u00a0é_"]


def _r1_sql() -> str:
    """Every rule as the reference's language reads it, written for this engine by hand; in the order of (priority, place)."""
    space, word = r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", r"\p{L}\p{N}_"
    rules = [("first", rf"([{word}])([{word}]*)(\n?)\z", r"\2\11\3"), ("spaces", f"[{space}]+", "_"), ("marks", f"[^{word}{space}]", "*"),
             ("dots", r"e[^\n]", "$0"), ("end", r"\.(\n?)\z", r"<end>\1")]
    tails = ", ".join(" || ".join(f"chr({ord(c)})" for c in t) for t in COMPILE_TAILS)
    texts = f"(SELECT conv_id, turn, text || ([{tails}])[1 + (conv_id + turn) % {len(COMPILE_TAILS)}] AS text FROM fx_turns)"
    return with_ctes(S.fx_turns_cte()) + " UNION ALL ".join(
        f"SELECT conv_id, turn, {i} AS position, {S.q(name)} AS rule_id, regexp_replace(text, {S.q(p)}, {S.q(r)}, 'g') AS output FROM {texts}"
        for i, (name, p, r) in enumerate(rules))


@register("r1_compile_rules", _r1_sql())
def q_r1(spark, sf_dir):
    """What every compiled rule alone makes of every turn, with endings in which regex engines differ."""
    n = F.col("conv_id") + F.col("turn")
    tail = F.element_at(F.array(*[F.lit(t) for t in COMPILE_TAILS]), (n % len(COMPILE_TAILS) + 1).cast("int"))
    turns = fx.fx_turns(spark, sf_dir).select("conv_id", "turn", F.concat("text", tail).alias("text"))
    each = [F.struct(F.lit(i).alias("position"), F.lit(r.id).alias("rule_id"), F.regexp_replace("text", r.pattern, r.replacement).alias("output"))
            for i, r in enumerate(R.compile_rules(COMPILE_RULES, spark))]
    return turns.select("conv_id", "turn", F.inline(F.array(*each)))


@register("r2_apply_rules", _r2_sql())
def q_r2(spark, sf_dir):
    turns = fx.fx_turns(spark, sf_dir).select("conv_id", "turn", "role", "text")
    return R.apply_rules(turns, R.compile_rules(DEMO_RULES, spark))


# A rule for every pair of these letters: a set that is applied as one expression.
MANY_RULES = [
    {"id": f"{a}{b}", "pattern": f"{a}{b}+", "replacement": f"{b}<{i}>", "target_roles": ["all"] if i % 3 else ["user"], "priority": i % 7}
    for i, (a, b) in enumerate((a, b) for a in "aeiouth" for b in "nrstlhd")
]


def _r2_many_sql() -> str:
    ordered = sorted(MANY_RULES, key=lambda r: r["priority"])
    cur = "fx_turns"
    for r in ordered:
        cond = "true" if r["target_roles"] == ["all"] else "role = 'user'"
        cur = f"(SELECT * REPLACE (CASE WHEN {cond} THEN regexp_replace(text, '{r['pattern']}', '{r['replacement']}', 'g') ELSE text END AS text) FROM {cur})"
    return with_ctes(S.fx_turns_cte()) + f"SELECT conv_id, turn, role, text FROM {cur}"


@register("r2_apply_many_rules", _r2_many_sql())
def q_r2_many(spark, sf_dir):
    turns = fx.fx_turns(spark, sf_dir).select("conv_id", "turn", "role", "text")
    return R.apply_rules(turns, R.compile_rules(MANY_RULES, spark))


def _r3_sql() -> str:
    compiled = R.compile_rules(DEMO_RULES)
    cur = "(SELECT text AS _out FROM fx_turns)"
    for i, r in enumerate(compiled):
        pat = S.q(r.source)
        rep = S.q(R.to_re2_replacement(r.tokens))
        cur = (f"(SELECT * REPLACE (regexp_replace(_out, {pat}, {rep}, 'g') AS _out), "
               f"coalesce(regexp_replace(_out, {pat}, {rep}, 'g') <> _out, false) AS _m{i} FROM {cur})")
    unions = " UNION ALL ".join(
        f"SELECT {S.q(r.id)} AS rule_id, count(*) FILTER (WHERE _m{i}) AS rows_changed FROM {cur}"
        for i, r in enumerate(compiled)
    )
    return with_ctes(S.fx_turns_cte()) + unions


@register("r3_rule_match_report", _r3_sql())
def q_r3(spark, sf_dir):
    turns = fx.fx_turns(spark, sf_dir)
    return R.rule_match_report(turns, R.compile_rules(DEMO_RULES, spark))[1]


# ---------------------------------------------------------------- statistics and decisions

from chatloom.operators import stats as A  # noqa: E402

TS_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
TS_LT = "TIMESTAMP '2024-01-20 00:00:00'"
TS_LD = "TIMESTAMP '2024-01-10 00:00:00'"
D = S.d


def _a1_sql(group: str | None, lt: str | None, ld: str | None) -> str:
    new = f'"timestamp" > {lt}' if lt else "true"
    since = f'"timestamp" > {ld}' if ld else new
    el = lambda a, b, unit: f"((epoch_us({a}) - epoch_us({b})) / {D(1000000.0)}) / {D(unit)}"
    days_tr = el(TS_NOW, lt, 86400.0) if lt else D(999.0)
    days_dpo = el(TS_NOW, ld, 86400.0) if ld else D(999.0)
    g = f"{group}, " if group else ""
    return with_ctes(FXI) + f"""SELECT {g}count(*) AS total,
  count(*) FILTER (WHERE {new}) AS new,
  CASE WHEN count(*) = 0 THEN {D(0.0)} ELSE {el(TS_NOW, 'max("timestamp")', 3600.0)} END AS hours_since_last,
  CASE WHEN count(*) = 0 THEN {D(999.0)} ELSE {days_tr} END AS days_since_training,
  count(*) FILTER (WHERE {new} AND sentiment > 0.3) AS new_positive,
  count(*) FILTER (WHERE {new} AND sentiment < -0.3) AS new_negative,
  count(*) FILTER (WHERE {new} AND abs(sentiment) <= 0.3) AS new_neutral,
  count(*) FILTER (WHERE {new} AND is_golden) AS new_golden,
  count(*) FILTER (WHERE {new} AND is_refusal) AS new_refusal,
  count(*) FILTER (WHERE {since} AND sentiment < -0.3) AS new_negative_since_dpo,
  count(*) FILTER (WHERE {since} AND is_refusal) AS new_refusals_since_dpo,
  CASE WHEN count(*) = 0 THEN {D(999.0)} ELSE {days_dpo} END AS days_since_dpo
FROM fx_interactions {'GROUP BY ' + group if group else ''}"""


@register("a1_training_stats", _a1_sql(None, TS_LT, TS_LD))
def q_a1(spark, sf_dir):
    return A.training_stats(fxi(spark, sf_dir), NOW, LAST_TRAINING, LAST_DPO)


@register("a1_training_stats_by_model", _a1_sql("model_line", TS_LT, TS_LD))
def q_a1m(spark, sf_dir):
    return A.training_stats(fxi(spark, sf_dir), NOW, LAST_TRAINING, LAST_DPO, group=["model_line"])


@register("a1_training_stats_never_trained", _a1_sql(None, None, None))
def q_a1n(spark, sf_dir):
    return A.training_stats(fxi(spark, sf_dir), NOW, None, None)


@register(
    "a2_sentiment_distribution",
    with_ctes(FXI) + """SELECT model_line, count(*) AS total, count(*) FILTER (WHERE sentiment > 0.3) AS positive,
  count(*) FILTER (WHERE sentiment < -0.3) AS negative,
  count(*) - count(*) FILTER (WHERE sentiment > 0.3) - count(*) FILTER (WHERE sentiment < -0.3) AS neutral
FROM fx_interactions GROUP BY model_line""",
)
def q_a2(spark, sf_dir):
    return A.sentiment_distribution(fxi(spark, sf_dir), ["model_line"])


@register(
    "a3_store_overview",
    with_ctes(FXI) + f"""SELECT {D(2.5)} AS size_gb, {D(10.0)} AS max_size_gb, {D(9.0)} AS threshold_size_gb,
  {D(25.0)} AS usage_percentage, count(*) AS total_interactions, count(*) FILTER (WHERE is_golden) AS golden_examples,
  true AS auto_cleanup_enabled, {D(10.0)} AS auto_cleanup_percentage FROM fx_interactions""",
)
def q_a3(spark, sf_dir):
    return A.store_overview(fxi(spark, sf_dir), 2.5)


def _a4_sql() -> str:
    inner = _a1_sql("model_line", TS_LT, TS_LD)[len("WITH "):]
    fxi_part, select_part = inner.split("\nSELECT ", 1)
    sig = "(new_negative_since_dpo + new_refusals_since_dpo)"
    mode = f"CASE WHEN {sig} >= 5 THEN 'dpo' ELSE 'sft' END"
    pos = "(new_positive + new_golden)"
    return f"""WITH {fxi_part}, st AS (SELECT {select_part})
SELECT model_line,
  CASE WHEN {sig} >= 5 OR {pos} >= 20 OR (hours_since_last >= 8.0 AND new >= 10) THEN true ELSE false END AS should_train,
  CASE WHEN {sig} >= 5 THEN CAST({sig} AS VARCHAR) || '_dpo_signals'
       WHEN {pos} >= 20 THEN CAST({pos} AS VARCHAR) || '_positive_examples'
       WHEN hours_since_last >= 8.0 AND new >= 10 THEN 'inactivity_consolidation' ELSE 'none' END AS reason,
  CASE WHEN {sig} >= 5 THEN 'dpo' WHEN {pos} >= 20 THEN 'sft'
       WHEN hours_since_last >= 8.0 AND new >= 10 THEN {mode} ELSE 'none' END AS mode,
  {mode} AS data_mode
FROM st"""


@register("a4_training_decision", _a4_sql())
def q_a4(spark, sf_dir):
    st = A.training_stats(fxi(spark, sf_dir), NOW, LAST_TRAINING, LAST_DPO, group=["model_line"])
    dec = A.training_decision()
    return st.select(
        "model_line", dec["should_train"].alias("should_train"), dec["reason"].alias("reason"),
        dec["mode"].alias("mode"), A.training_mode().alias("data_mode"),
    )


@register(
    "a8_advance_training_state",
    with_ctes(S.fx_runs_cte()) + """SELECT model_line, max(ts) AS last_training,
  max(CASE WHEN mode = 'dpo' THEN ts END) AS last_dpo, arg_max(mode, (ts, run_id)) AS last_mode, count(*) AS runs
FROM fx_runs GROUP BY model_line""",
)
def q_a8(spark, sf_dir):
    return A.advance_training_state(fx.fx_runs(spark, sf_dir), ["model_line"])


@register("a6_status_report")
def q_a6(spark, sf_dir):
    st = A.training_stats(fxi(spark, sf_dir), NOW, LAST_TRAINING, LAST_DPO, group=["model_line"])
    return A.status_report(st).select("model_line", "status")


# ---------------------------------------------------------------- training sets

from chatloom.operators import datasets as DS  # noqa: E402

CAPPED_POOL_CTES = [
    FXI,
    "golden AS (SELECT * FROM fx_interactions WHERE is_golden)",
    """pool AS (SELECT * EXCLUDE (rn) FROM (
       SELECT *, row_number() OVER (ORDER BY coalesce(weight, 1.0) DESC, "timestamp", id) AS rn
       FROM fx_interactions WHERE NOT is_golden)
     WHERE rn <= (SELECT greatest(0, 1000 - count(*)) FROM golden))""",
]
POOL_CTES = [
    FXI,
    "golden AS (SELECT * FROM fx_interactions WHERE is_golden)",
    "pool AS (SELECT * FROM fx_interactions WHERE NOT coalesce(is_golden, false))",
]


def _sample_sql(src: str, typ: str, chosen: str, rejected: str, wmul: float | None, where: str) -> str:
    w = "coalesce(weight, CAST(1.0 AS DOUBLE))" + (f" * {D(wmul)}" if wmul is not None else "")
    return (f"SELECT '{typ}:' || id AS sample_id, user_message AS prompt, CAST({chosen} AS VARCHAR) AS chosen, "
            f"CAST({rejected} AS VARCHAR) AS rejected, {w} AS weight, coalesce(sentiment, CAST(0.0 AS DOUBLE)) AS sentiment, "
            f"'{typ}' AS type FROM {src} WHERE {where}")


SFT_CTE = "sft AS (" + " UNION ALL ".join([
    _sample_sql("pool", "positive", "assistant_response", "NULL", None, "sentiment > 0.3"),
    _sample_sql("pool", "negative", "NULL", "assistant_response", 2.0, "sentiment < -0.3"),
    _sample_sql("pool", "neutral", "assistant_response", "NULL", 0.5, "abs(sentiment) <= 0.3"),
    _sample_sql("golden", "golden", "assistant_response", "NULL", None, "true"),
]) + ")"

REJ_CTES = [
    S.fx_replies_cte(),
    S.clean_rejections_cte(),
    "rej AS (SELECT * FROM (SELECT prompt AS _p, arg_max(rejection, seq) FILTER (WHERE length(rejection) > 0) AS rejection FROM cleaned GROUP BY prompt) WHERE rejection IS NOT NULL)",
    "pool_r AS (SELECT * FROM pool LEFT JOIN rej ON pool.user_message = rej._p)",
    "golden_r AS (SELECT * FROM golden LEFT JOIN rej ON golden.user_message = rej._p)",
]

DPO_CTE = "dpo AS (" + " UNION ALL ".join([
    _sample_sql("pool", "refusal_rejected_only", "NULL", "assistant_response", None, "coalesce(is_refusal, false)"),
    _sample_sql("pool_r", "positive_dpo", "assistant_response", "rejection", None,
                "NOT coalesce(is_refusal, false) AND sentiment > 0.3 AND rejection IS NOT NULL"),
    _sample_sql("pool_r", "positive_sft", "assistant_response", "NULL", None,
                "NOT coalesce(is_refusal, false) AND sentiment > 0.3 AND rejection IS NULL"),
    _sample_sql("pool_r", "neutral_dpo", "assistant_response", "rejection", 0.5,
                "NOT coalesce(is_refusal, false) AND abs(sentiment) <= 0.3 AND rejection IS NOT NULL"),
    _sample_sql("golden_r", "golden_dpo", "assistant_response", "rejection", 2.0, "rejection IS NOT NULL"),
    _sample_sql("golden_r", "golden_sft", "assistant_response", "NULL", 2.0, "rejection IS NULL"),
]) + ")"


def pool_and_golden(spark, sf_dir):
    """Every non-golden and every golden interaction: the cap of D1 is D1's own."""
    rows = fxi(spark, sf_dir)
    golden = F.coalesce(F.col("is_golden"), F.lit(False))
    return rows.where(~golden), rows.where(golden)


def rejections_of(spark, sf_dir, drop_short: bool = True):
    return DS.clean_rejections(fx.fx_replies(spark, sf_dir), drop_short=drop_short).select("prompt", "seq", "rejection")


def sft_set(spark, sf_dir):
    return DS.build_sft(DS.whole_pool(fxi(spark, sf_dir)))


def dpo_set(spark, sf_dir):
    return DS.build_dpo(DS.whole_pool(fxi(spark, sf_dir)), None, rejections_of(spark, sf_dir, drop_short=False))


@register("d1_training_pool", with_ctes(*CAPPED_POOL_CTES) + f"SELECT {INTERACTION_COLS} FROM pool UNION ALL SELECT {INTERACTION_COLS} FROM golden")
def q_d1(spark, sf_dir):
    pool, golden = DS.select_training_pool(fxi(spark, sf_dir))
    return pool.unionByName(golden)


@register("d2_build_sft", with_ctes(*POOL_CTES, SFT_CTE) + "SELECT * FROM sft")
def q_d2(spark, sf_dir):
    return sft_set(spark, sf_dir)


@register("d3_build_dpo", with_ctes(*POOL_CTES, *REJ_CTES, DPO_CTE) + "SELECT * FROM dpo")
def q_d3(spark, sf_dir):
    return dpo_set(spark, sf_dir)


@register(
    "d4_dataset_composition",
    with_ctes(*POOL_CTES, *REJ_CTES, DPO_CTE) + """SELECT type, count(*) AS samples,
  count(*) FILTER (WHERE chosen IS NOT NULL) AS sft_usable, count(*) FILTER (WHERE rejected IS NOT NULL) AS preference_pairs,
  count(*) FILTER (WHERE rejected IS NULL) AS fallbacks FROM dpo GROUP BY type""",
)
def q_d4(spark, sf_dir):
    return DS.dataset_composition(dpo_set(spark, sf_dir))


@register(
    "d5_rejection_prompts",
    with_ctes(*POOL_CTES) + """SELECT id, user_message AS prompt, 0 AS source_order FROM pool WHERE sentiment > 0.3
UNION ALL SELECT id, user_message, 1 FROM pool WHERE abs(sentiment) <= 0.3
UNION ALL SELECT id, user_message, 2 FROM golden""",
)
def q_d5(spark, sf_dir):
    pool, golden = pool_and_golden(spark, sf_dir)
    return DS.rejection_prompts(pool, golden)


@register("d6_clean_rejections", with_ctes(S.fx_replies_cte(), S.clean_rejections_cte()) + "SELECT prompt, seq, rejection FROM cleaned")
def q_d6(spark, sf_dir):
    return rejections_of(spark, sf_dir)


@register(
    "d8_fresh_rejections",
    with_ctes(S.fx_replies_cte(), S.clean_rejections_cte())
    + f"""SELECT prompt, seq, rejection, cached_at FROM cleaned
WHERE NOT (((epoch_us({TS_NOW}) - epoch_us(cached_at)) / {D(1000000.0)}) / {D(3600.0)} > {D(6.0)})""",
)
def q_d8(spark, sf_dir):
    cache = DS.clean_rejections(fx.fx_replies(spark, sf_dir))
    return DS.fresh_rejections(cache, NOW).select("prompt", "seq", "rejection", "cached_at")


@register(
    "d9_split_train_val",
    with_ctes(*POOL_CTES, SFT_CTE) + f"""SELECT * EXCLUDE (pos),
  CASE WHEN pos < (SELECT CAST(floor(count(*) * ({D(1.0)} - {D(0.1)})) AS BIGINT) FROM sft) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('42' || sample_id), sample_id) - 1 AS pos FROM sft)""",
)
def q_d9(spark, sf_dir):
    return DS.with_split(sft_set(spark, sf_dir), 0.1, seed=42)


@register("d10_format_sft", with_ctes(*POOL_CTES, SFT_CTE) + "SELECT prompt, chosen AS completion, weight FROM sft WHERE chosen IS NOT NULL")
def q_d10(spark, sf_dir):
    return DS.format_sft(sft_set(spark, sf_dir))


@register(
    "d11_format_dpo",
    with_ctes(*POOL_CTES, *REJ_CTES, DPO_CTE)
    + f"""SELECT regexp_replace(prompt, '{WS}+$', '') AS prompt, chosen, rejected FROM dpo
WHERE coalesce(length(chosen), 0) > 0 AND coalesce(length(rejected), 0) > 0""",
)
def q_d11(spark, sf_dir):
    return DS.format_dpo(dpo_set(spark, sf_dir))


@register(
    "d12_render_chat",
    with_ctes(*POOL_CTES, SFT_CTE) + """SELECT prompt, chosen AS completion, weight,
  '<|start|>user<|message|>' || prompt || '<|end|><|start|>assistant<|channel|>final<|message|>' AS prompt_text,
  '<|start|>user<|message|>' || prompt || '<|end|><|start|>assistant<|channel|>final<|message|>' || chosen || '<|return|>' AS full_text
FROM sft WHERE chosen IS NOT NULL""",
)
def q_d12(spark, sf_dir):
    return DS.render_chat(DS.format_sft(sft_set(spark, sf_dir)), "harmony")


@register(
    "j4_attach_rejections",
    with_ctes(*POOL_CTES, *REJ_CTES) + "SELECT id, user_message, rejection FROM pool_r",
)
def q_j4(spark, sf_dir):
    pool, _ = pool_and_golden(spark, sf_dir)
    return DS.attach_rejections(pool, rejections_of(spark, sf_dir, drop_short=False)).select("id", "user_message", "rejection")


# ---------------------------------------------------------------- checkpoint analytics

from chatloom.operators import checkpoints as CK  # noqa: E402

FXR = S.fx_runs_cte()
PPL_SQL = (f"CASE WHEN coalesce(eval_loss, {D(0.0)}) < 100 THEN floor(exp(coalesce(eval_loss, {D(0.0)})) * {D(1e9)} + {D(0.5)}) / {D(1e9)} "
           f"ELSE {D(999.0)} END")


@register(
    "c1_checkpoint_metrics",
    with_ctes(FXR) + f"""SELECT run_id, model_line, mode,
  CASE WHEN mode = 'dpo' THEN NULL ELSE {PPL_SQL} END AS sft_perplexity,
  coalesce(train_loss, {D(0.0)}) AS train_loss_or_0, coalesce(eval_loss, {D(0.0)}) AS eval_loss_or_0 FROM fx_runs""",
)
def q_c1(spark, sf_dir):
    return CK.checkpoint_metrics(fx.fx_runs(spark, sf_dir)).select(
        "run_id", "model_line", "mode", "sft_perplexity", "train_loss_or_0", "eval_loss_or_0"
    )


GATE_CTES = [
    FXR,
    f"""r AS (SELECT *, row_number() OVER (PARTITION BY model_line ORDER BY ts, run_id) AS rn,
              CASE WHEN mode = 'dpo' THEN NULL ELSE {PPL_SQL} END AS q_sft FROM fx_runs)""",
    f"""g AS (
  SELECT model_line, rn, run_id, ts, mode, CASE WHEN mode = 'dpo' THEN {D(999.0)} ELSE q_sft END AS perplexity,
         true AS deployed, CAST(NULL AS BIGINT) AS parent_run,
         CASE WHEN mode = 'dpo' THEN {D(999.0)} ELSE q_sft END AS cur_p, run_id AS cur_id
  FROM r WHERE rn = 1
  UNION ALL
  SELECT n.model_line, n.rn, n.run_id, n.ts, n.mode, n.q, n.dep, g.cur_id,
         CASE WHEN n.dep THEN n.q ELSE g.cur_p END, CASE WHEN n.dep THEN n.run_id ELSE g.cur_id END
  FROM g JOIN LATERAL (
    SELECT r.*, CASE WHEN r.mode = 'dpo' THEN g.cur_p ELSE r.q_sft END AS q,
           (g.cur_p < {D(2.0)} OR (CASE WHEN r.mode = 'dpo' THEN g.cur_p ELSE r.q_sft END) <= g.cur_p * {D(1.05)}) AS dep
    FROM r WHERE r.model_line = g.model_line AND r.rn = g.rn + 1) n ON true
)""",
]


@register(
    "c2_deploy_gate",
    "WITH RECURSIVE " + ",\n".join(GATE_CTES) + "\nSELECT model_line, run_id, ts, mode, perplexity, deployed, parent_run FROM g",
)
def q_c2(spark, sf_dir):
    return CK.deploy_gate(fx.fx_runs(spark, sf_dir))


@register(
    "c3_checkpoints_to_drop",
    "WITH RECURSIVE " + ",\n".join(GATE_CTES) + """,
cur AS (SELECT model_line, arg_max(run_id, (ts, run_id)) AS current_run FROM g WHERE deployed GROUP BY model_line),
others AS (SELECT f.* FROM fx_runs f LEFT JOIN cur c ON f.model_line = c.model_line
           WHERE c.current_run IS NULL OR f.run_id <> c.current_run)
SELECT run_id, model_line, ts, mode, train_loss, eval_loss, has_adapter FROM (
  SELECT *, row_number() OVER (PARTITION BY model_line ORDER BY ts DESC, run_id DESC) AS rk FROM others) WHERE rk > 3""",
)
def q_c3(spark, sf_dir):
    runs = fx.fx_runs(spark, sf_dir)
    current = CK.current_checkpoints(CK.deploy_gate(runs))
    return CK.checkpoints_to_drop(runs, current, 3)


@register(
    "c4_rotate_checkpoints",
    with_ctes(FXR) + """SELECT run_id, model_line, ts, mode, train_loss, eval_loss, has_adapter FROM (
  SELECT *, row_number() OVER (PARTITION BY model_line ORDER BY ts DESC, run_id DESC) AS rk FROM fx_runs) WHERE rk > 3""",
)
def q_c4(spark, sf_dir):
    return CK.rotate_checkpoints(fx.fx_runs(spark, sf_dir), 3)


@register(
    "c5_dangling_checkpoints",
    with_ctes(FXR) + "SELECT * FROM fx_runs WHERE run_id NOT IN (SELECT run_id FROM fx_runs WHERE has_adapter)",
)
def q_c5(spark, sf_dir):
    runs = fx.fx_runs(spark, sf_dir)
    return CK.dangling_checkpoints(runs, runs.where("has_adapter"))


@register(
    "c7_rollback",
    with_ctes(FXR) + """, req AS (
  SELECT model_line, min(run_id) AS run_id FROM fx_runs GROUP BY model_line
  UNION ALL SELECT model_line, max(run_id) + 1 FROM fx_runs GROUP BY model_line)
SELECT q.model_line, q.run_id,
  CASE WHEN f.run_id IS NULL THEN 'not_found' WHEN NOT coalesce(f.has_adapter, false) THEN 'no_adapter' ELSE 'ok' END AS status,
  CASE WHEN f.run_id IS NOT NULL AND f.has_adapter THEN q.run_id END AS current_run,
  coalesce(f.run_id IS NOT NULL AND f.has_adapter, false) AS deployed,
  CASE WHEN f.run_id IS NOT NULL AND f.has_adapter THEN TIMESTAMP '2024-02-01 00:00:00' END AS deployed_at
FROM req q LEFT JOIN fx_runs f ON q.model_line = f.model_line AND q.run_id = f.run_id""",
)
def q_c7(spark, sf_dir):
    runs = fx.fx_runs(spark, sf_dir)
    req = runs.groupBy("model_line").agg(F.min("run_id").alias("run_id")).unionByName(
        runs.groupBy("model_line").agg((F.max("run_id") + 1).alias("run_id"))
    )
    return CK.rollback(runs, req, NOW)


# ---------------------------------------------------------------- similarity

from chatloom.operators import similarity as J  # noqa: E402


@register(
    "j2_similar_topk",
    """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS nv FROM e),
p AS (SELECT a.id AS qid, b.id AS cid, floor(list_dot_product(a.v, b.v) / (a.nv * b.nv) * CAST(1000000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000000.0 AS DOUBLE) AS similarity FROM n a, n b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, cid) AS rank FROM p)
SELECT qid, cid, floor(similarity * CAST(10000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000.0 AS DOUBLE) AS similarity, rank
FROM r WHERE rank <= 5""",
)
def q_j2(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = J.similar_topk(emb, emb, 5)
    return hits.select("qid", "cid", (F.floor(F.col("similarity") * 10000.0 + 0.5) / 10000.0).alias("similarity"), "rank")


def captured(spark, sf_dir):
    return P.capture_pipeline(fx.fx_turns(spark, sf_dir))


# The captured interactions as vectors: counts of hashed terms in 384 buckets, of length 1.
VECTORS_CTE = r"""captured AS (SELECT id, user_message, 'User: ' || user_message || chr(10) || 'Assistant: ' || assistant_response AS document FROM interactions),
buckets AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS bucket, count(*) AS n
            FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(document), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS t FROM captured) GROUP BY 1, 2),
norms AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS norm FROM buckets GROUP BY id),
vectors AS (
  SELECT c.id, any_value(c.user_message) AS user_message, any_value(c.document) AS document,
         list(CAST(coalesce(b.n / m.norm, 0) AS FLOAT) ORDER BY i.bucket) AS vec
  FROM captured c CROSS JOIN (SELECT unnest(range(384)) AS bucket) i
  LEFT JOIN buckets b ON b.id = c.id AND b.bucket = i.bucket LEFT JOIN norms m ON m.id = c.id GROUP BY c.id)"""


def _vectors_sql(select: str) -> str:
    ctes, body = ORACLE["p6_capture_pipeline"].split("SELECT CAST(conv_id AS VARCHAR) || '_'", 1)
    return f"{ctes.rstrip()}, interactions AS (SELECT CAST(conv_id AS VARCHAR) || '_'{body}), {VECTORS_CTE} {select}"


@register("j1_embed", _vectors_sql("""SELECT id, 384 AS dim,
  array_to_string(list_transform(vec, lambda x: CAST(floor(CAST(x AS DOUBLE) * CAST(1000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)), ' ') AS vector FROM vectors"""))
def q_j1(spark, sf_dir):
    emb = J.embed(captured(spark, sf_dir))
    millionths = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string"))
    return emb.select("id", F.size("embedding").alias("dim"), F.array_join(millionths, " ").alias("vector"))


@register("j3_context_prompts", _vectors_sql("""
, long AS (SELECT *, CAST(vec AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS nv FROM vectors),
pairs AS (SELECT a.id AS qid, b.id AS cid, b.document AS doc,
            floor(list_dot_product(a.v, b.v) / (a.nv * b.nv) * CAST(1000000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS similarity FROM long a, long b WHERE a.id <> b.id),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, cid) AS rank FROM pairs),
context AS (SELECT qid, string_agg(doc, chr(10) || chr(10) ORDER BY rank) AS text FROM best WHERE rank <= 3 GROUP BY qid)
SELECT id, CASE WHEN text IS NOT NULL THEN 'Context:' || chr(10) || text || chr(10) || chr(10) || 'User: ' || user_message ELSE user_message END AS prompt
FROM vectors LEFT JOIN context ON qid = id"""))
def q_j3(spark, sf_dir):
    inter = J.embed(captured(spark, sf_dir))
    return J.context_prompts(inter, inter, 3).select("id", "prompt")


# ---------------------------------------------------------------- requests and message content

from chatloom.functions import content as C  # noqa: E402
from chatloom.operators import requests as RQ  # noqa: E402

REQ_CTES = [S.fx_turns_cte(), S.fx_requests_cte()]
MESSAGES_SQL = "(SELECT request_id, generate_subscripts(messages, 1) - 1 AS position, unnest(messages) AS m FROM fx_requests)"


def requests_of(spark, sf_dir):
    return fx.fx_requests(spark, sf_dir)


@register(
    "s2_explode_messages",
    with_ctes(*REQ_CTES) + f"""SELECT request_id, position, m.role AS role, {S.n1_sql('m.content')} AS content FROM (
  SELECT request_id, generate_subscripts(messages, 1) - 1 AS position, unnest(messages) AS m FROM fx_requests)""",
)
def q_s2(spark, sf_dir):
    return RQ.explode_messages(requests_of(spark, sf_dir))


@register(
    "n1_normalize_content",
    with_ctes(*REQ_CTES) + f"SELECT request_id, position, {S.n1_sql('m.content')} AS text FROM {MESSAGES_SQL}",
)
def q_n1(spark, sf_dir):
    r = requests_of(spark, sf_dir).select("request_id", F.posexplode("messages").alias("position", "m"))
    return r.select("request_id", "position", C.normalize_content(F.col("m.content")).alias("text"))


@register(
    "n2_text_content",
    with_ctes(*REQ_CTES) + f"""SELECT request_id, position, {S.n2_sql('m.content')} AS text FROM (
  SELECT request_id, generate_subscripts(messages, 1) - 1 AS position, unnest(messages) AS m FROM fx_requests)""",
)
def q_n2(spark, sf_dir):
    r = requests_of(spark, sf_dir).select("request_id", F.posexplode("messages").alias("position", "m"))
    return r.select("request_id", "position", C.text_content(F.col("m.content")).alias("text"))


def _n3_sql() -> str:
    c = "m.content"
    text_item = (f"lambda e: CASE WHEN e IS NULL THEN 'None' WHEN json_type(e) <> 'OBJECT' THEN {S.astext('e')} "
                 "WHEN json_extract_string(e, '$.type') = 'text' THEN coalesce(json_extract_string(e, '$.text'), '') END")
    url = "coalesce(json_extract_string(e, '$.image_url.url'), '')"
    img_item = (f"lambda e: CASE WHEN json_type(e) = 'OBJECT' AND json_extract_string(e, '$.type') = 'image_url' THEN "
                f"CASE WHEN starts_with({url}, 'data:') AND contains({url}, ';base64,') THEN substring({url}, strpos({url}, ';base64,') + 8) "
                f"WHEN {url} <> '' THEN {url} END END")
    arr = f"from_json({c}, '[\"JSON\"]')"
    return with_ctes(*REQ_CTES) + f"""SELECT request_id, position,
  CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN array_to_string(list_transform({arr}, {text_item}), chr(10)) ELSE {S.n2_sql(c)} END AS text,
  CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN coalesce(array_to_string(list_transform({arr}, {img_item}), ','), '') ELSE '' END AS images
FROM {MESSAGES_SQL}"""


@register("n3_split_blocks_text_images", _n3_sql())
def q_n3(spark, sf_dir):
    r = requests_of(spark, sf_dir).select("request_id", F.posexplode("messages").alias("position", "m"))
    s = C.split_blocks_text_images(F.col("m.content"))
    return r.select("request_id", "position", s["text"].alias("text"), F.array_join(s["images"], ",").alias("images"))


def thinking_replies(spark, sf_dir) -> DataFrame:
    """Assistant turns of fx_turns; even conversations carry a <think> block around the first 20 characters."""
    t = fx.fx_turns(spark, sf_dir).where(F.col("role") == "assistant")
    raw = F.when(
        F.col("conv_id") % 2 == 0,
        F.concat(F.lit("<think> "), F.substring("text", 1, 20), F.lit(" </think>\n"), F.substring("text", 21, 1 << 30)),
    ).otherwise(F.col("text"))
    return t.select("conv_id", "turn", raw.alias("raw"))


THINK_CTE = """thinking AS (SELECT conv_id, turn,
  CASE WHEN conv_id % 2 = 0 THEN '<think> ' || substring(text, 1, 20) || ' </think>' || chr(10) || substring(text, 21) ELSE text END AS raw
  FROM fx_turns WHERE role = 'assistant')"""


@register(
    "n4_extract_thinking",
    with_ctes(S.fx_turns_cte(), THINK_CTE) + f"""SELECT conv_id, turn,
  CASE WHEN regexp_matches(raw, '(?s)<think>.*?</think>') THEN regexp_replace(regexp_extract(raw, '(?s)<think>(.*?)</think>(.*)', 1), '^{WS}+|{WS}+$', '', 'g') END AS thinking,
  CASE WHEN regexp_matches(raw, '(?s)<think>.*?</think>') THEN regexp_replace(regexp_extract(raw, '(?s)<think>(.*?)</think>(.*)', 2), '^{WS}+|{WS}+$', '', 'g') ELSE raw END AS content
FROM thinking""",
)
def q_n4(spark, sf_dir):
    r = thinking_replies(spark, sf_dir)
    x = C.extract_thinking(F.col("raw"))
    return r.select("conv_id", "turn", x["thinking"].alias("thinking"), x["content"].alias("content"))


TOOL_CALLS = '[{"function":{"arguments":"{}","name":"lookup"},"id":"c1","type":"function"}]'


def provider_replies(spark, sf_dir) -> DataFrame:
    """One provider reply body per assistant turn: conv_id % 3 = 0 ollama, 1 openai, 2 openai without choices;
    odd turns of the first two carry a tool call, and finish reasons and contents are also missing or null."""
    t = fx.fx_turns(spark, sf_dir).where(F.col("role") == "assistant")
    j = fx._json_str(F.col("text"))
    k = F.col("conv_id") % 3
    calls = F.when(F.col("turn") % 2 == 1, F.lit(f',"tool_calls":{TOOL_CALLS}')).otherwise(F.lit(""))
    n = F.col("conv_id") + F.col("turn")
    end = lambda key, value: F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit(f',"{key}":null')).otherwise(F.lit(f',"{key}":"{value}"'))
    said = F.when(n % 5 == 3, F.lit("null")).otherwise(j)
    body = (
        F.when(k == 0, F.concat(F.lit('{"message":{"content":'), said, F.lit(',"thinking":"t"'), calls, F.lit("}"), end("done_reason", "stop"), F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"choices":[{"message":{"content":'), j, F.lit(',"reasoning":"","thoughts":"th"'), calls, F.lit("}"), end("finish_reason", "length"), F.lit("}]}")))
        .otherwise(F.lit('{"error":"overloaded"}'))
    )
    return t.select("conv_id", "turn", F.when(k == 0, F.lit("ollama")).otherwise(F.lit("openai")).alias("provider"), body.alias("body"))


REPLIES_CTE = f"""replies AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'ollama' ELSE 'openai' END AS provider,
    CASE conv_id % 3
      WHEN 0 THEN '{{"message":{{"content":' || CASE WHEN (conv_id + turn) % 5 = 3 THEN 'null' ELSE to_json(text)::VARCHAR END || ',"thinking":"t"' || calls || '}}'
             || CASE (conv_id + turn) % 4 WHEN 0 THEN '' WHEN 1 THEN ',"done_reason":null' ELSE ',"done_reason":"stop"' END || '}}'
      WHEN 1 THEN '{{"choices":[{{"message":{{"content":' || to_json(text)::VARCHAR || ',"reasoning":"","thoughts":"th"' || calls || '}}' || CASE (conv_id + turn) % 4 WHEN 0 THEN '' WHEN 1 THEN ',"finish_reason":null' ELSE ',"finish_reason":"length"' END || '}}]}}'
      ELSE '{{"error":"overloaded"}}' END AS body
  FROM (SELECT *, CASE WHEN turn % 2 = 1 THEN ',"tool_calls":{TOOL_CALLS}' ELSE '' END AS calls FROM fx_turns) WHERE role = 'assistant')"""


@register(
    "n5_parse_reply",
    with_ctes(S.fx_turns_cte(), REPLIES_CTE) + """SELECT conv_id, turn,
  CASE WHEN provider = 'ollama'
       THEN CASE WHEN json_extract(body, '$.message') IS NOT NULL THEN CASE WHEN json_extract(body, '$.message.content') IS NULL THEN '' ELSE json_extract_string(body, '$.message.content') END ELSE '' END
       ELSE CASE WHEN json_extract(body, '$.choices[0]') IS NOT NULL THEN CASE WHEN json_extract(body, '$.choices[0].message.content') IS NULL THEN '' ELSE json_extract_string(body, '$.choices[0].message.content') END ELSE '' END
  END AS content,
  CASE WHEN provider = 'ollama'
       THEN CASE WHEN json_extract(body, '$.message') IS NOT NULL THEN json_extract_string(body, '$.message.thinking') END
       ELSE CASE WHEN json_extract(body, '$.choices[0]') IS NOT NULL THEN
            coalesce(nullif(json_extract_string(body, '$.choices[0].message.reasoning'), ''), json_extract_string(body, '$.choices[0].message.thoughts')) END
  END AS thinking,
  CASE WHEN provider = 'ollama'
       THEN CASE WHEN json_extract(body, '$.message') IS NOT NULL THEN CASE WHEN json_extract(body, '$.done_reason') IS NULL THEN 'stop' ELSE json_extract_string(body, '$.done_reason') END ELSE 'error' END
       ELSE CASE WHEN json_extract(body, '$.choices[0]') IS NOT NULL THEN CASE WHEN json_extract(body, '$.choices[0].finish_reason') IS NULL THEN 'stop' ELSE json_extract_string(body, '$.choices[0].finish_reason') END ELSE 'error' END
  END AS finish_reason,
  CASE WHEN provider = 'ollama' THEN json_extract(body, '$.message.tool_calls')::VARCHAR
       ELSE json_extract(body, '$.choices[0].message.tool_calls')::VARCHAR END AS tool_calls
FROM replies""",
)
def q_n5(spark, sf_dir):
    r = provider_replies(spark, sf_dir)
    p = C.parse_reply(F.col("body"), F.col("provider"))
    return r.select("conv_id", "turn", p["content"].alias("content"), p["thinking"].alias("thinking"), p["finish_reason"].alias("finish_reason"), p["tool_calls"].alias("tool_calls"))


def _n6_sql() -> str:
    jl = "(CASE WHEN json_valid(line) THEN line END)"
    data = "substring(line, 7)"
    jd = f"(CASE WHEN json_valid({data}) THEN {data} END)"
    o_keep = f"(length(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')) > 0 AND json_valid(line) AND json_extract({jl}, '$.message') IS NOT NULL)"
    o_done = f"coalesce(CAST(json_extract({jl}, '$.done') AS BOOLEAN), false)"
    is_data = "starts_with(line, 'data: ')"
    is_end = f"({is_data} AND {data} = '[DONE]')"
    s_keep = f"({is_data} AND NOT {is_end} AND json_valid({data}))"
    delta = f"CASE WHEN provider = 'ollama' THEN json_extract_string({jl}, '$.message.content') ELSE json_extract_string({jd}, '$.choices[0].delta.content') END"
    return with_ctes(S.fx_turns_cte(), S.fx_chunks_cte()) + f"""SELECT request_id, seq,
  CASE WHEN provider = 'ollama' THEN coalesce({o_keep}, false) ELSE coalesce({s_keep}, false) END AS keep,
  CASE WHEN coalesce({delta}, '') <> '' THEN {delta} END AS delta,
  CASE WHEN provider = 'ollama' THEN CASE WHEN {o_keep} AND {o_done} THEN json_extract_string({jl}, '$.done_reason') END
       ELSE json_extract_string({jd}, '$.choices[0].finish_reason') END AS finish_reason,
  CASE WHEN provider = 'ollama' THEN coalesce({o_keep} AND {o_done}, false) ELSE false END AS done,
  CASE WHEN provider = 'ollama' THEN false ELSE {is_end} END AS "end"
FROM fx_chunks"""


@register("n6_parse_stream_line", _n6_sql())
def q_n6(spark, sf_dir):
    from chatloom.streaming.jobs import parsed_chunks

    return parsed_chunks(fx.fx_chunks(spark, sf_dir))


def _n7_sql() -> str:
    inner = _n6_sql()[len("WITH "):]
    ctes, sel = inner.split("\nSELECT ", 1)
    return f"""WITH {ctes}, parsed AS (SELECT {sel}),
ended AS (SELECT request_id, min(seq) AS _end FROM parsed WHERE "end" GROUP BY request_id),
kept AS (SELECT p.* FROM parsed p LEFT JOIN ended e ON p.request_id = e.request_id WHERE keep AND (e._end IS NULL OR p.seq < e._end))
SELECT request_id, coalesce(string_agg(delta, '' ORDER BY seq), '') AS content,
  coalesce(arg_max(finish_reason, seq) FILTER (WHERE finish_reason <> ''), 'stop') AS finish_reason, bool_or(done) AS done
FROM kept GROUP BY request_id"""


@register("n7_reassemble_reply", _n7_sql())
def q_n7(spark, sf_dir):
    from chatloom.streaming.jobs import reassemble_reply

    return reassemble_reply(fx.fx_chunks(spark, sf_dir))


def _wc_sql(c: str) -> str:
    toks = f"list_filter(regexp_split_to_array(regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+'), lambda t: t <> '')"
    return f"(CASE WHEN coalesce(length({c}), 0) = 0 THEN 0 ELSE len({toks}) END)"


@register(
    "n8_token_usage",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + f"""SELECT conv_id, turn, {_wc_sql('user_message')} AS prompt_tokens,
  {_wc_sql('assistant_response')} AS completion_tokens,
  CASE WHEN coalesce(length(user_message), 0) > 0 AND coalesce(length(assistant_response), 0) > 0
       THEN {_wc_sql('user_message')} + {_wc_sql('assistant_response')} ELSE 0 END AS total_tokens FROM fx_pairs""",
)
def q_n8(spark, sf_dir):
    u = C.token_usage(F.col("user_message"), F.col("assistant_response"))
    return P.pair_turns(fx.fx_turns(spark, sf_dir)).select(
        "conv_id", "turn", u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"),
        u["total_tokens"].alias("total_tokens"),
    )


@register("n9_normalize_model", with_ctes(*REQ_CTES) + "SELECT request_id, split_part(model, ':', 1) AS model FROM fx_requests")
def q_n9(spark, sf_dir):
    return requests_of(spark, sf_dir).select("request_id", C.normalize_model(F.col("model")).alias("model"))


@register(
    "n10_flag_invalid_requests",
    with_ctes(*REQ_CTES) + """SELECT request_id, array_to_string(list_filter([
    CASE WHEN split_part(model, ':', 1) NOT IN ('chatloom-model', 'local-llm') THEN 'unknown_model' END,
    CASE WHEN n NOT IN (0, 1) THEN 'n_not_1' END,
    CASE WHEN len(list_filter(messages, lambda m: m.role = 'user')) = 0 THEN 'no_user_message' END,
    CASE WHEN temperature < 0 OR temperature > 2 THEN 'bad_temperature' END,
    CASE WHEN top_p < 0 OR top_p > 1 THEN 'bad_top_p' END,
    CASE WHEN max_tokens < 1 THEN 'bad_max_tokens' END,
    CASE WHEN presence_penalty < -2 OR presence_penalty > 2 THEN 'bad_presence_penalty' END,
    CASE WHEN frequency_penalty < -2 OR frequency_penalty > 2 THEN 'bad_frequency_penalty' END,
    CASE WHEN top_logprobs < 0 OR top_logprobs > 20 THEN 'bad_top_logprobs' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM fx_requests""",
)
def q_n10(spark, sf_dir):
    f = RQ.flag_invalid_requests(requests_of(spark, sf_dir), "chatloom-model")
    return f.select("request_id", F.array_join("reasons", ",").alias("reasons"))


@register(
    "p1_latest_pair",
    with_ctes(*REQ_CTES) + f"""SELECT request_id,
  {S.p1_user_sql()} AS user_message,
  {S.p1_assistant_sql()} AS previous_assistant
FROM fx_requests""",
)
def q_p1(spark, sf_dir):
    return P.latest_pair(requests_of(spark, sf_dir)).select("request_id", "user_message", "previous_assistant")


def _gated_requests_sql(path: str) -> str:
    """The stored pairs of the request log, by the rules of the two capture paths."""
    if path == "api":
        text = f"coalesce({S.p1_user_sql()}, '')"
        where = """len(list_filter(messages, lambda m: m.role = 'user')) > 0
      AND (model IS NULL OR split_part(model, ':', 1) IN ('chatloom-model', 'local-llm')) AND n IN (0, 1)
      AND temperature BETWEEN 0 AND 2 AND top_p BETWEEN 0 AND 1 AND max_tokens >= 1
      AND coalesce(presence_penalty, 0) BETWEEN -2 AND 2 AND coalesce(frequency_penalty, 0) BETWEEN -2 AND 2
      AND coalesce(top_logprobs, 0) BETWEEN 0 AND 20"""
        gate = "finish_reason = 'stop' AND r.content <> ''"
    else:
        shown = f"lambda m: m.role = 'user' AND NOT regexp_matches({S.n2_sql('m.content')}, '^{WS}*###')"
        text = f"regexp_replace({S.n2_sql(f'list_filter(messages, {shown})[-1].content')}, '^{WS}+|{WS}+$', '', 'g')"
        where = "split_part(model, ':', 1) = 'chatloom-model'"
        gate = "r.done AND length(user_message) > 0"
    return f"""paired AS (SELECT request_id, conversation_id AS conv_id, "timestamp" AS ts, false AS is_refusal,
    {text} AS user_message, {S.p1_assistant_sql()} AS assistant_response FROM fx_requests WHERE {where}),
gated AS (SELECT p.* FROM paired p JOIN fx_request_replies r ON r.request_id = p.request_id
    WHERE length(assistant_response) > 0 AND {gate})"""


def request_replies(spark, sf_dir):
    return P.parsed_replies(fx.fx_request_replies(spark, sf_dir))


GATE_SQL = with_ctes(*REQ_CTES, S.fx_request_replies_cte(), _gated_requests_sql("api")) + "SELECT request_id, user_message, assistant_response AS previous_assistant FROM gated"


@register("p4_request_gate", GATE_SQL)
def q_p4r(spark, sf_dir):
    valid = RQ.flag_invalid_requests(requests_of(spark, sf_dir), "chatloom-model").where(F.size("reasons") == 0)
    pairs = P.latest_pair(valid).withColumn("user_message", F.coalesce("user_message", F.lit("")))
    return P.gate_requests(pairs, request_replies(spark, sf_dir)).select("request_id", "user_message", "previous_assistant")


def _p6_api_sql() -> str:
    body, _ = _rules_sql("(SELECT *, user_message AS text, 'user' AS role FROM gated)")
    ruled = f"ruled AS (SELECT * EXCLUDE (text, role) REPLACE (text AS user_message) FROM {body})"
    return with_ctes(*REQ_CTES, S.fx_request_replies_cte(), _gated_requests_sql("api"), ruled) + _interaction_sql_from("ruled")


@register("p6_capture_requests_api", _p6_api_sql())
def q_p6_api(spark, sf_dir):
    rules = R.compile_rules(DEMO_RULES, spark)
    return P.capture_requests(requests_of(spark, sf_dir), request_replies(spark, sf_dir), "api", rules, "chatloom-model").drop("document")


@register(
    "p6_capture_requests_proxy",
    with_ctes(*REQ_CTES, S.fx_request_replies_cte(), _gated_requests_sql("proxy")) + _interaction_sql_from("gated"),
)
def q_p6_proxy(spark, sf_dir):
    return P.capture_requests(requests_of(spark, sf_dir), request_replies(spark, sf_dir), "proxy", models=["chatloom-model:latest"]).drop("document")


@register(
    "p5_whitelist_models",
    with_ctes(*REQ_CTES) + "SELECT request_id, model FROM fx_requests WHERE split_part(model, ':', 1) IN ('chatloom-model')",
)
def q_p5(spark, sf_dir):
    return P.whitelist_models(requests_of(spark, sf_dir), ["chatloom-model:latest"]).select("request_id", "model")


@register(
    "i16_recent_requests",
    with_ctes(*REQ_CTES) + "SELECT request_id, conversation_id, \"timestamp\", model FROM fx_requests ORDER BY \"timestamp\" DESC, request_id DESC LIMIT 50",
)
def q_i16(spark, sf_dir):
    return I.recent_requests(requests_of(spark, sf_dir), 50).select("request_id", "conversation_id", "timestamp", "model")


# ---------------------------------------------------------------- streaming (stream == batch)

from chatloom.sources import io as IO  # noqa: E402
from chatloom.streaming import jobs as T  # noqa: E402


def _streamed(spark, df, order, job, name, closing=None, **options):
    """``job`` over ``df`` arriving in three parts, ascending by ``order``."""
    T.enable_state_store(spark)
    stream, feeds = IO.sliced_stream(df, order, closing=closing)
    return T.run_available_now(job(stream), name, feeds=feeds, **options)


def _shuffled(df, minutes):
    """``df`` with ``arrival``: its event time, up to so many minutes later (an arrival out of order)."""
    delay = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(minutes * 60)).cast("int")
    return df.withColumn("arrival", F.timestamp_add("SECOND", delay, F.col("ts")))


@register("t2_stream_pair", ORACLE["p2_pair_turns"])
def q_t2(spark, sf_dir):
    turns = _shuffled(fx.fx_turns(spark, sf_dir), 50)  # within the hour that the stream waits
    return _streamed(spark, turns, "arrival", T.stream_pair, "t2", IO.closing_row(turns, "ts", dt.timedelta(days=40)))


@register("t3_stream_reassemble", ORACLE["n7_reassemble_reply"])
def q_t3(spark, sf_dir):
    chunks = fx.fx_chunks(spark, sf_dir)
    return _streamed(spark, chunks, "ts", T.stream_reassemble, "t3", IO.closing_row(chunks, "ts", dt.timedelta(days=2)))


T4_SQL = with_ctes(FXI) + """SELECT date_trunc('day', "timestamp") AS window_start, date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end,
  count(*) AS interactions, count(*) FILTER (WHERE sentiment > 0.3) AS positive, count(*) FILTER (WHERE sentiment < -0.3) AS negative,
  count(*) FILTER (WHERE abs(sentiment) <= 0.3) AS neutral, count(*) FILTER (WHERE is_golden) AS golden,
  count(*) FILTER (WHERE is_refusal) AS refusal
FROM fx_interactions GROUP BY 1, 2"""


@register("t4_window_stats", T4_SQL)
def q_t4b(spark, sf_dir):
    return T.window_stats(fxi(spark, sf_dir), "1 day")


@register("t4_stream_stats", T4_SQL)
def q_t4(spark, sf_dir):
    return _streamed(spark, fxi(spark, sf_dir), "timestamp", lambda x: T.stream_stats(x, "1 day", "1 hour"), "t4",
                     mode="update", keys=["window_start"])


T5_SQL = "WITH RECURSIVE " + FXI + """,
r AS (SELECT model_line, "timestamp", id, row_number() OVER (PARTITION BY model_line ORDER BY "timestamp", id) AS rn,
        (CASE WHEN sentiment < -0.3 THEN 1 ELSE 0 END) + (CASE WHEN is_refusal THEN 1 ELSE 0 END) AS dinc,
        (CASE WHEN sentiment > 0.3 THEN 1 ELSE 0 END) + (CASE WHEN is_golden THEN 1 ELSE 0 END) AS pinc FROM fx_interactions),
f AS (
  SELECT model_line, rn, "timestamp", id, dinc AS d, pinc AS p FROM r WHERE rn = 1
  UNION ALL
  SELECT r.model_line, r.rn, r."timestamp", r.id,
         (CASE WHEN f.d >= 5 THEN 0 ELSE f.d END) + r.dinc,
         (CASE WHEN f.d >= 5 OR f.p >= 20 THEN 0 ELSE f.p END) + r.pinc
  FROM f JOIN r ON r.model_line = f.model_line AND r.rn = f.rn + 1)
SELECT model_line, "timestamp", id, CASE WHEN d >= 5 THEN 'dpo' ELSE 'sft' END AS mode,
  CASE WHEN d >= 5 THEN CAST(d AS VARCHAR) || '_dpo_signals' ELSE CAST(p AS VARCHAR) || '_positive_examples' END AS reason
FROM f WHERE d >= 5 OR p >= 20"""


@register("t5_trigger_points", T5_SQL)
def q_t5b(spark, sf_dir):
    return T.trigger_points(fxi(spark, sf_dir))


@register("t5_stream_triggers", T5_SQL)
def q_t5(spark, sf_dir):
    return _streamed(spark, fxi(spark, sf_dir), "timestamp", lambda x: x, "t5", batch_job=T.trigger_batch(), schema=T.TRIGGER_SCHEMA)


T6_SQL = """WITH RECURSIVE
e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 8 HOUR THEN 1 ELSE 0 END AS brk
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s1 AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
sess AS (SELECT user_id, max(ts) AS session_end, count(*) AS events FROM s1 GROUP BY user_id, sid),
done AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_end) AS rn FROM sess
         WHERE session_end + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events)),
f AS (SELECT user_id, rn, session_end, events AS c FROM done WHERE rn = 1
      UNION ALL
      SELECT d.user_id, d.rn, d.session_end, (CASE WHEN f.c >= 10 THEN 0 ELSE f.c END) + d.events
      FROM f JOIN done d ON d.user_id = f.user_id AND d.rn = f.rn + 1)
SELECT user_id, session_end AS idle_from, c AS events FROM f WHERE c >= 10"""


@register("t6_idle_points", T6_SQL)
def q_t6b(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    latest = ev.agg(F.max("ts")).first()[0]
    return T.idle_points(ev, 8.0, 10, now=latest)


@register("t6_stream_inactivity", T6_SQL)
def q_t6(spark, sf_dir):
    return _streamed(spark, read_table(spark, sf_dir, "events"), "ts", lambda x: T.stream_inactivity(x, 8.0, 10), "t6")


def _t1_sql() -> str:
    src = f"""(SELECT conversation_id, "timestamp",
        {S.p1_user_sql()} AS user_message, {S.p1_assistant_sql()} AS previous_assistant
      FROM fx_requests)"""
    gated = f"(SELECT * FROM {src} WHERE user_message IS NOT NULL AND length(coalesce(previous_assistant, '')) > 0)"
    return with_ctes(*REQ_CTES) + f"""SELECT conversation_id || '_' || CAST(epoch_us("timestamp") AS VARCHAR) AS id,
  conversation_id, "timestamp",
  CASE WHEN length(user_message) > 60000 THEN substring(user_message, 1, 60000) || '...[TRUNCATED]' ELSE user_message END AS user_message,
  CASE WHEN length(previous_assistant) > 60000 THEN substring(previous_assistant, 1, 60000) || '...[TRUNCATED]' ELSE previous_assistant END AS assistant_response,
  CAST(length(user_message) AS INTEGER) AS user_message_length, CAST(length(previous_assistant) AS INTEGER) AS assistant_response_length,
  sentiment, weight, is_golden, false AS is_refusal,
  length(user_message) > 60000 OR length(previous_assistant) > 60000 AS truncated
FROM {S.score_sql(gated)}"""


@register("t1_stream_score", _t1_sql())
def q_t1(spark, sf_dir):
    path = IO.scratch_path(spark, "request-log")
    IO.write_request_log(fx.fx_requests(spark, sf_dir).repartition(3, "request_id"), path)
    stream = IO.read_requests(spark, path, stream=True, files_per_trigger=1)
    return T.run_available_now(T.stream_score(stream), "t1").drop("document")


# ---------------------------------------------------------------- sources and sinks (round trips)


@register("s1_read_requests", ORACLE["s2_explode_messages"])
def q_s1(spark, sf_dir):
    path = IO.scratch_path(spark, "request-log")
    IO.write_request_log(fx.fx_requests(spark, sf_dir), path)
    return RQ.explode_messages(IO.read_requests(spark, path))


def doc_lines(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("log_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


DOC_LINES_SQL = "SELECT doc_id AS log_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
LOG_LINES_SQL = """SELECT k0 AS log_id, no AS line_no, CASE
    WHEN no = 0 AND k = 0 THEN 'CPU TRAINING MODE ENABLED' WHEN no = 0 AND k < 3 THEN 'Loading base model'
    WHEN no = 1 AND k = 1 THEN 'Using 8-bit quantization'
    WHEN no = 5 AND k < 3 THEN '  PASS ' || (k + 1) || '/4: Training layers ' || (k * 5) || '-' || (k * 5 + 4)
    WHEN no = 7 THEN 'Epoch ' || (k + 1) || '/5' WHEN no = 9 THEN '2024-01-05 10:00:09 started'
    WHEN no = 20 THEN 'PASS 4/4: Training layers 15-19, 2024-01-05 11:00:00'
    WHEN no % 7 = 0 THEN '  loss after step ' || event_id || '  ' WHEN no % 11 = 3 THEN 'Merging adapter'
    ELSE event_type || ' ' || props END AS line
  FROM (SELECT *, event_id // 60 AS k0, event_id % 60 AS no, (event_id // 60) % 4 AS k FROM events)"""


def _s5_sql(lines: str) -> str:
    kw = " OR ".join(f"contains(line, {S.q(k)})" for k in IO.LOG_KEYWORDS)
    pass_rx = r"PASS (\d+)/(\d+): Training layers (\d+)-(\d+)"
    epoch_rx = r"Epoch (\d+)/(\d+)"
    ts_rx = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
    return f"""WITH lines AS (
  {lines}),
f AS (SELECT log_id,
    bool_or(contains(line, 'CPU TRAINING MODE ENABLED')) AS _cpu, bool_or(contains(line, 'Loading base model')) AS _load,
    bool_or(contains(line, '8-bit quantization')) AS _8bit,
    arg_min(line, line_no) FILTER (WHERE regexp_matches(line, '{pass_rx}')) AS _pass,
    arg_min(line, line_no) FILTER (WHERE regexp_matches(line, '{epoch_rx}')) AS _epoch,
    arg_min(line, line_no) FILTER (WHERE regexp_matches(line, '{ts_rx}')) AS _ts
  FROM lines GROUP BY log_id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) AS rr FROM lines) WHERE rr <= 50 AND ({kw})),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) AS hh FROM r) WHERE hh <= 10),
g AS (SELECT log_id, string_agg(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g'), chr(10) ORDER BY line_no) AS logs FROM h GROUP BY log_id)
SELECT f.log_id,
  CASE WHEN _cpu THEN 'CPU' WHEN _load AND _8bit THEN 'GPU (8-bit)' END AS training_mode,
  CAST(regexp_extract(_pass, '{pass_rx}', 1) AS INTEGER) AS current_pass, CAST(regexp_extract(_pass, '{pass_rx}', 2) AS INTEGER) AS total_passes,
  CASE WHEN _pass IS NOT NULL THEN regexp_extract(_pass, '{pass_rx}', 3) || '-' || regexp_extract(_pass, '{pass_rx}', 4) END AS current_layers,
  CAST(regexp_extract(_epoch, '{epoch_rx}', 1) AS INTEGER) AS current_epoch, CAST(regexp_extract(_epoch, '{epoch_rx}', 2) AS INTEGER) AS total_epochs,
  CASE WHEN _ts IS NOT NULL THEN regexp_extract(_ts, '{ts_rx}', 1) END AS last_log_time,
  coalesce(g.logs, '') AS logs
FROM f LEFT JOIN g ON f.log_id = g.log_id"""


@register("s5_scan_training_logs", _s5_sql(LOG_LINES_SQL))
def q_s5(spark, sf_dir):
    return IO.scan_training_logs(fx.fx_log_lines(spark, sf_dir)).withColumn("logs", F.array_join("logs", "\n"))


@register("s5_scan_document_lines", _s5_sql(DOC_LINES_SQL))
def q_s5d(spark, sf_dir):
    """The same scan over texts that are no logs: nothing but stray keyword lines is found."""
    return IO.scan_training_logs(doc_lines(spark, sf_dir)).withColumn("logs", F.array_join("logs", "\n"))


@register(
    "s3_read_checkpoints",
    """SELECT 'ck_' || s_suppkey AS checkpoint_id, '/adapters/' || s_suppkey AS adapter_path,
  '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' AS "timestamp", s_suppkey / 4.0::DOUBLE AS perplexity,
  s_suppkey AS training_samples, s_suppkey % 2 = 0 AS can_rollback, s_suppkey % 7 = 0 AS deployed
FROM supplier WHERE s_suppkey % 5 <> 4""",
)
def q_s3(spark, sf_dir):
    path = IO.scratch_path(spark, "checkpoints")
    IO.write_files(fx.fx_checkpoint_files(spark, sf_dir), path)
    return IO.read_checkpoints(spark, path).select(
        "checkpoint_id", "adapter_path", "timestamp", F.col("metrics")["perplexity"].alias("perplexity"),
        "training_samples", "can_rollback", "deployed")


RUN_DAY_SQL = "'2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad((s_suppkey % 24)::VARCHAR, 2, '0')"


def _s4_sql() -> str:
    def rows(minute, extra, name, where, evaluated="NULL", runtime="NULL", step="NULL"):
        return (f"SELECT {RUN_DAY_SQL} || ':{minute}:00' AS \"timestamp\", (s_suppkey + {extra}) / 4.0::DOUBLE AS train_loss, "
                f"coalesce({evaluated}::DOUBLE, (s_suppkey + {extra}) / 8.0::DOUBLE) AS eval_loss, s_suppkey + 100 AS train_samples, "
                f"s_suppkey % 10 AS val_samples, 3.0::DOUBLE AS epochs, 'run_' || s_suppkey{name} AS checkpoint_name, "
                f"{runtime}::DOUBLE AS eval_runtime, {step}::BIGINT AS global_step FROM supplier WHERE {where}")
    return " UNION ALL ".join([
        rows("00", 0, "", "s_suppkey % 3 <> 0", step="(CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN 5 END)"),
        rows("10", 1, " || ' - Pass 1 (Layers 0-4)'", "s_suppkey % 3 = 0"),
        rows("30", 2, " || ' - Pass 2 (Layers 5-9)'", "s_suppkey % 3 = 0", *(f"(CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN {x} END)" for x in ("0.25", "2.5", "12"))),
    ])


def run_files(spark, sf_dir) -> str:
    path = IO.scratch_path(spark, "runs")
    IO.write_files(fx.fx_run_files(spark, sf_dir), path)
    return path


@register("s4_read_training_history", _s4_sql())
def q_s4(spark, sf_dir):
    return IO.read_training_history(spark, run_files(spark, sf_dir))


@register(
    "c6_training_progress",
    f"""WITH latest AS (SELECT *, {RUN_DAY_SQL} AS day, s_suppkey % 2 = 0 AS even, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS stated FROM supplier WHERE s_suppkey % 3 = 0
  ORDER BY {RUN_DAY_SQL} DESC, 'run_' || s_suppkey DESC LIMIT 1)
SELECT 'run_' || s_suppkey AS checkpoint_id, p AS pass_number, CASE p WHEN 1 THEN '0-4' ELSE '5-9' END AS layers,
  (s_suppkey + p) / 4.0::DOUBLE AS train_loss, s_suppkey + 100 AS train_samples, s_suppkey % 10 AS val_samples, 3.0::DOUBLE AS epochs,
  day || CASE p WHEN 1 THEN ':10:00' ELSE ':30:00' END AS "timestamp",
  CASE WHEN p = 2 AND stated THEN 3.0::DOUBLE END AS epoch, CASE WHEN p = 2 AND stated THEN 12 END AS global_step, CASE WHEN p = 2 AND stated THEN 40 END AS max_steps,
  CASE WHEN p = 2 AND stated THEN 0.25::DOUBLE END AS eval_loss, CASE WHEN p = 2 AND stated THEN 2.5::DOUBLE END AS eval_runtime,
  CASE WHEN even THEN 3 ELSE 2 END AS total_passes, true AS training_active, 2 AS current_pass, NOT (even AND p = 2) AS completed
FROM latest, (VALUES (1), (2)) AS passes(p)""",
)
def q_c6(spark, sf_dir):
    """Progress of the newest run, seen five minutes after its last reported pass."""
    from chatloom.operators import checkpoints as CK

    meta, states, dirs = IO.read_pass_tree(spark, run_files(spark, sf_dir))
    seen = dt.datetime.fromisoformat(meta.agg(F.max("timestamp")).first()[0]) + dt.timedelta(minutes=5)
    return CK.training_progress(meta, states, dirs, seen)


@register(
    "s6_write_interactions",
    with_ctes(S.fx_turns_cte(), _gated_pairs_sql()) + _interaction_sql_from("gated", 'CAST(ts AS DATE) AS "date", '),
)
def q_s6(spark, sf_dir):
    path = IO.scratch_path(spark, "interactions")
    IO.write_interactions(P.capture_pipeline(fx.fx_turns(spark, sf_dir)).drop("document"), path)
    return spark.read.parquet(path)


@register("s7_export_training_set", ORACLE["d10_format_sft"])
def q_s7(spark, sf_dir):
    path = IO.scratch_path(spark, "sft-export")
    IO.export_training_set(DS.format_sft(sft_set(spark, sf_dir)), path)
    return spark.read.schema("prompt string, completion string, weight double").json(path)


@register("s7_export_preferences", ORACLE["d11_format_dpo"])
def q_s7_dpo(spark, sf_dir):
    path = IO.scratch_path(spark, "dpo-export")
    IO.export_training_set(DS.format_dpo(dpo_set(spark, sf_dir)), path)
    return spark.read.schema("prompt string, chosen string, rejected string").json(path)


# ---------------------------------------------------------------- signals, pluggable model steps, schedule

from chatloom.operators import batchfn as BF  # noqa: E402


@register(
    "e3_sentiment_signals",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + f"""SELECT conv_id, turn,
  CASE WHEN _sn > 0 THEN 'strong_negative(' || _sn || ')' WHEN _sp > 0 THEN 'strong_positive(' || _sp || ')'
  ELSE array_to_string(list_filter([
    CASE WHEN _mn > _mp THEN 'moderate_negative(' || _mn || ')' WHEN _mp > _mn THEN 'moderate_positive(' || _mp || ')' END,
    CASE WHEN _len < 10 AND _cont THEN 'very_short' END,
    CASE WHEN _q > 2 THEN 'many_questions(' || _q || ')' END,
    CASE WHEN _e > 0 THEN (CASE WHEN _s2 >= 0 THEN 'enthusiastic' ELSE 'frustrated' END) END,
    CASE WHEN _in > 0 THEN 'instruction(' || _in || ')' END,
    CASE WHEN _cont AND _s4 = 0 THEN 'continuation' END], lambda x: x IS NOT NULL), ',') END AS signals
FROM {S.score_sql('fx_pairs', keep_steps=True)}""",
)
def q_e3(spark, sf_dir):
    s = scoring.score(P.pair_turns(fx.fx_turns(spark, sf_dir)), "user_message", with_signals=True)
    return s.select("conv_id", "turn", F.array_join("signals", ",").alias("signals"))


@register(
    "e4_parse_score_reply",
    """SELECT event_id, CASE WHEN event_id % 16 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CASE event_id % 8
    WHEN 0 THEN least(n, CAST(1.0 AS DOUBLE)) WHEN 1 THEN greatest(CAST(0.0 AS DOUBLE) - n, CAST(-1.0 AS DOUBLE)) WHEN 2 THEN least(n, CAST(1.0 AS DOUBLE))
    WHEN 5 THEN CAST(event_id % 2 AS DOUBLE) WHEN 6 THEN CAST(5.0 AS DOUBLE) - 4.0 WHEN 7 THEN CAST(-0.25 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END AS score
FROM (SELECT event_id, CAST((event_id % 3) || '.' || lpad((event_id % 100)::VARCHAR, 2, '0') AS DOUBLE) AS n FROM events)""",
)
def q_e4(spark, sf_dir):
    r = fx.fx_score_replies(spark, sf_dir)
    return r.select("event_id", scoring.parse_score_reply(F.col("reply"), F.col("status")).alias("score"))


@register(
    "e5_model_sentiment",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + """SELECT conv_id, turn,
  greatest(CAST(-1.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), (length(t) - length(replace(t, '!', '')) - (length(t) - length(replace(t, '?', '')))) / CAST(10.0 AS DOUBLE))) AS model_sentiment
FROM (SELECT conv_id, turn, substring(user_message, 1, 500) AS t FROM fx_pairs)""",
)
def q_e5(spark, sf_dir):
    pairs = P.pair_turns(fx.fx_turns(spark, sf_dir))
    return BF.model_sentiment(pairs).select("conv_id", "turn", "model_sentiment")


@register(
    "d7_generate_rejections",
    ORACLE["d5_rejection_prompts"].replace("SELECT id, user_message AS prompt, 0 AS source_order", f"""SELECT DISTINCT prompt, 0 AS seq,
  regexp_replace('I would rather not go into that: ' || prompt, '{WS}+$', '') AS rejection FROM (SELECT id, user_message AS prompt, 0 AS source_order""", 1) + ")",
)
def q_d7(spark, sf_dir):
    pool, golden = pool_and_golden(spark, sf_dir)
    rejections, report = BF.generate_rejections(DS.rejection_prompts(pool, golden))
    return rejections


def _d13_sql() -> str:
    def ids(col):
        toks = f"list_filter(regexp_split_to_array(regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+'), lambda t: t <> '')"
        return f"list_transform({toks}, lambda t: (CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 31999) + 1)"

    body = DS.TEMPLATES["harmony"]
    pt = f"'{body[0]}' || prompt || '{body[1]}'"
    return with_ctes(*POOL_CTES, SFT_CTE) + f"""SELECT prompt, prompt_len, array_to_string(input_ids, ' ') AS input_ids,
  list_sum(attention_mask) AS attended, array_to_string(list_transform(input_ids, lambda x, i: CASE WHEN i <= prompt_len THEN -100 ELSE x END), ' ') AS labels
FROM (SELECT prompt, least(len({ids(pt)}), 128) AS prompt_len,
        list_resize({ids(pt + " || chosen || '" + body[2] + "'")}[1:256], 256, 0) AS input_ids,
        list_resize(list_transform({ids(pt + " || chosen || '" + body[2] + "'")}[1:256], lambda x: 1), 256, 0) AS attention_mask
      FROM sft WHERE chosen IS NOT NULL)"""


@register("d13_tokenize_with_mask", _d13_sql())
def q_d13(spark, sf_dir):
    ds = DS.render_chat(DS.format_sft(sft_set(spark, sf_dir)), "harmony")
    t = DS.tokenize_with_mask(ds, 256)
    return t.select(
        "prompt", "prompt_len", F.array_join("input_ids", " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attended"),
        F.array_join("labels", " ").alias("labels"),
    )


def _d13_custom_sql() -> str:
    head, mid, tail = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in DS.TEMPLATES["chatml"])
    pt = f"'{head}' || prompt || '{mid}'"
    return with_ctes(*POOL_CTES, SFT_CTE) + f"""SELECT prompt, prompt_len, 256 AS n_ids,
  array_to_string(list_transform(list_resize(ids, 256, 0), lambda x, i: CASE WHEN i <= prompt_len THEN -100 ELSE x END), ' ') AS labels
FROM (SELECT prompt, least(length({pt}), 128) AS prompt_len,
        list_transform(string_split(substring({pt} || chosen || '{tail}', 1, 256), ''), lambda c: unicode(c) + 1) AS ids
      FROM sft WHERE chosen IS NOT NULL)"""


@register("d13_tokenize_custom", _d13_custom_sql())
def q_d13c(spark, sf_dir):
    ds = DS.render_chat(DS.format_sft(sft_set(spark, sf_dir)), "chatml")
    t = BF.tokenize_with(ds, BF.char_tokenizer, 256)
    return t.select("prompt", "prompt_len", F.size("input_ids").alias("n_ids"), F.array_join("labels", " ").alias("labels"))


SCHEDULED = DEFAULT.__class__(schedule_enabled=True)


@register(
    "a7_in_schedule_window",
    """SELECT event_id, (CASE WHEN d > 720 THEN 1440 - d ELSE d END) <= CAST(60.0 AS DOUBLE) AS in_window FROM (
  SELECT event_id, abs((CAST(extract(hour FROM l) * 3600 + extract(minute FROM l) * 60 AS DOUBLE)
                        + extract(microsecond FROM l) / CAST(1000000.0 AS DOUBLE)) - CAST(3600.0 AS DOUBLE)) / CAST(60.0 AS DOUBLE) AS d
  FROM (SELECT event_id, timezone('America/New_York', ts AT TIME ZONE 'UTC') AS l FROM events))""",
)
def q_a7(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", A.in_schedule_window(F.col("ts"), SCHEDULED).alias("in_window"))


# ---------------------------------------------------------------- explicit weight / golden / size queries


@register(
    "e6_interaction_weight",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + f"SELECT conv_id, turn, weight FROM {S.score_sql('fx_pairs')}",
)
def q_e6(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("conv_id", "turn", "weight")


@register(
    "e7_is_golden",
    with_ctes(S.fx_turns_cte(), S.fx_pairs_cte()) + f"SELECT conv_id, turn, is_golden FROM {S.score_sql('fx_pairs')} WHERE is_golden",
)
def q_e7(spark, sf_dir):
    return scored_pairs(spark, sf_dir).where("is_golden").select("conv_id", "turn", "is_golden")


@register(
    "i13_prune_if_oversize",
    with_ctes(FXI)
    + f"""SELECT {INTERACTION_COLS}, CAST("timestamp" AS DATE) AS "date" FROM (
  SELECT *, row_number() OVER (ORDER BY coalesce(weight, 1.0), "timestamp", id) - 1 AS rk FROM fx_interactions WHERE NOT is_golden)
WHERE rk >= (SELECT CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) FROM fx_interactions WHERE NOT is_golden)
UNION ALL SELECT {INTERACTION_COLS}, CAST("timestamp" AS DATE) AS "date" FROM fx_interactions WHERE is_golden""",
)
def q_i13(spark, sf_dir):
    """Store the interactions (S6), measure the stored bytes (I13) and prune the lowest
    10 % because the store is over 90 % of a limit set just below its size."""
    from dataclasses import replace

    path = IO.scratch_path(spark, "store")
    IO.write_interactions(fxi(spark, sf_dir), path)
    size = I.dataset_size_gb(spark, path)
    cfg = replace(DEFAULT, max_size_gb=size / 0.95)
    pruned, kept = I.prune_if_oversize(spark, path, cfg)
    return kept


def _a6_sql() -> str:
    inner = _a1_sql("model_line", TS_LT, TS_LD)[len("WITH "):]
    fxi_part, select_part = inner.split("\nSELECT ", 1)
    sig = "(new_negative_since_dpo + new_refusals_since_dpo)"
    pos = "(new_positive + new_golden)"
    nl = "chr(10)"
    lines = [
        "printf('Total interactions: %d', total)",
        "printf('New interactions since last training: %d', new)",
        "printf('  └─ Positive: %d, Negative: %d, Neutral: %d, Golden: %d', new_positive, new_negative, new_neutral, new_golden)",
        "printf('Hours since last interaction: %.1f', hours_since_last)",
        "printf('Days since last training: %.1f', days_since_training)",
        "printf('Days since last DPO training: %.1f', days_since_dpo)",
        "printf('New negatives since DPO: %d', new_negative_since_dpo)",
        f"{nl} || 'Trigger Status:'",
        f"printf('%s %d/%d (%d negative + %d refusals)', CASE WHEN {sig} >= 5 THEN '✓ DPO threshold met:' ELSE '  DPO threshold:' END, {sig}, 5, new_negative_since_dpo, new_refusals_since_dpo)",
        f"printf('%s %d/%d positive/golden', CASE WHEN {pos} >= 20 THEN '✓ SFT threshold met:' ELSE '  SFT threshold:' END, {pos}, 20)",
        "CASE WHEN hours_since_last >= 8.0 THEN printf('✓ Inactivity threshold met: %.1fh/8h', hours_since_last) END",
    ]
    return f"""WITH {fxi_part}, st AS (SELECT {select_part})
SELECT model_line, array_to_string(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL), {nl}) AS status FROM st"""


ORACLE["a6_status_report"] = _a6_sql()


def _a1_state_sql() -> str:
    el = lambda a, b, unit: f"((epoch_us({a}) - epoch_us({b})) / {D(1000000.0)}) / {D(unit)}"
    return with_ctes(FXI, FXR) + f""", st AS (
  SELECT model_line, max(ts) AS lt, max(CASE WHEN mode = 'dpo' THEN ts END) AS ld FROM fx_runs GROUP BY model_line),
j AS (SELECT f.*, st.lt, st.ld,
        CASE WHEN st.lt IS NULL THEN true ELSE f."timestamp" > st.lt END AS is_new,
        CASE WHEN st.ld IS NULL THEN (CASE WHEN st.lt IS NULL THEN true ELSE f."timestamp" > st.lt END) ELSE f."timestamp" > st.ld END AS since_dpo
      FROM fx_interactions f LEFT JOIN st ON f.model_line = st.model_line)
SELECT model_line, count(*) AS total, count(*) FILTER (WHERE is_new) AS new,
  {el(TS_NOW, 'max("timestamp")', 3600.0)} AS hours_since_last,
  CASE WHEN max(lt) IS NULL THEN {D(999.0)} ELSE {el(TS_NOW, 'max(lt)', 86400.0)} END AS days_since_training,
  count(*) FILTER (WHERE is_new AND sentiment > 0.3) AS new_positive,
  count(*) FILTER (WHERE is_new AND sentiment < -0.3) AS new_negative,
  count(*) FILTER (WHERE is_new AND abs(sentiment) <= 0.3) AS new_neutral,
  count(*) FILTER (WHERE is_new AND is_golden) AS new_golden,
  count(*) FILTER (WHERE is_new AND is_refusal) AS new_refusal,
  count(*) FILTER (WHERE since_dpo AND sentiment < -0.3) AS new_negative_since_dpo,
  count(*) FILTER (WHERE since_dpo AND is_refusal) AS new_refusals_since_dpo,
  CASE WHEN max(ld) IS NULL THEN {D(999.0)} ELSE {el(TS_NOW, 'max(ld)', 86400.0)} END AS days_since_dpo
FROM j GROUP BY model_line"""


@register("a1_stats_from_run_state", _a1_state_sql())
def q_a1s(spark, sf_dir):
    """A8 over the run log gives each model line's training state; A1 then counts that
    line's interactions against its own state."""
    state = A.advance_training_state(fx.fx_runs(spark, sf_dir), ["model_line"])
    return A.training_stats_from_state(fxi(spark, sf_dir), state, NOW, ["model_line"])


# ---------------------------------------------------------------- operations written back to the stored table

from chatloom.operators import store as ST  # noqa: E402


def _written_back(spark, sf_dir, operation):
    """The interactions stored by date (S6), changed in place by ``operation(path, run id)`` twice, and read back."""
    path = IO.scratch_path(spark, "store")
    IO.write_interactions(fxi(spark, sf_dir), path)
    for _ in range(2):  # the second time the run is marked as done
        operation(path, "run-1")
    return ST.read_store(spark, path).drop("date")


@register("i6_store_updates", ORACLE["i6_apply_updates"])
def q_i6_store(spark, sf_dir):
    return _written_back(spark, sf_dir, lambda path, run: ST.store_updates(spark, path, run, event_updates(spark, sf_dir)))


@register("i7_store_toggles", ORACLE["i7_toggle_golden"])
def q_i7_store(spark, sf_dir):
    ids = read_table(spark, sf_dir, "events").where(F.col("value") > 300).select(F.col("event_id").cast("string"))
    return _written_back(spark, sf_dir, lambda path, run: ST.store_toggles(spark, path, run, ids))


@register("i8_store_golden_review", with_ctes(FXI) + """SELECT * REPLACE (is_golden AND (coalesce(weight, 1.0) >= 5.0 OR sentiment >= 0.7
        OR (abs(sentiment) >= 0.3 AND (contains(lower(user_message), 'from now on') OR contains(lower(user_message), 'going forward')
             OR contains(lower(user_message), 'in the future') OR contains(lower(user_message), 'always do')
             OR contains(lower(user_message), 'never do') OR contains(lower(user_message), 'remember to')))
        OR (sentiment < -0.6 AND length(user_message) > 300)) AS is_golden) FROM fx_interactions""")
def q_i8_store(spark, sf_dir):
    return _written_back(spark, sf_dir, lambda path, run: ST.store_golden_review(spark, path, run))


@register("i9_store_deletions", ORACLE["i9_delete_ids"])
def q_i9_store(spark, sf_dir):
    return _written_back(spark, sf_dir, lambda path, run: ST.store_deletions(spark, path, run, _error_ids(spark, sf_dir)))


@register("i10_store_prune_by_age", ORACLE["i10_prune_by_age"])
def q_i10_store(spark, sf_dir):
    return _written_back(spark, sf_dir, lambda path, run: ST.store_prune_by_age(spark, path, run, NOW, 20))


@register("i11_store_prune_by_weight", ORACLE["i11_prune_by_weight"])
def q_i11_store(spark, sf_dir):
    return _written_back(spark, sf_dir, lambda path, run: ST.store_prune_by_weight(spark, path, run, 0.5))


@register("i12_store_prune_lowest", ORACLE["i12_prune_lowest"])
def q_i12_store(spark, sf_dir):
    return _written_back(spark, sf_dir, lambda path, run: ST.store_prune_lowest(spark, path, run, 0.1))


@register("i13_store_prune_if_oversize", ORACLE["i12_prune_lowest"])
def q_i13_store(spark, sf_dir):
    """The store is over 90 % of a limit set just below its size."""
    from dataclasses import replace

    def prune(path, run):
        cfg = replace(DEFAULT, max_size_gb=I.dataset_size_gb(spark, path) / 0.95)
        ST.store_prune_if_oversize(spark, path, run, cfg)

    return _written_back(spark, sf_dir, prune)


# ---------------------------------------------------------------- rejection cache, daily summary

D5_PROMPTS = "SELECT DISTINCT prompt FROM (SELECT id, user_message AS prompt, 0 AS source_order"


def _cached_rejections_sql() -> str:
    """The newest fresh cached rejection of every prompt, else the generator's."""
    fresh = f"""fresh AS (SELECT prompt, arg_max(rejection, (cached_at, seq)) AS rejection FROM cleaned
  WHERE NOT (((epoch_us({TS_NOW}) - epoch_us(cached_at)) / {D(1000000.0)}) / {D(3600.0)} > {D(6.0)}) GROUP BY prompt)"""
    ctes, body = ORACLE["d5_rejection_prompts"].split("SELECT id, user_message AS prompt, 0 AS source_order", 1)
    _, replies = with_ctes(S.fx_replies_cte(), S.clean_rejections_cte()).split("WITH ", 1)
    return f"""{ctes.rstrip()}, {replies.rstrip()}, {fresh}
SELECT p.prompt, coalesce(f.rejection, regexp_replace('I would rather not go into that: ' || p.prompt, '{WS}+$', '')) AS rejection
FROM (SELECT DISTINCT prompt FROM (SELECT id, user_message AS prompt, 0 AS source_order{body}) ) p LEFT JOIN fresh f ON f.prompt = p.prompt"""


@register("d7_cached_rejections", _cached_rejections_sql())
def q_d7_cache(spark, sf_dir):
    """A cache of an earlier run, partly stale; the generator is asked for the rest, and a second run for nothing."""
    path = IO.scratch_path(spark, "rejections")
    cache = DS.clean_rejections(fx.fx_replies(spark, sf_dir)).select("prompt", "seq", "rejection", "cached_at")
    cache.write.parquet(f"{path}/run=earlier")
    prompts = DS.rejection_prompts(*pool_and_golden(spark, sf_dir))
    BF.cached_rejections(prompts, path, NOW, "first")
    return BF.cached_rejections(prompts, path, NOW, "second")[0]


from chatloom.operators import summary as SU  # noqa: E402


def _summarised(spark, sf_dir):
    """The interactions stored by date, and their daily summary kept by a stream that had them in three parts."""
    df, group = fxi(spark, sf_dir), ["model_line"]
    store, path, ck = (IO.scratch_path(spark, x) for x in ("store", "summary", "summary-ck"))
    IO.write_interactions(df, store)
    stream, feeds = IO.sliced_stream(df, "weight")  # every day is in every part
    for feed in feeds:
        feed()
        stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(SU.summary_sink(path, group)).start().awaitTermination()
    return SU.read_summary(spark, path, group, "model_line bigint"), ST.read_store(spark, store)


@register("a1_stats_from_summary", ORACLE["a1_training_stats"])
def q_a1_summary(spark, sf_dir):
    return SU.training_stats_from_summary(*_summarised(spark, sf_dir), NOW, LAST_TRAINING, LAST_DPO)


@register("a1_stats_from_summary_by_model", ORACLE["a1_training_stats_by_model"])
def q_a1_summary_model(spark, sf_dir):
    return SU.training_stats_from_summary(*_summarised(spark, sf_dir), NOW, LAST_TRAINING, LAST_DPO, ["model_line"])


@register("a2_distribution_from_summary", ORACLE["a2_sentiment_distribution"])
def q_a2_summary(spark, sf_dir):
    return SU.distribution_from_summary(_summarised(spark, sf_dir)[0], ["model_line"])


@register("a3_overview_from_summary", ORACLE["a3_store_overview"])
def q_a3_summary(spark, sf_dir):
    return SU.overview_from_summary(_summarised(spark, sf_dir)[0], 2.5)


# ---------------------------------------------------------------- similarity on terms

from chatloom.operators import term_search as TS  # noqa: E402

TERMS_CTE = r"""tokens AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents),
counts AS (SELECT id, term, count(*) AS n FROM tokens GROUP BY 1, 2),
docs AS (SELECT term, count(*) AS docs FROM counts GROUP BY term),
raw AS (SELECT id, term, n * ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0::DOUBLE) / (docs + 0.5::DOUBLE)) AS raw FROM counts JOIN docs USING (term)),
weights AS (SELECT id, term, raw / norm AS w FROM raw JOIN (SELECT id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY id) USING (id) WHERE raw > 0)"""


@register("j2_sparse_topk", f"""WITH {TERMS_CTE},
pairs AS (SELECT a.id AS qid, b.id AS cid, sum(a.w * b.w) AS s FROM weights a JOIN weights b ON a.term = b.term AND a.id <> b.id WHERE CAST(a.id AS BIGINT) % 20 = 0 GROUP BY 1, 2),
best AS (SELECT qid, cid, floor(s * 1000000000.0::DOUBLE + 0.5::DOUBLE) / 1000000000.0::DOUBLE AS s FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rank FROM best)
SELECT qid, cid, floor(s * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS similarity, rank FROM ranked WHERE rank <= 5""")
def q_j2_sparse(spark, sf_dir):
    """Every twentieth document against all of them."""
    weights = TS.term_weights(read_table(spark, sf_dir, "documents"), "text", "doc_id")
    hits = TS.sparse_topk(weights.where(F.col("id").cast("long") % 20 == 0), weights, 5)
    return hits.select("qid", "cid", (F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"), "rank")
