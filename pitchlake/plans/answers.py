"""Questions in words answered over the graph: intent and entities from the wording, facts by joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.plans.questions import BANK_SQL, KINDS, _facts_sql, bank, question_facts
from pitchlake.plans.registry import query
from pitchlake.session import materialize


def _pattern(template: str, ends: int) -> str:
    """Pattern of a wording: its places are groups, what stands between them is taken as it is."""
    parts = [re.sub(r"([.?*+()\[\]])", r"\\\1", p) for p in template.split("{}")]
    return "^" + "(.+)".join(parts[: ends + 1] if ends < len(parts) else parts) + "$"


#: (type, kind, pattern) of the wordings, narrower ones first: a club in a province is asked for in the words of a club.
WORDINGS = [(t, k, _pattern(KINDS[k][i], n)) for k in ("home_club", "club_province", *[x for x in KINDS if x not in ("home_club", "club_province")]) for t, i, n in (("YN", 2, 2), ("TF", 1, 2), ("MCQ", 3, 1))]
#: Confidence of an answer by whether the graph has the fact.
SURE, UNSURE = 0.95, 0.85
_WHICH = " ".join(f"WHEN regexp_matches(question, '{p}') THEN {i}" for i, (_, _, p) in enumerate(WORDINGS))


def _group_sql(n: int) -> str:
    return "CASE which " + " ".join(f"WHEN {i} THEN regexp_extract(question, '{p}', {n})" for i, (t, _, p) in enumerate(WORDINGS) if n == 1 or t != "MCQ") + " END"


def _of_sql(values: list[str]) -> str:
    return "CASE which " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_ANSWERS_SQL = f"""WITH b AS ({BANK_SQL}), w AS (SELECT *, CASE {_WHICH} END AS which FROM b), p AS (SELECT no, answer AS expected, choices, {_of_sql([t for t, _, _ in WORDINGS])} AS asked, {_of_sql([k for _, k, _ in WORDINGS])} AS intent, {_group_sql(1)} AS s, {_group_sql(2)} AS o FROM w WHERE which IS NOT NULL),
facts AS (SELECT DISTINCT kind, s, o FROM ({_facts_sql()})), x AS (SELECT *, unnest(CASE WHEN asked = 'MCQ' THEN choices ELSE [o] END) AS option FROM p),
h AS (SELECT x.no, x.expected, x.asked, x.intent, min(CASE WHEN f.s IS NOT NULL THEN x.option END) AS holds FROM x LEFT JOIN facts f ON f.kind = x.intent AND f.s = x.s AND f.o = x.option GROUP BY 1, 2, 3, 4)
SELECT no, intent, asked, CASE asked WHEN 'TF' THEN CASE WHEN holds IS NULL THEN 'false' ELSE 'true' END WHEN 'YN' THEN CASE WHEN holds IS NULL THEN 'no' ELSE 'yes' END ELSE coalesce(holds, '?') END AS given, expected, CASE WHEN holds IS NULL THEN {UNSURE} ELSE {SURE} END::DOUBLE AS confidence FROM h"""


@query("answered_questions", _ANSWERS_SQL)
def answered_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each question of the set answered from its wording: intent and entities by patterns, the fact looked up in the graph, the choice that holds."""
    facts = materialize(question_facts(spark, sf), "facts")
    asked = materialize(bank(facts), "bank")
    return answer(asked.select("no", "question", "choices", F.col("answer").alias("expected")), facts).select("no", "intent", "asked", "given", "expected", "confidence")


def answer(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(no, question, expected, intent, asked, given, confidence) of questions (no, question, choices, expected) of a known wording.

    ``facts`` has kind, s and o. Names are compared as they stand. Questions of no known wording are left out; a question
    about an unknown entity is answered in the negative, less surely. The questions are a set that a user asks, so they
    are sent to the facts.
    """
    wordings = F.array(*[F.struct(F.lit(a).alias("asked"), F.lit(k).alias("intent"), F.lit(p).alias("pattern")) for a, k, p in WORDINGS])
    q = questions.withColumn("w", F.get(F.filter(wordings, lambda w: F.regexp_like("question", w["pattern"])), F.lit(0))).filter("w IS NOT NULL")
    places = "regexp_extract(question, w.pattern, 1) AS s", "CASE WHEN w.asked <> 'MCQ' THEN regexp_extract(question, w.pattern, 2) END AS o"
    q = q.selectExpr("no", "question", "expected", "choices", "w.asked", "w.intent", *places)
    options = q.withColumn("option", F.explode(F.when(F.col("asked") == "MCQ", F.col("choices")).otherwise(F.array("o"))))
    known = facts.select(F.col("kind").alias("intent"), "s", F.col("o").alias("option")).join(F.broadcast(options.select("intent", "s", "option").distinct()), ["intent", "s", "option"], "left_semi").distinct()
    found = options.join(known.withColumn("there", F.lit(True)), ["intent", "s", "option"], "left")
    held = found.groupBy("no", "question", "expected", "intent", "asked").agg(F.min(F.when(F.col("there"), F.col("option"))).alias("holds"))
    yes = F.col("holds").isNotNull()
    given = F.when(F.col("asked") == "TF", F.when(yes, "true").otherwise("false")).when(F.col("asked") == "YN", F.when(yes, "yes").otherwise("no")).otherwise(F.coalesce("holds", F.lit("?")))
    return held.select("no", "question", "expected", "intent", "asked", given.alias("given"), F.when(yes, SURE).otherwise(UNSURE).alias("confidence"))


@query(
    "answer_accuracy",
    f"SELECT intent, asked, expected, count(*)::BIGINT AS n, round(avg((given = expected)::INT), 6) AS accuracy FROM (SELECT intent, asked, CASE WHEN asked = 'MCQ' THEN 'choice' ELSE expected END AS expected, given = expected AS ok, given, expected AS wanted FROM ({_ANSWERS_SQL})) GROUP BY GROUPING SETS ((intent), (asked), (expected), ())".replace("avg((given = expected)::INT)", "avg(ok::INT)"),
)
def answer_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the answers by intent, type of question, expected answer and in all."""
    from pitchlake.functions.text import answers_match
    from pitchlake.operators import stats

    a = answered_questions(spark, sf).withColumn("ok", answers_match(F.col("given"), F.col("expected")).cast("int"))
    a = a.withColumn("expected", F.when(F.col("asked") == "MCQ", "choice").otherwise(F.col("expected")))
    return stats.grouped_sets(a, [["intent"], ["asked"], ["expected"], []], F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))
