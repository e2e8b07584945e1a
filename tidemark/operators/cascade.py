"""Selection by a cascade of rules that are data: each stage narrows the candidates of a group, and one must be left.

candidates: the columns of `by`, candidate, fields (a map of texts).  rules: stage (from 1), field, pattern, wanted (whether the
pattern must be found or must not).  Rules of one stage hold together.  One plan serves any number of stages; rules are a small
table, which every candidate meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import ContractError

MOST_RULES = 10_000


def cascade(candidates: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """by..., candidate, dropped_at (the stage at which it left, null if it never did), chosen, outcome, stage.

    A group's outcome is decided at the first stage that leaves exactly one (chosen), or none (nothing); later stages don't
    apply.  If the last stage leaves several, it is `several`, with that stage.  A text that is absent matches nothing."""
    n = rules.limit(MOST_RULES + 1).count()
    if not 0 < n <= MOST_RULES:
        raise ContractError(f"a cascade has 1 to {MOST_RULES} rules")
    met = candidates.select(*by, "candidate", "fields").join(F.broadcast(rules.select("stage", "field", "pattern", "wanted")))  # MOST_RULES rows
    holds = F.coalesce(F.rlike(F.element_at("fields", F.col("field")), F.col("pattern")), F.lit(False)) == F.col("wanted")
    passed = met.groupBy(*by, "candidate", "stage").agg(F.bool_and(holds).alias("holds"))
    failed = passed.groupBy(*by, "candidate").agg(F.min(F.when(~F.col("holds"), F.col("stage"))).alias("fails_at"))
    stages = rules.select("stage").distinct()
    left = failed.groupBy(*by, "fails_at").agg(F.count("*").alias("n"))
    left = left.join(F.broadcast(stages)).groupBy(*by, "stage").agg(F.sum(F.when(F.col("fails_at").isNull() | (F.col("fails_at") > F.col("stage")), F.col("n")).otherwise(0)).alias("n_left"))
    decided = left.groupBy(*by).agg(F.min(F.when(F.col("n_left") <= 1, F.struct("stage", "n_left"))).alias("d"), F.max("stage").alias("last"))
    decided = decided.select(*by, F.coalesce("d.stage", "last").alias("stage"), F.when(F.col("d.n_left") == 1, "chosen").when(F.col("d.n_left") == 0, "nothing").otherwise("several").alias("outcome"))
    out = failed.join(decided, by)
    gone = F.when(F.col("fails_at") <= F.col("stage"), F.col("fails_at"))
    return out.select(*by, "candidate", gone.alias("dropped_at"), (gone.isNull() & (F.col("outcome") == "chosen")).alias("chosen"), "outcome", "stage")
