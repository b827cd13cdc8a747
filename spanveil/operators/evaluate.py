"""Quality evaluation against labelled cases: issues, warnings, verdicts, summaries; checks; case generation.

Tables: ``cases`` (case_id, text, category, template, ``expected`` array of
``struct<value, expected_type, semantic_type, allow_type_mismatch>``). Matching is sequential within one case by
definition, so it is one fold per row; summaries are ordinary aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import empty_array, let
from spanveil.operators.dictionaries import Dictionaries
from spanveil.operators.redact import anonymize
from spanveil.operators.restore import deanonymize

EXPECTED = "struct<value:string,expected_type:string,semantic_type:string,allow_type_mismatch:boolean>"
ACTUAL = "struct<pos:int,type:string,value:string>"
NOTE = "struct<kind:string,is_warning:boolean,expected_type:string,actual_type:string,value:string,actual_value:string>"
CORE_BREAKING = ["missing_detection", "restore_mismatch", "type_mismatch", "unexpected_detection"]


def _note(kind: str, warning: bool, expected: Column, actual: Column, value: Column, actual_value: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(warning).alias("is_warning"), expected.alias("expected_type"),
        actual.alias("actual_type"), value.alias("value"), actual_value.alias("actual_value"),
    )


def _notes(expected: Column, actual: Column, restored_ok: Column) -> Column:
    none = F.lit(None).cast("string")

    def judge(e: Column, a: Column) -> Column:
        """Notes for an expected value and the detection paired with it."""
        over = F.when(
            a["value"] != e["value"],
            F.array(_note("overcapture", False, e["expected_type"], a["type"], e["value"], a["value"])),
        ).otherwise(empty_array(NOTE))
        wrong = F.when(
            a["type"] != e["expected_type"],
            F.when(
                e["allow_type_mismatch"],
                F.array(_note("taxonomy_mismatch", True, e["semantic_type"], a["type"], e["value"], none)),
            ).otherwise(F.array(_note("type_mismatch", False, e["expected_type"], a["type"], e["value"], none))),
        ).when(
            e["semantic_type"] != e["expected_type"],
            F.array(_note("taxonomy_mismatch", True, e["semantic_type"], a["type"], e["value"], none)),
        ).otherwise(empty_array(NOTE))
        return F.concat(over, wrong)

    def pair(acc: Column, e: Column) -> Column:
        exact = F.filter(acc["left"], lambda a: a["value"] == e["value"])
        holding = F.filter(acc["left"], lambda a: a["value"].contains(e["value"]))
        chosen = F.coalesce(F.get(exact, 0), F.get(holding, 0))
        return let(
            chosen,
            lambda a: F.when(
                a.isNull(),
                F.struct(
                    acc["left"].alias("left"),
                    F.concat(
                        acc["notes"],
                        F.array(_note("missing_detection", False, e["expected_type"], none, e["value"], none)),
                    ).alias("notes"),
                ),
            ).otherwise(
                F.struct(
                    F.filter(acc["left"], lambda x: x["pos"] != a["pos"]).alias("left"),
                    F.concat(acc["notes"], judge(e, a)).alias("notes"),
                )
            ),
        )

    def finish(acc: Column) -> Column:
        extra = F.transform(
            acc["left"], lambda a: _note("unexpected_detection", False, none, a["type"], none, a["value"])
        )
        lost = F.when(restored_ok, empty_array(NOTE)).otherwise(
            F.array(_note("restore_mismatch", False, none, none, none, none))
        )
        return F.concat(acc["notes"], extra, lost)

    return F.aggregate(
        expected, F.struct(actual.alias("left"), empty_array(NOTE).alias("notes")), pair, finish
    )


def evaluate_cases(
    cases: DataFrame, detectors: list[str] | None = None, dictionaries: Dictionaries | None = None
) -> DataFrame:
    """Every case with its ``notes`` (issues and warnings), ``core_pass`` and ``strict_pass``.

    Expected values are taken in order; each is paired with the first unused detection of the same value, else the
    first unused one that contains it (an overcapture).
    """
    done = deanonymize(anonymize(cases, "text", detectors, dictionaries))
    actual = F.transform(
        F.col("entities"), lambda e, i: F.struct(i.alias("pos"), e["type"].alias("type"), e["value"].alias("value"))
    ).cast(f"array<{ACTUAL}>")
    expected = F.coalesce(F.col("expected").cast(f"array<{EXPECTED}>"), empty_array(EXPECTED))
    judged = done.withColumn("notes", _notes(expected, actual, F.col("restored").eqNullSafe(F.col("text"))))
    return judged.withColumns(
        {
            "core_pass": ~F.exists("notes", lambda n: n["kind"].isin(CORE_BREAKING)),
            "strict_pass": F.size("notes") == 0,
        }
    )


def issues(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per issue or warning."""
    return (
        evaluated.select(*keys, F.explode_outer("notes").alias("n")).where(F.col("n").isNotNull()).select(*keys, "n.*")
    )


def summary(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Totals, core and strict passes by the given columns, by each of them alone, and over all; ``level`` is the grouping
    id (a set bit for every column, from the left, that the row adds up over), so a NULL category is no subtotal."""
    sets = list(dict.fromkeys([tuple(by), *[(c,) for c in by], ()]))
    return evaluated.groupingSets([list(s) for s in sets], *by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("core_pass").cast("int")).alias("core_passed"),
        F.sum(F.col("strict_pass").cast("int")).alias("strict_passed"),
        F.grouping_id().alias("level"),
    )


def issue_counts(evaluated: DataFrame) -> DataFrame:
    return issues(evaluated, []).groupBy("kind", "is_warning").agg(F.count(F.lit(1)).alias("n"))


def failures(evaluated: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """The first failing cases by key (a sample report)."""
    return evaluated.where("NOT strict_pass").orderBy(key).limit(limit)


def check_texts(
    checks: DataFrame, detectors: list[str] | None = None, dictionaries: Dictionaries | None = None
) -> DataFrame:
    """Test rows (text, expected_types, forbidden_types, sensitive_values, expect_count, expect_roundtrip): adds ``ok``
    and ``failed``, the list of failed checks."""
    done = deanonymize(anonymize(checks, "text", detectors, dictionaries))
    empty = empty_array("string")

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), empty)

    failed = F.concat(
        F.when(F.col("expect_count") != F.col("count"), F.array(F.lit("count"))).otherwise(empty),
        F.transform(F.array_except(given("expected_types"), F.col("detected_types")), lambda t: F.concat(F.lit("missing "), t)),
        F.transform(F.array_intersect(given("forbidden_types"), F.col("detected_types")), lambda t: F.concat(F.lit("unexpected "), t)),
        F.transform(
            F.filter(given("sensitive_values"), lambda v: F.col("anonymized").contains(v)), lambda v: F.concat(F.lit("leaked "), v)
        ),
        F.when(
            F.coalesce(F.col("expect_roundtrip"), F.lit(False)) & ~F.col("restored").eqNullSafe(F.col("text")),
            F.array(F.lit("roundtrip")),
        ).otherwise(empty),
    )
    return done.withColumn("failed", failed).withColumn("ok", F.size("failed") == 0)


def carrier_cases(values: DataFrame, prefixes: list[str], suffixes: list[str], n: int) -> DataFrame:
    """``n`` deterministic cases per row of ``values`` (value, carrier, expected_types …): the carrier sentence, with
    ``{}`` for the value, between a prefix and a suffix chosen by case number."""
    before, after = F.array(*[F.lit(p) for p in prefixes]), F.array(*[F.lit(s) for s in suffixes])
    numbered = values.withColumn("case_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = F.concat(
        F.element_at(before, (F.col("case_no") % len(prefixes) + 1).cast("int")),
        F.replace(F.col("carrier"), F.lit("{}"), F.col("value")),
        F.element_at(after, ((F.col("case_no") / len(prefixes)).cast("int") % len(suffixes) + 1).cast("int")),
    )
    return numbered.withColumn("text", text)
