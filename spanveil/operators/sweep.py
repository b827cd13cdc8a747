"""A sweep of generated cases: every profile in every template, and negatives, with their parts in a seeded order.

Profiles are rows made from any table's key by column expressions (no collect, no Python): the same key gives the same
profile everywhere, so a sweep can be run again in parts. Templates join labelled parts; ``shuffled`` puts the parts in an
order that depends on a seed and the case alone. Each case carries the values that must be found, for
``evaluate.evaluate_cases``, and ``negative`` cases carry none.

Nulls and ties: a row with a NULL key is a profile like any other (its key counts as 0); repeated keys give repeated cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.text import empty_array
from spanveil.operators.evaluate import EXPECTED, evaluate_cases

FIRST = ("Alice", "Robert", "Maria", "David", "Susan", "Kevin", "Laura", "Peter")
LAST = ("Johnson", "Smith", "Garcia", "Miller", "Wilson", "Anderson", "Thompson", "Martinez")
STREETS = ("Oak", "Maple", "Cedar", "Elm", "Birch")
SEED = 17


def number(key: Column, seed: int, width: int, low: int = 0) -> Column:
    """``width`` digits drawn from the key, the first one at least ``low``."""
    span = 10**width - low * 10 ** (width - 1)
    return F.lpad((F.pmod(F.xxhash64(F.lit(seed), key), F.lit(span)) + low * 10 ** (width - 1)).cast("string"), width, "0")


def hexes(key: Column, seed: int, width: int) -> Column:
    return F.left(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(width))


def picked(key: Column, seed: int, words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(words))) + 1).cast("int"))


def with_luhn_digit(body: Column, width: int) -> Column:
    """The digits and the last one that makes Luhn's sum a multiple of ten."""
    total = F.lit(0)
    for k in range(width):
        d = F.substring(body, k + 1, 1).cast("int")
        total = total + (d if (width - k) % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def profiles(table: DataFrame, key: str) -> DataFrame:
    """profile (the key) and one made-up value of each kind."""
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(0))

    def joined(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    first, last = picked(k, 1, FIRST), picked(k, 2, LAST)
    uuid = joined(hexes(k, 3, 8), "-", hexes(k, 4, 4), "-4", hexes(k, 5, 3), "-a", hexes(k, 6, 3), "-", hexes(k, 7, 12))
    return table.select(
        F.col(key).alias("profile"), first.alias("first"), last.alias("last"),
        joined(F.lower(first), ".", F.lower(last), number(k, 8, 4), "@example.com").alias("email"),
        joined("+1 415-555-", number(k, 9, 4)).alias("phone"),
        joined("5", number(k, 10, 2), "-", number(k, 11, 2, 1), "-", number(k, 12, 4, 1)).alias("ssn"),
        with_luhn_digit(joined("4", number(k, 13, 14)), 15).alias("card"),
        joined("0x", hexes(k, 14, 32), hexes(k, 15, 8)).alias("eth"),
        joined("sk_live_", hexes(k, 16, 24)).alias("api_key"),
        joined("10.", F.pmod(k, F.lit(200)).cast("string"), ".7.9").alias("ip"),
        uuid.alias("uuid"),
        joined("device_", hexes(k, 17, 10)).alias("device"), joined("user_", hexes(k, 18, 10)).alias("user"),
        joined("02:1a:", hexes(k, 19, 2), ":", hexes(k, 20, 2), ":3c:4d").alias("mac"),
        joined(number(k, 21, 3, 1), " ", picked(k, 22, STREETS), " Street").alias("street"),
        joined("19", number(k, 23, 2, 5), "-0", number(k, 24, 1, 1), "-1", F.pmod(k, F.lit(10)).cast("string")).alias("day"),
        joined("GB29 NWBK ", number(k, 25, 4, 1), " ", number(k, 26, 4, 1), " ", number(k, 27, 4, 1), " 19").alias("iban"),
        number(k, 28, 9, 1).alias("account"),
    )


#: template: (separator, [(words before the value, column, type that must be found)])
TEMPLATES = {
    "contact_note": ("\n", [("email: ", "email", "EMAIL"), ("reach me on ", "phone", "PHONE_NUMBER"), ("seen by ", "first", "PERSON_NAME")]),
    "identity_lines": ("\n", [("name: ", "last", "PERSON_NAME"), ("SSN: ", "ssn", "SSN"), ("DOB: ", "day", "DATE")]),
    "bank_form": ("; ", [("paid with ", "card", "CREDIT_CARD"), ("account: ", "account", "BANK_ACCOUNT"), ("holder ", "last", "PERSON_NAME")]),
    "crypto_support": ("\n", [("wallet ", "eth", "CRYPTO_ADDRESS"), ("key ", "api_key", "API_KEY"), ("from ", "email", "EMAIL")]),
    "infra_log": (" ", [("ip=", "ip", "IP_ADDRESS"), ("req=", "uuid", "UUID"), ("who=", "user", "USER_ID"), ("dev=", "device", "DEVICE_ID"), ("nic=", "mac", "MAC_ADDRESS")]),
    "shipping_block": ("\n", [("to ", "last", "PERSON_NAME"), ("at ", "street", "STREET_ADDRESS"), ("call ", "phone", "PHONE_NUMBER")]),
    "travel_document": ("\n", [("born ", "day", "DATE"), ("mail ", "email", "EMAIL")]),
    "record": (" | ", [("email=", "email", "EMAIL"), ("wallet=", "eth", "CRYPTO_ADDRESS"), ("key=", "api_key", "API_KEY")]),
    "uk_finance": (" | ", [("payee ", "first", "PERSON_NAME"), ("iban ", "iban", "BANK_ACCOUNT")]),
}
#: texts that hold nothing; ``{}`` is a small number
NEGATIVES = {
    "release_note": "the build was slower by {} percent after the patch",
    "roadmap": "phase {} covers search and sorting",
    "metrics": "{\"rows\": {}, \"bad\": 0}",
    "table": "rows,bad\n{},0",
    "prose": "we met {} people and liked the view",
}


def shuffled(parts: list[Column], case: Column, seed: int) -> Column:
    """The parts in an order drawn from the seed and the case."""
    keyed = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), case).alias("at"), F.lit(k).alias("k"), p.alias("p")) for k, p in enumerate(parts)])
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def sweep_cases(made: DataFrame, seed: int = SEED) -> DataFrame:
    """case_id (profile and template), profile, template, category (positive or negative), text and ``expected``: one row for each
    profile and template, negatives included, made in one pass without a shuffle."""
    case, cases = F.col("profile"), []
    for name, (glue, parts) in TEMPLATES.items():
        pieces = [F.struct(F.concat(F.lit(lead), F.col(c)).alias("text"), F.col(c).alias("value"), F.lit(kind).alias("type")) for lead, c, kind in parts]
        ordered = shuffled(pieces, F.concat_ws(":", F.lit(name), case), seed)
        text = F.array_join(F.transform(ordered, lambda p: p["text"]), glue)
        expected = F.transform(ordered, lambda p: F.struct(
            p["value"].alias("value"), p["type"].alias("expected_type"), p["type"].alias("semantic_type"), F.lit(False).alias("allow_type_mismatch"),
        ))
        cases.append(_case(name, "positive", text, expected.cast(f"array<{EXPECTED}>")))
    small = F.pmod(F.xxhash64(F.lit(seed), case), F.lit(90)).cast("string")
    for name, carrier in NEGATIVES.items():
        cases.append(_case(name, "negative", F.replace(F.lit(carrier), F.lit("{}"), small), empty_array(EXPECTED)))
    return made.select("profile", F.explode(F.array(*cases)).alias("c")).select(
        F.concat_ws(":", "profile", "c.template").alias("case_id"), "profile", "c.*"
    )


def _case(name: str, category: str, text: Column, expected: Column) -> Column:
    return F.struct(F.lit(name).alias("template"), F.lit(category).alias("category"), text.alias("text"), expected.alias("expected"))


def sweep_summary(made: DataFrame, floors: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """Per category and template, and over each category: total, core_passed, strict_passed, and whether the core share
    reaches the category's floor (``floors``, 0.99 where none is given)."""
    done = evaluate_cases(sweep_cases(made, seed))
    passed = done.groupBy("category", "template").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("core_pass").cast("bigint")).alias("core_passed"),
        F.sum(F.col("strict_pass").cast("bigint")).alias("strict_passed"),
    )
    totals = passed.groupingSets([["category", "template"], ["category"]], "category", "template").agg(
        F.sum("total").alias("total"), F.sum("core_passed").alias("core_passed"), F.sum("strict_passed").alias("strict_passed"),
        F.grouping_id().alias("level"),
    )
    floor = F.lit(0.99)
    for category, share in (floors or {}).items():
        floor = F.when(F.col("category") == category, share).otherwise(floor)
    return totals.withColumn("reached", F.col("core_passed") >= floor * F.col("total"))
