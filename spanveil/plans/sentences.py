"""Sentences built from the rows of a table, with the findings they must give.

The generated text corpus holds few kinds of personal data. For the other detectors the queries run over sentences
made from every row of ``orders``, ``customer`` or ``events``; the same SQL builds them for both engines, and the
expected findings follow from how a sentence was built.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def digits(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string), {width}, '0')"


def md5(expr: str) -> str:
    return f"md5(cast({expr} as string))"


@dataclass(frozen=True)
class Expect:
    detector: str
    placeholder: str
    value: str  # SQL expression; found at its first occurrence in the text
    when: str = "true"
    label: str | None = None


@dataclass(frozen=True)
class Sentence:
    text: str  # SQL expression
    expect: list[Expect] = field(default_factory=list)


@dataclass(frozen=True)
class SentenceSet:
    table: str
    key: str
    sentences: list[Sentence]
    detectors: list[str] | None

    @property
    def text_sql(self) -> str:
        n = len(self.sentences)
        branches = " ".join(f"WHEN {i} THEN {s.text}" for i, s in enumerate(self.sentences))
        return f"CASE {self.key} % {n} {branches} END"

    def oracle(self) -> str:
        n = len(self.sentences)
        parts = [
            f"SELECT {self.key} AS doc_id, '{e.detector}' AS detector, '{e.placeholder}' AS placeholder, "
            f"CAST(strpos(text, {e.value}) - 1 AS BIGINT) AS start, {e.value} AS value "
            f"FROM s WHERE {self.key} % {n} = {i} AND ({e.when})"
            for i, s in enumerate(self.sentences)
            for e in s.expect
        ]
        return f"WITH s AS (SELECT *, {self.text_sql} AS text FROM {self.table}) " + " UNION ALL ".join(parts)


def luhn_sql(value: str) -> str:
    """DuckDB: the Luhn check over the digits of ``value``."""
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({d}, length({d}) - i, 1) AS INT)"
    doubled = f"(2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(CAST(length({d}) AS BIGINT)), "
        f"lambda i: CASE WHEN i % 2 = 1 THEN {doubled} ELSE {digit} END)) % 10 = 0)"
    )


K = "o_orderkey"
H = md5(K)
CARD = f"'4539-' || {digits(K + ' % 10000', 4)} || '-' || {digits('o_custkey % 10000', 4)} || '-' || {digits(K + ' % 9973', 4)}"
NINES = f"'9' || {digits(K, 8)} || {digits('o_custkey', 7)}"
IBAN = f"'GB' || {digits(K + ' % 100', 2)} || ' NWBK ' || {digits(K + ' % 10000', 4)} || ' 3456 7890 12'"
SSN = f"'4' || {digits(K + ' % 100', 2)} || '-' || {digits(K + ' % 90 + 10', 2)} || '-' || {digits(K + ' % 10000', 4)}"
NINO = f"'AB ' || {digits(K + ' % 90 + 10', 2)} || ' ' || {digits(K + ' % 89 + 10', 2)} || ' ' || {digits(K + ' % 83 + 10', 2)} || ' C'"
DAY = "cast(cast(o_orderdate as date) as string)"
SLASHED = f"substr({DAY}, 6, 2) || '/' || substr({DAY}, 9, 2) || '/' || substr({DAY}, 1, 4)"
ZIP = digits(f"{K} % 90000 + 10000", 5)
USER = digits("user_id", 6)
UUID = (
    "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) "
    "|| '-' || substr({h}, 21, 12)"
).format(h=md5("event_id"))

CRYPTO = SentenceSet("orders", K, [
    Sentence(f"'Wallet 0x' || {H} || substr({H}, 1, 8) || ' is mine'",
             [Expect("eth_address", "CRYPTO_ADDRESS", f"'0x' || {H} || substr({H}, 1, 8)")]),
    Sentence(f"'pay BC1q' || {H} || 'aaaaaaa.'", [Expect("btc_bech32", "CRYPTO_ADDRESS", f"'BC1q' || {H} || 'aaaaaaa'")]),
    Sentence(f"'old 1' || replace({H}, '0', 'A') || ' coins'",
             [Expect("btc_legacy", "CRYPTO_ADDRESS", f"'1' || replace({H}, '0', 'A')")]),
    Sentence(f"'Bearer eyJ' || {H} || '.' || {H} || '.' || {H} || '-;'",
             [Expect("jwt_token", "ACCESS_TOKEN", f"'eyJ' || {H} || '.' || {H} || '.' || {H}")]),
    Sentence(f"'key=sk_live_' || {H} || ', end'", [Expect("api_key_secret", "API_KEY", f"'sk_live_' || {H}")]),
    Sentence(f"'GHP_' || {H} || ' leaked'", [Expect("api_key_secret", "API_KEY", f"'GHP_' || {H}")]),
    Sentence(f"'short 0x' || {H} || ' no address'"),
    Sentence(f"'bc1' || substr({H}, 1, 20) || ' too short'"),
], ["eth_address", "btc_bech32", "btc_legacy", "jwt_token", "api_key_secret"])

BANKING = SentenceSet("orders", K, [
    Sentence(f"'iban ' || {IBAN} || '.'", [Expect("iban", "BANK_ACCOUNT", IBAN)]),
    Sentence(f"'Routing: ' || {digits(K, 9)}", [Expect("routing_number", "ROUTING_NUMBER", digits(K, 9))]),
    Sentence(f"'acct #' || {digits(K, 8)} || ' closed'", [Expect("account_number", "BANK_ACCOUNT", digits(K, 8))]),
    Sentence(f"'sort code ' || {digits(K + ' % 100', 2)} || '-34-56'",
             [Expect("uk_sortcode", "SORT_CODE", f"{digits(K + ' % 100', 2)} || '-34-56'")]),
    Sentence(f"'paid by ' || {CARD} || ' now'", [Expect("credit_card", "CREDIT_CARD", CARD, luhn_sql(CARD))]),
    Sentence(f"'the routing number ' || {digits(K, 9)} || ' is old'",
             [Expect("context_number", "ROUTING_NUMBER", digits(K, 9))]),
    Sentence(f"'account ' || {digits(K, 7)} || ' is too short'"),
], ["iban", "routing_number", "account_number", "uk_sortcode", "credit_card"])

IDENTITY = SentenceSet("orders", K, [
    Sentence(f"'SSN ' || {SSN} || ' on file'", [Expect("ssn", "SSN", SSN)]),
    Sentence(f"'number 000-12-' || {digits(K + ' % 10000', 4)}"),
    Sentence(f"'NI ' || {NINO} || ','", [Expect("uk_nino", "SSN", NINO)]),
    Sentence(f"'Passport: A' || {digits(K, 8)} || ' seen'", [Expect("passport", "PASSPORT_NUMBER", f"'A' || {digits(K, 8)}")]),
    Sentence(f"'drivers license D' || {digits(K, 7)}", [Expect("drivers_license", "DRIVER_LICENSE", f"'D' || {digits(K, 7)}")]),
    Sentence("'my passport passport is lost'", [Expect("passport", "PASSPORT_NUMBER", "'passport'")]),
    Sentence(f"'DOB: ' || {SLASHED} || ' checked'", [Expect("date_dob", "DATE", SLASHED)]),
], ["ssn", "uk_nino", "passport", "drivers_license", "date_dob"])

DATES = SentenceSet("orders", K, [
    Sentence(f"'placed on ' || {DAY} || ' at noon'", [Expect("date_full", "DATE", DAY)]),
    Sentence(f"'birthday - ' || {SLASHED} || '!'", [Expect("date_dob", "DATE", SLASHED)]),
    Sentence(f"'{{\"created\": \"' || {DAY} || '\"}}'"),
    Sentence(f"'{{\"note\": \"' || {DAY} || '\"}}'", [Expect("date_full", "DATE", DAY)]),
    Sentence(f"'version=' || {DAY} || ' released'"),
    Sentence(f"'item,day' || chr(10) || 'a' || cast({K} as string) || ',' || {DAY}"),
    # no date in a CSV record, but then a number next to the word "order"
    Sentence(f"'order,day' || chr(10) || 'a' || cast({K} as string) || ',' || {DAY}", [Expect("context_number", "USER_ID", DAY)]),
    Sentence(f"'on a walk, ' || {DAY} || ' was wet'", [Expect("date_full", "DATE", DAY)]),
    Sentence(f"'x,' || {DAY} || chr(10) || 'then ' || {SLASHED} || ' came'", [Expect("date_full", "DATE", SLASHED)]),
], ["date_dob", "date_full"])

POSTAL = SentenceSet("orders", K, [
    Sentence(f"'Austin, TX ' || {ZIP} || ' is home'", [Expect("us_zip", "ZIP_CODE", ZIP)]),
    Sentence(f"'bare ' || {ZIP}", [Expect("us_zip", "ZIP_CODE", ZIP)]),
    Sentence(f"'{{\"count\": ' || {ZIP} || ', \"ok\": 1}}'"),
    Sentence(f"'zip ' || {ZIP} || '-' || {digits(K + ' % 10000', 4)} || '.'",
             [Expect("us_zip", "ZIP_CODE", f"{ZIP} || '-' || {digits(K + ' % 10000', 4)}")]),
    Sentence(f"'name,total' || chr(10) || 'n' || cast({K} as string) || ',' || {ZIP}"),
    Sentence(f"'at ' || {ZIP} || ' Grand Oak Avenue'"),
    Sentence(f"'Post to SW' || cast({K} % 9 + 1 as string) || 'A 1AA today'",
             [Expect("uk_postcode", "ZIP_CODE", f"'SW' || cast({K} % 9 + 1 as string) || 'A 1AA'")]),
    Sentence(f"'Fake ZZ' || cast({K} % 9 as string) || ' 0ZZ code'"),
    Sentence(f"'Double TT' || cast({K} % 9 as string) || ' 1AA but EE' || cast({K} % 9 as string) || ' 2BB'",
             [Expect("uk_postcode", "ZIP_CODE", f"'EE' || cast({K} % 9 as string) || ' 2BB'")]),
], ["uk_postcode", "us_zip"])

ADDRESS = SentenceSet("orders", K, [
    Sentence(f"'Ship to ' || cast({K} + 1 as string) || ' Grand Oak Avenue today'",
             [Expect("street_address", "STREET_ADDRESS", f"cast({K} + 1 as string) || ' Grand Oak Avenue'")]),
    Sentence(f"'At ' || cast({K} + 1 as string) || ' Main St Road, left'",
             [Expect("street_address", "STREET_ADDRESS", f"cast({K} + 1 as string) || ' Main St Road'")]),
    Sentence(f"cast({K} + 1 as string) || ' Happy Stone Players'"),
    Sentence("'Write to Dr. Quill Hammer about it'", [Expect("name_title", "PERSON_NAME", "'Dr. Quill Hammer'")]),
    Sentence("'Ask mr Quill or Mr quill'"),
], ["street_address", "name_title"])

PHONES = SentenceSet("orders", K, [
    Sentence(f"'Reach me +1 555-' || {digits(K + ' % 1000', 3)} || '-4567, thanks'",
             [Expect("phone_intl", "PHONE_NUMBER", f"'+1 555-' || {digits(K + ' % 1000', 3)} || '-4567'")]),
    Sentence(f"'tel: (020) 7946 ' || {digits(K + ' % 10000', 4)} || ' or email'",
             [Expect("phone_contextual", "PHONE_NUMBER", f"'(020) 7946 ' || {digits(K + ' % 10000', 4)}")]),
    Sentence(f"'number 7946' || {digits(K + ' % 10000', 4)} || ' drawn'"),
    Sentence(f"'Mobile ' || {digits(K, 10)}", [Expect("phone_contextual", "PHONE_NUMBER", digits(K, 10))]),
    Sentence(f"'+1 555-' || {digits(K + ' % 1000', 3)} || '.x ends badly'"),
], ["phone_intl", "phone_contextual"])

CONTEXT = SentenceSet("orders", K, [
    Sentence(f"'social  security ' || {digits(K, 9)}", [Expect("context_number", "SSN", digits(K, 9))]),
    Sentence(f"'ABA ' || {digits(K, 9)} || ' valid'", [Expect("context_number", "ROUTING_NUMBER", digits(K, 9))]),
    Sentence(f"'a/c ' || {digits(K, 10)}", [Expect("context_number", "BANK_ACCOUNT", digits(K, 10))]),
    Sentence(f"{NINES} || ' is my visa'", [Expect("context_number", "CREDIT_CARD", NINES, luhn_sql(NINES))]),
    Sentence(f"'passport no ' || {digits(K, 7)}", [Expect("context_number", "PASSPORT_NUMBER", digits(K, 7))]),
    Sentence(f"'licence is ' || {digits(K, 8)}", [Expect("context_number", "DRIVER_LICENSE", digits(K, 8))]),
    Sentence(f"'employee number ' || {digits(K, 6)}", [Expect("context_number", "USER_ID", digits(K, 6))]),
    Sentence(f"'see invoice: ' || {digits(K, 12)}", [Expect("context_number", "USER_ID", digits(K, 12))]),
    Sentence(f"'sum of ' || {digits(K, 9)} || ' units'"),
    Sentence(f"'transit ' || {digits(K, 12)} || ' passed'"),
    Sentence(f"'policy' || repeat('.', 85) || {digits(K, 8)} || ' far'"),
    Sentence(f"{digits(K, 8)} || repeat('.', 30) || ' case'", [Expect("context_number", "USER_ID", digits(K, 8))]),
], [])

SYSTEM = SentenceSet("events", "event_id", [
    Sentence(f"'login user_' || {USER} || ' ok'", [Expect("user_id", "USER_ID", f"'user_' || {USER}")]),
    Sentence(f"'session-' || substr({md5('event_id')}, 1, 12) || ' open'",
             [Expect("session_id", "SESSION_TOKEN", f"'session-' || substr({md5('event_id')}, 1, 12)")]),
    Sentence(f"'session-summary-' || {USER} || ' in docs'"),
    Sentence(f"'from DEVICE_' || {USER} || '-A;'", [Expect("device_id", "DEVICE_ID", f"'DEVICE_' || {USER} || '-A'")]),
    Sentence(f"'Device_' || {USER} || ' mixed case'"),
    Sentence(f"'trace ' || upper({UUID}) || ' done'", [Expect("uuid", "UUID", f"upper({UUID})")]),
    Sentence(f"'host 10.' || cast(user_id % 256 as string) || '.0.7 up'",
             [Expect("ipv4", "IP_ADDRESS", "'10.' || cast(user_id % 256 as string) || '.0.7'")]),
    Sentence(f"'build 0.' || cast(user_id % 256 as string) || '.0.7 up'"),
    Sentence(f"'mac ' || substr({md5('event_id')}, 1, 2) || ':0a:1B:2c:3D:4e up'",
             [Expect("mac_address", "MAC_ADDRESS", f"substr({md5('event_id')}, 1, 2) || ':0a:1B:2c:3D:4e'")]),
], ["ipv4", "mac_address", "device_id", "session_id", "user_id", "uuid"])

NAMES = SentenceSet("customer", "c_custkey", [
    Sentence("'call Mary about ' || c_name", [
        Expect("name_dictionary", "PERSON_NAME", "'Mary'"), Expect("context_number", "USER_ID", "substr(c_name, 10)"),
    ]),
    Sentence("'we sat in Grace and ' || c_mktsegment"),
    Sentence("'went into Grace and ' || c_mktsegment", [Expect("name_dictionary", "PERSON_NAME", "'Grace'")]),
    Sentence("'manager: Sterling of ' || c_mktsegment", [Expect("name_dictionary", "PERSON_NAME", "'Sterling'")]),
    Sentence("'offices in Austin, TX and ' || c_mktsegment"),
    Sentence("'then Robert, OK went off with ' || c_mktsegment"),
    Sentence("'April is in the example by ' || c_mktsegment"),
    Sentence("'x_mary and mary2 of ' || c_mktsegment"),
    Sentence("'{\"full_name\":\"Chase\",\"n\":\"' || c_mktsegment || '\"}'", [Expect("name_dictionary", "PERSON_NAME", "'Chase'")]),
    Sentence("'Robert Stone of ' || c_mktsegment", [
        Expect("name_dictionary", "PERSON_NAME", "'Robert'"), Expect("name_dictionary", "PERSON_NAME", "'Stone'"),
    ]),
], ["name_dictionary"])

CUSTOM = SentenceSet("orders", K, [
    Sentence(f"'badge staff-' || {digits(K, 6)} || ' entered'", [Expect("custom_Employee ID", "EMPLOYEE_ID", f"'staff-' || {digits(K, 6)}")]),
    Sentence(f"'ref TASK-' || {digits(K, 4)} || '; staff-' || {digits(K, 6)}", [
        Expect("custom_Project Code", "PROJECT_ID", f"'TASK-' || {digits(K, 4)}"),
        Expect("custom_Employee ID", "EMPLOYEE_ID", f"'staff-' || {digits(K, 6)}"),
    ]),
    Sentence(f"'ref task-' || {digits(K, 4)} || ' in lower case'"),
    Sentence(f"'quentin blackwood signed ' || {digits(K, 3)}", [Expect("custom_name", "PERSON_NAME", "'quentin blackwood'")]),
    Sentence(f"'Quentin Blackwood. signed ' || {digits(K, 3)}"),
    Sentence(f"'seen @Ops_Admin' || ' ' || {digits(K, 3)}", [Expect("custom_name", "PERSON_NAME", "'Ops_Admin'")]),
    Sentence(f"'maria de maria de maria ' || {digits(K, 3)}", [Expect("custom_name", "PERSON_NAME", "'maria de maria'")]),
], [])

SENTENCE_SETS = {
    "crypto_ids": CRYPTO,
    "bank_ids": BANKING,
    "identity_ids": IDENTITY,
    "dates_detected": DATES,
    "postal_codes": POSTAL,
    "addresses_and_titles": ADDRESS,
    "phones": PHONES,
    "context_numbers": CONTEXT,
    "system_ids": SYSTEM,
    "name_context": NAMES,
    "custom_dictionaries": CUSTOM,
}
