"""Every detector on one table of texts: what must be found, as (placeholder, value) in order."""

from __future__ import annotations

import spanveil as sv

P, E, Z, D = "PERSON_NAME", "EMAIL", "ZIP_CODE", "DATE"
NBSP = " "
ETH = "0x" + "aB12" * 10
HEX32 = "0123456789abcdef0123456789abcdef"
SEED = "abandon ability able about above absent absorb abstract absurd abuse access accident"

CASES = [
    # crypto and secrets
    (f"send to {ETH}.", [("CRYPTO_ADDRESS", ETH)]),
    (f"send to {ETH}0", []),
    ("bc1q" + "a1" * 20, [("CRYPTO_ADDRESS", "bc1q" + "a1" * 20)]),
    ("BTC 1BoatSLRHtKNngkdXEeobR76b53LETtpyT ok", [("CRYPTO_ADDRESS", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT")]),
    ("eyJabcdefghij.abcdefghij.abcdefgh-- x", []),
    ("eyJabcdefghij.abcdefghij.abcdefghij- x", [("ACCESS_TOKEN", "eyJabcdefghij.abcdefghij.abcdefghij")]),
    ("xoxb-1234567890 leaked", [("API_KEY", "xoxb-1234567890")]),
    ("SK_LIVE_" + "a" * 20, [("API_KEY", "SK_LIVE_" + "a" * 20)]),
    # cards and banking
    ("pay 4111-1111-1111-1111 now", [("CREDIT_CARD", "4111-1111-1111-1111")]),
    ("pay 4111-1111-1111-1112 now", []),
    ("amex 378282246310005", [("CREDIT_CARD", "378282246310005")]),
    ("IBAN GB29 NWBK 6016 1331 9268 19.", [("BANK_ACCOUNT", "GB29 NWBK 6016 1331 9268 19")]),
    ("routing#021000021", [("ROUTING_NUMBER", "021000021")]),
    ("acct: 12345678", [("BANK_ACCOUNT", "12345678")]),
    ("sort 12-34-56 and 12–34–56", [("SORT_CODE", "12-34-56"), ("SORT_CODE", "12–34–56")]),
    # identity
    ("id 123-45-6789 and 000-45-6789 and 666-45-6789", [("SSN", "123-45-6789")]),
    ("9xx 912-45-6789", [("SSN", "912-45-6789")]),
    ("nino ab123456c", [("SSN", "ab123456c")]),
    ("passport A1234567", [("PASSPORT_NUMBER", "A1234567")]),
    ("passport office", [("PASSPORT_NUMBER", "office")]),
    ("passport passport", [("PASSPORT_NUMBER", "passport")]),
    ("DL: D1234567", [("DRIVER_LICENSE", "D1234567")]),
    ("driver's licence D1234567", [("DRIVER_LICENSE", "D1234567")]),
    ("passport" + NBSP + "A1234567", [("PASSPORT_NUMBER", "A1234567")]),
    # network and contact
    ("ip 10.0.0.1 or 0.1.2.3 or 256.1.1.1", [("IP_ADDRESS", "10.0.0.1")]),
    ("mac 0A:1b:2C:3d:4E:5f", [("MAC_ADDRESS", "0A:1b:2C:3d:4E:5f")]),
    ("mail a.b+c@d-e.co.uk, thanks", [(E, "a.b+c@d-e.co.uk")]),
    ("first@b.cc.d@e.com", [(E, "first@b.cc"), (E, ".d@e.com")]),
    ("é.foo@x.com", [(E, "foo@x.com")]),
    ("call +44 20 7946 0958, ok", [("PHONE_NUMBER", "+44 20 7946 0958")]),
    ("ends +44 20 7946 0958", [("PHONE_NUMBER", "+44 20 7946 0958")]),
    ("plus +1234567. dot", []),
    ("tel (020) 7946 0958 x", [("PHONE_NUMBER", "(020) 7946 0958")]),
    ("number 79460958 drawn", []),
    ("no 7946-0958 drawn", [("PHONE_NUMBER", "7946-0958")]),
    # addresses
    ("SW1A 1AA and zz1 1aa and TT1 1AA and EE1 2BB and BF1 1AA", [(Z, "SW1A 1AA"), (Z, "EE1 2BB")]),
    ("Springfield, IL 62704", [(Z, "62704")]),
    ('{"n": 12345, "m": 1}', []),
    ("a,b\nrow1,12345", []),
    ("a b\n,12345", [(Z, "12345")]),
    ("left,\n12345,x", []),
    ("left,\n12345 x", [(Z, "12345")]),
    ("Well, 12345", []),
    ("Well then, 12345", [(Z, "12345")]),
    ("r1,12345 then 54321", [(Z, "54321")]),
    ("r1,x, 12345", []),
    ("12 Main Street and 7 Oak Tree Lane Road.", [("STREET_ADDRESS", "12 Main Street"), ("STREET_ADDRESS", "7 Oak Tree Lane Road")]),
    ("12 Mainly Stone Players", []),
    ("12 Street Road", [("STREET_ADDRESS", "12 Street Road")]),
    ("12 Grand Oak Avenue Xylo Quux", [("STREET_ADDRESS", "12 Grand Oak Avenue")]),
    # dates
    ("DOB: 03/04/1990", [(D, "03/04/1990")]),
    ("on 2024-01-31 and 1/2/24", [(D, "2024-01-31"), (D, "1/2/24")]),
    ('{"created": "2024-01-31"}', []),
    ("version=2024-01-31 slug: \"2024-01-31\"", []),
    ("r1,2024-01-31", []),
    # names
    ("Dr. Quill O'Hammer came", [(P, "Dr. Quill O'")]),
    ("mary met Robert", [(P, "mary"), (P, "Robert")]),
    ("we hope Grace wins", []),
    ("into Grace we go", [(P, "Grace")]),
    ("manager: Sterling", [(P, "Sterling")]),
    ("Robert Stone left", [(P, "Robert"), (P, "Stone")]),
    ("april sample user example", []),
    ("in Austin, TX and Robert, OK", []),
    ("José and x_mary and mary2", []),
    ('"beneficiary":"Chase"', [(P, "Chase")]),
    # system
    ("DEV_abc123 device-abc123 Device-abc123", [("DEVICE_ID", "DEV_abc123"), ("DEVICE_ID", "device-abc123")]),
    ("session_abc123 token-xyz789 session-summary-12", [("SESSION_TOKEN", "session_abc123"), ("SESSION_TOKEN", "token-xyz789")]),
    ("USR-abc123", [("USER_ID", "USR-abc123")]),
    ("id 123E4567-e89b-12d3-a456-426614174000", [("UUID", "123E4567-e89b-12d3-a456-426614174000")]),
    # seed phrases
    (f"words\n{SEED}\nend", [("ACCESS_TOKEN", SEED)]),
    (f"{SEED} extra", []),
    (f"{SEED}\n{SEED}", [("ACCESS_TOKEN", SEED)]),
    # keyword numbers
    ("social security 123456789", [("SSN", "123456789")]),
    ("aba 021000021", [("ROUTING_NUMBER", "021000021")]),
    ("employee #483920", [("USER_ID", "483920")]),
    ("order number 12345678 for 12 Main Street", [("USER_ID", "12345678"), ("STREET_ADDRESS", "12 Main Street")]),
    ("sum 12345678 units", []),
    ("policy" + "." * 80 + "82000001", []),
    ("policy" + "." * 74 + "82000001", [("USER_ID", "82000001")]),
    ("82000001" + "." * 35 + " claim x", []),
    ("82000001" + "." * 34 + " claim x", [("USER_ID", "82000001")]),
    # a number inside a longer hit is left alone even if that hit loses
    ("phone 123-45-6789", [("SSN", "123-45-6789")]),
    # texts
    ("", []),
    (" \n　﻿", []),
    (None, []),
    ("\U0001f600\U0001f600 mail x@y.org \U0001f600 Robert", [(E, "x@y.org"), (P, "Robert")]),
    ("mark ￿ mary￿robert x@y.org 12345", [(P, "mary"), (P, "robert"), (E, "x@y.org"), (Z, "12345")]),
    ("io 12345\n", [(Z, "12345")]),
]


def test_cases(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    done = sv.detect(spark.createDataFrame(rows, "id int, text string").repartition(8, "id")).collect()
    wrong = []
    for row in done:
        text, want = CASES[row.id]
        got = [(s.placeholder, s.value) for s in row.spans]
        if got != want:
            wrong.append((text, got, want))
        for s in row.spans:
            assert text[s.start : s.end] == s.value
    assert not wrong, "\n".join(map(str, wrong))


def test_subset_keeps_custom_seed_and_context(spark):
    df = spark.createDataFrame(
        [(1, f"x@y.org 10.0.0.1 Quibble order 12345678\n{SEED}")], "id int, text string"
    )
    words = sv.Dictionaries().add_names(["quibble"])
    kinds = lambda dets: [s.placeholder for s in sv.detect(df, detectors=dets, dictionaries=words).first().spans]
    assert kinds(["email", "no_such_detector"]) == [E, P, "USER_ID", "ACCESS_TOKEN"]
    assert kinds([]) == [P, "USER_ID", "ACCESS_TOKEN"]


def test_catalogue(spark):
    rows = sv.detector_catalogue(spark).orderBy("position").collect()
    assert len(rows) == 30 and rows[0].id == "eth_address" and rows[-1].id == "uuid"
    assert {r.tier for r in rows} == {"Crypto", "Financial", "Identity", "Network", "Contact", "Address", "Names", "System"}


def test_hostile_texts(spark):
    """Long runs that overflow the stack or take quadratic time with naive forms."""
    texts = {
        1: "12 " + "Aaa " * 20000 + "Street end",
        2: "Mr " + "Aaa " * 20000,
        3: "x@y.org " * 3000,
        4: "a." * 20000 + "@",
        5: "1,12345\n" * 3000,
        6: "word " * 12 * 4000,
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(6, "id")
    done = {r.id: r for r in sv.deanonymize(sv.anonymize(df)).collect()}
    assert done[1]["detected_types"] == ["STREET_ADDRESS"] and done[1]["count"] == 1
    assert done[3]["count"] == 3000 and len(done[3].entity_map) == 1
    assert done[5]["count"] == 0
    for i, text in texts.items():
        assert done[i].restored == text
