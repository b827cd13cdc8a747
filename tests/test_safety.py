"""Redaction never fails open: NULL scopes, missing and repeated keys, long name lists, odd configs, odd letters."""

from __future__ import annotations

import hashlib
import hmac
import json
import os

import pytest

import spanveil as sv
from spanveil.functions import fixed_values as fixed
from spanveil.operators import scope
from spanveil.operators.dictionaries import CustomPattern, Dictionaries, NameLists
from spanveil.operators.skew import drop_kept, kept
from spanveil.sources import texts as sources
from spanveil.streaming import jobs


def test_word_lists_are_whole():
    lists = NameLists()
    assert (len(lists.first), len(lists.last), len(fixed.SUPPRESS_WORDS), len(lists.ambiguous)) == (494, 229, 211, 184)
    assert len(lists.first | lists.last) == 701 and len(fixed.SEED_WORDS) == 120
    assert len(fixed.FIRST_NAMES) == len(set(fixed.FIRST_NAMES))


def test_names_of_the_whole_list_are_found(spark, tmp_path):
    df = spark.createDataFrame([("Sophia and Adrian met Isabella",)], "text string")
    assert sv.anonymize(df).first().anonymized == "[PERSON_NAME_1] and [PERSON_NAME_2] met [PERSON_NAME_3]"
    (tmp_path / "first.txt").write_text("# own list\nZaphod\n")
    own = Dictionaries(lists=NameLists.from_files(first=str(tmp_path / "first.txt")))
    row = sv.anonymize(spark.createDataFrame([("Zaphod met Isabella",)], "text string"), dictionaries=own).first()
    assert row.anonymized == "[PERSON_NAME] met Isabella"


def _in_scope(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = kept(sv.findings(docs, ["doc_id", "source"], detectors=["email"]))
    numbered = scope.number_entities(scope.entities_in_scope(found, "source", ["doc_id", "start"]), "source")
    return docs, found, numbered


def test_null_scopes_are_redacted_and_restored(spark):
    docs, found, numbered = _in_scope(spark, [(1, None, "mail a@b.org"), (2, "s", "mail c@d.org, e@f.org"), (3, None, "a@b.org or x@y.org")])
    done = scope.redact_in_scope(docs, found, numbered, "doc_id", "source")
    assert {r.doc_id: r.anonymized for r in done.collect()} == {
        1: "mail [EMAIL_1]", 2: "mail [EMAIL_1], [EMAIL_2]", 3: "[EMAIL_1] or [EMAIL_2]"
    }
    vault = scope.vault(numbered, "source")
    assert {(r.source, r.value) for r in vault.collect()} >= {(None, "a@b.org"), (None, "x@y.org")}
    back = sv.restore_from_scope_vault(done.select("doc_id", "source", "anonymized"), vault, "doc_id", "source")
    assert {r.doc_id: r.restored for r in back.collect()} == {i: t for i, _, t in docs.select("doc_id", "source", "text").collect()}


@pytest.mark.parametrize("rows", [[(1, "s", "a@b.org"), (1, "s", "now c@d.org")], [(None, "s", "a@b.org"), (2, "s", "c@d.org")]])
def test_repeated_and_missing_keys_are_refused(spark, rows):
    docs, found, numbered = _in_scope(spark, rows)
    with pytest.raises(Exception, match="unique keys"):
        scope.redact_in_scope(docs, found, numbered, "doc_id", "source").collect()


def test_an_unnumbered_occurrence_is_refused(spark):
    docs, found, numbered = _in_scope(spark, [(1, "s", "a@b.org")])
    with pytest.raises(Exception, match="no numbered entity"):
        scope.redact_in_scope(docs, found, numbered.where("false"), "doc_id", "source").collect()


@pytest.mark.parametrize("size", [10, 19_999, 20_001, 200_000])
def test_name_files_of_any_size_do_the_same(spark, tmp_path, size):
    (tmp_path / "names.csv").write_text("zork bop\n" + "\n".join(f"nobody{k}" for k in range(size - 1)))
    (tmp_path / "c.json").write_text(json.dumps({"names": ["Grok"], "nameFiles": ["names.csv"]}))
    got = sources.load_config(spark, str(tmp_path / "c.json"))
    assert (got.loaded, got.names_loaded, got.files_loaded) == (True, size + 1, 1)
    df = spark.createDataFrame([(1, "İİ met Zork Bop, grok and x@y.org"), (1, None)], "id int, text string")
    done = sv.anonymize(df, dictionaries=got.dictionaries).collect()
    assert [r.anonymized for r in done if r["count"]] == ["İİ met [PERSON_NAME_1], [PERSON_NAME_2] and [EMAIL]"]
    assert len(done) == 2
    kinds = sv.findings(df, ["id"], dictionaries=got.dictionaries, raw=True).groupBy("placeholder").count().collect()
    assert {r["placeholder"]: r["count"] for r in kinds} == {"PERSON_NAME": 2, "EMAIL": 1}


def test_configs(spark, tmp_path):
    def load(value):
        (tmp_path / "c.json").write_text(json.dumps(value))
        return sources.load_config(spark, str(tmp_path / "c.json"))

    assert load([]).loaded and load([]).names_loaded == 0
    assert not load({"names": ["zork", 5]}).loaded
    got = load({"names": ["zork"], "patterns": [{"regex": "AB", "placeholder": "EMP", "description": "x"}, {"regex": "CD"}, {"regex": "EF", "label": "L"}]})
    assert got.loaded and [p.id for p in got.dictionaries.patterns] == ["custom_EMP", "custom_pattern", "custom_L"]
    assert not load({"patterns": [{"regex": 5}]}).loaded


def test_matches_without_text_are_dropped(spark):
    own = Dictionaries(patterns=(CustomPattern("(?=z)"), CustomPattern("q(?=z)", placeholder="Q")))
    row = sv.anonymize(spark.createDataFrame([("fizz qz",)], "text string"), dictionaries=own).first()
    assert row.anonymized == "fizz [Q]z"


def test_names_after_a_letter_that_grows_in_lower_case(spark):
    row = sv.anonymize(spark.createDataFrame([("İİ met zork, ok",)], "text string"), dictionaries=Dictionaries().add_names(["zork"])).first()
    assert row.anonymized == "İİ met [PERSON_NAME], ok"


def test_map_entries_without_a_value(spark):
    df = spark.createDataFrame([("[A] and [B]", {"[A]": None, "[B]": "x"})], "anonymized string, entity_map map<string,string>")
    assert sv.deanonymize(df).first().restored == "[A] and x"


def test_stable_tags_are_hmac(spark):
    tag = jobs.with_stable_tag(spark.createDataFrame([("X@y.org", "EMAIL")], "value string, placeholder string"), "key").first().tag
    assert tag == f"[EMAIL_{hmac.new(b'key', b'EMAIL|x@y.org', hashlib.sha256).hexdigest()}]"


def test_first_findings_of_a_table_are_the_earliest(spark):
    rows = [(2, 5, "a", "late"), (1, 3, "a", "early"), (1, 9, "b", "only")]
    df = spark.createDataFrame(rows, "user int, ts int, value string, note string")
    got = jobs.first_findings(df, ["value"], "ts").collect()
    assert {(r.value, r.ts, r.note) for r in got} == {("a", 3, "early"), ("b", 9, "only")}


def test_kept_tables_can_be_deleted(spark):
    kept(spark.range(5))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert any(files for _, _, files in os.walk(folder))
    drop_kept(spark)
    assert not os.path.exists(folder)
    assert kept(spark.range(3)).count() == 3
