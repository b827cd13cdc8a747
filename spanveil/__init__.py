"""Find, redact, restore and audit personal data in Spark tables and streams."""

from spanveil.operators.detectors import detector_catalogue
from spanveil.operators.dictionaries import CustomPattern, Dictionaries, NameLists
from spanveil.operators.redact import anonymize, detect, findings
from spanveil.operators.restore import deanonymize, restore_from_scope_vault, restore_from_vault, restore_text

__all__ = [
    "CustomPattern",
    "Dictionaries",
    "NameLists",
    "anonymize",
    "deanonymize",
    "detect",
    "detector_catalogue",
    "findings",
    "restore_from_scope_vault",
    "restore_from_vault",
    "restore_text",
]
