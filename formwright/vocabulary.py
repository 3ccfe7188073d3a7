"""Closed vocabularies, patterns and constants shared by every module."""

from __future__ import annotations

# Fixed values, down to the name pattern: results are right only with exactly these.

# The position in the tuple is the class id.
DOCUMENT_TYPES = (
    "W-2",
    "1099-R",
    "1099-MISC",
    "1099-DIV",
    "Receipt",
    "Bank Statement",
    "1040",
    "Schedule A",
)
UNKNOWN_TYPE = "Unknown"

# Ordered: extracted fields are reported in this order.
FIELD_TYPES = (
    "SSN",
    "EMPLOYER_NAME",
    "WAGE_AMOUNT",
    "TAX_WITHHELD",
    "ADDRESS",
    "DATE",
    "EMPLOYER_EIN",
    "EMPLOYEE_NAME",
    "FEDERAL_TAX",
    "STATE_TAX",
    "SOCIAL_SECURITY_TAX",
    "MEDICARE_TAX",
    "ACCOUNT_NUMBER",
    "ROUTING_NUMBER",
    "PHONE_NUMBER",
    "EMAIL",
)

AMOUNT_FIELDS = (
    "WAGE_AMOUNT",
    "TAX_WITHHELD",
    "FEDERAL_TAX",
    "STATE_TAX",
    "SOCIAL_SECURITY_TAX",
    "MEDICARE_TAX",
)

CRITICAL_FIELDS = ("SSN", "WAGE_AMOUNT", "EMPLOYER_NAME")

# Entity groups of general-purpose models; a group missing here is taken as a field name.
GROUP_TO_FIELD = {
    "PERSON": "EMPLOYEE_NAME",
    "ORG": "EMPLOYER_NAME",
    "MONEY": "WAGE_AMOUNT",
    "DATE": "DATE",
    "LOC": "ADDRESS",
    "PHONE": "PHONE_NUMBER",
    "EMAIL": "EMAIL",
}

# Patterns of a field, in the order they are tried.
SSN_PATTERNS = (r"\b\d{3}-?\d{2}-?\d{4}\b",)
AMOUNT_PATTERNS = (r"\$[\d,]+\.?\d*", r"\b\d{1,3}(?:,\d{3})*\.?\d*\b")
DATE_PATTERNS = (
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
)
EIN_PATTERNS = (r"\b\d{2}-?\d{7}\b",)

PATTERN_CONFIDENCE = {"SSN": 0.9, "WAGE_AMOUNT": 0.8, "DATE": 0.8, "EMPLOYER_EIN": 0.7}

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NAME_PATTERN = r"^[A-Za-z\s\.,'-]+$"

# English month names.
MONTHS = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)

# Fixed values as well.
DEFAULT_WEIGHTS = {"ocr": 0.3, "ner": 0.4, "validation": 0.3}

# What `str.strip()` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

TEXT_LINE_CONFIDENCE = 0.9  # line confidence when the provider reports text only
TEXT_ONLY_CONFIDENCE = 0.8  # document confidence when there are no lines at all
PREVIEW_LENGTH = 200
CLASSIFIER_TOKEN_LIMIT = 512
IGNORED_LABEL = -100
SLOW_SECONDS = 10.0
#: Seconds that one OCR call may take.
OCR_CALL_LIMIT = 30.0

IMAGE_ENDINGS = ("jpg", "png", "jpeg")
IMAGE_GLOB = "*.{" + ",".join(IMAGE_ENDINGS) + "}"

BIO_TAGS = ("O",) + tuple(f"{prefix}-{name}" for name in FIELD_TYPES for prefix in ("B", "I"))
