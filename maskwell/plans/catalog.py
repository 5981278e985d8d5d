"""Dimensions of the engine: patterns, types, risks, labels, frameworks, knowledge base.

All values in this module are fixed values: detection results and reports depend on them literally.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """One regular expression of a detector.  ``group`` is the capture group that is the entity; ``space`` tells
    which of the two type vocabularies the detector speaks (``entity`` or ``pii``)."""

    detector: str
    type: str
    regex: str
    confidence: float
    ignore_case: bool = False
    group: int = 0
    space: str = "entity"
    subtype: str = ""

    @property
    def full(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.regex


def _all(detector: str, type_: str, confidence: float, *regexes: str, **more) -> list[Pattern]:
    return [Pattern(detector, type_, r, confidence, **more) for r in regexes]


# Regular expressions shared by several detectors.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SSN = (r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\bSSN:?\s*\d{3}[-\s]?\d{2}[-\s]?\d{4}\b")
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
URL = r"\bhttps?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[^\s]*\b"
PASSPORT = r"\b[A-Z]{1,2}[0-9]{6,9}\b"
ACCOUNT = r"\b[0-9]{8,17}\b"

# The legacy rule detector.
LEGACY = [
    *_all("rule_based", "email", 0.95, EMAIL),
    *_all("rule_based", "phone", 0.85, r"\b\d{3}-\d{3}-\d{4}\b", r"\b\(\d{3}\)\s?\d{3}-\d{4}\b", r"\b\d{3}\.\d{3}\.\d{4}\b", r"\b\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\b\d{10}\b"),
    *_all("rule_based", "ssn", 0.95, *SSN),
    *_all("rule_based", "pan", 0.90, r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    *_all("rule_based", "credit_card", 0.85, r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b", r"\b6011[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    *_all("rule_based", "iban", 0.80, IBAN),
    *_all("rule_based", "ip_address", 0.90, IPV4, IPV6),
    *_all("rule_based", "url", 0.85, r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"),
    *_all("rule_based", "address", 0.70, r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b", r"\b\d+\s+[A-Za-z\s]+,\s*[A-Za-z\s]+,\s*[A-Z]{2}\s*\d{5}(-\d{4})?\b"),
]

# The enhanced rule detector (definitions first, then additions).
ENHANCED = [
    *_all("enhanced", "person_name", 0.7, r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\b", ignore_case=True, space="pii"),
    *_all("enhanced", "email", 0.7, EMAIL, ignore_case=True, space="pii"),
    *_all("enhanced", "phone", 0.7, r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\b\+\d{1,3}[-.\s]?\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b", ignore_case=True, space="pii"),
    *_all(
        "enhanced", "credit_card", 0.7, r"\b4[0-9]{12}(?:[0-9]{3})?\b", r"\b5[1-5][0-9]{14}\b", r"\b3[47][0-9]{13}\b", r"\b6(?:011|5[0-9]{2})[0-9]{12}\b",
        r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|6(?:011|5[0-9]{2})|3[47][0-9]{2})[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", ignore_case=True, space="pii",
    ),
    *_all("enhanced", "bank_account", 0.7, ACCOUNT, ignore_case=True, space="pii"),
    *_all("enhanced", "ssn", 0.7, *SSN, ignore_case=True, space="pii"),
    *_all("enhanced", "passport", 0.7, PASSPORT, ignore_case=True, space="pii"),
    *_all("enhanced", "drivers_license", 0.7, r"\b[A-Z][0-9]{7}\b", r"\b[A-Z]{1,2}[0-9]{4,7}\b", ignore_case=True, space="pii"),
    *_all("enhanced", "health_insurance_id", 0.7, r"\b[A-Z0-9]{6,12}\b", ignore_case=True, space="pii"),
    *_all("enhanced", "ip_address", 0.7, IPV4, r"\b([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}\b", ignore_case=True, space="pii"),
    *_all("enhanced", "date_of_birth", 0.7, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b", ignore_case=True, space="pii"),
    *_all("enhanced", "url", 0.7, URL, ignore_case=True, space="pii"),
    *_all("enhanced", "credit_card", 0.95, r"(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})", space="pii"),
    *_all("enhanced", "credit_card", 0.92, r"(?:4[0-9]{3}|5[1-5][0-9]{2}|6(?:011|5[0-9]{2})|3[47][0-9]{2})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", space="pii"),
    *_all("enhanced", "passport", 0.9, r"\b[A-Z][0-9]{8}\b", space="pii"),
    *_all("enhanced", "passport", 0.85, PASSPORT, space="pii"),
    *_all("enhanced", "drivers_license", 0.85, r"\b[A-Z][0-9]{7}\b", space="pii"),
    *_all(
        "enhanced", "date", 0.85, r"\b(0?[1-9]|1[0-2])[\/\-\.](0?[1-9]|[12][0-9]|3[01])[\/\-\.](19|20)\d{2}\b", r"\b(0?[1-9]|[12][0-9]|3[01])[\/\-\.](0?[1-9]|1[0-2])[\/\-\.](19|20)\d{2}\b",
        r"\b(19|20)\d{2}[\/\-\.](0?[1-9]|1[0-2])[\/\-\.](0?[1-9]|[12][0-9]|3[01])\b", space="pii",
    ),
    *_all(
        "enhanced", "date_of_birth", 0.95, r"\b(?:DOB|Date\s+of\s+Birth)[:;\s]+(0?[1-9]|1[0-2])[\/\-\.](0?[1-9]|[12][0-9]|3[01])[\/\-\.](19|20)\d{2}\b",
        r"\b(?:DOB|Date\s+of\s+Birth)[:;\s]+(0?[1-9]|[12][0-9]|3[01])[\/\-\.](0?[1-9]|1[0-2])[\/\-\.](19|20)\d{2}\b", space="pii",
    ),
    *_all("enhanced", "bank_account", 0.7, ACCOUNT, space="pii"),
    *_all("enhanced", "iban", 0.9, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}([A-Z0-9]?){0,16}\b", space="pii"),
    *_all("enhanced", "ip_address", 0.95, r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", IPV6, space="pii"),
    *_all("enhanced", "url", 0.95, URL, space="pii"),
    *_all("enhanced", "gps_coordinates", 0.9, r"\b[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)\b", space="pii"),
]
DENSE_TYPES = ("person_name", "health_insurance_id")  # their patterns match almost every word

# Labelled medical identifiers.
HEALTHCARE = [
    *_all("healthcare", "medical_record_number", 0.9, r"\bMRN\s*[:#]?\s*(\d{5,10})\b", r"\bMedical Record\s*[:#]?\s*(\d{5,10})\b", r"\bRecord\s*[:#]?\s*(\d{5,10})\b", ignore_case=True, group=1, space="pii"),
    *_all(
        "healthcare", "health_insurance_id", 0.85, r"\bInsurance ID\s*[:#]?\s*([A-Z0-9]{6,15})\b", r"\bPolicy\s*[:#]?\s*([A-Z0-9]{6,15})\b", r"\bGroup\s*[:#]?\s*([A-Z0-9]{5,10})\b", r"\bMember ID\s*[:#]?\s*([A-Z0-9]{6,15})\b",
        r"\bBCBS\s*[:#]?\s*([A-Z0-9]{6,15})\b", r"\bMedicare\s*[:#]?\s*([0-9]{6,12})\b", r"\bMedicaid\s*[:#]?\s*([0-9]{6,12})\b", ignore_case=True, group=1, space="pii",
    ),
    *_all("healthcare", "patient_id", 0.9, r"\bPatient ID\s*[:#]?\s*([A-Z0-9]{5,15})\b", r"\bPatient\s*[:#]?\s*([A-Z0-9]{5,10})\b", r"\bPT\s*[:#]?\s*([A-Z0-9]{5,10})\b", ignore_case=True, group=1, space="pii"),
    *_all("healthcare", "custom", 0.85, r"\b[A-Z]\d{2}\.\d{1,2}\b", ignore_case=True, space="pii", subtype="diagnosis_code"),
    *_all("healthcare", "custom", 0.85, r"\bICD-10\s*:?\s*([A-Z]\d{2}\.\d{1,2})\b", r"\bDiagnosis\s*:?\s*([A-Z]\d{2}\.\d{1,2})\b", r"\bDX\s*:?\s*([A-Z]\d{2}\.\d{1,2})\b", ignore_case=True, group=1, space="pii", subtype="diagnosis_code"),
]

# Labelled financial identifiers.
FINANCIAL = [
    *_all("financial", "credit_card", 0.95, r"\bCVV\s*:?\s*(\d{3,4})\b", r"\bCVC\s*:?\s*(\d{3,4})\b", r"\bSecurity Code\s*:?\s*(\d{3,4})\b", ignore_case=True, group=1, space="pii", subtype="cvv"),
    *_all("financial", "credit_card", 0.9, r"\bExpir(?:y|ation)(?:\s+Date)?\s*:?\s*(\d{2}[/\s.-]\d{2,4})\b", r"\bExp\s*:?\s*(\d{2}[/\s.-]\d{2,4})\b", ignore_case=True, group=1, space="pii", subtype="expiration_date"),
    *_all("financial", "bank_account", 0.9, r"\bAccount\s*[:#]?\s*(\d{6,17})\b", r"\bAcct\s*[:#]?\s*(\d{6,17})\b", ignore_case=True, group=1, space="pii"),
    *_all("financial", "custom", 0.95, r"\bRouting\s*[:#]?\s*(\d{9})\b", r"\bABA\s*[:#]?\s*(\d{9})\b", ignore_case=True, group=1, space="pii", subtype="routing_number"),
    *_all("financial", "custom", 0.95, r"\bSWIFT\s*:?\s*([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", r"\bBIC\s*:?\s*([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", ignore_case=True, group=1, space="pii", subtype="swift_code"),
    *_all("financial", "iban", 0.95, r"\bIBAN\s*:?\s*([A-Z]{2}\d{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,16}))\b", r"\b([A-Z]{2}\d{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,16}))\b", ignore_case=True, group=1, space="pii"),
    *_all("financial", "crypto_address", 0.9, r"\b(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}\b", space="pii", subtype="bitcoin"),
    *_all("financial", "crypto_address", 0.9, r"\b0x[a-fA-F0-9]{40}\b", space="pii", subtype="ethereum"),
    *_all("financial", "crypto_address", 0.9, r"\br[a-zA-Z0-9]{24,34}\b", space="pii", subtype="ripple"),
    *_all("financial", "crypto_address", 0.9, r"\b[LM][a-km-zA-HJ-NP-Z1-9]{26,33}\b", space="pii", subtype="litecoin"),
    *_all("financial", "tax_id", 0.9, r"\bEIN\s*:?\s*(\d{2}-\d{7})\b", r"\bTax ID\s*:?\s*(\d{2}-\d{7})\b", r"\bTIN\s*:?\s*(\d{9})\b", ignore_case=True, group=1, space="pii"),
]

# The simple four-pattern detector.
SIMPLE = [
    *_all("simple", "email", 0.9, EMAIL, ignore_case=True),
    *_all("simple", "phone", 0.9, r"\b\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b", ignore_case=True),
    *_all("simple", "ssn", 0.9, r"\b\d{3}-?\d{2}-?\d{4}\b", ignore_case=True),
    *_all("simple", "credit_card", 0.9, r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", ignore_case=True),
]

# Own rule equivalents of the honorific and institution patterns of an entity ruler.
RULER = [
    *_all("spacy_patterns", "person", 0.75, r"\b(?:[Mm]r|[Mm]rs|[Dd]r)\.? [A-Z][a-z]+\b"),
    *_all("spacy_patterns", "organization", 0.75, r"\b[A-Z][a-z]+ (?:[Uu]niversity|[Cc]ollege|[Ii]nc)\b"),
]


@dataclass(frozen=True)
class Definition:
    """A knowledge-base entry."""

    entity_type: str
    name: str
    patterns: tuple[str, ...]
    keywords: tuple[str, ...]
    sensitivity: str
    examples: tuple[str, ...] = ()
    description: str = ""


# The default knowledge base.
KNOWLEDGE = [
    Definition("person", "Person Name", (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",), ("name", "person", "individual", "mr", "mrs", "ms", "dr", "prof"), "high", ("John Smith", "Dr. Sarah Johnson", "Mr. Robert Brown")),
    Definition("email", "Email Address", (EMAIL,), ("email", "e-mail", "contact", "address"), "high", ("john@example.com", "sarah.johnson@company.org")),
    Definition("phone", "Phone Number", (r"\b\d{3}-\d{3}-\d{4}\b", r"\b\(\d{3}\)\s?\d{3}-\d{4}\b", r"\b\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"), ("phone", "telephone", "mobile", "cell", "contact", "number"), "medium", ("555-123-4567", "(555) 123-4567", "+1 555 123 4567")),
    Definition("ssn", "Social Security Number", SSN[:2], ("ssn", "social security", "social security number"), "critical", ("123-45-6789", "123 45 6789")),
    Definition("credit_card", "Credit Card Number", (r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b"), ("credit card", "debit card", "card number", "payment"), "critical", ("4532 1234 5678 9012", "5555 5555 5555 4444")),
    Definition("organization", "Organization Name", (r"\b[A-Z][a-zA-Z\s&,.-]+(?:Inc|LLC|Corp|Company|Ltd|University|College)\b",), ("company", "organization", "corporation", "institute", "university"), "low", ("Acme Corporation", "State University", "ABC Company Inc.")),
    Definition("address", "Physical Address", (r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)\b",), ("address", "street", "avenue", "road", "location"), "medium", ("123 Main Street", "456 Oak Avenue")),
    Definition("date", "Date Information", (r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"), ("date", "birth", "birthday", "born", "created", "expires"), "medium", ("01/15/1990", "2023-12-25", "January 1, 2023")),
    Definition("ip_address", "IP Address", (IPV4,), ("ip", "address", "server", "network"), "medium", ("192.168.1.1", "10.0.0.1")),
    Definition("url", "URL/Website", (r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*)?",), ("url", "website", "link", "http", "https"), "low", ("https://example.com", "http://internal.company.com")),
]
SENSITIVITY_BOOST = {"low": 0.0, "medium": 0.1, "high": 0.15, "critical": 0.2}

# Base risks by entity type; anything else is medium.
RISK = {
    "ssn": "critical", "credit_card": "critical", "pan": "critical", "phone": "high", "email": "high", "person": "high", "address": "medium", "organization": "low",
    "date": "medium", "location": "low", "ip_address": "medium", "url": "low", "iban": "critical", "custom": "medium",
}
RISK_BELOW = {"critical": "high", "high": "medium", "medium": "low", "low": "low"}

# Frameworks with their types, and the strategies they ask for.
FRAMEWORKS = {
    "GDPR": ("person_name", "email", "phone", "address", "ip_address", "date_of_birth", "passport", "drivers_license"),
    "HIPAA": ("person_name", "phone", "email", "address", "ssn", "health_insurance_id", "medical_record_number", "patient_id", "date_of_birth"),
    "PCI_DSS": ("credit_card", "bank_account", "person_name"),
    "CCPA": ("person_name", "email", "phone", "address", "ssn", "drivers_license"),
}
REQUIRED_STRATEGIES = {
    ("GDPR", "person_name"): ("partial_mask", "pseudonymization"),
    ("GDPR", "email"): ("partial_mask",),
    ("GDPR", "phone"): ("partial_mask",),
    ("GDPR", "passport"): ("partial_mask", "full_mask"),
    ("HIPAA", "health_insurance_id"): ("full_mask", "tokenization"),
    ("HIPAA", "patient_id"): ("full_mask", "tokenization"),
    ("HIPAA", "medical_record_number"): ("full_mask",),
    ("PCI_DSS", "credit_card"): ("partial_mask",),
    ("PCI_DSS", "bank_account"): ("partial_mask", "tokenization"),
}

# Words that make a context doubtful, and words that are no names.
NEGATIONS = ("not", "fake", "example", "test", "dummy", "sample")
COMMON_WORDS = ("the", "and", "or", "but", "in", "on", "at", "to", "for")
GENERAL_LABELS = {
    "person_name": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE NUMBER]", "address": "[ADDRESS]", "credit_card": "[PAYMENT CARD]", "ssn": "[SSN]",
    "passport": "[PASSPORT]", "drivers_license": "[DRIVER'S LICENSE]", "date_of_birth": "[DOB]", "bank_account": "[BANK ACCOUNT]",
}
BLOCKED_DOMAINS = ("example.com", "test.com", "domain.com")

# Labels of tagging models, of an entity ruler, of the knowledge base and of context words, as types.
MODEL_LABELS = {
    "PERSON": "person", "PER": "person", "ORGANIZATION": "organization", "ORG": "organization", "LOCATION": "location", "LOC": "location", "GPE": "location", "DATE_TIME": "date", "DATE": "date",
    "EMAIL_ADDRESS": "email", "EMAIL": "email", "PHONE_NUMBER": "phone", "PHONE": "phone", "CREDIT_CARD": "credit_card", "IBAN_CODE": "iban", "IP_ADDRESS": "ip_address", "URL": "url", "US_SSN": "ssn", "SSN": "ssn",
    "US_PASSPORT": "custom", "PASSPORT": "custom", "US_DRIVER_LICENSE": "custom", "DRIVER_LICENSE": "custom", "MEDICAL_LICENSE": "custom", "CRYPTO": "custom", "NRP": "custom",
}
RULER_LABELS = {"PERSON": "person", "ORG": "organization", "GPE": "location", "LOC": "location", "DATE": "date", "TIME": "date", "MONEY": "custom", "PERCENT": "custom"}
OWN_MODEL_LABELS = {"PII": "custom", "SENSITIVE": "custom", "PERSONAL": "person", "FINANCIAL": "credit_card", "CONTACT": "email", "IDENTIFIER": "ssn"}
KNOWLEDGE_TYPES = ("person", "email", "phone", "ssn", "credit_card", "organization", "address", "date", "ip_address", "url", "pan", "iban")
CONTEXT_TYPES = {"name": "person", "email": "email", "phone": "phone", "address": "address", "contact": "person"}

# Tokens that make an entity likely, within three tokens of it, and words of addresses.
INDICATORS = {
    "PERSON": ("mr", "mrs", "ms", "dr", "prof", "ceo", "manager", "director"),
    "ORG": ("inc", "llc", "corp", "company", "ltd", "university", "college"),
    "GPE": ("in", "at", "from", "to", "near", "city", "state", "country"),
    "LOC": ("in", "at", "from", "to", "near", "city", "state", "country"),
}
ADDRESS_WORDS = ("street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "lane", "ln", "drive", "dr", "suite", "apt", "floor")

DETECTORS = {"enhanced": ENHANCED, "healthcare": HEALTHCARE, "financial": FINANCIAL, "rule_based": LEGACY, "simple": SIMPLE, "ruler": RULER}


def knowledge_patterns(definitions=None) -> list[Pattern]:
    return [Pattern("rag", d.entity_type, r, 0.7 + SENSITIVITY_BOOST.get(d.sensitivity, 0.0), ignore_case=True) for d in (definitions or KNOWLEDGE) for r in d.patterns]
