"""Types, levels and record layouts shared by all operators."""

from __future__ import annotations

# Types of findings with the priority that decides between equally long ones.
PRIORITY = {
    "CARD": 100, "SNILS": 95, "INN": 90, "PHONE": 85, "PASSPORT": 80, "FOREIGN_PASSPORT": 78, "DRIVER_LICENSE": 75, "RESIDENCE_PERMIT": 72, "BIRTH_CERT": 70,
    "MILITARY_ID": 68, "DEPT_CODE": 65, "DOB": 60, "ISSUE_DATE": 58, "ACCOUNT": 55, "OMS": 54, "PLATE": 53, "VIN": 52, "IP_ADDRESS": 51, "POSTCODE": 50,
    "BIRTH_PLACE": 46, "ADDRESS": 45, "ISSUER": 42, "FIO": 35, "CARDHOLDER": 30, "CITIZENSHIP": 25, "EMAIL": 20, "CVV": 15, "PIN": 14,
}
MANDATORY = ("FIO", "DOB", "BIRTH_PLACE", "PASSPORT", "CITIZENSHIP", "ISSUER", "DEPT_CODE", "ISSUE_DATE", "DRIVER_LICENSE", "ADDRESS", "POSTCODE", "EMAIL", "PHONE", "INN", "CARD", "CVV", "PIN", "CARDHOLDER")
DOCUMENT = ("SNILS", "FOREIGN_PASSPORT", "RESIDENCE_PERMIT", "BIRTH_CERT", "MILITARY_ID")
EXTRA = ("ACCOUNT", "OMS", "PLATE", "VIN", "IP_ADDRESS")
ALL_TYPES = MANDATORY + DOCUMENT + EXTRA
# Levels of confidence.
LOW, MEDIUM, ANCHORED, HIGH, CERTAIN = 0.4, 0.6, 0.75, 0.9, 1.0

SPAN = "struct<start:int,end:int,type:string,conf:double,reason:string>"
SPANS = f"array<{SPAN}>"


def tier(name: str) -> str:
    """mandatory, document, extra, or custom for a type of the user's own."""
    return "mandatory" if name in MANDATORY else "document" if name in DOCUMENT else "extra" if name in EXTRA else "custom"
