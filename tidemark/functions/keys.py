"""Canonical keys on the driver, for arguments of queries; the Column form is functions.text.canonical_key."""

from __future__ import annotations

import re
import unicodedata


def canonical_key_of(value: str | None) -> str:
    """Compatibility form, no accents, lower case, runs of other characters one blank."""
    flat = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", value or ""))
    plain = "".join(c for c in flat if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()
