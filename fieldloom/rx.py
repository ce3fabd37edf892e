"""Regular expression rules with a time limit, and text of an HTML fragment."""

from __future__ import annotations

import html
import re

import regex

FLAGS = regex.IGNORECASE | regex.DOTALL
TIME_LIMIT = 5.0
_SILENT = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<[^>]+>")


def html_to_text(s: str | None) -> str:
    """Text of a fragment: scripts, styles and comments out, a space for every tag, entities decoded, white space collapsed."""
    return " ".join(html.unescape(_TAG.sub(" ", _SILENT.sub(" ", s or ""))).split())


def find_all(text: str, pattern: str, limit: float = TIME_LIMIT) -> list[str]:
    """Matches of a rule: the first group that isn't empty, or the whole match; [] for an invalid pattern or one that exceeds the limit."""
    try:
        re.compile(pattern, re.IGNORECASE | re.DOTALL)
        found = regex.findall(pattern, text or "", flags=FLAGS, timeout=limit)
    except (re.error, regex.error, TimeoutError, OverflowError, RecursionError):
        return []
    first = (next((g for g in m if g), "") if isinstance(m, tuple) else m for m in found)
    return [m for m in first if m]


def values(text: str, pattern: str, kind: str, limit: float = TIME_LIMIT) -> list[str]:
    """What a rule extracts for a field: attribute values as they are, texts without their markup and without blank ones."""
    found = find_all(text, pattern, limit)
    if kind in ("image", "url"):
        return [html.unescape(m).strip() for m in found]
    return [t for t in map(html_to_text, found) if t]
