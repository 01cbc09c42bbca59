"""Archived pages for offline reading: addresses become archive look-ups, scripts cannot run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICY = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; img-src data: blob:; style-src 'unsafe-inline' data: blob:; font-src data: blob:; media-src data: blob:\">"


def rewritten(html: str | Column) -> Column:
    """Page with link and source attributes moved to data-archive ones, base and refresh removed, and a closed content policy first in its head."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?i)<base\b[^>]*>", "")
    h = F.regexp_replace(h, r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>", "")
    h = F.regexp_replace(h, r"(?i)(<[a-z][^>]*?\s)(href|src|srcset|poster|action)(\s*=)", "$1data-archive-$2$3")
    return F.regexp_replace(h, r"(?i)<head\b([^>]*)>", "<head$1>" + POLICY.replace("$", "\\$"))
