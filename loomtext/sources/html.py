"""Text of web pages by tag stripping; a fallback where no extractor is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(html: Column) -> Column:
    """Tags become blanks; scripts, styles and comments go; headings and block quotes keep a mark at their start."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<h[1-6]\b[^>]*>", "\n# ")
    out = F.regexp_replace(out, r"(?i)<blockquote\b[^>]*>", "\n> ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t]+", " ")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")
