"""Grammars of unfilled placeholders, for problems 3 and 6."""

from __future__ import annotations

import re

# The grammars, by delimiter.
GRAMMARS = {
    "double braces": r"\{\{[#/^>!&{]?\s*[A-Za-z_@][^{}\n]*(?:\}\}|$|(?=[\s,!.]))",
    "dollar braces": r"\$\{\s*[A-Za-z_][\w.]*(?:[:|?][^{}\n]*)?\s*\}",
    "hash braces": r"#\{\s*[A-Za-z_@][^{}\n]*\}",
    "numbered braces": r"(?<![\w{$#\\])\{\d{1,2}\}(?!\})",
    "named braces": r"(?<![\w{$#%\\`])\{(?:[a-z][a-z_]{2,}|[A-Z][A-Z0-9_]{2,})\}(?![}\w])",
    "percent tags": r"<%[=#-]?[^%\n]*%>",
    "brace tags": r"\{%-?\s[^%\n]*%\}",
    "double percent": r"%%[A-Za-z_]\w*%%",
    "percent": r"(?<![%\w])%[A-Z][A-Z0-9_]+%(?![%\w])",
    "double at": r"@@[A-Za-z_][\w.]*@@",
    "double tilde": r"~~[A-Z][A-Z0-9_]{2,}~~",
    "underscores": r"(?<![_\w])__(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|TITLE|NAME|DATE|AUTHOR|URL|CONTENT|BODY|TEXT|EMAIL|COMPANY|SITE)__(?![_\w])",
    "double brackets": r"(?<!\[)\[\[\s*(?:[a-z_][a-z0-9_.:]*|[A-Z][A-Z0-9_]{2,})\s*\]\](?![(\]])",
    "request in brackets": r"\[(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|ADD|Add)\b[^\[\]\n]*\](?!\()",
    "request in angles": r"<(?:YOUR|Your|INSERT|Insert|ENTER|Enter)[ _-][^<>\n]+>",
}
PLACEHOLDER = re.compile("|".join(GRAMMARS.values()))
#: A quick test before the grammars.
OPENER = re.compile(r"[{%]|@@|~~|__|\[\[|\[[IiYyEeAa]|<[YyIiEe%]")


def opens(row: str) -> bool:
    """Whether a placeholder may stand in a line."""
    return ("{" in row or "%" in row or "[" in row or "<" in row or "__" in row or "@@" in row or "~~" in row) and OPENER.search(row) is not None
