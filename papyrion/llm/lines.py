"""Lines of captured Markdown and what they are: shared by the operators on page bodies and on residue."""

from __future__ import annotations

import re
import unicodedata

from papyrion.llm import wordings as W
from papyrion.llm.abuse import _INVISIBLE
from papyrion.llm.lookalikes import _FROM, _TO, JOINED

LABELS, SIDEBAR, BYLINES = W.words(W.MENU) | W.words(W.BUTTONS) | W.words(W.TOOLS), W.words(W.SIDEBAR), W.words(W.BYLINES)
BUTTONS = W.words(W.BUTTONS)
NOTICES = W.automaton(W.NOTICES)
MESSAGE_PARTS = W.automaton({"missing": W.MISSING, "fails": W.FAILS, "message": W.MESSAGES, "scripts": W.SCRIPTS, "switched": W.SWITCHED, "error": W.ERROR})
LOADING = W.words(W.LOADING)
FILLER = W.Wordings(W.FILLER)

#: A message is a sentence of at most so many words, or characters in a script without spaces.
MESSAGE_WORDS, MESSAGE_CHARACTERS = 14, 60
_FOLD = {ord(a): b for a, b in zip(_FROM, _TO, strict=True) if not "Ѐ" <= a <= "ӿ" and not "぀" <= a <= "ヿ"} | {ord(k): v for k, v in JOINED.items()} | {ord(c): None for c in _INVISIBLE}
_TO_LATIN = {ord(a): b for a, b in zip(_FROM, _TO, strict=True) if "Ѐ" <= a <= "ӿ"}
_TO_CYRILLIC = {ord(b): a for a, b in zip(_FROM, _TO, strict=True) if "а" <= a <= "я" or "А" <= a <= "Я"}
_TOUCHED = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "̀-゙゚ͯ]")
_MEETING = re.compile(r"[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_MIXED = re.compile(r"\w*(?:[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z])\w*")
_BULLET = re.compile(r"^(?:[-*+•·]|\d+[.)])\s+(?:\[[ xX]\]\s+)?")
#: What a bullet or an item's number begins with; an empty line's beginning is in it too.
_BULLET_SIGNS = "-*+•·0123456789"
_HEADING = re.compile(r"^#{1,6}\s+")
_LINK = re.compile(r"!?\[([^\]\n]*+)\]\(([^)\s]*+)[^)]*+\)")
_WORD = re.compile(r"[^\W\d_]+")
_HAS_TEXT = re.compile(r"[^\W_]")
_STATUS = re.compile(r"^[45]\d\d(?![\w.,]\d)(?=$|[\s:,-])|(?:error|fehler|erreur|ошибка|エラー)[ :]*(?:code[ :]*)?\d+")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")


def _one_script(m: re.Match) -> str:
    """A word of two scripts in the one that most of its letters have."""
    word = m[0]
    return word.translate(_TO_CYRILLIC if sum("Ѐ" <= c for c in word) * 2 > len(word) else _TO_LATIN)


def fold_line(line: str) -> str:
    """A line in one spelling: look-alikes, accents' composition, invisible characters, white space and case."""
    if not line.isascii():
        if _TOUCHED.search(line):
            line = unicodedata.normalize("NFC", line.translate(_FOLD))
        if _MEETING.search(line):
            line = _MIXED.sub(_one_script, line)
    return " ".join(line.split()).lower()


def bare(folded: str) -> str:
    """A folded line without heading, bullet, quote and emphasis marks."""
    t = folded.lstrip("> ")
    if t[:1] == "#":
        t = _HEADING.sub("", t)
    if t[:1] in _BULLET_SIGNS:
        t = _BULLET.sub("", t)
    return t.strip("*_ \t") if t[:1] in "*_" or t[-1:] in "*_" else t


def link_text(text: str) -> str:
    return _LINK.sub(r"\1", text) if "](" in text else text


def latin_filler(folded: str) -> bool:
    """Filler that imitates Latin: most words are from its vocabulary."""
    if W.LATIN.isdisjoint(folded.split()):
        return False
    found = _WORD.findall(folded)
    return len(found) >= 4 and sum(w in W.LATIN for w in found) * 5 >= len(found) * 3


def message(text: str) -> bool:
    """Whether a short folded sentence is an error message or a notice that scripts are needed: a status code, or what is missing and how it fails."""
    if text in LOADING:
        return True
    if text.count(" ") > 3 * MESSAGE_WORDS:
        return False
    roles = {role for _, role in MESSAGE_PARTS.iter(text)}
    if not roles and not text[:1].isdigit():
        return False
    n = len(_WORD.findall(text))
    if n > MESSAGE_WORDS or n == 1 and len(text) > MESSAGE_CHARACTERS:
        return False
    return "message" in roles or {"missing", "fails"} <= roles or {"scripts", "switched"} <= roles or bool(("error" in roles or text[0].isdigit()) and (m := _STATUS.search(text)) and (n <= 6 or m.start() == 0))


def residue_line(folded: str) -> bool:
    """A line that is filler, an error message or a notice that scripts are needed, perhaps with a name before or after."""
    t = link_text(bare(folded))
    if not t:
        return False
    if FILLER.fullmatch(t) or latin_filler(t) or message(t):
        return True
    for sep in (" - ", " | ", ": ", " – "):
        at = t.find(sep, 0, 40 + len(sep))
        if at >= 0 and " " not in t[:at].strip() and (FILLER.fullmatch(rest := t[at + len(sep) :]) or latin_filler(rest) or message(rest)):
            return True
    return False


def metadata_lines(lines: list[str]) -> int:
    """Number of lines of a leading metadata block."""
    if lines and lines[0].strip() == "---":
        for i in range(1, len(lines)):
            if lines[i].strip() == "---":
                return i + 1
        return 0
    n = 0
    while n < len(lines) and lines[n].startswith("- **"):
        n += 1
    return n


def boilerplate(bare: str) -> bool:
    """Whether a line without its bullet is a menu's word, a button, a page tool or a byline."""
    t = bare.strip("*_ \t")
    if t in LABELS:
        return True
    ws = t.replace("：", ": ").replace(":", ": ").split()
    if not 2 <= len(ws) <= 8 or t[-1] in ".!?。":
        return False
    return ws[0].rstrip(":") in BYLINES or f"{ws[0]} {ws[1].rstrip(':')}" in BYLINES


def notice(text: str) -> bool:
    """Whether a line is about what notices and footers are about."""
    return next(NOTICES.iter(text), None) is not None if len(NOTICES) else False


def side_heading(folded: str) -> bool:
    return _HEADING.sub("", folded).strip("*_: \t") in SIDEBAR


def has_text(line: str) -> bool:
    """Whether a line has a letter or digit."""
    return bool(_HAS_TEXT.search(line))
