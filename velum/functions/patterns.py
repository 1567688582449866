"""Patterns of the finders.

``\\d`` and ``\\s`` of the original definitions cover all Unicode digits and blanks,
so the classes are spelt out: the JVM's short forms are ASCII only. The JVM forms
are also rewritten where a backtracking matcher would need deep stacks or quadratic
time on long junk; a rewritten form has the same matches.
"""

from __future__ import annotations

import re
import sys
import unicodedata

DIGIT = r"\p{Nd}"

# Members of the blank class, for use between brackets.
BLANK = r" \p{IsWhite_Space}\x{1c}-\x{1f}"

# All decimal digits beyond ASCII and, at the same index, their ASCII form.
_OTHER_DIGITS = [
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
]
OTHER_DIGITS = "".join(_OTHER_DIGITS)
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)

# What a telephone number, a zip code, a fiscal code, an age, a date
# and an e-mail address look like.


def telephone(blank: str) -> str:
    prefix = rf"(\(?(?:\+|00)\(?{DIGIT}{{2,3}}\)?)[{blank}\-.\\]?"
    gap = rf"[{blank}\-./\\]?"
    return (
        rf"(?:{prefix})?("
        rf"(?:3{DIGIT}{{2}}{gap}{DIGIT}{{7}})|"
        rf"(?:0{DIGIT}{gap}{DIGIT}{{8}})|"
        rf"(?:0{DIGIT}{{2}}{gap}{DIGIT}{{5,7}})|"
        rf"(?:0{DIGIT}{{3}}{gap}{DIGIT}{{5,6}}))"
    )


ZIP_CODE = r"\P{Nd}[0-9]{5}\P{Nd}"
FISCAL_CODE = rf"[A-Z]{{6}}{DIGIT}{{2}}[A-Z]{DIGIT}{{2}}[A-Z]{DIGIT}{{3}}[A-Z]"
_MONTH = (
    "gen(?:naio)?|feb(?:braio)?|mar(?:zo)?|apr(?:ile)?|mag(?:gio)|giu(?:gno)?|"
    "lug(?:lio)?|ago(?:sto)?|set(?:tembre)?|ott(?:obre)?|nov(?:embre)?|dic(?:embre)?"
)
DATE_SEPARATOR = r"[\-\x20/.]"
DATE = (
    rf"(?:{DIGIT}{{1,4}}{DATE_SEPARATOR})?({DIGIT}{{1,2}}|(?:{_MONTH})){DATE_SEPARATOR}{DIGIT}{{1,4}}"
)


def age(blank: str) -> str:
    return rf"({DIGIT}+)[{blank}]*anni|anni[{blank}]*({DIGIT}+)"


def email(blank: str) -> str:
    return rf"[^{blank}@]+@([^{blank}@.,]+\.)+[^{blank}@.,]{{2,}}"


# JVM forms. Possessive quantifiers run in a loop without backtracking; a leading
# look-ahead lets most start positions fail on cheap character tests, and classes
# name their frequent members first because they are tested in order.
_ANY_DIGIT = rf"[0-9{DIGIT}]"
JVM_TELEPHONE = rf"(?=[(+03]){telephone(BLANK)}"
JVM_ZIP_CODE = r"[ a-z\P{Nd}][0-9]{5}\P{Nd}"
JVM_FISCAL_CODE = FISCAL_CODE
JVM_DATE = rf"(?i)(?=[gfmalsond][eapiugto][nbrguotvc]|{_ANY_DIGIT}){DATE}"
# The first digit of a run is the only start that can match, and the run is
# never given back.
JVM_AGE = rf"(?i)(?<!{DIGIT}){DIGIT}++[{BLANK}]*+anni|(?i)anni[{BLANK}]*+{DIGIT}++"
# A match ends with the last label of two or more characters, so the host is one
# label and then groups of (one-character labels, longer label). A local part
# can only start where its run of characters does, or right after a match.
_LOCAL = f"[^{BLANK}@]"
_HOST = f"[^{BLANK}@.,]"
_HOST_PART = rf"@{_HOST}++(?:(?:\.{_HOST}(?!{_HOST}))*+\.{_HOST}{_HOST}++)++"
JVM_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++{_HOST_PART}"

# Cheaper patterns: the first is found in exactly the texts with an e-mail, the
# others in every text with a match.
GATE_EMAIL = f"{_LOCAL}{_HOST_PART}"
GATE_ZIP_CODE = "[0-9]{5}"
GATE_DATE = DATE_SEPARATOR + _ANY_DIGIT
GATE_AGE = "(?i)anni"

# Members of the class of characters that each match has one of, for use between brackets.
_DIGITS = f"0-9{DIGIT}"
NEEDED = {
    "telephone": _DIGITS,
    "zipcode": _DIGITS,
    "email": "@",
    "fiscal_code": _DIGITS,
    "date": _DIGITS,
    "age": _DIGITS,
}

# RE2 forms, for Arrow. RE2 runs in linear time, so the plain patterns do. Classes are spelt out,
# and so are both cases of letters, which in RE2 could also be letters beyond ASCII. Texts
# of ASCII alone have the same matches with short classes.


def _spelt(members: list[int]) -> str:
    """Ranges of a class, for use between brackets."""
    ends = [c for c in members if c + 1 not in members]
    starts = [c for c in members if c - 1 not in members]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


def _re2(digits: str, blank: str) -> dict[str, str]:
    def spelt(pattern: str, both_cases: bool = False) -> str:
        pattern = pattern.replace(DIGIT, "\0")
        if both_cases:
            pattern = re.sub(r"(?<!\\)[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)
        return pattern.replace("\0", f"[{digits}]")

    return {
        "telephone": spelt(telephone("\1")).replace("\1", blank),
        "zipcode": f"[^{digits}][0-9]{{5}}[^{digits}]",
        "email": email(blank),
        "fiscal_code": spelt(FISCAL_CODE),
        "date": spelt(DATE, both_cases=True),
        "age": spelt(age("\1"), both_cases=True).replace("\1", blank),
    }


_BLANKS = sorted([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                  0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
RE2 = _re2("0-9" + _spelt([ord(c) for c in _OTHER_DIGITS]), _spelt(_BLANKS))
RE2_ASCII = _re2("0-9", _spelt([c for c in _BLANKS if c < 0x80]))

INLINE_TAG = r"<([^<>]*)>#*"
