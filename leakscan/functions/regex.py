"""Translate rule regexes from the RE2 dialect to Java's.

Rules are written once for both dialects. Constructs RE2 has no notion of are
refused, and the few that mean something else in Java are rewritten.
"""

from __future__ import annotations

import re

_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NOT_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_SPACE = r"\t\n\f\r "
_FORBIDDEN = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|(?<!\\)[*+?}]\+")
# flags, a boundary, one character or class that must be there, and how often it may be
_BEGINNING = re.compile(r"(?P<flags>(?:\(\?[a-z]+\))*)(?P<boundary>" + re.escape(_BOUNDARY) + r")?(?P<atom>[0-9A-Za-z_]|\[(?:\\.|[^\]\\])+\])(?![*?]|\{0)(?P<more>\+\??)?")


class RuleError(ValueError):
    """A rule table that must not be loaded."""


def to_java(pattern: str, loose: bool = False) -> str:
    """The Java form of an RE2 pattern; raises :class:`RuleError` if there is none.

    ``loose`` leaves word boundaries out: cheaper, and true for every text the
    full pattern matches.
    """
    if not pattern:
        raise RuleError("empty regex")
    if _FORBIDDEN.search(pattern):
        raise RuleError(f"look-around, back-reference or possessive quantifier: {pattern!r}")
    out: list[str] = []
    in_class = False
    multiline = bool(re.search(r"\(\?[a-zA-Z]*m", pattern))
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        two = pattern[i : i + 2]
        if ch == "\\":
            i += 2
            if two == r"\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif two == r"\S" and not in_class:
                out.append(f"[^{_SPACE}]")
            elif two == r"\b" and not in_class:
                out.append("" if loose else _BOUNDARY)
            elif two == r"\B" and not in_class:
                out.append("" if loose else _NOT_BOUNDARY)
            else:
                out.append(two)
            continue
        if in_class:
            if pattern[i : i + 2] == "[:":
                end = pattern.find(":]", i)
                if end < 0:
                    raise RuleError(f"unfinished class name: {pattern!r}")
                name = pattern[i + 2 : end]
                prop = {"word": "w", "alpha": "p{Alpha}", "digit": "d", "alnum": "p{Alnum}",
                        "upper": "p{Upper}", "lower": "p{Lower}", "xdigit": "p{XDigit}",
                        "punct": "p{Punct}", "space": "s"}.get(name)
                if prop is None:
                    raise RuleError(f"unknown class name {name!r}")
                out.append("\\" + prop)
                i = end + 2
                continue
            span = re.match(r"[a-zA-Z0-9]-[a-zA-Z0-9](?!-)", pattern[i:])
            if span and span.group()[0] <= span.group()[2]:
                # Java looks single characters up in one table but tests ranges one by one
                out.append("".join(map(chr, range(ord(pattern[i]), ord(pattern[i + 2]) + 1))))
                i += 3
                continue
            if ch == "[" or two == "&&":
                out.append("\\")
            in_class = ch != "]"
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif ch == "$" and not multiline:
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return "(?d)" + _with_cheap_beginning("".join(out), loose)


def _with_cheap_beginning(java: str, loose: bool) -> str:
    """The same regex with the first character tested before a boundary, which takes Java ten times as long.

    Where only the answer counts, a first ``x+`` is an ``x``; else each word is read again from each of its letters.
    """
    begin = _BEGINNING.match(java)
    if not begin:
        return java
    flags, boundary, atom, more = (g or "" for g in begin.group("flags", "boundary", "atom", "more"))
    ahead = f"(?={atom})" if boundary else ""
    return flags + ahead + boundary + atom + ("" if loose else more) + java[begin.end():]


def required_literal(pattern: str) -> str:
    """A literal every match contains, or '' if none is obvious.

    Only text outside groups, classes and alternations counts, and of a
    case-insensitive pattern nothing but non-letters.
    """
    anycase = bool(re.search(r"\(\?[a-zA-Z]*i", pattern))
    runs, depth, i = [""], 0, 0
    while i < len(pattern):
        ch, step = pattern[i], 1
        if ch == "[":
            close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            while close > 0 and pattern[close - 1] == "\\":
                close = pattern.find("]", close + 1)
            if close < 0 or "[:" in pattern:
                return ""
            step, ch = close - i + 1, None
        elif ch == "\\":
            step = 2
            ch = pattern[i + 1] if not pattern[i + 1].isalnum() else None
        elif ch == "(":
            depth, ch = depth + 1, None
        elif ch == ")":
            depth, ch = depth - 1, None
        elif ch == "|":
            if depth == 0:
                return ""
            ch = None
        elif ch == "{":
            step, ch = pattern.find("}", i) - i + 1, None
        elif ch in ".^$*+?":
            ch = None
        i += step
        optional = pattern[i : i + 1] in ("?", "*", "{")
        repeated = pattern[i : i + 1] == "+"
        plain = ch is not None and depth == 0 and not optional and not (anycase and ch.isalpha()) and ord(ch) < 128
        if plain:
            runs[-1] += ch
        if not plain or repeated:
            runs.append("")
    return max(runs, key=len)


def quote(literal: str) -> str:
    """``literal`` as a regex that both dialects read the same way."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", literal)
