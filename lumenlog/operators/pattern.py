"""Phrase patterns: literals with ``*``, ``?`` and ``{captures}``, compiled to one regular expression.

Matching never backtracks: each literal is taken at its first place after the
last one, which atomic groups express. A leading literal may stand anywhere; a
leading capture or ``?`` starts at the line's beginning; a pattern need not reach
the line's end. ``{name:type}`` converts: ``number`` rejects lines that don't
parse, ``time`` and date formats give the least date instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lumenlog.errors import QueryError
from lumenlog.operators.tokens import MIN_TOKEN, Token, bounded, quote, tokenize

SPECIAL = "*?{"
ESCAPABLE = "{*\\?}"


@dataclass(frozen=True)
class Capture:
    name: str
    kind: str  # string, number, time or a date format
    group: int


@dataclass
class Pattern:
    source: str
    regex: str = ""
    captures: list[Capture] = field(default_factory=list)
    #: Regular expressions that a line's tokens must satisfy, and literals that each must contain.
    token_tests: list[str] = field(default_factory=list)
    needles: list[str] = field(default_factory=list)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, text): literal, star, any, capture."""
    out: list[tuple[str, str]] = []
    text, at = "", 0

    def flush() -> None:
        nonlocal text
        if text:
            out.append(("literal", text))
            text = ""

    while at < len(source):
        c = source[at]
        if c == "\\":
            if at + 1 >= len(source) or source[at + 1] not in ESCAPABLE:
                raise QueryError(f"bad escape at {at} in pattern {source!r}")
            text += source[at + 1]
            at += 2
            continue
        if c not in SPECIAL:
            text += c
            at += 1
            continue
        flush()
        if c == "{":
            end = source.find("}", at)
            if end < 0:
                raise QueryError(f"unclosed capture in pattern {source!r}")
            body = source[at + 1 : end]
            if not body.split(":", 1)[0].strip():
                raise QueryError(f"unnamed capture in pattern {source!r}")
            out.append(("capture", body))
            at = end + 1
        else:
            out.append(("star" if c == "*" else "any", c))
            at += 1
    flush()
    for (kind, _), (following, _) in zip(out, out[1:]):
        if kind in ("star", "capture") and following != "literal":
            raise QueryError(f"a wildcard or capture must be followed by text in pattern {source!r}")
    return out


def compile_pattern(source: str) -> Pattern:
    p = Pattern(source)
    pieces = _pieces(source)
    parts: list[str] = []
    anchored = bool(pieces) and pieces[0][0] in ("capture", "any")
    at = 0
    while at < len(pieces):
        kind, text = pieces[at]
        following = pieces[at + 1][1] if at + 1 < len(pieces) and pieces[at + 1][0] == "literal" else None
        last = at + 1 == len(pieces)
        if kind == "literal":
            free = at == 0
            parts.append(f"(?>.*?{quote(text)})" if free else quote(text))
        elif kind == "star":
            if following is not None:
                parts.append(f"(?>.*?{quote(following)})")
                at += 1
        elif kind == "any":
            parts.append(".?" if last else ".")
        else:
            name, _, how = text.partition(":")
            p.captures.append(Capture(name.strip(), how.strip() or "string", len(p.captures) + 1))
            if following is not None:
                parts.append(f"(?>(.*?){quote(following)})")
                at += 1
            else:
                parts.append("(.*)")
        at += 1
    if parts:
        # A free leading literal is found by searching on, from the line's start.
        p.regex = "(?s)^" + "".join(parts)
        if anchored is False and pieces[0][0] == "star" and len(pieces) == 1:
            p.regex = ""
    _token_tests(p, pieces)
    return p


def _token_tests(p: Pattern, pieces: list[tuple[str, str]]) -> None:
    """Tokens of at least MIN_TOKEN characters must be whole tokens of the line, neighbours at their distance."""
    found: list[tuple[Token, bool]] = []
    offset, loose, plain = 0, False, ""
    # The text between stars and captures is cut into tokens as a whole: ``?`` stands for one character.
    runs: list[tuple[str, bool]] = []
    for kind, text in pieces:
        if kind in ("star", "capture"):
            runs.append((plain, loose))
            plain, loose = "", True
        else:
            plain += text
    runs.append((plain, loose))
    for text, after_gap in runs:
        first = True
        for t in tokenize(text):
            if len(t.text) >= MIN_TOKEN:
                found.append((Token(t.text, offset + t.at), after_gap and first))
                first = False
        offset += len(text)
    p.needles = list(dict.fromkeys(t.text for t, _ in found))
    if len(found) == 1:
        p.token_tests = [f"(?s){bounded(found[0][0].text)}"]
    for (a, _), (b, gap) in zip(found, found[1:]):
        between = ".*" if gap else f".{{{b.at - a.at - len(a.text)}}}"
        p.token_tests.append(f"(?s){bounded(a.text)}{between}{bounded(b.text)}")
