"""Words that a text must hold for a pattern to match, read off the pattern.

A sequence needs the words of each of its parts, so the best part is taken: the one
whose shortest word is longest. A choice needs one word of each branch, a repetition
one only if it cannot be empty. Everything else asks for nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: A shorter word is found in nearly all texts.
LEAST_LENGTH = 3
_ESCAPED_LITERAL = re.compile(r"\\[^A-Za-z0-9]")
_REPEAT = re.compile(r"[*+?]|\{(\d+)(?:,\d*)?\}")
_GROUP = re.compile(r"\((?:\?(?:[imsux-]*:|[>]))?")


def ignores_case(pattern: str) -> bool:
    return re.match(r"\(\?[a-z]*i[a-z]*\)", pattern) is not None


class _Reader:
    """Reads a pattern once from left to right. ``choice`` and ``sequence`` return a
    set of words of which each match holds one, or None."""

    def __init__(self, pattern: str) -> None:
        self.pattern = re.sub(r"\A\(\?[a-z]+\)", "", pattern)
        self.at = 0

    def rest(self) -> str:
        return self.pattern[self.at :]

    def choice(self) -> frozenset[str] | None:
        branches = [self.sequence()]
        while self.rest().startswith("|"):
            self.at += 1
            branches.append(self.sequence())
        return None if None in branches else frozenset().union(*branches)

    def sequence(self) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""

        def end_run() -> None:
            nonlocal run
            if run:
                found.append(frozenset({run}))
            run = ""

        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            literal, words = self.atom()
            times = _REPEAT.match(self.pattern, self.at)
            if times:
                self.at = times.end()
                if self.rest()[:1] in ("?", "+"):
                    self.at += 1
                needed = times[0] == "+" or times[0][0] == "{" and int(times[1]) > 0
                end_run()
                if needed:
                    words = words or (frozenset({literal}) if literal else None)
                    if words:
                        found.append(words)
            elif literal is not None:
                run += literal
            else:
                end_run()
                if words:
                    found.append(words)
        end_run()
        return max(found, key=lambda ws: (min(map(len, ws)), -len(ws)), default=None)

    def atom(self) -> tuple[str | None, frozenset[str] | None]:
        """The next atom: its literal character, or the words that it needs."""
        p, at = self.pattern, self.at
        if p[at] == "\\":
            self.at += 2
            return (p[at + 1], None) if _ESCAPED_LITERAL.match(p, at) else (None, None)
        if p[at] == "[":
            self.at += 1
            if self.rest().startswith("^"):
                self.at += 1
            if self.rest().startswith("]"):
                self.at += 1
            while self.pattern[self.at] != "]":
                self.at += 2 if self.pattern[self.at] == "\\" else 1
            self.at += 1
            return None, None
        if p[at] == "(":
            plain = _GROUP.match(p, at)
            looks = re.compile(r"\(\?<?[=!]").match(p, at)
            self.at = (looks or plain).end()
            words = self.choice()
            self.at += 1
            return None, None if looks else words
        self.at += 1
        return (None, None) if p[at] in ".^$" else (p[at], None)


@lru_cache
def required(pattern: str) -> tuple[str, ...]:
    """Words of which every match holds one; none if the pattern asks for none.
    In lower case if the pattern ignores case."""
    words = _Reader(pattern).choice()
    if not words or min(map(len, words)) < LEAST_LENGTH:
        return ()
    return tuple(sorted({w.lower() if ignores_case(pattern) else w for w in words}))
