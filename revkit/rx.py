"""Go RE2 patterns -> Java regex, for use as literal Spark patterns.

Rule patterns are written once in their RE2 form (the form the oracle SQL uses
as is) and translated here, so Spark's Java engine matches the same text:

* ``(?d)`` on every pattern: only ``\\n`` ends a line for ``.``, ``^``, ``$``.
* ``$`` outside ``(?m)`` means end of text in RE2 -> ``\\z``.
* ``\\s`` is ``[\\t\\n\\f\\r ]`` in RE2 (Java adds ``\\x0B``); ``\\S`` likewise.
* ``\\b`` is an ASCII word boundary in RE2 (JDK 17 is Unicode aware). Before
  what can only be an ASCII word character it is just "none stands before", which
  Java tests several times faster at every position of a text.
* ``(?i)`` folds Unicode in RE2 -> ``(?iu)``; ``\\w`` under it also holds the
  long s and the Kelvin sign.
* a ``{`` that does not start a repetition is a literal in RE2 -> ``\\{``.
* ``[`` and ``&`` inside a class are literals in RE2 -> escaped for Java.
"""

from __future__ import annotations

import re
from functools import lru_cache

_WORD = "A-Za-z0-9_"
_BOUNDARY = f"(?-i:(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}])))"
_NO_WORD_BEFORE = f"(?<![{_WORD}])"
_SPACE = "\\t\\n\\f\\r "
_FOLDED_WORD = "A-Za-z0-9_\\x{17F}\\x{212A}"
_REPEAT = re.compile(r"\{\d+(,\d*)?\}")
_LEAD_FLAGS = re.compile(r"^\(\?([imsU]+)\)")


#: A word character that is not optional, or ``\\d``, ``\\w`` or a class of word characters, one or more of it.
_WORD_FIRST = re.compile(r"([A-Za-z0-9_]|\\[dw]|\[(?:[A-Za-z0-9_](?:-[A-Za-z0-9])?)+\])(?![*?{])")


def _starts_word(rest: str) -> bool:
    """What follows begins with an ASCII word character, or is a flat group of
    alternatives that all do."""
    group = re.match(r"\((?:\?:)?([^()\[\]]*)\)(?![*?{])", rest)
    if group:
        return all(_WORD_FIRST.match(x) for x in group.group(1).split("|"))
    return "|" not in rest.split("(")[0] and bool(_WORD_FIRST.match(rest))


@lru_cache(maxsize=None)
def java(go_pattern: str) -> str:
    """Translate one RE2 pattern into an equivalent Java pattern."""
    flags = ""
    body = go_pattern
    m = _LEAD_FLAGS.match(body)
    if m:
        flags = m.group(1)
        body = body[m.end():]
    multiline = "m" in flags
    fold = "i" in flags
    out: list[str] = []
    in_class = False
    class_start = False
    i = 0
    n = len(body)
    while i < n:
        c = body[i]
        if c == "\\" and i + 1 < n:
            e = body[i + 1]
            i += 2
            if e == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif e == "S":
                out.append(f"[^{_SPACE}]")
            elif e == "b" and not in_class:
                out.append(_NO_WORD_BEFORE if not fold and _starts_word(body[i:]) else _BOUNDARY)
            elif e == "w" and fold:
                out.append(_FOLDED_WORD if in_class else f"[{_FOLDED_WORD}]")
            else:
                out.append("\\" + e)
            class_start = False
            continue
        if in_class:
            if c == "]" and not class_start:
                in_class = False
                out.append(c)
            elif c in "[&":
                out.append("\\" + c)
            elif c == "^" and class_start:
                out.append(c)
                i += 1
                continue  # a ']' right after '[^' is still a literal
            else:
                out.append(c)
            class_start = False
            i += 1
            continue
        if c == "[":
            in_class = True
            class_start = True
            out.append(c)
        elif c == "$" and not multiline:
            out.append("\\z")
        elif c == "{" and not _REPEAT.match(body, i):
            out.append("\\{")
        else:
            out.append(c)
        i += 1
    java_flags = "d" + flags.replace("U", "") + ("u" if fold else "")
    return f"(?{java_flags})" + "".join(out)
