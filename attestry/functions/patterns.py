"""Regular expressions of linear-time dialects, rewritten for the JVM's."""

from __future__ import annotations

import re

from ..errors import InvalidPattern

_LOOK = re.compile(r"\(\?(?:=|!|<=|<!|>)")


def java_pattern(pattern: str) -> str:
    r"""The JVM pattern with the same meaning.

    ``$`` matches only at the very end unless ``(?m)`` is on, ``\d \w \s \b`` and ``(?i)`` know Unicode. Look-around,
    back-references and possessive or atomic groups have no counterpart and are refused before any job starts.
    """
    out, i, in_class, multiline = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise InvalidPattern(f"incomplete escape sequence in pattern `{pattern}`")
            n = pattern[i + 1]
            if n.isdigit() and not in_class or n == "k":
                raise InvalidPattern(f"backreferences are not supported: `{pattern}`")
            out.append({"z": r"\z", "A": r"\A"}.get(n, "\\" + n))
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern[i:i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i:i + 1] == "]":
                out.append(r"\]")
                i += 1
            continue
        elif c == "(" and pattern[i + 1:i + 2] == "?":
            if _LOOK.match(pattern, i):
                raise InvalidPattern(f"look-around, including look-ahead and look-behind, is not supported: `{pattern}`")
            m = re.match(r"\(\?P?<(\w+)>", pattern[i:])
            if m:
                out.append(f"(?<{m[1].replace('_', '')}>")
                i += m.end()
                continue
            m = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", pattern[i:])
            if not m or set(m[1] + (m[2] or "-")[1:]) - set("imsxuU"):
                raise InvalidPattern(f"unrecognised group in pattern `{pattern}`")
            if "U" in m[1]:
                raise InvalidPattern(f"swapped greediness is not supported: `{pattern}`")
            multiline |= "m" in m[1]
            on = m[1].replace("u", "") + ("u" if "i" in m[1] else "")
            out.append(f"(?{on}{(m[2] or '').replace('u', '') if m[2] not in (None, '-u') else ''}{m[3]}")
            i += m.end()
            continue
        elif c == "$" and not multiline:
            out.append(r"\z")
            i += 1
            continue
        elif c == "+" and i and pattern[i - 1] in "*+?}" and pattern[max(0, i - 2):i - 1] != "\\":
            raise InvalidPattern(f"possessive quantifiers are not supported: `{pattern}`")
        out.append(c)
        i += 1
    if in_class:
        raise InvalidPattern(f"unclosed character class in pattern `{pattern}`")
    return "(?U)" + "".join(out)


def checked(spark, pattern: str) -> str:
    """java_pattern, compiled once on the driver so that a bad pattern is refused early."""
    java = java_pattern(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise InvalidPattern(f"regex parse error in `{pattern}`: {str(e).splitlines()[0][:200]}") from None
    return java
