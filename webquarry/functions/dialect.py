"""RE2 patterns for Spark, whose functions use java.util.regex: translation, validation, and keyword gates.

What differs is spelled out: ASCII word boundaries, `$` as the end of the text, `.` without only \\n, \\s without
VT, full case folding, group names, and signs that Java gives a meaning inside classes. What RE2 refuses is refused.
"""

from __future__ import annotations

import re
import warnings

BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NO_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
SPACE = r"\t\n\f\r "
NO_SPACE = r"\x00-\x08\x0b\x0e-\x1f!-\x{10ffff}"
POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0b\f\r ", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~"}
MAX_REPEAT = 1000
#: Most literals of a gate.
MAX_KEYWORDS = 64


class PatternError(ValueError):
    """The pattern is none in RE2."""


def java(pattern: str) -> str:
    """The Java pattern that matches what the RE2 pattern matches. Raises PatternError for what RE2 refuses."""
    out, at, n, multiline, depth = [], 0, len(pattern), False, 0
    while at < n:
        c = pattern[at]
        if c == "\\":
            if at + 1 >= n:
                raise PatternError("trailing backslash")
            d = pattern[at + 1]
            if d == "Q":
                end = pattern.find("\\E", at + 2)
                literal = pattern[at + 2 : end if end >= 0 else n]
                out.append(re.sub(r"([^0-9A-Za-z_])", r"\\\1", literal))
                at = end + 2 if end >= 0 else n
                continue
            if d.isdigit() and d != "0":
                raise PatternError("backreference")
            if d in "ZGRXk":
                raise PatternError(f"\\{d} is not supported")
            if d in "pPx":
                m = re.compile(r"\\[pP](?:\{\^?\w+\}|\w)|\\x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})").match(pattern, at)
                if not m:
                    raise PatternError(f"bad escape \\{d}")
                out.append(m[0])
                at = m.end()
                continue
            out.append({"b": BOUNDARY, "B": NO_BOUNDARY, "s": f"[{SPACE}]", "S": f"[{NO_SPACE}]", "z": r"\z", "C": "(?s:.)"}.get(d, "\\" + d))
            at += 2
        elif c == "[":
            text, at = character_class(pattern, at)
            out.append(text)
        elif c == "(":
            m = re.compile(r"\(\?(?:P?<(?P<name>[A-Za-z_]\w*)>|(?P<flags>[imsU]*(?:-[imsU]+)?)(?P<end>[:)]))").match(pattern, at)
            if pattern.startswith("(?", at):
                if not m:
                    raise PatternError("lookaround, atomic and conditional groups are not supported")
                if m["name"]:
                    out.append(f"(?<{m['name'].replace('_', '0')}>")
                    depth += 1
                else:
                    on = m["flags"].split("-")[0]
                    if "U" in m["flags"]:
                        raise PatternError("the U flag is not supported")
                    multiline = multiline or "m" in on
                    out.append("(?" + m["flags"].replace("i", "iu") + m["end"])
                    depth += m["end"] == ":"
                at = m.end()
            else:
                out.append("(")
                depth += 1
                at += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unexpected )")
            out.append(c)
            at += 1
        elif c == "$":
            out.append("$" if multiline else r"\z")
            at += 1
        elif c in "*+?":
            if not out:
                raise PatternError(f"missing argument to repetition operator {c}")
            m = re.compile(r"[*+?]\??").match(pattern, at)
            if m.end() < n and pattern[m.end()] in "*+?":
                raise PatternError("bad repetition operator")
            out.append(m[0])
            at = m.end()
        elif c == "{":
            m = re.compile(r"\{(\d+)(,(\d*))?\}").match(pattern, at)
            if m:
                if int(m[1]) > MAX_REPEAT or m[3] and (int(m[3]) > MAX_REPEAT or int(m[3]) < int(m[1])):
                    raise PatternError("bad repeat count")
                out.append(m[0])
                at = m.end()
                if at < n and pattern[at] in "*+":
                    raise PatternError("bad repetition operator")
            else:
                out.append(r"\{")
                at += 1
        elif c == "}":
            out.append(r"\}")
            at += 1
        else:
            out.append(c)
            at += 1
    if depth:
        raise PatternError("missing )")
    return "(?d)" + "".join(out)


def character_class(pattern: str, at: int) -> tuple[str, int]:
    out, n = ["["], len(pattern)
    at += 1
    if at < n and pattern[at] == "^":
        out.append("^")
        at += 1
    first = True
    while True:
        if at >= n:
            raise PatternError("missing ]")
        c = pattern[at]
        if c == "]" and not first:
            return "".join(out) + "]", at + 1
        first = False
        if c == "[":
            m = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, at)
            if m and m[2] in POSIX:
                out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
                at = m.end()
                continue
            out.append(r"\[")
            at += 1
        elif c == "\\":
            d = pattern[at + 1 : at + 2]
            m = re.compile(r"\\(?:[pP](?:\{\^?\w+\}|\w)|x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|.)", re.S).match(pattern, at)
            if not m or d == "b":
                raise PatternError("bad escape in class")
            out.append({"s": SPACE, "S": NO_SPACE}.get(d, m[0]))
            at = m.end()
        else:
            out.append("\\" + c if c in "]&^" else c)
            at += 1


def keywords(pattern: str) -> list[str] | None:
    """Literals, in lower case, of which every match has one in any case; None if there are none. A cheap test before an expensive pattern."""
    try:
        from re import _constants as k
        from re import _parser as parser

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(re.sub(r"\\x\{([0-9A-Fa-f]{4})\}", r"\\u\1", pattern.replace("\\z", "\\Z")))
    except (re.error, OverflowError):
        return None

    def exact(op, arg) -> set[str] | None:
        """All texts that an item can be, in lower case, if they are few; a place takes no text."""
        if op is k.LITERAL:
            return {chr(arg).lower()}
        if op is k.AT:
            return {""}
        if op is k.IN and all(o is k.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is k.SUBPATTERN:
            return product({""}, arg[3])
        if op is k.BRANCH:
            each = [product({""}, x) for x in arg[1]]
            return set().union(*each) if all(x is not None for x in each) else None
        if op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[1] == 1:
            inner = product({""}, arg[2])
            return inner if arg[0] or inner is None else inner | {""}
        return None

    def product(run: set[str], items) -> set[str] | None:
        for op, arg in items:
            found = exact(op, arg)
            if found is None or len(run) * len(found) > MAX_KEYWORDS:
                return None
            run = {x + y for x in run for y in found}
        return run

    def worth(words: set[str]) -> tuple[int, int]:
        return min(map(len, words)), -len(words)

    def usable(words: set[str]) -> bool:
        return all(len(w) > 1 or w and not w.isalnum() and w not in " .,-" for w in words) and all(w.isascii() for w in words)

    def best(items, run: set[str]) -> set[str] | None:
        """The best set of which every match has one; run: what the text before may end with."""
        found: list[set[str]] = []
        for op, arg in items:
            longer = exact(op, arg)
            if longer is not None and len(run) * len(longer) <= MAX_KEYWORDS:
                run = {x + y for x in run for y in longer}
                continue
            inner = None
            if op is k.SUBPATTERN:
                inner = best(arg[3], run)
            elif op is k.BRANCH:
                each = [best(x, run) for x in arg[1]]
                inner = set().union(*each) if all(each) else None
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] > 0:
                inner = best(arg[2], run)
            found += [x for x in (run, inner) if x and usable(x)]
            run = {""}
        found += [run] if usable(run) else []
        return max(found, key=worth, default=None)

    words = best(list(tree), {""})
    if not words or len(words) > MAX_KEYWORDS:
        return None
    # One that contains another adds nothing.
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def any_of(words) -> str:
    """A Java pattern for any of some literals."""
    return "|".join(re.sub(r"([^0-9A-Za-z_])", r"\\\1", w) for w in words)
