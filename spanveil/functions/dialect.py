"""Turn a browser-style regular expression into the Java dialect that Spark evaluates.

The formats (built-in and user-supplied) assume ASCII word boundaries, Unicode white space and ``$`` as the very end
of the text. Java differs on all three, so each is spelled out: ``\\b`` becomes a look-around over ``[A-Za-z0-9_]``
(stable across JDK versions), ``\\s`` an explicit class, ``$`` becomes ``\\z``.
"""

from __future__ import annotations

import re

SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE_CLASS = f"[{SPACE}]"
NON_SPACE_CLASS = f"[^{SPACE}]"
WORD_START = r"(?<!\w)"
FIRST_LETTERS = 6
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java_regex(
    pattern: str,
    ignore_case: bool = False,
    multiline: bool = False,
    dot_all: bool = False,
    word_start: bool = False,
) -> str:
    """Java form of ``pattern``; no capture group is added or removed.

    ``word_start`` promises that every match starts with a word character, so that a leading ``\\b`` needs only the
    cheaper one-sided test.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            i += 2
            if nxt == "b" and not in_class:
                out.append(WORD_START if word_start and not out else BOUNDARY)
            elif nxt == "b":
                out.append(r"\x08")
            elif nxt == "B" and not in_class:
                out.append(f"(?!{BOUNDARY})")
            elif nxt == "s":
                out.append(SPACE if in_class else SPACE_CLASS)
            elif nxt == "S":
                out.append(f"{NON_SPACE_CLASS}")
            elif nxt == "/":
                out.append("/")
            else:
                out.append("\\" + nxt)
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch in "[&":
                ch = "\\" + ch
        elif ch == "[":
            in_class = True
            if pattern.startswith("[^]", i):
                out.append(r"[\x{0}-\x{10FFFF}]")
                in_class, i = False, i + 3
                continue
        elif ch == "$" and not multiline:
            ch = r"\z"
        elif ch == ".":
            ch = r"[\x{0}-\x{10FFFF}]" if dot_all else r"[^\n\r\x{2028}\x{2029}]"
        out.append(ch)
        i += 1
    head = ("(?i)" if ignore_case else "") + ("(?m)" if multiline else "")
    return head + "".join(out)


def literal(text: str) -> str:
    """Escape ``text`` so that a Java regular expression matches it as is."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def one_of(words: list[str]) -> str:
    """A prefix-sharing alternation equal to ``word|word|…`` for whole-word use.

    Java tries a flat list of alternatives one after the other at every position; sharing prefixes leaves one branch
    per letter. Which alternative matches first is irrelevant because callers fix both ends of the match.
    """
    letters = sorted({w[0] for w in words if w})
    if len(letters) > FIRST_LETTERS and all(ch.isalnum() for ch in letters):
        # A look-ahead per group of first letters skips the whole group at once.
        groups = [letters[i : i + FIRST_LETTERS] for i in range(0, len(letters), FIRST_LETTERS)]
        return "(?:" + "|".join(
            f"(?=[{''.join(group)}])" + one_of([w for w in words if w[:1] in group]) for group in groups
        ) + ")"
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        ends = "" in node
        groups: dict[str, list[str]] = {}
        for ch in sorted(k for k in node if k):
            groups.setdefault(render(node[ch]), []).append(ch)
        parts = [
            (literal(chars[0]) if len(chars) == 1 else "[" + "".join(literal(c) for c in chars) + "]") + tail
            for tail, chars in groups.items()
        ]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + ("?" if ends else "")

    return render(tree)
