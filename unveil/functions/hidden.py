"""C2 in linear time: hidden styled elements found in one pass over tags, style attributes and close tags.

The pattern it stands for takes, from left to right, an open tag whose last
usable style attribute before the next ``>`` passes a style test, and removes it with everything up
to the first close tag of its name. Whether a style attribute is usable, and where
its tag ends, does not depend on the tag it is reached from, so each is
examined once; tags, attributes and closes then meet by binary search.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from unveil.functions import fixed

_WS = f"[{fixed.WHITESPACE_CHARS}]"
_OPEN = re.compile(rf"<({'|'.join(fixed.HIDDEN_STYLED_TAGS)})\b", re.I)
_CLOSE = re.compile(rf"</({'|'.join(fixed.HIDDEN_STYLED_TAGS)})>", re.I)
_STYLE = re.compile(rf"style{_WS}*={_WS}*{fixed.QUOTE}", re.I)
_TESTS = re.compile(fixed.HIDDEN_STYLE_TESTS.replace(fixed.WS, _WS), re.I)
_QUOTE = re.compile(fixed.QUOTE)


def _name(tag: str) -> str:
    """A tag's name as the pattern compares it with its close tag: each character in simple lower case."""
    return tag.replace("\u0130", "i").lower()


def _hiding_styles(text: str) -> tuple[list[int], list[int]]:
    """Where style attributes with a hiding value begin, and where the tags that hold them end; both ascend."""
    at, ends = [], []
    quoted = closed = -1  # the end of the value looked at last, and of the tag around it
    for m in _STYLE.finditer(text):
        value = m.end()
        if value > quoted:
            quote = _QUOTE.search(text, value)
            if quote is None:
                break
            quoted = quote.start()
        if _TESTS.search(text, value, quoted):
            if closed <= quoted:
                closed = text.find(">", quoted + 1)
                if closed < 0:
                    break
            at.append(m.start())
            ends.append(closed + 1)
    return at, ends


def hidden_elements(text: str) -> tuple[str, list[str]] | None:
    """The text without hidden styled elements and their contents in order; None if there are none."""
    styles, tag_ends = _hiding_styles(text)
    if not styles:
        return None
    closes: dict[str, tuple[list[int], list[int]]] = {}
    for m in _CLOSE.finditer(text):
        starts, ends = closes.setdefault(_name(m.group(1)), ([], []))
        starts.append(m.start())
        ends.append(m.end())
    kept, found, done, reach = [], [], 0, -1
    for m in _OPEN.finditer(text):
        if m.start() < done:
            continue
        own = closes.get(_name(m.group(1)))
        if own is None:
            continue
        if reach < m.end():  # the first '>' behind the tag's name bounds where its style may begin
            reach = text.find(">", m.end())
            reach = len(text) if reach < 0 else reach
        last = min(bisect_right(styles, reach - 1), bisect_right(tag_ends, own[0][-1])) - 1
        if last < 0 or styles[last] < m.end():
            continue
        k = bisect_left(own[0], tag_ends[last])
        kept.append(text[done : m.start()])
        found.append(text[tag_ends[last] : own[0][k]])
        done = own[1][k]
    if not found:
        return None
    kept.append(text[done:])
    return "".join(kept), found
