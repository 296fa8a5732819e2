"""Native chain vs the row-wise Python cleaner on generated hostile texts."""

import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from unveil.functions import fixed
from unveil.functions.hidden import hidden_elements
from unveil.functions.rowwise import clean_row

# word boundaries beside combining marks, names in unusual case, attributes without end
EDGES = [
    "\u0301", "\u0345", "\u20dd", "_", "x", "\u00b2", "\u0661", "<img", "<img\u0301 alt='a'>", "<img x\u0301alt='b'>", "<img \u0301alt='c'>", "system\u0301:", "# system\u0301",
    "# instructions\u0301:", "#system_", "#system:", "\n", "<span\u0301 style='color:white'>", "<span style='font-size:0p\u0301x'>", "<d\u0130v style='opacity:0'>", "<d\u0131v style='opacity:0'>",
    "</span>", "</div>", "</d\u0130v>", "<p style=\"", " style='opacity:0", "'", "\"", ">", "</p>", "alt='z'", " ",
]
FRAGMENTS = [
    "<!--", "-->", "<!-- note -->", '<span style="color:white">', '<span style="color:#ffffff">',
    '<SPAN STYLE="display : none">', "</span>", "</SPAN>", '<div style="visibility:hidden">', "</div>",
    '<p style="opacity:0">', '<p style="opacity:0.5">', "</p>", '<font style="font-size:0pt">', "</font>",
    '<img src="a.png" alt="look here">', "<img alt=''>", "<img data-alt='x' alt=\"it's\">",
    chr(0x200B), chr(0x200D), chr(0xFEFF), chr(0x202E), chr(0x2066), chr(0xAD), chr(0xE0041), chr(0xE0001),
    "SYSTEM:", "system :", "Assistant:", "instructions:", "### System", "#Instruction\n", "## instructions:",
    "[INST]", "[/inst]", "[SYSTEM]", "[instruction]", "ＳＹＳＴＥＭ：",
    "\n", "\n\n\n", " \t\n", "  ", "　", " ", "\x85", "\x1c", "\xa0",
    "e\u0301", "\u0301", "\u1100\u1161", "\u11a8", "\u0b47\u0b3e", "\u0327\u0301", "\u2460", "\u00bd",
    '<ſpan style="color:white">', "</ſpan>", "<İmg alt=\"look\">", "<ımg alt='look'>",
    "word", "Système", "déjà", "ﬁle", "'", '"', "\\", "é", "x" * 3,
]


def _texts(seed: int, n: int) -> list:
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 14)
        out.append("".join(rnd.choice(FRAGMENTS) for _ in range(k)))
    return out


def test_random_fragments(clean_rows):
    texts = _texts(7, 600) + [None]
    got = clean_rows(texts)
    bad = [(t, g, clean_row(t)) for t, g in zip(texts, got) if g != clean_row(t)]
    assert not bad, bad[:3]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS + list("abc :#<>/=\"'-")), max_size=30).map("".join),
                min_size=20, max_size=60))
def test_hypothesis_texts(clean_rows, texts):
    got = clean_rows(texts)
    assert got == [clean_row(t) for t in texts]


def test_edges_of_words_and_tags(clean_rows):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(EDGES) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    got = clean_rows(texts)
    bad = [(t, g, clean_row(t)) for t, g in zip(texts, got) if g != clean_row(t)]
    assert not bad, bad[:3]


def test_hidden_elements_are_those_of_the_pattern():
    """The pass over tags against the backtracking pattern, in Python's own engine."""
    ws = f"[{fixed.WHITESPACE_CHARS}]"
    plain = fixed.HIDDEN_STYLED.replace("(?isUd)", "").replace("(?<tag>", "(?P<tag>").replace("(?<content>", "(?P<content>")
    pattern = re.compile(plain.replace(r"\k<tag>", "(?P=tag)").replace(fixed.WS, ws), re.I | re.S)
    rnd = random.Random(3)
    parts = [f for f in EDGES + FRAGMENTS if "\n" not in f] + ["color:white", "opacity:0", " style=\"", "<font "]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 16)))
        found = [m.group("content") for m in pattern.finditer(text)]
        assert hidden_elements(text) == ((pattern.sub("", text), found) if found else None), text


def test_hostile_rows_take_linear_time():
    for unit in ('<span style="color:white">', '<p <p style="color:white" style="opacity:0">', '<p style="', 'style="color:white"', "<p ", '</p><div style="display:none">', "<p style"):
        text = unit * ((1 << 20) // len(unit)) + '<p style="color:white"></span>'
        start = time.perf_counter()
        hidden_elements(text)
        assert time.perf_counter() - start < 1.0, unit
