"""Character classes shared by Spark expressions and Python. Fixed values.

Each is the body of a character class that Java's and Python's expressions both read.
"""

import re

#: White space of ECMAScript.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
ZERO_WIDTH = "\\u200b-\\u200d\\u2060\\ufeff"
#: Marks that fold into the character before them.
COMBINING = "\\u3099\\u309a\\uff9e\\uff9f"
#: Characters written without spaces between words: Han, Hiragana, Katakana, what those scripts share, CJK punctuation, full- and half-width forms.
CJK = (
    "\\u2e80-\\u2e99\\u2e9b-\\u2ef3\\u2f00-\\u2fd5\\u2ff0-\\u2fff\\u3000-\\u303f\\u3041-\\u3096\\u3099-\\u30ff\\u3190-\\u319f"
    "\\u31c0-\\u31e5\\u31ef-\\u31ff\\u3220-\\u3247\\u3280-\\u32b0\\u32c0-\\u33ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\ua700-\\ua707\\uf900-\\ufaff\\ufe45\\ufe46\\uff00-\\uffef"
)
_CJK_ASTRAL = ((0x16FE2, 0x16FF6), (0x1AFF0, 0x1B16F), (0x1D360, 0x1D371), (0x1F200, 0x1F200), (0x1F250, 0x1F251), (0x20000, 0x3347F))

_SPACE_RE = re.compile(f"[{SPACE}]")
_CJK_RE = re.compile(f"[{CJK}]")
_SPACES = "".join(c for c in map(chr, range(0x10000)) if _SPACE_RE.match(c))


def is_space(c: str) -> bool:
    return bool(_SPACE_RE.match(c))


def is_cjk(c: str) -> bool:
    return c >= "\u2e80" and (bool(_CJK_RE.match(c)) or any(a <= ord(c) <= b for a, b in _CJK_ASTRAL))


def strip(text: str) -> str:
    return text.strip(_SPACES)
