"""Line patterns. Fixed values, for Java's and Python's expressions alike."""

from pagewright.functions.characters import SPACE

_MARKS = "[-–—•·*・･]|[（(][{s}]*[0-9０-９]+[{s}]*[）)]".replace("{s}", SPACE)
_NUMERALS = "0-9０-９一二三四五六七八九十百"
LIST_ITEM = f"\\A[{SPACE}]*(?:{_MARKS}|[0-9０-９]+[{SPACE}]*[.)．）、]|第[{SPACE}]*[{_NUMERALS}]+[{SPACE}]*[条項号章]|[①-⑳])"
PROVISION = f"\\A[{SPACE}]*(?:{_MARKS}|第[{SPACE}]*[{_NUMERALS}]+[{SPACE}]*[条項号]|[①-⑳])"
SENTENCE_END = f"[。．.!?！？][{SPACE}]*\\z"
CONTINUATION = f"(?iu)\\A[{SPACE}]*(?:ただし|但し|なお|もっとも|この場合|その場合|however|provided that|except that|unless)"
SENTENCE_BREAK = "[。．.！？!?]"
IDENTIFIER = "\\A[A-Za-z0-9_-]{1,64}\\z"
SEGMENT_ID = "\\Ap[0-9]{3}-s[0-9]{3}\\z"


def for_python(pattern: str) -> str:
    return pattern.replace("\\z", "\\Z")
