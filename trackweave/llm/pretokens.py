"""The split of a text into the pieces that byte-level BPE merges one by one."""

from __future__ import annotations

import re

import regex

# The split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# White space, letters and numbers below U+0250, so that the quicker ``re`` can split Latin texts.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile(r"[^\x00-ɏ]")
_WHITE = r"\p{White_Space}"
_ANY = regex.compile(PATTERN.replace(r"[^\s", rf"[^{_WHITE}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", _WHITE))


def is_latin(text: str) -> bool:
    """No character from U+0250 on."""
    return text.isascii() or not _BEYOND.search(text)


def pieces_of(text: str) -> list[str]:
    """All matches of the pattern; together they are the whole text."""
    if is_latin(text):
        return _LATIN.findall(text)
    return _ANY.findall(text)


_WORD = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def latin_words(low: str) -> list[str]:
    """Words of a lower-cased text without characters from U+0250 on; white space is no part of any."""
    return _WORD.findall(low)
