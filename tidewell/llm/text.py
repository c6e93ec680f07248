"""Normal forms of text, with and without offsets into the original."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: Soft hyphen, zero-width and direction characters, byte order mark.
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
LINE_HYPHEN = re.compile(r"(?<=[^\W_])[-‐‑][ \t]*\r?\n[ \t>|]*(?=[^\W_])")
WORD = re.compile(r"[^\W_]+")


def cleaned(text: str) -> str:
    """Markup tags become a blank, character references are resolved, invisible characters are
    dropped, words divided by a hyphen at the end of a line are joined."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "-\n" in text or "\n" in text:
        text = LINE_HYPHEN.sub("", text)
    return text


def plain(text: str) -> str:
    """Lower case, compatibility form, without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits of its normal form."""
    return WORD.findall(plain(cleaned(text)))


def located_words(text: str) -> list[tuple[str, int, int]]:
    """The same words with the begin and end of each in the original text."""
    chars = [(c, i, i + 1) for i, c in enumerate(text)]

    def replace(pattern: re.Pattern, by) -> None:  # noqa: ANN001
        nonlocal chars
        s = "".join(c for c, _, _ in chars)
        out, last = [], 0
        for m in pattern.finditer(s):
            out += chars[last : m.start()]
            if m.end() > m.start():
                a, b = chars[m.start()][1], chars[m.end() - 1][2]
                out += [(c, a, b) for c in by(m.group())]
            last = m.end()
        chars = out + chars[last:]

    replace(TAG, lambda _: " ")
    replace(REFERENCE, html.unescape)
    replace(INVISIBLE, lambda _: "")
    replace(LINE_HYPHEN, lambda _: "")
    low = [(d, a, b) for c, a, b in chars for d in c.lower()]
    flat = []
    for c, a, b in low:
        flat += [(d, a, b) for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)]
    flat = [(d, a, b) for c, a, b in flat for d in c.lower()]
    s = "".join(c for c, _, _ in flat)
    return [(m.group(), flat[m.start()][1], flat[m.end() - 1][2]) for m in WORD.finditer(s)]
