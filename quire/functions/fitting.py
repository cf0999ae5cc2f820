"""How much of a text fits: prefix sums of glyph widths, made once a text, and binary search on them. For use inside tasks."""

from __future__ import annotations

from bisect import bisect_right
from math import ceil

import numpy as np

# Where a text is split best, and where an overflowing one may be; the least that a last fragment has.
SENTENCE_MARKS = ("。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ")
BREAKS = (" ", "\n", "。", "，", ".", ",")
LAST_CHARS, LAST_LINES = 12, 2
#: Points that a height has to spare.
SAFETY = 0.6

_glyphs = np.zeros(0, np.int32)


def _glyph(c: str) -> int:
    """The width of a character in hundredths of an em, as in quire.functions.text.WIDTHS."""
    from quire.functions.text import WIDTHS

    n = ord(c)
    wide = 0x1100 <= n <= 0x11FF or 0x2E80 <= n <= 0xA4CF or 0xAC00 <= n <= 0xD7AF or 0xF900 <= n <= 0xFAFF or 0xFE30 <= n <= 0xFE6F or 0xFF00 <= n <= 0xFFEF
    kind = "tab" if c == "\t" else "blank" if c.isspace() else "wide" if wide else "capital" if c.isupper() else "digit" if c.isdigit() else "ascii" if n < 128 else "other"
    return WIDTHS[kind]


def glyph_widths(text: str) -> np.ndarray:
    """The widths of the characters of a text in hundredths of an em."""
    global _glyphs
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(_glyphs):
        _glyphs = np.full(0x110000, -1, np.int32)
    out = _glyphs[points]
    for p in np.unique(points[out < 0]).tolist():
        _glyphs[p] = _glyph(chr(p))
    return _glyphs[points] if (out < 0).any() else out


def widths_of(texts: list[str]) -> list[int]:
    """The widths of many texts in hundredths of an em, in one pass over all of their characters."""
    ends = np.cumsum([len(t) for t in texts])
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(glyph_widths("".join(texts)), dtype=np.int64)))[ends] if len(texts) else ends
    return np.diff(sums, prepend=0).tolist()


def split_at(text: str, start: int, most: int) -> int:
    """ST25: where text[start:] is split if `most` characters of it may go first: behind the last end of a sentence, clause or word beyond 55 % of them, else there."""
    most = min(most, len(text) - start)
    best = max(text.rfind(m, start, start + most) for m in SENTENCE_MARKS) - start
    if best >= max(1, int(most * 0.55)):
        return start + best + (0 if text[start + best].isspace() else 1)
    return start + most


class Measured:
    """A text of single blanks with the running sums of its widths."""

    def __init__(self, text: str):
        self.text = text
        self.sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(glyph_widths(text), dtype=np.int64)))

    def hundredths(self, start: int, end: int) -> int:
        """The width of text[start:end] without blanks at its end."""
        while end > start and self.text[end - 1].isspace():
            end -= 1
        return int(self.sums[end] - self.sums[start])


class Style:
    """How a text is set: font size and space before and after in points, line height as a factor, indent of the first line in ems."""

    def __init__(self, font: float, line: float, before: float, after: float, indent: float):
        self.font, self.line, self.before, self.after, self.indent = font, line, before, after, indent

    def lines(self, hundredths: int, width: float) -> int:
        return max(1, ceil(hundredths / 100.0 * self.font / width))

    def height(self, hundredths: int, width: float) -> float:
        """The height that a text takes up, with SAFETY."""
        return max(self.font * self.line, self.lines(hundredths, max(1.0, width - self.indent * self.font)) * self.font * self.line) + SAFETY

    def chars(self, width: float, height: float) -> int:
        """A first guess at the characters that have room: 1.75 an em of each line."""
        lines = max(1, int(height / (self.font * self.line)))
        return max(1, int(width / max(self.font, 1.0) * lines * 1.75))

    def capacity(self, m: Measured, start: int, width: float, height: float) -> int:
        """The most characters of text[start:], 1 at least, whose estimated height is no more than `height`: a binary search on the sums."""
        low, high = 1, max(1, len(m.text) - start)
        best = 1
        if self.height(0, width) > height:
            return best
        # No line holds more than its width, so this many hundredths can't be passed; the search starts there.
        most = (height / (self.font * self.line) + 1) * max(1.0, width - self.indent * self.font) * 100 / self.font
        high = min(high, int(np.searchsorted(m.sums, int(m.sums[start] + most) + 1, side="right")) - start + 1)
        while low <= high:
            mid = (low + high) // 2
            if self.height(m.hundredths(start, start + mid), width) <= height:
                best, low = max(1, mid), mid + 1
            else:
                high = mid - 1
        return best

    def fragments(self, text: str, width: float, tallest: float, first: float | None = None) -> list[str]:
        """ST25: a text cut where boxes of height `tallest` (the first one: `first`) are full. Linear in the text: sums are made once, and each cut is a search in them.

        A rest of less than LAST_CHARS characters or LAST_LINES lines takes the last quarter of the fragment before it along.
        """
        if not text:
            return []
        if len(text) <= self.chars(width, first or tallest):
            return [text]
        m, start = Measured(text), 0
        out: list[str] = []
        while start < len(m.text):
            height = first if first and not out else tallest
            most = min(self.chars(width, height), self.capacity(m, start, width, height))
            if len(m.text) - start <= most:
                out.append(m.text[start:])
                break
            at = split_at(m.text, start, most)
            fragment = m.text[start:at].strip()
            at += len(m.text[at : at + 1]) - len(m.text[at : at + 1].lstrip())
            left = len(m.text) - at
            short = left and (left < LAST_CHARS or self.lines(m.hundredths(at, len(m.text)), width) < LAST_LINES)
            if short:
                cut = split_at(fragment, 0, max(1, int(len(fragment) * 0.75)))
                m, at = Measured(f"{fragment[cut:].strip()} {m.text[at:]}".strip()), 0
                fragment = fragment[:cut].strip()
            if fragment:
                out.append(fragment)
            start = at
        return out


def boxed_fragments(text: str, width: float, height: float, font: float, line: float) -> list[str]:
    """A text cut into fragments that fill a box; what is over goes on in a box of the same size.

    A text whose estimated lines fit is one fragment. Lines are filled glyph by glyph, and broken by the text's own line feeds; a cut moves back behind the last blank or mark of
    BREAKS if that lies beyond 60 % of the fragment. Linear in the text: each line is a search in the running sums, and estimates of the rest are kept as suffix sums.
    """
    many = max(1, int(height / (font * line))) if font > 0 and line > 0 else 1
    wide = 100 * max(1, int(width / font)) if font > 0 else 100
    widths = glyph_widths(text)
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(widths, dtype=np.int64)))
    own = [0]  # where the text's own lines begin, and below, where they end
    for piece in text.splitlines(keepends=True):
        own.append(own[-1] + len(piece))
    ends = [a + len(t) for a, t in zip(own, text.splitlines(), strict=False)]
    takes = lambda a, b: max(1, ceil((sums[b] - sums[a]) / 100.0 * font / width)) if width > 0 and font > 0 else 1
    after = [0]
    for a, b in zip(reversed(own[:-1]), reversed(ends), strict=True):
        after.append(after[-1] + takes(a, b))
    after.reverse()
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)

    def fits(start: int) -> bool:
        if start >= len(text):
            return True
        i = bisect_right(own, start) - 1
        lines = 1 if width <= 0 or font <= 0 else takes(start, max(ends[i], start)) + after[i + 1]
        return lines * font * line <= height

    out, start = [], 0
    while True:
        if fits(start):
            return [*out, text[start:]] if text[start:] or not out else out
        at, lines = start, 1
        k = int(np.searchsorted(feeds, start))
        while True:
            stop = int(feeds[k]) if k < len(feeds) else len(text)
            if at < stop:  # a line takes one glyph at least
                at = max(min(int(np.searchsorted(sums, sums[at] + wide, side="right")) - 1, stop), at + 1)
            if at == len(text) or lines == many:
                break
            lines += 1
            if at == stop:  # the line feed itself
                at, k = at + 1, k + 1
        end = max(at, start + 1)
        back = max(text.rfind(b, start, end) for b in BREAKS) - start
        if back >= max(1, int((end - start) * 0.6)):
            end = start + back + 1
        out.append(text[start:end].rstrip())
        start = end
        while start < len(text) and text[start].isspace():
            start += 1
        if start >= len(text):
            return out
