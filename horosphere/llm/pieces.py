"""Cutting texts where no byte-level or space-marking subword tokenizer can join them.

A cut lies before a space that follows a character that is no white space: the
split patterns of byte-level tokenizers always end a match there, and no piece
of a space-marking vocabulary has its mark after another character. The pieces
between cuts can be tokenized one by one, each distinct one once.
"""

from __future__ import annotations

#: Pieces that a task remembers at most (then it starts afresh), and the longest one it remembers.
MOST_KNOWN = 600_000
LONGEST_KNOWN = 200
#: White space before a space, in ASCII and beyond.
_ASCII_JOINS = [c + " " for c in map(chr, range(128)) if c.isspace()]
_OTHER_JOINS = [c + " " for c in map(chr, range(128, 0x3001)) if c.isspace()]


def whole_pieces(text: str) -> list[str]:
    """The pieces of ``text``, each without the space before it. A part between spaces that is
    empty or ends in white space belongs to the next one, at the end of the text to the last."""
    parts = text.split(" ")
    if not (text[:1] in ("", " ") or text[-1].isspace() or any(j in text for j in _ASCII_JOINS)
            or not text.isascii() and any(j in text for j in _OTHER_JOINS)):
        return parts
    out: list[str] = []
    run: list[str] = []
    for p in parts:
        run.append(p)
        if p and not p[-1].isspace():
            out.append(run[0] if len(run) == 1 else " ".join(run))
            run = []
    if run:
        tail = " ".join(run)
        if out:
            out[-1] += " " + tail
        else:
            out.append(tail)
    return out


def steps(sizes: list[int], most: int):
    """Consecutive row ranges of at most ``most`` characters each (one row at least)."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Remembered:
    """Values of pieces, each distinct one worked out once by ``learn`` (pieces -> values)."""

    def __init__(self, learn):
        self.learn = learn
        self.known: dict = {}

    def values(self, rows: list[list[str]]) -> list[list]:
        """The values of the pieces of each row."""
        known = self.known
        got = [list(map(known.get, pieces)) for pieces in rows]
        new = dict.fromkeys([p for pieces, g in zip(rows, got) if None in g
                             for p, v in zip(pieces, g) if v is None])
        if not new:
            return got
        if len(known) + len(new) > MOST_KNOWN:
            known.clear()                        # what the rows at hand hold has been looked up
        found = dict(zip(new, self.learn(list(new)), strict=True))
        for pieces, g in zip(rows, got):
            if None in g:
                g[:] = [found[p] if v is None else v for p, v in zip(pieces, g)]
        known.update(found if max(map(len, found)) <= LONGEST_KNOWN else
                     {p: v for p, v in found.items() if len(p) <= LONGEST_KNOWN})
        return got
