"""Terms of texts in tasks: bytes are mapped through a table and split, so that a term costs no Python call of its own."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of one piece: a longer text is split piece by piece.
PIECE = 4 << 20


def byte_table(digits: bool) -> bytes:
    """A-Z lower-cased; a-z, bytes above 0x7F (and 0-9 with ``digits``) as they are; everything else is a space."""
    table = bytearray(b" " * 256)
    for low, high in [(0x61, 0x7A), (0x80, 0xFF), *([(0x30, 0x39)] if digits else [])]:
        table[low : high + 1] = bytes(range(low, high + 1))
    table[0x41:0x5B] = table[0x61:0x7B]
    return bytes(table)


def term_lists(text: str | None, table: bytes) -> Iterator[list[bytes]]:
    """The terms of ``text`` in order, a list for each piece of it; null has none."""
    if not text:
        return
    body = text.encode().translate(table)
    at = 0
    while len(body) - at > PIECE:
        cut = body.rfind(b" ", at, at + PIECE)
        cut = cut if cut > at else body.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield body[at:cut].split()
        at = cut
    yield (body[at:] if at else body).split()
