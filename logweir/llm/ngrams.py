"""CRC-32 sums of all runs of consecutive words of many texts at once, in numpy.

Words are runs of digits, letters and all characters beyond ASCII, after A-Z became a-z. The sum of a run
follows from those of its words: moving a sum past n more bytes is linear over its bits, so it is four table
look-ups for n up to ``STEPS``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
IN_WORD = np.zeros(256, bool)
IN_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
CHUNK = 1 << 20
STEPS = 255
SHORT = 48
ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """The register after one byte, per byte (the reflected polynomial of zlib's CRC-32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


BYTE = _byte_table()


def _moves() -> np.ndarray:
    """``[n, k, b]``: the sum whose k-th byte is b, and no other bit is set, after n zero bytes."""
    moves = np.zeros((STEPS + 1, 4, 256), np.uint32)
    for k in range(4):
        moves[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(STEPS):
        moves[n + 1] = BYTE[moves[n] & np.uint32(255)] ^ (moves[n] >> np.uint32(8))
    return moves


MOVES = _moves()


def _moved(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the sums add to that of a text which goes on with n more bytes."""
    while len(n) and n.max() > 0:
        now = np.minimum(n, STEPS)
        sums = (MOVES[now, 0, sums & np.uint32(255)] ^ MOVES[now, 1, (sums >> np.uint32(8)) & np.uint32(255)]
                ^ MOVES[now, 2, (sums >> np.uint32(16)) & np.uint32(255)] ^ MOVES[now, 3, sums >> np.uint32(24)])
        n = n - now
    return sums


def _after_blank(sums: np.ndarray) -> np.ndarray:
    inner = sums ^ ONES
    return BYTE[(inner ^ np.uint32(32)) & np.uint32(255)] ^ (inner >> np.uint32(8)) ^ ONES


def _word_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.full(len(starts), ONES, np.uint32)
    left = np.flatnonzero(lengths <= SHORT)
    for k in range(SHORT):
        left = left[lengths[left] > k]
        if not len(left):
            break
        now = sums[left]
        sums[left] = BYTE[(now ^ data[starts[left] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    sums ^= ONES
    for i in np.flatnonzero(lengths > SHORT).tolist():
        sums[i] = zlib.crc32(data[starts[i]:starts[i] + lengths[i]])
    return sums


@dataclass
class Runs:
    """The runs of some texts: ``of`` and ``sums`` per run, ``words`` per text from number ``first`` on."""

    first: int
    words: np.ndarray
    of: np.ndarray
    sums: np.ndarray


def _pieces(texts: list[bytes | None], longest: int) -> Iterator[tuple[int, bytes, int]]:
    """(number, bytes, words at the start that an earlier piece has counted): long texts come in pieces."""
    for k, text in enumerate(texts):
        text = (text or b"").lower()
        if len(text) <= CHUNK:
            yield k, text, 0
            continue
        at, before = 0, []
        while at < len(text):
            gap = GAP.search(text, min(at + CHUNK, len(text)))
            end = gap.start() if gap else len(text)
            piece = b" ".join([*before, text[at:end]])
            yield k, piece, len(before)
            at, before = end, WORD.findall(piece)[1 - longest:] if longest > 1 else []


def _runs(first: int, held: list[tuple[int, bytes, int]], longest: int) -> Runs:
    data = np.frombuffer(b" ".join(piece for _, piece, _ in held) + b" ", np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(piece) + 1 for _, piece, _ in held])
    piece = np.searchsorted(ends, starts, "right")
    sizes = np.bincount(piece, minlength=len(held))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of the word in its piece
    fresh = place >= np.asarray([carried for *_, carried in held])[piece]
    of = np.asarray([number for number, *_ in held])[piece] - first
    words = _word_sums(data, starts, lengths)
    sums, found = words, [words[fresh]]
    for n in range(1, longest):
        sums = _moved(_after_blank(sums[:-1]), lengths[n:]) ^ words[n:]
        found.append(sums[fresh[n:] & (place[n:] >= n)])
    number = [of[n:][fresh[n:] & (place[n:] >= n)] for n in range(longest)]
    return Runs(first, np.bincount(number[0], minlength=held[-1][0] - first + 1),
                np.concatenate(number), np.concatenate(found))


def runs(texts: list[bytes | None], longest: int = 3) -> Iterator[Runs]:
    """All runs of 1 to ``longest`` words of the texts, joined by one blank, in chunks of about ``CHUNK`` bytes."""
    held: list[tuple[int, bytes, int]] = []
    size = 0
    for piece in _pieces(texts, longest):
        held.append(piece)
        size += len(piece[1])
        if size >= CHUNK:
            yield _runs(held[0][0], held, longest)
            held, size = [], 0
    if held:
        yield _runs(held[0][0], held, longest)
