"""Lines of a text, vectorised: identity, length and the pigeonhole blocks of their SimHashes.

A SimHash of a whole line moves in too many bits when one word changes. So the words of a line are dealt, by a hash of
each, to blocks of about four words, and every block has its own SimHash. A word that changes moves the block it leaves
and the block it joins; all others keep their bits. Of m changed words, more than 2m blocks leave one untouched,
which is what the lines are joined on. Lines of similar length deal to equally many blocks: a line belongs
to a level, the power of two below its length, and also to the next level if a similar line may be longer than
that. Of the blocks of a long line the first BLOCKS are used; which words they hold is left to the hash.

Short lines, and text that has no blanks between words, are dealt by runs of GRAM characters instead of words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Blocks that are used of a line dealt by words, and of one dealt by characters.
BLOCKS, GRAM_BLOCKS = 6, 8
#: Bytes of a word that is dealt; longer runs are dealt by characters.
SHORTEST, LONGEST = 4, 24
GRAM = 3
#: Lines of so many letters and digits are dealt by characters (up to the last) and by words (from the middle one).
LEAST_CHARS, WORDS_FROM, GRAMS_TO = 8, 24, 64
#: Fewest words or runs of characters of a block that is used; emptier blocks say too little.
LEAST_WORDS, LEAST_GRAMS = 2, 3
#: How much longer a similar line may be, with some allowance for blanks, which a level doesn't count.
LONGER = 1.3

#: Words of a line up to which its SimHash is counted in bit planes.
MANY = 256

#: Digits, a-z and bytes of other characters stay; all else separates words.
KEEP = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
WORD_BASE, CHECK_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[U(1)], np.full(size, base, U)]))


def _sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial hash of values[start:end] for each span."""
    size = 1 << len(values).bit_length()
    up, down = _powers(int(base), size), _powers(pow(int(base), -1, 1 << 64), size)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def _span_hashes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, eight at a time. ``padded`` has eight bytes to spare."""
    eights = np.ndarray((len(padded) - 7,), U, padded.data, 0, (1,))
    ones = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    found = mix((eights[starts] & ones[np.minimum(sizes, 8)]) + WORD_BASE * sizes.astype(U))
    at, left = np.flatnonzero(sizes > 8), 8
    while len(at):
        found[at] = mix(found[at] * CHECK_BASE + (eights[starts[at] + left] & ones[np.minimum(sizes[at] - left, 8)]))
        left += 8
        at = at[sizes[at] > left]
    return found


def _majorities(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of each group of hashes: the bits that over half of them have. Counts are kept as bit planes."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    planes = [np.zeros(len(starts), U)]
    having = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for k, n in enumerate(having.tolist()):
        carry = hashes[starts[:n] + k]
        for p in range(len(planes)):
            plane = planes[p][:n]
            planes[p][:n], carry = plane ^ carry, plane & carry
        if (k + 2) & (k + 1) == 0:  # the next count may need another plane
            planes.append(np.zeros(len(starts), U))
            planes[-1][:n] = carry
    above, equal, half = np.zeros(len(starts), U), np.full(len(starts), ~U(0)), sizes // 2
    for p in range(len(planes) - 1, -1, -1):
        bit = np.where(half >> p & 1, ~U(0), U(0))
        above |= equal & planes[p] & ~bit
        equal &= ~(planes[p] ^ bit)
    out = np.empty(len(starts), U)
    out[order] = above
    return out


def word_blocks(level: np.ndarray) -> np.ndarray:
    """How many blocks the words of a line of this level are dealt to: three at least, so that one stays when a word changes."""
    return np.maximum(3, (1 << np.minimum(level, 40)) // 20)


def gram_blocks(level: np.ndarray) -> np.ndarray:
    return np.maximum(6, (1 << np.minimum(level, 40)) // 4)


def _blocks(hashes: np.ndarray, line: np.ndarray, level: np.ndarray, dealt: np.ndarray, used: int, least: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the blocks of some lines; ``level`` and ``dealt`` are by line."""
    block = (hashes >> U(33)) % dealt[line].astype(U)
    kept = block < used
    hashes, line, group = hashes[kept], line[kept], line[kept] * 16 + block[kept].astype(np.int64)
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, U)
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    good = sizes >= least
    starts, sizes = starts[good], sizes[good]
    owner, number = group[starts] // 16, group[starts] % 16
    place = ((level[owner] * 16 + number) * 2 + kind) * 1024 + np.minimum(sizes, 1023)
    return owner, mix(_majorities(mix(hashes[order]), starts, sizes) ^ mix(place.astype(U)))


def identities(data: bytes):
    """What identifies the lines of lower-cased text: (line, check, size, has words, parts for ``block_keys``).

    ``line`` and ``check`` are two independent 64-bit hashes of the words in order, ``size`` is the number of characters
    of the words with a blank between them.
    """
    raw = np.frombuffer(data + b" " * 8, np.uint8)
    kept = KEEP[raw]
    inside = kept != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0], edges]) if len(inside) and inside[0] else edges
    starts, ends = edges[::2], edges[1::2]
    newlines = np.flatnonzero(raw == 10)
    bounds = np.concatenate([[0], np.searchsorted(starts, newlines), [len(starts)]])
    first, last = bounds[:-1], bounds[1:]
    line_of = np.repeat(np.arange(len(first)), last - first)
    hashes = _span_hashes(kept, starts, ends - starts)
    chars = ends - starts
    more = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no character
    if len(more):
        chars = chars - np.bincount(np.searchsorted(starts, more, side="right") - 1, minlength=len(starts))
    summed = np.concatenate([[0], np.cumsum(chars)])
    letters = summed[last] - summed[first]
    line = _sequence_hashes(hashes, first, last, WORD_BASE)
    check = _sequence_hashes(mix(hashes), first, last, CHECK_BASE)
    size = letters + np.maximum(last - first - 1, 0)
    return line, check, size, last > first, (kept, starts, ends, chars, first, last, line_of, hashes, letters)


def simhashes(parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of the words of SHORTEST bytes or more of each line, and whether it tells anything: not for short or unspaced lines."""
    _, starts, ends, _, first, last, line_of, hashes, letters = parts
    long = np.flatnonzero(ends - starts >= SHORTEST)
    words = mix(hashes[long])
    first, last = np.searchsorted(long, first), np.searchsorted(long, last)
    sizes = last - first
    out = np.zeros(len(first), U)
    few = np.flatnonzero(sizes <= MANY)
    out[few] = _majorities(words, first[few], sizes[few])
    for i in np.flatnonzero(sizes > MANY).tolist():
        ones = sum(np.unpackbits(words[k : min(k + 65_536, last[i])].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(first[i], last[i], 65_536))
        out[i] = np.packbits(2 * ones > sizes[i]).view(U)[0]
    return out, (letters >= GRAMS_TO) & ~_unspaced(parts)


def _unspaced(parts: tuple) -> np.ndarray:
    """Lines that consist of long runs for the most part."""
    _, starts, ends, chars, first, last, _, _, letters = parts
    total = np.concatenate([[0], np.cumsum(np.where(ends - starts > LONGEST, chars, 0))])
    return 2 * (total[last] - total[first]) > letters


def block_keys(parts: tuple, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line number, key) of every block of every line that ``identities`` has found, or of those in ``only``."""
    kept, starts, ends, _, _, _, line_of, hashes, letters = parts
    unspaced = _unspaced(parts)
    asked = np.ones(len(letters), bool) if only is None else only
    by_word = asked & (letters >= WORDS_FROM) & ~unspaced
    by_gram = asked & (letters >= LEAST_CHARS) & ((letters < GRAMS_TO) | unspaced)

    dealt = (ends - starts >= SHORTEST) & (ends - starts <= LONGEST) & by_word[line_of]
    words, word_line = hashes[dealt], line_of[dealt]

    # The characters of the lines dealt by characters, without the blanks between words.
    some = np.flatnonzero(by_gram[line_of])
    sizes = ends[some] - starts[some]
    at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(some) else np.zeros(0, np.int64)
    text = np.concatenate([kept[at], np.zeros(8, np.uint8)])
    begins = np.flatnonzero((text[: len(at)] & 0xC0) != 0x80)
    owner = np.repeat(line_of[some], sizes)[begins]
    many = max(0, len(begins) - GRAM + 1)
    whole = owner[:many] == owner[GRAM - 1 :][:many]
    stops = np.append(begins, len(at))[GRAM : GRAM + many]
    grams, gram_line = _span_hashes(text, begins[:many][whole], (stops - begins[:many])[whole]), owner[:many][whole]

    level = np.frexp(np.maximum(letters, 1).astype(float))[1] - 1
    upper = np.frexp(np.maximum(letters, 1) * LONGER)[1] - 1
    found = []
    for levels, chosen in ((level, None), (upper, upper != level)):
        for h, line, dealing, used, least, kind in ((words, word_line, word_blocks, BLOCKS, LEAST_WORDS, 0), (grams, gram_line, gram_blocks, GRAM_BLOCKS, LEAST_GRAMS, 1)):
            if chosen is not None:
                h, line = h[chosen[line]], line[chosen[line]]
            found.append(_blocks(h, line, levels, dealing(levels), used, least, kind))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
