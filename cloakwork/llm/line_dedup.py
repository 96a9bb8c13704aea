"""Fuzzy duplicates among lines: SimHash blocks, pigeonhole joins, edit similarity, connected groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import line_prints
from .common import discard, materialise
from .components import connected_components
from .line_prints import KEEP, block_keys, identities

#: Bytes of text that are analysed at once.
PIECE = 1_000_000
#: Buckets of up to JOINED lines give all their pairs; larger ones are searched in tiles of so many lines and characters.
JOINED, TILE, TILE_CHARS = 12, 4_096, 8_000_000
#: Buckets are dealt by so many of their first bits; keys that a task gathers before it deals them, and of one such part that are held if most are in crowds.
PART_BITS, GATHERED, HELD = 12, 1 << 19, 1 << 22
#: Bits of the map that tells at which places lines' texts may be needed; a place is a row's key and a line number.
BITMAP, SPREAD = 1 << 26, 0x9E3779B1
#: Bits in which the SimHashes of two lines may differ: eight words in nine are the same at least.
RADIUS = 15
#: Words that the quick bound looks ahead.
AHEAD = 4
#: Characters after which it is looked at whether the bound can still be kept.
STRIDE = 16
#: Bits of a class of three characters in a row, and classes.
CLASS_BITS = 10
CLASSES = 1 << CLASS_BITS
#: Pairs of lines whose counts of classes are held at once, and characters that are counted at once.
COUNTED, COUNTED_CHARS = 1_000, 50_000
#: Crowds with the same least line are searched together up to so many lines and characters.
FAMILY, FAMILY_CHARS = 16_384, 8_000_000


#: Letters, digits and bytes of other characters stay, all else separates; capitals are gone by then.
SEPARATED = bytes(b or 32 for b in KEEP)


def words_of(lower: bytes) -> str:
    """A lower-cased line as its words with a blank between them."""
    return b" ".join(lower.translate(SEPARATED).split()).decode()


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether the edit distance of two normalised lines is at most (1 - similarity) of the longer one.

    What they have in common at either end is cut off. If neither matching words nor the longest common subsequence, which bounds the
    distance on both sides, shows it, the distance is computed bit-parallel, one big-integer step for each character of the shorter
    line, until the bound can't be kept any more.
    """
    a, b = sorted((a, b), key=len)
    most = int((1 - similarity) * len(b) + 1e-9)
    if len(b) - len(a) > most:
        return False
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(b) <= most or _words_bound(a, b, most) <= most:
        return True
    masks, full = _places(b), (1 << len(b)) - 1
    # Whatever is not in common costs an edit; at most, all of it is deleted and inserted.
    common = _subsequence(a, masks, full, len(b) - most)
    if len(b) - common > most:
        return False
    if len(a) + len(b) - 2 * common <= most:
        return True
    plus, minus, find = full, 0, masks.get
    for k in range(0, len(a), STRIDE):
        for ch in a[k : k + STRIDE]:
            match = find(ch, 0)
            diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
            up = (minus | (full ^ (diagonal | plus))) << 1 | 1
            plus, minus = ((plus & diagonal) << 1 | ~(diagonal | up)) & full, diagonal & up
        done = min(k + STRIDE, len(a))
        distance = done + plus.bit_count() - minus.bit_count()
        if distance - (len(a) - done) > most:
            return False
    return distance <= most


def _places(line: str) -> dict[str, int]:
    """The places of each character, as bits."""
    masks: dict[str, int] = {}
    bit = 1
    for ch in line:
        masks[ch] = masks.get(ch, 0) | bit
        bit <<= 1
    return masks


def _subsequence(a: str, masks: dict[str, int], full: int, least: int) -> int:
    """Length of the longest common subsequence of ``a`` and the line whose places of each character ``masks`` has, or less than ``least`` if it is."""
    open_, length, find = full, full.bit_length(), masks.get
    for k in range(0, len(a), STRIDE):
        for ch in a[k : k + STRIDE]:
            met = open_ & find(ch, 0)
            open_ = (open_ + met) | (open_ - met)
        open_ &= full
        common = length - open_.bit_count()
        if common + max(0, len(a) - k - STRIDE) < least:
            return common
    return length - open_.bit_count()


def class_counts(words: list[str]) -> np.ndarray:
    """How often each class of three characters in a row comes in each line, 65,535 at most."""
    counts = np.zeros((len(words), CLASSES), np.uint16)
    start = 0
    while start < len(words):
        end, chars = start, 0
        while end < len(words) and chars < COUNTED_CHARS:
            chars += len(words[end])
            end += 1
        row = np.repeat(np.arange(end - start), [len(w) for w in words[start:end]])
        c = np.frombuffer("".join(words[start:end]).encode("utf-32-le"), np.uint32)
        kinds = (c[:-2] * np.uint32(0x85EBCA6B) + c[1:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CLASS_BITS)
        found = np.bincount((row[:-2] * CLASSES + kinds)[row[:-2] == row[2:]], minlength=(end - start) * CLASSES)
        counts[start:end] = np.minimum(found, 65_535).reshape(-1, CLASSES)
        start = end
    return counts


def may_be_similar(a: np.ndarray, b: np.ndarray, longer: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether lines with these ``class_counts`` can be within ``most`` edits: an edit changes three runs of three characters at most,
    so the longer line has all but three for each edit in common with the other. Classes that coincide only let more through."""
    return np.minimum(a, b).sum(axis=1, dtype=np.int64) >= np.minimum(longer - 2 - 3 * most, 65_535)


def similar_pairs(us: list[str], vs: list[str], similarity: float) -> list[bool]:
    """``similar`` of each two lines; most that aren't are told from their ``class_counts``."""
    out: list[bool] = []
    for k in range(0, len(us), COUNTED):
        u, v = us[k : k + COUNTED], vs[k : k + COUNTED]
        longer = np.array([max(len(a), len(b)) for a, b in zip(u, v)])
        may = may_be_similar(class_counts(u), class_counts(v), longer, np.floor((1 - similarity) * longer + 1e-9))
        out += [m and similar(a, b, similarity) for m, a, b in zip(may.tolist(), u, v)]
    return out


def _words_bound(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: words are matched in order, with a look ahead of AHEAD words where they differ,
    and what lies between matches counts as replaced. Stops once it is over ``most``."""
    x, y = a.split(" "), b.split(" ")
    known = set(x)
    if sum([len(w) for w in y if w not in known]) > most:  # these are replaced anyway
        return most + 1
    n, m, i, j, cost = len(x), len(y), 0, 0, 0
    if n == m:  # mostly words in their places have changed
        cost = sum([max(len(p), len(q)) for p, q in zip(x, y) if p != q])
        if cost <= most:
            return cost
        cost = 0
    while i < n and j < m and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = 1, 1
        for s in range(1, 2 * AHEAD):
            step = next((p for p in range(max(0, s - AHEAD), min(s, AHEAD) + 1) if i + p < n and j + s - p < m and x[i + p] == y[j + s - p]), None)
            if step is not None:
                p, q = step, s - step
                break
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _pieces(batches, lower: bool = True):
    """(batch, rows, first line numbers, parts, lower-cased bytes) of about PIECE bytes; longer texts are cut between lines."""
    for batch in batches:
        rows, firsts, parts, size = [], [], [], 0
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            data = text.as_py() or ""
            data = (data.lower() if lower else data).encode()
            line = at = 0
            while at <= len(data):
                end = len(data) if len(data) - at <= PIECE else data.find(b"\n", at + PIECE)
                part = data[at:] if end < 0 else data[at:end]
                rows.append(i)
                firsts.append(line)
                parts.append(part)
                size += len(part)
                if size >= PIECE:
                    yield batch, rows, firsts, parts
                    rows, firsts, parts, size = [], [], [], 0
                line += part.count(b"\n") + 1
                at += len(part) + 1
        if rows:
            yield batch, rows, firsts, parts


class _Seen:
    """Which of some 64-bit numbers are new to this task, which reads one split of the input."""

    def __init__(self):
        self.old = np.zeros(0, np.int64)

    def new(self, numbers: np.ndarray) -> np.ndarray:
        """The first positions of the numbers that haven't come before."""
        values, first = np.unique(numbers, return_index=True)
        at = np.searchsorted(self.old, values)
        fresh = self.old[np.minimum(at, len(self.old) - 1)] != values if len(self.old) else np.ones(len(values), bool)
        self.old = np.insert(self.old, at[fresh], values[fresh])
        return np.sort(first[fresh])


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no, line, check, size, blocks): the lines that have a word. ``blocks`` has keys of eight bytes and
    is null for a line that this task has seen before, so a frequent line is compared about once for each task."""

    def run(batches):
        seen = _Seen()
        for batch, rows, firsts, parts in _pieces(batches):
            line, check, size, words, found = identities(b"\n".join(parts))
            counts = np.array([p.count(b"\n") + 1 for p in parts])
            begins = np.cumsum(counts) - counts
            at = np.flatnonzero(words)
            number = np.arange(len(line)) - np.repeat(begins - np.array(firsts), counts)
            owner = pa.array(np.repeat(np.array(rows), counts)[at])
            line = line.view(np.int64)
            first = np.zeros(len(line), bool)
            first[at[seen.new(line[at])]] = True
            holder, keys = block_keys(found, first)
            order = np.argsort(holder, kind="stable")
            many = np.bincount(holder, minlength=len(line))[at]
            offsets = np.concatenate([[0], 8 * np.cumsum(many)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(owner),
                    batch.column(1).take(owner),
                    pa.array(number[at].astype(np.int32)),
                    pa.array(line[at]),
                    pa.array(check.view(np.int64)[at]),
                    pa.array(size[at].astype(np.int32)),
                    _binary(offsets, keys[order], first[at]),
                ],
                ["doc_id", "key", "line_no", "line", "check", "size", "blocks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key long, line_no int, line long, check long, size int, blocks binary")


def _binary(offsets: np.ndarray, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The bytes of ``values``, cut at ``offsets``."""
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [mask, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit integers in a column of bytes, and how many each row has; a null has none."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int64) if data else np.zeros(0, np.int64), np.diff(offsets) // 8


def candidates(lines: DataFrame, similarity: float, joined: int = JOINED, most_held: int = HELD) -> DataFrame:
    """(u, v, bucket, size, place_u, place_v): pairs of lines that share a block (v not null), and the members of larger
    buckets (v null), with the bits of places where they stand.

    The keys of many lines go together: arrays of (bucket, line, spot), dealt by the first PART_BITS bits of the bucket. A part
    is held as a whole, but for members of crowds if it has over HELD rows.
    """

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            keys, many = _numbers(batch.column(0))
            held.append(np.stack([keys, *(np.repeat(batch.column(c).to_numpy(), many) for c in (1, 2))], axis=1))
            size += len(keys)
            if size >= GATHERED:
                yield dealt(np.concatenate(held))
                held, size = [], 0
        if size:
            yield dealt(np.concatenate(held))

    def dealt(rows):
        part = part_of(rows)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), _binary(24 * np.append(starts, len(part)), rows[order])], ["part", "rows"])

    def part_of(rows):
        return (rows[:, 0] >> 64 - PART_BITS).astype(np.int16)

    def distinct(rows, alone):
        """(key, line, spot), sorted; of a line's places the least stays. Lines that are ``alone`` in their bucket may be left out."""
        if not alone:
            key = rows[:, 0]
            order = np.argsort(key)
            same = np.concatenate([[False], key[order[1:]] == key[order[:-1]], [False]])
            rows = rows[order[same[1:] | same[:-1]]]
        key, line, spot = rows[np.lexsort(rows.T[::-1])].T
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        return key[fresh], line[fresh], spot[fresh]

    def members(key):
        """How many members the bucket of each row has."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(key)))
        return np.repeat(many, many)

    def flush(rows, crowds):
        """Pairs of the small buckets and members of the others, also of ``crowds``, some of whose members have been given out."""
        key, line, spot = distinct(rows, len(crowds) > 0)
        many = members(key)
        few, size = (many <= joined) & ~np.isin(key, crowds), spot // BITMAP
        first, second = [], []
        for d in range(1, min(joined, int(many.max(initial=0)))):
            a = np.flatnonzero((key[:-d] == key[d:]) & few[:-d])
            shorter, longer = np.minimum(size[a], size[a + d]), np.maximum(size[a], size[a + d])
            a = a[longer - shorter <= (1 - similarity) * longer + 1e-9]
            first.append(a)
            second.append(a + d)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
        yield batch_of([line[a], line[b], None, None, spot[a] % BITMAP, spot[b] % BITMAP])
        yield crowded(key[~few], line[~few], spot[~few])

    def crowded(key, line, spot):
        return batch_of([line, None, key, spot // BITMAP, spot % BITMAP, None])

    def batch_of(columns):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        arrays = [pa.nulls(len(columns[0]), kind) if c is None else pa.array(c).cast(kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["u", "v", "bucket", "size", "place_u", "place_v"])

    def run(batches):
        held, crowds = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows = np.concatenate([held, _numbers(batch.column(1))[0].reshape(-1, 3)])
            part = part_of(rows)
            open_at = int(np.argmax(part == part[-1]))
            if open_at:
                yield from flush(rows[:open_at], crowds)
                crowds = crowds[:0]
            held = rows[open_at:]
            if len(held) > most_held:
                key, line, spot = distinct(held, True)
                many = (members(key) > joined) | np.isin(key, crowds)
                yield crowded(key[many], line[many], spot[many])
                crowds = np.union1d(crowds, key[many])
                held = np.stack([key[~many], line[~many], spot[~many]], axis=1)
        if len(held):
            yield from flush(held, crowds)

    # Size and place go as one number. Of a line's places the least comes first in every bucket, so it is asked for once.
    spot = F.col("size").cast("long") * BITMAP + place_bit(F.col("key"), F.col("line_no"))
    keyed = lines.where("blocks is not null").select("blocks", "line", spot.alias("spot")).mapInArrow(deal, "part int, rows binary")
    return keyed.repartition("part").sortWithinPartitions("part").mapInArrow(run, FOUND)


#: What ``candidates`` gives.
FOUND = "u long, v long, bucket long, size int, place_u int, place_v int"


def place_bit(key, number):
    """The bit of a place in the map, of columns or NumPy arrays of 64-bit integers."""
    if isinstance(key, np.ndarray):
        return (key ^ number * SPREAD) & (BITMAP - 1)
    return key.bitwiseXOR(number.cast("long") * SPREAD).bitwiseAND(F.lit(BITMAP - 1))


def candidates_by_length(lines: DataFrame, similarity: float) -> DataFrame:
    """All lines as ``candidates`` gives the members of large buckets, in buckets by length in which each two lines meet that can be similar at all.

    A bucket holds two neighbouring ranges of lengths; similar lengths are at most one range apart.
    """
    band = F.floor(F.log("size") / (-np.log(max(similarity, 1e-9)) + 1e-6))
    distinct = lines.where("blocks is not null").groupBy("line").agg(F.min("size").alias("size"), F.min(place_bit(F.col("key"), F.col("line_no"))).cast("int").alias("place_u"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("v", "long"), ("place_v", "int"))]
    return distinct.select(F.col("line").alias("u"), none[0], F.explode(F.array(band, band + 1)).alias("bucket"), "size", "place_u", none[1])


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(line, words, fp, tells): the normalised texts of the lines at ``places`` (place), with their SimHashes; some others may come too.

    A bitmap of fixed size tells at which places of a second scan a text may be wanted; only these lines are hashed again.
    """
    page = F.shiftright("place", 15)

    def mapped(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.unique(batch.column(0).to_numpy())
            for page in np.unique(place >> 15).tolist():
                own = place[place >> 15 == page] & 32_767
                pages.setdefault(page, np.zeros(32_768, bool))[own] = True
        for page, bits in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["page", "bits"])

    parts = places.repartition(page).mapInArrow(mapped, "page int, bits binary").collect()  # BITMAP / 8 bytes
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for part in parts:
        bitmap[part["page"] * 4096 : (part["page"] + 1) * 4096] |= np.frombuffer(part["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        seen = _Seen()
        for batch, rows, firsts, parts in _pieces(batches, lower=False):
            data = b"\n".join(parts)
            ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data))
            begins = np.concatenate([[0], ends[:-1] + 1])
            counts = np.array([p.count(b"\n") + 1 for p in parts])
            number = np.arange(len(ends)) - np.repeat(np.cumsum(counts) - counts - np.array(firsts), counts)
            key = np.repeat(batch.column(0).to_numpy()[np.array(rows)], counts)
            place = place_bit(key, number)
            at = np.flatnonzero(shared.value[place >> 3] >> (place & 7) & 1)
            some = [data[i:j].decode().lower().encode() for i, j in zip(begins[at].tolist(), ends[at].tolist())]
            if not some:
                continue
            line, _, _, words, found = identities(b"\n".join(some))
            fps, tells = line_prints.simhashes(found)
            line = line.view(np.int64)
            at = np.flatnonzero(words)
            at = at[seen.new(line[at])]
            texts = [words_of(some[k]) for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(line[at]), pa.array(texts, pa.string()), pa.array(fps.view(np.int64)[at]), pa.array(tells[at])], ["line", "words", "fp", "tells"])

    return docs.select("key", "text").mapInArrow(run, "line long, words string, fp long, tells boolean").repartition("line").dropDuplicates(["line"])


def simhashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each normalised line, and whether it tells anything; such lines must be within RADIUS bits to be linked."""
    return line_prints.simhashes(identities("\n".join(words).encode())[-1])


def forest(words: list[str], fps: np.ndarray, tells: np.ndarray, similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some lines."""
    return Family(similarity, radius).grow(list(range(len(words))), words, fps, tells)


class Family:
    """Crowds that have lines in common; two lines that were linked or found apart in one of them aren't compared in the next."""

    def __init__(self, similarity: float, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.above: dict[int, int] = {}  # of the lines linked so far
        self.apart: set[tuple[int, int]] = set()
        self.lines = self.chars = 0

    def root(self, name: int) -> int:
        while (up := self.above.get(name, name)) != name:
            self.above[name] = name = self.above.get(up, up)
        return name

    def grow(self, names: list[int], words: list[str], fps: np.ndarray, tells: np.ndarray) -> list[tuple[int, int]]:
        """Edges that, with those of the crowds before, connect what is linked in this crowd.

        Lines with too few runs of characters in common aren't compared (see ``may_be_similar``).
        """
        sizes = np.array([len(w) for w in words])
        counts = class_counts(words)
        classes = np.array([self.root(n) for n in names])
        left, edges, known = np.arange(len(words)), [], bool(self.above)
        while len(left):
            frontier, left = [int(left[0])], left[1:]
            while frontier and len(left):
                i = frontier.pop()
                if known:
                    linked = classes[left] == classes[i]
                    frontier += left[linked].tolist()
                    left = left[~linked]
                longer = np.maximum(sizes[left], sizes[i])
                most = np.floor((1 - self.similarity) * longer + 1e-9)
                told = tells[left] & tells[i]
                near = np.flatnonzero((np.abs(sizes[left] - sizes[i]) <= most) & (~told | (np.bitwise_count(fps[left] ^ fps[i]) <= self.radius)))
                if len(near):
                    near = near[may_be_similar(counts[left[near]], counts[i], longer[near], most[near])]
                reached, places, own = [], None, set(words[i].split(" ")) if len(near) else ()
                for k, j, size, edits in zip(near.tolist(), left[near].tolist(), longer[near].tolist(), most[near].astype(int).tolist()):
                    pair = (names[i], names[j]) if names[i] < names[j] else (names[j], names[i])
                    if pair in self.apart:
                        continue
                    if sum([len(w) for w in words[j].split(" ") if w not in own]) > edits:  # hardly similar: its characters are looked for in this line, whose places are listed once
                        places = places or _places(words[i])
                        if size - _subsequence(words[j], places, (1 << len(words[i])) - 1, size - edits) > edits:
                            self.apart.add(pair)
                            continue
                    if similar(words[i], words[j], self.similarity):
                        reached.append(k)
                        frontier.append(j)
                        edges.append((names[i], names[j]))
                        self.above[self.root(names[j])] = self.root(names[i])
                    else:
                        self.apart.add(pair)
                left = np.delete(left, reached) if reached else left
        self.lines, self.chars = self.lines + len(words), self.chars + int(sizes.sum())
        return edges


def _crowds(batches):
    """The rows of each (least, pair, bucket), which follow one another."""
    held, name = [], None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in range(3)]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            own = tuple(int(k[start]) for k in keys)
            if held and own != name:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            name = own
    if held:
        yield pa.Table.from_batches(held)


def links(docs: DataFrame, lines: DataFrame, similarity: float, radius: int = RADIUS, joined: int = JOINED, tile: int = TILE, exact: bool = False) -> DataFrame:
    """(u, v): edges that connect all lines that share a block, have SimHashes within ``radius`` bits (where those tell
    anything) and an edit distance of at most 1 - similarity. If ``exact``, blocks and SimHashes aren't asked for."""
    found = materialise(candidates_by_length(lines, similarity) if exact else candidates(lines, similarity, joined), "line-candidates")
    radius = 64 if exact else radius
    pairs = found.where("v is not null").select("u", "v").distinct()
    crowds = found.where("v is null").select(F.col("u").alias("line"), "bucket", "size")
    places = found.select(F.explode(F.array("place_u", "place_v")).alias("place")).where("place is not null")
    wanted = texts_of(docs, places)
    if exact:  # shorter lines have no blocks either
        wanted = wanted.where(F.length(F.replace("words", F.lit(" "), F.lit(""))) >= line_prints.LEAST_CHARS)
    texts = materialise(wanted, "line-texts")

    def check(batches):
        for batch in batches:
            near = pa.array(similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in (0, 1)], ["u", "v"])

    def of(rows: DataFrame, line: str) -> DataFrame:
        """The texts of a column of lines; they are exchanged by line, in the same way for each column."""
        joined = rows.hint("shuffle_hash").join(texts, F.col(line) == F.col("line"))
        return joined.select(*rows.columns, *(F.col(c).alias(f"{c}_{line}") for c in ("words", "fp", "tells")))

    near = (F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= radius) | ~(F.col("tells_u") & F.col("tells_v"))
    checked = of(of(pairs, "u"), "v").where(near).select("u", "v", "words_u", "words_v").mapInArrow(check, "u long, v long")

    # A crowd of more than a tile is dealt to tiles, and each two tiles meet in one task.
    # Crowds that have their least line in common are likely to share others: they go to one task, which doesn't compare two lines again.
    sizes = crowds.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.min("line").alias("least"))
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("chars") / TILE_CHARS)).cast("int")
    mine = F.pmod("line", F.col("tiles")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, mine).cast("long") * 1_000_000 + F.greatest(t, mine))
    dealt = crowds.join(sizes.select("bucket", tiles.alias("tiles"), "least"), "bucket").select("least", "bucket", "line", F.explode(met).alias("pair"))

    def grow(batches):
        family, name = None, None
        for crowd in _crowds(batches):
            own = [crowd.column(c)[0].as_py() for c in ("least", "pair")]
            if own != name or family.lines > FAMILY or family.chars > FAMILY_CHARS:
                family, name = Family(similarity, radius), own
            edges = family.grow(crowd.column("line").to_pylist(), crowd.column("words").to_pylist(), crowd.column("fp").to_numpy().view(np.uint64), crowd.column("tells").to_numpy())
            u, v = np.array(edges, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    members = dealt.hint("shuffle_hash").join(texts, "line").select("least", "pair", "bucket", "line", "words", "fp", "tells")
    grown = members.repartition("least", "pair").sortWithinPartitions("least", "pair", "bucket").mapInArrow(grow, "u long, v long")
    edges = materialise(checked.unionAll(grown), "line-edges")
    discard(found)
    discard(texts)
    return edges


def line_dedup(docs: DataFrame, similarity: float = 0.8, radius: int = RADIUS, carry: tuple[str, ...] = (), joined: int = JOINED, tile: int = TILE, exact: bool = False) -> DataFrame:
    """One row per input row: doc_id, text (without the lines that were removed), n_lines, n_removed, and ``carry``.

    Lines end at a newline. They are compared lower-cased, as runs of letters, digits and non-ASCII characters. Equal
    lines of any length are one group; lines that share a block of their SimHashes (see ``line_prints``), whose
    SimHashes as a whole differ in at most ``radius`` bits, are linked if their edit distance is at most 1 - ``similarity`` of
    the longer one; for lines of fewer than 64 letters and digits or without blanks, a shared block is enough to be compared. Of
    each connected group the occurrence with the least (doc_id, line number) stays, all others go,
    within a document too; a null doc_id comes first. Lines without a letter or digit stay as they are; lines of
    fewer than 8 letters and digits are compared for equality only. A null text stays null
    and has no lines; rows that repeat both id and text keep and lose the same lines. An empty table gives no
    rows; other columns are ignored.

    Similar lines that share no block stay unlinked. With ``exact`` no link is lost: all lines of 8 letters and digits or more meet all
    others of about their length, in tiles of ``tile`` lines, so a task holds two tiles; the work grows with the square of the number of distinct lines.
    """
    kept = ["doc_id", *carry]
    docs = docs.select("doc_id", "text", *carry).withColumn("key", F.xxhash64("doc_id", "text"))
    lines = materialise(occurrences(docs), "lines")
    edges = links(docs, lines, similarity, radius, joined, tile, exact)
    roots = connected_components(edges)
    discard(edges)
    groups = roots.select(F.col("node").alias("line"), "root").unionAll(roots.select(F.col("root").alias("line"), "root").distinct())

    place = F.struct("doc_id", "key", "line_no")
    firsts = lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"))
    grouped = firsts.join(groups, "line", "left").where("(n > 1 or root is not null) and check = other").withColumn("root", F.coalesce("root", "line"))
    grouped = materialise(grouped.select("line", "root", "first", "n"), "line-groups")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("n")).where("n > 1").select("root", "stays")
    repeated = grouped.select("line", "root").join(stays, "root").select("line", "stays")
    removed = lines.select("doc_id", "key", "line_no", "line").join(repeated.hint("shuffle_hash"), "line").where(place != F.col("stays"))
    removed = materialise(removed.groupBy("key").agg(F.collect_set("line_no").alias("removed")), "lines-removed")
    for done in (lines, roots, grouped):
        discard(done)

    # What stays of the line numbers is told by a hash set, so a text takes time in proportion to its lines.
    split = F.split("text", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.col("parts")[i]), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    found = docs.join(removed.hint("shuffle_hash"), "key", "left").select(*kept, "text", "removed", split.alias("parts"))
    return found.select(*kept, text.alias("text"), n_lines.alias("n_lines"), F.greatest(n_removed, F.lit(0).cast("long")).alias("n_removed"))
