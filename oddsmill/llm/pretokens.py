"""Pre-tokens of byte-level vocabularies, found without regular expressions.

The public pattern cuts a text into contractions, runs of letters, of numbers
and of other signs (each with one leading blank), and white space.  Here each
code point gets a symbol from a class array and its neighbours, a finite
automaton reads the symbols, and a piece starts wherever a step of the
automaton says so.  A step is a function from states to states and functions
compose associatively, so texts are cut into blocks of fixed length: all
blocks compose their steps at once, the blocks' functions are scanned, and all
blocks are replayed at once from their now known states.

Which code points are letters or numbers depends on the version of Unicode a
library was built with, so a library is asked for each code point once (see
``edges``), and its answer travels as the list of places where it changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np

# Classes of code points.
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE = range(5)
# White space of the pattern's \s.  Fixed values.
_WHITE_POINTS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Symbols: L, N, other, apostrophe of a contraction of two or three characters, blank before a
# sign, white space before white space or an end, other white space before a sign, end of a text.
_L, _N, _O, _A2, _A3, _SP, _WS, _WL, _END = range(9)
# States: fresh (the next sign starts a piece), in letters, in numbers, in others, after a leading
# blank, in white space, one or two characters of a contraction to come.
_FRESH, _INL, _INN, _INO, _LEAD, _INW, _C1, _C2 = range(8)
_STATES = 8
_BLOCK = 64
#: Characters scanned at once; longer texts are cut where a piece is sure to start.
CHUNK_CHARS = 1 << 18
_POINTS = 0x110000
_SURROGATES = range(0xD800, 0xE000)
# Planes 4 to 13 hold no characters; 15 and 16 are for private use.
_EMPTY = (*range(4, 14), 15, 16)
#: Code points asked for at once.
_ASKED = 256


def edges(joins: Callable[[str, str], np.ndarray], alike: Callable[[str], bool] | None = None) -> tuple[bytes, bytes]:
    """Where letters begin and end among code points, and where numbers do, as packed 32-bit integers.

    ``joins(first, points)`` says for each of the points whether ``first`` and
    it are one piece; ``alike(text)``, where given, whether a text is one
    piece, which settles blocks of one class by a question or two.
    """
    member = {first: np.zeros(_POINTS + 2, bool) for first in "a1"}

    def ask(at: int) -> None:
        points = "".join(map(chr, range(at, at + _ASKED)))
        one = next((c for c in "a1!" if alike(c + points)), None) if alike else None
        for first in "a1":
            member[first][at + 1 : at + 1 + _ASKED] = joins(first, points) if one is None else one == first

    with ThreadPoolExecutor() as pool:
        list(pool.map(ask, [at for at in range(0, _POINTS, _ASKED) if at not in _SURROGATES and at >> 16 not in _EMPTY]))
    letters, numbers = (np.flatnonzero(m[1:] != m[:-1]).astype("<u4").tobytes() for m in member.values())
    return letters, numbers


@cache
def tiktoken_edges() -> tuple[bytes, bytes]:
    """Letters and numbers as the tiktoken library sees them in the public pattern.

    The probe's vocabulary has all bytes and, for "a" and for "1", each pair
    with a byte that follows: a pair comes out where both are in one piece.
    """
    import public_tokenizers
    import tiktoken

    pairs = [first + bytes([b]) for first in (b"a", b"1") for b in range(256)]
    probe = tiktoken.Encoding(
        "probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate(pairs)}, special_tokens={}
    )

    def joins(first: str, points: str) -> np.ndarray:
        ids = np.array(probe.encode_ordinary("".join(f"{first}{c}\n" for c in points)))
        lowest = 256 if first == "a" else 512
        paired = (ids >= lowest) & (ids < lowest + 256)
        return paired[paired | (ids == ord(first))]

    return edges(joins)


@cache
def classes(letters: bytes, numbers: bytes) -> np.ndarray:
    """Class of every code point, one past the last included, from ``edges``."""
    out = np.full(_POINTS + 1, _OTHER, np.uint8)
    for kind, packed in ((_LETTER, letters), (_NUMBER, numbers)):
        for a, b in np.frombuffer(packed, "<u4").reshape(-1, 2).tolist():
            out[a:b] = kind
    out[list(_WHITE_POINTS)] = _WHITE
    out[0x20] = _BLANK
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece start here) by symbol and state."""
    step = np.zeros((9, _STATES), np.uint8)
    start = np.ones((9, _STATES), bool)
    for s in range(_STATES):
        for symbol, run in ((_L, _INL), (_N, _INN), (_O, _INO)):
            step[symbol, s] = run
            start[symbol, s] = s not in (run, _LEAD)
        for symbol, rest in ((_A2, _C1), (_A3, _C2)):
            inside = s in (_INO, _LEAD)  # an apostrophe within signs, or led by a blank, is a sign
            step[symbol, s], start[symbol, s] = (_INO if inside else rest), not inside
        step[_SP, s] = _LEAD
        step[_WS, s], start[_WS, s] = _INW, s != _INW
        step[_WL, s] = _FRESH
        step[_END, s] = _FRESH
    step[_L, _C2], start[_L, _C2] = _C1, False
    step[_L, _C1], start[_L, _C1] = _FRESH, False
    return step, start


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of symbols can compose to, number 0 the identity.

    Returns the functions, the number of "f, then one symbol" at f * 9 + symbol,
    and the number of "f, then g" at [f, g].
    """
    step, _ = automaton()
    known = {tuple(range(_STATES)): 0}
    todo = list(known)
    for f in todo:
        for symbol in range(9):
            g = tuple(int(step[symbol, s]) for s in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
    by_symbol = [known[tuple(int(step[symbol, s]) for s in f)] for f in todo for symbol in range(9)]
    product = [[known[tuple(g[s] for s in f)] for g in todo] for f in todo]
    return np.array(todo, np.uint8), np.array(by_symbol, np.intp), np.array(product, np.intp)


def _symbols(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Symbols of code points; 0x110000 ends a text."""
    kind = kinds.take(points)
    end = points == 0x110000
    out = kind.copy()  # letters, numbers and others are their own symbols
    white = kind >= _BLANK
    last = np.empty(len(points), bool)  # the next code point is a sign
    last[:-1] = ~(white[1:] | end[1:])
    last[-1:] = False
    out[white] = np.where(last[white], np.where(kind[white] == _BLANK, _SP, _WL), _WS)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        a, b = padded[at + 1], padded[at + 2]
        two = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)  # s t m d
        three = (((a == 0x72) | (a == 0x76)) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))  # re ve ll
        out[at[two]], out[at[three]] = _A2, _A3
    out[end] = _END
    return out


def starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point, by a blocked scan of composed steps."""
    step, start = automaton()
    n = len(points)
    if not n:
        return np.empty(0, bool)
    blocks = -(-n // _BLOCK)
    symbols = np.full(blocks * _BLOCK, _END, np.uint8)
    symbols[:n] = _symbols(points, kinds)
    columns = np.ascontiguousarray(symbols.reshape(blocks, _BLOCK).T)
    functions, by_symbol, product = monoid()
    # each block's composed function, by its number in the monoid
    whole = np.zeros(blocks, np.intp)
    for column in columns:
        whole = by_symbol[whole * 9 + column]
    state = np.concatenate(([_FRESH], functions[_scanned(whole, product), _FRESH][:-1])).astype(np.intp)
    flat, flat_start = step.ravel().astype(np.intp), start.ravel()
    out = np.empty((_BLOCK, blocks), bool)
    for k, column in enumerate(columns):
        at = column * np.intp(_STATES) + state
        out[k] = flat_start[at]
        state = flat[at]
    return out.T.reshape(-1)[:n]


def _scanned(whole: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive scan by doubling: the composition of all functions up to each block."""
    gap = 1
    while gap < len(whole):
        whole = np.concatenate((whole[:gap], product[whole[:-gap], whole[gap:]]))
        gap *= 2
    return whole


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK_CHARS, cut only before a blank that follows a sign: a piece starts there whatever came before."""
    at = 0
    while len(text) - at > 2 * CHUNK_CHARS:
        cut = at + CHUNK_CHARS
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or not text[cut - 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[str], bool]]:
    """Texts, or parts of a long one, to be scanned together; whether a part is to be continued by the next."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if len(text) > 2 * CHUNK_CHARS:
            if held:
                yield held, False
            held, size = [], 0
            before = None
            for part in _parts(text):
                if before is not None:
                    yield [before], True
                before = part
            yield [before], False
            continue
        held.append(text)
        size += len(text) + 1
        if size >= CHUNK_CHARS:
            yield held, False
            held, size = [], 0
    if held:
        yield held, False


def _bounds(texts: list[str], kinds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each piece, byte after it, pieces of each text)."""
    joined = "".join(f"{t}\0" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = 0x110000
    first = starts(points, kinds)
    first[ends] = True
    marks = np.flatnonzero(first)
    raw = joined.encode("utf-8", "surrogatepass")
    at = marks
    if len(raw) != len(points):
        heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # bytes that begin a code point
        at = np.flatnonzero(heads)[marks]
    last = np.searchsorted(marks, ends)  # the mark at the end of each text is no piece
    a, b = np.delete(at, last), np.delete(at, np.concatenate((last[:1] * 0, last[:-1] + 1)))
    return raw, a, b, np.diff(last, prepend=-1) - 1


def pieces(texts: list[str | None], kinds: np.ndarray | None = None) -> Iterator[list[bytes]]:
    """The pieces of each text in order, as UTF-8; null is an empty text."""
    kinds = classes(*tiktoken_edges()) if kinds is None else kinds
    held: list[bytes] = []
    for group, more in _groups(texts):
        raw, a, b, counts = _bounds(group, kinds)
        own = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        if more or held:
            held += own
            if not more:
                yield held
                held = []
            continue
        at = 0
        for n in counts.tolist():
            yield own[at : at + n]
            at += n


def distinct(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct piece, the number of each piece's distinct one).

    Pieces of up to 16 bytes are compared by their first and last eight bytes
    and their length, sorted by a 64-bit mix of these and then verified; longer
    ones, and any that the mix confuses, count as distinct.
    """
    size = b - a
    buffer = bytes(8) + raw + bytes(8)
    window = np.ndarray((len(buffer) - 7,), np.dtype("<u8"), buffer, 0, (1,))
    short = np.minimum(size, 8)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - short) * 8).astype(np.uint64)
    head = window[a + 8] & mask
    tail = np.where(size > 8, window[b], np.uint64(0))
    mix = (head ^ (tail * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)
    mix ^= mix >> np.uint64(31)
    order = np.argsort(mix)
    ranked = mix[order]
    new = np.ones(len(mix), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at, number = order[new], np.empty(len(mix), np.int64)
    number[order] = np.cumsum(new) - 1
    like = at[number]
    odd = np.flatnonzero((size > 16) | (head != head[like]) | (tail != tail[like]) | (size != size[like]))
    number[odd] = len(at) + np.arange(len(odd))
    return np.concatenate((at, odd)), number


#: Bytes that Python needs for an entry of the cache besides the characters: two headers and a place in a table.
_ENTRY = 180


class Coder:
    """Identifiers of texts from identifiers of pieces; each distinct piece of a group is looked up once.

    Two generations of a cache bound it: when the younger holds ``most`` bytes
    (what Python needs for an entry included) it becomes the older, from which
    what is used again is carried over.
    """

    def __init__(self, kinds: np.ndarray, most: int, longest: int):
        self.kinds, self.most, self.longest, self.held = kinds, most, longest, 0
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """Packed 32-bit identifiers of pieces."""
        raise NotImplementedError

    def look_up(self, wanted: list[bytes]) -> list[bytes]:
        packed = list(map(self.known.get, wanted))
        gaps = [i for i, x in enumerate(packed) if x is None]
        if gaps:
            keys = [wanted[i] for i in gaps]
            found = list(map(self.older.get, keys))
            missing = [j for j, x in enumerate(found) if x is None]
            for j, ids in zip(missing, self.learn([keys[j] for j in missing]), strict=True):
                found[j] = ids
            for i, ids in zip(gaps, found, strict=True):
                packed[i] = ids
            if max(map(len, keys)) > self.longest:
                short = [j for j, k in enumerate(keys) if len(k) <= self.longest]
                keys, found = [keys[j] for j in short], [found[j] for j in short]
            self.known.update(zip(keys, found, strict=True))
            self.held += sum(map(len, keys)) + sum(map(len, found)) + _ENTRY * len(keys)
            if self.held > self.most:
                self.known, self.older, self.held = {}, self.known, 0
        return packed

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Identifiers of each text in order."""
        held: list[np.ndarray] = []
        for group, more in _groups(texts):
            raw, a, b, counts = _bounds(group, self.kinds)
            place, number = distinct(raw, a, b)
            packed = self.look_up([raw[i:j] for i, j in zip(a[place].tolist(), b[place].tolist(), strict=True)])
            flat = np.frombuffer(b"".join(packed), "<u4")
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            begins = np.cumsum(sizes) - sizes
            own = sizes[number]
            to = np.cumsum(own)
            total = int(to[-1]) if len(to) else 0
            ids = flat[np.repeat(begins[number] - (to - own), own) + np.arange(total)].astype(np.int32)
            if more or held:
                held.append(ids)
                if not more:
                    yield np.concatenate(held)
                    held = []
                continue
            stops = np.concatenate(([0], to))[np.cumsum(counts)].tolist()
            begin = 0
            for stop in stops:
                yield ids[begin:stop]
                begin = stop
