"""Vectorised pre-tokenisation for byte-level BPE vocabularies, without regular expressions.

The split that the vocabularies are made for is a finite automaton over classes
of code points.  Each code point is mapped to a symbol (its class, with the
little look-ahead the split needs); each symbol is a function from state to
state.  Functions compose associatively, so a long text is cut into equal
blocks, the functions of all blocks are composed at the same time, a
doubling scan over the blocks gives the state each one starts in, and a last
pass marks the token starts.  The first symbol of a text ignores the state, so
any number of texts go through one scan.
"""

from __future__ import annotations

import unicodedata

import numpy as np

# The code points of the Unicode property White_Space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contraction endings, after an apostrophe, of one and of two letters.
ENDINGS_1 = "stmd"
ENDINGS_2 = ["re", "ve", "ll"]

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: a class, an apostrophe before an ending of one or two letters, a
#: joinable blank (U+0020 before a non-blank), another blank before a non-blank,
#: a blank before a blank or the end.
S_LETTER, S_NUMBER, S_OTHER, S_END1, S_END2, S_JOIN, S_LONE, S_BLANK = range(8)
#: States: what the open token accepts.  SHUT: nothing; BLANKS: blanks; JOINED: a
#: blank that takes a run of any class; LETTERS, NUMBERS, OTHERS: their run;
#: NEED1, NEED2: one or two letters of a contraction.
SHUT, BLANKS, JOINED, LETTERS, NUMBERS, OTHERS, NEED1, NEED2 = range(8)
STATES, SYMBOLS = 8, 8
BLOCK = 64

_UNKNOWN = 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)
_classes[WHITE_SPACE] = SPACE


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by [symbol, state]; symbols 8 to 15 are those at the start of a text."""
    step, start = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.ones((2 * SYMBOLS, STATES), bool)
    fresh = {S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_OTHER: OTHERS, S_END1: NEED1, S_END2: NEED2, S_JOIN: JOINED, S_LONE: SHUT, S_BLANK: BLANKS}
    for symbol, state in fresh.items():
        step[[symbol, symbol + SYMBOLS]] = state
    for symbol, run in ((S_LETTER, LETTERS), (S_NUMBER, NUMBERS), (S_OTHER, OTHERS), (S_END1, OTHERS), (S_END2, OTHERS)):
        for state in (run, JOINED):
            step[symbol, state], start[symbol, state] = run, False
    step[S_LETTER, NEED2], start[S_LETTER, NEED2] = NEED1, False
    step[S_LETTER, NEED1], start[S_LETTER, NEED1] = SHUT, False
    start[S_BLANK, BLANKS] = False
    return step, start


STEP, START = _automaton()


def classes(points: np.ndarray) -> np.ndarray:
    """Letter, number, blank or other for each code point, by the Unicode tables of this Python."""
    found = _classes[points]
    if (new := found == _UNKNOWN).any():
        for p in np.unique(points[new]).tolist():
            _classes[p] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(p))[0], OTHER)
        found = _classes[points]
    return found


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol for each code point; ``first`` marks the first of every text."""
    n = len(points)
    kind = classes(points)
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_BLANK], np.uint8)[kind]
    within = np.zeros(n, bool)  # the next code point is of the same text
    within[:-1] = ~first[1:]
    blank = np.flatnonzero(kind == SPACE)
    blank = blank[within[blank]]
    blank = blank[kind[blank + 1] != SPACE]
    symbol[blank] = np.where(points[blank] == 0x20, S_JOIN, S_LONE)
    tick = np.flatnonzero(points == 0x27)
    tick = tick[within[tick]]
    one = np.isin(points[tick + 1], [ord(c) for c in ENDINGS_1])
    symbol[tick[one]] = S_END1
    tick = tick[~one]
    tick = tick[tick + 2 < n]
    tick = tick[within[tick + 1]]
    two = np.isin(points[tick + 1].astype(np.int64) << 32 | points[tick + 2], [ord(a) << 32 | ord(b) for a, b in ENDINGS_2])
    symbol[tick[two]] = S_END2
    symbol[first] += SYMBOLS
    return symbol


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A flag for each code point that starts a token, by an associative scan of transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    symbol = symbols(points, first)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint8)
    grid.reshape(-1)[:n] = symbol
    by_step = np.ascontiguousarray(grid.T)
    flat_step, flat_start = STEP.reshape(-1), START.reshape(-1)
    # Compose each block's functions: row s holds the state reached from s.
    reach = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in by_step:
        reach = flat_step[(column.astype(np.int16) * STATES)[:, None] + reach]
    # Doubling scan over the blocks: afterwards row b is the function of blocks 0 to b.
    shift = 1
    while shift < blocks:
        reach[shift:] = np.take_along_axis(reach[shift:], reach[:-shift], axis=1)
        shift *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = reach[:-1, SHUT]
    starts = np.empty((BLOCK, blocks), bool)
    for i, column in enumerate(by_step):
        at = column.astype(np.int16) * STATES + state
        starts[i], state = flat_start[at], flat_step[at]
    return np.ascontiguousarray(starts.T).reshape(-1)[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, byte offset where each token starts plus the end, tokens before each text plus the total).

    Lone surrogates, which UTF-8 can't hold, become U+FFFD first.
    """
    try:
        wide = "".join(texts).encode("utf-32-le")
    except UnicodeEncodeError:
        texts = [t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts]
        wide = "".join(texts).encode("utf-32-le")
    points = np.frombuffer(wide, np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    first = np.zeros(len(points), bool)
    first[(ends - lengths)[lengths > 0]] = True
    starts = np.flatnonzero(token_starts(points, first))
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=byte_at[1:])
    offsets = np.append(byte_at[starts], byte_at[-1])
    before = np.searchsorted(starts, np.concatenate([[0], ends]))
    return "".join(texts).encode("utf-8"), offsets, before
