"""Pre-tokenisation without a regex engine: where the pieces begin that byte-pair merging works on.

The pieces are the matches of
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
which cover a text without gaps. Every code point gets a class from a table; where the pattern looks
ahead (the last white space before something else, an apostrophe with its letters), the class says
what follows. A class is then a function from the state left of the code point to the state right of
it. Functions compose associatively and few different ones arise, so each has a number and composing is
one look in a table. A batch of texts is scanned at once: the functions of all blocks grow side by side,
then the blocks' own functions are applied one after another, then those inside the blocks.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import tiktoken

# Classes of code points.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_RUN, SPACE_GLUE, SPACE_LAST, BREAK = range(9)
# States: what the code point just read belongs to. After QUOTE1 one letter is to come, after QUOTE2 two.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_RUN, GLUE, LAST, NEED1, NEED2, DONE = range(10)
_N_STATES = 10
_BLOCK = 512


def _transitions() -> np.ndarray:
    to = np.empty((9, _N_STATES), np.uint8)
    for kind, state in (
        (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (QUOTE1, NEED1), (QUOTE2, NEED2),
        (SPACE_RUN, IN_RUN), (SPACE_GLUE, GLUE), (SPACE_LAST, LAST), (BREAK, START),
    ):
        to[kind] = state
    # An apostrophe opens a contraction only at the start of a piece.
    for kind in (QUOTE1, QUOTE2):
        to[kind, [IN_OTHER, GLUE]] = IN_OTHER
    to[LETTER, NEED1] = DONE
    to[LETTER, NEED2] = NEED1
    return to


def _continues() -> np.ndarray:
    """Whether a code point of a class stays in the piece of the state before it."""
    same = np.zeros((9, _N_STATES), bool)
    same[LETTER, [IN_LETTERS, GLUE, NEED1, NEED2]] = True
    same[NUMBER, [IN_NUMBERS, GLUE]] = True
    for kind in (OTHER, QUOTE1, QUOTE2):
        same[kind, [IN_OTHER, GLUE]] = True
    same[SPACE_RUN, IN_RUN] = True
    return same


def _closure(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All functions that arise from runs of code points: their values, and their compositions with one more.

    The last step is a class, or a class plus nine for the first code point of a text, where the state is
    START whatever came before. Function 0 is the identity.
    """
    steps = [tuple(f) for f in to.tolist()] + [(f[START],) * _N_STATES for f in to.tolist()]
    functions, then = [tuple(range(_N_STATES))], []
    number = {functions[0]: 0}
    for f in functions:  # grows while it is read
        row = []
        for step in steps:
            made = tuple(step[x] for x in f)
            if made not in number:
                number[made] = len(functions)
                functions.append(made)
            row.append(number[made])
        then.append(row)
    return np.array(functions, np.uint8), np.array(then, np.uint16)


TO, CONTINUES = _transitions(), _continues()
FUNCTIONS, THEN = _closure(TO)


@cache
def table() -> np.ndarray:
    """The class of every code point as the tokenizer library sees it: its own engine says which ones match."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    bytes_only = {bytes([i]): i for i in range(256)}
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE_RUN)):
        engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        matched = bytes(engine.encode_ordinary(every)).decode()
        kinds[np.frombuffer(matched.encode("utf-32-le"), "<u4")] = kind
    return kinds


def classes(points: np.ndarray, break_before: np.ndarray) -> np.ndarray:
    """The class of each code point; a text ends at the end and before each position of ``break_before``."""
    kinds = table()[points]
    n = len(points)
    ends = np.zeros(n, bool)  # whether a text ends after the code point
    ends[-1:] = True
    ends[break_before - 1] = True

    following = np.append(points[1:], 0)
    space = kinds == SPACE_RUN
    last = space & ~np.append(space[1:], True) & ~ends
    kinds[last] = np.where(points[last] == 0x20, SPACE_GLUE, SPACE_LAST)

    at = np.flatnonzero((points == 0x27) & ~ends)
    one = following[at]
    kinds[at[np.isin(one, _codes("stmd"))]] = QUOTE1
    at = at[np.isin(one, _codes("rvl"))]
    at = at[(at + 2 < n) & ~ends[np.minimum(at + 1, n - 1)]]
    first, second = points[at + 1], points[at + 2]
    pair = (second == ord("e")) & ((first == ord("r")) | (first == ord("v")))
    pair |= (first == ord("l")) & (second == ord("l"))
    kinds[at[pair]] = QUOTE2
    return kinds


def _codes(letters: str) -> np.ndarray:
    return np.array([ord(c) for c in letters])


def starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece starts, piece ends, text of each piece) over the joined texts, in code points."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    n = len(points)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    begins = np.cumsum(lengths) - lengths
    begins_some = np.unique(begins[lengths > 0])
    kinds = classes(points, begins_some[begins_some > 0])

    steps = kinds.copy()
    steps[begins_some] += 9
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, BREAK, np.uint8)
    padded[:n] = steps
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    grown = np.empty((_BLOCK, rows), np.uint16)  # the function from the start of the block to here
    now = np.zeros(rows, np.uint16)
    for j in range(_BLOCK):
        now = grown[j] = THEN[now, columns[j]]
    entry, state = [], START
    for f in FUNCTIONS[now].tolist():
        entry.append(state)
        state = f[state]
    after = FUNCTIONS[grown, np.array(entry)].T.ravel()[:n]  # the state after each code point
    before = np.append(np.uint8(START), after[:-1])
    before[begins_some] = START

    first = np.flatnonzero(~CONTINUES[kinds, before])
    return first, np.append(first[1:], n), np.searchsorted(begins, first, side="right") - 1
