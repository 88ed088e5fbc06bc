"""Plain forms of disguised words, sentences and hashed terms for classifiers over forum text.

A batch of texts is worked on as one string and one array of its code points:
markup, accents and spelled-out words are undone over the whole string, words
and sentences are found by classes of code points, and each distinct word of a
batch is hashed once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np
import regex

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аевгдзікмнорстухјѕԁһɡαεικνορτυχ", "aebrg3ikmhopctyxjsdhgaeiknoptux")
# Digits and signs that stand for letters.
STAND_INS = str.maketrans("013457@$!+|", "oieastasiti")

# Names of tags; other words in brackets are text.
_BB = "b|i|u|s|url|img|quote|code|list|li|size|color|font|center|left|right|email|user|spoiler|sub|sup|table|tr|td|th|hr|br"
_HTML = "a|abbr|b|big|blockquote|body|br|center|cite|code|dd|del|div|dl|dt|em|font|form|h[1-6]|head|hr|html|i|iframe|img|input|ins|kbd|li|link|meta|ol|p|pre|q|s|script|small|span|strike|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|tt|u|ul|video"
#: Stands between the texts of a batch; no pattern matches across it.
_END = "\x1e"
_BETWEEN = f"\n{_END}\n"
_TAGS = re.compile(rf"\[/?(?:{_BB})(?:=([^\[\]{_END}]*))?\]|</?(?:{_HTML})(?:[^\S{_END}]([^<>={_END}]*=[^<>{_END}]*)|[^\S{_END}]*/?)>", re.I)
_INVISIBLE = regex.compile(r"\p{Cf}+")
_MARKS = re.compile("[̀-ͯ]+")
_SPELLED = re.compile(r"\b[^\W_]([-_.*~·])[^\W_](?:\1[^\W_]){2,}(?!\w)|\b[^\W\d_](?: [^\W\d_]){3,}(?!\w)")
_JOINERS = re.compile(r"[-_.*~· ]")
_JOINING = np.isin(np.arange(256), [ord(c) for c in "-_.*~· "])
_JOINING[255] = False
_REPEAT = re.compile(r"(.)\1+")
_LATIN, _ALIEN = re.compile("[a-z]"), regex.compile(r"[\p{Cyrillic}\p{Greek}]")
# Scripts written without blanks.
_CJK = "ぁ-ヿ㐀-䶿一-鿿"
_UNSPACED = re.compile(f"[{_CJK}]")

# Classes of code points.  A word is a run of INNER ones from its first ALNUM to its last TAIL.
ALNUM, INNER, TAIL, DIGIT, UNSPACED, BREAK, STOP, AFTER = (1 << i for i in range(8))
_CLASSES = {
    ALNUM: r"[^\W_]+",
    INNER: r"[\w*@$!#+|']+",
    TAIL: r"[\w*@$+]+",
    DIGIT: r"\d+",
    UNSPACED: f"[{_CJK}]+",
    # A sentence ends at a line's end or a full stop of the unspaced scripts, or at a stop with blanks or quotes after it.
    BREAK: f"[\n\r\x0b\x0c\x85  。！？{_END}]+",
    STOP: r"[.!?…]+",
    AFTER: r"[\s»”\"]+",
}


#: Code points from here on are ideographs, so far as words go.
_REST = 0x20000


@cache
def _classes() -> np.ndarray:
    """The classes of the code points below ``_REST``, as bits, and one entry for all others."""
    every = "".join(map(chr, range(_REST)))
    table = np.zeros(_REST + 1, np.uint8)
    for bit, pattern in _CLASSES.items():
        for m in re.finditer(pattern, every):
            table[m.start() : m.end()] |= bit
    table[_REST] = ALNUM | INNER | TAIL
    return table


def _kinds(codes: np.ndarray) -> np.ndarray:
    return _classes()[np.minimum(codes, _REST)]


def _spelled(text: str, codes: np.ndarray, kind: np.ndarray) -> str:
    """Text with words spelled letter by letter (``s_c_u_m``, ``s c u m``) written as one.

    Where a letter or digit stands alone between equal signs three times is seen
    in the array; the pattern then only looks there.
    """
    if len(codes) < 7:
        return text
    n = len(codes) - 6
    sign = codes[1 : n + 1]
    at = (sign == codes[3 : n + 3]) & (sign == codes[5 : n + 5])
    for i in (0, 2, 4, 6):
        at &= (kind[i : n + i] & ALNUM) != 0
    starts = np.flatnonzero(at & _JOINING[np.minimum(sign, len(_JOINING) - 1)]).tolist()
    pieces, done = [], 0
    for i in starts:
        if i >= done and (m := _SPELLED.match(text, i)):
            pieces += [text[done:i], _JOINERS.sub("", m[0])]
            done = m.end()
    return "".join([*pieces, text[done:]]) if pieces else text


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The plain forms of all texts in one string, the text that each of its pieces belongs to, and its code points with their classes.

    Plain is lower case without tags, invisible characters, accents and letters
    spelled one by one.  A tag is cut out, so a word it stood in is whole again;
    what tags hold follows after the texts, as pieces of their own.
    """
    parts = [t or "" for t in texts]
    whole = _BETWEEN.join(parts)
    if whole.count(_END) >= len(parts):
        whole = _BETWEEN.join(t.replace(_END, "\n") for t in parts)
    if "&" in whole:
        whole = html.unescape(whole)
    owner = np.arange(len(parts))
    if "[" in whole or "<" in whole:
        inside: list[str] = []
        at: list[int] = []

        def cut(m: re.Match) -> str:
            held = m[1] or m[2]
            if held:
                inside.append(held)
                at.append(m.start())
            return ""

        bare = _TAGS.sub(cut, whole)
        if inside:
            ends = np.flatnonzero(_codes(whole) == ord(_END))
            owner = np.concatenate([owner, np.searchsorted(ends, at)])
            bare = _BETWEEN.join([bare, *inside])
        whole = bare
    if not whole.isascii():
        whole = unicodedata.normalize("NFKD", _INVISIBLE.sub("", whole))
        whole = unicodedata.normalize("NFKC", _MARKS.sub("", whole))
    whole = whole.lower()
    codes = _codes(whole)
    kind = _kinds(codes)
    spelled = _spelled(whole, codes, kind)
    if len(spelled) < len(whole):
        codes = _codes(spelled)
        kind = _kinds(codes)
    return spelled, owner, codes, kind


def plain(text: str) -> str:
    """The plain form of one text; what its tags hold comes last, each on a line of its own."""
    return joined([text])[0].replace(_BETWEEN, "\n")


def word(token: str) -> str:
    """One word with lookalikes, stand-ins and repeated letters undone; pure numbers become ``0``."""
    if token.isdigit():
        return "0"
    if _LATIN.search(token) and _ALIEN.search(token):
        token = token.translate(LOOKALIKES)
    if not token.isalpha() and sum(map(str.isalpha, token)) * 2 >= len(token) - 1:
        token = token.translate(STAND_INS)
    return _REPEAT.sub(r"\1", token)


class Sentences(NamedTuple):
    """Sentences of documents: words of a sentence, terms of a word.

    ``words`` are numbers of distinct words, those of sentence i from
    ``offsets[i]`` to ``offsets[i + 1]``; ``slots`` are terms of distinct words,
    cut by ``cuts`` in the same way; ``doc`` is the document of each sentence,
    ascending, and ``documents`` the number of documents.
    """

    words: np.ndarray
    offsets: np.ndarray
    slots: np.ndarray
    cuts: np.ndarray
    doc: np.ndarray
    documents: int


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``lengths`` of them, one span after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class TermHasher:
    """Hashed terms of words: the word itself and one form that a masked letter leaves as it is; of unspaced scripts, short runs.

    Distinct words of a batch are told apart by a 64-bit polynomial hash of their
    code points; the terms of the last ``remember`` words are kept.
    """

    def __init__(self, bits: int = 18, remember: int = 200_000):
        self.size, self.remember = 1 << bits, remember
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.slots, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _slot(self, kind: str, what: str) -> int:
        return zlib.crc32(f"{kind}{what}".encode("utf-8", "replace")) % self.size

    def terms(self, token: str) -> list[int]:
        """The slots of one plain word."""
        if _UNSPACED.match(token):
            return [self._slot("c", token[i : i + k]) for k in (1, 2, 3) for i in range(len(token) - k + 1)]
        w = word(token)
        own = self._slot("w", w)
        return [own, self._slot("k", f"{w[:2]}{w[-2:]}{len(w)}")] if len(w) > 3 else [own]

    def _hashes(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each span of code points, from running sums of a polynomial over all of them."""
        if len(self.powers) <= len(codes):
            steps = np.full(len(codes) * 2, _BASE, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = _UNBASE
            self.inverse = np.multiply.accumulate(steps)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * self.powers[: len(codes)], dtype=np.uint64)])
        return (sums[end] - sums[first]) * self.inverse[first]

    def _rows(self, text: str, keys: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each distinct word among those kept; new ones are hashed."""
        if len(self.known) + len(keys) > self.remember:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[at] != keys if len(self.known) else np.ones(len(keys), bool)
        if new.any():
            fresh = [self.terms(text[i:j]) for i, j in zip(first[new].tolist(), end[new].tolist())]
            place = len(self.cuts) - 1 + np.arange(len(fresh))
            self.slots = np.concatenate([self.slots, np.array([s for f in fresh for s in f], np.int32)])
            self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum([len(f) for f in fresh])])
            known, place = np.concatenate([self.known, keys[new]]), np.concatenate([self.place, place])
            order = np.argsort(known)
            self.known, self.place = known[order], place[order]
            at = np.searchsorted(self.known, keys)
        return self.place[at]

    def batch(self, texts: list[str | None]) -> Sentences:
        """The sentences of a batch of texts with their distinct words; none for null, empty and blank texts."""
        text, owner, codes, kind = joined(texts)
        state = ((kind & INNER) != 0).astype(np.int8) + ((kind & UNSPACED) != 0)
        edges = np.flatnonzero(np.diff(state, prepend=0, append=0))
        run = np.flatnonzero(state[edges[:-1]]) if len(edges) else edges
        letters, tails = np.flatnonzero(kind & ALNUM), np.flatnonzero(kind & TAIL)
        place = np.searchsorted(letters, edges[run])
        run, place = run[place < len(letters)], place[place < len(letters)]
        held = letters[place] < edges[run + 1] if len(run) else np.zeros(0, bool)
        run, first = run[held], letters[place[held]]
        if not len(first):
            none = np.zeros(0, np.int64)
            return Sentences(none, np.zeros(1, np.int64), none.astype(np.int32), np.zeros(1, np.int64), none, len(texts))
        end = tails[np.searchsorted(tails, edges[run + 1]) - 1] + 1
        keys = self._hashes(codes, first, end)
        digits = np.concatenate([[0], np.cumsum((kind & DIGIT) != 0)])
        keys[digits[end] - digits[first] == end - first] = 0  # all numbers are one word
        distinct, seen, number = np.unique(keys, return_index=True, return_inverse=True)
        rows = self._rows(text, distinct, first[seen], end[seen])

        stop = (kind & BREAK) != 0
        stop[:-1] |= ((kind[:-1] & STOP) != 0) & ((kind[1:] & AFTER) != 0)
        # A word counts once a sentence, wherever it stands.
        pair = np.unique(np.cumsum(stop)[first] * len(distinct) + number)
        sentence, words = pair // len(distinct), pair % len(distinct)
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        piece = np.cumsum(codes == ord(_END))[first]
        doc_of = np.zeros(int(sentence[-1]) + 1, np.int64)
        doc_of[np.cumsum(stop)[first]] = owner[piece]
        doc, offsets = doc_of[sentence[starts]], np.append(starts, len(words))
        if len(owner) > len(texts):  # pieces from tags stand after all texts
            order = np.argsort(doc, kind="stable")
            sizes = np.diff(offsets)[order]
            words, doc, offsets = words[spans(offsets[order], sizes)], doc[order], np.concatenate([[0], np.cumsum(sizes)])
        counts = self.cuts[rows + 1] - self.cuts[rows]
        return Sentences(words, offsets, self.slots[spans(self.cuts[rows], counts)], np.concatenate([[0], np.cumsum(counts)]), doc, len(texts))
