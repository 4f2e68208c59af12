"""Documents that hold passages of held-out items, whole or in part, however they were printed.

Both sides are folded so that letters which scanners take for each other become equal. Windows of ``WINDOW`` words of the items get 64-bit
SimHash fingerprints of their weighted words; so do all windows of every page, in reading order. Fingerprints are cut into four blocks of
16 bits: two that differ in at most ``RADIUS`` = 3 bits agree in one block at least, so looking up each block finds all of them. Candidates
are verified by the exact similarity of their letter shingles, weighted by how often each occurs, which must reach ``ALIKE``. From a window
that both share the texts are then followed in both directions, letter by letter with room for misread ones, over line ends and over any
number of whole lines in between; a word counts as printed if its own letters resemble those on the page; the run is a leak if at least
``MIN_WORDS`` words of the item were printed one after the other.

A window of item size would miss parts of items, so windows have the size of the shortest part that lines and adverts leave whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.llm.pages import readings
from sparsemill.session import map_arrow, spread_small

WINDOW = 5
RADIUS = 3
MIN_WORDS = 13
#: Lines of other matter beyond which a passage must go on with FAR_LETTERS letters; up to here fewer are enough.
SKIP_LINES = 8
#: Letters of the item that a line beyond SKIP_LINES must follow.
FAR_LETTERS = 24
#: Letters that must agree again after a misread one.
RESUME = 4
#: More disagreements than DENSE_ERRORS within DENSE_LETTERS letters end a run.
DENSE_ERRORS, DENSE_LETTERS = 4, 16
#: A word counts as another one beyond this share of wrong strokes (a number with any wrong digit), or where its letters but one cost
#: more than OTHER each: a letter costs 1, one that scanners take for the other CONFUSED.
BAD_SHARE, OTHER, CONFUSED = 0.34, 0.31, 0.3
#: Share of letter shingles, each counted as often as it occurs, that candidate windows have in common.
ALIKE, SHINGLE = 0.6, 3
#: Letters into a line after which a run may still have gone on elsewhere, as chance agreement carries it past its true end.
STRAY = 24
#: Words whose vectors are held at once.
PIECE = 20_000
#: Letters of the pages that are looked up together; a longer page is looked up by itself, in pieces.
GROUP = 120_000
#: Pairs of windows compared at once.
PAIRS = 500_000
#: Letters of items handled by one pass over the corpus (all items are counted first); more items take more passes, so what the driver and a
#: worker hold stays bounded.
ITEM_LETTERS = 10_000_000

# What scanners confuse, as the strokes that the letters have in common.
_STROKES = {
    "o": "aceo0", "i": "fijlrt1!|", "ii": "bhnu", "iii": "m", "oi": "d", "io": "k", "v": "vy", "vv": "w", "s": "s5", "g": "gq9",
}
_JOIN = "\x01"


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for strokes, letters in _STROKES.items():
        for c in letters:
            out[ord(c)] = strokes
    for c in "pxz234678":
        out[ord(c)] = c
    return out


class _Folding(dict):
    """Folding of any character by its plain lower-case letters; what is no letter or digit becomes a blank, unknown signs a question mark."""

    def __init__(self) -> None:
        super().__init__(_table())
        self._plain = dict(self)
        for c in "'’‘`´":
            self[ord(c)] = ""
        for c in "■□�":
            self[ord(c)] = "?"
        self[10] = "\n"
        self[ord(_JOIN)] = _JOIN

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c == "ſ":
            plain = "s"
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        folded = "".join(self._plain.get(ord(x), x if x.isalnum() else " ") for x in plain)
        self[code] = folded if folded.strip() else " "
        return self[code]


class _Widths(dict):
    """How many letters a character is folded to."""

    def __missing__(self, c: str) -> int:
        n = self[c] = sum(x not in " \n\x01" for x in FOLD[ord(c)])
        return n


FOLD = _Folding()
_WIDTHS = _Widths()
_WORDS = re.compile(r"[^\s]+")
_PLAIN = re.compile(r"[^\W_]+")
_QUOTES = re.compile("['’‘`´]")
#: Marks of a word broken at a line end.
_BROKEN = re.compile(r"[-=¬­‐‑~_][^\S\n]*\n\s*(?=\S)")


def fold(text: str) -> str:
    return text.translate(FOLD)


def letters(text: str) -> str:
    """Plain lower-case letters and digits, without folding."""
    return "".join(x for x in unicodedata.normalize("NFKD", text.lower().replace("ſ", "s")) if x.isalnum())


def letter_cost(one: str, two: str) -> float:
    """Edit distance of two words, where a letter that scanners take for another, or for two others, costs CONFUSED."""
    if one == two:
        return 0.0
    n, m = len(one), len(two)
    x, y = [FOLD[ord(c)] for c in one], [FOLD[ord(c)] for c in two]
    cost = [[float(i + j) for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            swap = 0.0 if one[i - 1] == two[j - 1] else CONFUSED if x[i - 1] == y[j - 1] else 1.0
            best = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + swap)
            if j > 1 and x[i - 1] == y[j - 2] + y[j - 1]:
                best = min(best, cost[i - 1][j - 2] + CONFUSED)
            if i > 1 and x[i - 2] + x[i - 1] == y[j - 1]:
                best = min(best, cost[i - 2][j - 1] + CONFUSED)
            cost[i][j] = best
    return cost[n][m]


@lru_cache(maxsize=10_000)
def shingle_similarity(one: str, two: str) -> float:
    """Weighted Jaccard similarity of the letter shingles of two windows."""
    if one == two:
        return 1.0
    left: dict[str, int] = {}
    for i in range(len(one) - SHINGLE + 1):
        left[one[i : i + SHINGLE]] = left.get(one[i : i + SHINGLE], 0) + 1
    common = 0
    for i in range(len(two) - SHINGLE + 1):
        if n := left.get(two[i : i + SHINGLE], 0):
            left[two[i : i + SHINGLE]] = n - 1
            common += 1
    union = max(len(one) - SHINGLE + 1, 0) + max(len(two) - SHINGLE + 1, 0) - common
    return common / union if union else 0.0


class _Numbers(dict):
    """Word numbers; a new word gets the next number and its vector."""

    def __init__(self) -> None:
        super().__init__()
        self.vectors = np.empty((4096, 64), np.int8)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        bits = np.unpackbits(np.frombuffer(xxhash.xxh3_64_digest(word), np.uint8)).astype(np.int8)
        self.vectors[n] = (2 * bits - 1) * (1 + (len(word) > 4) + (len(word) > 8))
        return n


class _Tokens(dict):
    """Numbers of the words that a token as printed (anything between blanks) folds to; long tokens are not kept."""

    LONGEST = 40

    def __init__(self, known: _Numbers) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> tuple[int, ...]:
        numbers = tuple(map(self.known.__getitem__, fold(token).replace(_JOIN, "").split()))
        if len(token) <= self.LONGEST:
            self[token] = numbers
        return numbers


class Words:
    """±weight vectors of words; starts anew when the vocabulary grows large."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self._start_anew()

    def _start_anew(self) -> None:
        self._known = _Numbers()
        self._tokens = _Tokens(self._known)

    def vectors(self, words: Sequence[str]) -> np.ndarray:
        if len(self._known) > self.LIMIT:
            self._start_anew()
        numbers = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        return self._known.vectors[numbers]

    @staticmethod
    def _signs(vectors: np.ndarray) -> np.ndarray:
        sums = vectors[: len(vectors) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            sums += vectors[k : len(vectors) - WINDOW + 1 + k]
        return np.packbits(sums.ravel() > 0).view(np.uint64)

    def group_fingerprints(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each window over the words of all texts one after the other, also where two texts meet; the place where each text's words end.
        For texts of GROUP letters together.
        """
        if max(len(self._known), len(self._tokens)) > self.LIMIT:
            self._start_anew()
        each = [np.fromiter(chain.from_iterable(map(self._tokens.__getitem__, text.split())), np.int64) for text in texts]
        ends = np.cumsum([len(x) for x in each], dtype=np.int64)
        numbers = np.concatenate(each)
        if len(numbers) < WINDOW:
            return np.empty(0, np.uint64), ends
        pieces = range(0, len(numbers) - WINDOW + 1, PIECE - WINDOW + 1)
        return np.concatenate([self._signs(self._known.vectors[numbers[i : i + PIECE]]) for i in pieces]), ends

    def fingerprints(self, words: Sequence[str]) -> np.ndarray:
        """Of each window of WINDOW words; none for shorter lists. Long lists are taken in pieces."""
        if len(words) < WINDOW:
            return np.empty(0, np.uint64)
        if len(words) > PIECE:
            step = PIECE - WINDOW + 1
            return np.concatenate([self.fingerprints(words[i : i + PIECE]) for i in range(0, len(words) - WINDOW + 1, step)])
        return self._signs(self.vectors(words))


class ItemIndex:
    """Fingerprints of the items' windows by blocks of 16 bits."""

    def __init__(self, items: Sequence[tuple[str, str]], words: Words):
        texts: dict[str, list[str]] = {}
        for item_id, text in items:
            texts.setdefault(text or "", []).append(item_id)
        self.ids = [sorted(set(v)) for v in texts.values()]
        self.texts, self.bounds, self.words = [], [], []
        prints, owner, place = [], [], []
        for n, text in enumerate(texts):
            plain = [w for w in _PLAIN.findall(_QUOTES.sub("", text)) if fold(w).strip()]
            split = [fold(w).replace(" ", "") for w in plain]
            self.words.append([letters(w) for w in plain])
            ends = np.cumsum([len(w) for w in split], dtype=np.int64) if split else np.empty(0, np.int64)
            self.texts.append("".join(split))
            self.bounds.append(np.concatenate([[0], ends]).astype(np.int64))
            f = words.fingerprints(split)
            prints.append(f)
            owner.append(np.full(len(f), n, np.int64))
            place.append(np.arange(len(f), dtype=np.int64))
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        self.place = np.concatenate(place) if place else np.empty(0, np.int64)
        self._order, self._start = [], []
        for b in range(4):
            key = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            self._order.append(np.argsort(key, kind="stable"))
            self._start.append(np.concatenate([[0], np.cumsum(np.bincount(key.astype(np.int64), minlength=65536))]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) within RADIUS bits; a pair found by several blocks comes once."""
        found_w, found_i = [], []
        for b in range(4):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            first, n = self._start[b][key], self._start[b][key + 1] - self._start[b][key]
            has = np.flatnonzero(n)
            if not len(has):
                continue
            sums = np.cumsum(n[has])
            cuts = np.searchsorted(sums, np.arange(PAIRS, sums[-1], PAIRS))
            for some in np.split(has, np.unique(cuts)):
                each = n[some]
                window = np.repeat(some, each)
                at = np.arange(len(window)) + np.repeat(first[some] - np.cumsum(each) + each, each)
                item = self._order[b][at]
                ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
                found_w.append(window[ok])
                found_i.append(item[ok])
        if not found_w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(found_w) * len(self.prints) + np.concatenate(found_i))
        return np.divmod(both, len(self.prints))


#: How far the two texts may shift against each other at a misread letter, cheapest first: letters of the item, letters of the page.
_SHIFTS = [(1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3), (2, 3), (3, 2), (1, 3), (3, 1), (0, 3), (3, 0), (4, 4)]

_OFFSETS = range(max(map(max, _SHIFTS)) + 1)
#: Letters that a shift looks at; letters compared at once.
REACH, STEP = _OFFSETS[-1] + RESUME, 16


def _follow(item: str, p: int, page: str, q: int, errors: list[int], anchors: list[tuple[int, int]]) -> tuple[int, int]:
    """Furthest (p, q) up to which the texts agree, misread letters aside. ``errors`` gets the item's places that disagree, ``anchors`` the
    (p, q) from which both go on in step; many errors close together end the run.
    """
    n, m = len(item), len(page)
    recent: list[int] = []
    anchors.append((p, q))
    while p < n and q < m:
        ours, theirs = item[p : p + STEP], page[q : q + STEP]
        if ours == theirs:
            p += len(ours)
            q += len(ours)
            continue
        same = 0
        for x, y in zip(ours, theirs):
            if x != y:
                break
            same += 1
        p += same
        q += same
        if p >= n or q >= m:
            break
        recent = [x for x in recent if p - x < DENSE_LETTERS]
        if len(recent) >= DENSE_ERRORS:
            break
        shift = _shift(item[p : p + REACH], page[q : q + REACH])
        if shift is None:
            break
        a, b = shift
        errors.extend(range(p, p + max(a, b)))
        recent.append(p)
        p += a
        q += b
        anchors.append((p, q))
    return p, q


def _shift(ours: str, theirs: str) -> tuple[int, int] | None:
    """The cheapest shift after which both texts, cut to REACH letters, go on alike for RESUME letters, or to the end of one of them."""
    if len(ours) == len(theirs) == REACH:
        one = [ours[k : k + RESUME] for k in _OFFSETS]
        two = [theirs[k : k + RESUME] for k in _OFFSETS]
        for a, b in _SHIFTS:
            if one[a] == two[b]:
                return a, b
        return None
    for a, b in _SHIFTS:
        rest, tail = ours[a : a + RESUME], theirs[b : b + RESUME]
        if (len(rest) >= 2 and theirs.startswith(rest, b)) or (2 <= len(tail) < RESUME and ours.startswith(tail, a)):
            return a, b
    return None


class Page:
    """A page's reading as one string of folded letters, with the places of its lines and words."""

    def __init__(self, lines: Sequence[str]):
        self.raw = _BROKEN.sub(_JOIN, "\n".join(lines))
        #: Filled where a passage is followed.
        self.heads: dict[str, list[int]] = {}

    # Most pages have no window of an item and need none of these.
    @cached_property
    def _marked(self) -> str:
        return fold(self.raw)

    @cached_property
    def words(self) -> list[str]:
        return self._marked.replace(_JOIN, "").split()

    @cached_property
    def start(self) -> list[int]:
        return [0, *accumulate(map(len, self.words))]

    @cached_property
    def text(self) -> str:
        return "".join(self.words)

    @cached_property
    def line_start(self) -> list[int]:
        parts = self._marked.replace(" ", "").replace(_JOIN, "\n").split("\n")
        return [0, *accumulate(map(len, parts))]

    @cached_property
    def _before(self) -> list[int]:
        """For each character the number of folded letters before it."""
        return [0, *accumulate(map(_WIDTHS.__getitem__, self.raw))]

    def origin(self, at: int) -> int:
        """The place of the character that a folded letter comes from."""
        return bisect_right(self._before, at) - 1

    def printed(self, first: int, last: int) -> str:
        """The letters as printed behind the folded ones [first, last)."""
        first, last = max(first, 0), min(last, len(self.text))
        return letters(self.raw[self.origin(first) : self.origin(last - 1) + 1]) if first < last else ""


class _Run:
    """The item's letters [low, high) that the page prints in order around the common place (p, q)."""

    def __init__(self, page: Page, backward: tuple[str, list[int], dict[str, list[int]]], item: str, p: int, q: int):
        self.page, self.size, self.seed = page, len(item), p
        self.errors: list[int] = []
        self.ahead: list[tuple[int, int]] = []
        self.high = _extend(page.text, page.line_start, page.heads, item, p, q, self.errors, self.ahead)
        behind: list[int] = []
        self.behind: list[tuple[int, int]] = []
        text, starts, heads = backward
        self.low = len(item) - _extend(text, starts, heads, item[::-1], len(item) - p, len(page.text) - q, behind, self.behind)
        self.errors += [len(item) - 1 - x for x in behind]

    def place(self, p: int) -> int:
        """Where the page has the item's letter p."""
        forward = p >= self.seed
        anchors, x = (self.ahead, p) if forward else (self.behind, self.size - 1 - p)
        a, b = anchors[max(bisect_right(anchors, (x, len(self.page.text))) - 1, 0)]
        q = b + x - a
        return q if forward else len(self.page.text) - 1 - q


def _extend(text: str, starts: list[int], heads: dict[str, list[int]], item: str, p: int, q: int, errors: list[int], anchors: list[tuple[int, int]]) -> int:
    """How far the item is followed from (p, q): to where it breaks off inside a line, or over whole lines in between."""
    while True:
        p, q = _follow(item, p, text, q, errors, anchors)
        if p >= len(item) or q >= len(text):
            return p
        line = bisect_right(starts, q) - 1
        # Broken off within a few letters of a line's end, or near the start of one: the passage may go on at a later line.
        ends = [line] if starts[line + 1] - q <= 3 else []
        if q - starts[line] <= STRAY and line:
            ends.append(line - 1)
        best = _onward(text, starts, heads, item, p, q, ends)
        if not best:
            return p
        p, q = best
        while anchors and anchors[-1][0] >= p:
            anchors.pop()
        errors[:] = [x for x in errors if x < p]


def _heads(text: str, starts: list[int]) -> dict[str, list[int]]:
    """Lines' starts by the first six letters from there on."""
    out: dict[str, list[int]] = {}
    for at in starts[:-1]:
        out.setdefault(text[at : at + 6], []).append(at)
    return out


def _onward(text: str, starts: list[int], heads: dict[str, list[int]], item: str, p: int, q: int, ends: list[int]) -> tuple[int, int] | None:
    """Where the passage goes on: at the next of SKIP_LINES lines that follows the item for a few letters, else at the line, however many lies
    between, that follows it longest, by FAR_LETTERS at least.
    """
    near: tuple[int, int, int] | None = None
    far: tuple[int, int, int] | None = None
    for end in ends:
        if end + 2 >= len(starts) - 1:
            continue
        slack, first, limit = starts[end + 1] - q, starts[end + 2], starts[min(end + 2 + SKIP_LINES, len(starts) - 1)]
        for r in range(max(p + min(slack, 0) - 2, 0), min(p + max(slack, 0) + 3, len(item) - 5)):
            places = heads.get(item[r : r + 6])
            if not places or places[-1] < first:
                continue
            for at in places[bisect_left(places, first) :]:
                if at < limit and near is not None and at > -near[0]:
                    continue
                wrong: list[int] = []
                gain, _ = _follow(item, r, text, at, wrong, [])
                value, length = gain - 2 * len(wrong), gain - r
                if gain <= p:
                    continue
                if at < limit:
                    if length >= min(8, len(item) - r) and len(wrong) * 4 <= length and (near is None or (-at, value) > near[:2]):
                        near = (-at, value, r)
                elif length >= FAR_LETTERS and len(wrong) * 10 <= length and (far is None or value > far[0]):
                    far = (value, r, at)
        if near is not None:
            return near[2], -near[0]
    return far[1:] if far else None


def leaked(page: Page, index: ItemIndex, words: Words) -> dict[int, int]:
    """Items (numbers in the index) and the most words of a run on this page, for runs of at least MIN_WORDS."""
    return _leaked_from(page, index, *index.near(words.fingerprints(page.words)))


def leaked_all(pages: Iterable[tuple[int, Page]], index: ItemIndex, words: Words) -> dict[int, dict[int, int]]:
    """``leaked`` of many pages, looked up GROUP letters at a time, by the number each page comes with; the most words of a number's pages."""
    out: dict[int, dict[int, int]] = {}
    for group in _groups(pages):
        for number, found in _leaked_group(group, index, words):
            best = out.setdefault(number, {})
            for item, n in found.items():
                best[item] = max(n, best.get(item, 0))
    return out


def _groups(pages: Iterable[tuple[int, Page]]) -> Iterator[list[tuple[int, Page]]]:
    """Pages of GROUP letters together at most; a longer one alone."""
    held: list[tuple[int, Page]] = []
    size = 0
    for number, page in pages:
        if held and size + len(page.raw) > GROUP:
            yield held
            held, size = [], 0
        held.append((number, page))
        size += len(page.raw)
    if held:
        yield held


def _leaked_group(group: Sequence[tuple[int, Page]], index: ItemIndex, words: Words) -> Iterator[tuple[int, dict[int, int]]]:
    """``leaked`` of each page that has a window of an item."""
    if len(group[0][1].raw) > GROUP:
        yield group[0][0], leaked(group[0][1], index, words)
        return
    prints, ends = words.group_fingerprints([page.raw for _, page in group])
    window, item_window = index.near(prints)
    at = np.searchsorted(ends, window, side="right")
    inside = window + WINDOW <= ends[at]
    window, item_window, at = window[inside], item_window[inside], at[inside]
    starts = np.concatenate([[0], ends])
    for k in np.unique(at).tolist():
        a, b = np.searchsorted(at, [k, k + 1])
        number, page = group[k]
        yield number, _leaked_from(page, index, window[a:b] - starts[k], item_window[a:b])


def _leaked_from(page: Page, index: ItemIndex, window: np.ndarray, item_window: np.ndarray) -> dict[int, int]:
    """``leaked`` by the pairs of windows of page and items that are alike, in order."""
    out: dict[int, int] = {}
    backward: tuple[str, list[int], dict[str, list[int]]] | None = None
    covered: dict[int, deque[tuple[int, int, int]]] = {}
    owner, place = index.owner[item_window], index.place[item_window]
    for w, item, first in zip(window.tolist(), owner.tolist(), place.tolist(), strict=True):
        bounds = index.bounds[item]
        p, q = int(bounds[first]), page.start[w]
        if out.get(item, 0) >= len(index.words[item]):
            continue
        if any(a <= p < b and abs((q - p) - d) <= 12 for a, b, d in covered.get(item, ())):
            continue
        if shingle_similarity(index.texts[item][p : int(bounds[first + WINDOW])], page.text[q : page.start[w + WINDOW]]) < ALIKE:
            continue
        if backward is None:
            size = len(page.text)
            text, starts = page.text[::-1], [size - s for s in reversed(page.line_start)]
            backward = text, starts, _heads(text, starts)
            page.heads = _heads(page.text, page.line_start)
        # From the longest word that both windows have: the first one may be another word, where lines meet.
        same = [k for k in range(WINDOW) if page.words[w + k] == index.texts[item][int(bounds[first + k]) : int(bounds[first + k + 1])]]
        if not same:
            continue
        k = max(same, key=lambda k: len(page.words[w + k]))
        p, q = int(bounds[first + k]), page.start[w + k]
        run = _Run(page, backward, index.texts[item], p, q)
        covered.setdefault(item, deque(maxlen=16)).append((run.low, run.high, q - p))
        n = _printed_words(bounds, index.words[item], run)
        if n >= MIN_WORDS:
            out[item] = max(n, out.get(item, 0))
    return out


def _printed_words(bounds: np.ndarray, words: Sequence[str], run: _Run) -> int:
    """Most consecutive words of the item within the run whose letters the page prints."""
    first, last = bisect_right(bounds, run.low, 1) - 1, bisect_left(bounds, run.high)
    if last - first < MIN_WORDS:
        return 0
    wrong: dict[int, int] = {}
    for x in set(run.errors):
        word = bisect_right(bounds, x, 1) - 1
        wrong[word] = wrong.get(word, 0) + 1
    best = length = 0
    for i in range(first, last):
        a, b = int(bounds[i]), int(bounds[i + 1])
        inside = 4 * (min(b, run.high) - max(a, run.low)) >= 3 * (b - a)
        right = inside and wrong.get(i, 0) <= (0 if words[i].isdigit() else BAD_SHARE * (b - a))
        if right:
            right = letter_cost(words[i], run.page.printed(run.place(a), run.place(b - 1) + 1)) <= max(CONFUSED, OTHER * (len(words[i]) - 1))
        length = length + 1 if right else 0
        best = max(best, length)
    return best


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_words)``: pages that print at least MIN_WORDS consecutive words of an item.

    Null and empty texts of either side give nothing; repeated items count once; an item without MIN_WORDS words cannot leak. Boxes may be
    null, short or swapped (see ``pages.readings``). One pass over the corpus without a shuffle for each ITEM_LETTERS letters of items, which
    are broadcast, each pass's share to itself.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    passes = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_LETTERS))
    pages = documents.where(F.col("text").isNotNull()).select("doc_id", "text", "n_columns", F.col("boxes.x0").alias("x0"), F.col("boxes.x1").alias("x1"), F.col("boxes.y0").alias("y0"))
    pages = spread_small(pages)
    out = None
    for part in range(passes):
        # Items of one text stay together, as the index holds each text once.
        share = [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == part).toLocalIterator()]
        found = map_arrow(pages, _finder(spark.sparkContext.broadcast(share), uuid.uuid4().hex), "doc_id bigint, item_id string, n_words int")
        out = found if out is None else out.unionByName(found)
    return out


def page_rows(batch: pa.RecordBatch, at: int) -> Iterator[tuple[list[int] | None, list[int] | None, list[int] | None]]:
    """Boxes' x0, x1, y0 of each row from columns ``at`` on."""
    lists = [batch.column(at + i) for i in range(3)]
    flat, offsets = [], []
    for c in lists:
        flat.append(c.values.to_numpy(zero_copy_only=False) if c.values.null_count == 0 else np.array(c.values.to_pylist(), dtype=object))
        offsets.append(c.offsets.to_numpy())
    valid = lists[0].is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(batch)):
        if not valid[i]:
            yield None, None, None
        else:
            yield tuple(f[o[i] : o[i + 1]].tolist() for f, o in zip(flat, offsets, strict=True))


#: The index a worker has built, by the broadcast it comes from: one at a time, kept from task to task.
_BUILT: dict[str, tuple[Words, ItemIndex]] = {}


def _index(items: Broadcast, name: str) -> tuple[Words, ItemIndex]:
    if name not in _BUILT:
        _BUILT.clear()
        words = Words()
        _BUILT[name] = words, ItemIndex(items.value, words)
    return _BUILT[name]


def _finder(items: Broadcast, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = _index(items, name)
        for batch in batches:
            docs, found, n_words = [], [], []
            doc_ids = batch.column(0)
            rows = enumerate(zip(batch.column(1).to_pylist(), page_rows(batch, 3), batch.column(2).to_pylist(), strict=True))
            pages = ((row, Page(lines)) for row, (text, (x0, x1, y0), cols) in rows for lines in readings(text, x0, x1, y0, cols))
            for row, best in leaked_all(pages, index, words).items():
                doc_id = doc_ids[row].as_py()
                ids: dict[str, int] = {}
                for item, n in best.items():
                    for item_id in index.ids[item]:
                        ids[item_id] = max(n, ids.get(item_id, 0))
                for item_id, n in ids.items():
                    docs.append(doc_id)
                    found.append(item_id)
                    n_words.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string()), pa.array(n_words, pa.int32())], names=["doc_id", "item_id", "n_words"])

    return run
