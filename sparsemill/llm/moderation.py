"""Score of every page for abusive, hateful and sexually explicit language, and the rate of every source.

Words are looked up in a lexicon that is kept as a trie; what is not in it literally is matched by running the word's Levenshtein automaton
(one error from six letters on, two from nine) along the trie, so a misread, misspelled or partly masked term is found without comparing it
with every entry; shorter words, of which most are one letter from an ordinary one, must agree up to letters that scanners take for each
other. A word alone is no evidence: the classes of words that make a sentence offensive have to come together in a window, such as an insult
with an address or a word of contempt, a violent act with its object, a people with "are" and what is not human, a demand with what is
to be done to them, a part of the body with what is done to it. Evidence of a window adds up; words of animals, goods and plants close by
take off what is not certain. Evidence inside quotation marks, or after a word of speech or of the courts, counts as quoted and less
than the same words addressed. A page's score is that of its best window; from ``FOUND`` on it is a case.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsemill.llm import lexicon as L
from sparsemill.llm.eval_leaks import _BROKEN, fold, page_rows
from sparsemill.llm.pages import readings
from sparsemill.session import map_arrow, spread_small

#: Score from which a page is a case.
FOUND = 0.6
#: Words of a context window.
WINDOW = 40
#: Entries of a worker's memory of looked-up words; when full it starts anew.
CACHE_ENTRIES = 400_000

# Signs that printing and scanning put for letters.
_SIGNS = {"ſ": "s", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "œ": "oe", "’": "'", "–": "—"}
_DIGITS = str.maketrans("01569|!", "olsbgll")
#: Pairs of letters read for one.
_PAIRS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("lc", "k"), ("iri", "in"), ("ii", "n"), ("li", "h"))
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){2,}[^\W_](?![^\W_])")
_TOKENS = re.compile(r"[^\W_]+(?:(?:——+|\*+)[^\W_]+)*")
_MASK = re.compile(r"——+|\*+")


def _letters(word: str) -> int:
    """The set of a word's letters as bits; letters that share a bit only widen what is looked at."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class _Node:
    """Children by letter, the entry that ends here, and all entries below as bits."""

    __slots__ = ("below", "children", "word")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.word: str | None = None
        self.below = 0


class Trie:
    """The lexicon's words by their letters."""

    def __init__(self, words: Sequence[str]):
        self.words = set(words)
        self._root = _Node()
        for i, w in enumerate(words):
            node = self._root
            node.below |= 1 << i
            for c in w:
                node = node.children.setdefault(c, _Node())
                node.below |= 1 << i
            node.word = w
        self._letters = np.array([_letters(w) for w in words], np.uint64)
        self._sizes = np.array([len(w) for w in words])

    def nearest(self, word: str, errors: int) -> str | None:
        """The entry with the fewest edits, at most ``errors``; of equal ones the first by alphabet.

        The states of the word's Levenshtein automaton (positions in the word by errors so far, as bit sets) are carried along the trie.
        An edit changes length by at most one and the set of letters by at most two; only branches with entries that fit are entered.
        """
        apart = np.bitwise_count(self._letters ^ np.uint64(_letters(word))) <= 2 * errors
        fitting = 0
        for i in np.flatnonzero(apart & (np.abs(self._sizes - len(word)) <= errors)).tolist():
            fitting |= 1 << i
        if not fitting:
            return None
        n = len(word)
        masks: dict[str, int] = {}
        for j, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << j
        full = (1 << (n + 1)) - 1
        best: tuple[int, str] | None = None
        stack = [(self._root, tuple((1 << (e + 1)) - 1 & full for e in range(errors + 1)))]
        while stack:
            node, states = stack.pop()
            if node.word is not None:
                for e, s in enumerate(states):
                    if s >> n & 1:
                        if best is None or (e, node.word) < best:
                            best = (e, node.word)
                        break
            for c, child in node.children.items():
                if not child.below & fitting:
                    continue
                mask = masks.get(c, 0)
                new, below, below_new, alive = [], 0, 0, 0
                for s in states:
                    x = ((s & mask) << 1 | below | below << 1 | below_new << 1) & full
                    new.append(x)
                    alive |= x
                    below, below_new = s, x
                if alive:
                    stack.append((child, tuple(new)))
        return best[1] if best else None

    def masked(self, word: str) -> list[str]:
        """Entries that fit a masked word: an asterisk hides one letter, a dash any number."""
        shape = "".join("." * len(x) if x[0] == "*" else ".+" if x[0] == "—" else re.escape(x) for x in re.split(r"(——+|\*+)", word) if x)
        fits = re.compile(shape)
        return sorted(w for w in self.words if fits.fullmatch(w))


#: Words of the grammar around the lexicon's, compared literally.
_YOU = frozenset("espèce you your yourself yourselves ye thou thee thy thine du dich dir dein deine deinen deinem deiner ihr euch euer tu te toi ton ta tes vous votre vos".split())
_POINT = frozenset("you ye thou du tu ihr vous such that this what espèce toi bloody du sie dieser diese dieses".split())
_WISH = frozenset("hope may go let wish should ought shall will can va allez soll sollst geh fahr que puisses could to donc doch".split())
_SELF = frozenset("i we ich wir je nous somebody someone man on".split())
_WILL = frozenset("will shall ll would should ought going must deserve deserves werde werden will sollte soll sollten vais va dir te want".split())
_MUST = frozenset("""must should ought shall deserve deserves need needs let had better cure remedy fit wants worth be sollte sollten soll sollen muss müssen muß
 gehören gehört verdienen man lasst laßt il faut doit doivent qu on devrait devraient méritent mérite faudrait""".split())
_THEM = frozenset("""they them their theirs these those who whom all every everyone each none such themselves people peoples race races tribe tribes breed folk kind sort lot
 foreigners immigrants strangers sie ihnen ihre ihr diese dieser dieses diesen alle allen jeder volk völker rasse sippe sippschaft fremden ausländer ils elles eux les leur leurs ces cette ceux
 gens peuple peuples race races tous étrangers""".split())
_PLURAL = frozenset("they them their theirs sie ihnen ihre ils elles les leur leurs eux".split())
_ALL = frozenset("all every both lot alle sie allesamt sämtliche les tous toutes".split())
#: What is offered as a cure for a people, and what they are to be refused.
_CURE = frozenset("cure remedy solution heilmittel mittel lösung remède solution".split())
_ONLY = frozenset("one only but single sole nur einziges ein seul unique".split())
_REFUSE = frozenset("let sell rent lend serve give hire employ admit lodge vermieten vermietet verkauft louer vendre servir".split())
_SHELTER = frozenset("bed beds bread house houses job land lodging lodgings roof room rooms shop shops work arbeit brot haus land zimmer chambre lit logement maison travail".split())
_INTO = frozenset("into inside in en dans".split())
_FORBIDDEN = frozenset("forbid forbidden prevented stopped verboten untersagt interdit interdire empêcher".split())
_THE = frozenset("the these those all every any of no for to die der den diese alle les ces ce des aux tous".split())
_IS = frozenset("are is be was were been than like nothing mere sind ist seid sein wie nichts sont est être comme".split())
_LIKE = frozenset("like as wie comme".split())
#: Where people are driven to or from.
_PLACES = frozenset("""beds borders country county district fire flames gas homes hole house houses kingdom land parish pit river sea swamp town village
 gas grenze häuser haus land lande meer wasser bois eau feu frontière maisons mer pays rivière""".split())
_WHOLE = frozenset("whole entire ganze gesamte toute entière".split())
_HIS = frozenset("her his ihre ihren ihr seine ses sa son".split())
_SHOW = frozenset("let see saw show showed shown sehen sah zeigte voir vit montra".split())
_THIS = frozenset("this these those such dieses diese dieser diesem diesen ces cette ce cet".split())
_SPEECH = frozenset("""called calling said saying alleged complained used using language words expression expressions witness defendant complainant plaintiff
 summons summoned charged court bench magistrate magistrates reported stated quoted wrote shouted swore insult insulted slander libel
 sagte nannte rief schrieb beschimpft beleidigt beleidigung klage kläger angeklagte gericht zeuge ausdruck worte
 dit traité traita appelé cria écrivit injures insultes tribunal témoin plainte prévenu propos""".split())
_SPOKEN = re.compile(r"[“”„«»\"]")

#: Words between the parts of a sentence, in which a line of an advertisement may stand; words that belong together; of quotations.
FAR, NEAR, QUOTE = 16, 4, 10
#: Share of its weight that quoted evidence keeps.
QUOTED = 0.7
#: Classes of the lexicon by name.
_CLASSES = {
    name: getattr(L, name)
    for name in (
        "INSULTS", "FIGURES", "CONTEMPT", "VIOLENCE", "TARGETS", "KILLING", "CURSES", "SILENCE", "MOUTH", "DEHUMANIZING", "HARM", "REMOVAL", "INFERIOR", "RACE", "NOTHING", "LIVING",
        "WORTH", "BODY", "FLESH", "ACTS", "AROUSAL", "NAKED", "SPREAD", "LEGS", "BED", "SPENT", "EXPLICIT", "SLURS", "PLAIN",
    )
}
#: What starts a search for the rest of a pattern; other classes are looked at only beside these.
_ANCHORS = ("INSULTS", "FIGURES", "VIOLENCE", "KILLING", "CURSES", "SILENCE", "DEHUMANIZING", "HARM", "REMOVAL", "INFERIOR", "RACE", "NOTHING", "LIVING", "BODY", "FLESH", "AROUSAL", "SPREAD", "SPENT", "EXPLICIT", "SLURS")


_HATEFUL = frozenset(("DEHUMANIZING", "HARM", "REMOVAL", "LIVING"))


class _Places:
    """Sorted places of each class on a page, and of the words around them."""

    def __init__(self, tokens: Sequence[str], by_class: dict[str, list[int]]):
        self.tokens, self.lower = tokens, [t.lower() for t in tokens]
        self.by_class = by_class

    def any(self, name: str, low: int, high: int, besides: int = -1) -> bool:
        places = self.by_class.get(name, ())
        j = bisect_left(places, low)
        while j < len(places) and places[j] <= high:
            if places[j] != besides:
                return True
            j += 1
        return False

    def word(self, words: frozenset[str], low: int, high: int) -> int:
        """The last place of one of the words in [low, high], or -1."""
        for i in range(min(high, len(self.lower) - 1), max(low, 0) - 1, -1):
            if self.lower[i] in words:
                return i
        return -1

    def people(self, low: int, high: int) -> bool:
        """A word for a people, or a capitalised word after "the" or its like."""
        for i in range(max(low, 0), min(high, len(self.lower) - 1) + 1):
            if self.lower[i] in _THEM or (i and self.lower[i - 1] in _THE and len(self.tokens[i]) > 3 and self.tokens[i][0].isupper()):
                return True
        return False


class _Memory(dict):
    """Remembers what tokens stand for, up to CACHE_ENTRIES of them."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, token: str):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[token] = self._make(token)
        return found


class Scorer:
    """Finds evidence in the words of a page."""

    def __init__(self) -> None:
        self._classes: dict[str, tuple[str, ...]] = {}
        for name, words in _CLASSES.items():
            for w in words:
                if "-" not in w:
                    self._classes[w] = (*self._classes.get(w, ()), name)
        self._trie = Trie(sorted(self._classes))
        self._memory = _Memory(self._hits)

    def lookup(self, token: str) -> tuple[str, ...]:
        """Lexicon words that the token may stand for."""
        return tuple(w for w, _ in self._memory[token])

    def _hits(self, token: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Lexicon words that the token may stand for, and their classes; what decides alone has to be the word itself."""
        out = []
        for w in self._find(token.lower()):
            sure = _MASK.search(token) or fold(token) == fold(w)
            out.append((w, self._classes[w] if sure else tuple(c for c in self._classes[w] if c not in ("EXPLICIT", "SLURS"))))
        return tuple(out)

    def _find(self, token: str) -> tuple[str, ...]:
        if _MASK.search(token):
            return tuple(self._trie.masked(token))
        word = token if token.isalpha() else token.translate(_DIGITS)
        if word in self._trie.words:
            return (word,)
        if not word.isalpha() or not 4 <= len(word) <= 24:
            return ()
        for pair, letter in _PAIRS:
            if pair in word and word.replace(pair, letter) in self._trie.words:
                return (word.replace(pair, letter),)
        if word in L.ORDINARY:
            return ()
        near = self._trie.nearest(word, 1 if len(word) < 9 else 2)
        if near and (min(len(near), len(word)) >= 6 or (len(near) >= 4 and fold(near) == fold(word))):
            return (near,)
        return ()

    def evidence(self, text: str) -> list[tuple[int, str, float, str]]:
        """``(place, kind, weight, what)`` of all evidence in the order of the text."""
        for sign, letters in _SIGNS.items():
            text = text.replace(sign, letters)
        joined = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
        tokens = _TOKENS.findall(joined)
        by_class: dict[str, list[int]] = {}
        words: dict[int, str] = {}
        memory = self._memory
        for i, t in enumerate(tokens):
            for w, names in memory[t]:
                words.setdefault(i, w)
                for name in names:
                    at = by_class.setdefault(name, [])
                    if not at or at[-1] != i:
                        at.append(i)
        if not any(name in by_class for name in _ANCHORS):
            return []
        p = _Places(tokens, by_class)
        found = [(i, kind, weight, f"{kind} {words.get(i, '')}") for i, kind, weight in [*self._abuse(p), *self._hate(p), *self._sexual(p)]]
        if not found:
            return []
        quoted = _quoted(joined, len(tokens))
        out = []
        for i, kind, weight, what in found:
            if weight < 1.0 and p.any("PLAIN", i - 10, i + 10):
                weight -= 0.6
            if quoted is not None and quoted[i] and p.word(_SPEECH, i - QUOTE - 12, i + QUOTE) >= 0:
                weight, what = weight * QUOTED, f"quoted {what}"
            elif p.word(_REPORT, i - QUOTE, i - 1) >= 0:
                weight, what = weight * QUOTED, f"quoted {what}"
            if weight > 0:
                out.append((i, kind, weight, what))
        return sorted(out)

    @staticmethod
    def _abuse(p: _Places) -> Iterator[tuple[int, str, float]]:
        for i in p.by_class.get("INSULTS", ()):
            if p.any("CONTEMPT", i - 5, i + 2, i) or p.word(_POINT, i - 2, i - 1) >= 0:
                yield i, "abuse", 1.0
        for i in p.by_class.get("FIGURES", ()):
            if p.any("CONTEMPT", i - 3, i + 2, i) and p.word(_YOU, i - 6, i + 3) >= 0 or p.word(_YOU, i - 1, i - 1) >= 0:
                yield i, "abuse", 1.0
            elif p.any("CONTEMPT", i - 3, i - 1):
                yield i, "abuse", 0.6
            elif p.word(_YOU, i - 8, i - 1) >= 0 and p.word(_IS, i - 6, i - 1) >= 0:
                yield i, "abuse", 0.6
        for i in p.by_class.get("VIOLENCE", ()):
            if p.any("TARGETS", i - 8, i + 8, i) and p.word(_YOU, i - 6, i + 6) >= 0 and (p.word(_WILL, i - 8, i + 4) >= 0 or p.word(_SELF, i - 8, i + 3) >= 0):
                yield i, "abuse", 1.0
        for i in p.by_class.get("KILLING", ()):
            if p.word(_YOU, i - 3, i + 2) >= 0 and (p.word(_WILL, i - 5, i + 3) >= 0 or p.word(_SELF, i - 6, i + 3) >= 0) or p.word(_YOU, i - 6, i - 1) >= 0 and p.word(_WILL, i - 5, i - 1) >= 0:
                yield i, "abuse", 1.0
            elif p.word(_YOU, i + 1, i + 1) >= 0 and p.word(_WISH, i - 4, i - 1) >= 0:
                yield i, "abuse", 1.0
        for i in p.by_class.get("CURSES", ()):
            if p.word(_YOU, i - 4, i + 2) >= 0 and p.word(_WISH, i - 6, i + 2) >= 0:
                yield i, "abuse", 1.0
        for i in p.by_class.get("NOTHING", ()):
            if p.word(_YOU, i - 6, i - 1) >= 0 and p.word(_IS, i - 4, i - 1) >= 0 and p.word(_YOU, i - 14, i - 7) >= 0:
                yield i, "abuse", 0.6
        for i in p.by_class.get("SILENCE", ()):
            if p.any("MOUTH", i + 1, i + NEAR):
                yield i, "abuse", 0.6

    @staticmethod
    def _hate(p: _Places) -> Iterator[tuple[int, str, float]]:
        for i in p.by_class.get("DEHUMANIZING", ()):
            link = p.word(_IS, i - 6, i - 1)
            if link >= 0 and p.people(link - 6, link + 1):
                yield i, "hate", 0.9
            elif link >= 0 and p.people(link - FAR, link + 1):
                yield i, "hate", 0.4
            elif p.lower[i] in L.CONTEMPTUOUS and p.word(_THIS, i - 4, i - 1) >= 0:
                yield i, "hate", 0.6
            elif p.word(_THIS, i - 5, i - 2) >= 0 and p.people(i - 4, i - 1):
                yield i, "hate", 0.6
        for i in p.by_class.get("HARM", ()):
            if p.word(_MUST, i - 6, i - 1) >= 0 and p.people(i - FAR, i + 3):
                yield i, "hate", 0.9
        for i in p.by_class.get("REMOVAL", ()):
            if p.word(_MUST, i - 6, i - 1) >= 0 and p.people(i - FAR, i + 3):
                aimed = p.people(i - 7, i - 1) and (p.word(_LIKE, i + 1, i + 4) >= 0 or p.word(_PLACES, i + 1, i + 5) >= 0)
                yield i, "hate", 0.9 if aimed else 0.6 if p.word(_PLURAL, i - 6, i + 4) >= 0 else 0.4
        for i in p.by_class.get("KILLING", ()):
            # A call: the verb, then at once whom it is for.
            if p.word(_PLURAL, i + 1, i + 3) >= 0 and p.word(_ALL, i + 1, i + 4) >= 0:
                yield i, "hate", 0.9
        for i in p.by_class.get("SLURS", ()):
            yield i, "hate", 0.9
        if p.by_class.keys() & _HATEFUL:
            for i, w in enumerate(p.lower):
                # Beside other evidence on the page only, as these words are common.
                if w in _CURE and p.word(_ONLY, i - 3, i - 1) >= 0 and p.people(i + 1, i + 5):
                    yield i, "hate", 0.6
                elif w in _REFUSE and p.word(L.NEVER, i - 3, i - 1) >= 0 and p.word(_SHELTER, i + 1, i + 7) >= 0 and p.people(i + 2, i + 12):
                    yield i, "hate", 0.6
        for i in p.by_class.get("INFERIOR", ()):
            if p.any("RACE", i - 1, i + 2, i) and p.people(i - FAR, i + 4):
                yield i, "hate", 0.6
        for i in p.by_class.get("RACE", ()):
            if p.word(_WHOLE, i - 2, i - 1) >= 0 and p.word(_PLURAL, i + 1, i + 3) >= 0:
                yield i, "hate", 0.6
        for i in p.by_class.get("LIVING", ()):
            denied = p.word(_FORBIDDEN, i - 4, i - 1) >= 0 or p.word(L.NEVER, i - 6, i + 3) >= 0 and p.any("WORTH", i - 6, i + 3, i)
            if denied and p.people(i - FAR, i + 3):
                yield i, "hate", 1.0

    @staticmethod
    def _sexual(p: _Places) -> Iterator[tuple[int, str, float]]:
        for i in p.by_class.get("EXPLICIT", ()):
            yield i, "sexual", 1.0
        for i in p.by_class.get("BODY", ()):
            if p.any("ACTS", i - FAR, i + FAR, i) or p.any("AROUSAL", i - FAR, i + FAR, i):
                yield i, "sexual", 1.0
            elif p.any("NAKED", i - 3, i + 2, i) or p.word(_SHOW, i - 5, i - 1) >= 0 and p.word(_HIS, i - 2, i - 1) >= 0:
                yield i, "sexual", 0.6
        for i in p.by_class.get("FLESH", ()):
            if p.any("NAKED", i - 3, i + 2, i) and (p.any("ACTS", i - FAR, i + FAR, i) or p.any("AROUSAL", i - FAR, i + FAR, i)):
                yield i, "sexual", 0.9
        for i in p.by_class.get("AROUSAL", ()):
            if p.any("ACTS", i - 10, i + 10, i) or p.any("AROUSAL", i - NEAR, i + NEAR, i) or p.any("NAKED", i - FAR, i + FAR, i):
                yield i, "sexual", 0.9
        for i in p.by_class.get("ACTS", ()):
            if p.word(_INTO, i + 1, i + 1) >= 0 and p.word(_HIS, i + 2, i + 2) >= 0:
                yield i, "sexual", 0.5
        for i in p.by_class.get("SPREAD", ()):
            if p.any("LEGS", i + 1, i + NEAR, i):
                yield i, "sexual", 0.9
        for i in p.by_class.get("SPENT", ()):
            if p.any("BED", i + 1, i + 8, i) and p.any("SPENT", i - NEAR, i + NEAR, i):
                yield i, "sexual", 0.9

    def score(self, text: str) -> dict[str, float]:
        """Best window score of each kind that has evidence; ``quoted`` is that of quoted evidence alone."""
        found = self.evidence(text)
        places = [x[0] for x in found]
        best: dict[str, float] = {}
        for first, (at, kind, _, _) in enumerate(found):
            distinct = {x[3]: x[2] for x in found[first : bisect_right(places, at + WINDOW, first)] if x[1] == kind}
            best[kind] = max(best.get(kind, 0.0), sum(distinct.values()))
            if quoted := sum(w for what, w in distinct.items() if what.startswith("quoted")):
                best["quoted"] = max(best.get("quoted", 0.0), quoted)
        return best


#: Speech that reports words as such, without quotation marks.
_REPORT = frozenset("calling called alleged using language expression summons summoned charged beschimpft nannte beleidigung traité traita appelé injures".split())


def _quoted(text: str, n: int) -> list[bool] | None:
    """For each token whether it stands between quotation marks; None where there are none."""
    marks = [m.start() for m in _SPOKEN.finditer(text)]
    if len(marks) < 2:
        return None
    out, inside, k = [], False, 0
    since = 0
    for m in _TOKENS.finditer(text):
        while k < len(marks) and marks[k] < m.start():
            inside, since, k = not inside, len(out), k + 1
        # A mark that is never closed, or was misread, quotes no more than a long sentence.
        out.append(inside and len(out) - since < WINDOW)
    return out


KINDS = ("abuse", "hate", "sexual", "quoted")


def page_scores(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, abuse, hate, sexual, quoted, score)``, one row for each page and no shuffle; ``score`` is the greatest of the first
    three, ``quoted`` the part of them that is only quoted.

    Null and empty texts score 0; boxes may be null, short or swapped (see ``pages.readings``).
    """
    pages = documents.select("doc_id", "source", "text", "n_columns", F.col("boxes.x0").alias("x0"), F.col("boxes.x1").alias("x1"), F.col("boxes.y0").alias("y0"))
    return map_arrow(spread_small(pages), _score_batches, "doc_id bigint, source string, abuse double, hate double, sexual double, quoted double, score double")


@lru_cache(maxsize=1)
def worker_scorer() -> Scorer:
    """The scorer of this worker process, with its memory, for all tasks it runs."""
    return Scorer()


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = worker_scorer()
    for batch in batches:
        rows: list[list[float]] = []
        for text, columns, (x0, x1, y0) in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), page_rows(batch, 4), strict=True):
            best = dict.fromkeys(KINDS, 0.0)
            for lines in readings(text, x0, x1, y0, columns) if text else ():
                for kind, s in scorer.score(_BROKEN.sub("", "\n".join(lines)).replace("\n", " ")).items():
                    best[kind] = max(best[kind], s)
            rows.append([best[k] for k in KINDS])
        scores = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(KINDS))]
        top = pa.array([max(r[:3]) for r in rows], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *scores, top], names=["doc_id", "source", *KINDS, "score"])


def source_rates(scored: DataFrame, least: float = FOUND) -> DataFrame:
    """``(source, n_pages, n_found, rate)``; pages without a source form the group null. Counts are added before the shuffle."""
    found = F.sum((F.col("score") >= least).cast("bigint")).alias("n_found")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), found).withColumn("rate", F.col("n_found") / F.col("n_pages"))
