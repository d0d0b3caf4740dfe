"""Problem 10: abusive, hateful or sexual content.

Method: class-conditional Kneser-Ney models.  A word model of abusive and one
of ordinary language are trained on reviewed documents; a passage's score is
the length-normalised difference of its two log-likelihoods.  The classes'
models back off to shared counts, so an expression seen in neither class
speaks for neither.

Reviews are of whole documents, while abuse is a passage in a long text.
Training therefore alternates between finding the passages of reviewed
documents that the abusive model explains better and training on them; each
document is judged by models that have not seen it (folds), which also keeps
wrong reviews from confirming themselves.  The threshold is the one that
agrees best with the reviews under the same folds.

Sentences that many different texts repeat word by word join the ordinary side
as background: stock phrases, which abuse is not.  They are counted over all
documents, and their number is bounded by the share of the texts they must be
in.  Every document is scored as a whole text; only the reviewed documents
that training uses are bounded (``SAMPLE_DOCUMENTS`` of either class).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.functions.fold import plain
from stepforge.functions.ids import source_form, source_key
from stepforge.session import cut
from stepforge.sources import spread

#: Reviewed documents of either class that training uses at most, taken by hash; stock phrases weigh as in a sample of as many.
SAMPLE_DOCUMENTS = 4000
FOLDS = 5
ROUNDS = 4
#: Added to a passage's length when its score is normalised, so that two odd words are no passage.
SHORT = 4
#: A sentence is a stock phrase if this share of all distinct texts, and so many at least, repeat it.
STOCK_SHARE, STOCK = 0.00075, 3
#: Texts, drawn by hash, that stand for a stock phrase, since the names and numbers in it differ.
EXAMPLES = 8
#: The threshold is no lower than this.
LEAST_SCORE = 0.5
#: A passage has this many words at least.
FEWEST_WORDS = 3
#: Score from which a passage of a document reviewed as abusive is an example of abuse.
EXAMPLE = 0.15
#: Score from which a passage reviewed as ordinary isn't used as an example of ordinary language.
DOUBT = 1.0
#: Of a longer run of words that neither class has, the rest says nothing.
LONGEST_UNSEEN = 4
#: Most that one word can say for or against a passage (nats).
MOST_A_WORD = 4.0

# --- reading disguised text -------------------------------------------------

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_](?:[ .\-_*+|/]|\. )){3,}[^\W_](?![^\W_])")
_MAYBE_SPACED = re.compile(r"(?:\b|_)[^\W_][ .\-_*+|/] ?[^\W_][ .\-_*+|/]")
_CLASS_NAME = re.compile(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b")
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words, mentions and marks; a full stop, colon or bracket that ends something, and a line break, end the passage.
_TOKEN = re.compile(r"@\w[\w\-]*|[^\W_][\w'*$@!#]*[\w*$]|[\w*$]+|[?!]+|\n|[.;](?=[\s\"')]|$)|\(['\"]|['\"]\)|[|>](?=\s)")
_ENDS = frozenset("\n.;|>") | {"('", '("', "')", '")'}
_DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})
_RUN = re.compile(r"(.)\1+")
_HEX = re.compile(r"[0-9a-f]*\d[0-9a-f]*")


def squeeze(word: str) -> str:
    """Repeated letters once: what stretching a word leaves unchanged."""
    return _RUN.sub(r"\1", word)


def tokens(text: str) -> list[str]:
    """Tokens of a text in lower case; words joined by capitals become joined by underscores."""
    text = _CLASS_NAME.sub(lambda m: _CAPITAL.sub("_", m[0]), plain(text)).lower()
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*+|/]", "", m[0]), text)
    return _TOKEN.findall(text)


class Reader:
    """Turns a text into passages of canonical words, with the help of a vocabulary."""

    def __init__(self, vocabulary: Iterable[str] = (), names: Iterable[str] = ()) -> None:
        self.known = frozenset(vocabulary)
        self.plain = (self.known - frozenset(names)) | {"a", "i"}  # words that speak for a sentence where words are joined
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(self.known):
            self.by_length[len(w)].append(w)
        self.read = lru_cache(maxsize=200_000)(self._read)

    def _read(self, token: str) -> tuple[str, ...]:
        if token[0] in "?!":
            return (token[0],)
        if token[0] == "@" and len(token) > 2:
            return ("<at>",)
        token = token.strip("'")
        if token.isdigit():
            return ("<n>",)
        if "_" in token.strip("_"):
            return self._joined(token.split("_")) or ("<id>",)
        if not token.isalpha():
            if "*" in token or "#" in token:
                return (self._masked(token),)
            if len(token) >= 6 and _HEX.fullmatch(token):
                return ("<id>",)
            if any(c.isdigit() or c in "@$!" for c in token):
                letters = token.translate(_DIGITS)
                other = token.replace("1", "l").translate(_DIGITS)
                token = next((w for w in (letters, other) if squeeze(w) in self.known), letters)
            token = "".join(c for c in token if c.isalpha())
            if not token:
                return ("<id>",)
        word = squeeze(token)
        if word in self.known or len(word) < 7:
            return (word,)
        return self._parts(word) or (word,)

    def _masked(self, token: str) -> str:
        """A word with letters blanked out: the known word that fits, if there is one."""
        pattern = re.compile("".join("." if c in "*#" else re.escape(c) for c in token.translate(_DIGITS)))
        runs = re.compile("".join(r"\w{1,%d}" % max(1, len(p)) if p[0] in "*#" else re.escape(squeeze(p)) for p in re.findall(r"[*#]+|[^*#]+", token.translate(_DIGITS)) if p))
        for n in range(len(token), 1, -1):
            for w in self.by_length.get(n, ()):
                if (n == len(token) and pattern.fullmatch(w)) or runs.fullmatch(w):
                    return w
        return "<masked>"

    def _parts(self, word: str) -> tuple[str, ...]:
        """A run of letters cut into the fewest known words, if it can be."""
        best: list[tuple[str, ...] | None] = [()] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 20), end):
                if best[start] is not None and (end - start > 1 or word[start:end] in "ai") and word[start:end] in self.known:
                    if best[end] is None or len(best[start]) + 1 < len(best[end]):
                        best[end] = (*best[start], word[start:end])
        return best[-1] or ()

    def _joined(self, parts: list[str]) -> tuple[str, ...]:
        """Words joined by underscores or capitals, if most are words of running text; none of an identifier."""
        found = tuple(w for p in parts if p for w in self.read(p))
        return found if 2 * sum(w in self.plain for w in found) > len(found) else ()

    def passages(self, text: str) -> list[list[str]]:
        """The sentences of a text as canonical words."""
        return self.of_tokens(tokens(text))

    def of_tokens(self, found: Iterable[str]) -> list[list[str]]:
        out: list[list[str]] = [[]]
        read = self.read
        for token in found:
            if token in _ENDS:
                if out[-1]:
                    out.append([])
                continue
            out[-1] += read(token)
            if token[0] in "?!":
                out.append([])
        return [p for p in out if len(p) > 1]


# --- Kneser-Ney models ------------------------------------------------------


def _offsets(sizes: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64))]).astype(np.int64)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the spans [begin, end), and how far each is from its span's begin."""
    n = end - begin
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(begin, n) + within, within


class Vocabulary:
    """Words as numbers: 0 begins a passage, the last is any word unknown to the models."""

    def __init__(self, words: Iterable[str]) -> None:
        self.number = {w: k for k, w in enumerate(sorted(set(words)), 1)}
        self.unknown = len(self.number) + 1
        self.size = self.unknown + 1

    def trigrams(self, words: np.ndarray, within: np.ndarray) -> np.ndarray:
        """One number for each word with the two before it; ``within`` is its place in the passage."""
        one, two = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        one[1:], two[2:] = words[:-1], words[:-2]
        one[within < 1], two[within < 2] = 0, 0
        return (two * self.size + one) * self.size + words


@dataclass
class Counts:
    """Trigrams of one class in ascending order with their counts, and the number of passages."""

    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    n: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    passages: int = 0

    @staticmethod
    def of(codes: np.ndarray, weights: np.ndarray, passages: int) -> Counts:
        kinds, back = np.unique(codes, return_inverse=True)
        n = np.bincount(back, weights=weights, minlength=len(kinds)).astype(np.int64)
        return Counts(kinds[n > 0], n[n > 0], passages)

    def plus(self, other: Counts, sign: int = 1) -> Counts:
        return Counts.of(np.concatenate([self.codes, other.codes]), np.concatenate([self.n, sign * other.n]), self.passages + sign * other.passages)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 for one that isn't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Model:
    """Interpolated Kneser-Ney trigram model; ``shared`` is the unigram distribution of all classes."""

    discount = 0.75

    def __init__(self, counts: Counts, shared: np.ndarray) -> None:
        v = self.size = len(shared)
        self.counts, self.shared = counts, shared
        self.contexts, begin = np.unique(counts.codes // v, return_index=True)
        self.context_n = np.add.reduceat(counts.n, begin) if len(begin) else counts.n
        self.context_kinds = np.diff(np.append(begin, len(counts.codes)))
        self.pairs, self.pair_n = np.unique(counts.codes % (v * v), return_counts=True)  # continuation: in how many contexts
        before = self.pairs // v
        self.word_n = np.bincount(before, weights=self.pair_n, minlength=v)
        self.word_kinds = np.bincount(before, minlength=v)
        self.uni = np.bincount(self.pairs % v, minlength=v)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the last word of each trigram after the two before it."""
        d, v = self.discount, self.size
        word, before = codes % v, codes // v % v
        p = self.shared[word]
        if total := self.uni.sum():
            p = (np.maximum(self.uni[word] - d, 0) + d * np.count_nonzero(self.uni) * p) / total
        n = self.word_n[before]
        here = (np.maximum(_lookup(self.pairs, self.pair_n, codes % (v * v)) - d, 0) + d * self.word_kinds[before] * p) / np.maximum(n, 1)
        p = np.where(n > 0, here, p)
        n = _lookup(self.contexts, self.context_n, codes // v)
        here = (np.maximum(_lookup(self.counts.codes, self.counts.n, codes) - d, 0) + d * _lookup(self.contexts, self.context_kinds, codes // v) * p) / np.maximum(n, 1)
        return np.where(n > 0, here, p)


#: Parts of a nat in which ratios are summed, so that sums don't depend on their order.
UNITS = 1_000_000


class Scorer:
    """Passage scores from an abusive and an ordinary model."""

    def __init__(self, abusive: Counts, ordinary: Counts, size: int) -> None:
        kinds = np.unique(np.concatenate([abusive.codes, ordinary.codes]) % (size * size))
        seen = np.bincount(kinds % size, minlength=size)
        shared = (seen + 0.5) / (seen.sum() + np.count_nonzero(seen) + 1)
        self.size, self.seen = size, seen
        self.abusive, self.ordinary = Model(abusive, shared), Model(ordinary, shared)
        self.prior = math.log((ordinary.passages + 1) / (abusive.passages + 1))
        pairs, back = np.unique(abusive.codes % (size * size), return_inverse=True)
        self.pairs, self.pair_n = pairs, np.bincount(back, weights=abusive.n, minlength=len(pairs)).astype(np.int64)

    def ratios(self, codes: np.ndarray) -> np.ndarray:
        """What each word says for abuse, in units."""
        x = np.log(self.abusive.probability(codes) / self.ordinary.probability(codes))
        return np.rint(np.clip(x, -MOST_A_WORD, MOST_A_WORD) * UNITS).astype(np.int64)

    def unread(self, words: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Whether a word ends a run of more than LONGEST_UNSEEN words that neither class has, as texts in other languages do."""
        at = np.arange(len(words))
        known = np.maximum.accumulate(np.where(self.seen[words] > 0, at, np.where(within == 0, at - 1, -1))) if len(at) else at
        return at - known > LONGEST_UNSEEN

    def best_spans(self, ratios: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every passage the span with the greatest summed ratio: length-normalised score, begin, end (in ``ratios``).

        Abusive passages are rare, so the sum is set against the log odds of an
        ordinary one before it is normalised; a span it doesn't outweigh has score 0.
        """
        sizes = np.diff(ptr)
        n = len(sizes)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Sums of the words before each place of a passage, its end included, and the least of them so far.
        ahead = np.concatenate([[0], np.cumsum(ratios)])
        first = ptr[:-1] + np.arange(n)
        place, within = _spread(first, first + sizes + 1)
        passage = np.repeat(np.arange(n), sizes + 1)
        sums = ahead[place - passage] - np.repeat(ahead[ptr[:-1]], sizes + 1)
        apart = 2 * int(np.abs(sums).max(initial=0)) + 1  # keeps the minima of passages apart
        low = np.minimum.accumulate(sums - passage * apart) + passage * apart
        begin = np.maximum.accumulate(np.where(sums == low, place, 0))
        gain = sums - low
        best = np.maximum.reduceat(gain, first)
        end = np.minimum.reduceat(np.where(gain == best[passage], place, len(place)), first)
        begin = begin[end]
        length = end - begin
        score = np.where(length < FEWEST_WORDS, 0.0, np.maximum(0.0, best / UNITS - self.prior) / (length + SHORT))
        at = np.arange(n)
        return score, begin - at, end - at

    def seen_often(self, codes: np.ndarray) -> bool:
        """Whether the abusive model knows most word pairs of a span from two places or more."""
        known = _lookup(self.pairs, self.pair_n, codes[1:] % (self.size * self.size)) >= 2
        return bool(2 * known.sum() >= len(codes) - 1 > 0)


@dataclass
class Detector:
    """A trained detector: the reader's vocabulary, both classes' counts and the threshold."""

    vocabulary: list[str]
    abusive: Counts
    ordinary: Counts
    threshold: float
    names: list[str] = field(default_factory=list)  # words of the vocabulary that are commoner in identifiers
    words: list[str] = field(default_factory=list)  # words of the models

    def judge(self) -> Judge:
        return Judge(self)


class Judge:
    """Scores texts with a detector."""

    def __init__(self, detector: Detector) -> None:
        self.reader = Reader(detector.vocabulary, detector.names)
        self.words = Vocabulary(detector.words)
        self.scorer = Scorer(detector.abusive, detector.ordinary, self.words.size)
        self.threshold = detector.threshold
        self.cache: dict[str, tuple[int, ...]] = {}

    def numbers(self, token: str) -> tuple[int, ...]:
        """The words of a token as numbers."""
        get, unknown = self.words.number.get, self.words.unknown
        if len(self.cache) > 500_000:
            self.cache.clear()
        found = self.cache[token] = tuple(get(w, unknown) for w in self.reader.read(token))
        return found

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """The score of each text's worst passage, 0 without one, and that passage where it is abusive."""
        flat: list[int] = []
        ends: list[int] = [0]  # of passages
        count: list[int] = []  # passages of each text
        cache, numbers = self.cache, self.numbers
        for text in texts:
            before = len(ends)
            for token in tokens(text) if text else ():
                if token in _ENDS:
                    if len(flat) > ends[-1]:
                        ends.append(len(flat))
                    continue
                flat += cache.get(token) or numbers(token)
                if token[0] in "?!":
                    ends.append(len(flat))
            if len(flat) > ends[-1]:
                ends.append(len(flat))
            count.append(len(ends) - before)
        words, ptr = np.array(flat, np.int64), np.array(ends, np.int64)
        _, within = _spread(ptr[:-1], ptr[1:])
        codes = self.words.trigrams(words, within)
        kinds, back = np.unique(codes, return_inverse=True)
        ratios = self.scorer.ratios(kinds)[back]
        ratios[self.scorer.unread(words, within)] = 0
        score, begin, end = self.scorer.best_spans(ratios, ptr)
        score[np.diff(ptr) < 2] = 0.0
        of_text = _offsets(count)
        worst, passages = np.zeros(len(texts)), []
        for k, (a, b) in enumerate(zip(of_text.tolist(), of_text[1:].tolist(), strict=False)):
            passage = None
            if a < b:
                p = a + int(score[a:b].argmax())
                worst[k] = score[p]
                if score[p] > self.threshold:
                    passage = " ".join([w for t in tokens(texts[k] or "") for w in (self.reader.read(t) if t not in _ENDS else ())][begin[p] - ptr[a] : end[p] - ptr[a]])
            passages.append(passage)
        return worst, passages


def _odd_spans(docs: list[tuple[list[list[str]], int, int, int]], n_texts: int) -> list[list[int]]:
    """First guess for the abusive passages, by number: those whose words are commoner in documents reviewed as abusive."""
    seen = (Counter(), Counter())
    total = [1 + n_texts, 1]
    for passages, label, _, weight in docs:
        total[label] += weight == 0
        for g in {g for p in passages for g in (*p, *zip(p, p[1:], strict=False))}:
            seen[label][g] += weight or 1

    def odds(g: object) -> float:
        return math.log((seen[1][g] + 0.1) / total[1] / ((min(seen[0][g], total[0]) + 0.5) / total[0]))

    out = []
    for passages, label, *_ in docs:
        spans: list[int] = []
        if label:
            for i, p in enumerate(passages):
                x = [odds(w) for w in p]
                x = [v + odds(g) for v, g in zip(x, [p[0], *zip(p, p[1:], strict=False)], strict=True)]
                if len(p) >= 3 and sum(x) / (len(p) + SHORT) > 0.5:
                    spans.append(i)
        out.append(spans)
    return out


def train(reviewed: list[tuple[list[str], int]], background: Collection[tuple[list[str], float]] = (), n_texts: int = 0, n_abusive: int = 0) -> Detector:
    """Train on tokenised texts reviewed as abusive (1) or ordinary (0), folds in the order of the list, and on stock phrases.

    ``background`` has tokenised sentences and in how many of the ``n_texts``
    texts of the corpus they are; ``n_abusive`` texts are reviewed as abusive
    in all, the ones that aren't trained on included.  Without a document of either class nothing
    is abusive: the threshold is infinite.
    """
    labels = [label for _, label in reviewed]
    # Stock phrases weigh as if as many texts were at hand as can be reviewed.
    shrink = min(1.0, SAMPLE_DOCUMENTS / max(1, n_texts))
    texts = [(t, label, 0) for t, label in reviewed] + [(t, 0, max(1, round(n * shrink))) for t, n in background]
    reader = Reader()
    df: Counter = Counter()
    joined: Counter = Counter()
    for found, _, weight in texts:
        for w in {w for p in reader.of_tokens(found) for w in p}:
            df[w] += weight or 1
        for w in {squeeze(w) for t in found if "_" in t.strip("_") for w in t.split("_") if w}:
            joined[w] += weight or 1
    known = sorted(w for w, n in df.items() if n >= 2 and len(w) > 1 and w[0] != "<")
    names = [w for w in known if joined[w] > df[w]]
    if not any(labels) or all(labels):
        return Detector(known, Counts(), Counts(), math.inf)
    reader = Reader(known, names)
    docs = [(reader.of_tokens(found), label, k % FOLDS, 0) for k, (found, label) in enumerate(reviewed)]
    rude = Counter(tuple(p) for passages, label, *_ in docs if label for p in {tuple(p) for p in passages})
    n_rude = max(1, sum(labels))
    stock: Counter = Counter()
    for found, n in background:
        for p in {tuple(p) for p in reader.of_tokens(found)}:
            stock[p] += n
    for k, (p, n) in enumerate(stock.items()):
        # What documents reviewed as abusive say doesn't count, and what is far commoner in them is none of the stock.
        rest = n - rude[p] * max(1.0, n_abusive / n_rude)
        if rest * shrink >= 0.5 and not (rude[p] >= 2 and rude[p] / n_rude > 3 * rest / max(1, n_texts)):
            docs.append(([list(p)], 0, k % FOLDS, max(1, round(rest * shrink))))
    odd = _odd_spans(docs, round(n_texts * shrink))

    # All passages as numbers, one after the other.
    words = Vocabulary(w for passages, *_ in docs for p in passages for w in p)
    ptr = _offsets(len(p) for passages, *_ in docs for p in passages)
    flat = np.array([words.number[w] for passages, *_ in docs for p in passages for w in p], np.int64)
    codes = words.trigrams(flat, _spread(ptr[:-1], ptr[1:])[1])
    n_passages = np.array([len(passages) for passages, *_ in docs])
    doc = np.repeat(np.arange(len(docs)), n_passages)
    label, fold, weight = (np.array(x)[doc] for x in zip(*((x, f, w or 1) for _, x, f, w in docs), strict=True))
    first = _offsets(n_passages)

    def counts(begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> Counts:
        at, within = _spread(begin, end)
        return Counts.of(words.trigrams(flat[at], within), np.repeat(weight, end - begin), int(weight.sum()))

    passage = np.array([first[k] + i for k, own in enumerate(odd) for i in own], np.int64)
    begin, end = ptr[passage], ptr[passage + 1]  # spans taken as abusive
    doubted = np.zeros(len(label), bool)  # ordinary passages that all other reviews call abusive
    score = np.zeros(len(label))
    parts = []
    for f in range(FOLDS):
        own = np.flatnonzero(fold == f)
        at, _ = _spread(ptr[own], ptr[own + 1])
        parts.append((own, _offsets(ptr[own + 1] - ptr[own]), *np.unique(codes[at], return_inverse=True)))
    for _ in range(ROUNDS):
        abusive = [counts(begin[of], end[of], np.ones(of.sum())) for of in (fold[passage] == f for f in range(FOLDS))]
        plain_ones = [np.flatnonzero((fold == f) & (label == 0) & ~doubted) for f in range(FOLDS)]
        ordinary = [counts(ptr[i], ptr[i + 1], weight[i]) for i in plain_ones]
        everything = tuple(reduce(Counts.plus, by) for by in (abusive, ordinary))
        spans = []
        for f, (own, own_ptr, kinds, back) in enumerate(parts):
            scorer = Scorer(everything[0].plus(abusive[f], -1), everything[1].plus(ordinary[f], -1), words.size)
            score[own], b, e = scorer.best_spans(scorer.ratios(kinds)[back], own_ptr)
            b, e = b - own_ptr[:-1] + ptr[own], e - own_ptr[:-1] + ptr[own]
            found = (label[own] == 1) & (score[own] > EXAMPLE)
            spans.append((own[found], b[found], e[found]))
            doubted[own] = False
            for i in np.flatnonzero((label[own] == 0) & (score[own] > DOUBT)).tolist():
                doubted[own[i]] = scorer.seen_often(codes[b[i] : e[i]])
        passage, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    worst = np.zeros(len(docs))
    np.maximum.at(worst, doc, score)
    used = np.unique(np.concatenate([c.codes for c in everything]))
    return _compact(Detector(known, *everything, _threshold(worst[: len(labels)].tolist(), labels), names), used, words)


def _compact(detector: Detector, codes: np.ndarray, words: Vocabulary) -> Detector:
    """The detector with numbers for the words of its counts only."""
    used = np.zeros(words.size, bool)
    for c in (codes % words.size, codes // words.size % words.size, codes // words.size**2):
        used[c] = True
    used[0] = True
    number = np.cumsum(used) - 1
    size = int(used[1:].sum()) + 2

    def renumbered(c: Counts) -> Counts:
        a, b, w = c.codes // words.size**2, c.codes // words.size % words.size, c.codes % words.size
        return Counts((number[a] * size + number[b]) * size + number[w], c.n, c.passages)

    detector.words = [w for w, k in words.number.items() if used[k]]
    detector.abusive, detector.ordinary = renumbered(detector.abusive), renumbered(detector.ordinary)
    return detector


def _threshold(scores: list[float], labels: list[int]) -> float:
    """The threshold of the best F1 against the reviews, in the middle of the gap it falls in."""
    order = sorted(zip(scores, labels, strict=True), reverse=True)
    positives, hit, best, at = sum(labels), 0, -1.0, 0.0
    for k, (s, label) in enumerate(order, 1):
        hit += label
        if k < len(order) and order[k][0] == s:
            continue
        if (f1 := 2 * hit / (k + positives)) > best:
            below = order[k][0] if k < len(order) else 0.0
            best, at = f1, (s + below) / 2
    return max(at, LEAST_SCORE)


# --- on DataFrames ----------------------------------------------------------


def reviews(doc_labels: DataFrame) -> DataFrame:
    """``doc_id, label``: 1 or 0 where all reviewers' last opinions agree; other documents are left out."""
    last = doc_labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id", "reviewer").agg(F.max(F.struct("reviewed_at", "toxic"))["toxic"].alias("toxic"))
    return last.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("most")).filter("label = most AND label IN (0, 1)").select("doc_id", "label")


#: What ends a sentence in a text whose line breaks are followed by blanks, and names, numbers and paths, in which stock
#: phrases may differ.
_SENTENCE_END = r"[.;?!|>\n]\s"
_NAME = r"(?<![^ \n])[^ \n0-9_/`\\]*+[0-9_/`\\][^ \n]*"


def _sentences(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for before, after in (("\r", "\n"), ("\\n", "\n"), ("\n", "\n ")):
        text = F.replace(text, F.lit(before), F.lit(after))
    return F.split(text, _SENTENCE_END)


def _hashes(text: Column | str = "text") -> Column:
    """One hash for each sentence of a text, NULL for one without blank; names, numbers and paths make no difference."""
    letters = F.transform(_sentences(text), lambda p: F.trim(F.lower(F.regexp_replace(p, _NAME, "0"))))
    return F.transform(letters, lambda p: F.when(F.contains(p, F.lit(" ")), F.xxhash64(p)))


def phrase(text: str = "text", s: str = "s") -> Column:
    """The first sentence of a text that has the hash ``s``."""
    return F.get(_sentences(text), F.array_position(_hashes(text), F.col(s)).cast("int") - 1)


def stock_phrases(documents: DataFrame) -> DataFrame:
    """``s, n, n_texts, places``: hash and count of every sentence repeated by a share of STOCK_SHARE of all distinct texts.

    ``places`` are the documents, up to EXAMPLES, that show it.  Sentences agree
    that have the same words but for names, numbers and paths.  The hashes alone
    are exchanged, first by (sentence, text), so that copies of a text count once
    and no sentence is gathered; what three texts repeat is checkpointed.  At
    most 1 / STOCK_SHARE times the sentences of a text, on average, can come out.
    One more row, with s NULL, counts the texts.
    """
    rows = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.explode(F.concat(_hashes(), F.array(F.lit(None).cast("long")))).alias("s")
    )
    places = {f"place{k}": F.min(F.when(F.pmod("t", F.lit(EXAMPLES)) == k, F.col("doc_id"))) for k in range(EXAMPLES)}
    counted = rows.groupBy("s", "t").agg(F.min("doc_id").alias("doc_id")).groupBy("s").agg(F.count("*").alias("n"), *(f.alias(c) for c, f in places.items()))
    often = cut(counted.filter((F.col("n") >= STOCK) | F.col("s").isNull()))
    total = often.agg(F.max(F.when(F.col("s").isNull(), F.col("n"))).alias("n_texts"))
    found = often.crossJoin(F.broadcast(total)).filter(F.col("s").isNull() | (F.col("n") >= F.col("n_texts") * STOCK_SHARE))
    return found.select("s", "n", "n_texts", F.array_compact(F.array(*places)).alias("places"))


def fit(documents: DataFrame, doc_labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Detector:
    """A detector from the reviewed documents, at most ``sample`` of each class, and the stock phrases of all documents.

    Reviews choose the documents by the hash of their id; one without text has
    nothing to train on.  Only those documents' tokens and the phrases reach the
    driver.
    """
    spark = documents.sparkSession
    key = F.md5(F.concat(F.lit("train:"), F.col("doc_id").cast("string")))
    labelled = reviews(doc_labels).withColumn("k", key)
    n_abusive = labelled.filter("label = 1").count()
    chosen = [r for label in (1, 0) for r in labelled.filter(F.col("label") == label).orderBy("k", "doc_id").limit(sample).collect()]
    phrases = stock_phrases(documents).collect()
    n_texts = max((r.n_texts for r in phrases), default=0)
    # The documents that show a phrase share its count.
    places = [(doc_id, r.s, None, r.n / len(r.places)) for r in phrases if r.s is not None for doc_id in r.places]
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, None, r.label, 0.0) for r in chosen] + places, "doc_id long, s long, label int, n double"))  # bounded, see stock_phrases
    texts = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.when(F.col("s").isNull(), F.col("text")).otherwise(phrase())
    rows = texts.join(wanted, "doc_id").select(key.alias("k"), "doc_id", "label", "n", "s", _tokenised(F.coalesce(text, F.lit(""))).alias("tokens")).collect()
    rows.sort(key=lambda r: (r.k, r.doc_id, r.s or 0, r.tokens))
    reviewed = [(r.tokens.split("\0"), r.label) for r in rows if r.s is None]
    return train(reviewed, [(r.tokens.split("\0"), r.n) for r in rows if r.s is not None], n_texts, n_abusive)


@F.pandas_udf(T.StringType())
def _tokenised(texts: pd.Series) -> pd.Series:
    """The tokens of a text, joined by a character that no token has."""
    return texts.map(lambda t: "\0".join(tokens(t)))


_READY: dict[int, Judge] = {}


def scores(documents: DataFrame, detector: Detector) -> DataFrame:
    """``doc_id, source, score, abusive, passage`` of every document.

    The score is that of the worst passage, 0 for a NULL or empty text; the
    passage is given in canonical words.  Equal texts get equal scores.
    """
    sent = documents.sparkSession.sparkContext.broadcast(detector)
    key = sent._jbroadcast.id()  # names the detector in workers that outlive a query

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _READY:  # a worker process judges many batches and tasks
            _READY.clear()
            _READY[key] = sent.value.judge()
        judge = _READY[key]
        for frame in frames:
            worst, passages = judge.scores(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "score": worst, "abusive": worst > judge.threshold, "passage": passages})

    rows = spread(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInPandas(score, "doc_id long, source string, score double, abusive boolean, passage string")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive documents and their rate per source; spellings of a source are one, NULL is its own."""
    form = source_form("source")
    return (
        scored.groupBy(source_key("source").alias("key"))
        .agg(
            F.max(F.struct(F.length(form), form))["col2"].alias("source"),
            F.count("*").alias("n_documents"),
            F.count_if("abusive").alias("n_abusive"),
            F.avg("score").alias("mean_score"),
        )
        .select("source", "n_documents", "n_abusive", (F.col("n_abusive") / F.col("n_documents")).alias("rate"), F.round("mean_score", 6).alias("mean_score"))
    )
