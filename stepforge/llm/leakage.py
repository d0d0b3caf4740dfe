"""Problem 8: evaluation texts that leak into training documents.

Method: training suffix arrays.  Every task turns its documents into shards
and builds a word-level suffix array of each; all suffixes of the evaluation
texts' own sentences are binary-searched in it, which gives the places of the
verbatim matches.  Documents and sentences that match are then compared word
by word, so that altered copies count and sentences that merely share a mould
do not; for every leak the longest verbatim match and its place are given.

The evaluation set is small and sent to all tasks in blocks whose size is
checked (``BLOCK_CHARS``).  What a sentence or word pair counts is taken over
all items and all distinct texts, so results don't depend on how the set falls
into blocks.  Documents are tokenised once a block and kept as numbers of the
block's words; only those are exchanged, once, to count copies of a text once.
That an item is repeated often never makes its sentences stock phrases: only
texts that repeat nothing else of the item count for that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.functions.fold import plain, words
from stepforge.session import cut
from stepforge.sources import spread

#: Characters of evaluation text per broadcast block.
BLOCK_CHARS = 8_000_000
#: Words per suffix-array shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Cells of the table of documents and word pairs that is held at a time.
CELLS = 32_000_000


@dataclass(frozen=True)
class LeakRules:
    """What counts as a leak.

    information   least information (nats, from document frequencies of word pairs) of a verbatim match
    sentence      least share of a sentence's words, in order, within the window of the document
    wording       least share of its information carried by word pairs that stay adjacent
    pair_wording  the same, least average over the sentences of a document that repeat one item
    sentences     least number of repeated sentences
    min_words     least number of words in them
    stock_items   a sentence of more than this share of the items (and of more than two) is a stock phrase
    stock_docs    so is one that this share of all distinct texts (and more than five) repeats word by word
                  without another sentence of the item; ``stock_sentences`` lists those
    """

    information: float = 7.0
    sentence: float = 0.7
    wording: float = 0.5
    pair_wording: float = 0.7
    sentences: int = 2
    min_words: int = 20
    stock_items: float = 0.02
    stock_docs: float = 0.05
    shortest: int = 5
    weight_cap: float = 6.0


_STOP = re.compile(r"(?<=[.?!])[\"')\]]*\s+|\n+")
_CODE = re.compile(r"^\s*(?:\$ |>>> |def |class |for .*:$|while |if .*:$|return\b|import |from \S+ import|Traceback |File \"|\[\d\d:|\{\")|^\s{2,}\S")


def sentences(text: str, shortest: int = 5) -> list[list[str]]:
    """The word lists of a text's sentences; lines of code, shell or logs aren't sentences."""
    found = []
    for line in plain(text).split("\n"):
        if not line or _CODE.search(line):
            continue
        for part in _STOP.split(line):
            if part and len(w := words(part)) >= shortest:
                found.append(w)
    return found


# --- the evaluation set -----------------------------------------------------


def own_sentences(items: DataFrame, rules: LeakRules) -> DataFrame:
    """``item_id, texts, sentences`` of every item that has sentences of its own.

    A sentence is given as ``words`` (joined by blanks) and ``counts``: for each
    of its word pairs the number of own sentences of all items that hold it.
    """
    source = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, " ".join(w)) for i, t in zip(frame["item_id"], frame["text"], strict=True) for w in sentences(t, rules.shortest)]
            yield pd.DataFrame(rows, columns=["item_id", "words"])

    found = source.mapInPandas(cut_up, "item_id long, words string").distinct()
    most = source.agg(F.greatest(F.lit(2.0), F.count_distinct("item_id") * F.lit(rules.stock_items)).alias("most"))
    in_items = found.groupBy("words").agg(F.count("*").alias("n"))
    own = found.join(in_items, "words").crossJoin(F.broadcast(most)).filter("n <= most").select("item_id", "words")
    total = own.agg(F.count("*").alias("n_own"))
    w = F.split("words", " ")
    pairs = own.withColumn("w", w).select("item_id", "words", F.posexplode(F.expr("transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))")).alias("at", "pair"))
    held = pairs.select("item_id", "words", "pair").distinct().groupBy("pair").agg(F.count("*").alias("n"))
    counted = pairs.join(held, "pair").groupBy("item_id", "words").agg(F.sort_array(F.collect_list(F.struct("at", "n")))["n"].alias("counts"))
    by_item = counted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("words", "counts"))).alias("sentences"))
    texts = source.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    return texts.join(by_item, "item_id").crossJoin(F.broadcast(total))


def _blocks(own: DataFrame) -> Iterator[list]:
    """The evaluation set in blocks of at most BLOCK_CHARS characters, read part by part."""
    block, size = [], 0
    for row in own.toLocalIterator():
        n = sum(map(len, row.texts))
        if block and size + n > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    if block:
        yield block


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _spans(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the entries of ``rows`` of a compressed table: the place in ``rows`` and in the table of each."""
    n = ptr[rows + 1] - ptr[rows]
    at = np.repeat(np.arange(len(rows)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[rows], n)


def _unique(x: np.ndarray) -> np.ndarray:
    """The different values in ascending order, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Block:
    """A block of the evaluation set as numbers: words, word pairs, sentences and items."""

    def __init__(self, rows: list) -> None:
        texts = [[words(t) for t in r.texts] for r in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ts in texts for t in ts for w in t} | {w for r in rows for s in r.sentences for w in s.words.split(" ")}), 1)}
        known = self.vocabulary
        self.width = len(known) + 1
        self.item_ids = [r.item_id for r in rows]
        #: All words of an item, texts apart.
        self.item_words = [[x for t in ts for x in (*(known[w] for w in t), 0)] for ts in texts]
        self.sentences = [[known[w] for w in s.words.split(" ")] for r in rows for s in r.sentences]
        self.texts = [s.words for r in rows for s in r.sentences]
        self.item = np.repeat(np.arange(len(rows)), [len(r.sentences) for r in rows])
        self.item_ptr = _offsets(np.bincount(self.item, minlength=len(rows)))
        self.length = np.array([len(s) for s in self.sentences], np.int64)
        codes = [a * self.width + b for s in self.sentences for a, b in zip(s, s[1:], strict=False)]
        self.codes, self.pair = np.unique(np.array(codes, np.int64), return_inverse=True)
        self.ptr = _offsets(self.length - 1)
        self.in_own = np.zeros(len(self.codes), np.int64)
        self.in_own[self.pair] = [n for r in rows for s in r.sentences for n in s.counts]
        self.n_own = rows[0].n_own
        self.dtype = np.uint16 if self.width <= 1 << 16 else np.uint32

    def numbers(self, text_words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in text_words], self.dtype)

    def pairs_at(self, tokens: np.ndarray) -> np.ndarray:
        """The number of the word pair that begins at each token, -1 for a pair of no sentence."""
        out = np.full(len(tokens), -1, np.int64)
        if len(tokens) > 1 and len(self.codes):
            t = tokens.astype(np.int64)
            at = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
            code = t[at] * self.width + t[at + 1]
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[at] = np.where(self.codes[k] == code, k, -1)
        return out


class Shard:
    """Documents of a task, one after the other with a 0 between them, and the word pairs in them."""

    def __init__(self, block: Block, docs: list[np.ndarray], margin: int = 1) -> None:
        self.block, self.docs = block, docs
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = _offsets(sizes + 1)[:-1] + 1
        self.tokens = np.zeros(int(sizes.sum()) + len(docs) + 1 + margin, np.int32)
        for d, s in zip(docs, self.starts.tolist(), strict=True):
            self.tokens[s : s + len(d)] = d
        self.pairs = block.pairs_at(self.tokens)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def present(self) -> np.ndarray:
        """document * pairs + pair for every pair a document holds, ascending."""
        at = np.flatnonzero(self.pairs >= 0)
        return _unique(self.doc_of(at) * len(self.block.codes) + self.pairs[at])

    def coverage(self, present: np.ndarray, doc: np.ndarray, sentence: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Summed weight of the pairs of a sentence that are anywhere in the document, for each (document, sentence)."""
        n_pairs, out = len(self.block.codes), np.zeros(len(doc))
        order = np.argsort(doc, kind="stable")
        step = max(1, CELLS // max(1, n_pairs))
        edges = np.searchsorted(doc[order], np.arange(0, len(self.docs) + step, step))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a == b:
                continue
            lo, hi = np.searchsorted(present, [k * step * n_pairs, (k + 1) * step * n_pairs])
            there = np.zeros(step * n_pairs, bool)
            there[present[lo:hi] - k * step * n_pairs] = True
            some = order[a:b]
            for part in np.array_split(some, max(1, len(some) // 200_000)):
                at, cell = _spans(self.block.ptr, sentence[part])
                pair = self.block.pair[cell]
                hit = there[(doc[part][at] - k * step) * n_pairs + pair]
                out[part] = np.bincount(at, weights=weight[pair] * hit, minlength=len(part))
        return out


def _unpacked(block: Block, column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), block.dtype) if x else np.empty(0, block.dtype) for x in column.to_pylist()]


def _tokenised(docs: DataFrame, sent: object) -> DataFrame:
    """``doc_id, key, ids``: a hash of the words of a text and their numbers; NULL where no word pair is known."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            keys, packed = [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                keys.append(blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=16).digest())
                ids = block.numbers(w)
                packed.append(zlib.compress(ids.tobytes(), 1) if len(ids) > 1 and (ids[1:].astype(bool) & ids[:-1].astype(bool)).any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "key", "ids"])

    return docs.mapInArrow(tokenise, "doc_id long, key binary, ids binary")


def _count(tokenised: DataFrame, sent: object, rules: LeakRules) -> tuple[int, np.ndarray, np.ndarray]:
    """Distinct texts in all, how many hold each word pair, and how many each sentence but nothing else of its item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        n_pairs, n = len(block.codes), 0
        df, alone = np.zeros(n_pairs, np.int64), np.zeros(len(block.sentences), np.int64)
        first = np.argsort(block.pair[block.ptr[:-1]], kind="stable")  # sentences by their first pair
        first_ptr = np.searchsorted(block.pair[block.ptr[:-1]][first], np.arange(n_pairs + 1))
        # A sentence is repeated if so many of its pairs are there; repeated pairs of a sentence count once each.
        one = np.ones(n_pairs)
        for batch in batches:
            n += batch.num_rows
            shard = Shard(block, _unpacked(block, batch.column("ids")), int(block.length.max()))
            present = shard.present()
            df += np.bincount(present % n_pairs, minlength=n_pairs)
            at = np.flatnonzero(shard.pairs >= 0)
            k, cell = _spans(first_ptr, shard.pairs[at])
            at, s = at[k], first[cell]
            j = 1
            while len(at) and (going := block.length[s] - 1 > j).any():
                same = ~going
                same[going] = shard.pairs[at[going] + j] == block.pair[block.ptr[s[going]] + j]
                at, s, j = at[same], s[same], j + 1
            if not len(at):
                continue
            hit = _unique(shard.doc_of(at) * len(block.sentences) + s)
            doc, s = hit // len(block.sentences), hit % len(block.sentences)
            k, other = _spans(block.item_ptr, block.item[s])
            differs = other != s[k]
            k, other = k[differs], other[differs]
            held = shard.coverage(present, doc[k], other, one) >= rules.sentence * (block.length[other] - 1)
            alone += np.bincount(s[np.bincount(k[held], minlength=len(s)) == 0], minlength=len(alone))
        counts = np.concatenate([[n], df, alone])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["k", "n"])

    # Copies have the same words, so any of them stands for all.
    texts = tokenised.groupBy("key").agg(F.first("ids").alias("ids")).select("ids")
    total = texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # at most the block's pairs and sentences
    block = sent.value
    counts = np.zeros(1 + len(block.codes) + len(block.sentences), np.int64)
    counts[total["k"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    return int(counts[0]), counts[1 : 1 + len(block.codes)], counts[1 + len(block.codes) :]


# --- the search -------------------------------------------------------------


def suffix_order(tokens: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """The positions ``at`` (by default of the non-zero tokens), ordered by the ``depth`` tokens from there on (prefix doubling).

    A 0 ends a text: what follows it doesn't count.
    """
    known = np.flatnonzero(tokens)
    rank = tokens.astype(np.int64)
    step = 1
    while step < depth:
        ahead = known + step
        nxt = np.where(ahead < len(tokens), rank[np.minimum(ahead, len(tokens) - 1)], 0)
        _, rank[known] = np.unique(rank[known] * (int(nxt.max(initial=0)) + 1) + nxt, return_inverse=True)
        rank[known] += 1
        step *= 2
    at = known if at is None else at
    return at[np.argsort(rank[at], kind="stable")]


def _bound(tokens: np.ndarray, order: np.ndarray, query: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each query row the first place in the suffix order not below (or, upper, above) its first words."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    while len(active := np.flatnonzero(lo < hi)):
        mid = (lo[active] + hi[active]) // 2
        at, going, right = order[mid], np.arange(len(active)), np.full(len(active), upper)
        for j in range(query.shape[1]):  # word by word, while equal
            going = going[length[active[going]] > j]
            if not len(going):
                break
            a, b = tokens[at[going] + j], query[active[going], j]
            right[going] = np.where(a == b, upper, a < b)
            going = going[a == b]
        lo[active[right]] = mid[right] + 1
        hi[active[~right]] = mid[~right]
    return lo


def _alignment(sentence: list[int], window: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs."""
    n, m = len(sentence), len(window)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        x, row, below = sentence[i], best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == window[j] else max(below[j], row[j + 1])
    i = j = 0
    pairs = []
    while i < n and j < m:
        if sentence[i] == window[j] and best[i][j] == best[i + 1][j + 1] + 1:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def longest_match(doc: list[int], item: list[int]) -> tuple[int, int, int]:
    """Length of the longest run of words the two share, and where it begins in either; 0 is no word."""
    places: dict[int, list[int]] = {}
    wanted = set(item)
    for j, x in enumerate(doc):
        if x and x in wanted:
            places.setdefault(x, []).append(j)
    best, before = (0, 0, 0), {}
    for i, x in enumerate(item):
        runs = {j: before.get(j - 1, 0) + 1 for j in places.get(x, ())}
        for j, n in runs.items():
            if n > best[0]:
                best = (n, j - n + 1, i - n + 1)
        before = runs
    return best


class Searcher:
    """Searches the shards of one task for the suffixes of an evaluation block."""

    def __init__(self, block: Block, weight: np.ndarray, stock: np.ndarray, rules: LeakRules) -> None:
        self.block, self.weight, self.rules = block, weight, rules
        sentence, offset, query, before = [], [], [], []
        by_cell = weight[block.pair].tolist()
        for k, ids in enumerate(block.sentences):
            if stock[k]:
                continue
            weights = by_cell[block.ptr[k] : block.ptr[k + 1]]
            for o in range(len(ids) - 1):
                got = 0.0
                for size, x in enumerate(weights[o:], 2):
                    got += x
                    if got >= rules.information:
                        sentence.append(k)
                        offset.append(o)
                        query.append(ids[o : o + size])
                        before.append(ids[o - 1] if o else -1)
                        break
        self.sentence, self.offset, self.before = (np.array(x, np.int64) for x in (sentence, offset, before))
        self.length = np.array([len(q) for q in query], np.int64)
        self.depth = int(self.length.max(initial=1))
        self.query = np.array([q + [0] * (self.depth - len(q)) for q in query], np.int32).reshape(-1, self.depth)
        self.sums = np.bincount(np.repeat(np.arange(len(block.sentences)), block.length - 1), weights=weight[block.pair], minlength=len(block.sentences))

    def matches(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, sentence and place of the sentence's start for every left-maximal match."""
        order = suffix_order(shard.tokens, self.depth, np.flatnonzero(shard.pairs >= 0))  # a match holds a pair at least
        if not len(order) or not len(self.query):
            return (np.empty(0, np.int64),) * 3
        lo = _bound(shard.tokens, order, self.query, self.length, False)
        hi = _bound(shard.tokens, order, self.query, self.length, True)
        n = hi - lo
        q = np.repeat(np.arange(len(n)), n)
        at = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        maximal = shard.tokens[at - 1] != self.before[q]
        q, at = q[maximal], at[maximal]
        doc = shard.doc_of(at)
        return doc, self.sentence[q], at - shard.starts[doc] - self.offset[q]

    def leaks(self, docs: list[np.ndarray]) -> Iterator[tuple]:
        """(document, item, sentences, words, longest verbatim match, its place in the document and the item, wording) of every leak."""
        block, r = self.block, self.rules
        shard = Shard(block, docs, max(self.depth, 1))
        doc, sentence, start = self.matches(shard)
        if not len(doc):
            return
        n_sentences, n_items = len(block.sentences), len(block.item_ids)

        def several(combo: np.ndarray) -> np.ndarray:
            """Of (document, sentence) numbers those whose document has sentences enough of the item."""
            pair = combo // n_sentences * n_items + block.item[combo % n_sentences]
            _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
            return combo[n[back] >= r.sentences]

        hits = doc * n_sentences + sentence
        combo = several(_unique(hits))
        # What the document's word pairs could keep of a sentence at most, wherever they are; below the rule nothing is aligned.
        most = shard.coverage(shard.present(), combo // n_sentences, combo % n_sentences, self.weight)
        combo = several(combo[most >= r.wording * self.sums[combo % n_sentences]])
        kept = np.flatnonzero(np.isin(hits, combo))
        kept = kept[np.argsort(hits[kept], kind="stable")]
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        edges = np.flatnonzero(np.diff(hits[kept], prepend=-1, append=-1))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            d, s = divmod(int(hits[kept[a]]), n_sentences)
            best = self.judge(s, shard, d, set(start[kept[a:b]].tolist()))
            if best and best[0] >= r.sentence and best[1] >= r.wording:
                found.setdefault((d, int(block.item[s])), []).append((int(block.length[s]), best[1]))
        for (d, item), got in sorted(found.items()):
            n = sum(k for k, _ in got)
            if len(got) >= r.sentences and n >= r.min_words and (mean := sum(k * x for k, x in got) / n) >= r.pair_wording:
                yield d, block.item_ids[item], len(got), n, *longest_match(docs[d].tolist(), block.item_words[item]), mean

    def judge(self, s: int, shard: Shard, d: int, starts: set[int]) -> tuple[float, float] | None:
        """Share of the words, and of the wording, of a sentence that the document repeats near ``starts``."""
        block, doc, best = self.block, shard.docs[d], None
        sent = block.sentences[s]
        n, pairs = len(sent), block.pair[block.ptr[s] : block.ptr[s + 1]]
        weight, bag, pairs = self.weight[pairs].tolist(), Counter(sent), pairs.tolist()
        for a in {max(0, x) // 4 for x in starts}:
            lo, hi = max(0, a * 4 - 4), min(len(doc), a * 4 + n + 8)
            there = set(shard.pairs[shard.starts[d] + lo : shard.starts[d] + hi - 1].tolist())
            if sum(x for x, p in zip(weight, pairs, strict=True) if p in there) < self.rules.wording * self.sums[s]:
                continue
            window = doc[lo:hi].tolist()
            seen = Counter(window)
            if sum(min(c, seen[w]) for w, c in bag.items()) < self.rules.sentence * n:
                continue
            aligned = _alignment(sent, window)
            kept = sum(weight[i] for (i, j), (k, m) in zip(aligned, aligned[1:], strict=False) if k == i + 1 and m == j + 1)
            got = (len(aligned) / n, float(kept) / max(self.sums[s], 1e-9))
            best = got if best is None or got > best else best
        return best


_FOUND = "doc_id long, item_id long, n_sentences int, n_words int, longest_match int, doc_word int, item_word int, wording double"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_STOCK = "item_id long, sentence string, n_texts long"


def _weights(block: Block, n: int, df: np.ndarray, rules: LeakRules) -> np.ndarray:
    weight = np.clip(np.log((n + 1) / (df + 1)), 0.0, rules.weight_cap)
    # With few documents hardly any pair looks common, so pairs that recur in the evaluation set weigh no more than there.
    return np.where(block.in_own > 2, np.minimum(weight, np.maximum(0.0, np.log((block.n_own + 1) / np.maximum(block.in_own, 1)))), weight)


def _prepared(documents: DataFrame, items: DataFrame, rules: LeakRules) -> Iterator[tuple]:
    """Of every block: the tokenised documents, the block as sent to the tasks, pair weights and stock sentences with their counts."""
    docs = spread(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    for rows in _blocks(own_sentences(items, rules)):
        block = Block(rows)
        sent = documents.sparkSession.sparkContext.broadcast(block)
        tokenised = cut(_tokenised(docs, sent))
        n, df, alone = _count(tokenised, sent, rules)
        yield tokenised, sent, _weights(block, n, df, rules), alone > max(5, rules.stock_docs * n), alone


def leaks(documents: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """Pairs of a document and an evaluation item that it repeats.

    One row per (doc_id, item_id): repeated sentences and words, the longest
    verbatim match in words with the words before it in document and item, and
    the share of the wording kept.  NULL and empty texts leak nothing; equal
    documents each get their own rows; stock phrases and code are not an item's
    own text.  Empty inputs give no rows.
    """
    spark = documents.sparkSession
    out = None
    for tokenised, sent, weight, stock, _ in _prepared(documents, items, rules):
        more = spark.sparkContext.broadcast((weight, stock))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, more=more) -> Iterator[pa.RecordBatch]:
            block = sent.value
            searcher = Searcher(block, *more.value, rules)
            ids: list[int] = []
            held: list[np.ndarray] = []
            size = 0

            def shard() -> pa.RecordBatch:
                rows = [(ids[d], *rest) for d, *rest in searcher.leaks(held)]
                return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_FOUND_NAMES).astype({c: t for c, t in zip(_FOUND_NAMES, ("int64", "int64", "int32", "int32", "int32", "int32", "int32", "float64"), strict=True)}), preserve_index=False)

            for batch in batches:
                for i, doc in zip(batch.column("doc_id").to_pylist(), _unpacked(block, batch.column("ids")), strict=True):
                    if held and size + len(doc) > SHARD_WORDS:
                        yield shard()
                        ids, held, size = [], [], 0
                    ids.append(i)
                    held.append(doc)
                    size += len(doc)
            if held:
                yield shard()

        found = tokenised.filter("ids IS NOT NULL").select("doc_id", "ids").mapInArrow(search, _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], _FOUND)
    rest = [c for c in _FOUND_NAMES if c not in ("doc_id", "item_id", "n_words")]
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", *rest)).alias("m"))  # a doc_id may have several texts
    return best.select("doc_id", "item_id", "m.*").select(*_FOUND_NAMES)


def stock_sentences(documents: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """``item_id, sentence, n_texts``: item sentences set aside as stock phrases because so many texts repeat them.

    ``n_texts`` counts the distinct texts that repeat the sentence and nothing
    else of the item, so a passage leaked that widely on its own shows here.
    """
    found = []
    for _, sent, _, stock, alone in _prepared(documents, items, rules):
        b = sent.value
        found += [(b.item_ids[int(b.item[k])], b.texts[k], int(alone[k])) for k in np.flatnonzero(stock)]
    return documents.sparkSession.createDataFrame(found, _STOCK)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which nothing leaked; a document without id is kept."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def item_report(items: DataFrame, found: DataFrame) -> DataFrame:
    """Per evaluation item: documents that repeat it, and the longest verbatim match; 0 and NULL when none does."""
    by = found.groupBy("item_id").agg(F.count("*").alias("n"), F.max("longest_match").alias("longest_match"))
    return (
        items.select("item_id", "eval_set")
        .dropDuplicates(["item_id"])
        .join(by, "item_id", "left")
        .select("item_id", "eval_set", F.coalesce("n", F.lit(0)).alias("n_documents"), "longest_match", F.col("n").isNotNull().alias("leaked"))
    )
