"""Problem 7: evaluation passages that leak into training texts.

Each shard of the corpus (SHARD_WORDS words of a partition) gets one FM-index
over its words, followed by every second word of them in two lanes, so that words
with one between them are neighbours somewhere in the index. All questions
are backward searches through its wavelet ranks, whatever the number of passages:

* the phrases of PHRASE words, located by sampled suffix positions;
* for passages that return with words changed, left out or put in, the pairs of
  neighbouring words: at least ``pairs_needed`` of them stand at most two places apart
  in a stretch that fulfils the condition (of passages too short for such pairs: the single
  words). The ranges tell how often each seed occurs before any is located; the most
  frequent ones are left out as far as enough others must remain, the rest are
  located, and where enough of them lie within a stretch the longest common
  subsequence decides exactly.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex

PHRASE, SHARE, STRETCH = 12, 0.75, 1.3
#: Words of a shard, of the passages looked for at a time, and of those that go to the tasks at a time (4 bytes each);
#: of more passages than that, the corpus is read again for the rest.
SHARD_WORDS, BLOCK_WORDS, PASS_WORDS = 1 << 18, 1 << 17, 1 << 26
ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
BROKEN = re.compile(r"(?<=[^\W_])-[ \t]*\r?\n\s*(?=[^\W_])")
WORD = re.compile(r"[^\W_]+")
HITS = "item_id bigint, doc_id bigint, kind string, first_word int, last_word int"


def words_of(text: str) -> list[str]:
    """Words in lower case, without bracketed interjections; words broken at a line end joined."""
    if "-" in text:
        text = BROKEN.sub("", text)
    if "(" in text or "[" in text:
        text = ASIDE.sub(" ", text)
        if "-" in text:
            text = BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.casefold())


def pairs_needed(n: int) -> int:
    """Of matched words next to each other in the passage, those at most two places apart in the text, at least."""
    m, s = math.ceil(SHARE * n - 1e-9), math.floor(STRETCH * n + 1e-9)
    return math.ceil(2.5 * m - 1 - n - s / 2)


def _csr(of: np.ndarray, key: np.ndarray):
    """(distinct keys, start of each in the entries, entries in order of key)."""
    order = np.argsort(key, kind="stable")
    keys, start = np.unique(key[order], return_index=True)
    return keys, np.append(start, len(key)), of[order]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Passages:
    """A block of passages as word ids (0 ends a text, 1 is any other word or a text's border): their phrases and seeds."""

    def __init__(self, ids: list[int], words: list[np.ndarray], symbols: int):
        self.ids, self.words, self.symbols = ids, [np.asarray(w, dtype=np.int64) for w in words], symbols
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.stretch = np.floor(STRETCH * size + 1e-9).astype(np.int64)
        flat = np.concatenate(self.words) if ids else np.empty(0, dtype=np.int64)
        of, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        at = np.flatnonzero(np.arange(len(flat)) - begin[of] <= size[of] - PHRASE)
        grams = flat[at[:, None] + np.arange(PHRASE)]
        self.phrases, which = np.unique(grams, axis=0, return_inverse=True) if len(at) else (grams, at)
        _, self.phrase_at, self.phrase_of = _csr(of[at], which.ravel())
        # seeds: pairs of neighbouring words, key a * symbols + b; of passages without a sure pair single words, key -1 - word
        pairs = np.array([pairs_needed(int(n)) for n in size], dtype=np.int64)
        single = pairs < 1
        self.sure = np.where(single, np.ceil(SHARE * size - 1e-9).astype(np.int64), pairs)
        at = np.flatnonzero((np.append(of[1:], -1) == of) & ~single[of]) if len(of) else of
        alone = np.flatnonzero(single[of])
        key = np.concatenate((flat[at] * symbols + flat[np.minimum(at + 1, len(flat) - 1)] if len(at) else at, -1 - flat[alone]))
        self.seeds, seed = np.unique(key, return_inverse=True)
        entry, self.times = np.unique(np.concatenate((of[at], of[alone])) * max(1, len(self.seeds)) + seed.ravel(), return_counts=True)
        self.seed_of, self.seed = entry // max(1, len(self.seeds)), entry % max(1, len(self.seeds))  # by passage
        self._masks: dict[tuple[int, bool], dict[int, int]] = {}

    def masks(self, j: int, back: bool = False) -> dict[int, int]:
        """Places of each word of passage j, a bit each."""
        out = self._masks.get((j, back))
        if out is None:
            out = self._masks[j, back] = {}
            for k, c in enumerate((self.words[j][::-1] if back else self.words[j]).tolist()):
                out[c] = out.get(c, 0) | 1 << k
        return out

    def seed_ranges(self, index: FMIndex) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(len(self.seeds), dtype=np.int64), np.zeros(len(self.seeds), dtype=np.int64)
        one = self.seeds < 0
        for which, words in ((one, (-1 - self.seeds[one])[:, None]), (~one, np.stack((self.seeds[~one] // self.symbols, self.seeds[~one] % self.symbols), axis=1))):
            if len(words):
                lo[which], hi[which] = index.search(words)
        return lo, hi

    def seed_hits(self, index: FMIndex, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, position, needed): located seeds, and how many distinct positions a stretch of each passage must have.

        A stretch that fulfils the condition has ``sure`` seeds of its passage. Without the most frequent ones, which are
        at most ``sure - needed`` (repeats counted), ``needed`` are left.
        """
        lo, hi = self.seed_ranges(index)
        count = (hi - lo)[self.seed]
        needed = np.maximum(1, -(-self.sure // 2))
        order = np.lexsort((self.seed, -count, self.seed_of))
        of, times = self.seed_of[order], self.times[order]
        total = np.cumsum(times)
        first = np.searchsorted(of, of, "left")
        keep = total - (total - times)[first] > (self.sure - needed)[of]
        keep &= count[order] > 0
        of, seed = of[keep], self.seed[order][keep]
        seeds, start, of = _csr(of, seed)
        n = hi[seeds] - lo[seeds]
        at, s = place(index.locate(_spread(lo[seeds], n))), np.repeat(np.arange(len(seeds)), n)
        m = np.diff(start)[s]
        return of[_spread(start[s], m)], np.repeat(at, m), needed

    def common(self, j: int, text: list[int]) -> int:
        """Length of the longest common subsequence with passage j, a bit a word."""
        masks, full = self.masks(j), (1 << len(self.words[j])) - 1
        v = full
        for c in text:
            m = masks.get(c)
            if m:
                u = v & m
                v = (v + u | v - u) & full
        return len(self.words[j]) - v.bit_count()

    def _matched(self, masks: dict[int, int], j: int, text: list[int]) -> tuple[int, int]:
        """(length of the longest common subsequence, place where it is reached first), -1 without any."""
        full = (1 << len(self.words[j])) - 1
        v, n, end = full, 0, -1
        for k, c in enumerate(text):
            m = masks.get(c)
            if m:
                u = v & m
                t = v + u
                v = (t | v - u) & full
                if t > full:
                    n, end = n + 1, k
        return n, end

    def stretches(self, index: FMIndex, place, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first, last word) of stretches with SHARE of the passage in order."""
        n = len(text)
        j, at, needed = self.seed_hits(index, place)
        key = np.unique(j * n + at)  # a position counts once, whatever its seeds
        j, at = key // n, key % n
        # the seeds from here to the end of a stretch that begins here
        reach = np.searchsorted(key, j * n + np.minimum(at + self.stretch[j], n) - 1, "right") - np.arange(len(key))
        start = np.flatnonzero(reach >= needed[j])
        out = []
        k = 0
        while k < len(start):
            p, lo = int(j[start[k]]), int(at[start[k]])
            size = int(self.stretch[p])
            hi = lo + size
            k += 1
            while k < len(start) and j[start[k]] == p and at[start[k]] <= hi + size:
                hi = int(at[start[k]]) + size
                k += 1
            out += self._exact(p, text, lo - size, hi, starts)
        return out

    def _exact(self, p: int, text: np.ndarray, lo: int, hi: int, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """Stretches within [lo, hi) that fulfil the condition, each in one document: from their first to their
        last matched word, those that overlap or touch as one."""
        lo, hi = max(0, lo), min(hi, len(text))
        need, size, masks = math.ceil(SHARE * len(self.words[p]) - 1e-9), int(self.stretch[p]), self.masks(p)
        out = []
        for d in range(int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi, "left"))):
            a, b = max(lo, int(starts[d])), min(hi, int(starts[d + 1]))
            part = text[a:b].tolist()
            if self.common(p, part) < need:
                continue
            s, first, last = 0, len(part), -2
            while s <= len(part) - need:
                if part[s] not in masks:
                    s += 1
                    continue
                n, end = self._matched(masks, p, part[s : s + size])
                if n < need:  # the stretch k words on has at most k matches more
                    s += need - n
                    continue
                end += s
                if s < first or end > last:  # else within the span
                    start = end - self._matched(self.masks(p, True), p, part[s : end + 1][::-1])[1]
                    if start > last + 1:
                        if last >= 0:
                            out.append((p, a + first, a + last))
                        first, last = start, end
                    first, last = min(first, start), max(last, end)
                s += 1
            if last >= 0:
                out.append((p, a + first, a + last))
        return out


class Shard:
    """Word ids of texts with a border before each next one, and their FM-index with the two lanes behind them."""

    def __init__(self, docs: list[tuple[list[int], int, list[int]]], symbols: int):
        """``docs``: (ids of the rows with this text, place of its first word, word ids)."""
        self.docs = docs
        sizes = [len(w) + 1 for _, _, w in docs]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.text = np.ones(self.starts[-1], dtype=np.int64)
        for (_, _, w), s in zip(docs, self.starts):
            self.text[s : s + len(w)] = w
        self.n, border = len(self.text), np.ones(1, dtype=np.int64)
        self.index = FMIndex(np.concatenate((self.text, border, self.text[::2], border, self.text[1::2], border - 1)), symbols)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Word of the texts at a position of the index."""
        even, odd = self.n + 1, self.n + 2 + (self.n + 1) // 2
        return np.where(at < even, at, np.where(at < odd, 2 * (at - even), 2 * (at - odd) + 1))


def phrase_spans(passages: Passages, shard: Shard) -> list[tuple[int, int, int]]:
    """(passage, first, last word) of runs of PHRASE or more words of a passage."""
    if not len(passages.phrases):
        return []
    lo, hi = shard.index.search(passages.phrases)
    got = np.flatnonzero(hi > lo)
    n = hi[got] - lo[got]
    at, phrase = shard.index.locate(_spread(lo[got], n)), np.repeat(got, n)
    at, phrase = at[at < shard.n], phrase[at < shard.n]  # not in the lanes
    m = passages.phrase_at[phrase + 1] - passages.phrase_at[phrase]
    of, at = passages.phrase_of[_spread(passages.phrase_at[phrase], m)], np.repeat(at, m)
    order = np.lexsort((at, of))
    at, of = at[order], of[order]
    if not len(at):
        return []
    # phrases that overlap or touch are one span
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] > at[:-1] + PHRASE)])
    last = np.append(first[1:], len(at)) - 1
    return [(int(of[a]), int(at[a]), int(at[b]) + PHRASE - 1) for a, b in zip(first, last)]


def search_shard(passages: Passages, shard: Shard) -> list[tuple]:
    """Rows of ``HITS``."""
    spans = [(*x, "phrase") for x in phrase_spans(passages, shard)]
    spans += [(*x, "stretch") for x in passages.stretches(shard.index, shard.place, shard.text, shard.starts)]
    out = []
    for p, a, b, kind in spans:
        d = int(np.searchsorted(shard.starts, a, "right")) - 1
        ids, place, w = shard.docs[d]
        s = int(shard.starts[d])
        b = min(b, s + len(w) - 1)
        out += [(passages.ids[p], i, kind, place + a - s, place + b - s) for i in ids]
    return out


def stated(items, pass_words: int | None = None, block_words: int | None = None):
    """Of (id, passage) pairs: (vocabulary, blocks, words of the longest) of each pass; a block is (ids, word ids) of its passages."""
    vocabulary, blocks, longest, block, total = {}, [], 0, 0, 0
    for i, text in items:
        w = words_of(text or "")
        if not w:
            continue
        if total >= (pass_words or PASS_WORDS):
            yield vocabulary, blocks, longest
            vocabulary, blocks, longest, block, total = {}, [], 0, 0, 0
        if not blocks or block >= (block_words or BLOCK_WORDS):
            blocks.append(([], []))
            block = 0
        blocks[-1][0].append(i)
        blocks[-1][1].append(np.array([vocabulary.setdefault(x, len(vocabulary) + 2) for x in w], dtype=np.int32))
        block, total, longest = block + len(w), total + len(w), max(longest, len(w))
    if blocks:
        yield vocabulary, blocks, longest


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """Every span of a document that holds a passage: item_id, doc_id, kind, first_word, last_word.

    kind 'phrase': PHRASE or more consecutive words of the passage; 'stretch':
    SHARE of its words in order within STRETCH times its length, all such stretches that
    overlap or touch as one span, from the first to the last matched word. Null ids, null
    or wordless texts and passages give no row; passages and texts of one word are
    searched like all others. Equal texts of a shard are searched once and
    reported for each row. Long texts are searched in pieces that overlap by more
    than a stretch, so nothing is cut. The passages, a stated set, come to
    the driver piece by piece and go to the tasks as word ids, in blocks of bounded size;
    each shard is indexed once for all blocks.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(passage_col).alias("p")).dropna().toLocalIterator()
    d = documents.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).dropna()
    found = spark.createDataFrame([], HITS)
    for k, (vocabulary, blocks, longest) in enumerate(stated((r["i"], r["p"]) for r in rows)):
        sent = [spark.sparkContext.broadcast(b) for b in blocks]
        part = d.mapInPandas(_searcher(spark.sparkContext.broadcast(vocabulary), sent, longest), HITS)
        found = found.unionByName(part) if k else part
    return found


def _searcher(vocabulary, blocks: list, longest: int):
    def run(batches):
        get, columns = vocabulary.value.get, ["item_id", "doc_id", "kind", "first_word", "last_word"]
        symbols = len(vocabulary.value) + 2
        overlap = max(PHRASE, math.floor(STRETCH * longest + 1e-9)) + PHRASE
        most = max(SHARD_WORDS, 2 * overlap)
        only = Passages(*blocks[0].value, symbols) if len(blocks) == 1 else None
        docs: list = []
        same: dict = {}
        size = 0

        def done():
            shard = Shard(docs, symbols)
            for b in blocks:
                yield pd.DataFrame(search_shard(only or Passages(*b.value, symbols), shard), columns=columns)

        for pdf in batches:
            for i, t in zip(pdf["i"].tolist(), pdf["t"].tolist()):
                if t in same:
                    for k in same[t]:
                        docs[k][0].append(i)
                    continue
                w = [get(x, 1) for x in words_of(t)]
                if not w:
                    continue
                same[t] = []
                for a in range(0, max(1, len(w) - overlap), most - overlap):
                    same[t].append(len(docs))
                    docs.append(([i], a, w[a : a + most]))
                    size += min(len(w) - a, most) + 1
                if size >= SHARD_WORDS:
                    yield from done()
                    docs.clear()
                    same.clear()
                    size = 0
        if docs:
            yield from done()

    return run


def removal_spans(found: DataFrame) -> DataFrame:
    """One row a run of words to remove: doc_id, first_word, last_word, items; spans that overlap or touch are merged."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("first_word", "last_word", "item_id")
    s = found.withColumn("before", F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("run", F.sum(F.when(F.col("first_word") <= F.col("before") + 1, 0).otherwise(1)).over(w))
    return s.groupBy("doc_id", "run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("run")
