"""Evaluation passages that stand in a training corpus, by a distributed positional inverted index.

1. The words of the test items make the vocabulary. The corpus is tokenised once into an index of that vocabulary, sharded by
   rows and written to the shared folder: a shard holds, for each term, its postings (document, word position) in order; a
   spoilt word posts under every term it may be. However many items there are, the corpus is read and tokenised once.
2. The frequency of each term is summed over all shards and joined to the items' words; of every window of `min_words`
   consecutive words of an item the rarest term becomes an anchor.
3. The items go to the shards in blocks of bounded size. A shard looks up the anchor terms that it holds, so only items with
   such a term are visited: their anchors' postings less their place in the item give offsets at which the item would start.
   These are intersected with the offset-adjusted postings of the other words of the anchor's windows, all items of a shard
   together: first of the words that are likely to be missing in most windows, rare ones near the anchor. Windows that lack
   a word and offsets without a window left are dropped. What remains is a leak.

Nothing that grows with the corpus is sent anywhere, and none of its rows is shuffled.

Defined results: null and empty texts hold nothing; items of fewer than `min_words` words can't be found; repeated rows
of a document or an item give one row; null ids are left out; texts are read whole: long ones are indexed in segments that
overlap by `min_words` - 1 words, long items searched in pieces that overlap alike.

`find_leaks` writes the index when it is called, before the result is used. `layout` and `resolver` hold what is peculiar to a
corpus: how a text becomes words, and which terms a word may stand for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import subtitles
from strandline.sources.tables import materialise

#: Characters of test items in one block; what is sent to the shards is proportional to it.
BLOCK_CHARS = 4_000_000
#: Characters of vocabulary that one index holds; items with a larger one are searched in several parts, each with an index of its own.
VOCABULARY_CHARS = 2_000_000
#: Documents (or segments of them) and words after which a shard is closed.
SHARD_DOCS, SHARD_WORDS = 2000, 400_000
#: Words of an item that are searched as one piece.
PIECE_WORDS = 4096
#: Cells (an offset's windows) that are held at once.
CELLS = 2_000_000
INDEX_SCHEMA = "doc_ids array<long>, terms array<int>, sizes array<int>, docs array<int>, places array<int>"
#: Added to positions so that an item that would start before its document keeps a key of its own.
PAD = PIECE_WORDS
#: Bits of a position and of a document's number in a key.
PLACE_BITS, DOC_BITS = 21, 12
LOW = (1 << (PLACE_BITS + DOC_BITS)) - 1


class Coder(dict):
    """Numbers of the parts of texts, given when first met (-1: no word), and the terms of each number."""

    REMEMBER = 400_000

    def __init__(self, plain: Callable[[str], str], resolve: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.plain, self.resolve = plain, resolve
        self.sizes: list[int] = []
        self.terms: list[int] = []

    def __missing__(self, part: str) -> int:
        word = self.plain(part)
        if not word:
            self[part] = -1
            return -1
        terms = self.resolve(word)
        self[part] = n = len(self.sizes)
        self.sizes.append(len(terms))
        self.terms += terms
        return n

    def encode(self, parts: list[str]) -> np.ndarray:
        """Numbers of the words among the parts."""
        codes = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        return codes[codes >= 0]

    def postings(self, codes: np.ndarray, doc: np.ndarray, place: np.ndarray):
        """(term, doc, place): a word posts under each of its terms."""
        size, terms = np.array(self.sizes, np.int64), np.array(self.terms, np.int64)
        first = np.cumsum(size) - size
        n = size[codes]
        who = np.repeat(np.arange(len(codes)), n)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        return terms[first[codes[who]] + nth], doc[who], place[who]


def postings(term: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """terms, sizes, docs, places: the postings of a shard, by term, document and position."""
    key = np.sort(term.astype(np.int64) << (PLACE_BITS + DOC_BITS) | doc.astype(np.int64) << PLACE_BITS | place.astype(np.int64))
    term = key >> (PLACE_BITS + DOC_BITS)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    return term[first], np.diff(np.append(first, len(term))), (key & LOW) >> PLACE_BITS, key & ((1 << PLACE_BITS) - 1)


@lru_cache(1)
def _vocabulary(resolver: Callable, words: tuple[str, ...]):
    """A worker's vocabulary, made once for all its tasks."""
    return resolver(words)


def build_index(docs: DataFrame, id_col: str, text_col: str, words: list[str], overlap: int, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS, layout: Callable = subtitles.spoken_parts, plain: Callable = subtitles.plain, resolver: Callable = subtitles.Vocabulary) -> DataFrame:
    """The index of the corpus for the given terms, a row for each shard; term i is words[i - 1].

    A document of more than `shard_words` words is indexed in segments that overlap by `overlap` words.
    """
    shard_docs, shard_words = min(shard_docs, (1 << DOC_BITS) - 1), min(shard_words, 1 << (PLACE_BITS - 1))
    segment = max(shard_words, 2 * overlap + 1)

    def close(coder, ids, parts):
        sizes = np.array([len(p) for p in parts], np.int64)
        doc = np.repeat(np.arange(len(parts)), sizes)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        term, doc, place = coder.postings(np.concatenate(parts), doc, place)
        cols = [np.array(ids, np.int64), *postings(term, doc, place)]
        kinds = [np.int64, *[np.int32] * 4]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c.astype(k))) for c, k in zip(cols, kinds)]
        return pa.RecordBatch.from_arrays(lists, ["doc_ids", "terms", "sizes", "docs", "places"])

    def run(batches):
        resolve = _vocabulary(resolver, tuple(words)).resolve
        coder = Coder(plain, resolve)
        ids, parts, read = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                codes = coder.encode(layout(text.as_py()))
                for at in range(0, max(1, len(codes) - overlap), segment - overlap):
                    ids.append(doc_id)
                    parts.append(codes[at : at + segment])
                    read += len(parts[-1])
                    if len(ids) >= shard_docs or read >= shard_words:
                        yield close(coder, ids, parts)
                        ids, parts, read = [], [], 0
                if not ids and len(coder) > coder.REMEMBER:
                    coder = Coder(plain, resolve)
        if ids:
            yield close(coder, ids, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, INDEX_SCHEMA)


def item_words(items: DataFrame, id_col: str, text_col: str, min_words: int, layout: Callable = subtitles.spoken_parts, plain: Callable = subtitles.plain) -> DataFrame:
    """item_id, piece, place, word of the items' words; long items come in pieces that overlap by min_words - 1 words."""
    if min_words > PIECE_WORDS // 2:
        raise ValueError(f"min_words is at most {PIECE_WORDS // 2}")
    step = PIECE_WORDS

    def run(batches):
        for b in batches:
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = [w for w in map(plain, layout(text.as_py())) if w]
                for piece, at in enumerate(range(0, max(1, len(words) - min_words + 1), step - min_words + 1)):
                    part = words[at : at + step]
                    n = len(part)
                    if n >= min_words:
                        yield pa.RecordBatch.from_arrays([pa.array([item_id] * n, pa.int64()), pa.array([piece] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(part, pa.string())], ["item_id", "piece", "place", "word"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, piece int, place int, word string")


def anchors(counts: np.ndarray, min_words: int, spare: int = 0) -> list[int]:
    """Places of an item such that each window of min_words has its spare + 1 rarest terms among them."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    windows = np.lib.stride_tricks.sliding_window_view(rank, min_words)
    return np.unique(order[np.sort(windows, 1)[:, : spare + 1]]).tolist()


class Shard:
    """A shard's postings as one sorted array of keys: term, document and position in one number."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, places: np.ndarray):
        self.terms, self.ends = terms.astype(np.int64), np.cumsum(sizes, dtype=np.int64)
        self.low = docs.astype(np.int64) << PLACE_BITS | places.astype(np.int64) + PAD
        self.keys = np.repeat(self.terms, sizes) << (PLACE_BITS + DOC_BITS) | self.low

    def holds(self, term: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each term stands at each document and position."""
        if not len(self.keys):
            return np.zeros(len(term), bool)
        key = term << (PLACE_BITS + DOC_BITS) | low
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


class Block:
    """Items side by side: their terms, and all anchors by term with the order in which the words around them are looked up."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]], min_words: int, spare: int = 0):
        """items: (item_id, terms, occurrences of each term in the corpus)."""
        self.min_words, self.spare = min_words, spare
        self.ids = np.array([i for i, _, _ in items], np.int64)
        self.size = np.array([len(t) for _, t, _ in items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.terms = np.concatenate([np.array(t, np.int64) for _, t, _ in items] + [np.zeros(0, np.int64)])
        found = [anchors(np.array(c), min_words, spare) for _, _, c in items]
        owner, place = np.repeat(np.arange(len(items)), [len(a) for a in found]), np.array([p for a in found for p in a], np.int64)
        term = self.terms[self.first[owner] + place]
        by = np.argsort(term, kind="stable")
        self.a_term, self.a_item, self.a_place = term[by], owner[by].astype(np.int64), place[by]
        # the words within reach of an anchor: the rarer and nearer, the more windows they are likely to rule out
        self.away = np.concatenate([np.arange(1 - min_words, 0), np.arange(1, min_words)])
        at = self.a_place[:, None] + self.away
        self.inside = (at >= 0) & (at < self.size[self.a_item][:, None])
        occurs = np.concatenate([np.array(c, np.float64) for _, _, c in items] + [np.zeros(0)])
        total = max(occurs.sum(), 1)
        hit = occurs[np.where(self.inside, self.first[self.a_item][:, None] + at, 0)] / total if len(occurs) else np.zeros(at.shape)
        gain = np.where(self.inside, (1 - hit) * (min_words - np.abs(self.away)), -1)
        self.order = np.argsort(-gain, axis=1, kind="stable")
        # window k of an anchor starts min_words - 1 - k words before it; which windows hold the word so many places away
        k = np.arange(min_words)
        self.held = (k <= self.away[:, None] + min_words - 1) & (k >= self.away[:, None])

    def search(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document number, item_id) of the leaks in a shard."""
        at = np.searchsorted(shard.terms, self.a_term)
        there = np.flatnonzero(shard.terms[np.minimum(at, len(shard.terms) - 1)] == self.a_term) if len(shard.terms) else np.zeros(0, np.int64)
        end = shard.ends[at[there]]
        begin = np.where(at[there] > 0, shard.ends[at[there] - 1], 0)
        n = end - begin
        who = np.repeat(there, n)
        post = np.repeat(begin, n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        step = max(1, CELLS // self.min_words)
        hits = [a + self._verify(shard, who[a : a + step], shard.low[post[a : a + step]]) for a in range(0, len(who), step)]
        keep = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        pairs = np.unique((shard.low[post[keep]] >> PLACE_BITS) << 32 | self.a_item[who[keep]])
        return pairs >> 32, self.ids[pairs & 0xFFFFFFFF]

    def _verify(self, shard: Shard, anchor: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which of the anchors' postings have a window around them that lacks at most `spare` words."""
        rows = np.arange(len(anchor))
        start = self.a_place[anchor][:, None] - (self.min_words - 1) + np.arange(self.min_words)
        fits = (start >= 0) & (start + self.min_words <= self.size[self.a_item[anchor]][:, None])
        lacks = np.where(fits, 0, self.min_words + 1).astype(np.int16)
        for nth in range(len(self.away)):
            if not len(rows):
                break
            which = self.order[anchor, nth]
            here = self.inside[anchor, which]
            term = self.terms[np.where(here, self.first[self.a_item[anchor]] + self.a_place[anchor] + self.away[which], 0)]
            m = np.flatnonzero(here & ~shard.holds(term, low + self.away[which]))
            lacks[m] += self.held[which[m]]
            left = (lacks <= self.spare).any(1)
            if not left.all():
                rows, anchor, low, lacks = rows[left], anchor[left], low[left], lacks[left]
        return rows


def item_blocks(counted: DataFrame, block_chars: int | None = None, min_words: int = 16, spare: int = 0):
    """The items in blocks of bounded size. counted: item_id, piece, terms, counts (in order of place), chars."""
    limit = BLOCK_CHARS if block_chars is None else block_chars
    block, size = [], 0
    for item_id, terms, counts, chars in counted.select("item_id", "terms", "counts", "chars").toLocalIterator():
        block.append((item_id, terms, counts))
        size += chars
        if size >= limit:
            yield Block(block, min_words, spare)
            block, size = [], 0
    if block:
        yield Block(block, min_words, spare)


def _search(index: DataFrame, block: Block) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, *rest = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(5))
                doc, item = block.search(Shard(*rest))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

    return index.mapInArrow(run, "doc_id long, item_id long")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_words: int = 16, spare: int = 0, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS, layout: Callable = subtitles.spoken_parts, plain: Callable = subtitles.plain, resolver: Callable = subtitles.Vocabulary) -> DataFrame:
    """doc_id, item_id of every document that holds min_words consecutive words of an item.

    With `spare`, so many of them may be other words (proximity matches): still found without loss, for a window that lacks
    `spare` words has one of its spare + 1 rarest.
    """
    wanted = materialise(item_words(items, item_id, text_col, min_words, layout, plain), "leak-items")

    def part(words: DataFrame) -> DataFrame | None:
        distinct = words.select("word").distinct()
        size, most, least = words.groupBy("word").agg(F.max("item_id").alias("hi"), F.min("item_id").alias("lo")).agg(F.sum(F.length("word")), F.max("hi"), F.min("lo")).first()
        if size is None:
            return None
        if size > VOCABULARY_CHARS and most > least:
            halves = [h for h in (part(words.where(F.col("item_id") <= (least + most) // 2)), part(words.where(F.col("item_id") > (least + most) // 2))) if h is not None]
            return halves[0] if len(halves) == 1 else halves[0].unionByName(halves[1])
        vocabulary = [r[0] for r in distinct.orderBy("word").toLocalIterator()]
        index = materialise(build_index(docs, doc_id, text_col, vocabulary, min_words - 1, shard_docs, shard_words, layout, plain, resolver), "leak-index")
        numbers = docs.sparkSession.createDataFrame(pa.table({"word": vocabulary, "term": pa.array(range(1, len(vocabulary) + 1), pa.int32())}))
        counts = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("n"))
        counted = words.join(numbers, "word").join(counts, "term", "left").groupBy("item_id", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"), F.sum(F.length("word") + 1).alias("chars"))
        counted = counted.select("item_id", F.col("w.term").alias("terms"), F.col("w.n").alias("counts"), "chars")
        found = None
        for block in item_blocks(counted, None, min_words, spare):
            one = _search(index, block)
            found = one if found is None else found.unionByName(one)
        return found

    found = part(wanted)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long") if found is None else found.dropDuplicates(["doc_id", "item_id"])
