"""Long exact spans shared between documents, by a compacted De Bruijn graph.

A character is shared if some `length` characters around it stand verbatim in another document.

1. Tokens are k-character substrings; of each window of `length` characters the one with the least hash is taken, so
   every window that two documents share gives both the same token at the same place. Successive tokens of a document
   are edges, labelled by a hash of all the text from the one token to the end of the next.
2. Tokens are aggregated over the corpus (partially before the shuffle): a token in one document only is dropped; a
   token whose occurrences all have the same edge onwards (or backwards) does not branch there.
3. A join gives each occurrence of a repeated token its node; a second join gives each document its occurrences.
   Successive occurrences over an edge that branches at neither end are compacted into paths: every document that holds
   a part of a path holds all of it, so a path of `length` or more characters is shared as a whole.
4. Only windows around repeated tokens that no path covers, which are those near branches, are verified one by one: the
   128-bit hash of each is aggregated, and those in two or more documents join back to their source coordinates.
5. Overlapping or touching stretches of a document are united.

No pairs are formed: a span that stands in any number of documents gives one row for each.

Defined results: null texts and texts shorter than `length` share nothing; rows with a null id are left out; rows that
repeat a doc_id count as one document (repeats within a document are not shared); offsets count Unicode characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.tables import materialise

#: Characters of a token. Longer ones repeat less by chance, shorter ones make sparser samples.
TOKEN = 64
#: Characters handled at once; longer texts are cut into segments that overlap by length - 1.
SEGMENT = 1 << 20
_LOW = np.uint64(SEGMENT - 1)
OCCURRENCES = "token long, doc_id long, at long, onward long, back long"
WINDOWS = "doc_id long, span_start long, span_end long, h1 long, h2 long"

#: Odd multipliers of the two rolling hashes and of the mixer: fixed values, any odd numbers serve.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept for the longest n seen."""
    key = (base, 0)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, 1), base, np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p)
    return _powers[key][:n]


class Rolling:
    """Hashes of substrings of a sequence of code points, each from two prefix sums."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(codes)
        self.back = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x51 + which)) * powers(base, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every full window."""
    n = len(x)
    if n < w:
        return x[:0]
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def segments(ids, texts, length: int):
    """Groups of (doc_id, offset, text) of at most SEGMENT characters together, texts cut where they are longer."""
    group, size = [], 0
    for doc, text in zip(ids, texts):
        if text is None or len(text) < length:
            continue
        step = SEGMENT - length + 1
        for at in range(0, max(1, len(text) - length + 1), step):
            part = text[at : at + SEGMENT] if len(text) > SEGMENT else text
            if size + len(part) > SEGMENT and group:
                yield group
                group, size = [], 0
            group.append((doc, at, part))
            size += len(part)
    if group:
        yield group


def sample_tokens(lengths: np.ndarray, codes: np.ndarray, length: int, k: int):
    """(segment, place, token, onward, back) of the least token of every window, of texts laid end to end."""
    ends = np.cumsum(lengths)
    roll = Rolling(codes)
    first = np.arange(len(codes) - k + 1)
    h = roll.of(first, first + k)
    order = (h & ~_LOW) | first.astype(np.uint64)  # among equal hashes the leftmost
    w = length - k + 1
    least = sliding_min(order, w)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    fits = np.arange(len(least)) + length <= ends[owner[: len(least)]]
    chosen = np.zeros(len(codes), bool)
    chosen[(least[fits] & _LOW).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    seg = owner[at]
    onward = np.zeros(len(at), np.uint64)
    linked = seg[1:] == seg[:-1]
    label = roll.of(at[:-1], at[1:] + k)
    onward[:-1][linked] = label[linked]
    back = np.zeros(len(at), np.uint64)
    back[1:][linked] = label[linked]
    return seg, at - (ends - lengths)[seg], h[at], onward, back


def _occurrences(length: int, k: int):
    def run(batches):
        for b in batches:
            for group in segments(b.column(0).to_pylist(), b.column(1).to_pylist(), length):
                lengths = np.array([len(t) for _, _, t in group])
                seg, at, token, onward, back = sample_tokens(lengths, code_points([t for _, _, t in group]), length, k)
                docs, offsets = np.array([d for d, _, _ in group], np.int64), np.array([o for _, o, _ in group], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(docs[seg]), pa.array(at + offsets[seg]), pa.array(onward.view(np.int64)), pa.array(back.view(np.int64))], ["token", "doc_id", "at", "onward", "back"])

    return run


def compact(at: np.ndarray, onward_one: np.ndarray, back_one: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of `length` or more characters, as (starts, ends), of one document's repeated tokens in order."""
    link = onward_one[:-1] & back_one[1:]
    start = np.flatnonzero(np.concatenate([[True], ~link]))
    end = np.append(start[1:], len(at)) - 1
    a, b = at[start], at[end] + k
    long_enough = b - a >= length
    return a[long_enough], b[long_enough]


def _windows(length: int, k: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat = b.column(2).flatten()
            begin = b.column(2).offsets.to_numpy()
            at_all, one_on, one_back = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = [[], [], [], [], []]
            for i, (doc, text) in enumerate(zip(ids, texts)):
                at, keep = np.unique(at_all[begin[i] : begin[i + 1]], return_index=True)
                on, back = one_on[begin[i] : begin[i + 1]][keep], one_back[begin[i] : begin[i + 1]][keep]
                whole, until = compact(at, on, back, k, length)
                # windows that hold a repeated token: starts at - (length - k) .. at, as a coverage count
                n = len(text) - length + 1
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, np.minimum(np.maximum(at - (length - k), 0), n), 1)
                np.add.at(step, np.minimum(at + 1, n), -1)
                open_ = np.cumsum(step)[:n] > 0
                for a, e in zip(whole.tolist(), until.tolist()):
                    open_[a : e - length + 1] = False
                p = np.flatnonzero(open_)
                if len(whole):
                    none = np.zeros(len(whole), np.int64)
                    for c, v in zip(out, (np.full(len(whole), doc), whole, until, none, none)):
                        c.append(v)
                if len(p):
                    codes = code_points([text])
                    h1, h2 = (Rolling(codes, j).of(p, p + length).view(np.int64) for j in (0, 1))
                    for c, v in zip(out, (np.full(len(p), doc), p, p + length, h1, h2)):
                        c.append(v)
            cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
            sure = (cols[3] == 0) & (cols[4] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], mask=sure), pa.array(cols[4], mask=sure)], ["doc_id", "span_start", "span_end", "h1", "h2"])

    return run


def unite(spans: DataFrame) -> DataFrame:
    """doc_id, span_start, span_end of the united stretches of overlapping or touching spans."""
    w = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    before = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before >= F.col("span_start"), 0).otherwise(1))
    marked = marked.withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "stretch").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("stretch")


def shared_spans(df: DataFrame, doc_id: str = "doc_id", text_col: str = "text", length: int = 200, token: int = TOKEN) -> DataFrame:
    """doc_id, span_start, span_end of every stretch of characters shared with another document."""
    k = min(token, length)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null").where(F.length("text") >= length)
    occ = docs.mapInArrow(_occurrences(length, k), OCCURRENCES)
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    nodes = occ.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), one("onward").alias("onward_one"), one("back").alias("back_one")).where("lo < hi").drop("lo", "hi")
    placed = occ.select("token", "doc_id", "at").join(nodes, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "onward_one", "back_one"))).alias("places"))
    windows = materialise(docs.join(placed, "doc_id").select("doc_id", "text", "places").mapInArrow(_windows(length, k), WINDOWS), "shared-windows")
    checked = windows.where("h1 is not null")
    twice = checked.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2")
    verified = checked.join(twice, ["h1", "h2"]).select("doc_id", "span_start", "span_end")
    return unite(verified.unionByName(windows.where("h1 is null").select("doc_id", "span_start", "span_end")))


def shared_amounts(spans: DataFrame, df: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, shared_chars, n_chars, shared_part of every document with shared stretches."""
    total = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    size = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.length(text_col).cast("long").alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    return total.join(size, "doc_id").withColumn("shared_part", F.col("shared_chars") / F.col("n_chars"))
