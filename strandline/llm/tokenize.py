"""Encoding of whole texts by byte-level BPE, with a segment tree over byte positions.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once per worker. The pieces of one size class
are encoded together: a complete binary tree over the byte positions of each piece keeps, at every node, the leftmost
least merge rank of the pairs that start below it (rank and position in one integer, so the minimum is the leftmost).
A merge reads the root, joins two live neighbours and updates three leaves and their ancestors: logarithmic in the piece,
vectorised over the pieces. A long piece has a tree of its own: all places of the least rank are merged at once, where no
pair that such a merge makes can have a lower rank, with the same point updates; else only the leftmost is.

Defined results: null and empty texts have no ids; texts are encoded whole; strings of special tokens are ordinary text;
text is what UTF-8 holds, so lone surrogates cannot occur.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie, and the pattern that parts text before the merges.
TOKENIZER_DIR = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it forgets them all; bounds memory, not results.
REMEMBER = 200_000
NONE = np.int64(1) << 60
#: Bytes from which a piece is encoded by itself.
LONG = 1024


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else the next free from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.first = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        code = left << 20 | right
        order = np.argsort(code)
        self.codes, self.ranks, self.made = code[order], order.astype(np.int64), made[order]
        self.by_rank = made
        # the least rank of any pair with a token that the merge of this rank makes: is it lower, places must be merged one by one
        least = np.full(int(max(made.max(), left.max(), right.max())) + 1, len(made), np.int64)
        np.minimum.at(least, left, np.arange(len(made)))
        np.minimum.at(least, right, np.arange(len(made)))
        self.at_once = least[made] > np.arange(len(made))
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where no merge joins them."""
        code = a << 20 | b
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[i] == code, self.ranks[i], NONE)

    def merge_class(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of 2..width bytes; width is a power of two."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        cols = np.arange(width)
        sym = self.first[raw]
        nxt = np.where(cols + 1 < sizes[:, None], cols + 1, width)  # width: no neighbour
        prv = np.broadcast_to(cols - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        pair = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        pair = np.where((cols[:-1] + 1 < sizes[:, None]) & (pair < NONE), pair << 32 | cols[:-1], NONE)
        tree[:, width : 2 * width - 1] = pair
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.ones((n, width + 1), bool)
        live[:, :width] = cols < sizes[:, None]
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            sym[rows, at] = self.by_rank[rank]
            live[rows, gone] = False
            nxt[rows, at] = after
            has = after < width
            prv[rows[has], after[has]] = at[has]
            before = prv[rows, at]
            back = before >= 0
            leaf = np.full(len(rows), NONE)
            r = self.rank(sym[rows[has], at[has]], sym[rows[has], after[has]])
            leaf[has] = np.where(r < NONE, r << 32 | at[has], NONE)
            tree[rows, width + at] = leaf
            tree[rows, width + gone] = NONE
            rb, bb = rows[back], before[back]
            r = self.rank(sym[rb, bb], sym[rb, at[back]])
            tree[rb, width + bb] = np.where(r < NONE, r << 32 | bb, NONE)
            a, g, b = (width + at) >> 1, (width + gone) >> 1, (width + bb) >> 1
            for _ in range(width.bit_length() - 1):
                tree[rows, a] = np.minimum(tree[rows, 2 * a], tree[rows, 2 * a + 1])
                tree[rows, g] = np.minimum(tree[rows, 2 * g], tree[rows, 2 * g + 1])
                tree[rb, b] = np.minimum(tree[rb, 2 * b], tree[rb, 2 * b + 1])
                a, g, b = a >> 1, g >> 1, b >> 1
            rows = rows[tree[rows, 1] < NONE]
        keep = live[:, :width]
        flat, ends = sym[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of two or more bytes."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        sym = self.first[np.frombuffer(piece, np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        live = np.ones(n, bool)
        tree = np.full(2 * width, NONE)
        r = self.rank(sym[:-1], sym[1:])
        tree[width : width + n - 1] = np.where(r < NONE, r << 32 | np.arange(n - 1), NONE)
        level = width
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        while (best := int(tree[1])) < NONE:
            rank = best >> 32
            if self.at_once[rank]:
                nodes = np.ones(1, np.int64)
                while nodes[0] < width:  # down to all leaves of this rank, in order
                    nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
                    nodes = nodes[tree[nodes] >> 32 == rank]
                at = nodes - width
                if len(at) > 1:
                    joined = np.concatenate([[False], nxt[at[:-1]] == at[1:]])  # overlaps the pair before it, as in aaa
                    if joined.any():
                        head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                        at = at[(np.arange(len(at)) - head) % 2 == 0]
            else:
                at = np.array([best & 0xFFFFFFFF])
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.by_rank[rank]
            live[gone] = False
            nxt[at] = after
            has = after < n
            prv[after[has]] = at[has]
            tree[width + gone] = tree[width + at] = NONE
            start = np.concatenate([at[has], prv[at[prv[at] >= 0]]])
            r = self.rank(sym[start], sym[nxt[start]])
            tree[width + start] = np.where(r < NONE, r << 32 | start, NONE)
            up = (np.concatenate([at, gone, start]) + width) >> 1
            for _ in range(width.bit_length() - 1):
                if len(up) > 64:
                    up = np.unique(up)
                tree[up] = np.minimum(tree[2 * up], tree[2 * up + 1])
                up >>= 1
        return sym[live].tolist()

    def learn(self, pieces) -> None:
        """Encodes the given pieces, by size class, and remembers them."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if len(b) == 1:
                self.known[p] = [int(self.first[b[0]])]
            elif len(b) >= LONG:
                self.known[p] = self.merge_long(b)
            else:
                classes.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for width, members in classes.items():
            step = max(1, 262_144 // width)
            for i in range(0, len(members), step):
                some = members[i : i + step]
                for (p, _), ids in zip(some, self.merge_class([b for _, b in some], width)):
                    self.known[p] = ids

    def encode_batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Flat ids and the end of each text's ids."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn({p for pieces in cut for p in pieces}.difference(self.known))
        known, flat, ends = self.known, [], []
        for pieces in cut:
            for p in pieces:
                flat += known[p]
            ends.append(len(flat))
        return flat, ends


_loaded: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, ids of every row. One pass, no shuffle; the vocabulary is read from `tokenizer_dir` on each executor."""
    path = os.path.join(tokenizer_dir, f"{name}.json")

    def run(batches):
        bpe = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                flat, ends = bpe.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
