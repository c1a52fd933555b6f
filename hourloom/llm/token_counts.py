"""Edit-aware token counts: a segment tree of pre-token counts for each document.

A text is cut into chunks at places that no token crosses: before blanks, and in long stretches without these, as unspaced scripts,
tables and code have them, before other white space, where letters, digits and other characters meet, and between two characters whose
adjoining bytes stand side by side in no token of the vocabulary. A run of chunks is a leaf, kept as its piece of the text. The tree's
root is the document's token count, its inner nodes sum their subtrees' characters and tokens. An edit finds its leaves from the
root, re-encodes the leaves it touches, and neighbours as long as a leaf's border is no longer such a place; then only the sums above
the changed leaves are redone. Leaves that have grown are split and emptied ones leave, so a later edit stays small; the tree's shape
is redone then, without encoding anything again.

A null text counts as empty: 0 tokens. Edits are in code points of the text as it is when they apply, one after the other;
what lies beyond the text's end is cut off, so every edit has a result. Rows are edited one by one, repeated rows too;
tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm import store
from hourloom.llm.tokenize import ChunkEncoder, default_file, encoder

#: Chunks in a leaf; a leaf of more than twice as many is split.
LEAF = 32
#: Characters of a chunk that is cut again, and least characters of what it is cut into. Where no place is safe it stays whole.
LONG, PIECE = 48, 16
#: White space whose class depends on the engine.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\u180e"


@cache
def kind(c: str) -> str:
    """L for letters, N for numbers, S for white space, O for others; none where Unicode versions or engines differ."""
    now, before = (u.category(c)[0] for u in (unicodedata, unicodedata.ucd_3_2_0))
    if c in ODD_SPACE or now != before or unicodedata.category(c) == "Cn":
        return ""
    return "S" if c.isspace() else now if now in "LN" else "O"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_neighbours: dict[int, np.ndarray] = {}


def neighbours(enc: ChunkEncoder) -> np.ndarray:
    """For each pair of bytes (256 * first + second), whether some token of the vocabulary has them side by side."""
    if id(enc) not in _neighbours:
        values, out = byte_values(), np.zeros(1 << 16, bool)
        for token in enc.tokenizer.get_vocab():
            b = np.array([values.get(c, 0) for c in token], np.int64)
            out[256 * b[:-1] + b[1:]] = True
        _neighbours[id(enc)] = out
    return _neighbours[id(enc)]


def border(a: str, b: str, enc: ChunkEncoder) -> bool:
    """Whether no token, in any text, reaches from character a to b behind it, so that a text may be encoded in parts that meet there.

    A pre-token ends where kinds change and before white space, but an apostrophe may take letters along; within one kind the parts'
    pre-tokens are those of the whole cut in two, and no merge crosses the cut.
    """
    x, y = kind(a), kind(b)
    if not x or not y or x == "S":
        return False
    if y == "S":
        return True
    if x != y:
        return a != "'"
    return b != "'" and not neighbours(enc)[256 * a.encode()[-1] + b.encode()[0]]


def chunks_of(text: str, enc: ChunkEncoder) -> list[str]:
    """The encoder's chunks, long ones cut again."""
    out = []
    for chunk in enc.chunks(text):
        if len(chunk) > LONG:
            start, at = 0, PIECE
            while at < len(chunk):
                if border(chunk[at - 1], chunk[at], enc):
                    out.append(chunk[start:at])
                    start, at = at, at + PIECE
                else:
                    at += 1
            chunk = chunk[start:]
        out.append(chunk)
    return out


class Tree:
    """pieces: the text by leaf. sums[k] are the characters and tokens below node k, whose children are 2k and 2k + 1; the leaves
    are the upper half."""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.pieces, self.counts = pieces or [""], counts or [0]
        self.shape()

    def shape(self) -> None:
        """Redo all sums from the leaves."""
        self.half = half = 1 << (len(self.pieces) - 1).bit_length()
        level = np.zeros((half, 2), np.int64)
        level[: len(self.pieces), 0] = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        level[: len(self.pieces), 1] = self.counts
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        self.sums = np.concatenate([np.zeros((1, 2), np.int64), *levels[::-1]])

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, place in it) of a code point, the last leaf's end for the text's end; from the root down."""
        k, last = 1, len(self.pieces) - 1
        while k < self.half:
            left = int(self.sums[2 * k, 0])
            k, at = (2 * k, at) if at < left else (2 * k + 1, at - left)
        leaf = k - self.half
        return (leaf, at) if leaf <= last else (last, len(self.pieces[last]))

    def set(self, leaf: int, piece: str, count: int) -> None:
        """Change a leaf and the sums above it."""
        k = self.half + leaf
        step = np.array((len(piece), count), np.int64) - self.sums[k]
        self.pieces[leaf], self.counts[leaf] = piece, count
        while k:
            self.sums[k] += step
            k //= 2

    def before(self, leaf: int) -> int:
        """Tokens in the leaves before one, by the subtrees to its left."""
        k, out = self.half + leaf, 0
        while k > 1:
            if k % 2:
                out += int(self.sums[k - 1, 1])
            k //= 2
        return out


def leaves_of(text: str, enc: ChunkEncoder, leaf: int) -> tuple[list[str], list[int]]:
    """Pieces of `leaf` chunks and their token counts."""
    chunks = chunks_of(text, enc) if text else []
    sizes = enc.counts(chunks)
    cut = range(0, len(chunks), leaf)
    return ["".join(chunks[k : k + leaf]) for k in cut], [sum(sizes[k : k + leaf]) for k in cut]


def build(text: str, enc: ChunkEncoder, leaf: int = LEAF) -> Tree:
    return Tree(*leaves_of(text, enc, leaf))


def joint(left: str, right: str, enc: ChunkEncoder) -> bool:
    """Whether a leaf may end between two texts."""
    return bool(left) and bool(right) and border(left[-1], right[0], enc)


def edit(tree: Tree, at: int, delete: int, insert: str, enc: ChunkEncoder, leaf: int = LEAF) -> int:
    """Edit the tree's text in place; the number of leaves re-encoded."""
    at = max(0, min(at, tree.chars))
    end = max(at, min(at + delete, tree.chars))
    (first, a), (stop, b) = tree.find(at), tree.find(end)
    if a == 0 and first > 0:  # what is put at a leaf's start may join the leaf before
        first, a = first - 1, len(tree.pieces[first - 1])
    pieces = tree.pieces
    new = pieces[first][:a] + insert + pieces[stop][b:]
    while True:
        if first > 0 and not joint(pieces[first - 1], new, enc):
            first -= 1
            new = pieces[first] + new
        elif stop < len(pieces) - 1 and not joint(new, pieces[stop + 1], enc):
            stop += 1
            new += pieces[stop]
        else:
            break
    chunks = chunks_of(new, enc) if new else []
    old = stop - first + 1
    if old == 1 and 0 < len(chunks) <= 2 * leaf:
        tree.set(first, new, sum(enc.counts(chunks)))
        return 1
    own, counts = leaves_of(new, enc, leaf)
    if len(own) == old:
        for k in range(old):
            tree.set(first + k, own[k], counts[k])
    else:
        pieces[first : stop + 1], tree.counts[first : stop + 1] = own, counts
        if not pieces:
            pieces.append("")
            tree.counts.append(0)
        tree.shape()
    return max(old, len(own))


TREES = "doc_id long, pieces array<string>, counts array<int>"


def build_trees(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, pieces, counts: the stored state that edits start from; the sums follow from it without encoding."""
    store.small_batches(docs.sparkSession)
    file = tokenizer or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            trees = [leaves_of(t or "", enc, leaf) for t in store.texts(batch)]
            cols = [batch.column(0), pa.array([p for p, _ in trees], pa.list_(pa.string())), pa.array([c for _, c in trees], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "pieces", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, TREES)


EDITED = f"{TREES}, tokens_before long, tokens_after long, leaves long, leaves_encoded long"


def apply_edits(trees: DataFrame, edits: Column, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Trees after edits (array of structs at, delete, insert), with the counts before and after and the work done. edits may refer to
    the tree's pieces."""
    store.small_batches(trees.sparkSession)
    file = tokenizer or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, pieces, counts, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(pieces, counts)
                before, work = tree.total, 0
                for e in own or []:
                    work += edit(tree, e["at"] or 0, e["delete"] or 0, e["insert"] or "", enc, leaf)
                for c, v in zip(cols, (doc_id, tree.pieces, tree.counts, before, tree.total, len(tree.pieces), work), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "pieces", "counts", "tokens_before", "tokens_after", "leaves", "leaves_encoded"])

    return trees.select("doc_id", "pieces", "counts", edits.alias("edits")).mapInArrow(run, EDITED)


def redaction_edits(text: Column) -> Column:
    """Three edits that follow from each text: its middle 20 code points are masked, its first word is put again at the start,
    and a code point goes at one third."""
    size = F.coalesce(F.length(text), F.lit(0))
    one = lambda at, delete, insert: F.struct(at.cast("int").alias("at"), F.lit(delete).alias("delete"), insert.alias("insert"))
    word = F.coalesce(F.regexp_extract(text, r"^\S{0,40}", 0), F.lit(""))
    return F.array(one(size / 2, 20, F.lit("[masked]")), one(F.lit(0), 0, F.concat(word, F.lit(" "))), one(size / 3, 1, F.lit("")))
