"""Encode texts with a public byte-level BPE file of the tokenizers library, remembering chunks already encoded."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker remembers in each of two generations.
REMEMBERED = 700_000
#: A byte-level pre-token that holds other than white space can have a blank only as its first character, so a text may
#: be cut before a blank that follows such a character, and its ids are those of the parts in order.
CUT = re.compile(r"(?<=\S)(?= )")
#: Blanks at the start or next to other white space: only then do plain splits at blanks differ from CUT.
ODD_BLANKS = [w + " " for w in "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Characters of which no one doubts that they are letters (Latin, Greek, Cyrillic), digits, or marks without the apostrophe.
LETTER, DIGIT, MARK = "A-Za-zÀ-ÖØ-öø-\u024f\u0391-\u03a1\u03a3-\u03e1\u0400-\u0481\u048a-\u052f", "0-9", r"!-&(-/:-@\[-`{-~"
#: Pieces into which the published byte-level rule cuts chunks of these alone; line ends count where they stand single inside.
PIECES = re.compile(rf" ?[{LETTER}]+| ?[{DIGIT}]+| ?[{MARK}]+|(?<=[{LETTER}{DIGIT}{MARK}])\n(?=[{LETTER}{DIGIT}{MARK}])")
#: The same rule for Arrow, and chunks that are nothing but pieces: in these, line ends stand single inside.
ARROW_PIECES = rf" ?[{LETTER}]+| ?[{DIGIT}]+| ?[{MARK}]+|\n"
ARROW_WHOLE = rf"\A ?[{LETTER}{DIGIT}{MARK}]+(?:\n[{LETTER}{DIGIT}{MARK}]+)*\z"
#: Texts whose blanks need CUT, for Arrow.
ARROW_ODD = "\\A |[" + "".join(w[0] for w in ODD_BLANKS) + "] "
#: A letter whose byte, FF, is in no UTF-8 text and here in no other token: LOT pieces with it between them are merged as one word.
#: Their ids are told apart by four such bytes, which no ids below 2 ** 24 hold.
BETWEEN, LOT = "ÿ", 24


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Remembered(dict):
    """Ids of chunks, looked for when first asked for. Those not asked for in a generation are forgotten, so memory stays bounded."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find, self.old = find, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.find(chunk)
        self[chunk] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def plain_model(file: str):
    """The merges alone of a tokenizer file, if it has byte-level rules and nothing else that changes ids; else None."""
    from tokenizers import models

    with open(file, encoding="utf-8") as f:
        rules = json.load(f)
    model, cutter = dict(rules["model"]), rules["pre_tokenizer"] or {}
    byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
    limits = [rules.get(k) for k in ("normalizer", "truncation", "padding", "post_processor")]
    if not byte_level or any(limits) or model.pop("type", None) != "BPE" or model.get("dropout"):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.pop("merges")]
    # Each piece is asked for once, so the model's own cache would only cost time.
    return models.BPE(model.pop("vocab"), merges, cache_capacity=0, **{k: v for k, v in model.items() if v is not None})


class ChunkEncoder:
    """Little-endian 32-bit ids of texts.

    A chunk that wasn't met lately is cut into pieces, which are remembered like chunks; only pieces that weren't met either are merged.
    Chunks with other characters, or with an added token's text, go through the whole tokenizer. Of a batch of texts, each distinct
    piece is looked up once, and all new pieces are merged together.
    """

    def __init__(self, file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model, self.letters = plain_model(file), byte_letters()
        self.added_texts = added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        if any(len(PIECES.findall(t)) < 2 for t in added):
            self.model = None
        self.joint, self.between = self.merger(), self.tokenizer.token_to_id(BETWEEN)
        self.known = Remembered(self.find)

    def merger(self):
        """A tokenizer that merges pieces with BETWEEN between them; None where that can't be."""
        from tokenizers import Tokenizer

        vocab = self.tokenizer.get_vocab()
        return Tokenizer(self.model) if self.model and len(vocab) < 1 << 24 and [t for t in vocab if BETWEEN in t] == [BETWEEN] else None

    def chunks(self, text: str) -> list[str]:
        if text.startswith(" ") or "\0" in text or any(w in text for w in ODD_BLANKS):
            return CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def find(self, chunk: str) -> bytes:
        pieces = PIECES.findall(chunk)
        # What no piece holds is missing from the join; an added token's text is more than one piece.
        if self.model is None or "".join(pieces) != chunk or (len(pieces) > 1 and self.added.search(chunk)) or not chunk:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        elif len(pieces) > 1:
            return b"".join(map(self.known.__getitem__, pieces))
        else:
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def counts(self, chunks: list[str]) -> list[int]:
        """Ids in each chunk."""
        self.known.age()
        return [len(x) // 4 for x in map(self.known.__getitem__, chunks)]

    def encode(self, text: str) -> bytes:
        self.known.age()
        return b"".join(map(self.known.__getitem__, self.chunks(text)))

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        shown = np.array([ord(self.letters[b]) for b in range(256)], "<u4")
        raw = [b"\xff".join(map(str.encode, pieces[k : k + LOT])) for k in range(0, len(pieces), LOT)]
        letters = shown[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        ends = np.cumsum(list(map(len, raw))).tolist()
        lots = [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = np.array([x for lot in self.joint.encode_batch_fast(lots, add_special_tokens=False) for x in (*lot.ids, self.between)], "<u4")
        ids[ids == self.between] = 0xFFFFFFFF
        return ids[:-1].tobytes().split(b"\xff" * 4)

    def all_known(self, pieces: list[str], apart: set[str]) -> list[bytes]:
        """The ids of distinct pieces, the new ones merged together, and of the chunks apart, which the whole tokenizer must have."""
        self.known.age()
        known, old = self.known, self.known.old
        ids = list(map(known.get, pieces))
        missing = [k for k, x in enumerate(ids) if x is None]
        new = [p for p in map(pieces.__getitem__, missing) if p not in old and p not in apart]
        if new:
            known.update(zip(new, self.merged(new), strict=True))
        for k in missing:
            ids[k] = known[pieces[k]]
        return ids

    def pieces_of(self, chunks: pa.Array) -> tuple[pa.Array, set[str]]:
        """Lists of the pieces of each chunk, and the chunks that stay whole."""
        if self.joint is None:
            return pc.split_pattern(chunks, "\0"), set(listed(chunks))
        whole = pc.match_substring_regex(chunks, ARROW_WHOLE)
        for t in self.added_texts:
            whole = pc.and_not(whole, pc.match_substring(chunks, t))
        cut = pc.replace_substring_regex(chunks, ARROW_PIECES, "\\0\0")
        return pc.split_pattern(pc.if_else(whole, cut, chunks), "\0"), set(listed(chunks.filter(pc.invert(whole))))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, none for nulls. Arrow cuts the texts, finds the distinct chunks and their distinct pieces, and puts ids in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        alone = pc.match_substring(texts, "\0")
        rows = pc.if_else(alone, "", texts)
        marked, odd = pc.replace_substring(rows, " ", "\0 "), pc.match_substring_regex(rows, ARROW_ODD)
        if pc.any(odd).as_py():
            cut = ["\0".join(CUT.split(t)) for t in rows.filter(odd).to_pylist()]
            marked = pc.replace_with_mask(marked, odd, pa.array(cut, marked.type))
        chunks = pc.split_pattern(marked, "\0")
        coded = chunks.values.dictionary_encode()
        pieces, apart = self.pieces_of(coded.dictionary)
        own = pieces.values.dictionary_encode()
        ids = pa.array(self.all_known(listed(own.dictionary), apart), pa.large_binary()).take(own.indices)
        ids = joined(joined(ids, pieces.offsets).take(coded.indices), chunks.offsets).to_pylist()
        for k in np.flatnonzero(alone.to_numpy(zero_copy_only=False)):
            ids[k] = self.encode(texts[int(k)].as_py())
        return ids


def listed(values: pa.Array) -> list[str]:
    """Strings without NUL as a list, faster than by to_pylist."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(values)], values), pa.scalar("\0", values.type))[0].as_py().split("\0") if len(values) else []


def joined(values: pa.Array, cuts: pa.Array) -> pa.Array:
    """Byte strings of the runs of values between cuts, which share the values' bytes."""
    offsets = np.frombuffer(values.buffers()[1], "<i8")[values.offset :][cuts.to_numpy()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), values.buffers()[2]])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(file: str) -> ChunkEncoder:
    """The worker's encoder of a file; workers are reused, so what it has learnt serves later tasks."""
    if file not in _encoders:
        _encoders[file] = ChunkEncoder(file)
    return _encoders[file]
