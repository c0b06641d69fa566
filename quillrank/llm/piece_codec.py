"""Sentence-piece encoding and decoding with the tokenizers library as the engine.

The model file is read field by field; normaliser, space marker, scores or merges, and byte fallback are rebuilt from
it. Batches are encoded on several threads, and the result of each whole text is compared with that of the original
library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import id_and_text, text_groups

MARKER = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, PAIRS = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; nested messages and strings come as bytes, floats as 4 bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a piece model")
        size = {1: 8, 5: 4}.get(kind) or (0 if kind in (1, 5) else number())
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    fold_spaces: bool = True
    mark_spaces: bool = True
    suffix_marker: bool = False


def read_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix_marker = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_prefix = bool(v)
                elif n == 4:
                    model.fold_spaces = bool(v)
                elif n == 5:
                    model.mark_spaces = bool(v)
    if model.kind not in (UNIGRAM, PAIRS) or model.suffix_marker or not model.pieces:
        raise ValueError("only unigram and pair models with a leading space marker can be rebuilt")
    return model


def _merges(model: PieceModel, ids: dict[str, int]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best score first."""
    usable = {p for p, _, k in model.pieces if k in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in usable and b in usable:
                    found.append((-score, ids[piece], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def separable(model: PieceModel) -> bool:
    """No piece runs from a word into the next marker: each word with its markers can be encoded by itself."""
    inside = any(MARKER in p.lstrip(MARKER) for p, _, k in model.pieces if k in (NORMAL, USER, UNUSED))
    return model.mark_spaces and model.add_prefix and not inside and not any(k == USER for *_, k in model.pieces)


def rebuild(model: PieceModel):
    """The tokenizer that gives the model's ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {}
    for i, (piece, _, _) in enumerate(model.pieces):
        ids.setdefault(piece, i)
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        lowest = min((s for _, s, k in model.pieces if k in (NORMAL, USER)), default=0.0)
        # Only ordinary pieces may match text: the others get a score that no path takes.
        scores = [(p, s if k in (NORMAL, USER, UNKNOWN) else lowest - 1e6) for p, s, k in model.pieces]
        engine = models.Unigram(scores, unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        unk = model.pieces[unknown][0] if unknown is not None else None
        engine = models.BPE(ids, _merges(model, ids), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(engine)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.fold_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARKER if model.mark_spaces else " "
    if model.add_prefix:
        steps.append(normalizers.Prepend(space))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if separable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
    user = [AddedToken(p, normalized=True, special=False) for p, _, k in model.pieces if k == USER]
    if user:
        tokenizer.add_tokens(user)
    back = [decoders.Replace(MARKER, " ")] if model.mark_spaces else []
    back += [decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.add_prefix else [])
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class Codec:
    """Encodes and decodes batches, and holds the rebuilt tokenizer against the original library.

    Every text is encoded whole by both, and the ids are decoded and compared with it. Nothing is kept from one text
    to the next. Of a pair model with separable words, merges never run over a word, so a normalised text needs no
    cutting before they are applied.
    """

    def __init__(self, data: bytes, threads: int):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = read_model(data)
        self.fast = rebuild(self.model)
        self.threads = threads
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.controls = {i for i in range(len(self.original)) if self.original.is_control(i)}
        self.engine = Tokenizer(self.fast.model) if self.model.kind == PAIRS and separable(self.model) else None
        self.plain = not self.model.charsmap and not self.model.fold_spaces
        self.cut = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
        # What each id decodes to.
        space = lambda p: p.replace(MARKER, " ") if self.model.mark_spaces else p
        shown = [bytes([int(p[3:5], 16)]) if k == BYTE else space(p).encode() for p, _, k in self.model.pieces]
        self.shown = [b"" if i in self.controls else x for i, x in enumerate(shown)]

    def _normal(self, text: str) -> str:
        if self.plain:
            return MARKER + text.replace(" ", MARKER) if text else ""
        return self.fast.normalizer.normalize_str(text)

    def _words(self, normal: str) -> list[str]:
        """The words of a normalised text, each with its markers."""
        first, *rest = normal.split(MARKER)
        if not rest or "" in rest:
            return self.cut.findall(normal)
        words = [MARKER + w for w in rest]
        return [first, *words] if first else words

    def _rebuilt(self, texts: list[str]) -> list[list[int]]:
        """The rebuilt tokenizer's ids of each text."""
        engine, given = (self.fast, texts) if self.engine is None else (self.engine, [self._normal(t) for t in texts])
        return [e.ids for e in engine.encode_batch_fast(given, add_special_tokens=False)]

    def encode_whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        mine = self._rebuilt(texts)
        theirs = self.original.encode(texts, num_threads=self.threads)
        shown = self.decode(theirs)
        return theirs, [a == b for a, b in zip(mine, theirs)], [a == b for a, b in zip(shown, texts)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """(ids, same as the original, decoding gives the text back) of each text."""
        return self.encode_whole(texts)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The text of each list; bytes that are no text are shown by the rebuilt tokenizer."""
        texts = []
        for row in ids:
            try:
                text = b"".join(map(self.shown.__getitem__, row)).decode()
            except UnicodeDecodeError:
                texts.append(self.fast.decode([i for i in row if i not in self.controls]))
            else:
                texts.append(text[1:] if self.model.add_prefix and text.startswith(" ") else text)
        return texts


_codecs: dict[tuple[bytes, int], Codec] = {}


def codec_of(data: bytes, threads: int) -> Codec:
    """The worker's codec of a model, built once for all tasks of a process."""
    if (data, threads) not in _codecs:
        _codecs.clear()
        _codecs[data, threads] = Codec(data, threads)
    return _codecs[data, threads]


def encode(
    docs: DataFrame, model_path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids, parity, round_trip) of every row.

    `ids` are the piece ids of the whole text, without begin or end. `parity` says that the rebuilt tokenizer gave
    the same ids as the original library; where it does not, `ids` are the original's. `round_trip` says that
    decoding gives the text back, up to the model's normalisation (a text that holds the marker itself does not
    come back). Null and empty texts have no ids. Repeated rows and null ids are encoded like any others; an empty
    table gives an empty one; only the two named columns are read. The model file is read on the driver and goes
    with the function; its size does not depend on the data. `threads`: threads per task.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    read_model(data)
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data, threads)
        for keys, texts in text_groups(batches):
            ids, parity, back = codec.encode(texts)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, count=int(ends[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), lists, pa.array(parity), pa.array(back)], names=["id", "ids", "parity", "round_trip"]
            )

    out = rows.mapInArrow(run, f"id {id_type}, ids array<int>, parity boolean, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "ids", "parity", "round_trip")


def decode(rows: DataFrame, model_path: str, threads: int = 2, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from piece ids. A null list gives a null text, an empty list an empty one; an id that the model
    does not have is an error."""
    with open(model_path, "rb") as f:
        data = f.read()
    known = len(read_model(data).pieces)
    lists = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    id_type = lists.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data, threads)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            if any(not 0 <= i < known for row in ids for i in row or ()):
                raise ValueError("a piece id is not in the model")
            texts = [t if row is not None else None for t, row in zip(codec.decode([r or [] for r in ids]), ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return lists.mapInArrow(run, f"id {id_type}, text string").select(F.col("id").alias(id_col), "text")
