"""Token counts of byte-level pair encoding by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie one after another in one array of symbol ids. In each step every sequence applies its
own lowest-rank pair, at all its places at once, and the symbols that are left when no pair has a rank are counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import id_and_text, text_groups

# Fixed values of byte-level vocabularies: the printable bytes that stand for themselves, and the pre-token pattern.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int64).max
FLUSH_PIECES = 200_000
KNOWN_PIECES = 500_000


@dataclass(frozen=True)
class PairTable:
    """A vocabulary's pairs, sorted by key, with their rank and product. Its size is that of the vocabulary."""

    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    byte_ids: np.ndarray
    base: int
    late: str
    specials: tuple[str, ...]


def _byte_symbols() -> list[str]:
    spare = iter(range(256, 512))
    own = set(PRINTABLE)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _late_letters() -> str:
    """Letters and numbers that `regex` knows and the tokenizer library, whose tables can be older, does not."""
    import regex
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    points = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    late = ""
    for kind, mate in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        own = regex.findall(kind, points)
        whole = {span for _, span in cut.pre_tokenize_str("".join(f" {mate}{c}" for c in own))}
        late += "".join(c for i, c in enumerate(own) if (3 * i, 3 * i + 3) not in whole)
    return late


def read_pairs(path: str) -> PairTable:
    """Reads a tokenizer file on the driver. Raises ValueError for kinds other than plain byte-level pair encoding."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut = file["model"], file["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type", "BPE") != "BPE" or file["normalizer"] or not plain or any(model.get(k) for k in odd):
        raise ValueError(f"{path} is not a plain byte-level pair encoding")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
        raise ValueError("added tokens that take in white space are not supported")
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    base = max(vocabulary.values()) + 1
    left = np.array([vocabulary[a] for a, _ in merges], dtype=np.int64)
    right = np.array([vocabulary[b] for _, b in merges], dtype=np.int64)
    made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
    rank_of = np.full(base, -1, dtype=np.int64)
    rank_of[made[::-1]] = np.arange(len(made))[::-1]
    if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
        raise ValueError("a pair ranks before one of its parts; pairs can't be merged all at once")
    keys = left * base + right
    order = np.argsort(keys, kind="stable")
    byte_ids = np.array([vocabulary[s] for s in _byte_symbols()], dtype=np.int64)
    specials = tuple(sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True))
    return PairTable(keys[order], order.astype(np.int64), made[order], byte_ids, base, _late_letters(), specials)


def merged_lengths(pieces: list[bytes], table: PairTable) -> np.ndarray:
    """The number of symbols that each piece ends with."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    left = sizes.copy()
    symbols = table.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    while len(symbols) > 1:
        keys = symbols[:-1] * table.base + symbols[1:]
        at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
        known = (table.keys[at] == keys) & (owner[:-1] == owner[1:])
        ranks = np.append(np.where(known, table.ranks[at], NO_RANK), NO_RANK)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lengths = np.diff(np.append(starts, len(symbols)))
        lowest = np.minimum.reduceat(ranks, starts)
        left[owner[starts]] = lengths
        if (lowest == NO_RANK).all():
            break
        wanted = np.repeat(lowest, lengths)
        place = np.flatnonzero((ranks == wanted) & (wanted < NO_RANK))
        # A pair of equal symbols can overlap itself: of each run of places, the first, third, fifth ... count.
        new_run = np.append(True, np.diff(place) != 1)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - run_start) % 2 == 0]
        symbols[place] = table.products[at[place]]
        stays = wanted < NO_RANK
        stays[place + 1] = False
        symbols, owner = symbols[stays], owner[stays]
        left[np.unique(owner)] = np.bincount(owner, minlength=len(pieces))[np.unique(owner)] if len(owner) else 0
    return left


class Counter:
    """Counts the tokens of texts; piece lengths that are known are kept up to a bound and then counted anew."""

    def __init__(self, table: PairTable):
        import regex

        self.table = table
        self.cut = regex.compile(PRE_TOKENS)
        self.late = frozenset(table.late)
        self.as_signs = dict.fromkeys(map(ord, table.late), "!")
        self.special = regex.compile("|".join(map(regex.escape, table.specials))) if table.specials else None
        self.known: dict[str, int] = {}

    def _cut(self, text: str) -> Iterator[str]:
        """Pre-tokens. Letters that the library does not know stand as signs while the text is cut."""
        if text.isascii() or self.late.isdisjoint(text):
            return (m.group() for m in self.cut.finditer(text))
        return (text[slice(*m.span())] for m in self.cut.finditer(text.translate(self.as_signs)))

    def learn(self, pieces: set[str]) -> None:
        listed = sorted(pieces)
        self.known.update(zip(listed, merged_lengths([p.encode() for p in listed], self.table).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """The pieces of many texts are merged in one batch; one very long text is cut into several batches."""
        totals = [0] * len(texts)
        held: list[list[str]] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            fresh = {w for pieces in held for w in pieces if w not in self.known}
            if len(self.known) > KNOWN_PIECES:
                self.known.clear()
                fresh = {w for pieces in held for w in pieces}
            if fresh:
                self.learn(fresh)
            for i, pieces in zip(owners, held):
                totals[i] += sum(map(self.known.__getitem__, pieces))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            totals[i] += len(parts) - 1
            for part in parts:
                pieces = self._cut(part)
                while some := list(islice(pieces, FLUSH_PIECES)):
                    held.append(some)
                    owners.append(i)
                    size += len(some)
                    if size >= FLUSH_PIECES:
                        flush()
                        size = 0
        flush()
        return totals


_counters: dict[tuple[str, int, int], Counter] = {}


def counter_of(table: PairTable, path: str) -> Counter:
    """The worker's counter of a vocabulary: later tasks in the same process find the pieces of earlier ones."""
    key = (path, table.base, hash(table.keys.tobytes()))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(table)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row.

    Null and empty texts have 0 bytes and 0 tokens. Each row is counted by itself, so repeated rows and null ids
    come out as often as they went in; an empty table gives an empty one. Added tokens inside a text count as one
    token each. Only the two named columns are read, so other columns can have any name. The vocabulary goes to
    the tasks with the function: it does not grow with the data.
    """
    table = read_pairs(tokenizer_path)
    rows = id_and_text(docs, id_col, text_col).select("id", "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, kind = counter_of(table, tokenizer_path), None
        for ids, texts in text_groups(batches):
            kind = kind or (pa.int64() if id_type == "bigint" else None)
            sizes = [len(t.encode()) for t in texts]
            columns = [pa.array(ids, type=kind), pa.array(sizes, pa.int64()), pa.array(counter.counts(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
