"""Removes passages that occur more than once, by suffix arrays per shard.

The unit is a window: a string of `span` bytes. A window belongs to its anchor, the place of the smallest hash among its
grams, so equal windows belong to equal anchors, wherever they are. The windows of one anchor and the bytes that they
cover are a context. Anchors whose gram occurs once in the whole corpus need no text: their windows are unique. The
others are put into shards by gram, each different context once with its number of occurrences. Each shard builds its
suffix array (Larsson-Sadakane) and common prefixes (Kasai), and windows that share `span` bytes are one class. A gram
with too many contexts for one shard is cut into several; their sorted window fingerprints are merged by binary search.

Contexts with the same gram are held equal by a 64-bit hash; so are windows of a gram that is cut into several shards.
Within a shard, bytes are compared. With a million contexts of one gram, the chance of an error is below one in ten million.

Defined results: a null text is empty; texts shorter than `span` keep all bytes; every row is a document of its own, so
equal rows repeat one another; null and repeated ids are carried through; other columns are left out, whatever they are
called; an empty table gives an empty result. Texts of any length are read in blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.session import settled

SPAN = 200
BLOCK = 1 << 18
SHARD_BYTES = 4 << 20
PART_CONTEXTS = 8192
RUN_WINDOWS = 1 << 19

_SYMBOLS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WORD = 7
LANE = 512

OCCURRENCES = "key long, hash long, a long, b long, extra int, copies int, starts array<int>"
SHARD_OUT = "kind int, key long, hash long, part int, bucket int, lo array<int>, hi array<int>, at binary, prints binary"


def gram_of(span: int) -> int:
    """Bytes of a gram: long enough to be rare by chance, short enough to leave anchors far apart."""
    return max(2, min(48, span // 4))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` bytes, from hashes of powers of two."""
    power, size, part, done, held = _BASE, 1, _SYMBOLS[data], 0, None
    while True:
        if width & size:
            if held is None:
                held = part
            else:
                n = len(data) - done - size + 1
                held = held[:n] * np.uint64(power) + part[done : done + n]
            done += size
        if done == width:
            break
        n = len(data) - 2 * size + 1
        part = part[:n] * np.uint64(power) + part[size : size + n]
        power, size = power * power & _MASK, 2 * size
    held = (held ^ (held >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return held ^ (held >> np.uint64(32))


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For every `width` values, the place of the first smallest one."""
    best, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        n = len(best) - step
        later = best[step:] < best[:n]
        at = np.where(later, at[step:], at[:n])
        best = np.minimum(best[step:], best[:n])
        size += step
    return at


def anchor_runs(data: np.ndarray, closed: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram hash) of each anchor; `closed` marks windows that reach over the end of a text."""
    gram = gram_of(span)
    grams = rolling(data, gram)
    at = leftmost_smallest(grams, span - gram + 1)
    at[closed[: len(at)]] = -1
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(at)]]) - 1
    open_ = at[first] >= 0
    first, last = first[open_], last[open_]
    return first, last, grams[at[first]]


def _pieces(batches: Iterable[pa.RecordBatch], span: int, block: int = BLOCK) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Groups of (a, b, copies, offset, bytes) of about a block; longer texts are cut, cuts overlap by a window less one byte."""
    for batch in batches:
        marks = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        copies = Counter(marks)
        group, held = [], 0
        for (a, b), text in dict(zip(marks, batch.column(0))).items():
            raw, n = text.as_py().encode(), copies[a, b]
            for offset in range(0, len(raw) - span + 1, block):
                piece = raw[offset : offset + block + span - 1]
                group.append((a, b, n, offset, piece))
                held += len(piece)
                if held >= block:
                    yield group
                    group, held = [], 0
        if group:
            yield group


def _occurrences(span: int, block: int = BLOCK):
    """mapInArrow: the anchors of each text with a hash of their context; equal ones of one text share a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _pieces(batches, span, block):
            raw = b"".join(p[4] for p in group)
            data = np.frombuffer(raw, np.uint8)
            sizes = np.array([len(p[4]) for p in group])
            ends = np.cumsum(sizes)
            closed = np.zeros(len(data), bool)
            for end in ends.tolist():
                closed[end - span + 1 : end] = True
            first, last, keys = anchor_runs(data, closed, span)
            hashes = np.fromiter(
                (xxhash.xxh3_64_intdigest(raw[i : j + span]) for i, j in zip(first.tolist(), last.tolist())),
                np.uint64,
                len(first),
            )
            piece = np.searchsorted(ends, first, side="right")
            order = np.lexsort((first, hashes, keys, piece))
            piece, keys, hashes, first, last = (x[order] for x in (piece, keys, hashes, first, last))
            new = np.ones(len(order), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])
            heads = np.flatnonzero(new)
            column = lambda i: np.array([p[i] for p in group], dtype=np.int64)
            starts = first - (ends - sizes)[piece] + column(3)[piece]
            of = piece[heads]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[heads].view(np.int64)),
                    pa.array(hashes[heads].view(np.int64)),
                    pa.array(column(0)[of]),
                    pa.array(column(1)[of]),
                    pa.array((last - first)[heads].astype(np.int32)),
                    pa.array(column(2)[of].astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array(starts.astype(np.int32))
                    ),
                ],
                ["key", "hash", "a", "b", "extra", "copies", "starts"],
            )

    return run


def words(data: np.ndarray) -> np.ndarray:
    """The next seven symbols of every suffix in one number; the end of the text counts as a symbol below all others."""
    one = np.zeros(len(data) + 8, np.int64)
    one[: len(data)] = data.astype(np.int64) + 1
    two = (one[:-1] << 9) | one[1:]
    four = (two[:-2] << 18) | two[2:]
    return ((four[:-4] << 27) | (two[4 : 4 + len(four) - 4] << 9) | one[6 : 6 + len(four) - 4])[: len(data)]


def suffix_array(data: np.ndarray, head: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    A suffix's rank is the first place of its group. In each round the suffixes of groups that are not single yet are
    ordered by their rank and the rank of what follows after the length that is sorted already, which doubles.
    """
    n = len(data)
    head = words(data) if head is None else head
    order = np.argsort(head)
    ordered = head[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    size = _WORD
    alone = new.copy()
    alone[:-1] &= new[1:]
    slots = slots[~alone]
    while len(slots):
        member = order[slots]
        key = rank[member] * (n + 1) + rank[np.minimum(member + size, n)] + 1
        turn = np.argsort(key)
        member, key = member[turn], key[turn]
        order[slots] = member
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[member] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        size *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, head: np.ndarray | None = None) -> np.ndarray:
    """For each place of the suffix array the length, up to `depth`, that it shares with the place before, by Kasai's rule.

    In text order the shared length falls by one byte at most from a suffix to the next. Lanes of the text go forward
    side by side, each keeping its length; what is shared beyond it is found a word at a time.
    """
    n = len(data)
    head = words(data) if head is None else head
    head = np.append(head, np.zeros(depth + _WORD, np.int64))
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, LANE)
    length = np.zeros(len(lanes), np.int64)
    for step in range(min(LANE, n)):
        place = lanes + step
        place = place[place < n]
        length = np.maximum(length[: len(place)] - 1, 0)
        other = before[place]
        length[other < 0] = 0
        going = np.flatnonzero((other >= 0) & (length < depth))
        while len(going):
            far = length[going]
            differ = head[place[going] + far] ^ head[other[going] + far]
            same = differ == 0
            gain = np.where(same, _WORD, 0)
            for bits in range(9, 9 * _WORD, 9):
                gain += ~same & (differ < (1 << bits))
            length[going] = np.minimum(far + gain, depth)
            going = going[same & (far + gain < depth)]
        shared[place] = length
    out = shared[order]
    out[:1] = 0
    return out


def window_classes(data: np.ndarray, span: int) -> np.ndarray:
    """A number per suffix, the same for suffixes that share their first `span` bytes."""
    head = words(data)
    order = suffix_array(data, head)
    shared = common_prefixes(data, order, span, head)
    classes = np.empty(len(data), np.int64)
    classes[order] = np.cumsum(shared < span)
    return classes


def _runs(marked: np.ndarray, offsets: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """First and last marked places of each context, counted from its start."""
    edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    own = np.searchsorted(offsets, lo, side="right") - 1
    lo, hi = lo - offsets[own], hi - offsets[own]
    cuts = np.searchsorted(own, np.arange(len(offsets) + 1))
    return [lo[i:j] for i, j in zip(cuts[:-1], cuts[1:])], [hi[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def _shard(span: int):
    """applyInArrow: the repeated windows of a shard's contexts; for a gram in several shards also sorted fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        raw = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw])
        offsets = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(raw)), sizes)
        inside = np.arange(len(data)) - offsets[owner] <= (sizes - span)[owner]
        classes = window_classes(data, span)
        counts = np.array(table.column("n").to_pylist(), np.int64)
        total = np.bincount(classes[inside], weights=counts[owner[inside]], minlength=int(classes.max()) + 1)
        marked = inside & (total[classes] >= 2)
        lo, hi = _runs(marked, offsets)
        keys, hashes = table.column("key").to_pylist(), table.column("hash").to_pylist()
        part, runs = table.column("part")[0].as_py(), table.column("runs")[0].as_py()
        n = len(raw)
        at, prints = [None] * n, [None] * n
        rows = {"kind": [0] * n, "key": keys, "hash": hashes, "part": [part] * n, "bucket": [0] * n, "lo": lo, "hi": hi}
        if part >= 0:
            print_of = np.zeros(len(data), np.uint64)
            found = rolling(data, span)
            print_of[: len(found)] = found
            still = inside & ~marked
            for i, (start, size) in enumerate(zip(offsets.tolist(), sizes.tolist())):
                places = np.flatnonzero(still[start : start + size])
                at[i] = places.astype(np.int32).tobytes()
                prints[i] = print_of[start + places].tobytes()
            # Of each class one fingerprint, in order, cut into ranges.
            told = np.unique(print_of[inside])
            bucket = (told >> np.uint64(32)) * np.uint64(runs) >> np.uint64(32)
            for k in np.unique(bucket).tolist():
                here = told[bucket == k]
                for name, value in (("kind", 1), ("key", keys[0]), ("hash", 0), ("part", part), ("bucket", k), ("lo", []), ("hi", [])):
                    rows[name].append(value)
                at.append(None)
                prints.append(here.tobytes())
        types = {"kind": pa.int32(), "key": pa.int64(), "hash": pa.int64(), "part": pa.int32(), "bucket": pa.int32()}
        types |= {"lo": pa.list_(pa.int32()), "hi": pa.list_(pa.int32())}
        columns = {k: pa.array(v, types[k]) for k, v in rows.items()}
        return pa.table(columns | {"at": pa.array(at, pa.binary()), "prints": pa.array(prints, pa.binary())})

    return run


def merge_sorted(table: pa.Table) -> pa.Table:
    """applyInArrow: of one range of fingerprints, those of each part that another part has too."""
    runs = [np.frombuffer(x, np.uint64) for x in table.column("prints").to_pylist()]
    merged = np.sort(np.concatenate(runs))
    kept = []
    for run in runs:
        n = np.searchsorted(merged, run, side="right") - np.searchsorted(merged, run, side="left")
        kept.append(run[n >= 2].tobytes())
    return pa.table(
        {"key": table.column("key"), "part": table.column("part"), "prints": pa.array(kept, pa.binary())}
    )


def _found_elsewhere(contexts: pa.Table, matches: pa.Table) -> pa.Table:
    """cogrouped applyInArrow: the windows of a part that the merge has found in another one."""
    keys, hashes, lows, highs = [], [], [], []
    found = [np.frombuffer(x, np.uint64) for x in matches.column("prints").to_pylist()]
    found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    columns = [contexts.column(c).to_pylist() for c in ("key", "hash", "at", "prints")]
    for key, value, at, prints in zip(*columns):
        at, prints = np.frombuffer(at, np.int32), np.frombuffer(prints, np.uint64)
        place = np.searchsorted(found, prints)
        hit = np.zeros(len(at), bool)
        there = place < len(found)
        hit[there] = found[place[there]] == prints[there]
        places = at[hit]
        if len(places):
            cut = np.flatnonzero(np.diff(places) != 1)
            keys.append(key)
            hashes.append(value)
            lows.append(places[np.concatenate([[0], cut + 1])])
            highs.append(places[np.concatenate([cut, [len(places) - 1]])])
    ints = pa.list_(pa.int32())
    return pa.table(
        {"key": pa.array(keys, pa.int64()), "hash": pa.array(hashes, pa.int64()), "lo": pa.array(lows, ints), "hi": pa.array(highs, ints)}
    )


def _cut_contexts(span: int):
    """mapInArrow: (text, wanted contexts) to one row per context with its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                wanted = wanted.as_py()
                cut = [raw[w["start"] : w["start"] + w["extra"] + span] for w in wanted]
                names = ("key", "hash", "n", "home", "part", "runs")
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array([w[c] for w in wanted], t) for c, t in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], [*names, "bytes"])

    return run


def _remove(span: int):
    """mapInArrow: (id, text, repeated windows) to bytes, removed bytes, removed runs and what is left."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                runs: list[list[int]] = []
                for lo, hi in sorted(
                    (start + lo, start + hi + span)
                    for x in found.as_py() or []
                    for start in x["starts"]
                    for lo, hi in zip(x["lo"], x["hi"])
                ):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept[-1]))
                spans.append([{"start": lo, "end": hi} for lo, hi in runs])
            pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            counts = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64())]
            columns = [batch.column(0), *counts, pa.array(spans, pair), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def repeated_contexts(
    docs: DataFrame, span: int, shard_bytes: int, part_contexts: int, run_windows: int, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Occurrences of anchors whose gram repeats, and the repeated windows of those with more than one context.

    `docs` has text, a and b. A gram with `part_contexts` contexts or fewer is whole in one shard.
    """
    read = docs.where(F.octet_length("text") >= span).select("text", "a", "b")
    occurrences = settled(read.mapInArrow(_occurrences(span, block), OCCURRENCES), "anchors")
    number = F.col("copies") * F.size("starts").cast("long")
    grams = occurrences.groupBy("key").agg(F.sum(number).alias("seen"), (F.min("hash") != F.max("hash")).alias("many"))
    repeated = settled(occurrences.join(grams.where("seen > 1").drop("seen"), "key"), "repeated")
    at = F.struct("a", "b", F.col("starts")[0].alias("start"), "extra")
    contexts = repeated.where("many").groupBy("key", "hash").agg(F.sum(number).alias("n"), F.min(at).alias("at"))
    contexts = settled(contexts, "contexts")
    size = contexts.agg(F.sum(F.col("at.extra") + F.lit(span))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    wide = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("at.extra") + 1).alias("windows"))
    wide = wide.where(F.col("m") > part_contexts).select(
        "key",
        F.ceil(F.col("m") / F.lit(part_contexts)).alias("parts"),
        F.ceil(F.col("windows") / F.lit(run_windows)).cast("int").alias("runs"),
    )
    placed = contexts.join(wide, "key", "left").select(
        F.col("at.a").alias("a"),
        F.col("at.b").alias("b"),
        F.struct(
            "key",
            "hash",
            "n",
            F.col("at.start").alias("start"),
            F.col("at.extra").alias("extra"),
            F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("key")).alias("home"),
            F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod("hash", "parts")).cast("int").alias("part"),
            F.coalesce("runs", F.lit(0)).alias("runs"),
        ).alias("w"),
    )
    wanted = placed.groupBy("a", "b").agg(F.collect_list("w").alias("wanted"))
    once = docs.where(F.octet_length("text") >= span).groupBy("a", "b").agg(F.first("text").alias("text"))
    cut = once.join(wanted.hint("shuffle_hash"), ["a", "b"]).select("text", "wanted")
    schema = "key long, hash long, n long, home long, part int, runs int, bytes binary"
    shard = cut.mapInArrow(_cut_contexts(span), schema).groupBy("home", "part").applyInArrow(_shard(span), SHARD_OUT)
    shard = settled(shard, "shards")
    runs = shard.where("kind = 1").select("key", "bucket", "part", "prints")
    merged = runs.groupBy("key", "bucket").applyInArrow(merge_sorted, "key long, part int, prints binary")
    open_ = shard.where("kind = 0 and part >= 0").select("key", "part", "hash", "at", "prints")
    across = open_.groupBy("key", "part").cogroup(merged.groupBy("key", "part"))
    across = across.applyInArrow(_found_elsewhere, "key long, hash long, lo array<int>, hi array<int>")
    windows = shard.where("kind = 0 and size(lo) > 0").select("key", "hash", "lo", "hi").union(across)
    return repeated, windows


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    shard_bytes: int = SHARD_BYTES,
    part_contexts: int = PART_CONTEXTS,
    run_windows: int = RUN_WINDOWS,
    block: int = BLOCK,
) -> DataFrame:
    """Per document: id, n_bytes, n_removed, spans (removed runs of bytes) and kept (the bytes that are left).

    A byte goes if a string of `span` bytes over it also starts at another place of any document, its own included.
    """
    if span < 8:
        raise ValueError("span has to be 8 bytes at least")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    repeated, windows = repeated_contexts(rows, span, shard_bytes, part_contexts, run_windows, block)
    whole = repeated.where("not many").select(
        "a", "b", "starts", F.array(F.lit(0)).alias("lo"), F.array("extra").alias("hi")
    )
    decided = repeated.where("many").join(windows, ["key", "hash"]).select("a", "b", "starts", "lo", "hi")
    # One entry for each context of a text, however many copies the text has.
    found = whole.union(decided).groupBy("a", "b").agg(F.collect_set(F.struct("starts", "lo", "hi")).alias("found"))
    left = rows.join(found, ["a", "b"], "left").select("id", "text", "found")
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    schema = f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return left.mapInArrow(_remove(span), schema)
