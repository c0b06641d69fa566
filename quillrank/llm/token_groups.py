"""Join of documents by n-gram Jaccard similarity with a matrix of tokens and groups.

Similar documents are put into groups, and of each group the union of its tokens is stored. For a document, the number
of its tokens in a group's union bounds its overlap with every member; only groups whose bound reaches what the
threshold needs are opened, and their members compared token by token.

The matrix holds only what can decide. Tokens are ordered, frequent ones last, the same everywhere; of a set of n, whose
links need an overlap of at least o = ceil(0.8 n), the first n - o + l tokens hold at least l of the tokens shared with
any partner, where l = 1 + n // 8. So the bound is counted on these prefixes, and reaching l is what qualifies.

Equal sets are one class, named by a 64-bit hash of the set. No step makes pairs within a group of similar documents: tokens that occur in one group only
leave the matrix before it is joined, unless the group is one of documents that are similar but not linked yet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import components, id_and_text, text_groups
from quillrank.llm.shingles import SIZE, fingerprint, shingle_sets
from quillrank.session import settled

#: Similarity is a ratio of whole numbers, so that no link hangs on rounding.
NUMERATOR, DENOMINATOR = 80, 100
#: Counters that find frequent tokens. They set the order of tokens only: any order gives the same links.
SKETCH_BITS = 22
OFTEN = 8
PART_TOKENS = 2_000_000
GROUP_BLOCK, QUERY_BLOCK = 64, 256


def needed(n, numerator: int, denominator: int):
    """Least overlap of a set of n with any partner."""
    return -(-n * numerator // denominator)


def depth(n):
    """How many shared tokens the prefix of a set of n is sure to hold."""
    return 1 + n // 8


def _facts(rows: DataFrame, id_type: str, size: int) -> DataFrame:
    """First pass: (kind 0: id, set size, class) per document, (kind 1: sketch place, count) for frequent tokens.

    A token counts as frequent where one task meets at least OFTEN different sets with it, and more than its share.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        out = lambda kind, ids, a, b: pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(a), pa.int8()), ids, pa.array(a, pa.int64()), pa.array(b, pa.int64())],
            names=["kind", "id", "a", "b"],
        )
        id_kind = None
        for ids, texts in text_groups(batches):
            sizes, names, fresh = [], [], []
            for tokens in shingle_sets(texts, size):
                name = fingerprint(tokens)
                sizes.append(len(tokens))
                names.append(name)
                if name not in seen:
                    seen.add(name)
                    fresh.append(tokens)
            if fresh:
                places = (np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                counts += np.bincount(places, minlength=len(counts))
            column = pa.array(ids)
            id_kind = column.type if not pa.types.is_null(column.type) else id_kind
            yield out(0, column, sizes, names)
        often = np.flatnonzero(counts >= max(OFTEN, 4 * counts.mean()))
        if len(often):
            yield out(1, pa.nulls(len(often), id_kind), often, counts[often])

    return rows.mapInArrow(run, f"kind byte, id {id_type}, a long, b long")


def _prefix_tokens(
    rows: DataFrame, classes: np.ndarray, parts: int, size: int, numerator: int, denominator: int
) -> DataFrame:
    """Second pass: (part, frequent, tokens, names): prefix tokens and the classes they belong to, in packed blocks.

    Tokens of no great frequency are dealt out by token, so one part sees all classes of a token; a class appears in
    each task once. Frequent ones are dealt out by class: nothing has to gather them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, np.ndarray]] = []
        count = 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            names = np.repeat(np.array([h[1] for h in held], np.int64), [len(h[0]) for h in held])
            often = np.concatenate([h[2] for h in held])
            part = np.where(often, names.view(np.uint64), tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)) % np.uint64(parts)
            key = part.astype(np.int64) * 2 + often
            order = np.lexsort((tokens, key))
            key, tokens, names = key[order], tokens[order], names[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(starts[1:], len(key))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(key[starts] // 2, pa.int32()),
                    pa.array(key[starts] % 2 == 1),
                    pa.array([tokens[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([names[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["part", "frequent", "tokens", "names"],
            )

        for _, texts in text_groups(batches):
            for tokens in shingle_sets(texts, size):
                name = fingerprint(tokens)
                if not len(tokens) or name in seen:
                    continue
                seen.add(name)
                rank = classes[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                n = len(tokens)
                length = min(n, n - needed(n, numerator, denominator) + depth(n))
                first = np.argsort(rank, kind="stable")[:length]
                held.append((tokens[first], name, rank[first] > 0))
                count += length
                if count >= PART_TOKENS:
                    yield block()
                    count = 0
        if held:
            yield block()

    return rows.select("id", "text").mapInArrow(run, "part int, frequent boolean, tokens binary, names binary")


def _shared(blocks: DataFrame, parts: int) -> DataFrame:
    """(token, name) of tokens that several classes have; a frequent token is taken to be one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        rows = lambda t, x: pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(x)], names=["token", "name"])
        for batch in batches:
            for often, tokens, names in zip(*[batch.column(i) for i in (1, 2, 3)]):
                pair = (np.frombuffer(tokens.as_buffer(), np.uint64), np.frombuffer(names.as_buffer(), np.int64))
                if often.as_py():
                    yield rows(*pair)
                else:
                    rare.append(tuple(a.copy() for a in pair))
        if not rare:
            return
        tokens, names = (np.concatenate([r[i] for r in rare]) for i in (0, 1))
        rare.clear()
        order = np.lexsort((names, tokens))
        tokens, names = tokens[order], names[order]
        same_token = tokens[1:] == tokens[:-1]
        fresh = np.append(True, ~(same_token & (names[1:] == names[:-1])))
        tokens, names = tokens[fresh], names[fresh]
        same_token = tokens[1:] == tokens[:-1]
        several = np.append(same_token, False) | np.append(False, same_token)
        tokens, names = tokens[several], names[several]
        for at in range(0, len(tokens), 100_000):
            yield rows(tokens[at : at + 100_000], names[at : at + 100_000])

    return blocks.repartition(parts, "part").mapInArrow(run, "token long, name long")


def _open(
    members: DataFrame, queries: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int
) -> DataFrame:
    """Links (a, b) between queries (name, g) and members (name, g) of the same group, found by comparing whole sets.

    Members and queries of a group are cut into blocks, and each block of one meets each of the other: a large group
    is opened by many tasks, none of which holds more than two blocks.
    """
    blocks = lambda rows, n, width: rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias(n))
    counts = blocks(members, "nm", GROUP_BLOCK).join(blocks(queries, "nq", QUERY_BLOCK), "g")
    of = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(counts, "g").withColumn("m", of("nm")).withColumn("q", every("nq"))
    right = queries.join(counts, "g").withColumn("q", of("nq")).withColumn("m", every("nm"))
    pick = lambda rows, asks: rows.select("name", "g", "m", "q", F.lit(asks).alias("asks"))
    wanted = pick(left, False).union(pick(right, True)).join(texts, "name")

    def links_of(members: list[tuple[int, str]], asking: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
        own = checked(members)
        if not own:
            return
        sizes = np.array([len(tokens) for _, tokens in own])
        tokens = np.concatenate([tokens for _, tokens in own])
        owner = np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for name, wanted in checked(asking):
            low, high = np.searchsorted(tokens, wanted, "left"), np.searchsorted(tokens, wanted, "right")
            hits = high - low
            at = np.repeat(low - np.append(0, np.cumsum(hits)[:-1]), hits) + np.arange(hits.sum())
            both = np.bincount(owner[at], minlength=len(own))
            for j in np.flatnonzero(denominator * both >= numerator * (sizes + len(wanted) - both)):
                if own[j][0] != name:
                    yield name, own[j][0]

    def checked(rows: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
        """Sets of the texts that are what their name says: an id can stand for several texts."""
        sets = shingle_sets([t for _, t in rows], size)
        return [(name, tokens) for (name, _), tokens in zip(rows, sets) if fingerprint(tokens) == name]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, ([], []), []
        for batch in batches:
            *keys, asks, names, texts = (batch.column(i) for i in range(6))
            keys = zip(*[k.to_pylist() for k in keys])
            for at, asking, name, text in zip(keys, asks.to_pylist(), names.to_pylist(), texts):
                if at != key:
                    found += links_of(*held)
                    key, held = at, ([], [])
                held[asking].append((name, text.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found = []
        found += links_of(*held)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    key = ["g", "m", "q"]
    dealt = wanted.select(*key, "asks", "name", "text").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _gathered(grouped: DataFrame) -> DataFrame:
    """Puts classes that link with nothing so far into groups of similar ones, which are joined by no link yet.

    The group of a class is named by the one that it shares most tokens with, among those that stand for its tokens, if these
    are half of what a link needs. Any such division gives the same links: it only decides what is opened together.
    """
    single = grouped.where("single")
    top = F.max(F.struct("worth", "name")).alias("top")
    tops = single.groupBy("token").agg(top, F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "top.name")
    met = single.join(tops.withColumnRenamed("name", "hub"), "token").groupBy("name", "hub")
    met = met.agg(F.count(F.lit(1)).alias("c"), F.first("least").alias("least")).where("2 * c >= least")
    hubs = met.groupBy("name").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return grouped.join(hubs, "name", "left").withColumn("g", F.coalesce("hub", "g")).drop("hub")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set, and the smallest id that links lead to.

    Two documents link when numerator * union <= denominator * intersection of their sets of `size`-word shingles. Null and
    empty texts, and those without a word, have an empty set and link with nothing. A text with fewer words than
    `size` is one shingle. Rows with a null id get their size and a null component and link nothing. Rows that repeat,
    and several rows with one id, each give a row; an id reaches what any of its rows links with only through that
    row. An empty table gives no rows. Only the two named columns are read; ids are whole numbers.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    seen = settled(_facts(rows, id_type, size), "facts")
    facts = seen.where("kind = 0").select("id", F.col("a").alias("n"), F.col("b").alias("name"))
    # At most one row per place of the sketch: a fixed size, whatever the corpus.
    often = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("count")).toPandas()
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    classes[often["a"].to_numpy(dtype=np.int64)] = np.log2(often["count"].to_numpy(dtype=float)).astype(np.uint8)
    named = facts.where("n > 0 and id is not null").groupBy("name").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    named = settled(named, "classes")
    least = F.ceil(F.col("n") * numerator / denominator)
    total = named.agg(F.coalesce(F.sum(F.col("n") - least + 1 + F.floor(F.col("n") / 8)), F.lit(0)).alias("t")).first()["t"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // PART_TOKENS + 1)
    blocks = _prefix_tokens(rows, classes, parts, size, numerator, denominator)
    tokens = settled(_shared(blocks, parts).dropDuplicates(["token", "name"]), "tokens")

    # A class that shares fewer prefix tokens than its smallest possible partner needs links with nothing.
    smallest = F.ceil(F.col("n") * numerator / denominator)
    least_shared = (1 + F.floor(smallest / 8)).alias("least")
    able = tokens.groupBy("name").agg(F.count(F.lit(1)).alias("c")).join(named, "name")
    able = settled(able.select("name", "rep", "n", "c", least_shared).where("c >= least").drop("c"), "able")
    texts = rows.join(able.select(F.col("rep").alias("id"), "name").hint("shuffle_hash"), "id").select("name", "text")
    texts = settled(texts, "texts")
    matrix = settled(tokens.join(able.select("name", "n", "least"), "name"), "matrix")

    # Groups grow in rounds: each class is held against the one member of another group that it shares most prefix tokens
    # with, among those that stand for its tokens. Those are the members whose tokens are the most common, which are the middle
    # of a group of near copies. Every other round it is the one that shares its rarest tokens, which finds partners at the rim.
    # What the rounds miss is found below.
    common = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    worth = matrix.join(common, "token").groupBy("name").agg((F.sum("df") / F.first("n")).alias("worth"))
    grouped = matrix.join(common, "token").join(worth, "name").withColumn("g", F.col("name"))
    stars, names, turn, idle = None, able.count(), 0, 0
    while True:
        grouped = settled(grouped, "grouped")
        rank = F.col("worth") if turn == 0 else F.xxhash64("name", F.lit(turn)).cast("double")
        pick = F.max(F.struct(rank.alias("rank"), "name", "g"))
        first = grouped.groupBy("token").agg(pick.alias("one"))
        second = grouped.join(first, "token").where("g <> one.g").groupBy("token").agg(pick.alias("two"), F.first("one").alias("one"))
        met = grouped.join(second, "token").select("name", "least", "df", F.when(F.col("g") != F.col("one.g"), F.col("one.name")).otherwise(F.col("two.name")).alias("other"))
        # Whole numbers, so that no choice hangs on the order of a sum.
        weight = F.lit(1) if turn % 2 == 0 else F.floor(F.lit(1 << 20) / F.col("df"))
        met = met.groupBy("name", "other").agg(F.sum(weight).alias("c"))
        leader = met.groupBy("name").agg(F.max_by("other", F.struct("c", "other")).alias("g"))
        leader = settled(leader, "leaders")
        leaders = leader.select("g").distinct().select(F.col("g").alias("name"), "g")
        links = settled(_open(leaders, leader.select("name", "g"), texts, size, numerator, denominator), "links")
        found = links.count()
        stars = links if stars is None else stars.union(links)
        groups = settled(components(stars), "groups")
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        grouped = grouped.drop("g", "single").join(groups.withColumnRenamed("node", "name"), "name", "left")
        grouped = grouped.withColumn("g", F.coalesce("component", "name")).withColumn("single", F.col("component").isNull())
        grouped = grouped.drop("component")
        idle = idle + 1 if found * 50 <= names else 0
        turn += 1
        if idle == 2:
            break

    # The matrix of tokens and groups, where a token has more than one group, or several classes of a group that is not
    # linked; the rest is linked already.
    grouped = settled(_gathered(settled(grouped, "grouped")), "gathered")
    open_ = grouped.groupBy("token").agg(
        F.min("g").alias("low"), F.max("g").alias("high"), F.max("single").alias("single"), F.count(F.lit(1)).alias("k")
    ).where("low < high or (single and k > 1)")
    asking = settled(grouped.join(open_.select("token"), "token", "left_semi"), "asking")
    unions = asking.groupBy("token", "g").agg(F.min("n").alias("short"), F.max("n").alias("long"), F.count(F.lit(1)).alias("k"))
    unions = unions.select("token", F.col("g").alias("to"), "short", "long", "k")
    inside = (F.col("to") == F.col("g")) & F.col("single") & (F.col("k") > 1)
    fits = (F.col("long") * denominator >= F.col("n") * numerator) & (F.col("short") * numerator <= F.col("n") * denominator)
    bound = asking.join(unions, "token").where(((F.col("to") < F.col("g")) | inside) & fits)
    bound = bound.groupBy("name", "to").agg(F.count(F.lit(1)).alias("c"), F.first("least").alias("least"))
    qualified = settled(bound.where("c >= least").select("name", F.col("to").alias("g")), "qualified")
    members = grouped.select("name", "g").distinct().join(qualified.select("g").distinct(), "g", "left_semi")
    more = _open(members.select("name", "g"), qualified, texts, size, numerator, denominator)
    whole = components(settled(more.union(stars), "links"))

    roots = named.join(whole.withColumnRenamed("node", "name"), "name", "left")
    roots = roots.select("name", "rep", F.coalesce("component", "name").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = settled(roots.join(lowest, "root").select("name", "component_id"), "labels")
    linked = facts.where("n > 0 and id is not null").join(labels, "name", "left").select("id", "n", "component_id")
    alone = facts.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
