"""Block search against brute force; an index in generations against one built anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import WHOLE, brute, rows_of

from quillrank.operators import block_index, blocks
from quillrank.session import fresh_path

FLOAT = "id string, term string, weight double"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    terms = [f"t{i}" for i in range(40)]
    common = 1 / np.arange(1, 41)
    draw = lambda p, n, most: [
        (f"{p}{i}", t, int(w)) for i in range(n) for t, w in zip(rng.choice(terms, most, replace=False, p=common / common.sum()), rng.integers(1, 9, most))
    ]
    docs, queries = draw("d", 150, 7), draw("q", 25, 6)
    docs += [(f"c{i}", "t0", 3) for i in range(60)]  # equal documents
    return docs, queries + [("alone", "nowhere", 5)]


def expected(docs, queries, k, cut=None):
    return [r for r in brute(docs, queries, k, cut) if r[0] != "alone"]


@pytest.mark.parametrize("k, cut", [(1, None), (8, 3), (400, None), (400, 1)])
@pytest.mark.parametrize("limits", [{}, {"chunk_postings": 60, "chunk_kept": 10_000}])
def test_topk(spark, data, k, cut, limits):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in data)
    packed = blocks.pack(docs, 150)
    assert packed.count() > 4
    assert rows_of(blocks.topk(packed, queries, k, cut, **limits)) == expected(*data, k, cut)


def test_passes_of_few_cells_give_the_same(spark, data):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in data)
    rows = blocks.pack(docs, 300).collect()
    for cut, cells, terms in [(None, 100, 5), (2, 100, 5), (None, 10**6, 10**6)]:
        chosen = queries if cut is None else queries.withColumn("cut", F.expr("row_number() over (partition by id order by weight desc, term)") <= cut)
        chunk = blocks._chunk(chosen.withColumnRenamed("id", "qid"), True)
        old = blocks.CELLS, blocks.TERM_ROWS
        blocks.CELLS, blocks.TERM_ROWS = cells, terms
        try:
            search = blocks._Search(chunk, 5)
            for row in rows:
                types = {"ids": "s", "terms": "s", "ends": "i", "docs": "i", "weights": "w", "tops": "w"}
                search.add(blocks._Block({c: _scalar(row[c], t) for c, t in types.items()}))
        finally:
            blocks.CELLS, blocks.TERM_ROWS = old
        got = {}
        for q, s, d in zip(search.query, search.score, search.ids):
            got.setdefault(chunk.names[q], []).append((str(d), int(s)))
        want = {}
        for q, d, s, _ in sorted(expected(*data, 5, cut), key=lambda r: (r[0], r[3])):
            want.setdefault(q, []).append((d, s))
        assert got == want


def _scalar(values, kind):
    import pyarrow as pa

    inner = {"s": pa.string(), "i": pa.int32(), "w": pa.int64()}[kind]
    return pa.array([values], pa.list_(inner))[0]


def test_blocks_that_cannot_improve_are_skipped(spark):
    strong = [(f"a{i}", "x", 9) for i in range(20)]
    weak = [(f"b{i}", "x", 1) for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, WHOLE)
    packed = [blocks.pack(frame(rows)).first() for rows in (strong, weak)]
    chunk = blocks._chunk(frame([("q", "x", 2), ("p", "x", 1)]).withColumnRenamed("id", "qid"), True)
    search = blocks._Search(chunk, 10)
    for row in packed:
        types = {"ids": "s", "terms": "s", "ends": "i", "docs": "i", "weights": "w", "tops": "w"}
        search.add(blocks._Block({c: _scalar(row[c], t) for c, t in types.items()}))
    assert search.skipped == 2 and set(search.score.tolist()) == {18, 9}


def test_floats_large_numbers_repeats_and_nulls(spark):
    docs = [("a", "x", 0.1), ("a", "y", 0.2), ("b", "x", 0.3), ("b", None, 1.0), (None, "x", 1.0), ("c", "x", None), ("a", "x", 0.1), ("n", "x", -1.0)]
    queries = [("q", "x", 1.0), ("q", "y", 0.5), ("r", "x", -1.0), (None, "x", 1.0), ("q", "y", 0.5)]
    found = rows_of(blocks.topk(blocks.pack(spark.createDataFrame(docs, FLOAT)), spark.createDataFrame(queries, FLOAT), 9))
    assert found == [("q", "a", 0.4, 1), ("q", "b", 0.3, 2), ("q", "n", -1.0, 3), ("r", "a", -0.2, 2), ("r", "b", -0.3, 3), ("r", "n", 1.0, 1)]
    big = spark.createDataFrame([("a", "x", 1 << 40), ("b", "x", (1 << 40) + 1), ("b", "y", 1)], "id string, term string, weight long")
    ask = spark.createDataFrame([("q", "x", 1 << 20), ("q", "y", 1)], "id string, term string, weight long")
    assert [r[2] for r in rows_of(blocks.topk(blocks.pack(big), ask, 2))] == [1 << 60, (1 << 60) + (1 << 20) + 1]
    none = spark.createDataFrame([], WHOLE)
    assert rows_of(blocks.topk(blocks.pack(none), spark.createDataFrame([("q", "x", 1)], WHOLE), 3)) == []
    assert rows_of(blocks.topk(blocks.pack(spark.createDataFrame([("d", "x", 1)], WHOLE)), none, 3)) == []


def test_no_posting_is_shuffled(spark, data, capsys):
    docs, queries = (spark.createDataFrame(x, WHOLE) for x in data)
    path = fresh_path(spark, "blocks")
    blocks.pack(docs, 150).write.parquet(path)
    blocks.topk(spark.read.parquet(path), queries, 5).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2
    assert sorted(blocks.unpack(spark.read.parquet(path)).collect()) == sorted(docs.selectExpr("id", "term", "cast(weight as long) weight").collect())


def test_generations_equal_a_rebuild(spark, data):
    docs, queries = data
    frame = lambda rows: spark.createDataFrame(rows, WHOLE)
    asked = frame(queries)
    index = block_index.BlockIndex(spark, fresh_path(spark, "index"), 150)
    assert index.version() == 0 and rows_of(index.search(asked, 5)) == []
    ids = sorted({r[0] for r in docs})
    first, second = set(ids[:120]), set(ids[100:])
    index.add(frame([r for r in docs if r[0] in first]))
    changed = [(i, t, w + 1) if i in first else (i, t, w) for i, t, w in docs if i in second]
    index.add(frame(changed))
    index.delete(frame([(i, "", 0) for i in ids[5:15] + ["unknown"]]).select("id"))
    held = [r for r in docs if r[0] in first - second] + changed
    held = [r for r in held if r[0] not in ids[5:15]]
    kinds = [x["kind"] for x in index.manifest()]
    assert kinds.count("blocks") == 2 and kinds.count("dead") == 2 and index.version() == 3
    for cut in (None, 2):
        assert rows_of(index.search(asked, 7, cut)) == expected(held, queries, 7, cut)
    assert sorted(tuple(r) for r in index.postings().collect()) == sorted(held)
    index.compact()
    assert [x["kind"] for x in index.manifest()] == ["blocks"]
    assert rows_of(index.search(asked, 7)) == expected(held, queries, 7)
    index.drop_old()
    assert rows_of(index.search(asked, 7, chunk_postings=30)) == expected(held, queries, 7)
    # Most documents gone: the index compacts by itself.
    index.delete(frame([(i, "", 0) for i in ids[20:]]).select("id"))
    assert [x["kind"] for x in index.manifest()] == ["blocks"]
    held = [r for r in held if r[0] in ids[:20]]
    assert rows_of(index.search(asked, 7)) == expected(held, queries, 7)
    index.rebuild(frame(docs))
    assert rows_of(index.search(asked, 7)) == expected(docs, queries, 7)


def test_an_unfinished_version_does_not_count(spark):
    rows = spark.createDataFrame([("d", "x", 1)], WHOLE)
    index = block_index.BlockIndex(spark, fresh_path(spark, "index"))
    index.add(rows)
    spark.createDataFrame([("blocks", "nowhere", 1, "bigint")], block_index.MANIFEST).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(index._place(2))
    assert index.version() == 1 and rows_of(index.search(rows.withColumn("id", F.lit("q")), 3)) == [("q", "d", 1, 1)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index.add(rows)
    index.recover()
    index.add(rows.withColumn("id", F.lit("e")))
    assert index.version() == 2 and [x["kind"] for x in index.manifest()] == ["blocks", "blocks"]


def test_whole_and_float_generations_meet(spark):
    index = block_index.BlockIndex(spark, fresh_path(spark, "index"))
    index.add(spark.createDataFrame([("d", "x", 1)], WHOLE))
    index.add(spark.createDataFrame([("e", "x", 0.5)], FLOAT))
    asked = spark.createDataFrame([("q", "x", 2)], WHOLE)
    assert rows_of(index.search(asked, 3)) == [("q", "d", 2.0, 1), ("q", "e", 1.0, 2)]
