"""Vector operators, URL lists, components and the pipeline against brute force."""

import itertools
import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
import oracle
from quillrank.llm import curve_search, near_vectors, url_lists
from quillrank.llm.common import components

BAD = [
    (9001, None, 1, "v", "i"),
    (9002, [], 1, "v", "i"),
    (9003, [0.0] * 8, 1, "v", "i"),
    (9004, [float("nan")] + [1.0] * 7, 1, "v", "i"),
    (9005, [float("inf")] + [1.0] * 7, 1, "v", "i"),
    (9006, [None] + [1.0] * 7, 1, "v", "i"),
]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    edges += [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hilbert_curve_visits_neighbours():
    for bits, m in ((3, 2), (2, 3), (2, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=m)))
        keys = curve_search.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_window_holds_the_wanted_share():
    distances = np.array([[0, 9], [1, 0], [5, 1], [9, 1]])
    assert curve_search.choose_window(distances, 100, 1.0) == (2, 1)
    assert curve_search.choose_window(distances, 100, 0.5) == (2, 1)
    # A third curve is worth it where it makes the windows of all much narrower.
    assert curve_search.choose_window(np.column_stack([distances + 9, [0, 0, 0, 0]]), 100, 1.0) == (3, 1)
    assert curve_search.choose_window(np.column_stack([distances, [4, 4, 4, 4]]), 100, 1.0) == (2, 1)
    assert curve_search.choose_window(np.zeros((0, 5)), 100, 0.9) == (2, 1)


def test_search_recall_and_exact_scores(spark, make_vectors):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    points = (centres[rng.integers(0, 20, 900)] + 0.2 * rng.normal(size=(900, 8))).astype(np.float32)
    points[500:560] = points[0]
    rows = [(i, p.tolist(), 0, "v", "i") for i, p in enumerate(points)] + BAD
    df = make_vectors(rows + rows[:5])
    asked = df.where("vec_id % 25 = 0 or vec_id > 9000")
    got = curve_search.nearest(df, asked, k=10, block_rows=64).collect()
    exact, hit = points.astype(np.float64), 0
    queries = list(range(0, 900, 25))
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == queries
    for q in queries:
        far = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(900), far)) if i != q][:10]
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(far[r["vec_id"]], abs=1e-12) for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit += len(set(order) & {r["vec_id"] for r in mine})
    assert hit / (10 * len(queries)) >= 0.9


def test_several_curves_on_spread_vectors(make_vectors, caplog):
    """Vectors spread over all directions: several curves are merged, and the audited recall is what brute force gives."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(3000, 12)).astype(np.float32).astype(np.float64)
    df = make_vectors([(i, p.tolist(), 0, "v", "i") for i, p in enumerate(points)])
    with caplog.at_level("INFO", curve_search.LOG.name):
        got = curve_search.nearest(df, df.where("vec_id % 30 = 0"), k=10, block_rows=32).collect()
    used, window, blocks, recall = re.search(r"(\d+) curves of 32, (\d+) of (\d+) blocks on each, audited recall ([\d.]+)", caplog.text).groups()
    assert int(used) >= 2 and int(window) < int(blocks) and float(recall) >= 0.94
    hit = 0
    for q in range(0, 3000, 30):
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hit += len(set(np.argsort(far)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 900


def test_nearest_points_with_many_ties_or_a_common_offset():
    ids = np.arange(2000)
    hot = np.eye(2000)
    ((_, got, far),) = curve_search._nearest(hot[:1], ids, hot, ids[:1], 10)
    assert got.tolist() == list(range(1, 11)) and set(far) == {np.sqrt(2)}
    rng = np.random.default_rng(6)
    moved = rng.normal(size=(2000, 16)) + 1e9
    few = np.append(moved[:50], moved[50:] + 1e11, axis=0)
    for points in (hot, moved, few, rng.integers(0, 2, (2000, 12)).astype(float)):
        for k in (1, 10, 1999, 3000):
            got = list(curve_search._nearest(points[:20], ids, points, ids[:20], k))
            for i, who, far in got:
                exact = np.sqrt(((points[i] - points) ** 2).sum(axis=1))
                order = [j for j in np.lexsort((ids, exact)) if j != i][:k]
                assert who.tolist() == order and (far == exact[order]).all()
            assert len(got) == 20


def test_search_of_few_or_no_points(spark, make_vectors):
    few = make_vectors([(0, [1.0, 0.0], 0, "", ""), (1, [0.0, 1.0], 0, "", ""), (2, [1.0, 0.0, 0.0], 0, "", "")])
    rows = curve_search.nearest(few, few.where("vec_id in (0, 2)")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [(0, 1, 1)]
    empty = make_vectors([])
    assert curve_search.nearest(empty, empty).count() == 0
    assert curve_search.nearest(make_vectors(BAD), few).count() == 0


def brute_links(rows, threshold=0.98):
    good = {}
    for key, vector, label, *_ in rows:
        v = None if vector is None or None in vector else np.array(vector, dtype=np.float32).astype(np.float64)
        ok = v is not None and label is not None and len(v) and np.isfinite(v).all() and v.any()
        good[key] = (label, v) if ok else None
    count, parent = dict.fromkeys(good, 0), {k: k for k in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(good), 2):
        if good[a] and good[b] and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
            x, y = good[a][1], good[b][1]
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                count[a] += 1
                count[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: (count[k], root(k), root(k) == k) for k in good}


def test_near_vectors_against_brute_force(make_vectors):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    rows = []
    for i, b in enumerate(base):
        for _ in range(3 if i else 70):
            rows.append((len(rows), (b + rng.normal(scale=rng.choice([0, 0.02, 0.2]), size=8)).tolist(), int(i % 3), "v", "i"))
    rows += [(len(rows) + i, rows[0][1], 0, "v", "i") for i in range(40)]
    rows += [(8000, rows[0][1], None, "v", "i"), (8001, [1.0, 2.0], 1, "v", "i"), (8002, [2.0, 4.0], 1, "v", "i"), (8003, [2.0, 4.0], 2, "v", "i")]
    rows += BAD
    got = near_vectors.near_duplicates(make_vectors(rows + rows[:3])).collect()
    expected = brute_links(rows)
    assert len(got) == len(rows)
    mine = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert sum(mine[k] == v for k, v in expected.items()) >= 0.99 * len(rows)
    assert sum(m[0] for m in mine.values()) >= 0.99 * sum(v[0] for v in expected.values())
    assert all(mine[k][0] <= v[0] for k, v in expected.items())
    for key in (8000, *(b[0] for b in BAD)):
        assert mine[key] == (0, key, True)


def linked_clumps(rng, size, dim, spread):
    """Two clumps, each larger than any list is long, at a cosine of about 0.985."""
    axis, side = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    middles = (axis, 0.985 * axis + np.sqrt(1 - 0.985**2) * side)
    return [m + rng.normal(scale=spread, size=dim) for m in middles for _ in range(size)]


def test_near_vectors_links_between_tight_clumps(make_vectors):
    rng = np.random.default_rng(21)
    rows = []
    for label, (size, spread) in enumerate([(12, 0.002), (40, 0.002), (40, 0.004), (80, 0.004), (40, 0.006), (80, 0.006)]):
        rows += [(v.tolist(), label) for v in linked_clumps(rng, size, 32, spread)]
    rows = [(int(i), v, label, "v", "i") for i, (v, label) in zip(rng.permutation(len(rows)), rows)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(make_vectors(rows)).collect()}
    assert got == brute_links(rows)


def test_near_vectors_do_not_end_on_an_audit_without_links(make_vectors, monkeypatch):
    """First lists that find nothing, and two lone pairs that a small sample may miss."""
    none = lambda reps, *_: reps.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0).cast("float").alias("sim")).limit(0)
    monkeypatch.setattr(near_vectors, "_first_lists", none)
    vectors = np.random.default_rng(4).normal(size=(600, 16))
    vectors[[100, 400]] = vectors[[50, 350]] * 1.5 + 0.01
    rows = [(i, v.tolist(), 1, "v", "i") for i, v in enumerate(vectors)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(make_vectors(rows)).collect()}
    assert got == brute_links(rows) and sum(n for n, _, _ in got.values()) == 4


def test_descent_finds_lone_pairs_without_comparing_labels(make_vectors, monkeypatch, caplog):
    """A table of spread vectors with few links: groups come from lists alone, and the audit holds planted links."""
    rng = np.random.default_rng(31)
    vectors = rng.normal(size=(1500, 24))
    for i in range(30):
        side = rng.normal(size=24)
        side -= (side @ vectors[i]) * vectors[i] / (vectors[i] @ vectors[i])
        cosine = rng.uniform(0.981, 0.999)
        vectors[700 + i] = cosine * vectors[i] / np.linalg.norm(vectors[i]) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    rows = [(i, v.tolist(), i % 700 % 2, "v", "i") for i, v in enumerate(vectors)]
    sizes, compare = [], near_vectors._compare_groups

    def recorded(groups, *rest):
        sizes.append(groups.groupBy("g").count().agg(F.max("count")).first()[0])
        return compare(groups, *rest)

    monkeypatch.setattr(near_vectors, "_compare_groups", recorded)
    with caplog.at_level("INFO", near_vectors.LOG.name):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(make_vectors(rows)).collect()}
    expected = brute_links(rows)
    assert sum(n for n, _, _ in expected.values()) >= 60 and got == expected
    assert sizes and max(sizes) < 10
    assert "known links" in caplog.text
    assert {k: v for k, v in got.items()} == {
        r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(make_vectors(rows), exhaustive=True).collect()
    }


def test_outer_lists_double_while_inner_ones_are_full_of_links(spark):
    rows = [(1, 10 + i, 0.99, True, 4) for i in range(4)] + [(1, 30, 0.5, False, 4)]
    rows += [(2, 20 + i, 0.9, True, 4) for i in range(4)] + [(3, 40, 0.99, True, 4), (4, 41, 0.3, False, 16)]
    graph = spark.createDataFrame(rows, "u long, v long, sim float, own boolean, k int")
    assert {tuple(r) for r in near_vectors._widened(graph, 4, 0.976).collect()} == {(1, 8), (4, 16)}


def test_orders_grow_with_the_rows_of_a_label():
    counts = [near_vectors.orders_for(n, 0.98) for n in (10_000, 100_000, 1_000_000, 30_000_000)]
    assert counts == sorted(set(counts)) and counts[1] >= 16


def test_near_vectors_of_nothing(make_vectors):
    assert near_vectors.near_duplicates(make_vectors([])).count() == 0
    assert near_vectors.near_duplicates(make_vectors(BAD)).count() == len(BAD)


# --- URL lists --------------------------------------------------------------------------------------------------


def test_lists_hold_from_add_to_remove(spark):
    events = spark.createDataFrame(
        [
            ("spam", "domain", "x.org", "2024-01-10", "add"),
            ("spam", "domain", "x.org", "2024-01-20", "remove"),
            ("spam", "domain", "x.org", "2024-01-20", "add"),
            ("spam", "domain", "x.org", "2024-02-01", "add"),
            ("old", "prefix", "y.org/a", "2024-01-05", "add"),
            ("old", "prefix", "y.org/a", "2024-01-05", "add"),
            ("old", "domain", "org", "2023-01-01", "add"),
            ("old", "domain", "org", "2024-01-02", "remove"),
            ("old", "domain", None, "2024-01-02", "add"),
            ("old", "domain", "z.org", "2024-01-01", "wrong"),
        ],
        "list string, kind string, pattern string, day string, action string",
    ).withColumn("day", F.col("day").cast("date")).withColumn("host", F.lit("clash"))
    seen = [
        (1, "http://www.X.org./p", "2024-01-09", ""),
        (2, "http://www.x.org/p", "2024-01-10", "spam"),
        (3, "https://u:p@x.org:80?q", "2024-01-19", "spam"),
        (4, "http://x.org", "2024-01-20", ""),
        (5, "http://x.org", "2024-03-01", "spam"),
        (6, "http://notx.org/", "2024-01-15", ""),
        (7, "http://y.org/a/b?c", "2024-01-05", "old"),
        (8, "http://y.org//a", "2024-01-06", "old"),
        (9, "http://y.org/ab", "2024-01-06", ""),
        (10, "http://z.org/", "2024-01-01", "old"),
        (11, None, "2024-01-15", ""),
        (12, "no host", "2024-01-15", ""),
        (13, "http://x.org/", None, ""),
        (None, "http://x.org/", "2024-01-15", "spam"),
        (2, "http://www.x.org/p", "2024-01-10", "spam"),
        (14, "http://y.org/" + "a/" * 3000, "2024-01-15", "old"),
    ]
    captures = spark.createDataFrame(seen, "page_id long, url string, day string, lists string").withColumn("day", F.col("day").cast("date"))
    rows = url_lists.evaluate(captures, events).collect()
    assert {(r["page_id"], r["lists"]) for r in rows} == {(s[0], s[3]) for s in seen} and len(rows) == len(seen) - 1
    assert all(r["blocked"] == bool(r["lists"]) for r in rows)
    assert url_lists.evaluate(captures, events.limit(0)).where("blocked").count() == 0
    assert url_lists.evaluate(captures.limit(0), events).count() == 0


# --- queries and pipeline ---------------------------------------------------------------------------------------


def test_each_operator_has_one_query():
    names = [n for n in entry_points.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert good.columns == docs.columns
    kept = good.select("doc_id").join(labels, "doc_id").toPandas()
    assert (kept["quality"] == 1).mean() > 0.97
    assert len(kept) > 0.95 * labels.where("quality = 1").count()
    good = spark.createDataFrame(good.collect(), docs.schema)
    apart = corpus_pipeline.duplicates_stage(spark, good, sf_dir)
    from test_texts import brute_jaccard, brute_secrets

    expected = brute_jaccard([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in apart.collect()} == {k for k, (_, c) in expected.items() if k == c}
    apart = spark.createDataFrame(apart.collect(), docs.schema)
    clean = {r["doc_id"]: r for r in corpus_pipeline.secrets_stage(spark, apart, sf_dir).collect()}
    for r in apart.collect():
        assert not brute_secrets(clean[r["doc_id"]]["text"])
        if not brute_secrets(r["text"]):
            assert clean[r["doc_id"]]["text"] == r["text"]
    packed = corpus_pipeline.packing_stage(spark, apart, sf_dir).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(clean)


def test_duplicates_are_decided_by_row(spark, make_docs, sf_dir):
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    near = plain(1).replace("w1x29", "other")
    texts = [plain(1), near, plain(2), plain(3), plain(3), None, None, "", " ", plain(4), near, plain(5), plain(5), plain(6)]
    ids = [1, 2, 2, 3, 3, 4, 4, None, None, None, None, 9, 8, None]
    docs = make_docs(texts, ids)
    left = corpus_pipeline.duplicates_stage(spark, docs, sf_dir)
    assert left.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    want = [(1, plain(1)), (2, plain(2)), (3, plain(3)), (4, None), (4, None), (None, ""), (None, " "), (None, plain(4)), (8, plain(5)), (None, plain(6))]
    assert rows == sorted(want, key=str)


def test_stages_with_odd_rows(spark, make_docs, sf_dir):
    token = "token=abcdefgh1"
    texts = [None, "", token, token, "a long text " * 2000, "x" * 400_000, "plain"]
    ids = [None, 1, 2, 2, None, 3, 3]
    docs = make_docs(texts, ids, [None, "s", "s", "s", None, "t", "t"])
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert good.columns == docs.columns and {r["text"] for r in good.collect()} <= set(texts)
    clean = corpus_pipeline.secrets_stage(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    want = sorted(((i, "[secret]" if t == token else t) for i, t in zip(ids, texts)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == want
    packed = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    assert sorted((str(r["doc_id"]) for r in packed)) == sorted(map(str, ids))
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in packed}) == len(packed)


def test_batches_hold_tokens(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    batches = {}
    for r in corpus_pipeline.packing_stage(spark, docs, sf_dir).collect():
        assert r["n_tokens"] == sizes[r["doc_id"]] and r["bound"] - r["n_tokens"] == r["padding"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["bound"])
    assert all(sum(b) <= 16_384 or len(b) == 1 for b in batches.values())


def test_pipeline_of_an_empty_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir) if "doc_id" in rows.columns and "text" in rows.columns else rows
    assert rows.count() == 0


def test_oracle_file_is_there():
    assert oracle.connect and corpus_pipeline.ORACLE_SQL is None
