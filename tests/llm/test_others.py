"""Operators on urls, vectors and graphs, and the pipeline."""

import numpy as np
import pytest

from gatewright.llm import embedding_dedup as ed
from gatewright.llm import url_filters
from gatewright.llm.common import WordCache, components
from tests.compare import duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


def test_urls_match_sql(spark):
    assert spark_rows(url_filters.op9_url_filters(spark, SF_DIR)) == duck_rows(url_filters.ORACLE_SQL["op9_url_filters"], SF_DIR)


def test_urls_against_brute_force(spark):
    rng = np.random.default_rng(1)
    labels, paths = ["a", "b", "c-c", "d"], ["/", "/x", "/x/", "/x/y", "/xy"]
    rules = [(".".join(rng.choice(labels, rng.integers(1, 4))), str(rng.choice(paths)), str(rng.choice(["allow", "block"]))) for _ in range(25)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [None, "", "no scheme", "http://", "http://A.B", "ftp://a.b?q=/x"] + [f"http://{'.'.join(rng.choice(labels, rng.integers(1, 5)))}{rng.choice([*paths, '', '?x', '/x/y/z#f'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "id int, url string, rule string")
    got = url_filters.judge(df, "url", spark.createDataFrame(rules, "host string, path string, verdict string"), "none").collect()
    assert len(got) == len(urls)
    for r in got:
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if r["host"] and (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        want = max(fits, key=lambda x: x[:2]) if fits else None
        assert (r["rule"], r["verdict"]) == ((want[2], want[3]) if want else (None, "none")), r


def test_urls_without_rows_or_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.b/")], "id int, url string")
    assert url_filters.judge(df, "url", rules).first()["verdict"] == "allow"
    assert url_filters.judge(df.limit(0), "url", spark.createDataFrame(url_filters.RULES, rules.schema)).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    x = np.vstack([x, x[:10] + rng.normal(size=(10, 8)) * 0.1, np.repeat(x[:1], 5, 0), 3 * x[1:2]])
    return [[float(np.float32(v)) for v in row] for row in x]


def test_vectors_against_brute_force(spark):
    x = vectors()
    rows = [(i, v, "z") for i, v in enumerate(x)]
    rows += [(100, None, "z"), (101, [], "z"), (102, [0.0] * 8, "z"), (103, [None] + x[0][1:], "z"), (104, [float("nan")] + x[0][1:], "z"), (105, [float("inf")] + x[0][1:], "z"), (106, x[0][:4], "z"), (3, x[3], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id string")
    got = ed.link_vectors(df, "vec_id", "embedding", 0.9, chunk=16).collect()
    assert len(got) == len(rows)
    sound = [(i, np.array(v, float)) for i, v, _ in rows if i < 100]
    u = np.array([v / np.linalg.norm(v) for _, v in sound])
    near = u @ u.T >= 0.9
    comp = list(range(len(sound)))
    for _ in sound:
        comp = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(sound))]
    want = sorted((sound[i][0], int(near[i].sum()) - 1, min(sound[j][0] for j in range(len(sound)) if comp[j] == comp[i])) for i in range(len(sound)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] < 100) == want
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] >= 100)
    assert ed.link_vectors(df.limit(0), "vec_id", "embedding").count() == 0


def test_vectors_are_sent_by_blocks_and_linked_by_group(spark):
    """Chunks in several blocks: links are those of brute force; with `by`, those within a group."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 8))
    x[120:150] = x[:30] + rng.normal(size=(30, 8)) * 0.1
    rows = [(i, [float(np.float32(e)) for e in v], "b" if i % 3 else None if i % 5 else "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<float>, kind string")
    u = ed.unit(np.array([r[1] for r in rows]))
    for by in (None, "kind"):
        near = u @ u.T >= 0.9
        if by:
            near &= np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows]) | np.eye(len(rows), dtype=bool)
        comp = np.arange(len(rows))
        for _ in rows:
            comp = np.array([comp[n].min() for n in near])
        got = sorted(tuple(r) for r in ed.link_vectors(df, "id", "v", 0.9, chunk=20, by=by).select("id", "n_links", "component_id").collect())
        assert got == [(i, int(near[i].sum()) - 1, int(comp[i])) for i in range(len(rows))]


@pytest.mark.parametrize("cosine", [0.5, 0.9, 0.99])
def test_flat_trees_are_compared_densely(cosine):
    rng = np.random.default_rng(7)
    x, y = (ed.unit(rng.normal(size=(300, 32))) for _ in range(2))
    y[:20] = ed.unit(x[:20] + rng.normal(size=(20, 32)) * 0.03)
    trees = [ed.CoverTree(v) for v in (x, y)]
    x, y = (v[t.order] for v, t in zip((x, y), trees, strict=True))
    w = np.arange(300) + 1.0
    for b, tb, wb in ((y, trees[1], w[::-1]), (x, trees[0], w)):
        same = b is x
        near = x @ b.T >= cosine
        if same:
            np.fill_diagonal(near, False)
        nx, ny, edges = ed.dual_links(x, trees[0].table, w, b, tb.table, wb, cosine, same)
        assert np.allclose(nx, near @ wb) and (same or np.allclose(ny, near.T @ w))
        assert all(near[i, j - (0 if same else 300)] for i, j in edges) and len(edges) <= near.sum()


@pytest.mark.parametrize("cosine", [0.5, 0.9, 0.99])
def test_dual_traversal(cosine):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=12)
    x = ed.unit(np.vstack([rng.normal(size=(80, 12)), centre + rng.normal(size=(120, 12)) * 0.05, np.repeat(centre[None], 9, 0)]))
    tree = ed.CoverTree(x)
    x = x[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    w = np.ones(len(x))
    links, _, edges = ed.dual_links(x, tree.table, w, x, tree.table, w, cosine, True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    assert (links == near.sum(1)).all()
    up = list(range(len(x)))
    for a, b in edges:
        assert near[a, b] or np.isclose(x[a] @ x[b], cosine)
        one, two = up[a], up[b]
        up = [min(one, two) if v in (one, two) else v for v in up]
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert [int(np.flatnonzero(r)[0]) for r in reach] == [int(np.flatnonzero([v == up[i] for v in up])[0]) for i in range(len(x))]


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_cache_forgets_and_makes_again():
    made = []
    cache = WordCache(lambda w: made.append(w) or w.upper(), 3)
    for words in (["a", "b"], ["c", "d", "a"], ["e", "a"], ["f", "g", "h", "i"], ["a"]):
        assert cache.all(words) == [w.upper() for w in words]
    assert len(cache.new) + len(cache.old) <= 12


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    docs = odd.select(*p.COLUMNS).where("doc_id is not null")
    seen = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF_DIR)
        rows = docs.collect()
        seen.append((name, {r["doc_id"] for r in rows}))
        if name != p.STAGES[-1][0]:
            assert docs.columns == p.COLUMNS
            docs = spark.createDataFrame(rows, docs.schema)
    kept = dict(seen)
    assert not kept["language_id"] & {1, 2, 3, 11} and {4, 6, 8, 12, 15} <= kept["language_id"]
    assert {4, 6, 8, 13, 14, 16, 17} <= kept["near_dedup"] and not kept["near_dedup"] & {5, 7, 9}
    assert kept["packing"] == kept["substring_dedup"]


def test_pipeline_runs_on_tables(spark):
    import corpus_pipeline as p

    rows = p.run(spark, SF_DIR).select("doc_id", "sequence_id", "offset", "length").collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(fill.values()) <= 1024


def test_registered_names():
    from gatewright.llm import registry

    names = registry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(registry.oracle_sql()) <= set(names)


def test_pipeline_takes_null_keys_extra_columns_and_empty_tables(spark, odd, empty):
    import corpus_pipeline as p

    docs = odd.withColumn("another", odd.doc_id)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
    rows = docs.collect()
    assert None in {r["doc_id"] for r in rows} and "another" not in docs.columns
    none = empty
    for _, stage in p.STAGES:
        none = stage(spark, none, SF_DIR)
    assert none.count() == 0
