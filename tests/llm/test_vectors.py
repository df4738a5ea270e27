import numpy as np

from llm import vectors
from llm.vectors import audit, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, rep long"


def made(n=260, dim=16, seed=3):
    r = np.random.default_rng(seed)
    center = r.normal(size=dim)
    x = np.concatenate([center + r.normal(size=(n // 2, dim)) * 0.12, r.normal(size=(n - n // 2, dim))]).astype(np.float32)
    return x, r.integers(0, 2, n)


def brute(x, labels, ids, least=0.93):
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = (y @ y.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    part = np.array(ids)
    while True:
        new = np.array([min([part[i], *part[hit[i]]]) for i in range(len(ids))])
        if (new == part).all():
            return hit.sum(axis=1), part
        part = new


def test_links_and_components_match_brute_force_in_small_shards(spark):
    x, labels = made()
    ids = list(range(10, 10 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), int(k), "a", 0) for i, v, k in zip(ids, x, labels, strict=True)], SCHEMA)
    out = near_vectors(df, shard=32)
    got = {r["vec_id"]: r for r in out.collect()}
    n, part = brute(x, labels, ids)
    assert sum(got[i]["n_links"] for i in ids) >= 0.98 * n.sum() > 0
    assert all(got[i]["n_links"] <= k for i, k in zip(ids, n, strict=True))
    assert [got[i]["component_id"] for i in ids] == part.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    row = audit(df, out, one_in=5, block=50).first()
    assert row["links"] == n[[i % 5 == 0 for i in ids]].sum() and row["recall"] >= 0.9


def test_no_link_is_lost_between_hundreds_of_clusters(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 16))
    x = np.concatenate([x, x + 0.36 * r.normal(size=x.shape)]).astype(np.float32)  # pairs near the least cosine
    labels, ids, clusters, plain = np.zeros(len(x), int), list(range(len(x))), [], vectors._cluster
    monkeypatch.setattr(vectors, "_cluster", lambda *a: (lambda c: clusters.append(len(c)) or c)(plain(*a)))
    monkeypatch.setattr(vectors, "FAR_VALUES", 3000)
    df = spark.createDataFrame([(i, v.tolist(), 0, "a", 0) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {r["vec_id"]: r for r in near_vectors(df, shard=16).collect()}
    n, part = brute(x, labels, ids)
    assert clusters[0] >= 200
    assert [got[i]["n_links"] for i in ids] == n.tolist() and n.sum() > 400
    assert [got[i]["component_id"] for i in ids] == part.tolist()


def test_odd_vectors_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (3, [2.0, 0.0], 0), (4, one, 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0), (10, one, None), (11, [], 0), (12, [1.0, 0.0, 0.0], 0), (None, one, 0), (13, [1e-30, 0.0], 0)]
    out = near_vectors(spark.createDataFrame([(*r, "a", 0) for r in rows], SCHEMA)).collect()
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert len(out) == len(rows)
    assert links[1] == links[2] == links[3] == links[13] == (3, 1)
    assert all(links[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert links[None] == (0, None)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
