"""Near-duplicate operators against all pairs."""

import numpy as np
import pytest
from conftest import SMALL  # noqa: F401
from pyspark.sql import functions as F

from leakscope.llm import minhash, polytope
from leakscope.llm.components import components
from leakscope.llm.queries import QUERIES
from leakscope.llm.words import shingle_sets, word_hashes

from .conftest import roots, shingles, similar


def expected(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    return roots(similar(sets), sets), sets


def test_minhash_equals_all_pairs(spark, docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    want, sets = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def chain(n, words=60, step=4):
    """Texts of which each is like its neighbours only."""
    return [(i, " ".join(f"c{k}" for k in range(step * i, step * i + words))) for i in range(n)]


def test_minhash_chains_and_borders(spark):
    """Links between documents unlike the bucket's centre, and pairs on both sides of 0.75."""
    rows = chain(80)
    base = [f"b{k}" for k in range(40)]
    for j in range(12):  # one text and versions with one word changed at growing places
        rows.append((1000 + j, " ".join(base[:j] + [f"x{j}"] + base[j + 1 :])))
    for j in range(30):  # a shared passage in otherwise different texts
        rows.append((2000 + j, " ".join(base[:24] + [f"r{j}_{k}" for k in range(9)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == expected(rows)[0]


@pytest.mark.parametrize("block", [2, 7])
def test_minhash_small_blocks(spark, block):
    """Buckets larger than a block give the same classes."""
    rows = chain(60, step=3) + [(500 + i, " ".join(f"c{k}" for k in range(60)) + f" e{i}")
                                for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"]
           for r in minhash.near_duplicates(df, block=block).collect()}
    assert got == expected(rows)[0]


def test_joined_labels():
    def row(block, label, values):
        return block, label, np.array(values)

    a, b, c = [1, 2, 3, 4], [1, 2, 3, 4, 5], [7, 8, 9]
    assert minhash._joined_labels([row(0, 1, a), row(0, 2, b), row(0, 3, c), row(0, 2, b)], 75) == [
        (1, 2)]
    assert minhash._joined_labels([row(0, 5, a), row(1, 2, c), row(1, 3, b)], 75) == [(5, 3)]
    assert minhash._joined_labels([row(0, 5, c), row(1, 2, a), row(1, 3, b)], 75) == []


def test_minhash_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"])
                 for r in minhash.near_duplicates(odd_docs).collect())
    assert len(got) == 15
    by_id = {}
    for i, n, c in got:
        by_id.setdefault(i, set()).add((n, c))
    assert by_id[1] == by_id[2] == by_id[11] == {(13, 1)}
    assert by_id[3] == {(0, 3)} and by_id[4] == {(0, 4)} and by_id[5] == {(0, 5)}
    assert by_id[0] == {(13, None), (0, None)}
    assert by_id[6] == {(59996, 6)} and by_id[7] == {(59997, 6)}
    assert by_id[8] == by_id[9] == {(1, 8)} and by_id[10] == {(1, 10)}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_kept_is_one_of_each_class(spark, sf):
    df = QUERIES["op6_minhash"][0](spark, sf)
    assert df.where("kept").count() == df.select("component_id").distinct().count()


def test_words_across_segments(monkeypatch):
    from leakscope.llm import words

    texts = [f"Alpha beta\tgamma{i}  delta\n".encode() * (i % 5) for i in range(40)]
    whole = word_hashes(texts)
    monkeypatch.setattr(words, "SEGMENT", 16)
    parts = word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))
    a, b = shingle_sets([b"ONE two THREE four five", b"one TWO three four five six"], 5)
    assert len(a) == 1 and len(b) == 2 and a[0] in b


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(100)] + [(2000, 2000 + i) for i in range(200)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    want = roots(pairs, {x for p in pairs for x in p})
    assert got == {n: want[n] for n in nodes}
    assert components(df.where("u is null")).count() == 0


def brute_vectors(rows, cosine):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[1]
          and np.isfinite(r[1]).all() and np.any(r[1])]
    links, pairs = {r[0]: 0 for r in rows}, []
    unit = {r[0]: np.array(r[1], float) / np.linalg.norm(r[1]) for r in ok}
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= cosine:
                links[a[0]] += 1
                links[b[0]] += 1
                pairs.append((a[0], b[0]))
    return links, roots(pairs, links)


def test_polytope_equals_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    links, want = brute_vectors([tuple(r) for r in df.collect()], 0.93)
    got = polytope.near_vectors(df, 0.93).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("block, small", [(8, 32), (512, 32), (512, 2), (512, 512)])
def test_polytope_groups_blocks_and_odd_rows(spark, block, small, monkeypatch):
    """A group larger than a block, pairs near the threshold, copies, unusable vectors."""
    monkeypatch.setattr(polytope, "SMALL", small)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    centre = rng.normal(size=24)
    for _ in range(60):
        rows.append((i, (centre + 0.06 * rng.normal(size=24)).tolist(), 1))
        i += 1
    for _ in range(120):  # pairs of a cosine about the threshold
        a = rng.normal(size=24)
        rows += [(i, a.tolist(), 2), (i + 1, (a + 0.37 * rng.normal(size=24)).tolist(), 2)]
        i += 2
    rows += [(900 + k, rows[0][1], 1) for k in range(5)] + [(950, rows[0][1], 3)]
    rows += [(960, None, 1), (961, [0.0] * 24, 1), (962, [1.0, None], 1), (963, rows[0][1], None),
             (964, [float("nan")] * 24, 1), (965, [float("inf")] * 24, 1), (966, [], 1),
             (967, rows[0][1][:20], 1), (968, [2 * x for x in rows[0][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({"id": F.lit("x"), "code": F.lit(1), "n": F.lit(2)})
    links, want = brute_vectors(rows, 0.93)
    got = polytope.near_vectors(df, 0.93, block=block).collect()
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
    assert found >= 0.98 * sum(links.values())
    group = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] < 60 or r["vec_id"] >= 900}
    assert group == {v: links[v] for v in group}
    assert polytope.near_vectors(df.limit(0), 0.93).count() == 0


def test_vectors_of_any_scale_and_labels_of_any_type(spark):
    v = [3.0, -4.0, 12.0, 0.5]
    scales = [1.0, 1e-200, 2e-200, 1e200, 1e-310, -1e200]
    rows = [(i, [s * x for x in v], "a") for i, s in enumerate(scales)]
    rows += [(10, v, "b"), (11, [2 * x for x in v], "b"), (12, v, None), (13, [1e308] * 4, "a"),
             (14, [5e307, 5e307, 5e307, 4e307], "a"), (15, [1e308, 0.0, 0.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in polytope.near_vectors(df, 0.93).collect()}
    assert [got[i] for i in range(6)] == [(4, 0)] * 5 + [(0, 5)]
    assert got[10] == got[11] == (1, 10) and got[12] == (0, 12)
    assert got[13] == got[14] == (1, 13) and got[15] == (0, 15)
    close = spark.createDataFrame([(1, v, 1.2), (2, v, 1.7)],
                                  "vec_id long, embedding array<double>, label double")
    assert {r.n_links for r in polytope.near_vectors(close, 0.93).collect()} == {0}
