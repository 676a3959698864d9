"""Operators on groups of documents, and the pipeline, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from crosstide.llm import components, lattice, neardup, pii, queries, shingles


# ------------------------------------------------------------------ components
def brute_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["random", "path", "zigzag", "star", "empty"])
def test_components(spark, shape):
    r = random.Random(3)
    links = {
        "random": [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)], "path": [(i, i + 1) for i in range(150)], "zigzag": [((i * 89) % 151, ((i + 1) * 89) % 151) for i in range(150)],
        "star": [(500, i) for i in range(300)], "empty": [],
    }[shape]
    df = spark.createDataFrame([*links, (7, 7), (None, 3)], "a bigint, b bigint")
    got = {x["id"]: x["label"] for x in components.components(df).collect()}
    assert got == {k: v for k, v in brute_components([x for x in links if x[0] != x[1]]).items()}


# ------------------------------------------------------------------ near-duplicates
def words_of(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def sets_of(texts, k):
    out = []
    for t in texts:
        w = words_of(t)
        out.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \t\n\x0b\xa0.", max_size=25), min_size=1, max_size=6), st.integers(1, 4))
def test_shingle_sets(texts, k):
    got = shingles.shingle_sets(texts, k)
    want = sets_of(texts, k)
    assert [len(g) for g in got] == [len(w) for w in want]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


def test_shingles_do_not_depend_on_grouping(monkeypatch):
    texts = ["some words here and there " * 3, "", None, "x", "A b C d e"]
    whole = [s.tolist() for s in shingles.shingle_sets(texts, 3)]
    monkeypatch.setattr(shingles, "TOGETHER", 10)
    assert [s.tolist() for s in shingles.shingle_sets(texts, 3)] == whole


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(2))
    both = np.concatenate([a, b])
    assert (neardup.merge(neardup.registers(a), neardup.registers(b)) == neardup.registers(both)).all()
    errors = []
    for j in (0.3, 0.6, 0.85):
        n = int(2000 * j / (1 + j))
        for _ in range(12):
            pool = rng.integers(0, 2**63, 2000 - n).astype(np.uint64)
            x, y = pool[: 1000], pool[1000 - n :]
            like = neardup.likeliest_similarity(neardup.registers(x)[None], neardup.registers(y)[None], np.array([float(len(x))]), np.array([float(len(y))]))[0]
            errors.append(like - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.03
    for t in (0.8, 0.85, 0.95):
        k = neardup.rows_per_band(t)
        assert (1 - t**k) ** (neardup.REGISTERS // k) <= neardup.MISS


def brute_groups(rows, k, share):
    sets = sets_of([t for _, t in rows], k)
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] == rows[b][0] or sets[a] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                if rows[a][0] is not None and rows[b][0] is not None:
                    links.append((rows[a][0], rows[b][0]))
    label = brute_components([x for x in links if x[0] != x[1]])
    return sorted((i if i is not None else -1, len(s), label.get(i, i) if i is not None else -1) for (i, _), s in zip(rows, sets))


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=40))
    rows, i = [], 0
    for g in range(25):
        base = r.choices(vocabulary, k=r.randint(5, 160))
        for c in range(r.choice([1, 1, 2, 5, 30])):
            w = [x if r.random() > r.choice([0, 0.005, 0.02, 0.05, 0.1]) else r.choice(vocabulary) for x in base]
            i += r.randint(1, 5)
            rows.append((i, " ".join(w) + (f" {passage}" if g % 3 == 0 else "")))
    for t in (None, "", "  \n", "one", "ONE", "one two", "one two", "x" * 5000):
        i += 1
        rows.append((i, t))
    rows += [rows[3], rows[3], (rows[8][0], rows[40][1]), (None, "one two"), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, share", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(spark, monkeypatch, k, share):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, registers string, label int")
    got = neardup.near_duplicates(df, k, share).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute_groups(rows, k, share)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(df).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).where("kept AND n_shingles = 0").count() == 2


# ------------------------------------------------------------------ embeddings
def test_e8_points_are_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(scale=2, size=(300, 8))
    near = lattice.decode(x)
    assert np.allclose(near * 2, np.rint(near * 2)) and ((near.sum(axis=1) % 2) == 0).all()
    own = ((x - near) ** 2).sum(axis=1)
    others = ((x[:, None] - near[:, None] - lattice._neighbours()[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= others + 1e-9).all() and len(lattice._neighbours()) == 240


def vectors():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 32))
    rows = []
    for g, b in enumerate(base):
        for _ in range([1, 2, 12, 60][g % 4]):
            noise = rng.normal(size=32)
            spread = rng.choice([0.0, 0.1, 0.3, 0.45, 0.5]) * np.linalg.norm(b) / np.linalg.norm(noise)
            rows.append([float(v) for v in (b + noise * spread).astype(np.float32) * rng.choice([1, 1, 3.5])])
    rows += [None, [], [0.0] * 32, [1.0, None, *[0.0] * 30], [float("nan")] * 32, [float("inf"), *[0.0] * 31], [1.0, 0.0], [2.0, 0.0], rows[5], rows[5], rows[5]]
    return list(enumerate(rows, 3))


def brute_vectors(rows, threshold):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and np.abs(v).max() > 0:
            x = np.array(v, np.float32).astype(float)
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    label = brute_components(links)
    return degree, {i: label.get(i, i) for i, _ in rows}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 16)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, unit string")
    got = lattice.near_duplicates(df, 0.9).collect()
    degree, label = brute_vectors(rows, 0.9)
    assert len(got) == len(rows)
    found, all_ = sum(r["n_links"] for r in got), sum(degree.values())
    assert 0.99 * all_ <= found <= all_ and all(r["n_links"] <= degree[r["vec_id"]] for r in got)
    assert np.mean([r["component_id"] == label[r["vec_id"]] for r in got]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [500, 4_000, 64_000, 10**6])
def test_cells_recall(n):
    plan = lattice.design(n, 0.9)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (own_a, near_a, s_a), (own_b, near_b, s_b) = lattice.cells(a, plan), lattice.cells(b, plan)
    hit = np.array([bool(set(x) & set(p) | set(x) & set(q) | set(y) & set(z)) for x, p, q, y, z in zip(own_a, own_b, near_b, own_b, near_a)])
    apart = np.array([sum(int(u ^ v).bit_count() if u ^ v >= 0 else int((int(u) ^ int(v)) & (2**64 - 1)).bit_count() for u, v in zip(x, y)) for x, y in zip(s_a.tolist(), s_b.tolist())])
    assert hit.mean() > 0.99 and (apart <= lattice.sign_limit(0.9)).mean() > 0.999


def test_pairs_met_by_chance_do_not_follow_the_table():
    met = {}
    for n in (4_000, 64_000):
        u = np.random.default_rng(4).normal(size=(n, 64))
        own, probed, _ = lattice.cells(u / np.linalg.norm(u, axis=1, keepdims=True), lattice.design(n, 0.9))
        keys, counts = np.unique(own.ravel(), return_counts=True)
        at = np.minimum(np.searchsorted(keys, probed.ravel()), len(keys) - 1)
        met[n] = ((counts * (counts - 1)).sum() + counts[at][keys[at] == probed.ravel()].sum()) / n
    assert met[64_000] < 2.5 * met[4_000]


# ------------------------------------------------------------------ SQL and pipeline
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labelled = docs.where("lang = 'en'").limit(3).collect()
    other = docs.where("lang = 'de'").orderBy(F.length("text").desc()).limit(2).collect()
    add = [(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, "12 34", "en", "s", 5), (900_003, other[0]["text"], None, "s", 1), (900_003, other[0]["text"], None, "s", 1), (900_004, labelled[0]["text"], "en", "s", 1), (900_004, "ein ganz anderer Text " + other[1]["text"][::-1], "de", "s", 2)]
    odd = docs.withColumn("extra", F.lit(1)).unionByName(spark.createDataFrame([(*r, 2) for r in add], "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"))
    made = cp.identify_language(spark, odd, folder)
    langs = {r["lang"] for r in made.where("doc_id = 900003").collect()}
    assert langs == {"de"} and made.where("doc_id in (900001, 900002) or doc_id is null").count() == 0 and tuple(made.columns) == cp.COLUMNS
    rest = cp.remove_near_duplicates(spark, odd, folder)
    rows = rest.where("doc_id >= 900001 or doc_id is null").collect()
    # The copy of a labelled text goes, the other text of its id stays; equal rows without a smaller copy leave one row at most.
    assert [r["text"] for r in rows if r["doc_id"] == 900_004] == [add[-1][1]]
    assert len([r for r in rows if r["doc_id"] is None]) == 1 and len([r for r in rows if r["doc_id"] == 900_003]) == 0 and len([r for r in rows if r["doc_id"] in (900_001, 900_002)]) >= 1
    assert cp.replace_personal_data(spark, odd, folder).count() == odd.count()
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, folder).cache()
        assert tuple(docs.columns) == cp.COLUMNS and dict(docs.dtypes) == dict(before.dtypes)
        seen.append((name, before.collect(), docs.collect()))
    (_, a, b), (_, c, e), (_, f, g) = seen
    assert 0.98 * len(a) <= len(b) <= len(a)
    groups = dict((i, label) for i, _, label in brute_groups([(r["doc_id"], r["text"]) for r in c], 5, (80, 100)))
    assert sorted(r["doc_id"] for r in e) == sorted(i for i, label in groups.items() if i == label)
    assert {r["doc_id"]: r["text"] for r in g} == {r["doc_id"]: pii.replaced(r["text"], pii.DEMONSTRATION_KEY)[0] for r in f}
    assert all(r["n_chars"] == len(r["text"]) for r in g)
    packed = cp.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in g}
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
