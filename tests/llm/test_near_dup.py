"""Near duplicates against brute force over all pairs."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from funnelscope.llm import near_dup, queries
from funnelscope.llm.components import components


def brute_force(rows, k, similar):
    """{id: (set size, smallest reachable id)} of (id, text) rows with distinct ids."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)}
        sets[i] = grams or ({tuple(words)} if words else set())
    holders = {}
    for i, grams in sets.items():
        for g in grams:
            holders.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, grams in sets.items():
        for j in {j for g in grams for j in holders[g] if j < i}:
            both = len(grams & sets[j])
            if similar[1] * both >= similar[0] * len(grams | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    result = queries.op3_near_duplicates(spark, sf_dir)
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(result) == brute_force(rows, 3, (85, 100))


def words(start, n):
    return [f"w{i}" for i in range(start, start + n)]


def test_chains_copies_and_borderline(spark):
    base = words(0, 200)
    rows = [(i, " ".join(words(i, 200))) for i in range(100, 140)]            # each a shift of the one before
    rows += [(10 + i, " ".join(base[:i * 7] + ["x"] + base[i * 7 + 1:])) for i in range(20)]
    rows += [(50 + i, " ".join(base).upper()) for i in range(5)]
    rows += [(200, " ".join(words(5000, 87))), (201, " ".join(words(5000, 87)[:74])), (202, " ".join(words(7000, 87))),
             (203, " ".join(words(7000, 87)[:75]))]
    got = found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)))
    assert got == brute_force(rows, 3, (85, 100))


def changed(text, places, mark):
    return [f"{mark}-{i}" if i in places else w for i, w in enumerate(text)]


def test_dense_region_of_one_template(spark, monkeypatch):
    """Texts over one template, similar by about 0.8, hide the planted pairs from each other in every order."""
    monkeypatch.setattr(near_dup, "CHUNK_ENTRIES", 16, raising=False)
    draw, base, rows = random.Random(3), words(0, 300), []
    for i in range(300):
        rows.append((i, changed(base, draw.sample(range(0, 300, 4), 5), f"x{i}")))
    for i in range(0, 300, 10):
        rows.append((1000 + i, changed(rows[i][1], draw.sample(range(2, 300, 4), 3), f"y{i}")))
    rows = [(i, " ".join(text)) for i, text in rows]
    expected = brute_force(rows, 3, (85, 100))
    assert sum(i != root for i, (_, root) in expected.items()) >= 30
    assert found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100))) == expected


def test_passages_quoted_at_other_lengths(spark):
    """Copies stand among longer texts that quote the same passage: similar by about 0.77, but of sizes that rule it out."""
    draw, rows = random.Random(4), []
    for passage in range(3):
        base = words(1000 * passage, 100)
        rows += [(1000 * passage + i, base + [f"{passage}-{i}-{j}" for j in range(30)]) for i in range(150)]
        rows += [(1000 * passage + 500, base), (1000 * passage + 501, changed(base, draw.sample(range(2, 96, 4), 2), f"c{passage}"))]
    rows = [(i, " ".join(text)) for i, text in rows]
    expected = brute_force(rows, 3, (85, 100))
    assert sum(i != root for i, (_, root) in expected.items()) == 3
    assert found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100))) == expected


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO\n"), (6, "one"), (None, "one two"), (7, "a b c"), (7, "a b c"),
            (8, "z " * 50_000), (9, "Z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as n", "'x' as id")
    got = near_dup.near_duplicates(df, 3, (85, 100)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by_id == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True),
                     None: (1, None, True), 7: (1, 7, True), 8: (1, 8, True), 9: (1, 8, False)}


def test_a_batch_is_gone_through_in_parts():
    texts = [" ".join(f"w{(i * 7919 + j) % 100_003}" for j in range(700)) for i in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    assert batch.nbytes > 4_000_000
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part in near_dup._sets(5)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 40e6   # 4 MB at once took 54 MB


def test_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(5, 3), (3, 5), (9, 5), (2, 8)]])
def test_components(spark, links):
    parent = {i: i for link in links for i in link}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["component"] for r in components(df).collect()} == {i: c for i, c in parent.items() if i != c}
