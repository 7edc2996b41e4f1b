"""Connected components over several tasks and in several steps, against a plain union of links."""

import random

from funnelscope.llm import components as module


def plain(links):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in list(parent) if root(i) != i}


def some_links():
    draw = random.Random(3)
    names = draw.sample(range(-5000, 5000), 700)
    path = [(names[i], names[i + 1]) for i in range(300)]
    star = [(names[320], names[i]) for i in range(321, 480)]
    loose = [(draw.choice(names[480:]), draw.choice(names[480:])) for _ in range(150)]
    links = path + star + loose + path[:20] + [(b, a) for a, b in star[:20]] + [(7001, 7001)]
    draw.shuffle(links)
    return links


def table(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def rows(df):
    out = [(r["id"], r["component"]) for r in df.collect()]
    assert len(out) == len(dict(out))
    return {i: c for i, c in out if i != c}


def test_one_task_and_many(spark, monkeypatch):
    links = some_links()
    want = {i: c for i, c in plain(links).items()}
    assert rows(module.components(table(spark, links))) == want
    monkeypatch.setattr(module, "TASK_LINKS", 60)
    assert rows(module.components(table(spark, links))) == want


def test_merging_in_steps(spark):
    links, labels = some_links(), None
    for i in range(0, len(links), 150):
        labels = module.merged(labels, table(spark, links[i:i + 150]))
        assert rows(labels) == plain(links[:i + 150])


def test_no_links(spark):
    assert rows(module.components(table(spark, []))) == {}
    labels = module.merged(None, table(spark, [(2, 1)]))
    assert rows(module.merged(labels, table(spark, []))) == {2: 1}
