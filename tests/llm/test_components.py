import random

from spanloom.llm.components import components


def brute(links):
    of = {v: v for e in links for v in e}

    def root(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {(v, root(v)) for v in of}


def test_equals_union_find(spark):
    r = random.Random(1)
    cases = [
        [],
        [(1, 1), (2, 3)],
        [(i, i + 1) for i in range(50)],
        [(50 - i, 49 - i) for i in range(50)],
        [(1000, i) for i in range(40)] + [(2000, i) for i in range(20, 60)],
        [(r.randrange(200), r.randrange(200)) for _ in range(120)],
        [(2 * i, 2 * i + 3) for i in range(40)] + [(5, 5), (7, 2), (7, 2)],
    ]
    for links in cases:
        df = spark.createDataFrame(links, "a long, b long")
        assert {tuple(x) for x in components(df).collect()} == brute(links), links
