"""Components of links, against a walk."""

import random

from keyloom.operators.graph import components


def test_chains_stars_and_random_links(spark):
    rnd = random.Random(5)
    chain = [(i * 7919 % 10007, (i + 1) * 7919 % 10007) for i in range(2000)]  # names in no order along the chain
    links = chain + [(20_000, 20_001 + i) for i in range(300)] + [(30_000 + rnd.randrange(400), 30_000 + rnd.randrange(400)) for _ in range(300)] + [(5, 5), (None, 3), (40_000, 40_000)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(up)}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), max_rounds=25).collect()}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
