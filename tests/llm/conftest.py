import re
from collections import defaultdict

import pytest

SF = "/root/testdata/sf0.01"
BLANK = re.compile("[\x20\x09-\x0d]+")


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in BLANK.split(text) if w]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else (
        {tuple(w)} if w else set())


def roots(pairs, nodes):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(sets, percent=75):
    """All pairs of ids whose sets reach the similarity, through an index of their shingles."""
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    return [(a, b) for (a, b), n in common.items()
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


DOCS = "doc_id long, text string, id string, key int, at int, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null and repeated ids, ties, a long text, clashing extra columns."""
    long_text = " ".join(f"w{i}" for i in range(60_000))
    one = "the quick brown fox jumps over the lazy dog while the cat looks on from the wall"
    rows = [(1, one), (2, one), (2, one), (3, None), (4, ""), (5, "   \n"), (None, one),
            (None, None), (6, long_text), (7, long_text + " end"), (8, "A"), (9, "a"),
            (10, "x" * 100_000), (11, one.upper()), (12, "na\u00efve \u4e2d\u6587 <|endoftext|> \x1c y")]
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
