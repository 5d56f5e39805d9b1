"""Spelling variants against brute force over deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from leakscope.llm import queries
from leakscope.llm import spelling_variants as spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, shortest=6, least=5, every=199):
    total = Counter()
    for doc_id, text in rows:
        for w in RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    index = defaultdict(list)
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            index[key].append(w)
    out = defaultdict(set)
    for group in index.values():
        for a in group:
            out[a].update(b for b in group if near(a, b))
    return out


def expected(words, ratio=5):
    around, form = neighbours(words), {}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(around[w]), words[form[w]] if form[w] else None)
    return out


def grouped(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_acceptor_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(12)})
        states, start = spelling.acceptor(words)

        def language(s):
            return frozenset([""] * states[s][0]) | {
                a + z for a, t in states[s][1].items() for z in language(t)}

        languages = [language(s) for s in range(len(states))]
        assert languages[start] == set(words)
        assert len(set(languages)) == len(languages)


def test_composition_finds_each_pair_once():
    rng = random.Random(5)
    for _ in range(300):
        span = rng.randrange(1, 5)
        words = sorted({"".join(rng.choices("abc", k=span + rng.randrange(2))) for _ in range(25)})
        got = list(spelling.compose(words, span, True))
        assert len(set(got)) == len(got)
        assert {frozenset(p) for p in got} == {
            frozenset((a, b)) for a in words for b in words
            if len(a) == span and near(a, b)}


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_pairs_at_any_partition_size(spark, limit):
    rng = random.Random(6)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 9))) for _ in range(900)} | {
        "z" * 3000, "z" * 3001, "z" * 2999 + "a"}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = [frozenset(r) for r in spelling.near_pairs(df, limit).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == {frozenset((a, b)) for a, bs in neighbours(words).items() for b in bs}


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = expected(counts(map(tuple, rows)))
    assert any(f for f, *_ in want.values())
    assert grouped(queries.op13_spelling_variants(spark, sf)) == want


def test_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {r.word: r.n for r in spelling.word_counts(odd_docs, 3, 2, 7).collect()}
    assert got == counts(rows, 3, 2, 7)
    got = {r.word: r.n for r in spelling.word_counts(odd_docs, 1, 1).collect()}
    assert got == counts(rows, 1, 1, None)
    assert spelling.variant_groups(spelling.word_counts(no_docs, 1, 1)).count() == 0


def test_chains_ties_and_long_texts(spark):
    words = {"colour": 2, "colours": 10, "coloursx": 50, "coloursxy": 250, "coloursxyz": 1250,
             "abcdef": 1, "abcdeg": 6, "abcdeh": 6, "lonely": 9, "über÷x": 1, "über×x": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = grouped(spelling.variant_groups(df))
    assert got == expected(words)
    assert got["colour"][1] == "coloursxyz" and got["abcdef"][0] == "abcdeg"
    text = "Straße " * 400_000 + "y" * 2_500_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(docs, 6, 5).collect()} == {
        "straße": 400_000}
