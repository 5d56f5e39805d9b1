"""Token counts and packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from leakscope.llm import pack_tree, token_count, token_output, tokens

WORD = tokens.vocabulary(tokens.WORD_VOCABULARY)
BYTE = tokens.vocabulary(tokens.BYTE_VOCABULARY)
RANKS = tokens.vocabulary(tokens.BYTE_RANKS)

ODD = ["", "a  b \n c\n\n d", "x <|endoftext|> y", "\u00dcn\u00ef \u00b9\u00b2 \u00bd x_y 12345 \u0391\u03a3 \u00c0\u00c9 \u0130x",
       "a\x1cb", "\u4e2d\u6587 \u5b57 e\u0301 \ufb01  x", "it's I'LL DON'T '' '", "\x00\x01 a\x7f\u0085b c", "   ",
       "z" * 5000, " lead", "trail ", "\u00a0nb\u00a0sp", "end.\n\n\n  \t next"]


def ids_of(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts],
                                                   add_special_tokens=False)
    return [e.ids for e in found]


@pytest.mark.parametrize("path, spaced", [(WORD, False), (BYTE, True)])
def test_units_equal_the_tokenizer(docs, path, spaced):
    texts = ODD + [r["text"] for r in docs.limit(150).collect()]
    units = tokens.Units(path, spaced, "I")
    assert [tokens.as_ids(x, "I").tolist() for x in units.of(texts)] == ids_of(path, texts)
    assert tokens.Units(path, spaced, None).of(texts) == [len(x) for x in ids_of(path, texts)]


@pytest.mark.parametrize("seed", range(3))
def test_bare_units_equal_the_tokenizer(seed):
    """Short forms, marks, digits, blanks and other characters in any order."""
    rng = np.random.default_rng(seed)
    signs = list("'''''strevlmdSTL aZ_5-,.\n\t\x00\x7f") + [
        "\u00e9", "\u00c9", "\u0301", "\u00a0", "\u2019", "\u4e2d", "\u0130", "\u00b2", "\U0001f600"]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 60, 700)] + ["", "'", "'r", "é"]
    for part in (texts, [""], [" "], ["'s"]):
        units = tokens.Units(WORD, False, "I")
        want = ids_of(WORD, part)
        for _ in range(2):
            assert [tokens.as_ids(x, "I").tolist() for x in units.of(part)] == want
        assert tokens.Units(WORD, False, None).of(part) == [len(x) for x in want]


def test_a_word_is_merged_once_with_any_marks():
    units = tokens.Units(WORD, False, "I")
    units.of(["Word, word. (word) WORD's", "word" + "x" * 300, "word! 1word"])
    assert set(units.known) == {"word", ",", ".", "(", ")", "'s", "!", "1"}


def test_counts(docs, odd_docs, no_docs):
    for df in (docs.limit(300), odd_docs):
        rows = df.select("doc_id", "text").collect()
        want = sorted(
            (r["doc_id"] or -1, len((r["text"] or "").encode()), len(x), len(x) > 1024)
            for r, x in zip(rows, ids_of(BYTE, [r["text"] for r in rows])))
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"])
                     for r in token_count.token_counts(df, BYTE, 1024).collect())
        assert got == want
    assert token_count.token_counts(no_docs, BYTE, 1024).count() == 0


def checked(rows, capacity):
    """Sequences without gaps and overlaps, documents without loss."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], r["length"], r["piece"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return sequences, documents


def test_pack(docs):
    want = {r["doc_id"]: x + [0] for r, x in zip(docs.collect(), ids_of(
        WORD, [r["text"] for r in docs.collect()]))}
    rows = pack_tree.pack(docs.repartition(9), WORD, keep_ids=True).collect()
    sequences, documents = checked(rows, 2048)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        assert r["start"] == len(got[r["doc_id"]])
        got[r["doc_id"]] += tokens.as_ids(r["ids"], "I").tolist()
    assert got == want
    for parts in documents.values():
        assert [p for _, _, p in sorted(parts)] == list(range(len(parts)))
        assert all(n == 2048 for _, n, _ in sorted(parts)[:-1])
    total = sum(map(len, want.values()))
    _, _, best = pack_tree.best_fit([r["length"] for r in rows], 2048)
    assert len(sequences) <= 1.02 * len(best) and len(sequences) >= total / 2048


def test_pack_more_rounds(docs):
    """Underfull bins dealt out to several tasks, round after round."""
    rows = pack_tree.pack(docs.repartition(24), WORD, capacity=512, items=60).collect()
    sequences, _ = checked(rows, 512)
    _, _, best = pack_tree.best_fit([r["length"] for r in rows], 512)
    assert len(sequences) <= 1.05 * len(best)


def test_pack_odd_rows(odd_docs, no_docs):
    rows = pack_tree.pack(odd_docs, WORD).collect()
    checked(rows, 2048)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r["length"])
    assert by_id[3] == by_id[4] == by_id[5] == [1]
    assert len(by_id[2]) == 2 and len(by_id[None]) == 2 and len(by_id[6]) > 50
    assert pack_tree.pack(no_docs, WORD).count() == 0


def test_best_fit_fills_the_least_room():
    bins, offsets, used = pack_tree.best_fit([5, 9, 1, 4, 8, 2], 10)
    # 9; 8 and 2; 5 and 4, and 1 in one of the two places left
    assert sorted(used) == [9, 10, 10]
    assert bins[0] == bins[3] != bins[1] and bins[4] == bins[5] and offsets[2] == 9


def test_ranks_equal_the_tokenizer(docs):
    texts = ODD + ["a" * 999 + " " * 1500 + "b", " \t" * 900, "x " * 3000] + [
        r["text"] for r in docs.limit(150).collect()]
    encoder = tokens.Ranks(RANKS, BYTE)
    assert [encoder.of(t).tolist() for t in texts] == ids_of(BYTE, texts)


@pytest.mark.parametrize("seed", range(4))
def test_segment_tree_equals_scan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 300).tolist()
    rows = token_output.fit(lengths, 64)
    _, _, used = pack_tree.best_fit(lengths, 64)
    assert sorted(sum(lengths[i] for i in r) for r in rows) == sorted(used)
    assert sorted(i for r in rows for i in r) == list(range(300))


def test_sequences_round_trip(spark, docs, odd_docs, no_docs, tmp_path):
    for df, block in ((docs.limit(200), 20_000), (odd_docs, 8_000_000)):
        rows = token_output.packed_sequences(df, BYTE, RANKS, 50256, block=block)
        token_output.write_sequences(rows, str(tmp_path / f"s{block}"))
        rows = spark.read.parquet(str(tmp_path / f"s{block}")).collect()
        pieces = []
        for r in rows:
            ids = tokens.as_ids(r["ids"], "H")
            assert len(ids) == 2048 and r["cu_seqlens"][-1] == r["n_tokens"]
            assert not ids[r["n_tokens"] :].any()
            position = token_output.position_ids(r["cu_seqlens"], r["position_starts"], 2048)
            for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
                pieces.append((r["doc_ids"][k], r["position_starts"][k], ids[a:b].tolist()))
                assert position[a] == 0 and position[b - 1] == b - a - 1
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        texts = df.select("doc_id", "text").collect()
        want = sorted((r["doc_id"] or -1, x + [50256]) for r, x in zip(
            texts, ids_of(BYTE, [r["text"] for r in texts])))
        # pieces of equal documents may stand in any order, so lengths and multisets are compared
        got = defaultdict(list)
        for doc, start, x in pieces:
            got[doc or -1] += x
        together = defaultdict(list)
        for doc, x in want:
            together[doc] += x
        assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in together.items()}
    assert token_output.packed_sequences(no_docs, BYTE, RANKS, 50256).count() == 0
