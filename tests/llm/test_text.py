"""URL filter, decontamination, toxicity, shards and extraction."""

import collections
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.llm import (
    decontaminate,
    html_extract,
    shard_shuffle,
    toxicity,
    url_filter,
)
from leakscope.llm.html_labelled import labelled_pages
from leakscope.llm.queries import QUERIES, RULES

from .conftest import words


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for kind, rule in RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = (kind, rule)
    return best


def brute_scores(shapes):
    """Score of each shape by the two models, one character at a time."""
    tables = {}
    for shape, (rejected, train) in shapes.items():
        t = f"\x02{shape}\x03"
        if train:
            for i in range(2, len(t) + 1):
                for k in range(1, min(5, i) + 1):
                    g = t[i - k : i]
                    tables.setdefault((rejected, g[:-1]), collections.Counter())[g[-1]] += 1

    def p(rejected, context, c, k):
        shorter = p(rejected, context[1:], c, k - 1) if k > 1 else 1 / 128
        seen = tables.get((rejected, context))
        if not seen:
            return shorter
        return (seen[c] + len(seen) * shorter) / (sum(seen.values()) + len(seen))

    out = {}
    for shape in shapes:
        t = f"\x02{shape}\x03"
        logs = []
        for i in range(2, len(t) + 1):
            k = min(5, i)
            g = t[i - k : i]
            logs.append(np.log(p(True, g[:-1], g[-1], k)) - np.log(p(False, g[:-1], g[-1], k)))
        out[shape] = float(np.mean(logs))
    return out


def test_urls(spark, sf):
    rows = QUERIES["op1_url_filter"][0](spark, sf).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    bad = re.compile("casino|bets|pills|adult|spam|ads-")
    right = open_ = 0
    for r in rows:
        assert (r["host"], r["path"]) == host_path(urls[r["page_id"]])
        rule = ruled(r["host"], r["path"])
        assert r["rule"] == (rule and rule[1])
        if rule:
            assert r["verdict"] == rule[0]
        else:
            open_ += 1
            right += (r["verdict"] == "block") == bool(bad.search(r["host"]))
    assert right >= 0.97 * open_ > 0


def test_url_scores_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = url_filter.judge(df, RULES).collect()
    labels = set(url_filter.REJECTED_WORDS)
    names = {re.sub("[0-9]+", "0", r["host"] + r["path"]): r["host"] for r in rows}
    train = {r["s"]: r["t"] for r in spark.createDataFrame([(n,) for n in names], "s string")
             .select("s", (F.pmod(F.xxhash64("s"), F.lit(5)) != 0).alias("t")).collect()}
    want = brute_scores({n: (bool(labels & set(re.split("[.-]", h))), train[n])
                         for n, h in names.items() if n})
    for r in rows:
        name = re.sub("[0-9]+", "0", r["host"] + r["path"])
        assert r["score"] == pytest.approx(want[name], abs=1e-9)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y://z", "a://b.net/fr/?q",
            "x://net/es/", "x://Example.com?x", "x://\u00c4.example.org/#a", "x://a/b://c", "x://a\nb/c"]
    df = spark.createDataFrame([(i, u, "s", 1) for i, u in enumerate(urls + urls[:5])] +
                               [(None, "x://a.com/", "s", 1)],
                               "page_id long, url string, shape string, score int")
    rows = url_filter.judge(df, RULES).collect()
    assert len(rows) == len(urls) + 6
    for r in rows:
        if r["page_id"] is not None:
            assert (r["host"], r["path"]) == host_path((urls + urls[:5])[r["page_id"]])
            rule = ruled(r["host"], r["path"])
            assert (r["rule"], r["verdict"]) == ((rule[1], rule[0]) if rule else (None, "allow"))
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def brute_leaks(docs, items):
    found = {}
    for d, text in docs:
        w = words(text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        for item, passage in items:
            v = words(passage)
            diagonals = {i - p for p in range(len(v) - 2) for i in at.get(tuple(v[p : p + 3]), ())}
            for g in diagonals:
                same = [0 <= g + k < len(w) and w[g + k] == v[k] for k in range(len(v))]
                if sum(same) >= 10:
                    found[d, item] = max(found.get((d, item), 0), sum(same))
    return found


def longest(w, v):
    """Most equal words of a stretch of one alignment with at least 10, at a rate of 0.75."""
    best = 0
    for g in range(1 - len(v), len(w)):
        at = [k for k in range(max(0, -g), min(len(v), len(w) - g)) if w[g + k] == v[k]]
        if len(at) > max(9, best):
            best = max([best] + [b - a + 1 for a in range(len(at)) for b in range(a + 9, len(at))
                                 if b - a + 1 >= 0.75 * (at[b] - at[a] + 1)])
    return best


def test_leaks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = decontaminate.leaks(docs, items).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    passages = {r["item_id"]: r["text"] for r in items.collect()}
    want = brute_leaks(texts.items(), passages.items())
    assert {(r["doc_id"], r["item_id"]) for r in rows} == set(want) and want
    assert {(r["doc_id"], r["item_id"]): r["n_matches"] for r in rows} == {
        (d, i): longest(words(texts[d]), words(passages[i])) for d, i in want}


def test_leaks_with_substitutions(spark):
    item = [f"w{k}" for k in range(40)]
    noise = [f"n{k}" for k in range(300)]

    def text(changed, a=0, b=40):
        return " ".join(noise[:100] + [f"s{k}" if k in changed else w for k, w in
                                       enumerate(item) if a <= k < b] + noise[100:])

    rows = [(1, text(())), (2, text({5, 20, 33})), (3, text(set(range(0, 40, 7)))),
            (4, text((), 10, 30)), (5, text(set(range(0, 40, 2)))), (6, text((), 0, 8)),
            (7, " ".join(noise)), (8, text(()).upper().replace(" ", "\n\t"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(
        [(7, " ".join(item)), (9, " ".join(item)), (8, "too short"), (10, None), (None, "")],
        "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {1, 2, 3, 4, 8} and {r["item_id"] for r in got.values()} == {7}
    assert got[1]["n_matches"] == 40 and got[1]["start_word"] == 100 and got[2]["n_matches"] == 37
    assert got[4]["n_matches"] == 20 and got[4]["n_words"] == 20


def test_leaks_any_stretch(spark):
    """A stretch that meets both bounds counts, also beside a shorter one of fewer changes."""
    shapes = {1: "1" * 6 + "000" + "1" * 7, 2: "1" * 8 + "00" + "1" * 4}
    docs = spark.createDataFrame(
        [(d, " ".join(f"w{k}" if c == "1" else f"s{d}x{k}" for k, c in enumerate(shape)))
         for d, shape in shapes.items()], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(20)))],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["n_matches"], r["n_words"], r["start_word"])
           for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 13, 16, 0), (2, 12, 14, 0)}


def test_leaks_are_reported_whole(spark):
    """Passages far longer than a mask, at many changes, and every item that holds them."""
    draw = random.Random(8)
    passage = [f"w{k}" for k in range(400)]
    changed = [w if draw.random() < 0.8 else f"s{k}" for k, w in enumerate(passage)]
    items = [(1, passage), (2, passage + ["more"]), (3, passage), (4, passage[100:160])]
    docs = [(10, ["a"] * 7 + passage + ["z"] * 9), (11, changed), (12, passage[350:] + passage[:30])]
    got = decontaminate.leaks(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
        items_df := spark.createDataFrame([(i, " ".join(w)) for i, w in items],
                                          "item_id long, text string")).collect()
    want = {(d, i): longest(w, v) for d, w in docs for i, v in items if i != 3}
    assert {(r["doc_id"], r["item_id"]): r["n_matches"] for r in got} == {
        k: n for k, n in want.items() if n}
    whole = next(r for r in got if (r["doc_id"], r["item_id"]) == (10, 1))
    assert (whole["n_matches"], whole["n_words"], whole["start_word"], whole["n_items"]) == (
        400, 400, 7, 2)
    classes = {tuple(r) for r in decontaminate.item_classes(items_df).collect()}
    assert classes == {(1, 1), (2, 2), (3, 1), (4, 4)}


def test_masks_fit_every_passage():
    """No shape of 10 or more equal words at a rate of 0.75 or more is without a seed.

    Goes through all shapes, word by word: the best sum (+1 equal, -3 changed) of shapes without a
    seed, by their last words and count of equal words. Shapes of over 27 words hold shorter ones.
    """
    masks = [int(m, 2) for m in decontaminate.MASKS]
    low = 2 ** (decontaminate.SPAN - 1) - 1
    best = {(0, 0): 0}
    for _ in range(28):
        longer = {}
        for (last, n), total in best.items():
            for equal in (0, 1):
                now = last << 1 | equal
                if any(now & m == m for m in masks):
                    continue
                key, value = (now & low, min(10, n + equal)), total + (1 if equal else -3)
                longer[key] = max(longer.get(key, value), value)
        best = longer
        assert all(total < 0 for (_, n), total in best.items() if n == 10)


def test_leaks_of_every_length(spark):
    """Whole copies of items of any length, and copies with as many changes as the rate allows."""
    draw = random.Random(5)
    items, docs, want = [], [], set()
    for n in (*range(2, 18), 20, 24, 32, 48):
        passage = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(passage)))
        most = min(n // 4, n - 10) if n > 10 else 0
        for changes in range(most + 1):
            for turn in range(12 if changes else 1):
                changed = set(draw.sample(range(n), changes))
                text = [f"s{k}" if k in changed else w for k, w in enumerate(passage)]
                noise = [f"n{draw.random()}" for _ in range(turn)]
                docs.append((len(docs), " ".join(noise + text + noise)))
                want.add((len(docs) - 1, n))
        if n < 10:  # all words of a short item are needed
            docs.append((len(docs), " ".join(passage[:-1] + ["other"])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["n_matches"] >= min(10, r["item_id"]) for r in got)


def test_leaks_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("h"))
    rows = decontaminate.leaks(odd_docs, items).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    # equal items stand under the smallest id; ids 6 and 7 differ in their last word
    assert {(1, 1), (2, 1), (None, 1), (11, 1), (6, 6), (7, 6)} <= got
    assert not {d for d, _ in got} & {3, 4, 5, 8, 9, 10}
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(odd_docs, items.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 1)
    again = decontaminate.leaks(odd_docs, items).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"][0](spark, sf).collect()
    assert len(rows) == 10_000
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    s, y = np.array(held).T
    order = s.argsort().argsort()
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc >= 0.92
    assert (s[y == 0] >= 0.5).mean() <= 0.02 and (s[y == 1] >= 0.5).mean() >= 0.7


def test_toxicity_scores_equal_brute_force(spark, docs):
    """Scores from lengths that zstandard gives for each single window, one by one."""
    import zstandard

    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    options = zstandard.ZstdCompressionParameters.from_level(
        9, write_content_size=False, write_checksum=False, write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = [zstandard.ZstdCompressionDict(content + toxicity.TAIL,
                                          dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            for content in (model.ordinary, model.toxic)]
    for d in held:
        d.precompute_compress(level=9)
    packers = [zstandard.ZstdCompressor(dict_data=d, compression_params=options) for d in held]
    rows = docs.limit(20).collect()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    for row in rows:
        gains = []
        for w in (row["text"] or "").lower().split():
            for part in [w[a : a + 48] for a in range(0, max(1, len(w) - 8), 40)]:
                data = f" {part} ".encode() + toxicity.TAIL
                a, b = (len(p.compress(data)) for p in packers)
                gains.append(a - b)
        counts = np.array([sum(g >= k for g in gains) for k in range(-4, 16)])
        x = np.array([1, max(gains, default=0), *np.log1p(counts), *(counts / max(1, len(gains)))])
        z = (x - model.mean) / model.scale @ model.weights
        assert got[row["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxic_dictionary_holds_what_toxic_texts_share():
    """Words of one toxic text only, and words that ordinary texts share, are left out."""
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(60)]

    def text(bad):
        own = ["".join(rng.choice(list("klmnopqrst"), 9)) for _ in range(3)]
        words = [*rng.choice(plain, 30), *own]
        return " ".join([*words[:12], bad, *words[12:]])

    bad = ["uvwxyzuvw", "zyxwvzyxw", "", "", "", "", "", ""]
    texts = [text(bad[i % 8]) for i in range(800)]
    model = toxicity.fit_texts(texts, [int(i % 8 < 2) for i in range(800)])
    # a segment may end before the last bytes of a word
    assert b"uvwxyzuv" in model.toxic and b"zyxwvzyx" in model.toxic
    assert not any(w.encode() in model.toxic for w in plain)
    scores = model.scorer().scores([text(bad[i % 8]) for i in range(80)])
    assert [s >= 0.5 for s in scores] == [i % 8 < 2 for i in range(80)]


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (6, 0)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.toxicity(odd_docs, model).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1
    left = toxicity.without_toxic(odd_docs, model)
    assert left.columns == odd_docs.columns and left.count() == sum(r["predicted"] == 0 for r in rows)
    nothing = toxicity.fit(odd_docs, labels.limit(0))
    assert toxicity.toxicity(odd_docs, nothing).count() == 15
    assert toxicity.toxicity(no_docs, nothing).count() == 0


def test_windows_overlap():
    """Every letter sequence of a long word is whole in one of its windows."""
    for n in (1, 47, 48, 49, 90, 91, 132, 133, 500):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        found = toxicity.windows(f"a {word} b")[1:-1]
        assert all(len(w) <= toxicity.WINDOW for w in found)
        k = toxicity.OVERLAP
        assert {word[i : i + k] for i in range(max(1, n - k + 1))} <= {
            w[i : i + k] for w in found for i in range(len(w))}
        assert found[-1].endswith(word[-1]) and found[0].startswith(word[0])


def test_long_labelled_texts_take_part(spark):
    long = "ordinary words " * 4000
    docs = [(i, ("vile slurword " if i % 2 else "kind greeting ") * 3 + (long if i > 150 else ""))
            for i in range(300)]
    docs += [(500 + i, long + "vile slurword " * 20 + long) for i in range(4)]
    labels = [(i, i % 2) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"slurwor" in model.toxic  # a segment may end before the last byte


def test_toxicity_does_not_read_held_out_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(
        toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.toxic == b.toxic and (a.weights == b.weights).all()


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op5_shard_shuffle"][0](spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    shards = collections.defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        shards[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert {len(s) for s in shards.values()} == {25} and len(shards) == 40
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_shuffle_is_uniform(spark, monkeypatch):
    """Over many seeds each row meets each shard and slot equally often; ranges don't matter."""
    df = spark.range(0, 12, 1, 3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = np.zeros((12, 3, 4))
    runs = 60
    for seed in range(runs):
        if seed == 30:
            monkeypatch.setattr(shard_shuffle, "RANGE_ROWS", 2)
        for r in shard_shuffle.shuffle_into_shards(df, 3, seed).collect():
            counts[r["doc_id"], r["shard"], r["slot"]] += 1
    assert (counts.sum(axis=(1, 2)) == runs).all() and (counts.sum(axis=0) == runs).all()
    chi = ((counts - runs / 12) ** 2 / (runs / 12)).sum()
    assert chi < 200  # 121 degrees of freedom


def test_hypergeometric():
    import random

    rng = random.Random(4)
    draws = [shard_shuffle.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    cells = shard_shuffle.matrix([5, 0, 1000, 17], shard_shuffle.even_sizes(1022, 7), 1)
    assert [sum(r) for r in cells] == [5, 0, 1000, 17]
    assert [sum(c) for c in zip(*cells)] == shard_shuffle.even_sizes(1022, 7)
    big = shard_shuffle.matrix([10**9, 10**9], [10**9, 10**9], 1)
    assert abs(big[0][0] - 5 * 10**8) < 10**6


def test_shards_odd_rows(odd_docs, no_docs):
    rows = shard_shuffle.shuffle_into_shards(odd_docs.withColumn("row", F.lit(1)), 4).collect()
    assert len(rows) == 15 and sorted(collections.Counter(r["shard"] for r in rows).values()) == [
        3, 4, 4, 4]
    assert shard_shuffle.shuffle_into_shards(no_docs, 4).count() == 0


MODEL = html_extract.train(labelled_pages())
S = "The wind turned at noon and the boats came home early with little in them."


@pytest.mark.parametrize("page, text", [
    (f"<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>T</h1><p>{S}"
     f'</p><div class="ad">Buy now</div><p>Caf&eacute; &amp; tea&nbsp;x</p></article><section class="comments">'
     f'<h3>Comments</h3><p>{S}</p></section></main><aside class="sidebar"><p>{S}</p></aside></body>',
     f"T\n{S}\nCaf\u00e9 & tea x"),
    (f'<div id="cookie-banner"><p>{S}</p></div><div class="container"><div class="content"><h2>T</h2><p>{S}</p>'
     f'<ul><li>a</li><li>b <b>c</b> d</li></ul></div><div class="sidebar widget"><p>{S}</p></div></div>',
     f"T\n{S}\na\nb c d"),
    (f"<p>{S}</p><p>{S}</p>", f"{S}\n{S}"),
    ("<nav><a href=x>x</a></nav>", ""), ("", ""), ("plain text", "plain text"),
    (f'<article><h1>T</h1><p>One<p>Two<br>three</article><div id="comments">{S}</div><form><p>Sign up</p></form>',
     "T\nOne\nTwo three"),
    (f'<article><p>{S}</p><div class="notice"><p>{S}</p></div><p>end</p><aside>{S}</aside></article>',
     f"{S}\nend"),
    (f"<article><p>{S}<!-- x <p>no</p> --></p><script>var a='</p><p>no';</script><p>&lt;b&gt; &am", f"{S}\n<b> &am"),
])
def test_main_text(page, text):
    assert html_extract.main_text(page, MODEL) == text


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "math", "canvas", "audio",
                                 "video", "noscript"])
def test_unclosed_element_before_article(tag):
    page = f"<body><div class=nav><{tag}></div><article><p>{S}</p></article>"
    assert html_extract.main_text(page, MODEL) == S
    page = f"<body><{tag}><article><p>{S}</p><p>{S}</p></article>"
    assert html_extract.main_text(page, MODEL) == f"{S}\n{S}"


@pytest.mark.parametrize("inside, text", [
    ("<math><mi>x</mi><mo>+</mo><mn>1</mn></math>", "x+1"),
    ("<math display=block><mfrac><mi>a</mi><mi>b</mi></mfrac><mspace/></math>", "ab"),
    ("<noscript>a note</noscript>", "a note"), ("<object data=x>a chart</object>", "a chart"),
    ("<svg><title>t</title><path d=x/><text>label</text></svg>", ""),
    ("<button>Share</button>", ""), ("<select><option>One<option>Two</select>", ""),
    ("<template>slot</template>", ""), ("<iframe><p>no</p></iframe>", ""),
    ("<script>a < b</script>", ""),
])
def test_elements_within_article(inside, text):
    page = f"<body><article><p>{S}</p><p>{S} {inside} {S}</p></article><footer>x</footer>"
    got = html_extract.main_text(page, MODEL)
    assert " ".join(got.split()) == " ".join(f"{S} {S} {text} {S}".split())


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<a " * 100_000, "<a href='" * 50_000 + "<p>x", "<! " * 100_000,
    "<p><b>" * 50_000 + "</i>" * 50_000 + "x", "<svg><g/>" * 30_000, "</p>" * 100_000])
def test_time_grows_with_the_page_only(page):
    half = page[: len(page) // 2]
    html_extract.parse(half[:1000])

    def seconds(text):
        start = time.process_time()
        html_extract.parse(text)
        return time.process_time() - start

    assert seconds(page) < 4 * seconds(half) + 0.5 and seconds(page) < 8


def test_extract_pages(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op9_html_extract"][0](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        body = p["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>|</?b>|<br>", body)]
        r = rows[p["page_id"]]
        assert r["text"] == "\n".join(x for x in parts if x)
        assert r["url"] == p["url"] and r["n_chars"] == len(r["text"])


def test_extract_odd_rows(spark):
    big = "<div>" * 3000 + "<p>deep</p>" + "<p>" + S * 2000
    rows = [(1, None, None), (None, "u", ""), (2, "u", big), (2, "u", big), (3, "u", "<"), (4, "u", "<a href='")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html_extract.extract(df).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == [""]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    """Messages give the exact marginals of a small tree."""
    from itertools import product

    page = html_extract.parse("<article><p>One two.</p><div class='ad'><a href=x>x</a></div></article>")
    n = len(page.nodes)
    total, on = 0.0, np.zeros(n)
    for s in product((0, 1), repeat=n):
        w = MODEL.prior[s[0]]
        for i, node in enumerate(page.nodes):
            x = sum(MODEL.odds.get(t, 0.0) for t in node.traits)
            p = 1 / (1 + np.exp(-max(-30.0, min(30.0, x))))
            w *= p if s[i] else 1 - p
            if i:
                w *= MODEL.share[node.tag == "#text"][s[node.parent]][s[i]]
        total += w
        on += w * np.array(s)
    assert np.allclose(html_extract.marginals(page.nodes, MODEL), on / total)
