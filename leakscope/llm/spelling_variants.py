"""Words one edit apart, by finite-state composition of vocabulary acceptors.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The
pairs are those that acceptor o one-edit transducer o acceptor accepts. The transducer copies,
edits at the first difference only, and copies again, so each pair has exactly one accepting path.

The composition is split by its initial states. For words of lengths c and c + 1 the edit lies in
one of the segments [0, c / 2) and [c / 2, c]; both words then agree on the code points before the
segment and on those behind it, so a partition holds the words of these lengths that share such a
head and tail, and starts from the product state behind the head. Within a partition the middles
are compiled into a minimal acyclic acceptor and the accepted pairs are enumerated by walking it
against itself. Partitions of very many words are split again by halving their segment until they
are small or the segment is one code point long, where the alphabet bounds them.
"""

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import mapped, written

# Distinct words that a task counts before it hands on their partial counts.
HELD_WORDS = 200_000
# Bytes of a text that are cut into words at a time; a longer word makes its stretch longer.
STRETCH = 1 << 20
# Words of a partition that is not split further.
PARTITION = 50_000

# One byte for each code point up to U+00FF: letters of the alphabet (A-Z as a-z), else a blank.
_ALPHABET = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _stretches(text: str):
    data = text.encode("latin-1", "replace").translate(_ALPHABET)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + STRETCH)
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


def misspelt(doc_id: str, word: bytes, every: int) -> bytes:
    """The word, or with one letter left out where `every` divides the crc32 of `doc_id:word`."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(),
                   zlib.crc32(f"{doc_id}:".encode()))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, shortest: int, least: int, every: int | None = None) -> DataFrame:
    """(word, n): words of whole texts with at least `shortest` letters and `least` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. With
    `every`, letters are first left out as `misspelt` says. A null text has no words, a null doc_id
    counts as an empty one, repeated rows count each time and other columns are ignored. Tasks sum
    a bounded number of words before the shuffle; long texts are read in stretches.
    """
    schema = "word string, n long"

    def run(batches):
        def batch(total):
            return pa.RecordBatch.from_pydict({
                "word": pa.array([w.decode("latin-1") for w in total], pa.string()),
                "n": pa.array(list(total.values()), pa.int64())})

        total: dict[bytes, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    for stretch in _stretches(text.as_py() or ""):
                        words = Counter([w for w in stretch.split() if len(w) >= shortest])
                        if every:
                            prefix = zlib.crc32(f"{doc_id}:".encode())
                            for w, n in words.items():
                                h = zlib.crc32(
                                    w if w.isascii() else w.decode("latin-1").encode(), prefix)
                                if not h % every:
                                    w = misspelt(doc_id, w, every)
                                    if len(w) < shortest:
                                        continue
                                total[w] = total.get(w, 0) + n
                        else:
                            for w, n in words.items():
                                total[w] = total.get(w, 0) + n
                        if len(total) > HELD_WORDS:
                            yield batch(total)
                            total = {}
        if total:
            yield batch(total)

    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return mapped(texts, run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= least)


def acceptor(words) -> tuple[list, int]:
    """States (final, {letter: state}) of the minimal acyclic acceptor of sorted distinct words,
    and the initial one."""
    states, register = [], {}
    path, last = [[False, {}]], ""

    def close(depth: int):
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs.items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append((final, arcs))
            path[-1][1][last[len(path) - 1]] = state

    for word in words:
        depth = 0
        for a, b in zip(last, word):
            if a != b:
                break
            depth += 1
        close(depth)
        path.extend([False, {}] for _ in word[depth:])
        path[-1][0], last = True, word
    close(0)
    states.append(tuple(path[0]))
    return states, len(states) - 1


def _common(states: list, p: int, q: int, length: int, unlike: str):
    """Words of a length that both states accept and that do not begin with the letter `unlike`."""
    walks = [(p, q, "")]
    while walks:
        p, q, word = walks.pop()
        if len(word) == length:
            if states[p][0] and states[q][0]:
                yield word
            continue
        arcs, others = states[p][1], states[q][1]
        if len(others) < len(arcs):
            arcs, others = others, arcs
        for letter in arcs:
            if letter in others and (word or letter != unlike):
                walks.append((states[p][1][letter], states[q][1][letter], word + letter))


def compose(words, span: int, last: bool):
    """Pairs (x, y) of sorted distinct words of `span` and `span` + 1 letters that are one edit
    apart, x of `span` letters; the first difference lies within `span` letters, or behind them if
    `last`."""
    states, start = acceptor(words)
    walks = [(start, "")]
    while walks:
        state, head = walks.pop()
        depth, arcs = len(head), states[state][1]
        if depth < span:
            letters = list(arcs)
            for i, a in enumerate(letters):
                for b in letters[i + 1 :]:
                    for tail in _common(states, arcs[a], arcs[b], span - depth - 1, ""):
                        yield head + a + tail, head + b + tail
        if depth < span or last and depth == span:
            for a, to in arcs.items():
                for tail in _common(states, state, to, span - depth, a):
                    yield head + tail, head + a + tail
            walks += [(to, head + a) for a, to in arcs.items()]


def _keyed(words: DataFrame, cuts: Column) -> DataFrame:
    """A row for each word and cut (c, low, high) with the partition's key and the word's middle."""
    rows = words.select("*", F.explode(cuts).alias("cut")).select("*", "cut.*").drop("cut")
    head = F.expr("substring(word, 1, low)")
    tail = F.expr("substring(word, length(word) - c + high + 1)")
    return rows.withColumns({
        "middle": F.expr("substring(word, low + 1, length(word) - c + high - low)"),
        "key": F.concat_ws(":", "c", "low", "high", F.concat(head, tail)),
    })


def _partitions(words: DataFrame, limit: int) -> DataFrame:
    """Rows of all partitions that may hold a pair, with word, n, c, low, high, middle and key."""
    cut = ("struct(cast({0} as int) as c, cast({1} as int) as low, cast({2} as int) as high)")
    halves = [cut.format(c, low, high) for c in ("length(word)", "length(word) - 1")
              for low, high in ((0, f"({c}) div 2"), (f"({c}) div 2", c))]
    first = F.expr(f"filter(array({', '.join(halves)}), x -> x.c > 0 and x.high > x.low)")
    halved = F.expr("array(" + ", ".join(
        cut.format("c", low, high)
        for low, high in (("low", "(low + high) div 2"), ("(low + high) div 2", "high"))) + ")")
    rows, ready = _keyed(words.where("word != ''"), first), None
    while True:
        sizes = rows.groupBy(F.col("key").alias("k")).agg(
            F.count("*").alias("size"), F.sum((F.length("word") == F.col("c")).cast("long"))
            .alias("shorter")).where("size > 1 and shorter > 0")
        sized = written(rows.join(sizes, F.col("key") == F.col("k")).drop("k", "shorter"),
                        "spelling-partitions")
        large = (F.col("size") > limit) & (F.col("high") - F.col("low") > 1)
        done = sized.where(~large).drop("size")
        ready = done if ready is None else ready.unionByName(done)
        rest = sized.where(large)
        if rest.isEmpty():
            return ready
        rows = _keyed(
            rest.select("word", "n", halved.alias("cuts")), F.col("cuts")).drop("cuts")


def _groups(batches):
    """(rows of one partition) from sorted batches of key, middle, word, n, span, last."""
    key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            columns = [c.to_pylist() for c in batch.slice(at, 4096).columns]
            for row in zip(*columns):
                if row[0] != key:
                    if held:
                        yield held
                    key, held = row[0], []
                held.append(row)
    if held:
        yield held


def _pairs_of(held):
    """Pairs of (word, n) of one partition that are near."""
    words = {middle: (word, n) for _, middle, word, n, _, _ in held}
    for x, y in compose(words, held[0][4], held[0][5]):
        yield words[x], words[y]


def _enumerated(words: DataFrame, limit: int, run, schema: str) -> DataFrame:
    return mapped(
        _partitions(words, limit).repartition("key").sortWithinPartitions("key", "middle").select(
            "key", "middle", "word", "n", (F.col("high") - F.col("low")).alias("span"),
            (F.col("high") == F.col("c")).alias("last")), run, schema)


def near_pairs(words: DataFrame, limit: int = PARTITION) -> DataFrame:
    """(a, b): each pair of near words once, for a table (word, n) of distinct words."""
    schema = "a string, b string"

    def run(batches):
        out = []
        for held in _groups(batches):
            out += [(x[0], y[0]) for x, y in _pairs_of(held)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string()) for c in zip(*out)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in zip(*out)], names=["a", "b"])

    return _enumerated(words, limit, run, schema)


def _neighbours(words: DataFrame, limit: int) -> DataFrame:
    """(word, n_near, best_n, best): near words within one partition, summed there."""
    schema = "word string, n_near long, best_n long, best string"
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                names=["word", "n_near", "best_n", "best"])

        out = []
        for held in _groups(batches):
            found: dict = {}
            for x, y in _pairs_of(held):
                for (word, _), (near, n) in ((x, y), (y, x)):
                    count, best = found.get(word, (0, (1, "")))
                    found[word] = count + 1, min(best, (-n, near))
            out += [(w, count, -least, near) for w, (count, (least, near)) in found.items()]
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return _enumerated(words, limit, run, schema)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word that has a form.

    Pointers double in each round, so the rounds grow with the logarithm of the longest chain; a
    form has several times its word's occurrences, so there are no cycles.
    """
    up = written(forms.select(F.col("word").alias("w"), F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("w").alias("v"), F.col("root").alias("next"))
        joined = written(
            up.join(further, F.col("root") == F.col("v"), "left").select(
                "w", F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved")), "roots")
        up = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return up


def variant_groups(words: DataFrame, ratio: int = 5, limit: int = PARTITION) -> DataFrame:
    """Each word of a table (word, n) with its form and root: word, form, root, n, n_near, form_n.

    The form is the near word of largest n (ties: the smallest in code-point order) if that n is
    at least `ratio` times the word's; the root is the last word that forms lead to, or the word.
    Words are distinct and not null; an empty table gives none. All pairs of near words are found,
    each once; no task holds more than a partition of the composition.
    """
    words = written(words.select("word", "n"), "spelling-words")
    near = _neighbours(words, limit).groupBy(F.col("word").alias("w")).agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("best"))
    strong = -F.col("best.least") >= F.col("n") * ratio
    forms = written(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", F.when(strong, F.col("best.best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, -F.col("best.least")).alias("form_n")), "spelling-forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
