"""Token ids and token counts of whole texts, worked out once for each distinct unit of text.

A unit is a stretch of text that the tokenizer's own pre-tokenizer never crosses, so that the ids
of a text are the ids of its units, one after another. Each Python worker keeps the units it has
met lately, in bounded memory; texts for which the rule does not hold (special strings of the
vocabulary, rare separators) are encoded directly.

For vocabularies that drop white space the units of many texts are cut, made distinct and joined
to their ids as arrays, so that only distinct units become Python objects.
"""

import gc
import os
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa

from leakscope.llm import memory

# Units that a generation holds; the last two generations are kept.
KEPT_UNITS = 200_000
LONG_UNIT = 200

#: Blank to Python's str but not to the tokenizers' patterns.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACED = re.compile(r"\s*\S+|\s+")

# Text in which Python's character classes agree with the vocabularies' patterns and which is its
# own composed form: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
# How the two vocabularies cut plain text into pre-tokens.
_SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"
_BARE = re.compile(rf"{_SHORT_FORMS}|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_WITH_BLANK = re.compile(
    rf"{_SHORT_FORMS}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

# Kinds of bytes: blanks, letters, digits, marks; bytes of other characters.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _BLANK
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[128:] = _OTHER
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"

_units: dict = {}
memory.store(_units.clear)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Visible bytes stand for themselves, the others, in order, for the letters from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Units:
    """Ids of distinct units for one vocabulary file of the `tokenizers` library.

    `spaced`: a unit is white space with the word behind it (byte-level vocabularies, which keep
    white space); else a lower-case pre-token, or a word with characters beyond ASCII as it stands
    (vocabularies that drop white space and case). `code`: struct code
    of an id, or None to keep the number of ids only.
    """

    def __init__(self, path: str, spaced: bool, code: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.code = spaced, code
        self.known, self.older = {}, {}
        self.letters = _letters()

    def _value(self, ids: list[int]):
        return len(ids) if self.code is None else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _encode(self, text: str):
        return self._value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _unit(self, unit: str):
        """Plain units: the vocabulary's merges on each pre-token. Others: the whole tokenizer."""
        merged = self.model.tokenize
        if not self.spaced and unit.isascii() and unit.isalpha():
            return self._value([t.id for t in merged(unit.lower())])
        if not _PLAIN.fullmatch(unit):
            return self._encode(unit)
        ids = []
        for part in (_WITH_BLANK.findall(unit) if self.spaced else _BARE.findall(unit.lower())):
            spelled = part.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in merged(spelled)]
        return self._value(ids)

    def _direct(self, text: str) -> bool:
        """Whether a text has to be encoded as a whole."""
        return bool(_SEPARATORS.search(text)) or any(s in text for s in self.specials)

    def of(self, texts: list[str]) -> list:
        """For each text the bytes of its ids, or their number."""
        gc.disable()  # very many small objects, none of them in a cycle
        try:
            return self._of(texts) if self.spaced else self._of_bare(texts)
        finally:
            gc.enable()

    def _of(self, texts: list[str]) -> list:
        split = [None if self._direct(t) else _SPACED.findall(t) for t in texts]
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {u for us in split if us for u in us if u not in known}
        for u in new:
            value = older.get(u)
            known[u] = self._unit(u) if value is None else value
        out = []
        for t, us in zip(texts, split):
            if us is None:
                out.append(self._encode(t))
            elif self.code is None:
                # frequencies of the text's distinct units, joined to the counts of the units
                out.append(sum(known[u] * n for u, n in Counter(us).items()))
            else:
                out.append(b"".join([known[u] for u in us]))
        for u in new:
            if len(u) > LONG_UNIT:
                del known[u]
        return out

    def _values(self, distinct: list[str]) -> list:
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, distinct))
        new = [i for i, value in enumerate(out) if value is None]
        # in order, as neighbours take the same merges
        for i in sorted(new, key=distinct.__getitem__):
            u = distinct[i]
            value = older.get(u)
            out[i] = value = self._unit(u) if value is None else value
            if len(u) <= LONG_UNIT:
                known[u] = value
        return out

    def _of_bare(self, texts: list[str]) -> list:
        direct = {i: self._encode(t) for i, t in enumerate(texts) if self._direct(t)}
        encoded = [b"" if i in direct else t.encode() for i, t in enumerate(texts)]
        units, ends = bare_units(encoded)
        units = units.dictionary_encode()
        values = self._values(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = units.indices.to_numpy()
        if self.code is None:
            ends = np.append(0, np.cumsum(np.array(values, np.int64)[which]))[ends]
            out = np.diff(ends, prepend=0).tolist()
        else:
            kind = np.dtype(f"<{self.code}")
            size = np.array([len(v) for v in values], np.int64) // kind.itemsize
            first = np.cumsum(size) - size
            size, first = size[which], first[which]
            after = np.cumsum(size)
            at = np.repeat(first - after + size, size)
            at += np.arange(len(at))
            ids = np.frombuffer(b"".join(values), kind)[at].tobytes()
            ends = (np.append(0, after)[ends] * kind.itemsize).tolist()
            out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for i, value in direct.items():
            out[i] = value
        return out


def bare_units(texts: list[bytes]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Units of UTF-8 texts without white space, and how many there are up to each text's end.

    A unit is a pre-token of ASCII text, in lower case: a run of letters or of marks, a digit, or
    a short form. Words with other characters are one unit each, as they stand.
    """
    data = np.frombuffer(b"\n".join([*texts, b"   "]), np.uint8)  # room to look ahead
    ends = np.cumsum([len(t) + 1 for t in texts])
    kinds = _KINDS[data]
    filled = kinds != _BLANK
    starts = filled & (kinds == _DIGIT)
    starts[0] = filled[0]
    starts[1:] |= filled[1:] & (kinds[1:] != kinds[:-1])
    lower = _LOWER[data]

    # "'s" at the start of a run of marks: the run ends there, and letters behind it start anew
    at = np.flatnonzero(starts & (data == ord("'")))
    one, two = lower[at + 1], lower[at + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))
              | (two == ord("l")) & (one == ord("l")))
    for which, length in ((single, 2), (double, 3)):
        starts[at[which] + 1] = False
        behind = at[which] + length
        starts[behind] |= filled[behind]

    other = np.flatnonzero(kinds == _OTHER)
    if len(other):
        edges = np.flatnonzero(np.diff(filled, prepend=False))
        # words and blanks in turn
        words = np.unique(np.searchsorted(edges, other, "right") - 1)
        inside = np.zeros(len(data), np.int8)
        inside[edges[words]], inside[edges[words + 1]] = 1, -1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        starts &= ~inside
        starts[edges[words]] = True
        lower = np.where(inside, data, lower)

    counts = np.searchsorted(np.flatnonzero(starts), ends)
    bare = lower[filled]
    offsets = np.append(np.flatnonzero(starts[filled]), len(bare))
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(bare)), counts


def units(path: str, spaced: bool, code: str | None) -> Units:
    """The units that this Python process keeps for a vocabulary; tasks in turn share them."""
    key = (path, spaced, code)
    if key not in _units:
        _units[key] = Units(*key)
    return _units[key]


def parts(batches, chunk: int = 4 << 20):
    """(rows of the other columns, texts) of Arrow batches whose last column is the text.

    A part holds a bounded number of characters; a longer text is a part of its own. Null texts
    are empty.
    """
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        texts = [t or "" for t in columns[-1]]
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chunk or i == len(texts) - 1:
                yield [c[at : i + 1] for c in columns[:-1]], texts[at : i + 1]
                at, size = i + 1, 0


# Characters of a pre-token from which a text is left to the library whose merges take no square time.
LONG_TOKEN = 1000


def has_long_token(text: str) -> bool:
    """Whether a stretch without blanks, or possibly one of blanks only, is so long."""
    lengths = list(map(len, text.split()))
    blanks = len(text) - sum(lengths) - len(lengths)
    return blanks >= LONG_TOKEN or max(lengths, default=0) >= LONG_TOKEN


class Ranks:
    """Ids of whole texts by a vocabulary that is given both as ranks and as a tokenizer file.

    Both give the same ids; special strings in a text are special tokens in both.
    """

    def __init__(self, ranks: str, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
            special_tokens={t.content: i for i, t in
                            self.tokenizer.get_added_tokens_decoder().items()})

    def of(self, text: str) -> np.ndarray:
        if has_long_token(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def ranks(ranks_path: str, path: str) -> Ranks:
    """The encoder that this Python process keeps for a vocabulary."""
    key = (ranks_path, path)
    if key not in _units:
        _units[key] = Ranks(*key)
    return _units[key]


def as_ids(data: bytes, code: str) -> np.ndarray:
    return np.frombuffer(data, {"H": "<u2", "I": "<u4"}[code])
