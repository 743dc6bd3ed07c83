"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree hold, for each symbol of a word, the rank of the pair it forms with its right
neighbour.  An inner node holds the smaller of its children, the left one on a tie, so that the root
names the leftmost pair of the lowest rank.  A merge changes three leaves, each update costs the height
of the tree, and the word is done when the root holds no pair: ``n log n`` for a word of ``n`` symbols,
however long.  The trees of short words are kept side by side in one array and merged in step.
Plain texts are split side by side too, as bytes of one array, and only the different words are taken out of it.

The vocabulary file is the JSON of the ``tokenizers`` library.  Its normalizer and its splitter
prepare a piece of text; merging and decoding are done here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_PAIR = 1 << 62
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: What a task remembers of the words it has met, in words and in characters.
REMEMBERED = 200_000
REMEMBERED_LENGTH = 8 << 20

#: Words of up to so many bytes are merged side by side, so many at once (some 2 kB each while they are); texts are
#: taken in groups of so many bytes.
SHORT = 32
SIDE_BY_SIDE = 4096
TOGETHER = 2 << 20

# Texts of these characters need no normalization but lower case, and split by this pattern: printable
# ASCII, its white space, and the letters (and two signs) of Latin-1.
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xc0-\xff]*")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d a-z0-9\xdf-\xf6\xf8-\xff]+")
# The same split for all texts at once: what each Latin-1 byte is, and the letters that make a word with an apostrophe.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20]] = _SPACE
_CLASS[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_ONE = np.isin(np.arange(256), list(b"stmd"))
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def _special(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec.get("added_tokens", ())}


def plain_words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of lower-cased plain texts in Latin-1, as ``_PLAIN_WORDS`` finds them, and how many of them there are
    up to the end of each text."""
    data = np.frombuffer(b" ".join([*texts, b"  "]), np.uint8)  # at least two places follow each text's last one
    kind = _CLASS[data]
    starts = np.empty(len(data), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == _DIGIT
    # An apostrophe within a run of other signs belongs to the run; a run that it begins may be a word of its own.
    quotes = np.flatnonzero(data == 0x27)
    quotes = quotes[starts[quotes]]
    one, two = data[quotes + 1], data[quotes + 2]
    short = _ONE[one]
    long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
    quotes, after = quotes[short | long], np.where(short, 2, 3)[short | long]
    starts[quotes + 1] = False
    after += quotes
    starts[after] |= kind[after] == _LETTER
    inside = kind != _SPACE
    starts &= inside
    places = np.flatnonzero(starts)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    # Without the white space the words follow each other.
    kept = data[inside]
    offsets = np.append(np.flatnonzero(starts[inside]), len(kept)).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), buffers), np.searchsorted(places, ends)


def _shown(words: pa.LargeBinaryArray) -> list[str]:
    """Words in Latin-1 as text; ``words`` is no slice."""
    _, offsets, data = words.buffers()
    if not len(words):
        return []
    whole = data.to_pybytes().decode("latin-1")
    places = np.frombuffer(offsets, np.int64)[: len(words) + 1].tolist()
    return [whole[a:b] for a, b in zip(places, places[1:], strict=False)]


@cache
def tokens(path: str) -> dict[int, bytes]:
    """The text of every id, special ones included: all that decoding needs of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec.get("decoder"):
        raise ValueError("only vocabularies without a decoder are supported")
    known = {i: t.encode() for t, i in spec["model"]["vocab"].items()}
    return {**known, **{i: t.encode() for t, i in _special(spec).items()}}


class Vocabulary:
    """Merges and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError(f"not a plain BPE vocabulary: {path}")
        ids: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + end] for x in letters], np.int64)
        self.bytes_of = {ord(x): bytes([b]) for b, x in enumerate(letters)}

        self.special = _special(spec)
        # Where special tokens overlap, the longest one counts.
        found = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_text = re.compile(f"({found})") if found else None

        library = Tokenizer.from_file(path)
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        pattern = _PLAIN_PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        self._plain = pattern and kinds == ["NFC", "Replace", "Lowercase"]
        self._pairs()

    def _pairs(self) -> None:
        """The merges as a hash table of arrays, with the rank of each pair and the token it makes."""
        size = 1 << (4 * len(self.merges)).bit_length()
        self._shift = np.uint64(64 - size.bit_length() + 1)
        self._keys, self._ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.made = np.array([new for _, new in self.merges.values()] or [0], np.int64)
        for (a, b), (rank, _) in self.merges.items():
            key = a << 32 | b
            at = (key * int(_SPREAD) & (1 << 64) - 1) >> int(self._shift)
            while self._keys[at] >= 0:
                at = (at + 1) % size
            self._keys[at], self._ranks[at] = key, rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1 where it is none; a negative id stands for no symbol."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        at = ((keys.view(np.uint64) * _SPREAD) >> self._shift).view(np.int64)
        there = self._keys[at]
        found = np.where(there == keys, self._ranks[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self._keys)
            there = self._keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self._ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def is_plain(self, text: str) -> bool:
        return self._plain and _PLAIN.fullmatch(text) is not None and "<|" not in text

    def words(self, piece: str) -> list[str]:
        """The words of a piece of text that are merged one by one, normalized."""
        if self._plain and _PLAIN.fullmatch(piece):
            return _PLAIN_WORDS.findall(piece.lower())
        split = self._splitter.pre_tokenize_str(self._normalizer.normalize_str(piece))
        return [b"".join(map(self.bytes_of.__getitem__, map(ord, w))).decode() for w, _ in split]

    def parts(self, piece: str) -> list[str]:
        """Words, and special tokens between them."""
        if "<" not in piece or not self.special_text:
            return self.words(piece)
        found: list[str] = []
        for part in self.special_text.split(piece):
            if part in self.special:
                found.append(part)
            elif part:
                found += self.words(part)
        return found

    def packed(self, words: list[str]) -> list[bytes]:
        """Packed ids of words and special tokens."""
        found = self.merged_all([w.encode() for w in words])
        if not self.special.keys().isdisjoint(words):
            for k, word in enumerate(words):
                if word in self.special:
                    found[k] = self.special[word].to_bytes(4, "little")
        return found

    def symbols(self, word: bytes) -> list[int]:
        """Ids of the word's bytes; the last one carries the word end."""
        codes = np.frombuffer(word, np.uint8)
        return [*self.inner[codes[:-1]].tolist(), int(self.last[codes[-1]])]

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word: merge the leftmost pair of the lowest rank until none is left."""
        ids = self.symbols(word)
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        base = 1 << (n - 1).bit_length()
        tree = [_NO_PAIR] * (2 * base)

        def leaf(i: int, j: int) -> int:
            # rank first, then place: the smallest key is the leftmost pair of the lowest rank
            found = merges.get((ids[i], ids[j])) if j < n else None
            return _NO_PAIR if found is None else found[0] * base + i

        for i in range(n - 1):
            tree[base + i] = leaf(i, i + 1)
        for k in range(base - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, key: int) -> None:
            k = base + i
            if tree[k] == key:
                return
            tree[k] = key
            while k > 1:
                k >>= 1
                key = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == key:
                    return
                tree[k] = key

        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        gone = bytearray(n)
        while tree[1] != _NO_PAIR:
            i = tree[1] % base
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            gone[j] = 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, _NO_PAIR)
            put(i, leaf(i, k))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [t for t, out in zip(ids, gone, strict=True) if not out]

    def merged_together(self, words: list[bytes], base: int) -> list[bytes]:
        """Packed ids of many words of at most ``base`` bytes, a power of two: the trees of :meth:`merged`
        as rows of one array, each step merging the root's pair in every row that still has one."""
        rows, wide = len(words), base + 1  # the last column stands for "no neighbour"
        none = np.int32(2**31 - 1)
        n = np.fromiter(map(len, words), np.int32, rows)
        inside = np.arange(base, dtype=np.int32) < n[:, None]
        codes = np.zeros((rows, base), np.uint8)
        codes[inside] = np.frombuffer(b"".join(words), np.uint8)
        every = np.arange(rows)
        ids2 = np.full((rows, wide), -1, np.int32)
        ids2[:, :base] = np.where(inside, self.inner[codes], -1)
        ids2[every, n - 1] = self.last[codes[every, n - 1]]
        tree2 = np.full((rows, 2 * base), none, np.int32)
        rank = self.ranks(ids2[:, : base - 1].ravel(), ids2[:, 1:base].ravel()).reshape(rows, -1)
        tree2[:, base : 2 * base - 1] = np.where(rank >= 0, rank * base + np.arange(base - 1), none)
        for k in range(base - 1, 0, -1):
            tree2[:, k] = np.minimum(tree2[:, 2 * k], tree2[:, 2 * k + 1])
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), rows)
        before = np.tile(np.arange(-1, base, dtype=np.int32), rows)
        ids, tree = ids2.ravel(), tree2.ravel()  # views: cells are addressed by row * width + column

        def leaves(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            rank = self.ranks(ids[row + i], ids[row + j])
            return np.where(rank >= 0, rank * base + i, none).astype(np.int32)

        at = every
        while len(at := at[tree[at * (2 * base) + 1] != none]):
            row, top = at * wide, at * (2 * base)
            root = tree[top + 1]
            i = root % base
            j = after[row + i]
            k = after[row + j]
            p = before[row + i]
            ids[row + i] = self.made[root // base]
            ids[row + j] = -1
            after[row + i] = k
            before[row + k] = i
            tree[top + base + j] = none
            tree[top + base + i] = mine = leaves(row, i, np.minimum(k, base))
            first = p < 0
            p = np.where(first, i, p)
            tree[top + base + p] = np.where(first, mine, leaves(row, p, i))
            for place in (j, i, p):
                node = (base + place) >> 1
                while node[0]:  # all leaves are equally deep
                    left = top + 2 * node
                    tree[top + node] = np.minimum(tree[left], tree[left + 1])
                    node >>= 1
        alive = ids2 >= 0
        packed = ids2[alive].astype("<u4").tobytes()
        ends = (4 * alive.sum(axis=1)).cumsum().tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of every word."""
        found: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(length > SHORT).tolist():
            found[k] = np.array(self.merged(words[k]), "<u4").tobytes()
        base, above = 2, 0
        while above < SHORT:
            places = np.flatnonzero((length > above) & (length <= min(base, SHORT))).tolist()
            for at in range(0, len(places), SIDE_BY_SIDE):
                some = places[at : at + SIDE_BY_SIDE]
                done = self.merged_together([words[k] for k in some], base)
                for k, packed in zip(some, done, strict=True):
                    found[k] = packed
            base, above = 2 * base, base
        return found


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts word by word and remembers the ids of words met before.

    Texts of plain characters are split side by side, and only the different words among theirs are looked up.  Any
    other text is taken by its pieces between ASCII white space, over which no word of the vocabulary's splitter
    reaches.  A full memory keeps what is met at that time: it bounds space, not results.
    """

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _group(self, texts: list[bytes]) -> list[bytes]:
        plain: dict[int, bytes] = {}
        split: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            whole = text.decode()
            if self.vocabulary.is_plain(whole):
                plain[k] = whole.lower().encode("latin-1")
            else:
                split[k] = [w for piece in text.split() for w in self.vocabulary.parts(piece.decode())]
        words, ends = plain_words(list(plain.values()))
        words = words.dictionary_encode()
        different = _shown(words.dictionary)
        self._meet(set(different).union(*split.values()))
        known, found = self.known, [b""] * len(texts)
        ids = pa.array([known[w] for w in different], pa.large_binary()).take(words.indices)
        if len(ids):
            places = np.frombuffer(ids.buffers()[1], np.int64)[[0, *ends]].tolist()
            data = memoryview(ids.buffers()[2])
            for k, a, b in zip(plain, places, places[1:], strict=False):
                found[k] = bytes(data[a:b])
        for k, some in split.items():
            found[k] = b"".join([known[w] for w in some])
        return found

    def _meet(self, met: set[str]) -> None:
        """Remember the ids of all of ``met``."""
        new = met.difference(self.known)
        if self.known and (len(self.known) + len(new) > REMEMBERED or self.size > REMEMBERED_LENGTH):
            self.known = {w: self.known[w] for w in met.difference(new)}
            self.size = sum(map(len, self.known))
        words = list(new)
        self.known.update(zip(words, self.vocabulary.packed(words), strict=True))
        self.size += sum(map(len, words))

    def texts(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Packed ids of every text, in order: little-endian unsigned 32-bit integers."""
        group, size = [], 0
        for text in texts:
            group.append(text or b"")
            size += len(group[-1])
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def text(self, text: str | None) -> bytes:
        return next(self.texts([text.encode() if text else None]))


def encoded(text: Column, path: str) -> Column:
    """Token ids of the whole text, binary: little-endian unsigned 32-bit integers.

    ``path`` is the vocabulary file, which every executor must have.  Special tokens that stand in the
    text become their ids, none are added.  Null and empty texts give no ids.
    """

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for batch in batches:
            texts = (t.as_py() for t in batch.cast(pa.binary()))
            yield pa.array(list(encoder.texts(texts)), pa.binary())

    return ids(text)


def _joined(packed: bytes | None, known: dict[int, bytes]) -> bytes | None:
    if packed is None:
        return None
    ids = np.frombuffer(packed, "<u4").tolist()
    try:
        return b" ".join([known[i] for i in ids])
    except KeyError:
        return b" ".join([known[i] for i in ids if i in known])


def decoded(ids: Column, path: str) -> Column:
    """Text of binary ids as :func:`encoded` returns them; null ids give null.

    The tokens, special ones included, are joined by spaces, as the library does for a vocabulary
    that names no decoder.  Ids outside the vocabulary are left out.
    """

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = tokens(path)
        for batch in batches:
            yield pa.array([_joined(b.as_py(), known) for b in batch], pa.string())

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """``ids`` of :func:`encoded` and ``decoded``, their text as of :func:`decoded`, by one worker of a task."""
    made = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("ids binary, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, known = Encoder(path), tokens(path)
        for batch in batches:
            packed = list(encoder.texts(t.as_py() for t in batch.cast(pa.binary())))
            columns = pa.array(packed, pa.binary()), pa.array((_joined(b, known) for b in packed), pa.string())
            yield pa.StructArray.from_arrays(columns, fields=list(made))

    return both(text)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")
