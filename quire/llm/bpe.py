"""BPE encoding and decoding with a contiguous rank array.

A word is an array of the ids of its parts and, beside it, the array of the merge
ranks of neighbouring parts. The smallest rank is found by a scan, its two parts
become one and the ranks of the two neighbours are refreshed, until no pair has a
rank. For words of at most SHORT parts the scans stay in a few cache
lines; longer words use the same merges from a heap, so that a text without
spaces isn't quadratic.

The tokenizer file is read by the driver alone and broadcast (its size is that
of its vocabulary, whatever the corpus).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, small_batches, table, trim

SHORT = 48
#: Words and chunks remembered by a worker; a full memory becomes the old one, which the next replaces.
MEMORY = 250_000
END = "</w>"
_NO_RANK = 1 << 60
#: Bits of an id within a pair, and the id of a byte that the vocabulary lacks, which no pair has.
_SHIFT, _UNKNOWN = 32, -1
#: White space of str.split() that the tokenizer's \s isn't.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[^{_SPACE}]+")
# Letters and numbers that Unicode assigned after version 16, whose table the
# tokenizers library reads; the regex module has a newer one. To the library they are neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# Capitals that the library lower-cases and Python's tables don't know, (first, last, first small letter).
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
_CAPITALS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CAPITALS) + "]")
_SMALL = {c: to + c - a for a, b, to in CAPITALS for c in range(a, b + 1)}


def byte_letters() -> list[str]:
    """The printable letter of each byte value in byte-level vocabularies: a
    visible Latin-1 character stands for itself, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in seen else chr(256 + next(hidden)) for b in range(256)]


def load(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    pattern = next(p["pattern"]["Regex"] for p in raw["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "pattern": pattern, "special": {t["content"]: t["id"] for t in raw["added_tokens"]}}


class WordBpe:
    """Encoder and decoder of one tokenizer."""

    def __init__(self, data: dict):
        self.vocab = data["vocab"]
        # Parts are their ids; a pair of them is one number, and its rank leads to the id of the whole.
        self.rank = {self.vocab[a] << _SHIFT | self.vocab[b]: i for i, (a, b) in enumerate(data["merges"])}
        self.merged = [self.vocab[a + b] for a, b in data["merges"]]
        self.special = data["special"]
        pattern = regex.compile(data["pattern"])
        self.split, self.places = pattern.findall, pattern.finditer
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.text_of_id = {i: str(i) for i in self.token}
        self.letter_ids, self.last_ids = ([self.vocab.get(x + end, _UNKNOWN) for x in byte_letters()] for end in ("", END))
        self.cut = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.by_word: dict[str, tuple[int, ...]] = {}
        self.by_chunk: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.old_chunks: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of the parts of word, the end mark on the last."""
        ids = [*map(self.letter_ids.__getitem__, word[:-1]), self.last_ids[word[-1]]]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, whole = self.rank.get, self.merged
        ranks = [get(a << _SHIFT | b, _NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            i = ranks.index(best)
            ids[i] = here = whole[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | here, _NO_RANK)
            if i < len(ranks):
                ranks[i] = get(here << _SHIFT | ids[i + 1], _NO_RANK)
        return ids

    def _merge_long(self, parts: list[int | None]) -> list[int]:
        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] << _SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank.get(parts[x] << _SHIFT | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.by_word.get(word)
        if ids is None:
            ids = self.old_words.get(word)
            if ids is None:
                ids = tuple(self.merge(word.encode()))
                if _UNKNOWN in ids:
                    raise KeyError(word)
            if len(self.by_word) >= MEMORY:
                self.old_words, self.by_word = self.by_word, {}
            self.by_word[word] = ids
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run without white space."""
        ids = self.old_chunks.get(chunk)
        if ids is None:
            # Case is mapped letter by letter: a capital sigma has no final form here.
            small = chunk.lower() if chunk.isascii() else self.fold(chunk)
            words = self.split(small) if small.isascii() or not _NEWER.search(small) else self.split_newer(small)
            if words == [chunk]:
                words = [chunk]  # one string and one tuple serve both memories
            ids = self.word(words[0]) if len(words) == 1 else tuple(chain.from_iterable(map(self.word, words)))
        if len(self.by_chunk) >= MEMORY:
            self.old_chunks, self.by_chunk = self.by_chunk, {}
        self.by_chunk[chunk] = ids
        return ids

    @staticmethod
    def fold(chunk: str) -> str:
        small = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return small.translate(_SMALL) if _CAPITALS.search(small) else small

    def split_newer(self, small: str) -> list[str]:
        """The words if each newer letter is taken for a private character, which is no letter either."""
        return [small[m.start() : m.end()] for m in self.places(_NEWER.sub("\ue000", small))]

    def encode(self, text: str) -> list[int]:
        if self.cut is not None and "<|" in text and (found := list(self.cut.finditer(text))):
            ids, end = [], 0
            for m in found:
                ids += self._plain(text[end : m.start()])
                ids.append(self.special[m[0]])
                end = m.end()
            return ids + self._plain(text[end:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        chunks = _CHUNKS.findall(text) if _CONTROL.search(text) else text.split()
        get, fill, ids = self.by_chunk.get, self.chunk, []
        for c in chunks:
            got = get(c)
            ids += fill(c) if got is None else got
        return ids

    def forget(self) -> None:
        """Drop what is remembered, at the end of a task: a new one fills its memory within seconds."""
        self.by_word, self.by_chunk, self.old_words, self.old_chunks = {}, {}, {}, {}
        trim()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


#: The coder of this worker process; it outlives a task, what it remembers doesn't.
_CODER: dict[str, WordBpe] = {}


def coder(name: str, data: dict) -> WordBpe:
    if name not in _CODER:
        _CODER.clear()
        _CODER[name] = WordBpe(data)
    return _CODER[name]


def _shared(docs: DataFrame, path: str):
    """A function that gives a worker its coder, made from broadcast data."""
    small_batches(docs.sparkSession)
    data = load(path)
    name = hashlib.sha256(json.dumps([data["merges"], data["special"], data["pattern"]]).encode()).hexdigest()
    data = docs.sparkSession.sparkContext.broadcast(data)
    return lambda: coder(name, data.value)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each of docs; a null or empty text has no ids."""
    get = _shared(docs, path)

    def run(batches):
        bpe = get()
        for b in (part for batch in batches for part in slices(batch, 1000)):
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for each row of encoded(doc_id, ids); null ids give an empty text."""
    get = _shared(encoded, path)

    def run(batches):
        bpe = get()
        for b in (part for batch in batches for part in slices(batch, 1000)):
            texts = [bpe.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each of docs.

    Whole texts, whatever their length, are encoded and the ids decoded again in
    one pass, so that ids never leave the worker. Repeated rows repeat; null is empty.
    """
    get = _shared(docs, path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        bpe = get()
        shown = bpe.text_of_id.__getitem__
        for b in (part for batch in batches for part in slices(batch, 1000)):
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text"):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(shown, ids))))
                text_sha.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(table(spark, sf_dir, "documents"), default_path())
