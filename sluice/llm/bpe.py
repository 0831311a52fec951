"""Byte-level BPE: texts to ids and back, with the merges of a public tokenizer file.

Texts are cut into words by the tokenizer's pattern. The words of a partition that were not met before are encoded
together: their bytes stand in one array, every pair of neighbours that has a rank is listed under that rank with all its
positions, and the ranks that are active are applied in ascending order. A merge changes the pairs at both its sides only,
which are listed under their own ranks. A pair with a merged token is always of a higher rank (files in which it is not
are refused), so each word sees its merges in the order in which it would take them alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts_of

# fixed value: how byte-level vocabularies cut text before merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a task whose ids are remembered, and the longest of them.
MEMORY, LONGEST = 500_000, 64
#: Code points of a text that are cut into words at a time.
BLOCK = 1 << 20
#: Where a text may be cut without changing its words.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_FIND = regex.compile(PATTERN)
# fixed values: letters and numbers of Unicode versions after 16.0, which the public tokenizers take for neither
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_LATER = regex.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split()) + "]")
_END = -1


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


@dataclass
class Merges:
    """A tokenizer: ``token[id]`` its bytes, ``first[byte]`` the id of a byte, and for each rank the pair (as ``key``, sorted, with
    ``rank``) and the id that it becomes (``into``, by rank); ``special`` maps texts that are one token to their ids."""

    token: list[bytes]
    first: np.ndarray
    key: np.ndarray
    rank: np.ndarray
    into: np.ndarray
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Merges:
        """From a tokenizer file with byte-level words and no normalizer; anything else is refused."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or told.get("normalizer") or any(map(model.get, plain)):
            raise ValueError("only byte-level BPE without a normalizer is read")
        if cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only words by the byte-level pattern are read")
        added = told.get("added_tokens") or []
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take neighbours are not read")
        letters, ids = _byte_letters(), model["vocab"]
        token = [b""] * (max([*ids.values(), *(a["id"] for a in added)]) + 1)
        for text, i in ids.items():
            token[i] = bytes(map(letters.__getitem__, text))
        for a in added:
            token[a["id"]] = a["content"].encode()
        first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            first[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        into = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        made = np.full(len(token), -1)
        made[into[::-1]] = np.arange(len(into))[::-1]
        if np.any(made[key >> 32] >= np.arange(len(key))) or np.any(made[key & 0xFFFFFFFF] >= np.arange(len(key))):
            raise ValueError("a merge stands before those that make its parts")
        return cls(token, first, key[order], order, into, {a["content"]: a["id"] for a in added})

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 without one."""
        if not len(self.key):
            return np.full(len(left), -1)
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; words are not empty."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ids, n = self.first[data], len(data)
        after = np.arange(1, n + 1)
        after[ends - 1] = _END
        before = np.arange(-1, n - 1)
        before[np.append(0, ends[:-1])] = _END
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(at: np.ndarray) -> None:
            """List the pairs that begin at ``at`` under their ranks."""
            at = at[at != _END]
            at = at[after[at] != _END]
            found = self.ranks(ids[at], ids[after[at]])
            at, found = at[found >= 0], found[found >= 0]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.append(0, cuts)].tolist(), np.split(at, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        enlist(np.arange(n))
        key_of = np.empty(len(self.key), np.int64)
        key_of[self.rank] = self.key
        while active:
            r = heapq.heappop(active)
            a, b = int(key_of[r]) >> 32, int(key_of[r]) & 0xFFFFFFFF
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[(ids[at] == a) & (after[at] != _END)]
            at = at[ids[after[at]] == b]
            if a == b and len(at):
                at = self._apart(at, after)
            if not len(at):
                continue
            gone = after[at]
            ids[at], ids[gone] = self.into[r], _END
            following = after[gone]
            after[at] = following
            inner = following != _END
            before[following[inner]] = at[inner]
            enlist(np.unique(np.concatenate([before[at], at])))
        left = ids != _END
        upto = np.append(0, np.cumsum(left))[ends] * 4
        flat = ids[left].astype("<u4").tobytes()
        cut = [0, *upto.tolist()]
        return [flat[x:y] for x, y in zip(cut[:-1], cut[1:])]

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of pairs of one token with itself that overlap, every other one from the left."""
        chained = np.append(False, after[at[:-1]] == at[1:])
        start = np.flatnonzero(~chained)
        run = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        return at[run % 2 == 0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of ``text``, some for each block of it; cut where the pattern cuts in any case."""
    try:
        text.encode("latin-1")  # has none of the later letters
        plain = text
    except UnicodeEncodeError:
        plain = _LATER.sub("\U000EFFFF", text)
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > BLOCK:
            cut = _SAFE.search(plain, at + BLOCK)
            to = cut.start() if cut else to
        if plain is text:
            yield _FIND.findall(text[at:to])
        else:
            yield [text[at + m.start() : at + m.end()] for m in _FIND.finditer(plain[at:to])]
        at = to


class Encoder:
    """Encodes texts of a task; ids of words that were met are remembered up to a bound."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        names = sorted(merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words, in blocks; a special token is a block of its own."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield [part]
            else:
                yield from words_of(part)

    def learn(self, blocks: Iterable[list[str]]) -> None:
        """Encode what is new among the words of ``blocks``, all together."""
        new = set().union(*blocks).difference(self.known)
        fixed = {w: np.array([i], "<u4").tobytes() for w, i in self.merges.special.items()}
        new = sorted(new.difference(fixed))
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = sorted(set().union(*blocks).difference(fixed))
        self.known.update(zip(new, self.merges.encode_words([w.encode() for w in new])))
        self.known.update(fixed)

    def forget(self) -> None:
        """Leave long words out of what is remembered."""
        if len(self.known) > MEMORY:
            self.known = {}
        for w in [w for w in self.known if len(w) > LONGEST]:
            del self.known[w]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; null is empty."""
        out = []
        for words in self.pieces(text or ""):
            self.learn([words])
            out.append(b"".join(map(self.known.__getitem__, words)))
            self.forget()
        return np.frombuffer(b"".join(out), "<u4")


def _ids_of(texts: list[str], encoder: Encoder) -> Iterator[np.ndarray]:
    """The ids of each text; the new words of all of them are encoded together. A text alone is taken block by block."""
    if len(texts) == 1:
        yield encoder.encode(texts[0])
        return
    cut = [[w for words in encoder.pieces(t) for w in words] for t in texts]
    encoder.learn(cut)
    for words in cut:
        yield np.frombuffer(b"".join(map(encoder.known.__getitem__, words)), "<u4")
    encoder.forget()


def _mapped(docs: DataFrame, merges: Merges, doc_id: str, text: str, schema: str, row) -> DataFrame:
    """``row(ids, merges)`` (a tuple of values) of each text behind its id; the tokenizer is broadcast, its size is the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for rows, texts in texts_of(batch.column(1)):
                made = [row(ids, shared.value) for ids in _ids_of(texts, encoder)]
                columns = [pa.array([m[k] for m in made], types[k + 1]) for k in range(len(types) - 1)]
                yield pa.record_batch([batch.column(0)[rows], *columns], names=names)

    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    ).mapInArrow(run, schema)


def encode(docs: DataFrame, merges: Merges, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for each row: the token ids of its whole text, special tokens where the text spells them.

    A null text has no ids. Rows with equal or null ids each keep theirs; an empty table gives an empty one; other columns
    are not read, whatever their names. Texts of any length are read whole, block by block.
    """
    return _mapped(docs, merges, doc_id, text, "doc_id long, ids array<long>", lambda ids, _: (ids.astype(np.int64),))


def decode(tokens: DataFrame, merges: Merges, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the text of each list of ids, special tokens as they are spelled. Null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "text"])

    return tokens.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").cast("array<long>").alias("ids")
    ).mapInArrow(run, "doc_id long, text string")


def _digests(ids: np.ndarray, merges: Merges) -> tuple[int, str, str]:
    back = merges.decode(ids).encode()
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()


def round_trip(docs: DataFrame, merges: Merges, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row: SHA-256 of the ids (little-endian, 32 bits each) and of
    the text that is decoded from them. Rows, nulls and odd tables are taken as in ``encode``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, merges, doc_id, text, schema, _digests)
