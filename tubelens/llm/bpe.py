"""BPE encoding and decoding by batched numpy merge rounds.

All new words of a batch lie end to end in one flat symbol array. A round looks up every adjacent pair
by binary search over the sorted pair keys, takes the lowest rank of each word and merges its
occurrences from left to right; words without a known pair leave the array. Words are encoded once per
batch and kept in a cache of bounded size. The vocabulary (fixed size) is read on the driver from a path and broadcast.

Defined cases: null text counts as empty and has no token; special tokens in a text are taken as their
ids, like the tokenizers library does; repeated rows give repeated rows; other columns are ignored.
"""
from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tubelens.llm.common import documents

CACHE_WORDS = 200_000
SHIFT = np.int64(1 << 20)
#: The file's own split rule comes from its JSON; this is the byte-to-character map of byte-level BPE.
_KEEP = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_chars() -> list[str]:
    out, extra = [], 0
    for b in range(256):
        if b in set(_KEEP):
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Vocabulary:
    """Sorted pair keys with ranks and merged ids, and the token strings."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * int(SHIFT) + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + self.end] for c in chars], dtype=np.int32)
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


def merge_rounds(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of every word (each of one byte at least)."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    sym = v.inner[raw]
    ends = np.cumsum(n)
    sym[ends - 1] = v.last[raw[ends - 1]]
    wid = np.repeat(np.arange(len(words)), n)
    none = np.iinfo(np.int32).max
    done_sym, done_wid = [], []
    while len(sym):
        key = sym[:-1].astype(np.int64) * SHIFT + sym[1:]
        at = np.minimum(np.searchsorted(v.key, key), len(v.key) - 1)
        known = (v.key[at] == key) & (wid[:-1] == wid[1:])
        rank = np.full(len(sym), none, dtype=np.int32)
        rank[:-1][known] = v.rank[at[known]]
        first = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
        over = low == none
        if over.any():
            done_sym.append(sym[over])
            done_wid.append(wid[over])
        hit = (rank == low) & ~over
        # of overlapping occurrences (aaa) every second one, from the left
        pos = np.flatnonzero(hit)
        if len(pos):
            head = np.concatenate([[True], np.diff(pos) != 1])
            run = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            sym[pos] = v.made[at[pos]]
        keep = ~over
        keep[pos + 1] = False
        sym, wid = sym[keep], wid[keep]
    if not done_sym:
        return []
    sym, wid = np.concatenate(done_sym), np.concatenate(done_wid)
    order = np.argsort(wid, kind="stable")
    return np.split(sym[order], np.cumsum(np.bincount(wid, minlength=len(words)))[:-1])


def _ranges(at) -> str:
    """Code points as ranges of a character set."""
    at = np.array(sorted(at), dtype=np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-9) != 1)
    last = np.append(first[1:], len(at)) - 1
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(at[first].tolist(), at[last].tolist()))


@functools.cache
def foreign() -> tuple[str, str, dict[int, str]]:
    """Where the library's Unicode version differs from that of ``regex`` and Python.

    ``(no letters, rare, lower)``: what only ``regex`` counts as letters or digits, this with all letters of another
    lower case (ranges of character sets), and that lower case.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    new = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    split = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(new)
    none = {ord(c) for part, _ in split for c in part}
    low = normalizers.Lowercase().normalize_str
    lower = {ord(c): low(c) for c in new if low(c) != c.lower()}
    return _ranges(none), _ranges(none | lower.keys()), lower


class Encoder:
    """Normalise, split and encode texts; decode ids."""

    def __init__(self, v: Vocabulary):
        self.v, self.cache = v, {}
        self.find = self.find_without = regex.compile(v.pattern).findall
        self.rare, self.odd = None, set()  # words with code points that the library doesn't know
        none, rare, lower = foreign()
        if rare:
            self.rare = regex.compile(f"[{rare}]").search
            less = v.pattern
            for kind in (r"\p{L}", r"\p{N}"):
                less = less.replace(kind, f"[{kind}--[{none}]]" if none else kind)
            find = regex.compile(less, regex.V1).findall
            self.find_without = lambda text: find(text.translate(lower))
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        for s, i in v.special.items():
            assert i < len(v.tokens), s
        self.token = np.array(v.tokens, dtype=object)

    def words(self, text: str, find) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return find(text.lower())

    def split(self, text: str, find=None) -> list:
        """Words, and ids of special tokens."""
        find = find or self.find
        if self.specials is None or "<" not in text or not self.specials.search(text):
            return self.words(text, find)
        out: list = []
        for part in self.specials.split(text):
            out += [self.v.special[part]] if part in self.v.special else self.words(part, find)
        return out

    def _note(self, words: list) -> None:
        if self.rare:
            self.odd.update(w for w in words if isinstance(w, str) and not w.isascii() and self.rare(w))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.odd = {}, set()
        cache = self.cache
        new = [w for w in set().union(*parts) if w not in cache] if parts else []
        self._note(new)
        if self.odd:  # such texts are split again; all others only pay for their new words
            parts = [p if self.odd.isdisjoint(p) else self.split(t, self.find_without) for p, t in zip(parts, texts)]
            new = [w for w in set().union(*parts) if w not in cache]
            self._note(new)
        for w in [w for w in new if isinstance(w, int)]:
            cache[w] = np.array([w], dtype="<u4").tobytes()
        new = [w for w in new if isinstance(w, str)]
        for w, ids in zip(new, merge_rounds(self.v, [w.encode() for w in new])):
            cache[w] = ids.astype("<u4").tobytes()
        return [b"".join([cache[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder."""
        return " ".join(self.token[np.frombuffer(ids, dtype="<u4")].tolist())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _runs(batches, column: str, limit: int = 4 << 20):
    """Lists of row numbers of a batch with about ``limit`` characters each."""
    for b in batches:
        texts = [t or "" for t in b.column(column).to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < limit):
                size += len(texts[j])
                j += 1
            yield b, i, j, texts[i:j]
            i = j


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    box = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path or default_path()))

    def run(batches):
        enc = Encoder(box.value)
        for b, i, j, texts in _runs(batches, "text"):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in enc.encode(texts)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.ListArray.from_arrays(off, pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    box = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path or default_path()))

    def run(batches):
        enc = Encoder(box.value)
        for b in batches:
            ids = [np.array(x or [], dtype="<u4").tobytes() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "text"])

    src = tokens.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode these ids, in one pass."""
    box = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path or default_path()))

    def run(batches):
        enc = Encoder(box.value)
        for b, i, j, texts in _runs(batches, "text"):
            ids = enc.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir))
