"""Token counts: a map-side two-tier lookup, no shuffle of pre-tokens.

Tier one is a compact table of frequent pre-token lengths, broadcast; tier two is a cache in each Python worker
that encodes what tier one lacks. A text is cut in front of every space that follows a non-space: a byte-level BPE
with the usual pattern never joins across that cut, so counts add up exactly. Both tiers only save work; the counts
are the library's whatever they hold.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; very long texts
are counted whole, piece by piece; an empty table gives an empty table; special strings inside a text are treated as the library does by default; input columns named like an
output column are replaced by it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, begun, ended, mapped
from .vectext import chunks

#: Rows from which the broadcast table is drawn, and its entries: bounds on a cache, without influence on the counts.
TABLE_SAMPLE_ROWS = 2000
TABLE_ENTRIES = 32_768
#: Pre-tokens a worker keeps at most (the earliest stay), and the longest that it keeps.
CACHE_ENTRIES = 800_000
CACHE_CHARS = 48
#: Ids that a worker keeps at most from one batch to the next.
CACHE_IDS = 4 << 20

#: Fixed: characters on which the Unicode tables of the two libraries might differ, or which mark a special token.
_UNSURE = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ]|<\\|")
_CUT = re.compile(r"(?<!\s) ")
_SPACES = re.compile(r"\s ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pre_tokens(text: str) -> list[str]:
    """The text cut in front of each space that follows a non-space."""
    parts = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
    return [parts[0], *[f" {p}" for p in parts[1:]]] if parts[0] else [f" {p}" for p in parts[1:]]


def _keys(text: str) -> list[str]:
    """Cache keys of a text: its pre-tokens, without the leading space but for the first, which is marked."""
    parts = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
    head = parts[0]
    parts[0] = f"\0{head}"
    return parts


class Library:
    """The tokenizer file through its library; `additive` where counts of pre-tokens add up to the text's."""

    def __init__(self, path: str):
        self.path, self.sp, self.fast = path, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.sp, self.additive = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.additive = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if self.additive:
            self.fast = self._ranked(spec)
            self.single = self.fast and self.fast._core_bpe.encode_single_piece

    @staticmethod
    def _ranked(spec: dict):
        """The same vocabulary in the faster library, for pre-tokens of plain characters; None where its ids aren't merge ranks."""
        import tiktoken

        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"]["".join(m)] for m in merged]
        if len(ranks) != 256 + len(ids) or any(b <= a for a, b in zip(ids, ids[1:])) or (ids and ids[0] < 256):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, piece: str, sure: bool = False) -> list[int]:
        """sure: the piece is known to hold plain characters only."""
        if self.fast is not None and (sure or not _UNSURE.search(piece)):
            if piece.isalpha() or piece[1:].isalpha() and piece[0] == " ":  # one pre-token
                return self.single(piece.encode())
            return self.fast.encode_ordinary(piece)
        return self.sp.encode(piece, num_threads=1) if self.sp else self.tok.encode(piece, add_special_tokens=False).ids


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


class Lengths(dict):
    """Both tiers: filled from the broadcast table, grown by what a worker encodes."""

    def __init__(self, lib: Library, table: tuple[str, bytes] = ("", b"")):
        names, sizes = table
        super().__init__(zip(names.split("\n") if names else [], sizes))
        self.sure = False
        self.lib, self.base = lib, len(self)

    def __missing__(self, key: str) -> int:
        if self.sure:
            word = key.rstrip(".,")
            if len(word) != len(key) and word.isalpha():  # letters and punctuation never share a pre-token
                return self[word] + self["\0" + key[len(word) :]]
        n = len(self.lib.ids(key[1:] if key[:1] == "\0" else f" {key}", self.sure))
        if len(key) <= CACHE_CHARS and len(self) < self.base + CACHE_ENTRIES:
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not self.lib.additive or "\0" in text:
            return len(self.lib.ids(text))
        self.sure = self.lib.fast is not None and not _UNSURE.search(text)
        return sum(map(self.__getitem__, _keys(text)))

_LENGTHS: dict[tuple[str, int], Lengths] = {}


def frequent(docs: DataFrame, text: str, path: str, seed: int = 7) -> tuple[str, bytes]:
    """The compact table: frequent pre-tokens of a sample of about TABLE_SAMPLE_ROWS rows (newline-joined) and their lengths, a byte each.

    Each task counts what it drew, and sends its most frequent pre-tokens only. The table saves work; counts don't depend on it.
    """

    def counted(batches):
        begun("tokens")
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and "\0" not in t:
                    seen.update(_keys(t))
        found = [(k, n) for k, n in seen.most_common(TABLE_ENTRIES) if "\n" not in k and len(k) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["k", "n"])
        ended()

    lib = library(path)
    rows = docs.count()
    if not lib.additive or not rows:
        return "", b""
    sample = docs.select(text).sample(min(1.0, TABLE_SAMPLE_ROWS / rows), seed)
    most = sample.mapInArrow(counted, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(TABLE_ENTRIES).collect()
    sized = [(r.k, len(lib.ids(r.k[1:] if r.k[:1] == "\0" else f" {r.k}"))) for r in most]
    sized = [(k, n) for k, n in sized if n < 256]
    return "\n".join(k for k, _ in sized), bytes(n for _, n in sized)


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None, carry: list[str] | None = None, over: int = 1024) -> DataFrame:
    """docs (its columns `carry`, all by default) with n_bytes, n_tokens and over_limit (n_tokens > over) of each whole text."""
    path = tokenizer or default_tokenizer()
    out = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in out]
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, path))

    def each(batch: pa.RecordBatch):
        key = (path, hash(table.value))
        if key not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[key] = Lengths(library(path), table.value)
        lengths = _LENGTHS[key]
        for part in chunks(batch, "__text"):
            texts = part.column(part.num_columns - 1).to_pylist()
            n = [lengths.count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())], names=[*kept, *out])

    frame = docs.select(*[docs[c] for c in kept], docs[text].cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return mapped(frame, each, f"{fields}, n_bytes long, n_tokens long, over_limit boolean" if fields else "n_bytes long, n_tokens long, over_limit boolean", "tokens")


class Ids(dict):
    """A worker's cache of pre-token ids: key -> slot; slot s has ids flat[at[s]:at[s + 1]]."""

    def __init__(self, lib: Library):
        super().__init__()
        self.lib, self.sure = lib, False
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.used, self.long = 0, []  # slots taken, and keys that are too long to stay
        self.flat, self.at = np.zeros(1 << 20, np.uint32), np.zeros(1 << 19, np.int64)

    def __missing__(self, key: str) -> int:
        ids = self.lib.ids(key[1:] if key[:1] == "\0" else f" {key}", self.sure)
        slot, a = self.used, int(self.at[self.used])
        b = a + len(ids)
        if slot + 2 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros(len(self.at), np.int64)))
        if b > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)))
        self.flat[a:b], self.at[slot + 1] = ids, b
        self[key] = slot
        self.used += 1
        if len(key) > CACHE_CHARS:
            self.long.append(key)
        return slot

    def trim(self) -> None:
        """Drops long keys; where too many entries or ids are left, the later half, or all where long keys' ids fill the rest."""
        for key in self.long:
            del self[key]
        self.long = []
        if len(self) > CACHE_ENTRIES or self.at[self.used] > CACHE_IDS:
            for key in list(islice(self, CACHE_ENTRIES // 2, None)):
                del self[key]
            self.used = self[next(reversed(self))] + 1 if self else 0
            if self.at[self.used] > CACHE_IDS // 2:
                self.forget()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin (one more than texts)."""
        self.trim()
        if not self.lib.additive or any(t and "\0" in t for t in texts):
            each = [self.lib.ids(t) if t else [] for t in texts]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.cumsum([0, *map(len, each)])
        keys = [_keys(t) if t else [] for t in texts]
        self.sure = self.lib.fast is not None and not any(_UNSURE.search(t) for t in texts if t)
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        slots = np.fromiter(chain.from_iterable(map(self.__getitem__, k) for k in keys), np.int64, int(sizes.sum()))
        n = self.at[slots + 1] - self.at[slots]
        end = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[slots] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.concatenate(([0], end))[bounds]


_IDS: dict[str, Ids] = {}
CACHES["tokens"] = [_LIBRARIES, _LENGTHS, _IDS]


def worker_ids(path: str) -> Ids:
    """This worker's cache."""
    if path not in _IDS:
        _IDS[path] = Ids(library(path))
    return _IDS[path]
