"""Byte-pair encoding with contiguous rank arrays, and decoding (operator 7).

A word's parts and the ranks of its adjacent pairs lie in two contiguous rows.
The smallest rank is found by a scan, its boundary is deleted by moving what
follows one place down, and the two neighbouring ranks are looked up anew. The
words of a batch that are about as long share one pair of matrices, so that a
step of all of them is a few array operations. Words too long for scanning
take the same merges from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fleetquery.llm.common import table
from fleetquery.llm.tokens import byte_characters, in_blocks

#: Longest word, in bytes, that is scanned.
SCANNED = 512
#: Distinct words a worker remembers before it begins anew.
REMEMBERED = 250_000
_NONE = np.iinfo(np.int64).max
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: For texts of ASCII and Latin letters the same cut by a faster engine.
_PLAIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_NOT_PLAIN = re.compile("[^\t-\r -~«»À-ÖØ-öø-ſ–—‘-”…]")
_PLAIN_WORD = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_PLAIN_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_PLAIN_LETTERS}]+|\\s+(?!\\S)|\\s+"
)


class Codec:
    """Encodes as the tokenizers library does without special tokens added;
    their strings in a text give their ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in held["model"]["merges"]]
        names = byte_characters()
        back = {c: b for b, c in enumerate(names)}
        self.first = np.array([vocab[c] for c in names], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, n in vocab.items():
            self.bytes_of[n] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, n in self.special.items():
            self.bytes_of[n] = token.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; pairs that never merge rank last."""
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.ranks[at], _NONE)

    def scan(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words that are about as long as each other."""
        width = max(map(len, words))
        size = np.array([len(w) for w in words])
        parts = np.zeros((len(words), width + 1), np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(width + 1) < size[:, None]
        parts[inside] = self.first[flat]
        ranks = np.full((len(words), width + 1), _NONE)
        pair = np.arange(width) < size[:, None] - 1
        ranks[:, :width][pair] = self.rank(parts[:, :-1][pair], parts[:, 1:][pair])
        done: list[bytes] = [b""] * len(words)
        who = np.arange(len(words))
        columns = np.arange(width + 1)
        while len(who):
            at = ranks.argmin(1)
            rows = np.arange(len(who))
            best = ranks[rows, at]
            ended = best == _NONE
            if ended.any():
                for i in np.flatnonzero(ended):
                    done[who[i]] = parts[i, : size[i]].astype("<u4").tobytes()
                stay = ~ended
                who, size, at, best = who[stay], size[stay], at[stay], best[stay]
                parts, ranks, rows = parts[stay], ranks[stay], np.arange(len(who))
                if not len(who):
                    break
            parts[rows, at] = self.merged[best]
            # the boundary after the merged part goes: what follows moves down
            moved = np.minimum(columns + (columns > at[:, None]), width)
            parts = np.take_along_axis(parts, moved, 1)
            ranks = np.take_along_axis(ranks, moved, 1)
            size = size - 1
            more = at + 1 < size
            ranks[rows, at] = _NONE
            i, j = rows[more], at[more]
            ranks[i, j] = self.rank(parts[i, j], parts[i, j + 1])
            i, j = rows[at > 0], at[at > 0]
            ranks[i, j - 1] = self.rank(parts[i, j - 1], parts[i, j])
        return done

    def heap(self, word: bytes) -> bytes:
        """Packed ids of a word of any length."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        ranks = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(queue)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                a, b = ids[i], ids[after[i]]
                r = self._one.get((a, b))
                if r is not None:
                    heapq.heappush(queue, (r, i, a, b))

        while queue:
            r, i, a, b = heapq.heappop(queue)
            if ids[i] != a or after[i] >= len(ids) or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.merged[r]), -1, after[gone]
            if after[gone] < len(ids):
                before[after[gone]] = i
            offer(i)
            offer(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    @property
    def _one(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs_one"):
            self._pairs_one = {(p >> 32, p & 0xFFFFFFFF): r for p, r in zip(self.pairs.tolist(), self.ranks.tolist())}
        return self._pairs_one

    def learn(self, words: Iterable[str]) -> None:
        """Encodes ``words`` into the table of known ones."""
        by_width: dict[int, list[str]] = {}
        for word in words:
            raw = len(word.encode())
            if raw > SCANNED:
                self.known[word] = self.heap(word.encode())
            else:
                by_width.setdefault(max(4, 1 << (raw - 1).bit_length()), []).append(word)
        for width, found in by_width.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                self.known.update(zip(part, self.scan([w.encode() for w in part])))

    def segments(self, text: str) -> list[str]:
        """The text's words; special strings stand alone."""
        words: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                words.append(part)
            else:
                words += (_WORD if _NOT_PLAIN.search(part) else _PLAIN_WORD).findall(part)
        return words

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.segments(x) for x in texts]
        wanted = set().union(*cut)
        if len(self.known) > REMEMBERED:
            self.known = {}
        for token, n in self.special.items():
            self.known[token] = np.array([n], "<u4").tobytes()
        self.learn(wanted.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each worker process and file."""
    return Codec(path)


def round_trips(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null texts
    count as empty, and have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(tokenizer)
        for batch in batches:
            rows = []
            for texts in in_blocks(batch.column("text").to_pylist()):
                for ids in held.encode(texts):
                    decoded = held.decode(ids).encode()
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))] if rows else []
            if rows:
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids of every row."""
    from fleetquery.llm.token_store import id_lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_blocks(batch.column("text").to_pylist()):
                part = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([part, id_lists(codec(tokenizer).encode(texts))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
