"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring byte symbols that stands inside no vocabulary token can never be
merged across, so the word is cut there for certain; the fragments are encoded on their own
and their ids joined.  The vocabulary file is read once on the driver (its size is fixed by
the file, not by the data) and travels to the tasks as a broadcast value; texts stream
through Arrow batches, each row in the task that read it: no shuffle.

Defined cases: a null or blank text has no tokens and decodes to the empty text; repeated
rows are encoded each; a fragment of any length is merged with a heap in n log n steps, so
one very long word is no trap; the caches of a task are bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import map_batches, ship

#: Entries kept in each of a task's two caches; a full cache is emptied.  Words longer than LONG are not kept.
CACHE = 400_000
LONG = 64


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it prints, else the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


class Codec:
    """Encoder and decoder for a byte-level BPE file with a suffix at word ends."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: place for place, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocabulary, **self.special}.items()}
        parts = data["pre_tokenizer"]["pretokenizers"]
        self.piece = regex.compile(parts[0]["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        self.inside = self._inside_pairs()
        self.fragments: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def _inside_pairs(self) -> set[tuple[str, str]]:
        """The neighbouring symbols that occur inside some token; all other pairs are certain cuts."""
        found = set()
        for token in self.vocabulary:
            symbols = self._symbols_of(token)
            found.update(zip(symbols, symbols[1:]))
        return found

    def _symbols_of(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def split(self, symbols: list[str]) -> Iterator[list[str]]:
        """The fragments between forced boundaries."""
        start = 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.inside:
                yield symbols[start:i]
                start = i
        if symbols:
            yield symbols[start:]

    def merge(self, parts: list[str]) -> list[str]:
        """Merge by rank, leftmost first; a heap over a linked list for long fragments."""
        rank = self.rank
        if len(parts) <= 24:
            while len(parts) > 1:
                best, at = None, -1
                for i, pair in enumerate(zip(parts, parts[1:])):
                    r = rank.get(pair)
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return parts
        right = list(range(1, len(parts))) + [-1]
        left = list(range(-1, len(parts) - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != pair[0] or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (parts[a], parts[b]) in rank:
                    heapq.heappush(heap, (rank[parts[a], parts[b]], a, (parts[a], parts[b])))
        return [p for p in parts if p]

    def _fragment(self, symbols: list[str]) -> tuple[int, ...]:
        key = "".join(symbols)
        ids = self.fragments.get(key)
        if ids is None:
            ids = tuple(self.vocabulary[t] for t in self.merge(list(symbols)) if t in self.vocabulary)
            if len(key) <= LONG:
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                self.fragments[key] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)]) if not text.isascii() else text.lower()
        ids: list[int] = []
        for piece in self.piece.findall(text):
            symbols = [self.symbols[b] for b in piece.encode("utf-8")]
            symbols[-1] += self.end
            for fragment in self.split(symbols):
                ids.extend(self._fragment(fragment))
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        if "<|" in chunk:
            ids = []
            for part in self.cut_special.split(chunk):
                ids.extend([self.special[part]] if part in self.special else self._plain(part))
        else:
            ids = self._plain(chunk)
        out = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])
        if len(chunk) <= LONG:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text they decode to.

        A blank is no part of any token and joins no neighbour, so what stands between blanks is encoded on its own.
        """
        known, make = self.chunks.get, self._chunk
        parts = [known(c) or make(c) for c in (text or "").replace("\n", " ").split(" ") if c]
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])

    def decode(self, ids) -> str:
        """The tokens with a blank between them; an id without a token is skipped."""
        return " ".join([self.names[i] for i in ids if i in self.names])


_codecs: dict[int, Codec] = {}


def _codec(spec) -> Codec:
    """One codec per Python worker and broadcast vocabulary."""
    if spec.value[0] not in _codecs:
        _codecs.clear()
        _codecs[spec.value[0]] = Codec(spec.value[1])
    return _codecs[spec.value[0]]


def _shared(docs: DataFrame, vocabulary_path: str):
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.md5(text.encode()).hexdigest(), text))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """id, n_tokens, ids (array of int) per row, and the text that the ids decode to if ``decoded``."""
    spec = _shared(docs, vocabulary_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec)
        for batch in batches:
            for start in range(0, len(batch), 1000):  # ids of few rows at a time
                part = batch.iloc[start:start + 1000]
                found = [np.frombuffer(codec.encode(t)[0], dtype="<u4").astype("int32") for t in part["text"]]
                out = pd.DataFrame({"id": part["id"].array, "n_tokens": [len(x) for x in found], "ids": found})
                yield out.assign(decoded=[codec.decode(x.tolist()) for x in found]) if decoded else out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run,
                       f"id {kind}, n_tokens long, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(ids: Column, docs: DataFrame, vocabulary_path: str) -> Column:
    """The text that a column of ids stands for; null ids decode to the empty text."""
    ship(docs.sparkSession)
    spec = _shared(docs, vocabulary_path)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        codec = _codec(spec)
        return pd.Series([codec.decode([] if x is None else x) for x in column])

    return run(ids)


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids and of the decoded text, in one pass that keeps neither."""
    spec = _shared(docs, vocabulary_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec)
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids, decoded = codec.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", batch["id"].array)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run,
                       f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
