"""Encoding of texts with a public byte-level BPE vocabulary, exactly and in linear time.

Within a pre-token, Aho-Corasick finds the longest token at every offset. The encoder takes the
longest one that is compatible with the token before it (the pair would not have been merged
otherwise), falls back to its longest prefix token, and steps back when none fits; an offset
once given up is never tried again, which bounds the work. Decoding slices one byte string by
an offset table.

Defined cases: null and empty texts have no ids; special-token strings in a text are ordinary
text; lone surrogates are replaced as UTF-8 requires; very long pre-tokens are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Place of the vocabulary (token in base 64, rank); a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens up to this length are remembered per worker, up to so many of them.
CACHED_LENGTH, CACHED_TOKENS = 48, 300_000


class BpeEncoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.offsets = [0]
        for token in self.tokens:
            self.offsets.append(self.offsets[-1] + len(token))
        self.blob = b"".join(self.tokens)
        self.ids = ranks
        self.shorter = [self._prefix(token) for token in self.tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(self.tokens))]
        self._pairs: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token, rank)
        self._pairs.clear()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.cache: dict[str, list[int]] = {}

    def _prefix(self, token: bytes) -> int:
        """Id of the longest token that is a proper prefix, -1 if none."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def _learn(self, token: bytes, rank: int) -> None:
        """The pair whose merge makes the token: both halves are older and stand side by side unmerged."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.ids.get(token[len(self.tokens[left]) :], -1)
            if 0 <= right < rank and left < rank and self.compatible(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens can follow each other: no earlier merge reaches across their border."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo the later of the two last merges again and again, looking for a border pair merged before it."""
        halves, merged = self.halves, self.merged
        bound = len(self.tokens)
        while True:
            made = merged.get((left, right))
            if made is not None and made < bound:
                return False
            inner, outer = halves[left][1], halves[right][0]
            left_open, right_open = inner != left, outer != right
            if not left_open and not right_open:
                return True
            if left_open and (left > right or not right_open):
                bound, left = left, inner
            else:
                bound, right = right + 1, outer

    def encode_bytes(self, data: bytes) -> list[int]:
        known = self.ids.get(data)
        if known is not None:
            return [known]
        size = len(data)
        longest = [-1] * size
        width = [0] * size
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > width[start]:
                width[start], longest[start] = length, rank
        tokens, shorter, compatible = self.tokens, self.shorter, self.compatible
        usable = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, candidate = 0, longest[0]
        while at < size:
            previous = out[-1] if out else -1
            while candidate >= 0:
                end = at + len(tokens[candidate])
                if usable[end] and (previous < 0 or compatible(previous, candidate)):
                    break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at = end
                candidate = longest[at] if at < size else -1
            else:
                usable[at] = 0
                candidate = out.pop()
                at -= len(tokens[candidate])
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.pattern.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_TOKENS:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        blob, offsets = self.blob, self.offsets
        return b"".join([blob[offsets[i] : offsets[i + 1]] for i in ids]).decode("utf-8", "replace")


_encoders: dict[int, BpeEncoder] = {}


def _encoder(shared) -> BpeEncoder:
    """The encoder of a broadcast vocabulary, built once per worker."""
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BpeEncoder(shared.value)
    return _encoders[key]


def _share(spark: SparkSession, vocabulary: str):
    """The vocabulary file, under 2 MB whatever the data, as a broadcast."""
    with open(vocabulary, "rb") as file:
        raw = file.read(2_000_001)
    if len(raw) > 2_000_000:
        raise ValueError(f"{vocabulary} is no vocabulary of the expected size")
    return spark.sparkContext.broadcast(raw)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    shared = _share(df.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared).encode
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": [encode(t) for t in b["t"]]})

    kind = df.schema[key].dataType.simpleString()
    out = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows without their text, with its number of tokens."""
    shared = _share(df.sparkSession, vocabulary)
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared).encode
        for b in batches:
            counts = [len(encode(t)) for t in b[text]]
            yield b.drop(columns=[text]).assign(**{out: counts})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{out}` long"
    return spread(df.select(*[f.name for f in rest], text)).mapInPandas(run, schema)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids); null ids give an empty text."""
    shared = _share(df.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = _encoder(shared).decode
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "text": [decode(i) if i is not None else "" for i in b["i"]]})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInPandas(run, f"k {kind}, text string")
    return out.withColumnRenamed("k", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows whose text does not come back from its ids: none, if all is well."""
    back = decode_ids(encode_texts(df, key, text, vocabulary), key, "ids", vocabulary).withColumnRenamed("text", "_back")
    both = df.select(key, F.coalesce(text, F.lit("")).alias("_text")).join(back, key)
    return both.where("_text != _back").select(key)
