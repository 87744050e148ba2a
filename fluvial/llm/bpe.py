"""Byte-pair encoding and decoding with the vocabulary of a public byte-level tokenizer.

Encoding finds, by an Aho-Corasick automaton over all tokens, the longest token from each position of a piece, and
walks forward over them. A token may follow another only if merging would not have crossed their border, which is
looked up in a pair-compatibility table (filled on demand); where no token fits, the last one is taken back and its next
shorter prefix is tried. Each position is given up once at most, so the work is linear in the piece, and the result is
exactly that of applying the merges in order. Decoding copies byte ranges by an offset table.

The vocabulary file is read on the driver (its size is that of a vocabulary, about 2 MB) and broadcast.

Null text: as empty text: no tokens. Very long pieces are encoded in linear time and never cached. Other columns are
ignored, whatever their names; repeated rows are encoded each.
"""

from __future__ import annotations

import itertools
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fluvial.common import small_batches

# The splitting pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces of at most so many characters are remembered, and so many of them in each Python worker.
CACHE_CHARS, CACHE_PIECES = 48, 150_000
PAIR_CACHE = 400_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable in Latin-1."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as byte strings, the rank of each merge, special tokens."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        of = byte_chars()
        to_bytes = lambda s: bytes(of[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a merged token: its rank and its two halves
        for r, (x, y) in enumerate(merges):
            a, b = self.ids[to_bytes(x)], self.ids[to_bytes(y)]
            self.rank[a, b] = r
            self.parts.setdefault(self.ids[to_bytes(x + y)], (r, a, b))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = ahocorasick.Automaton()
        for b, i in vocabulary.ids.items():
            self.find.add_word(b.decode("latin-1"), i)
        self.find.make_automaton()
        self.size = list(map(len, vocabulary.bytes))
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.unreachable = self.unreachable_tokens()
        self.cache = _Pieces(self)

    def border_holds(self, x: int, y: int, but: int = -1) -> bool:
        """Whether merging the bytes of x and y never merges across their border (apart from a merge of rank `but`).

        Undo the merges next to the border, latest first. At each step the two tokens at the border stood side by side
        until the merge that was just undone; had they a merge of an earlier rank, it would have come first.
        """
        parts, none = self.v.parts, (-1, -1, -1)
        until, last_left = len(self.v.rank), False
        while True:
            r = self.v.rank.get((x, y))
            # of equal ranks (the same merge on both sides) the left one comes first
            if r is not None and r != but and (r < until or r == until and not last_left):
                return False
            left, right = parts.get(x, none), parts.get(y, none)
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                x, until, last_left = left[2], left[0], True
            else:
                y, until, last_left = right[1], right[0], False

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as exactly these two tokens; looked up in the table."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.border_holds(a, b)
        return known

    def unreachable_tokens(self) -> set[int]:
        """Tokens that merging their own bytes doesn't make. Halves have earlier merges, so go by rank."""
        bad: set[int] = set()
        for token, (r, x, y) in sorted(self.v.parts.items(), key=lambda t: t[1]):
            if x in bad or y in bad or not self.border_holds(x, y, but=r):
                bad.add(token)
        return bad

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of token, or -1."""
        if token not in self.shorter:
            b, ids = self.v.bytes[token], self.v.ids
            self.shorter[token] = next((ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ids), -1)
        return self.shorter[token]

    def piece(self, piece: str) -> tuple[int, ...]:
        b = piece.encode("utf-8", "surrogatepass")
        if (whole := self.v.ids.get(b)) is not None and whole not in self.unreachable:
            return (whole,)
        size, n, bad, pairs = self.size, len(b), self.unreachable, self.pairs
        longest = [-1] * (n + 1)
        for end, token in self.find.iter(b.decode("latin-1")):
            longest[end + 1 - size[token]] = token
        out: list[int] = []
        last, pos, token, dead = -1, 0, longest[0], None
        while pos < n:
            end = pos + size[token]
            if dead is None or not dead[end]:
                fits = last < 0 or pairs.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits and (not bad or token not in bad):
                    out.append(token)
                    last, pos, token = token, end, longest[end]
                    continue
            less = self.next_shorter(token)
            if less >= 0:
                token = less
            else:
                dead = dead or bytearray(n + 1)
                dead[pos] = 1
                token = out.pop()
                last = out[-1] if out else -1
                pos -= size[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        lookup = self.cache.__getitem__
        if not any(s in text for s in self.v.special):
            return list(itertools.chain.from_iterable(map(lookup, self.split(text))))
        out: list[int] = []
        for part in self.at_special(text):
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                out.extend(itertools.chain.from_iterable(map(lookup, self.split(part))))
        return out


class _Pieces(dict):
    """Remembered pieces, in two generations: when the young one is full, it becomes the old one, whose pieces come back when
    they are met again. So frequent pieces stay."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encoder.piece(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Decoder:
    """Token ids to text: the bytes of all tokens in one block, and where each begins."""

    def __init__(self, vocabulary: Vocabulary):
        self.block = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.size = np.fromiter(map(len, vocabulary.bytes), np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return ""
        take = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)
        return self.block[take].tobytes().decode("utf-8", "replace")


_made: dict[type, tuple[str, object]] = {}


def _once(kind, spec) -> object:
    """One encoder or decoder for each worker and vocabulary."""
    text = spec.value
    if kind not in _made or _made[kind][0] != text:
        _made[kind] = text, kind(Vocabulary(text))
    return _made[kind][1]


def vocabulary_spec(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, decoded: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids array<int> for each document; with decoded, a column of that name with the ids decoded again,
    as decode_documents() has it, but without sending them to another worker."""
    spec = vocabulary_spec(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = _once(Encoder, spec)
        decoder = _once(Decoder, spec) if decoded else None
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in batch.column(1):
                flat.extend(encoder.encode(text.as_py() or ""))
                offsets.append(len(flat))
            ends = np.frombuffer(offsets, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))
            columns, names = [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), ids], ["doc_id", "n_tokens", "ids"]
            if decoded:
                values = np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)
                columns.append(pa.array([decoder.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)
        encoder.cache.forget()  # workers stay for later stages; what was remembered need not

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with text_col, the text of each list of ids; a null list gives null, an empty one an empty text."""
    spec = vocabulary_spec(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c != text_col]

    def run(batches):
        decoder = _once(Decoder, spec)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [decoder.decode(values[a:b]) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    d = encoded.select(*kept)
    return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + f", `{text_col}` string")
