"""Harmonic packing of token streams into sequences.

A document's full sequences stand alone. What remains of it, of length l, belongs to class k = floor(capacity / l),
and a sequence of class k takes k such remainders, whole. Every task fills the sequences of its own classes, so
nothing is shuffled. What such a sequence has room for beyond its k remainders would be padding: remainders that come
later are put there, whole where they fit, or cut to it where the room and what is left of them are LEAST tokens or
more. What a task holds in unfinished sequences at its end is joined and cut into full ones, and the last tokens into
sequences of powers of two, so that a task's end pads nothing.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
#: The low bits of a sequence id count the sequences of a task.
SEQUENCES_A_TASK = 40
#: Documents aren't cut into pieces of fewer tokens, but at a task's end; sequences that wait for a piece to fill them.
LEAST, MOST_WAITING = 32, 256
#: Longer texts are encoded in parts. A part ends before a space between two letters, where this vocabulary's
#: pre-tokenizer always ends a word too, so the ids are those of the whole text.
PART = 1 << 18
SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE tokenizer file. tiktoken merges by the file's own ranks: the ids are those of the
    tokenizers library (tests compare them), at a sixth of the time. What tiktoken can't take goes to tokenizers.

    With special, the file's special tokens are found in texts and get their own ids, as tokenizers does unless its
    encode_special_tokens is set; without, they are text like any other.
    """

    def __init__(self, path: str, pattern: str, special: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        bytes_of, added = byte_of(), {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
        own = {t["content"]: t["id"] for t in told["added_tokens"] if t["special"]} if special else {}
        if any(t[k] for t in told["added_tokens"] if t["content"] in own for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take blanks, need word ends or are normalised aren't supported")
        if any(SAFE.search(t) for t in own):
            raise ValueError("special tokens with a space between letters could be cut between parts")
        self.path, self.slow, self.special = path, None, special
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=own)

    def part(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except BaseException as error:  # a panic of its Rust code is no Exception
            if not isinstance(error, Exception) and type(error).__name__ != "PanicException":
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.special
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self.part(text)
        parts, begin = [], 0
        while begin < len(text):
            cut = SAFE.search(text, begin + PART)
            end = cut.start() if cut else len(text)
            parts.append(self.part(text[begin:end]))
            begin = end
        return np.concatenate(parts)


class Packer:
    """The sequences of one task that aren't done: of each class one that lacks remainders, and some with room left."""

    def __init__(self, capacity: int, task: int, least: int = LEAST):
        self.capacity, self.least, self.base, self.used = capacity, least, task << SEQUENCES_A_TASK, 0
        self.open: dict[int, list[tuple]] = {}
        self.rooms: list[int] = []
        self.waiting: list[list[tuple]] = []
        self.done: list[tuple] = []

    def seal(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, ids, tokens of the document)."""
        number, offset, total = self.base + self.used, 0, sum(len(p[2]) for p in pieces)
        self.used += 1
        for doc_id, start, ids, tokens in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, number, offset, total))
            offset += len(ids)

    def await_more(self, pieces: list[tuple], room: int) -> None:
        """Keep a sequence whose class is filled for what fits its room; of too many, that with the least room is done."""
        if room:
            at = bisect_left(self.rooms, room)
            self.rooms.insert(at, room)
            self.waiting.insert(at, pieces)
        else:
            self.seal(pieces)
        if len(self.waiting) > MOST_WAITING:
            self.rooms.pop(0)
            self.seal(self.waiting.pop(0))

    def into_rooms(self, doc_id: int | None, start: int, ids: np.ndarray, tokens: int) -> tuple[int, np.ndarray]:
        """Put ids where there is room for them; what is left of them."""
        while len(ids) and self.rooms:
            at = bisect_left(self.rooms, len(ids))
            if at == len(self.rooms):  # no room for all of it: the largest takes a part
                at, room = len(self.rooms) - 1, self.rooms[-1]
                if room < self.least or len(ids) - room < self.least:
                    break
            size = min(self.rooms[at], len(ids))
            room, pieces = self.rooms.pop(at) - size, self.waiting.pop(at)
            self.await_more([*pieces, (doc_id, start, ids[:size].copy(), tokens)], room)
            start, ids = start + size, ids[size:]
        return start, ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, tokens = 0, len(ids)
        for start in range(0, tokens - self.capacity + 1, self.capacity):
            self.seal([(doc_id, start, ids[start : start + self.capacity], tokens)])
        start = tokens - tokens % self.capacity
        start, rest = self.into_rooms(doc_id, start, ids[start:], tokens)
        if len(rest):
            k = self.capacity // len(rest)
            pieces = self.open.setdefault(k, [])
            pieces.append((doc_id, start, rest.copy(), tokens))
            if len(pieces) == k:
                self.await_more(self.open.pop(k), self.capacity - sum(len(p[2]) for p in pieces))

    def finish(self) -> None:
        """Unfinished sequences become full ones, and the tokens after them sequences of powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        rest = [(d, *left, n) for d, start, ids, n in rest if len((left := self.into_rooms(d, start, ids, n))[1])]
        for pieces in self.waiting:
            self.seal(pieces)
        self.open, self.rooms, self.waiting = {}, [], []
        total, size, own = sum(len(p[2]) for p in rest), 0, []
        for doc_id, start, ids, tokens in rest:
            while len(ids):
                if not size:
                    size = min(self.capacity, 1 << (total.bit_length() - 1))
                take = min(size, len(ids))
                own.append((doc_id, start, ids[:take], tokens))
                start, ids, size, total = start + take, ids[take:], size - take, total - take
                if not size:
                    self.seal(own)
                    own = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [[]] * 8
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, special: bool = False, least: int = LEAST) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most capacity ids (a power of two).

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the sequence's length;
    what that lacks of the capacity is padding, unless it is a power of two. Pieces have `least` tokens or more, but
    for whole documents and remainders of fewer and those cut at a task's end. A null or empty text is the end id
    alone; a long one is encoded in parts and fills sequences of its own, and its remainder another; rows with a null
    or a repeated id are packed like others. No rows give none. Further columns are ignored, whatever their names. The
    rows of a task depend on its input rows only, so a lost task is made again as it was. With special, the
    tokenizer's special tokens in texts get their own ids, the default of tokenizers; without, they are plain text.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer, pattern, special), Packer(capacity, TaskContext.get().partitionId(), least)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end]))
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=True)
