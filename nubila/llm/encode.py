"""Problem 6: encoding of the whole corpus with a public tokenizer.

Texts are cut into chunks where a rolling hash of the last bytes says so; what
documents share has the same chunks wherever it stands, and each chunk is
encoded once a task. Cuts are taken only where the tokenizer's splitting ends a piece
whatever follows (a change between letters, digits, signs and white space, not behind white
space and not beside an apostrophe), and merges never cross pieces, so the ids of chunks side by side
are those of the whole. Each kind of join is proved all the same, by encoding
its nearest words apart and together; where that does not agree, the chunks
are encoded again as one, back and back until all joins agree.

No shuffle: of this project's speeches 4.4 % of the bytes stand in a chunk that occurred
before, and a table of all chunks would move the other 95.6 % as well, twice (README).
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("NUBILA_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the byte-level vocabulary of 50,256 splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a vocabulary that are sent to every task.
MAX_VOCABULARY = 32 << 20
#: One candidate of 2**MASK_BITS becomes a cut; bytes of chunks a task remembers, twice; bytes hashed at a time.
MASK_BITS, REMEMBER, AT_ONCE = 5, 24 << 20, 1 << 20
_ENCODERS: dict = {}


def ranks_file(name: str, folder: str) -> bytes:
    """The vocabulary, read by the driver; it goes to the tasks, which need no folder of their own."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than MAX_VOCABULARY")
    with open(path, "rb") as f:
        return f.read()


def encoder(name: str, ranks: bytes):
    """Of the lines of a vocabulary (token in base64, rank); built once a worker process."""
    key = (name, len(ranks), zlib.crc32(ranks))
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        _ENCODERS[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(256, dtype=np.uint8)  # 0: never next to a cut
    for b in range(128):
        c = chr(b)
        kind[b] = 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in " \t\n\r" else 4 if 33 <= b < 127 else 0
    kind[ord("'")] = 5
    gear = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
    return kind, gear


KIND, GEAR = _tables()


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which to cut: the hash of the 16 bytes before says so, and no token can reach across."""
    if len(data) < 2:
        return np.empty(0, dtype=np.int64)
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        g = h.copy()
        g[shift:] += h[:-shift] << np.uint32(shift)
        h = g
    k = KIND[data]
    before, after = k[:-1], k[1:]
    # white space may hang on to what follows it, so a cut stands before white space, never behind it;
    # an apostrophe joins what stands before and behind it
    safe = (before != after) & (before != 0) & (after != 0) & (before != 3) & (before != 5) & (after != 5)
    return np.flatnonzero(safe & (h[:-1] >> np.uint32(32 - MASK_BITS) == 0)) + 1


class ChunkEncoder:
    def __init__(self, name: str, ranks: bytes):
        self.encode = encoder(name, ranks).encode_ordinary
        self.known: dict[bytes, np.ndarray] = {}
        self.before: dict[bytes, np.ndarray] = {}  # the generation before, so that what is asked again stays
        self.proved: dict[tuple[bytes, bytes], bool] = {}
        self.size = self.reused = self.asked = 0

    def ids(self, chunk: bytes) -> np.ndarray:
        self.asked += 1
        got = self.known.get(chunk)
        if got is not None:
            self.reused += 1
            return got
        got = self.before.get(chunk)
        if got is None:
            got = np.array(self.encode(chunk.decode("utf-8", "surrogatepass")), dtype=np.int32)
        else:
            self.reused += 1
        if self.size > REMEMBER:
            self.before, self.known, self.size = self.known, {}, 0
        self.known[chunk] = got
        self.size += len(chunk) + got.nbytes + 150
        return got

    def agrees(self, a: bytes, b: bytes) -> bool:
        """Whether the join of two chunks is one of tokens: their nearest words encoded apart and together."""
        tail, head = a[a.rfind(b" ", 0, len(a) - 1) + 1 :] if len(a) < 64 or b" " in a[-64:-1] else a, b[: b.find(b" ", 1)] if b" " in b[1:] else b
        key = (tail, head)
        got = self.proved.get(key)
        if got is None:
            if len(self.proved) > 100_000:
                self.proved.clear()
            text = lambda x: x.decode("utf-8", "surrogatepass")
            got = self.proved[key] = self.encode(text(tail)) + self.encode(text(head)) == self.encode(text(tail + head))
        return got

    def text(self, data: bytes, marks: list[int]) -> list[np.ndarray]:
        parts, start = [], 0
        for end in (*marks, len(data)):
            chunk = data[start:end]
            start = end
            while parts and not self.agrees(parts[-1], chunk):  # one chunk now, whose own join is asked again
                chunk = parts.pop() + chunk
            parts.append(chunk)
        return [self.ids(c) for c in parts]

    def batch(self, texts: pa.Array) -> pa.Array:
        flat: list[np.ndarray] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        raw = [(k, t.encode("utf-8", "surrogatepass")) for k, t in enumerate(texts.to_pylist()) if t]
        at = 0
        while at < len(raw):
            group, total = [], 0
            while at < len(raw) and (not group or total + len(raw[at][1]) <= AT_ONCE):
                group.append(raw[at])
                total += len(raw[at][1])
                at += 1
            data = np.frombuffer(b"".join(b for _, b in group), dtype=np.uint8)
            found, ends = cuts(data), np.cumsum([len(b) for _, b in group])
            first = np.searchsorted(found, ends - [len(b) for _, b in group], "right")
            last = np.searchsorted(found, ends, "left")
            for (k, b), e, lo, hi in zip(group, ends, first, last):
                parts = self.text(b, (found[lo:hi] - (e - len(b))).tolist())
                sizes[k] = sum(map(len, parts))
                flat += parts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        values = np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the token ids of its text, exactly those of the text encoded whole.

    No special tokens: text that looks like one is ordinary text. Null and empty
    texts give an empty list, a null id stays null, repeated rows are repeated.
    """

    ranks = ranks_file(tokenizer, folder)

    def run(batches):
        enc = ChunkEncoder(tokenizer, ranks)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.batch(part.column(1))], ["doc_id", "ids"])

    d = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, ids array<int>")
