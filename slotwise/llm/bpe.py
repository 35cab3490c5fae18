"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end the prefix's encoding.  That token is kept
for each prefix, so a text is encoded left to right in one pass, appending never changes what is already
there, and after an edit only positions from the edit on are worked out again, until the table meets its
old state.  A token may follow another if the two, put together, would still be encoded as these two; the
check undoes merges from both sides of the joint, latest first.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import bounded_batches

#: Bounds of a worker's caches: pieces in either generation, bytes of a kept piece, pairs of tokens.
CACHE_PIECES, CACHE_BYTES, CACHE_PAIRS = 150_000, 48, 200_000
_packed: dict[str, "_Packed"] = {}


class Vocabulary:
    """Ranks of byte strings with their last merges; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.suffixes = ahocorasick.Automaton()
        for rank, token in sorted(self.bytes_of.items()):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
            else:
                for i in range(1, len(token)):
                    a, b = ranks.get(token[:i]), ranks.get(token[i:])
                    if a is not None and b is not None and max(a, b) < rank and a in self.split and b in self.split and self.adjacent(a, b):
                        self.split[rank] = (a, b)
                        self.joined[a, b] = rank
                        break
                else:
                    continue  # no chain of merges makes it: only a whole piece can be this token
            self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        limit, split, joined = 1 << 62, self.split, self.joined
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            # Undo the later of the two last merges; merges at or after it can't have bridged the joint.
            if left > right:
                limit, down = left, split[left][1]
                if down == left:
                    limit, down = right + 1, split[right][0]
                    if down == right:
                        return True
                    right = down
                else:
                    left = down
            else:
                limit, down = right + 1, split[right][0]
                if down == right:
                    limit, down = left, split[left][1]
                    if down == left:
                        return True
                    left = down
                else:
                    right = down

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token itself is that token; else the table decides."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else PrefixTable(self, piece).tokens() if piece else []


class PrefixTable:
    """The last token of each prefix of a byte string (one piece: no splitting by a pattern)."""

    __slots__ = ("vocabulary", "data", "last", "size")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.size = vocabulary, b"", [], []
        self.append(data)

    def _fill(self, start: int, settled: int | None = None) -> None:
        """Works out the entries from ``start`` on; behind ``settled`` it stops where the old ones hold again."""
        vocabulary, last, size, data = self.vocabulary, self.last, self.size, self.data
        adjacent, pairs, longest = vocabulary.adjacent, vocabulary.pairs, vocabulary.longest
        base = max(0, start - longest)
        done, same = start - 1, 0
        for end, (rank, length) in vocabulary.suffixes.iter(data[base:].decode("latin-1")):
            end += base
            if end <= done:
                continue
            before = end - length
            if before >= 0:
                pair = last[before] << 32 | rank
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = adjacent(last[before], rank)
                if not fits:
                    continue
            if end > done + 1:
                break
            done = end
            if settled is not None:
                same = same + 1 if (last[end], size[end]) == (rank, length) else 0
                # An entry looks back `longest` bytes at most: after so many unchanged ones behind the edit, all are.
                if end - settled >= longest and same > longest:
                    return
            last[end], size[end] = rank, length
        if done + 1 < len(data):
            raise ValueError(f"byte {data[done + 1]} has no token")
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.last += [-1] * len(data)
        self.size += [0] * len(data)
        self._fill(start)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Replaces data[start:end]; the table behind the edit is kept as far as it still holds."""
        self.data = self.data[:start] + data + self.data[end:]
        self.last[start:end] = [-1] * len(data)
        self.size[start:end] = [0] * len(data)
        self._fill(start, start + len(data))

    def tokens(self) -> list[int]:
        out, at = [], len(self.data) - 1
        while at >= 0:
            out.append(self.last[at])
            at -= self.size[at]
        return out[::-1]


class Codec:
    """Encodes whole texts, each match of the pattern by itself, and decodes ids."""

    def __init__(self, rank_file: bytes, pattern: str):
        key = hashlib.sha256(rank_file).hexdigest()
        if key not in _packed:
            _packed.clear()
            _packed[key] = _Packed(Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}))
        self.packed = _packed[key]
        self.vocabulary = self.packed.vocabulary
        # Rust's \s is the White_Space property; that of the Python library has four controls more.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I")))


class _Packed(dict):
    """Packed ids of pieces; only short pieces are kept, in two generations, of which the older goes when the newer is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            ids = array("I", self.vocabulary.encode_piece(data)).tobytes()
            if len(data) > CACHE_BYTES:
                return ids
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the packed ids.

    A null text counts as empty (no tokens, digests of no bytes); repeated rows give repeated rows; other
    columns are not looked at.  ``rank_file`` is the content of a rank file, of a few MB at most whatever
    the input, and goes out as one broadcast.
    """
    bounded_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            counts, sums, decoded, ids = [], [], [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                sums.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if with_ids:
                    ids.append(packed)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
