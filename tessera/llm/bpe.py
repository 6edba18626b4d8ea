"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``Codec`` builds a ``tokenizers`` model from a rank file: the merges follow from
the ranks, and each byte stands as one printable character (the byte table).
A text is cut into the matches of the public pattern; each distinct match of a
batch is encoded once by the library, and a bounded memo keeps frequent ones.
Decoding reverses the byte table; a character split over tokens is whole again
once its bytes are joined, and offsets give each such token the span of the
character it lies in.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import lean, table

#: Distinct pieces a worker remembers; beyond it the memo starts anew.
MEMO_PIECES = 200_000
#: Rows encoded and handed on at once.
ROWS_AT_ONCE = 64
#: Longer matches (runs of signs or letters) are encoded but not remembered.
MEMO_CHARS = 48
#: Pieces that the library gets in one string; their byte lengths part the ids again.
GROUP_PIECES = 64


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Codec:
    """Encoder and decoder of one rank file; built once per worker."""

    _held: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._held:
            cls._held[path, pattern] = cls(path, pattern)
        return cls._held[path, pattern]

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_table()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [tuple(shown[p] for p in self._halves(t, ranks)) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.to_char = dict(enumerate(chars))
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.table = np.array(self.bytes_of, object)
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.split = regex.compile(pattern).findall
        self.latin = self._latin(pattern)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
        """The two parts whose merge makes ``token``: merge by rank, only with ranks before its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r >= ranks[token]:
                raise ValueError(f"no merge makes {token!r}")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    @staticmethod
    def _latin(pattern: str):
        r"""The pattern for texts below U+0250 with \p{L}, \p{N} and \s spelled out, for the faster module; None if it holds other classes."""
        import regex

        letters, digits, spaces = ("".join(re.escape(chr(c)) for c in range(0x250) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"[\t-\r \x85\xa0]"))
        out = pattern
        for k, v in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{digits}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
            out = out.replace(k, v)
        return None if r"\p" in out else re.compile(out).findall

    _beyond = re.compile("[^\x00-ɏ]").search

    def pieces(self, text: str) -> list[str]:
        return (self.split if self.latin is None or self._beyond(text) else self.latin)(text)

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids (little-endian uint32) of each piece; frequent short ones go to the memo."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        new = [p for p in pieces if p not in self.memo]
        extra = {}
        if new:
            raw = [p.encode("utf-8") for p in new]
            # a line break has another character in the byte table, so it can part the pieces
            shown = [r.decode("latin-1").translate(self.to_char) for r in raw]
            groups = ["\n".join(shown[i : i + GROUP_PIECES]) for i in range(0, len(shown), GROUP_PIECES)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(groups, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(r) for r in raw])) + 1
            flat, at = ids.tobytes(), 0
            for p, e in zip(new, (4 * ends).tolist(), strict=True):
                (self.memo if len(p) <= MEMO_CHARS else extra)[p] = flat[at:e]
                at = e
        return extra

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        cuts = [self.pieces(t) for t in texts]
        extra = self.learn(set().union(*cuts))
        for cut in cuts:
            if extra:
                yield b"".join([self.memo[p] if p in self.memo else extra[p] for p in cut])
            else:
                yield b"".join(map(self.memo.__getitem__, cut))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist())

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """(start, end) characters of each token; the parts of a split character share its span."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        if not len(ends):
            return np.zeros((0, 2), np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        return np.stack([char_of[starts], char_of[ends - 1] + 1], axis=1)


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode each whole ``text`` and decode it again, one row per row.

    Returns the columns ``keep`` plus n_tokens, ids_sha256, decoded_sha256, and
    unless ``digests_only`` also ids (array<long>) and ends (array<long>, the
    character each token ends at).  Null and empty texts have no tokens; both
    digests are then of nothing.  Very long texts are encoded whole; repeated
    rows give repeated results; a result column's name must not be in ``keep``.
    """
    import pyspark.sql.types as T

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if not digests_only:
        added += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))]
    clash = {f.name for f in added} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are result columns")
    schema = T.StructType([docs.schema[c] for c in keep] + added)
    source = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for whole in batches:
            for batch in (whole.slice(i, ROWS_AT_ONCE) for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                n, ids_sha, dec_sha, all_ids, all_ends = [], [], [], [], []
                part = [t or "" for t in batch.column(len(keep)).to_pylist()]
                for t, ids in zip(part, codec.encode_many(part), strict=True):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    dec_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if not digests_only:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int64))
                        all_ends.append(codec.offsets(t, ids)[:, 1])
                columns = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
                if not digests_only:
                    columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_ends, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *(f.name for f in added)])
        codec.memo.clear()

    return source.mapInArrow(lean(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), default_ranks_path(), public_tokenizers.PATTERN, ["doc_id"], digests_only=True)
