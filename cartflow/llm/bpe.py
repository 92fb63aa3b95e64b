"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

`encode_documents` returns one row per document with its token ids, `decode_ids` gives the bytes back.

Defined cases: a null text counts as empty and has no tokens; a text of any length is encoded whole; rows that
repeat an id or a text each give a row; a null id stays null; an empty table gives no rows; columns other than
`doc_id` and `text` are not looked at. There are no special tokens: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from cartflow.llm.common import Memo, per_batch, text_of

RANKS = "byte_bpe_50k.tiktoken"

# A space directly before a visible character always starts a new match of the pattern: no alternative continues
# over a space, and white space before it gives up exactly its last character. So texts can be cut there.
UNIT_START = re.compile(r" (?=\S)")

BITS = 8  # ranks per leaf of the bitmap, as a power of two; two levels cover 65,536 ranks
MARK = [1 << bit for bit in range(1 << BITS)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes with `ranks`; `pattern` gives the pre-tokens.

    Queue of a merge: positions wait in a bucket per rank, a bitmap of two levels marks the ranks in use, and
    find-first-set on both gives the next rank. A bucket is a heap, so equal ranks come from left to right.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        if max(ranks.values()) >> 2 * BITS:
            raise ValueError("more ranks than the bitmap has bits")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.matches = regex.compile(pattern)
        self.leaves = [0] * (1 << BITS)  # all zero between merges
        self.memo = Memo(self.encode_unit, 250_000)
        self.merged = Memo(self.merge)

    def merge(self, pretoken: str) -> bytes:
        """The packed ids of one pre-token. Tokens are slices of it; `after` and `before` link their starts."""
        rank_of, packed, leaves = self.ranks.get, self.packed, self.leaves
        piece = pretoken.encode("utf-8")
        if (whole := rank_of(piece)) is not None:
            return packed[whole]
        end = len(piece)
        after = list(range(1, end + 2))
        before = list(range(-1, end))
        pair = [-1] * (end + 1)  # the rank of the pair that starts here; queue entries that differ are stale
        buckets: dict[int, list[int]] = {}
        top = 0
        fresh = [(i, rank_of(piece[i : i + 2])) for i in range(end - 1)]
        while True:
            for at, rank in fresh:
                if rank is None:
                    continue
                pair[at] = rank
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    leaves[rank >> BITS] |= MARK[rank & 255]
                    top |= MARK[rank >> BITS]
            left = -1
            while top:
                high = (top & -top).bit_length() - 1
                word = leaves[high]
                low = word & -word
                rank = (high << BITS) + low.bit_length() - 1
                bucket = buckets[rank]
                left = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    leaves[high] = word = word ^ low
                    if not word:
                        top ^= MARK[high]
                if pair[left] == rank:
                    break
                left = -1
            if left < 0:
                break
            right = after[left]
            follower = after[left] = after[right]
            before[follower] = left
            previous = before[left]
            pair[left] = pair[right] = -1
            fresh = [(left, rank_of(piece[left : after[follower]]))] if follower < end else []
            if previous >= 0:
                pair[previous] = -1
                fresh.append((previous, rank_of(piece[previous:follower])))
        ids, at, tokens = [], 0, self.ranks
        while at < end:
            ids.append(packed[tokens[piece[at : after[at]]]])
            at = after[at]
        return b"".join(ids)

    def encode_unit(self, unit: str) -> bytes:
        return b"".join([self.merged[match] for match in self.matches.findall(unit)])

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        first, *rest = UNIT_START.split(text)
        memo = self.memo
        return memo[first] + b"".join([memo[" " + unit] for unit in rest])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: the ranks are read once and the memo serves all its tasks."""
    return Encoder(load_ranks(path))


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and the ids themselves.

    Rows are independent, so there is no shuffle; a task holds one batch of texts at a time.
    """
    path = path or public_tokenizers.path(RANKS)

    def make():
        bpe = encoder(path)

        def step(rows: dict) -> dict:
            ids = [bpe.encode(text) for text in rows["text"]]
            out = {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }
            return out | {"ids": ids} if keep_ids else out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return per_batch(docs.select("doc_id", text_of(docs).alias("text")), make, schema + ", ids binary" * keep_ids)


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of `ids`; null ids give a null text.

    Ids that were cut inside a character decode to its replacement character.
    """
    path = path or public_tokenizers.path(RANKS)

    def make():
        bpe = encoder(path)

        def step(rows: dict) -> dict:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in rows["ids"]]
            return {"doc_id": rows["doc_id"], "text": texts}

        return step

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return per_batch(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, text string")
