"""Token counts by byte-pair merging on a heap and a linked list; no ids are produced.

The count of a unit is its initial symbols minus the merges, plus the extra bytes of characters that the
vocabulary lacks (byte fallback).

Defined cases: a null text counts as empty and has no tokens; texts of any length are counted whole; every row
gives a row, repeated or not; a null id stays null; an empty table gives no rows; columns other than `doc_id` and
`text` are not looked at; control strings inside a text are ordinary text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
from pyspark.sql import DataFrame

from cartflow.llm.common import Memo, per_batch, text_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096

SPACE = "▁"  # the vocabulary's sign for a space
# No piece of the vocabulary has the sign for a space after another character (`Counter` checks it), so no merge
# crosses from a word into the space behind it and such units are counted on their own.
UNITS = re.compile(" *[^ ]+| +")


class Counter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # Higher scores merge first; the sign for a space is put back to a space, as in the texts.
        self.order = {model.id_to_piece(i).replace(SPACE, " "): -model.get_score(i) for i in normal}
        if any(" " in piece.lstrip(" ") for piece in self.order):
            raise ValueError("pieces that go on over a space are not supported")
        self.memo = Memo(self.count_unit)

    def count_unit(self, unit: str) -> int:
        order, end = self.order, len(unit)
        if unit in order and end == 1:
            return 1
        part = list(unit)
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        heap = []
        for i in range(end - 1):
            rank = order.get(unit[i : i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapify(heap)
        merges = 0
        while heap:
            _, left, size = heappop(heap)
            right = after[left]
            # Stale: one side is gone or has grown since the pair was queued.
            if not part[left] or right >= end or len(part[left]) + len(part[right]) != size:
                continue
            part[left] += part[right]
            part[right] = ""
            merges += 1
            following = after[left] = after[right]
            if following < end:
                before[following] = left
                pair = part[left] + part[following]
                if (rank := order.get(pair)) is not None:
                    heappush(heap, (rank, left, len(pair)))
            previous = before[left]
            if previous >= 0:
                pair = part[previous] + part[left]
                if (rank := order.get(pair)) is not None:
                    heappush(heap, (rank, previous, len(pair)))
        fallback = sum(len(x.encode("utf-8")) - 1 for x in part if len(x) == 1 and x not in order)
        return end - merges + fallback

    def count(self, text: str) -> int:
        if not text:
            return 0
        units = UNITS.findall(" " + text.replace(SPACE, " "))
        return sum(map(self.memo.__getitem__, units))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit. Rows are independent: no shuffle."""
    path = path or public_tokenizers.path(MODEL)

    def make():
        tokens = counter(path)

        def step(rows: dict) -> dict:
            counts = [tokens.count(text) for text in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_bytes": [len(text.encode("utf-8")) for text in rows["text"]],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return per_batch(docs.select("doc_id", text_of(docs).alias("text")), make, schema)
