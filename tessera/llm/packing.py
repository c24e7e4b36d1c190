"""Filling fixed-capacity containers with whole texts: sum-of-squares online packing.

A text of n tokens takes one slot in a container of ``capacity`` tokens; a longer text is cut into full containers and one
remainder. Items arrive one by one. Let N[h] be the number of open containers filled to h. An item of size s goes to the
level h for which the sum of N[h]^2 after the step is least: moving a container from h to h + s changes the sum by
-(2 N[h] - 1) unless h = 0 (a new container) and by +(2 N[h + s] + 1) unless h + s is the capacity (a full container is
no longer counted). Counts stand in one array over the levels, so a step costs one vector pass.

Scale: documents are dealt by a hash of their id to shards of a fixed expected number of documents (``shard_docs``); each
shard is packed by one task with its own level array. Only ids and sizes are shuffled, never text. What a shard leaves
open is bounded by the number of levels, so the share of unused room falls with ``shard_docs`` and doesn't depend on the
size of the corpus.

Defined results: a null or empty text has size 0 and stands in the container last used by its shard; texts are
measured whole; rows that repeat an id are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
SHARD_DOCS = 20_000


def load_tiktoken(path: str, pattern: str | None = None):
    """An encoder from a rank file of lines ``base64-token rank``."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern or split_pattern(), mergeable_ranks=ranks, special_tokens={})


def split_pattern() -> str:
    """The pre-tokenization pattern the vocabularies' module gives. It is read on the driver and sent along, so that all
    executors count alike; where the module is missing, a pattern has to be given."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens) of every document, null text as 0."""
    pattern = pattern or split_pattern()
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_tiktoken(tokenizer, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64())], [id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_tokens bigint")


class SumOfSquares:
    """The packer's state: one stack of open containers a level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.size: list[int] = []
        self.last = -1
        # cost of leaving level h: 2 N[h] - 1, out of reach where N[h] = 0, nothing at level 0
        self._leave = np.full(capacity + 1, np.iinfo(np.int64).max // 4)
        self._leave[0] = 0
        self._enter = np.ones(capacity + 1, np.int64)  # 2 N[h] + 1, nothing at the capacity
        self._enter[capacity] = 0

    def _recount(self, h: int) -> None:
        n = self.counts[h]
        self._leave[h] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self._enter[h] = 2 * n + 1

    def place(self, s: int) -> tuple[int, int]:
        """(container, room already taken in it) of an item of size s."""
        c = self.capacity
        if s == 0:
            if self.last < 0:
                self.last = len(self.size)
                self.size.append(0)
            return self.last, self.size[self.last]
        # of equal costs the fullest level wins
        costs = self._leave[: c - s + 1] + self._enter[s:]
        h = c - s - int(np.argmin(costs[::-1]))
        if h:
            at = self.open[h].pop()
            self.counts[h] -= 1
            self._recount(h)
        elif len(self.size) == 1 and self.size[0] == 0:
            at = 0  # opened by an empty text
        else:
            at = len(self.size)
            self.size.append(0)
        if h + s < c:
            self.open[h + s].append(at)
            self.counts[h + s] += 1
            self._recount(h + s)
        self.size[at] = h + s
        self.last = at
        return at, h


_SCHEMA = "container_id string, position int, {id} {kind}, piece int, token_start bigint, n_tokens bigint, fill_before int"


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, pattern: str | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(container_id, position, id, piece, token_start, n_tokens, fill_before): one row per piece of a document."""
    shards = max(1, -(-docs.count() // shard_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = token_counts(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, pattern=pattern)
    # rows without an id are dealt by their place, so that they don't meet in one shard
    place = F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(id_col)))
    dealt = sizes.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([id_col, "n_tokens"], kind="stable", na_position="first")
        state, out, held = SumOfSquares(capacity), [], {}
        for doc, n in zip(rows[id_col].tolist(), rows["n_tokens"].tolist(), strict=True):
            piece = start = 0
            while True:
                size = min(n - start, capacity)
                at, before = state.place(size)
                held[at] = held.get(at, 0) + 1
                out.append((f"{key[0]:06d}-{at:08d}", held[at], doc, piece, start, size, before))
                start, piece = start + size, piece + 1
                if start >= n:
                    break
        return pd.DataFrame(out, columns=["container_id", "position", id_col, "piece", "token_start", "n_tokens", "fill_before"])

    return dealt.groupBy("shard").applyInPandas(pack, _SCHEMA.format(id=f"`{id_col}`", kind=kind))
