"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie and packed in the same task, group by group, so token ids are never shuffled and a task holds one
group and one document. A document's full windows of `size` tokens are sequences of their own. What is left of each goes whole into a pool; a
pool of about `group` tokens is divided among windows by differencing: every rest starts as a partial partition of its own, and the two partial
partitions with the largest imbalance are merged, large sums against small ones, until one is left. Its windows are nearly equal. While one
exceeds the capacity, the window count rises; when a part in 256 more has not helped, the windows that are still too full give up what is beyond
the capacity, and that alone is cut to the room which others have.

Defined results: a null or empty text is the end id alone. Repeated rows and rows with a null doc_id are packed one by one. Equal lengths are
told apart by their order in the partition. A very long text is tokenised whole, in its row. An empty table gives an empty result. Only doc_id and text are read. sequence_id holds the task's partition in its upper bits: ids are unique in a run, but
not dense.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import table

END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
#: Characters that both libraries put in the same classes; other texts go the slower way.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _tokenizer(json_path: str, ranks_path: str | None):
    """text -> ids as the tokenizers library gives them. The same vocabulary as ranks serves the texts of which it is known to be equal."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    whole = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks_path:
        return whole
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def encode(text: str) -> np.ndarray:
        if _OTHER.search(text):
            return whole(text)
        try:
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        except (ValueError, RuntimeError):
            return whole(text)

    return encode


def difference(sizes: list[int], m: int) -> list[int]:
    """The window (0 to m - 1) of each size, by multiway differencing."""
    if not sizes:
        return []
    if m == 1:
        return [0] * len(sizes)
    # A partial partition: its sums in falling order less the least of them. made[i]: the two it came from and where each one's windows went.
    made: list[tuple[int, int, np.ndarray] | None] = [None] * len(sizes)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i))
    heapq.heapify(heap)
    unit = lambda i: np.concatenate(([sizes[i]], np.zeros(m - 1, np.int64)))
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a, None) if a >= len(sizes) else unit(a)
        both = both + (sums.pop(b) if b >= len(sizes) else unit(b))[::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        both = both[order] - both[order[-1]]
        made.append((a, b, order))
        sums[len(made) - 1] = both
        heapq.heappush(heap, (-int(both[0]), len(made) - 1))
    out = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(m, dtype=np.int32))]  # of a partial partition, the final window of each of its windows
    while todo:
        i, at = todo.pop()
        if made[i] is None:
            out[i] = int(at[0])
            continue
        a, b, order = made[i]
        own = np.empty(m, np.int32)
        own[order] = at
        todo += [(a, own), (b, own[::-1])]
    return out


def pack(rests: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """rests: tokens left of each document, under `size`. Windows of (document, start in the rest, length)."""
    least = -(-sum(rests) // size)
    for m in (least, least + max(1, least // 256)):
        at = difference(rests, m)
        windows: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, w in enumerate(at):
            windows[w].append((i, 0, rests[i]))
        room = [size - sum(p[2] for p in w) for w in windows]
        if min(room, default=0) >= 0:
            return [w for w in windows if w]
    # Too full: the end of the longest piece goes, to where it fits tightly, or else into the widest room as far as that goes.
    loose: list[tuple[int, int, int]] = []
    for w, r in zip(windows, room):
        while r < 0:
            i, a, n = max(w, key=lambda p: p[2])
            w.remove((i, a, n))
            over = min(n, -r)
            if over < n:
                w.append((i, a, n - over))
            loose.append((i, a + n - over, over))
            r += over
    free = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i, a, n in sorted(loose, key=lambda p: -p[2]):
        while n:
            j = bisect.bisect_left(free, (n, -1))
            r, k = free.pop(min(j, len(free) - 1))
            part = min(n, r)
            windows[k].append((i, a, part))
            a, n = a + part, n - part
            if r > part:
                bisect.insort(free, (r - part, k))
    return [w for w in windows if w]


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = 2048, group: int = 1 << 19) -> DataFrame:
    """A row per piece, as SCHEMA; each id of each document lies in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(json_path, ranks_path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        pool: list[tuple[int | None, np.ndarray, int, int]] = []
        pooled, rows = 0, []

        def crc(ids: np.ndarray) -> int:
            return zlib.crc32(ids.astype("<u4").tobytes())

        def flush():
            nonlocal sequence, pool, pooled
            for window in pack([len(x[1]) for x in pool], size):
                offset = 0
                for i, a, n in window:
                    doc, ids, start, of = pool[i]
                    rows.append((doc, start + a, n, crc(ids[a : a + n]), of, sequence, offset))
                    offset += n
                sequence += 1
            pool, pooled = [], 0

        def batch():
            nonlocal rows
            cols, rows = list(zip(*rows)), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                ids = np.append(encode(text), np.uint32(END)) if text else np.array([END], np.uint32)
                full = len(ids) - len(ids) % size
                for a in range(0, full, size):
                    rows.append((doc, a, size, crc(ids[a : a + size]), len(ids), sequence, 0))
                    sequence += 1
                if full < len(ids):
                    pool.append((doc, ids[full:].copy(), full, len(ids)))
                    pooled += len(ids) - full
                if pooled >= group:
                    flush()
                if len(rows) >= 8192:
                    yield batch()
        if pool:
            flush()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op8_kk_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
