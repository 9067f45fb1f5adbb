"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

The encoding of a string is a chain of tokens in which every two neighbours are compatible: merging the two tokens' own text gives just these
two. Every prefix has one such chain, so one last token. The table is filled from left to right: an automaton over the vocabulary lists the
tokens that end at a position, and the one that is compatible with the last token of the prefix before it is stored. Ids are then read
backwards from the end of the table. Compatibility is tested by merging the pair's text and remembered by pair.

No piece holds a line feed, and none holds a blank after another character (checked when the model is loaded), so merges never cross these
places: lines and words are encoded on their own and remembered, in two generations of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text. A very long text is encoded whole, by the task that has its row. Repeated rows stay repeated; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import table

BLANK = "▁"
#: Before the first token; no token fits.
START, NONE = 65535, -1


class PieceEncoder:
    """Encodes as the sentencepiece library does with a BPE model of the identity normalizer, with dummy prefix and byte fallback."""

    def __init__(self, model_path: str, remember: int = 250_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                self.pieces[p], self.score[p] = i, self.sp.get_score(i)
        if self.sp.get_piece_size() >= START:
            raise ValueError("ids need more than 16 bits")
        if any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in self.pieces):
            raise ValueError("a piece crosses a line or a word")
        self.text = {i: p for p, i in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # id before, or START, << 16 | id
        self.decimal = [str(i) for i in range(self.sp.get_piece_size())]
        self.remember = remember
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose piece has the highest score, the leftmost first, until none is a piece."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if a >= 0 and b < len(part) and (p := part[a] + part[b]) in self.score:
                heapq.heappush(heap, (-self.score[p], a, b, p))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, a, b, p = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != p:
                continue
            part[a], part[b] = p, None
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in part if p is not None]

    def compatible(self, before: int, i: int) -> bool:
        """Whether the piece i can follow a piece, or START."""
        b = self.text[i]
        if before == START:
            ok = self.merged(b) == [b]
        else:
            ok = self.merged((a := self.text[before]) + b) == [a, b]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[before << 16 | i] = ok
        return ok

    def tokens(self, text: str) -> list[int] | None:
        """Ids by the prefix table; None if a character that no piece covers is in the way."""
        n = len(text)
        last = [NONE] * (n + 1)
        last[0] = START
        width = [0] * (n + 1)
        known = self.pairs.get
        for end, (i, k) in self.automaton.iter(text):
            end += 1
            if last[end] == NONE and (before := last[end - k]) != NONE:
                ok = known(before << 16 | i)
                if ok or ok is None and self.compatible(before, i):
                    last[end], width[end] = i, k
        if last[n] == NONE:
            return None
        out = []
        while n:
            out.append(last[n])
            n -= width[n]
        out.reverse()
        return out

    def strange(self, text: str) -> list[str]:
        """The same for texts with characters that are no pieces: such a character is a token of its own."""
        n = len(text)
        ends: list[list[str]] = [[c] if c not in self.pieces else [] for c in text]
        for end, (i, _) in self.automaton.iter(text):
            ends[end].append(self.text[i])
        last = [""] * (n + 1)
        for end in range(1, n + 1):
            for p in ends[end - 1]:
                before = last[end - len(p)]
                if (end == len(p) or before) and self.merged(before + p) == ([before, p] if before else [p]):
                    last[end] = p
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def unit(self, text: str) -> bytes:
        """Ids of a word, as unsigned 16-bit numbers."""
        got = self.old.get(text)
        if got is None:
            ids = self.tokens(text)
            if ids is None:
                ids = []
                for p in self.strange(text):
                    i = self.pieces.get(p)
                    ids += [i] if i is not None else [self.bytes[x] for x in p.encode()]
            got = array("H", ids).tobytes()
        if len(text) <= 64:
            if len(self.young) >= self.remember:
                self.young, self.old = {}, self.young
            self.young[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        units = re.findall(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+", BLANK + text.replace(" ", BLANK))
        got = list(map(self.young.get, units))
        if None in got:
            unit = self.unit
            got = [unit(u) if x is None else x for u, x in zip(units, got)]
        return array("H", b"".join(got)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(maxsize=2)
def encoder(model_path: str) -> PieceEncoder:
    return PieceEncoder(model_path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: ids and decoded as well."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for b in batches:
            rows = []
            for text in b.column(1):
                ids = e.encode(text.as_py() or "")
                decoded = e.decode(ids)
                row = (len(ids), hashlib.sha256(",".join([e.decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids, decoded) if with_ids else row)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types[: 3 + 2 * with_ids]]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op4_piece_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
