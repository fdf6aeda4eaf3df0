"""Token counts by byte-pair merging over a linked list with a heap; no token ids are made.

Method: a pre-token starts as one symbol per byte, linked in order. The adjacent pair with the lowest
merge rank (leftmost first) is popped from a heap and joined, its new neighbours are pushed, and the count is
the initial symbols less the merges. Counts of short pre-tokens are remembered per worker.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from tallyframe.llm.columns import kept_fields, with_text

#: Remembered pre-tokens per worker; a full memory is emptied, which changes speed only.
MEMORY = 400_000
#: Longer pre-tokens are merged each time instead of remembered.
LONGEST_KEPT = 64
#: Longer texts are matched lazily, so that their pre-tokens are never held together.
LONG_TEXT = 1 << 20

# Below U+0530 these classes equal those of the tokenizer's own pattern (tests compare every code point);
# other texts are cut by the tokenizer library.
OTHER = re.compile(r"[^\x00-\x1b\x20-ԯ]")
_N = "²³¹¼-¾"
PRETOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[^\W\d_{_N}]+|[\d{_N}]+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class HeapBpe:
    """Counts tokens as the tokenizer file's own library does, without added tokens at the ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level files without normalizer and prefix space are counted")
        if model.get("type") != "BPE" or model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-pair models are counted")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbol = dict(enumerate(byte_symbols()))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.memory: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token: initial symbols less merges."""
        symbols = list(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbol))
        n, rank = len(symbols), self.rank
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after, merges = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def pieces(self, text: str):
        if OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        if len(text) > LONG_TEXT:
            return (m.group() for m in PRETOKEN.finditer(text))
        return PRETOKEN.findall(text)

    def _piece(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        total, known = len(parts) - 1, self.memory.get
        for part in parts:
            for piece in self.pieces(part):
                total += known(piece) or self._piece(piece)
        return total


@functools.lru_cache(maxsize=4)
def counter(path: str) -> HeapBpe:
    return HeapBpe(path)


def count_tokens(
    df: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 512
) -> DataFrame:
    """``keep`` plus n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    ``tokenizer`` is a file every executor has. No shuffle; one row out per row in, in any order. Null
    and empty texts have 0 bytes and 0 tokens; null ids and repeated rows pass through; other columns are
    not read; an empty table gives an empty result.
    """
    schema = T.StructType(
        [
            *kept_fields(df, keep),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    keep = list(keep)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(tokenizer)
        for batch in batches:
            texts = batch.column(len(keep))
            n = [bpe.count(t.as_py()) for t in texts]
            size = [0 if t.as_py() is None else t.as_buffer().size for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return with_text(df, text, keep).mapInArrow(counted, schema)
