"""Token counts by byte-pair merging, without emitting identifiers.

Method: a word's initial symbols form a linked list, adjacent pairs lie in a heap by merge rank; the lowest pair is
popped and merged until none is left. The count is the number of initial symbols minus the merges done. Words
repeat, so each distinct white-space chunk is merged once while it stays in a worker's bounded table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Most chunks a worker remembers; beyond it the table is emptied and filled anew. Memory only, not results.
REMEMBERED = 1_000_000

#: White space as the normaliser's regular expression knows it (Unicode White_Space).
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(f"[{WHITE_SPACE}]+")
#: str.split() also cuts at these, the normaliser does not.
_ODD = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """The pieces between white space. No token crosses white space."""
    if _ODD.search(text):
        return [c for c in _WHITE.split(text) if c]
    return text.split()


class MergeCounter:
    """Counts tokens as a word-end byte-pair vocabulary (a ``.json`` file of the tokenizers library) gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = {s[:2] for s in special}
        self.byte = _byte_letters()
        self.known: dict[str, int] = {}

    def pairs_merged(self, symbols: list[str]) -> int:
        """Merges done on one word: pop the lowest-rank pair of neighbours (leftmost on ties) until none is left."""
        n = len(symbols)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else -1
            if j < 0 or symbols[j] != right:
                continue  # one side has been merged meanwhile
            symbols[i] = left + right
            symbols[j] = ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            done += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return done

    def chunk_tokens(self, chunk: str) -> int:
        """Tokens of a chunk without white space: normalise, split into pieces, merge each."""
        total = 0
        text = unicodedata.normalize("NFC", chunk)
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()  # no context rule for a final sigma
        for piece in self.piece.findall(text):
            symbols = [self.byte[b] for b in piece.encode("utf-8", "replace")]
            symbols[-1] += self.end
            total += len(symbols) - self.pairs_merged(symbols)
        return total

    def _fill(self, pieces: list[str]) -> None:
        for c in set(pieces).difference(self.known):
            self.known[c] = self.chunk_tokens(c)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text. Special strings inside are one token each, as the library's default."""
        if not text:
            return 0
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        pieces = chunks(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            self._fill(pieces)
            return sum(map(self.known.__getitem__, pieces))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else from code point 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_counters: dict[str, MergeCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row of ``docs``.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted each; other columns are ignored. One
    pass in Arrow batches, no shuffle; the vocabulary is found by name on each executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = MergeCounter(vocabulary_path(vocabulary))
        counter = _counters[vocabulary]
        for batch in batches:
            texts = batch.column("text")
            n_tokens = [counter.count(t.as_py()) for t in texts]
            n_bytes = [0 if (b := t.as_buffer()) is None else b.size for t in texts]
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = StructType([docs.schema["doc_id"]] + StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean").fields)
    return docs.select("doc_id", "text").mapInArrow(count, schema)
