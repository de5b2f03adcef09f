"""Byte-pair encoding and decoding with a published vocabulary.

Each word is a doubly linked list of symbols. A heap holds the mergeable neighbours by (rank, position); the lowest
rank is popped, entries whose symbols have changed since they were pushed are skipped as stale, the pair is joined
in place and its two new neighbours are pushed. That is O(n log n) for a word of n symbols, so a text that is one
word of a million letters is no special case. Decoding looks every id up in the vocabulary and joins the strings.
"""

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docketlens.llm.common import ship

#: Words whose encoding a Python worker remembers; beyond it, the memory is emptied and filled anew.
CACHE_WORDS = 150_000

#: Documents in an output batch.
STEP = 200


def byte_letters() -> list[str]:
    """The printable letter for each byte: bytes that print stand for themselves, the others for code points from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Words(dict):
    """From words to their ids."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.codec.word_ids(word)
        if len(word) < 64:
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        (pattern,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.words = Words(self)

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n, ranks = len(ids), self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = joined, -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                if found := ranks.get((joined, ids[after])):
                    heapq.heappush(heap, (found[0], i, joined, ids[after], found[1]))
            before = left[i]
            if before >= 0 and (found := ranks.get((ids[before], joined))):
                heapq.heappush(heap, (found[0], before, ids[before], joined, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self.words
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                # Sigma has no special form at the end of a word here: letters are lowered one by one.
                for word in self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()):
                    ids += words[word]
        return ids

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, with decode, decoded string: the text that the ids give back.

    A null text counts as empty and has no ids; an empty table gives an empty result. Rows are independent of each
    other, so that repeated rows, ties and other columns do not matter. The file at path must be on every executor.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in (batch.slice(at, STEP) for at in range(0, batch.num_rows, STEP)):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decode else ""))
