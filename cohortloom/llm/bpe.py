"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as two lists side by side: its parts (the boundaries) and the rank of each pair of neighbours.
The smallest rank is found by a scan, one boundary goes, and the ranks on both sides are looked up again.
That is quadratic in the word's length with a very small constant, so it serves words of up to `SHORT` symbols;
longer ones (base64, URLs without breaks) take a heap over a linked list, which gives the same merges.

Words repeat, so each task keeps a bounded table of words it has encoded; it goes with the task, as Spark keeps Python
workers for other stages. The job has no shuffle: it is a map over the rows, and a lost executor costs only its tasks.

Defined results: a null or empty text has no tokens and decodes to the empty text; other columns pass
through untouched, except that columns named as the outputs are replaced; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 256
CACHED_WORDS = 400_000
ROWS_AT_ONCE = 512
FILE_BOUND = 64 << 20
NO_RANK = 1 << 40

# Characters for which lower-casing, composition and classes are the same in every Unicode version in use:
# Latin with its extensions, dashes and quotes. Texts with others go through the library's own normaliser.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The printable stand-in for each byte: itself where printable, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b if b in own else free))
        free += b not in own
    return letters


class WordBpe:
    """A tokenizer file of kind BPE with word ends, read once per Python worker."""

    def __init__(self, spec: str):
        import tokenizers

        made = json.loads(spec)
        model = made["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in (self.vocab | self.special).items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.vocab[left], self.vocab[right]] = rank
            self.merged.append(self.vocab[left + right])
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        """Words of a text, in order; a special token's text is a word of its own."""
        if self.split and any(s in text for s in self.special):
            return [w for part in self.split.split(text) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _WORDS.findall(text.lower())
        lib = self.library
        found = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in w).decode("utf-8", "replace") for w, _ in found]

    def encode_word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if word in self.special:
                ids = [self.special[word]]
            else:
                symbols = [self.letters[b] for b in word.encode("utf-8")]
                symbols[-1] += self.end
                ids = [self.vocab[s] for s in symbols]
                ids = self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def merge_short(self, parts: list[int]) -> list[int]:
        rank_of = self.pairs.get
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.pairs.get
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := rank_of((parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[after[a]]))
        return [p for p, there in zip(parts, alive) if there]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.encode_word(w)]

    def decode(self, ids) -> str:
        """Tokens joined by a space, as a file without a decoder has it; unknown ids are skipped."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])


_made: dict[str, WordBpe] = {}


def _tokenizer(spec: str) -> WordBpe:
    if spec not in _made:
        _made.clear()
        _made[spec] = WordBpe(spec)
    return _made[spec]


def _spec(path: str) -> str:
    """The tokenizer file, read on the driver and sent with the tasks; its size is checked."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(FILE_BOUND + 1)
    if len(spec) > FILE_BOUND:
        raise ValueError(f"{path} is larger than {FILE_BOUND} characters")
    return spec


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `ids` (array of int) and `decoded` (the ids turned back into text) for every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer_path))
    kept = docs.select([c for c in docs.columns if c not in (ids, decoded)])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    slots: dict[str, int] = {}
                    rows = [[slots.setdefault(w, len(slots)) for w in bpe.words(t)] if t else [] for t in batch.column(text).to_pylist()]
                    encoded = [bpe.encode_word(w) for w in slots]
                    texts = [bpe.decode(x) for x in encoded]
                    size = np.array([len(x) for x in encoded], dtype=np.int64)
                    start = np.concatenate([[0], np.cumsum(size)])
                    flat = np.fromiter((i for x in encoded for i in x), dtype=np.int32, count=int(start[-1]))
                    word = np.fromiter((k for r in rows for k in r), dtype=np.int64, count=sum(map(len, rows)))
                    n = size[word]
                    ends = np.cumsum(n)
                    picked = flat[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - start[word], n)]
                    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])])]
                    back = pa.array([" ".join([texts[k] for k in r]) for r in rows], pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(picked, pa.int32())), back], names=[*batch.schema.names, ids, decoded])
        finally:
            # The worker stays, idle or in other stages, and a process that keeps its words is as large as its longest run of tasks.
            bpe.known.clear()

    return kept.mapInArrow(apply, schema)


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of every whole text."""
    return round_trip(docs, tokenizer_path, text, ids, "__decoded").drop("__decoded")


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids (null: empty)."""
    spec = rows.sparkSession.sparkContext.broadcast(_spec(tokenizer_path))
    kept = rows.select([c for c in rows.columns if c != decoded])
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(apply, schema)


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    out = round_trip(docs.select("doc_id", "text"), tokenizer_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
