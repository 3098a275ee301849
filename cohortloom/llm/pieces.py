"""SentencePiece encoding and decoding of kind BPE with a merge-type prefix table.

For each prefix of a word one token is its last: the one that ends there and is compatible with the last token of what
comes before it. An automaton over the pieces gives all tokens that end at a place, a pair test tells which is
compatible, and the ids are read off the table from the end backwards. Two tokens are compatible if merging never joins
across their border: their merges are undone in turn, the later one first, and no pair across the border may be one that
would have been merged before the merge undone last. Each piece's own last merge is found when the model is read;
pieces that merging never makes are no tokens of the table. Equal scores go to the left-most pair, as in the library.

Texts are cut where no piece can cross: between a character and a mark for a space after it, between letters and other
characters, and around characters that are in no piece of two or more; the first two only if the model's pieces agree. Pieces of text repeat, so each Python worker keeps a bounded table of them. The time is
linear in the text, however long a piece of it is without a cut. A map over rows without a shuffle: a lost executor
costs its tasks only.

A model file is refused if it isn't of kind BPE, has pieces defined by a user or unused ones, normalises by a table of
characters, removes extra blanks, has no bytes to fall back on, or has a piece whose parts merge later than itself.

Defined results: a null or empty text has the end id alone and decodes to the empty text, a null array of ids decodes to
the empty text; ids outside the vocabulary raise; repeated rows repeat; other columns pass through, except those named
as the outputs, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_WORDS = 600_000
CACHED_CHARS = 64
CACHED_PAIRS = 4_000_000
ROWS_AT_ONCE = 2048
FILE_BOUND = 64 << 20

# Fixed values of the public model format: kinds of pieces, the field of the model kind for BPE, the mark for a space
# and the text of an unknown id.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message: whole numbers, or the bytes of strings, messages and floats."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A model file, read once per Python worker."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trained: dict = {}
        rules: dict = {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trained = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        self._refuse(trained, rules)
        self.prefix = bool(rules.get(3, 1))
        self.end_id = trained.get(42, 2)
        self.unknown_text = trained[44].decode("utf-8") if 44 in trained else UNKNOWN_TEXT
        self.bytes = [0] * 256
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
        self.controls = {i for i, kind in enumerate(self.kinds) if kind == CONTROL}
        self.made = [self._bytes_of(i) for i in range(len(self.pieces))]
        self._learn_merges({p: (i, s) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds)) if k == NORMAL})
        self.size = [len(p) for p in self.pieces]
        self.known: dict[str, tuple[int, ...]] = {}
        self.compatible: dict[int, bool] = {}

    def _refuse(self, trained: dict, rules: dict) -> None:
        if trained.get(3, 1) != BPE:
            raise ValueError("the model is not of kind BPE")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces defined by a user and unused pieces are not supported")
        if self.kinds.count(BYTE) != 256:
            raise ValueError("the model has no bytes to fall back on")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trained.get(24, 0):
            raise ValueError("the model's normaliser is not supported")

    def _bytes_of(self, i: int) -> bytes:
        """What an id decodes to."""
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == CONTROL else self.unknown_text.encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode("utf-8")

    def _learn_merges(self, tokens: dict[str, tuple[int, float]]) -> None:
        """Ranks of tokens, the parts of each one's last merge, pairs by token, the automaton and where texts can be cut."""
        order = {s: r for r, s in enumerate(sorted({s for p, (_, s) in tokens.items() if len(p) > 1}, reverse=True))}
        rank_of = {p: order[s] for p, (_, s) in tokens.items() if len(p) > 1}
        n = len(self.pieces)
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        joined: set[str] = set()
        self.crossed = self.mixed = False
        for piece, (i, _) in tokens.items():
            if len(piece) > 1:
                parts = self._last_merge(piece, rank_of)
                joined |= set(piece)
                borders = [(a, b) for a, b in zip(piece, piece[1:]) if a != b]
                self.crossed = self.crossed or any(b == SPACE for _, b in borders)
                self.mixed = self.mixed or any(SPACE not in x and x[0].isalpha() != x[1].isalpha() for x in borders)
                if parts is None:
                    continue
                a, b = parts
                if max(rank_of.get(a, -1), rank_of.get(b, -1)) > rank_of[piece]:
                    raise ValueError(f"the parts of {piece!r} merge later than it does")
                self.rank[i], self.left[i], self.right[i] = rank_of[piece], tokens[a][0], tokens[b][0]
                self.merged[self.left[i], self.right[i]] = i
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.single = {p: i for p, (i, _) in tokens.items() if len(p) == 1}
        letters, others = ({c for c in joined - {SPACE} if c.isalpha() == kind} for kind in (True, False))
        if self.mixed:
            letters, others = letters | others | ({SPACE} if self.crossed else set()), set()
        classes = ["[" + "".join(map(re.escape, sorted(c))) + "]" for c in (letters, others) if c]
        self.cut = re.compile("|".join([*[("" if self.crossed else f"{SPACE}*") + f"{c}+" for c in classes], f"{SPACE}+", "."]), re.DOTALL)

    @staticmethod
    def _last_merge(piece: str, rank_of: dict[str, int]) -> tuple[str, str] | None:
        """The two parts that merging joins last to make the piece, none if merging ends with other pieces."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [rank_of.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 40:
                return None
            k = ranks.index(least)
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def _pair(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two tokens alone."""
        rank, merged, limit = self.rank, self.merged.get, 1 << 40
        while True:
            across = merged((a, b))
            if across is not None and rank[across] < limit:
                return False
            if rank[a] > rank[b]:
                # The merge on the left is further left than the border: it goes before an equal one across it.
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a text that holds no cut."""
        single, n = self.single, len(word)
        if n == 1:
            i = single.get(word, -1)
            return (i,) if i >= 0 else tuple(self.bytes[b] for b in word.encode("utf-8"))
        # Entry k of the table is the last token of the first k characters. Exactly one token is: where no token of two
        # characters or more is compatible it is the last character alone, -1 if that is outside the vocabulary.
        last, filled, size = [-1] * (n + 1), 1, self.size
        pairs, many = self.compatible, len(self.pieces)
        if len(pairs) > CACHED_PAIRS:
            pairs.clear()
        for end, token in self.automaton.iter(word):
            while filled <= end:
                if last[filled] < 0:
                    last[filled] = single.get(word[filled - 1], -1)
                filled += 1
            if last[filled] < 0:
                before = last[filled - size[token]] if filled > size[token] else -1
                if before >= 0:
                    fits = pairs.get(before * many + token)
                    if fits is None:
                        fits = pairs[before * many + token] = self._pair(before, token)
                    if not fits:
                        continue
                last[filled] = token
        for at in range(filled, n + 1):
            if last[at] < 0:
                last[at] = single.get(word[at - 1], -1)
        ids, at = [], n
        while at:
            token = last[at]
            if token < 0:
                ids.extend(self.bytes[b] for b in reversed(word[at - 1].encode("utf-8")))
                at -= 1
            else:
                ids.append(token)
                at -= size[token]
        ids.reverse()
        return tuple(ids)

    def words(self, text: str) -> list[str]:
        """Parts of a text between its cuts; their ids follow each other."""
        return self.cut.findall((SPACE if self.prefix and text else "") + text.replace(" ", SPACE))

    def word_ids(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.encode_word(word)
            if len(word) <= CACHED_CHARS:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without an end id."""
        return list(chain.from_iterable(map(self.word_ids, self.words(text))))

    def encode_all(self, texts: list[str], tail: list[int]) -> pa.ListArray:
        """Ids of texts with the same ids after each; words that repeat among the texts are encoded once."""
        rows = [self.words(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(rows)), pa.string()).dictionary_encode()
        encoded = [*map(self.word_ids, coded.dictionary.to_pylist()), tuple(tail)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        start = np.cumsum(size) - size
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(size.sum()))
        # The words of a row, then one more for what comes after each text.
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        word = np.insert(np.asarray(coded.indices), ends, len(encoded) - 1)
        n = size[word]
        stops = np.cumsum(n)
        picked = flat[np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - n - start[word], n)]
        offsets = np.concatenate([[0], stops[ends + np.arange(len(rows))]]) if rows else np.zeros(1, np.int64)
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(picked)).cast(pa.list_(pa.int32()))

    def decode(self, ids) -> str:
        """Text of ids: marks are spaces, bytes that are no UTF-8 are U+FFFD each, the blank before the first piece goes."""
        made, kinds = self.made, self.kinds
        if not self.controls.isdisjoint(ids):
            # Control ids give no text; bytes on both sides of one are no character together.
            parts: list[list[int]] = [[]]
            for i in ids:
                parts[-1].append(i) if i not in self.controls else parts.append([])
        else:
            parts = [ids]
        first = next((part for part in parts if part), None)
        text = "".join([self._text(part) for part in parts if part])
        return text[1:] if self.prefix and first is not None and kinds[first[0]] == NORMAL and made[first[0]].startswith(b" ") else text

    def decode_all(self, arrays: pa.ListArray) -> pa.StringArray:
        """Texts of arrays of ids."""
        flat = arrays.flatten().to_numpy(zero_copy_only=False).tolist()
        stops = np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)).tolist()
        return pa.array([self.decode(flat[a:b]) for a, b in zip([0, *stops], stops)], pa.string())

    def _text(self, ids: list[int]) -> str:
        data = b"".join(map(self.made.__getitem__, ids))
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("utf-8", _EACH_BYTE)


_EACH_BYTE = "cohortloom-each-byte"


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


_made: dict[bytes, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    import codecs

    codecs.register_error(_EACH_BYTE, _one_byte)
    if data not in _made:
        _made.clear()
        _made[data] = PieceModel(data)
    return _made[data]


def _file(path: str) -> bytes:
    """The model file, read on the driver and sent with the tasks; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(FILE_BOUND + 1)
    if len(data) > FILE_BOUND:
        raise ValueError(f"{path} is larger than {FILE_BOUND} bytes")
    return data


def round_trip(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", end: bool = True) -> DataFrame:
    """Adds `ids` (array of int, with the end id if `end`) and `decoded` (the text of these ids) for every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(_file(model_path))
    kept = docs.select([c for c in docs.columns if c not in (ids, decoded)])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model.value)
        tail = [own.end_id] if end else []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                encoded = own.encode_all([t or "" for t in batch.column(text).to_pylist()], tail)
                back = own.decode_all(encoded)
                yield pa.RecordBatch.from_arrays([*batch.columns, encoded, back], names=[*batch.schema.names, ids, decoded])

    return kept.mapInArrow(apply, schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """Adds the ids of every whole text."""
    return round_trip(docs, model_path, text, ids, "__decoded", end).drop("__decoded")


def decode(rows: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids (null: empty)."""
    model = rows.sparkSession.sparkContext.broadcast(_file(model_path))
    kept = rows.select([c for c in rows.columns if c != decoded])
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode_all(batch.column(ids))], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(apply, schema)


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens with the end id, and the digests of the ids and of the decoded text."""
    out = round_trip(docs.select("doc_id", "text"), model_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
