"""Order-preserving packing by dynamic programming.

Texts are tokenised and laid end to end in id order. Window cuts are chosen at document or sentence
boundaries (and, where a sentence is long, at places within it) so that padding plus truncation
penalties are least. With f(j) the least cost of everything before boundary j,

    f(j) = penalty(j) + min over i of f(i) + padding(position(j) - position(i))

and padding is capacity - length, so for the window before j the minimum is that of f(i) + position(i): a
queue kept monotone gives it in constant time. A sequence whose length is a power of two has no
padding; these few starts are looked up apart.

The rows are range-partitioned and sorted by id. A partition is packed as a stream of segments of
about ``SEGMENT`` tokens: all windows of a segment but the last are final, and the last one's tokens
begin the next segment, so memory is bounded and only a partition's last window ends early.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import text_batches

CAPACITY, END_ID, SEGMENT, STEP = 4096, 2, 1 << 19, 32
#: Sequences of a power of two are cut on purpose only from this length on, lest there be many tiny ones.
SHORTEST = 512
#: Penalties, in tokens, for a cut at the end of a sentence and within one; the end of a document costs nothing.
SENTENCE, WITHIN = 8, 48
CACHED_WORDS = 150_000
_ENDINGS = (".", "!", "?", "。", "…")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class _Words(dict):
    """Ids by word; a word that is not there is looked up among the older words, else encoded."""

    def __init__(self, encode: Callable[[bytes], bytes], older: dict[bytes, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across white space.

    Texts are cut at ASCII white space, and the ids of a word are kept for its next use, as encoding words
    anew is nearly all the work. A new word of ASCII characters and Latin letters is cut into the
    tokenizer's own pieces (contractions, runs of letters, single digits, runs of other characters), which are kept too and go to the
    model past the steps that would not change them. Any other word is encoded in full. A full
    store of words replaces the older one, from which words still in use come back.
    """

    _LATIN = "a-zà-öø-ÿß"
    _PLAIN = re.compile(rf"[!-@\[-`{{-~{_LATIN}]+")
    _PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^0-9{_LATIN}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.words = _Words(self._word, {})
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, i in vocabulary.items():
            word = token.removesuffix("</w>")
            if word and word[-1] in _ENDINGS:
                self.ending[i] = True

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII letters alone are one piece
            return self._piece(word.decode())
        text = word.decode()
        lower = text.lower()
        if len(lower) != len(text) or not self._PLAIN.fullmatch(lower) or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for piece in self._PIECES.findall(lower):
            ids = self.pieces.get(piece)
            if ids is None:
                self.pieces[piece] = ids = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHED_WORDS:
            self.words = _Words(self._word, dict(self.words))
        if len(self.pieces) > CACHED_WORDS:
            self.pieces.clear()
        kept = self.words.__getitem__
        # Spelled-out special tokens have no upper-case form, so a text that could hold one keeps its case.
        return [np.frombuffer(b"".join(map(kept, (b if b"<|" in b else b.lower()).split())), dtype="<u4") for b in (t.encode() for t in texts)]


@lru_cache(1)
def kept_tokenizer(path: str) -> WordTokenizer:
    """One for all partitions that a Python worker packs, so that its words are kept between them."""
    return WordTokenizer(path)


def choose_cuts(positions: list[int], penalties: list[int], capacity: int) -> list[int]:
    """Indices of the chosen boundaries, the first and last of ``positions`` included, at least cost.

    ``positions`` ascend strictly, from 0, with gaps of at most ``capacity``.
    """
    place = {p: i for i, p in enumerate(positions)}
    powers = [1 << b for b in range(capacity.bit_length()) if SHORTEST <= 1 << b <= capacity]
    cost, back, key = [0.0], [0], [0.0]  # key: cost + position
    queue: deque[int] = deque([0])
    first = 0
    for j, at in enumerate(positions):
        if not j:
            continue
        while positions[first] < at - capacity:
            queue.popleft()
            first = queue[0]
        best, prev = key[first] + capacity - at, first
        for power in powers:
            i = place.get(at - power)
            if i is not None and cost[i] < best:
                best, prev = cost[i], i
        best += penalties[j]
        cost.append(best)
        back.append(prev)
        best += at
        key.append(best)
        while queue and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
        first = queue[0]
    chosen = [len(positions) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class _Packer:
    """Packs the documents of one partition in order; ``flush`` gives the pieces of final windows."""

    def __init__(self, chunk: int, capacity: int, ending: np.ndarray):
        self.chunk, self.capacity, self.ending = chunk, capacity, ending
        self.open: list[tuple[int, np.ndarray, int]] = []  # (document number, its ids, first id not packed)
        self.size, self.sequences = 0, 0

    def add(self, number: int, ids: np.ndarray) -> None:
        self.open.append((number, ids, 0))
        self.size += len(ids)

    def _boundaries(self) -> tuple[list[int], list[int]]:
        places, costs, base = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 0
        for _, ids, start in self.open:
            n = len(ids) - start
            ends = np.flatnonzero(self.ending[ids[start : start + n - 1]]) + 1
            here = [ends, np.array([n])]
            cost = [np.full(len(ends), SENTENCE), np.zeros(1, dtype=np.int64)]
            if n > STEP:
                marks = np.concatenate(([0], ends, [n]))
                long = np.flatnonzero(np.diff(marks) > 4 * STEP)
                inner = [np.arange(marks[g] + STEP, marks[g + 1], STEP) for g in long]
                if inner:
                    more = np.concatenate(inner)
                    here.append(more)
                    cost.append(np.full(len(more), WITHIN))
            place, price = np.concatenate(here), np.concatenate(cost)
            place, first = np.unique(place, return_index=True)
            price = price[first]
            price[-1] = 0
            places.append(place + base)
            costs.append(price)
            base += n
        return np.concatenate(places).tolist(), np.concatenate(costs).tolist()

    def flush(self, last: bool) -> Iterator[tuple[int, int, np.ndarray, int, int, int]]:
        """(document number, start, ids, document's length, sequence, offset)."""
        if not self.open:
            return
        positions, penalties = self._boundaries()
        cuts = [positions[i] for i in choose_cuts(positions, penalties, self.capacity)]
        if not last:
            cuts.pop()
        at, window = 0, 0
        rest: list[tuple[int, np.ndarray, int]] = []
        for number, ids, start in self.open:
            while start < len(ids):
                if window + 1 >= len(cuts):
                    rest.append((number, ids, start))
                    break
                n = min(len(ids) - start, cuts[window + 1] - at)
                yield number, start, ids[start : start + n], len(ids), (self.chunk << 32) + self.sequences, at - cuts[window]
                start, at = start + n, at + n
                if at == cuts[window + 1]:
                    window, self.sequences = window + 1, self.sequences + 1
        self.open = rest
        self.size = sum(len(ids) - start for _, ids, start in rest)


def _pack(tokenizer_path: str, end_id: int, capacity: int, with_ids: bool, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = kept_tokenizer(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), capacity, tokenizer.ending)
        doc_ids: dict[int, pa.Scalar] = {}
        id_type, number = pa.null(), 0

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            rows = list(packer.flush(last))
            for start in range(0, len(rows), 4096):
                part = rows[start : start + 4096]
                columns = [
                    pa.array([doc_ids[r[0]].as_py() for r in part], id_type),
                    pa.array([r[1] for r in part], pa.int64()),
                    pa.array([len(r[2]) for r in part], pa.int64()),
                    pa.array([r[2] for r in part], pa.list_(pa.int32())) if with_ids else pa.array([zlib.crc32(r[2]) for r in part], pa.int64()),
                    pa.array([r[3] for r in part], pa.int64()),
                    pa.array([r[4] for r in part], pa.int64()),
                    pa.array([r[5] for r in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            kept = {n: doc_ids[n] for n, _, _ in packer.open}
            doc_ids.clear()
            doc_ids.update(kept)

        for batch in text_batches(batches, 4 << 20):
            texts = tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])
            id_type = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0), texts, strict=True):
                doc_ids[number] = doc_id
                packer.add(number, np.append(ids, np.array([end_id], dtype="<u4")))
                number += 1
                if packer.size >= SEGMENT:
                    yield from pieces(False)
        yield from pieces(True)

    return pack


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, partitions: int | None = None, digest: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset, in order of ids within a sequence.

    A document is the ids of its whole text and ``end_id``; a null text is empty and has that id
    alone. Each id lies in one piece, a sequence holds at most ``capacity`` ids, offsets are gapless from 0. With ``digest``
    the column ``ids`` gives way to ``ids_crc32``, the CRC-32 of the ids as little-endian 32-bit numbers. Rows with the same or no id
    are different documents. Ids may be of any type that Spark can order. An empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer_path or default_tokenizer()
    slim = docs.select(id_col, text_col)
    order = [F.col(id_col), F.xxhash64(text_col)]
    dealt = slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    kind = slim.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {kind}, start bigint, length bigint, {'ids_crc32 bigint' if digest else 'ids array<int>'}, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.sortWithinPartitions(*order).mapInArrow(_pack(path, end_id, capacity, not digest, names), schema)


