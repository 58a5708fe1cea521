"""Packing: cut tokenised documents into sequences of a fixed length with little padding.

Method: Karmarkar-Karp multiway differencing. Each task packs blocks of its own documents, so nothing is
shuffled. Documents longer than a sequence first give whole sequences. The rest of a block goes into the
fewest windows that could hold it: each piece starts as a partial partition, and the two partitions with the
largest imbalance are merged, the fullest window of one with the emptiest of the other, until one is left.
If its fullest window exceeds the capacity, the number of windows rises and the block is packed again.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import hashing as H
from panelspark.llm.common import groups_of, text_buffer, tidied

#: Tokens that a task packs at once; pieces of text whose tokens a worker remembers.
BLOCK_TOKENS, REMEMBERED = 1 << 20, 3 << 18
#: Classes of bytes: white space, letters, digits, other signs, and what sends a whole word to the tokenizer.
_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of each byte of plain text."""
    kind, low = np.full(256, _WHOLE, np.uint8), np.arange(256, dtype=np.uint8)
    kind[0x21:0x7F] = _SIGN
    kind[[*range(0x09, 0x0E), 0x20]] = _SPACE
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0x27] = _WHOLE  # an apostrophe may begin an ending that the tokenizer's pattern cuts off
    low[0x41:0x5B] += 32
    return kind, low


_KIND, _LOW = _byte_classes()
_LEAD, _TIMES, _OVER = 0xC3, 0x97, 0xB7  # U+00C0 to U+00FF are this byte and one more; two of them are no letters


def cut_plain(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, stops, whole): the pieces of UTF-8 text as the vocabulary's own pattern cuts them.

    Text is cut at ASCII white space and at ``breaks``, across which its normaliser and pattern join nothing. Words
    of plain characters (ASCII and U+00C0 to U+00FF) are put into lower case and cut further into runs of letters,
    single digits and runs of other signs; a word with any other character, an apostrophe or ``<|`` is one piece, as it
    stands, and marked as whole."""
    kind, text = _KIND[data], _LOW[data]
    lead = np.flatnonzero(data[:-1] == _LEAD)
    after = data[lead + 1]
    sign = (after == _TIMES) | (after == _OVER)
    kind[lead] = kind[lead + 1] = np.where(sign, _SIGN, _LETTER)
    text[lead[(after < 0x9F) & ~sign] + 1] += 32
    kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = _WHOLE
    fresh = np.ones(len(data), bool)  # not in one piece with the byte before
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[breaks] = True
    whole = kind == _WHOLE
    if whole.any():
        inside = kind != _SPACE
        word = inside.copy()
        word[1:] &= ~inside[:-1]
        word[breaks] = inside[breaks]
        number = np.cumsum(word)
        odd = np.zeros(number[-1] + 1, bool)
        odd[number[whole]] = True
        whole = odd[number] & inside
        text[whole] = data[whole]
        fresh = np.where(whole, word, fresh | (kind == _DIGIT))
    else:
        fresh |= kind == _DIGIT
    inside = kind != _SPACE
    starts = np.flatnonzero(fresh & inside)
    last = inside.copy()
    last[:-1] &= fresh[1:] | ~inside[1:]
    return text, starts, np.flatnonzero(last) + 1, whole[starts]


class Known:
    """What a worker remembers: the token ids of pieces by hash, in flat arrays with open addressing.

    Beyond ``most`` pieces those that were not met since the last clearing go, or all if that leaves too many."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self._empty(1 << 14)

    def _empty(self, slots: int) -> None:
        self.count = self.used = 0
        self.keys = np.zeros(slots, np.uint64)
        self.first, self.size, self.met = np.zeros(slots, np.uint32), np.zeros(slots, np.int32), np.zeros(slots, bool)
        self.pool = np.zeros(slots, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out, at, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(at):
            there, wanted = self.keys[slot], keys[at]
            hit = there == wanted
            out[at[hit]] = slot[hit]
            more = ~hit & (there != 0)
            at, slot = at[more], (slot[more] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New, distinct keys with their tokens, one after another."""
        if 4 * (self.count + len(keys)) > 3 * len(self.keys):
            self._rebuild(np.flatnonzero(self.keys), len(keys), False)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used // 4 + len(ids), np.uint32)))
        mask = len(self.keys) - 1
        at, slot = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[at[free]]
            placed = free & (self.keys[slot] == keys[at])
            self.first[slot[placed]] = (self.used + np.cumsum(size) - size)[at[placed]]
            self.size[slot[placed]] = size[at[placed]]
            at, slot = at[~placed], (slot[~placed] + 1) & mask
        self.pool[self.used : self.used + len(ids)] = ids
        self.count, self.used = self.count + len(keys), self.used + len(ids)

    def forget(self, room: int) -> bool:
        """Clear if so many more would be too many; the next batch's pieces are then kept whatever their number."""
        if self.count + room <= self.most:
            return False
        kept = np.flatnonzero(self.met)
        self._rebuild(kept if len(kept) + room <= 3 * self.most // 4 else kept[:0], room, True)
        return True

    def _rebuild(self, slots: np.ndarray, room: int, clear: bool) -> None:
        keys, size, ids, met = self.keys[slots], self.size[slots], self.tokens(slots), self.met[slots]
        self._empty(max(1 << 14, 1 << int(4 * (len(keys) + room) // 3).bit_length()))
        if len(keys):
            self.add(keys, ids, size)
            if not clear:
                self.met[self.find(keys[met])] = True

    def tokens(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the pieces in these slots, one after another."""
        size = self.size[slots].astype(np.int64)
        ends = np.cumsum(size)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[slots].astype(np.int64) - ends + size, size)]


class WordTokenizer:
    """Token ids of whole texts. Each different piece of text (see ``cut_plain``) is tokenised once for as long as a
    worker remembers it; pieces are told apart by hashes of 64 bits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(model))
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        model |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}
        self.parts_only = Tokenizer.from_str(json.dumps(model))
        mark, vocabulary = model["model"]["end_of_word_suffix"], model["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.known = Known()

    def _learn(self, keys: np.ndarray, pieces: list[bytes], whole: np.ndarray) -> None:
        texts = [p.decode() for p in pieces]
        for some, ids, size in ((~whole, *self._plain([t for t, w in zip(texts, whole) if not w])), (whole, *self._whole([t for t, w in zip(texts, whole) if w]))):
            if len(size):
                self.known.add(keys[some], ids, size)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.parts_only.encode_batch_fast([" ".join(texts[i : i + 64]) for i in range(0, len(texts), 64)], add_special_tokens=False)
        ids = np.array([i for e in got for i in e.ids], np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)  # a piece's last token, and no other, carries the mark of a word's end

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts data[bounds[d]:bounds[d + 1]]."""
        out, size = [], np.zeros(len(bounds) - 1, np.int64)
        for s, e in self._chunks(data, bounds):
            doc = int(np.searchsorted(bounds, s, "right")) - 1
            if e - s > H.BATCH:  # one word that no table holds
                ids = np.array(self.whole.encode(data[s:e].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                size[doc] += len(ids)
                out.append(ids)
                continue
            inner = bounds[(bounds > s) & (bounds < e)] - s
            slots, starts = self._pieces(data[s:e], inner)
            out.append(self.known.tokens(slots))
            d = doc + np.searchsorted(inner, starts, "right") if not len(inner) or (np.diff(inner) > 0).all() else np.searchsorted(bounds, s + starts, "right") - 1
            size += np.bincount(d, self.known.size[slots], len(size)).astype(np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum(size)))

    def _pieces(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, start) of each piece of the text."""
        text, starts, stops, whole = cut_plain(data, breaks)
        keys = H.span_hashes(H.prefix_sums(H.byte_values(text)), starts, stops)
        keys = np.where(whole, H.mix(keys), keys) | np.uint64(1 << 63)  # never 0, which marks a free slot
        slots = self.known.find(keys)
        if (slots < 0).any():
            if self.known.forget(len(np.unique(keys[slots < 0]))):
                slots = self.known.find(keys)
            miss = np.flatnonzero(slots < 0)
            miss = miss[np.unique(keys[miss], return_index=True)[1]]
            raw = text.tobytes()
            self._learn(keys[miss], [raw[a:b] for a, b in zip(starts[miss].tolist(), stops[miss].tolist())], whole[miss])
            slots = self.known.find(keys)
        self.known.met[slots] = True
        return slots, starts

    @staticmethod
    def _chunks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges that end at white space or at a text's end; longer than a batch only if one word is."""
        s, end = 0, len(data)
        while s < end:
            e = min(end, s + H.BATCH)
            if e < end:
                space = np.flatnonzero(_KIND[data[max(s, e - 4096) : e]] == _SPACE)
                text = int(bounds[np.searchsorted(bounds, e, "right") - 1])
                near = max(s, e - 4096) + int(space[-1]) + 1 if len(space) else s
                e = max(text, near)
                if e <= s:
                    space = np.flatnonzero(_KIND[data[s : s + H.BATCH]] == _SPACE)
                    e = s + int(space[-1]) + 1 if len(space) else min([*bounds[bounds > s][:1].tolist(), *(s + H.BATCH + np.flatnonzero(_KIND[data[s + H.BATCH :]] == _SPACE)[:1]).tolist()])
            yield s, e
            s = e


@cache
def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer for each file in a worker: what it has learned serves all tasks that run there."""
    return WordTokenizer(path)


def differencing(sizes: list[int], windows: int) -> list[int]:
    """Karmarkar-Karp: the window of each item. Partitions keep their windows' sums in falling order."""
    n = len(sizes)
    if windows <= 1:
        return [0] * n
    nxt = np.full(n, -1, np.int64)
    heap: list[tuple] = []
    for i in np.argsort(-np.array(sizes), kind="stable").tolist():
        heap.append((-sizes[i], i, None, i))
    heapq.heapify(heap)
    serial = n

    def opened(entry: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if entry[2] is not None:
            return entry[2]
        sums, head, tail = np.zeros(windows, np.int64), np.full(windows, -1, np.int64), np.full(windows, -1, np.int64)
        sums[0], head[0], tail[0] = sizes[entry[3]], entry[3], entry[3]
        return sums, head, tail

    while len(heap) > 1:
        a, b = opened(heapq.heappop(heap)), opened(heapq.heappop(heap))
        sums, bh, bt = a[0] + b[0][::-1], b[1][::-1], b[2][::-1]
        both = (a[2] >= 0) & (bh >= 0)
        nxt[a[2][both]] = bh[both]
        head = np.where(a[1] >= 0, a[1], bh)
        tail = np.where(bt >= 0, bt, a[2])
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), serial, (sums, head[order], tail[order]), -1))
        serial += 1
    out = [0] * n
    _, head, _ = opened(heap[0])
    for w, i in enumerate(head.tolist()):
        while i >= 0:
            out[i] = w
            i = int(nxt[i])
    return out


def pack_block(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(document, start, length, sequence, offset)], number of sequences) for documents of these lengths."""
    out, sequence, items = [], 0, []
    grain = max(1, capacity // 8)
    for d, n in enumerate(lengths):
        s = 0
        while n - s >= capacity:
            out.append((d, s, capacity, sequence, 0))
            sequence += 1
            s += capacity
        while s < n:
            items.append((d, s, min(grain, n - s)))
            s += grain
    if not items:
        return out, sequence
    sizes = [x[2] for x in items]
    windows = -(-sum(sizes) // capacity)
    while True:
        place = differencing(sizes, windows)
        if max(np.bincount(place, sizes, minlength=windows)) <= capacity:
            break
        windows += 1
    filled, last = [0] * windows, {}
    for w, (d, s, n) in sorted(zip(place, items)):
        before = last.get(w)
        if before is not None and out[before][0] == d and out[before][1] + out[before][2] == s:  # next to its predecessor: one piece
            out[before] = (d, out[before][1], out[before][2] + n, sequence + w, out[before][4])
        else:
            last[w] = len(out)
            out.append((d, s, n, sequence + w, filled[w]))
        filled[w] += n
    return out, sequence + windows


def _packer(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        base = TaskContext.get().partitionId() << 36
        ids: list = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, tokens, sizes, total, made
            every, all_ids, length_of = np.concatenate(tokens).astype("<u4").tobytes(), pa.concat_arrays(ids), np.concatenate(sizes)
            first = np.cumsum(length_of) - length_of
            pieces, n = pack_block(length_of.tolist(), capacity)
            for k in range(0, len(pieces), 2000):
                doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces[k : k + 2000]))
                cut = [every[a:b] for a, b in zip((4 * (first[doc] + start)).tolist(), (4 * (first[doc] + start + length)).tolist())]
                yield pa.RecordBatch.from_arrays([all_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(length_of[doc]), pa.array(base + made + sequence), pa.array(offset), pa.array(cut, pa.binary())], ["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            ids, tokens, sizes, total, made = [], [], [], 0, made + n

        for batch in batches:
            data, bounds = text_buffer(batch.column("_text"))
            for i, j in groups_of(bounds):
                new, ends = tokenizer.encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                ids.append(batch.column("_id").slice(i, j - i))
                tokens.append(np.insert(new, ends[1:], end_id))
                sizes.append(np.diff(ends) + 1)
                total += len(tokens[-1])
                if total >= BLOCK_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, start, length, doc_tokens, sequence_id, offset, ids): every document's tokens and ``end_id``, cut into
    pieces that fill sequences of at most ``capacity`` tokens; ``ids`` are little-endian unsigned 32-bit.

    A null or empty text is the end id alone. Repeated rows are packed each. Ids may be null or repeat. Each
    task fills its own sequences. An empty table gives no piece. Other columns are left, whatever their names.
    """
    id_field = T.StructField("_id", docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([id_field, *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(tidied(_packer(tokenizer_path, capacity, end_id)), schema)


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    out = pack(docs, tokenizer_path)
    return out.select(F.col("_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
