"""Packing token streams into fixed windows by minimum bin slack.

Each task tokenises its documents once and packs them in bounded windows of tokens, so nothing is shuffled and the
ids travel once.  A document is cut into whole sequences and one rest.  The rests of a window are a multiset of
lengths (at most ``capacity - 1`` distinct ones): again and again the longest rest is completed by the multiset of
other rests that leaves the least slack, found by a subset-sum over a bitset whose steps are walked back to counts,
and that filling is used as often as the counts allow.  Rests for which no exact filling is left are laid end to
end, cut at the capacity, and the very last part is cut at powers of two, lengths that need no padding.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.common import hash_runs

#: Texts of these characters, with single spaces and line feeds between other characters, are encoded word by word:
#: the vocabulary's pattern never joins what such a space or line feed parts.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ſ]+(?:[ \n][\x21-\x7eÀ-ÖØ-öø-ſ]+)*")
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[ord(" "), ord("\n")]] = False
#: Words whose ids a worker remembers (about 40 bytes each).  Bounds memory only: others are encoded each time.
WORD_MEMORY = 500_000
#: Texts are laid end to end in blocks of about so many bytes; the work arrays take some forty times that.
BLOCK_BYTES = 400_000


class Encoder:
    """Ids of texts under a byte-level vocabulary, as the tokenizer file ``<name>.json`` gives them.

    Each distinct word is encoded once and remembered by its 64-bit hash; the ids of a text are gathered from there.
    """

    def __init__(self, ranks_path: str, special: dict[str, int]):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._full = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)
        self._line_end = ranks[b"\n"]
        self._keys = np.zeros(0, np.uint64)
        self._at, self._n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of every text; null counts as empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        block, where, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if _PLAIN.fullmatch(text) is None or any(s in text for s in self._special):
                text = text.encode("utf-8", "replace").decode("utf-8")
                out[i] = np.asarray(self._full.encode(text, allowed_special="all"), dtype=np.uint32)
                continue
            block.append(text.encode("utf-8"))
            where.append(i)
            size += len(block[-1])
            if size >= BLOCK_BYTES:
                self._encode_block(block, where, out)
                block, where, size = [], [], 0
        if block:
            self._encode_block(block, where, out)
        return out

    def _encode_block(self, block: list[bytes], where: list[int], out: list[np.ndarray]) -> None:
        hashes, begin, end, owner = hash_runs(block, _NOT_SPACE)
        raw = b"\n".join(block) + b"\n"
        first = np.ones(len(owner), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]
        # what stands before the word: nothing, a line feed, or a space
        before = np.where(first, 0, np.where(np.frombuffer(raw, np.uint8)[begin - 1] == 10, 1, 2)).astype(np.uint64)
        keys, example, word = np.unique(hashes * np.uint64(4) + before, return_index=True, return_inverse=True)
        place = np.searchsorted(self._keys, keys)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], n[known] = self._at[place[known]], self._n[place[known]]
        ids = self._ids
        if len(new):
            new_ids, new_at, new_n = self._encode_words(raw, begin[example[new]], end[example[new]], before[example[new]])
            at[new], n[new] = new_at + len(ids), new_n
            ids = np.concatenate([ids, new_ids])
            if len(self._keys) + len(new) <= WORD_MEMORY:
                self._ids = ids
                self._at = np.insert(self._at, place[new], at[new])
                self._n = np.insert(self._n, place[new], n[new])
                self._keys = np.insert(self._keys, place[new], keys[new])
        n, at = n[word], at[word]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        flat = ids[np.arange(total[-1]) + np.repeat(at - total[:-1], n)]
        cuts = total[np.flatnonzero(first)].tolist() + [int(total[-1])]
        for k, i in enumerate(where):
            out[i] = flat[cuts[k] : cuts[k + 1]]

    def _encode_words(self, raw: bytes, begin, end, before) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words laid end to end, where each begins, and how many it has."""
        spaced = [(b" " if k == 2 else b"") + raw[a:b] for a, b, k in zip(begin.tolist(), end.tolist(), before.tolist(), strict=True)]
        ids = np.asarray(self._full.encode_ordinary(b"\n".join(spaced).decode("utf-8") + "\n"), dtype=np.uint32)
        ends = np.flatnonzero(ids == self._line_end)
        begins = np.concatenate([[0], ends[:-1] + 1])
        after_line = before == 1
        # a word after a line feed starts with it: its own stands before it, or after all for the first word
        ids = np.concatenate([[np.uint32(self._line_end)], ids])
        return ids, begins + 1 - after_line, ends - begins + after_line


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    """The encoder of a tokenizer file; the ranks lie beside it."""
    import public_tokenizers

    path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
    return Encoder(path.removesuffix(".json") + ".tiktoken", {"<|endoftext|>": 50256})


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often each length goes into a window of ``room`` so that the least of it stays empty."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        steps.append((length, counts[length], reach))
        left, part = min(counts[length], room // length), 1
        while left:
            use = min(part, left)
            reach |= (reach << (length * use)) & full
            left -= use
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, have, before in reversed(steps):
        k = 0
        while not before >> (total - k * length) & 1:
            k += 1
        if k:
            out[length] = k
            total -= k * length
    return out


def fillings(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(filling, times): together they use every length as often as it occurs."""
    counts = {x: n for x, n in counts.items() if n}
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        filling = least_slack(rest, capacity - longest)
        filling[longest] = filling.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in filling.items())
        for x, k in filling.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        yield filling, times


def layout(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece; sequences are counted from 0."""
    out, sequence, rests, loose = [], 0, {}, []
    for item, n in enumerate(lengths.tolist()):
        whole, rest = divmod(n, capacity)
        for k in range(whole):
            out.append((item, k * capacity, capacity, sequence, 0))
            sequence += 1
        if rest:
            rests.setdefault(rest, []).append((item, whole * capacity))
    for filling, times in fillings({x: len(v) for x, v in rests.items()}, capacity):
        exact = sum(x * k for x, k in filling.items()) == capacity
        for _ in range(times):
            offset = 0
            for x, k in filling.items():
                for _ in range(k):
                    item, start = rests[x].pop()
                    if exact:
                        out.append((item, start, x, sequence, offset))
                        offset += x
                    else:
                        loose.append((item, start, x))
            sequence += exact
    left = sum(x for _, _, x in loose)
    room, offset = _next_room(left, capacity), 0
    for item, start, x in loose:
        while x:
            take = min(x, room - offset)
            out.append((item, start, take, sequence, offset))
            start, x, offset = start + take, x - take, offset + take
            if offset == room:
                left -= room
                sequence += 1
                room, offset = _next_room(left, capacity), 0
    return out


def _next_room(left: int, capacity: int) -> int:
    return capacity if left >= capacity or not left else 1 << (left.bit_length() - 1)


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 0,
    tokenizer: str = "byte_bpe_50k.json",
    window_tokens: int = 4_000_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of token sequences: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers.  A row's ids are those of its text
    and then ``end_id``; null and empty texts give ``end_id`` alone, so every row has a piece.  Rows with a null or a
    repeated id are rows like any other (their pieces keep that id); an empty table gives an empty table.  Other
    columns, whatever their names, are not read.  A task holds the ids of ``window_tokens`` tokens at most, and of
    one text more.  Padding: none, as only sequences of ``capacity`` or of a power of two occur.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField(id_column, kind),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.asarray([end_id], dtype=np.uint32)
        next_sequence = TaskContext.get().partitionId() << 33
        keys, tokens, held = [], [], 0
        id_type = None

        def packed():
            nonlocal next_sequence
            rows = layout(np.fromiter(map(len, tokens), np.int64, len(tokens)), capacity)
            for at in range(0, len(rows), 4096):
                item, start, length, sequence, offset = zip(*rows[at : at + 4096], strict=True)
                ids = [tokens[i][s : s + n].astype("<u4", copy=False).tobytes() for i, s, n in zip(item, start, length, strict=True)]
                columns = [
                    pa.array([keys[i] for i in item], id_type),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([len(tokens[i]) for i in item], pa.int64()),
                    pa.array([next_sequence + s for s in sequence], pa.int64()),
                    pa.array(offset, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            next_sequence += 1 + max((r[3] for r in rows), default=-1)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys += part.column(0).to_pylist()
                for ids in encode(part.column(1).to_pylist()):
                    tokens.append(np.concatenate([ids, end]))
                    held += len(tokens[-1])
                if held >= window_tokens:
                    yield from packed()
                    keys, tokens, held = [], [], 0
        if keys:
            yield from packed()

    return docs.select(docs[id_column], docs[text_column].cast("string")).mapInArrow(pieces, schema)
