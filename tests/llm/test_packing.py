import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def best_sum(items, room):
    reach = {0}
    for x in items:
        reach |= {r + x for r in reach if r + x <= room}
    return max(reach)


def test_least_slack_is_the_best_subset():
    random.seed(3)
    for _ in range(200):
        counts = collections.Counter(random.choices(range(1, 60), k=random.randint(0, 9)))
        room = random.randint(1, 150)
        got = packing.least_slack(dict(counts), room)
        assert all(k <= counts[x] for x, k in got.items())
        assert sum(x * k for x, k in got.items()) == best_sum(list(counts.elements()), room)


def test_ids_are_those_of_the_tokenizer(ids_of, texts):
    random.seed(1)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "'", "é", "7", "½", "<|endoftext|>", "!", "\x1c", "\xa0", "中", "🙂", "ab.", "x,"]
    odd = ["".join(random.choices(parts, k=random.randint(0, 10))) for _ in range(3000)]
    encoder = packing.encoder("byte_bpe_50k.json")
    for text, ids in zip(odd + list(texts.values()), encoder.encode(odd + list(texts.values())), strict=True):
        assert ids.tolist() == ids_of(text)


def check_pieces(rows, tokens_of, capacity):
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
    return documents


def test_every_id_lies_in_one_piece(docs, ids_of, texts):
    rows = packing.pack(docs, window_tokens=30_000).collect()
    documents = check_pieces(rows, ids_of, 1024)
    assert set(documents) == set(texts)
    for i, pieces in documents.items():
        want = ids_of(texts[i]) + [0]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert np.frombuffer(p["ids"], "<u4").tolist() == want[at : at + p["length"]]
            at += p["length"]
        assert at == len(want)


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64).collect()
    check_pieces(rows, None, 64)
    assert sum(r["start"] == 0 for r in rows) == odd_docs.count()
    empty = [r for r in rows if r["doc_id"] in (0, 1)]
    assert [bytes(r["ids"]) for r in empty] == [b"\0\0\0\0"] * 2
    assert packing.pack(no_docs).count() == 0


def test_query_digest(spark, sf):
    from tickloom.llm import queries

    rows = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.pack_sequences(spark, sf).collect()}
    for p in packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert rows.get((p["doc_id"], p["start"])) in (None, zlib.crc32(bytes(p["ids"]))) or p["length"] < 1024
