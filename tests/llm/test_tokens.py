"""Records, packing: exact round trips and optimal packings."""

import glob
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests_odd import ODD
from lexweave.llm import packing, records
from lexweave.llm.common import default_tokenizer, encoder


def ids_of(text):
    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_of_text_give_the_ids_of_the_whole():
    rnd = random.Random(3)
    parts = ["foo", " ", "  ", "\n", "\t", "it's", "'s", ",", ".", "1２", "²", "ü", "中文", "<|endoftext|>", "!", "\r\n", "\u00a0", "Bar,", "e\u0301"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    library = Tokenizer.from_file(default_tokenizer())
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    enc = encoder(default_tokenizer())
    for _ in range(2):  # learning, then by the pieces kept
        assert [x.tolist() for x in enc.encode(texts)] == want


def test_checksum_of_the_standard():
    assert int(records.crc32c(b"123456789", np.array([0]), np.array([9]))[0]) == 0xE3069283
    data = bytes(range(256)) * 9
    spans = [(0, 0), (1, 1), (3, 511), (0, 512), (5, 513), (0, 2304)]

    def slow(piece):
        crc = 0xFFFFFFFF
        for byte in piece:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    found = records.crc32c(data, np.array([s for s, _ in spans]), np.array([n for _, n in spans]))
    assert found.tolist() == [slow(data[s : s + n]) for s, n in spans]


def test_records_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "out")
    records.write_records(odd, path, default_tokenizer(), partitions=4)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.start), r) for r in records.digests(spark, path).collect())
    want = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for (_, r), (doc, text) in zip(rows, want, strict=True):
        ids = ids_of(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = records.read_at(spark, path, spark.createDataFrame([(6,), (99,)], "doc_id long")).collect()
    assert [(r.doc_id, r.ids) for r in one] == [(6, ids_of(dict(ODD)[6]))]


def test_a_broken_record_is_noticed():
    data = b"".join(x + b"\n" for x in records.frame([b"12345678\x00ab", b"12345678\x00cd"]))
    spans = np.array(list(records.walk(data)))
    records.check(data, spans[:, 0], spans[:, 1])
    for at in (14, 8, 0):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            spans = np.array(list(records.walk(bytes(bad))))
            records.check(bytes(bad), spans[:, 0], spans[:, 1])


def test_records_of_an_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "none")
    records.write_records(make_docs([(1, "x")]).where("doc_id = 2"), path, default_tokenizer())
    assert records.digests(spark, path).count() == 0
    assert glob.glob(f"{path}/index/*")


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[j] -= items[i]
            go(i + 1, rooms)
            rooms[j] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_completion_is_optimal_on_small_sets():
    rnd, better = random.Random(1), 0
    for _ in range(300):
        capacity = rnd.choice([10, 20, 37, 60])
        items = Counter(rnd.randint(1, capacity) if rnd.random() < 0.3 else rnd.randint(max(1, capacity // 6), capacity // 2 + 1) for _ in range(rnd.randint(0, 11)))
        solution = packing.solve(dict(items), capacity)
        used = Counter()
        for filling, n in solution:
            assert sum(s * k for s, k in filling) <= capacity
            for s, k in filling:
                used[s] += n * k
        assert used == items
        assert packing.bins(solution) == fewest(list(items.elements()), capacity)
        better += packing.bins(packing.best_fit(items, capacity)) > packing.bins(solution)
    assert better


def test_many_pieces_are_searched_like_few():
    # best fit and full repeats alone need 119 and 160 sequences
    for capacity, items, fewest_bins in ((52, {21: 65, 24: 149, 4: 104, 6: 127}, 118), (53, {25: 74, 11: 195, 15: 113, 12: 73, 7: 86, 17: 72}, 159)):
        solution = packing.solve(dict(items), capacity)
        placed = Counter()
        for filling, n in solution:
            assert sum(s * k for s, k in filling) <= capacity
            for s, k in filling:
                placed[s] += n * k
        assert placed == items and packing.bins(solution) == fewest_bins == packing.lower_bound(items, capacity)


def check_packing(rows, docs, capacity):
    by_doc = Counter()
    for doc, text in docs:
        ids = ids_of(text)
        for i, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            by_doc[doc, i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == by_doc
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def test_packing_places_every_piece(odd, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    for capacity in (3, 64, 2048):
        packed = packing.pack(odd, default_tokenizer(), capacity, keep_ids=True).cache()
        n = check_packing(packed.collect(), ODD, capacity)
        whole = packing.sequences(packed).collect()
        assert len(whole) == n and sum(len(r.ids) for r in whole) == sum(len(ids_of(t)) for _, t in ODD)


def test_packing_of_an_empty_table(make_docs):
    assert packing.pack(make_docs([(1, "x")]).where("doc_id = 2"), default_tokenizer()).count() == 0


def test_op8_reaches_the_bound(spark, sf):
    from lexweave.llm.queries import QUERIES

    rows = QUERIES["op8_packing"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(rows, docs, 2048) <= packing.lower_bound(Counter(r.length for r in rows), 2048) * 1.01 + 1
