"""Similarity of candidates without batches of sets in workers; the packing cache by its caller."""

from inspect import signature

import numpy as np

from lexweave.llm import packing, similar
from lexweave.llm.common import CHUNK_CACHE


def test_links_are_those_of_the_similarity(spark):
    rnd = np.random.default_rng(3)
    sets = [np.zeros(0, "<u8"), np.zeros(0, "<u8"), *(np.unique(rnd.integers(0, 14, 12).astype("<u8") * np.uint64(1 << 60)) for _ in range(40))]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    nodes = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, members array<bigint>")
    found = similar.links(spark.createDataFrame(pairs, "a long, b long"), nodes, 0.8)
    expected = {(a, b) for a, b in pairs if similar.similarity(sets[a], sets[b]) >= 0.8}
    assert {tuple(r) for r in found.collect()} == expected and 1 < len(expected) < len(pairs)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_packing_keeps_the_pieces_that_its_caller_asks_for():
    assert signature(packing.pieces).parameters["kept"].default == signature(packing.pack).parameters["kept"].default == CHUNK_CACHE
