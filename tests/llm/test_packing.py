import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prosaic.llm import best_fit_packing as packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def test_both_libraries_agree(encoder):
    draw = random.Random(3)
    for _ in range(1500):
        text = "".join(draw.choice([chr(draw.randrange(256)), chr(draw.randrange(32, 127)), "  ", "\n", "'s", " a"]) for _ in range(draw.randrange(25)))
        assert encoder.encode(text) == encoder.full.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(spark, odd, encoder):
    made = packing.pack_documents(odd, PATH, with_ids=True).toPandas()
    assert made.groupby("sequence_id")["length"].sum().max() <= 1024
    for _, own in made.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]]
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for key, own in made.groupby("doc_id", dropna=False):
        key = None if key != key else int(key)
        assert own["length"].sum() == sum(len(encoder.full.encode(t, add_special_tokens=False).ids) + 1 for t in texts[key])
        assert all(r["length"] == 1024 for _, r in own.iterrows() if r["piece"] > 0)
        for ids, crc in zip(own["ids"], own["ids_crc32"]):
            assert zlib.crc32(np.asarray(ids, "<u4")) == crc
    ids = encoder.full.encode(texts[7][0], add_special_tokens=False).ids + [2]
    assert [x for i in made[made["doc_id"] == 7].sort_values("piece")["ids"] for x in i] == ids


def test_empty_table(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_bounds(seed):
    draw = np.random.default_rng(seed)
    lengths = -np.sort(-draw.integers(1, 60, draw.integers(1, 40)))
    bins, offsets, room = packing.best_fit_decreasing(lengths, 64)
    # the same one by one
    rooms: list[int] = []
    for size in lengths.tolist():
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(64 - size)
    assert sorted(rooms) == sorted(room.tolist())
    assert packing.lower_bound(lengths, 64) <= len(room)
    assert packing.lower_bound(np.array([40] * 5), 64) == 5
    assert packing.lower_bound(np.array([33, 33, 31, 31]), 64) == 2


def test_exchange_saves_bins(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0, 0, 100 + i % 700, i) for i in range(4000)], "id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(packing, "PART", 100)
    many = packing.pack(rows).toPandas()
    monkeypatch.setattr(packing, "ROUNDS", 1)
    once = packing.pack(rows).toPandas()
    assert len(many) == len(once) == 4000 and many["id"].nunique() == 4000
    assert many["sequence_id"].nunique() <= once["sequence_id"].nunique()
    assert many.groupby("sequence_id")["length"].sum().max() <= 1024


def test_exchange_goes_on_while_it_saves(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0, 0, 500, i) for i in range(20)], "id long, piece int, start long, length long, ids_crc32 long")
    done = []

    def saves_one_bin(rest, number, parts, capacity):
        done.append(number)
        made = 20 - min(number, 9)
        bins = F.least(F.col("id"), F.lit(made - 1))
        return rest.select(*rows.columns, bins.alias("sequence_id"), F.when(F.col("id") < made, 0).otherwise(500).cast("long").alias("offset"), F.lit(False).alias("closed"))

    monkeypatch.setattr(packing, "PART", 1)
    monkeypatch.setattr(packing, "_round", saves_one_bin)
    out = packing.pack(rows)
    assert done == list(range(11)) and out.count() == 20 and out.select("sequence_id").distinct().count() == 11
