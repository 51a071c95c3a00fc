"""Answers by range of keys: the same as by a table of all keys, on little disk beyond the bound of a broadcast too."""

import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import exchange, lm_score, suffix_dedup
from tidewater.sources.shared import shared_folder


@pytest.mark.parametrize("kind", [np.uint64, np.int64, np.uint8])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_squeeze(kind, n):
    x = np.random.default_rng(n).integers(0, 200, n).astype(kind)
    assert (exchange.expand(exchange.squeeze(x), kind) == x).all()
    keys = np.sort(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    assert (exchange.expand_keys(exchange.squeeze_keys(keys)) == keys).all()
    at = exchange.edges(keys, 7, 40)
    assert at[0] == 0 and at[-1] == n and (np.diff(at) >= 0).all()


@pytest.mark.parametrize("limit", [0, None])
def test_answers(spark, limit):
    """A unit has questions of two kinds; a key that all units have and one that one unit has twice are among them."""
    r = random.Random(5)
    docs = [(i, None if i % 50 == 7 else " ".join(str(r.randint(0, 40)) for _ in range(r.randint(0, 12)))) for i in range(400)]
    units = exchange.pack(spark.createDataFrame(docs, "doc long, text string").repartition(3), 600).cache()
    held = {u["unit"]: exchange.unpack(bytes(u["data"])).to_pylist() for u in units.collect()}
    assert sorted(((x["doc"], x["text"]) for x in sum(held.values(), [])), key=lambda x: x[0]) == docs and len(held) > 5
    key = lambda w: np.uint64((int(w) + 1) * 0x9E3779B97F4A7C15 % 2**64)

    def words(rows):
        found = {}
        for x in rows:
            for w in (x["text"] or "").split():
                found.setdefault(key(w), []).append(x["doc"])
        return dict(sorted(found.items()))

    def questions(row):
        own = words(exchange.unpack(row["data"]).to_pylist())
        k = np.array(list(own), np.uint64)
        return [(k, np.array([len(set(x)) > 1 for x in own.values()], np.int64)), (k, np.array([min(x) for x in own.values()], np.int64))]

    found = exchange.answers(exchange.ask(units, questions, 5), [exchange.elsewhere, exchange.earlier])
    everywhere = words(sum(held.values(), []))
    for row in exchange.attach(units, {"got": found}, limit).collect():
        own = words(held[row["unit"]])
        k = np.array(list(own), np.uint64)
        got = [x.asDict() for x in row["got"] or ()]
        assert exchange.recall(got, 0, k, 5).tolist() == [len(set(everywhere[x])) > 1 for x in own]
        assert exchange.recall(got, 1, k, 5).tolist() == [min(everywhere[x]) < min(d) for x, d in own.items()]


def test_lost_answers_are_noticed():
    with pytest.raises(RuntimeError):
        exchange.recall(None, 0, np.array([1], np.uint64), 3)


def disk(spark):
    """Bytes that all stages have written to shuffles, and those in the shared folder."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    shared = subprocess.run(["du", "-sb", shared_folder(spark).removeprefix("file://")], capture_output=True).stdout
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) + int(shared.split()[0])


def grown(spark, run) -> int:
    """Bytes that run() writes to shuffles and the shared folder, deleted ones too."""
    before = disk(spark)
    run()
    return disk(spark) - before


def test_repeats_take_little_disk(spark):
    """Beyond the bound of a broadcast, shuffles and tables write under 5 times the table (8.5 times, when keys were joined to each document)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert grown(spark, lambda: suffix_dedup.repeats_digest(docs, limit=1).agg(F.max("kept_sha256")).collect()) < 5 * 1_428_373


def test_anchors_spread(spark):
    """The least of neighbouring hashes are small numbers; each range of anchors still gets its share."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    row = exchange.pack(docs.limit(300).coalesce(1)).first().asDict()
    n = np.diff(exchange.edges(suffix_dedup.Unit(row, 8, 50).anchors()[0][0], 8))
    assert n.min() > 0.8 * n.mean() and n.max() < 1.2 * n.mean()


def test_lm_scores_take_little_disk(spark):
    """Beyond the bounds of a broadcast, shuffles and tables write under 4 times the table (20 times, when each text's n-grams were joined to the counts)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert grown(spark, lambda: lm_score.lm_scores(docs, max_broadcast=1).agg(F.max("score")).collect()) < 4 * 1_428_373


@pytest.mark.parametrize("most", [0, 10**6])
def test_lm_scores_of_units(spark, monkeypatch, most):
    """Units of a few texts, shuffled or broadcast: the same scores to the last digits as by the broadcast filter."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = {r["doc_id"]: r for r in lm_score.lm_scores(docs).collect()}
    monkeypatch.setattr(exchange, "UNIT_BYTES", 20_000)
    far = lm_score.lm_scores(docs, max_broadcast=most, max_bits=64).collect()
    assert len(far) == len(near)
    for r in far:
        for c, x in r.asDict().items():
            assert x == (pytest.approx(near[r["doc_id"]][c], rel=1e-12) if isinstance(x, float) else near[r["doc_id"]][c])
