"""Stored graphs: the format, damage, releases that are whole or not there."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepfree.shared import new_folder
from stepfree.sources import artifacts as A

DATA = "/root/testdata/sf0.001"


def table(n, seed=1):
    rng = random.Random(seed)
    some = lambda f: [None if rng.random() < 0.2 else f() for _ in range(n)]
    return pa.table(
        {
            "id": pa.array([rng.randrange(-(2**63), 2**63) for _ in range(n)], pa.int64()),
            "small": pa.array(some(lambda: rng.randrange(-9, 9)), pa.int32()),
            "x": pa.array(some(lambda: rng.choice([0.1, -1e300, float("inf"), 5e-324])), pa.float64()),
            "flag": pa.array(some(lambda: rng.random() < 0.5), pa.bool_()),
            "text": pa.array(some(lambda: rng.choice(["", "gravel", "½ straße", "x" * 5000])), pa.string()),
            "none": pa.array([None] * n, pa.string()),
        }
    )


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_format(n):
    t = table(n)
    assert A.decoded(A.encoded(t)).equals(t)


def test_format_is_compact():
    t = pa.table({"id": pa.array(range(10**6, 10**6 + 20_000)), "src": pa.array([k // 4 for k in range(20_000)]), "surface": pa.array(["asphalt", "gravel"] * 10_000)})
    assert len(A.encoded(t)) < t.nbytes / 20


def test_other_data_is_refused():
    with pytest.raises(ValueError, match="not a graph artifact"):
        A.decoded(b"PAR1" + b"x" * 20)
    with pytest.raises(TypeError):
        A.encoded(pa.table({"d": pa.array([None], pa.date32())}))


@pytest.fixture
def store(spark):
    s = A.GraphStore(spark, new_folder(spark, "graph"))
    s.release(A.shard_edges(spark, DATA))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 40)
    edges = A.shard_edges(spark, DATA)
    s = A.GraphStore(spark, new_folder(spark, "graph"))
    assert s.release(edges) == 1
    assert rows(s.read()) == rows(edges) and s.read().schema.simpleString() == edges.schema.simpleString()
    assert s.manifest().agg(F.max("chunk")).first()[0] > 2 and s.sound()
    one = s.manifest().select(*A.SHARD).limit(1)
    assert rows(s.read(region=one)) == rows(edges.join(one, [*A.SHARD], "left_semi").select(*edges.columns))


def damage(spark, store, change):
    """Rewrite the artifacts of the first release with some payloads changed, as a bad disk would."""
    folder = store.manifest(1).first()["folder"]
    held = [(r["shard_y"], r["shard_x"], r["chunk"], r["n"], change(k, bytes(r["payload"]))) for k, r in enumerate(sorted(spark.read.parquet(folder).collect()))]
    spark.createDataFrame([h for h in held if h[4] is not None], A._STORED).write.mode("overwrite").parquet(folder)
    return held


@pytest.mark.parametrize("place", [0, 10, -1])
def test_a_flipped_byte_is_refused(spark, store, place):
    flip = lambda k, p: p if k else p[:place] + bytes([p[place] ^ 1]) + p[place:][1:]
    held = damage(spark, store, flip)
    with pytest.raises(Exception, match="damaged artifact"):
        store.read().collect()
    bad = store.validate().where("status != 'ok'").collect()
    assert [(r["shard_y"], r["shard_x"], r["status"]) for r in bad] == [(*held[0][:2], "damaged")] and not store.sound()


def test_a_missing_artifact_is_refused(spark, store):
    held = damage(spark, store, lambda k, p: None if k == 1 else p)
    with pytest.raises(Exception, match="missing artifact"):
        store.read().collect()
    bad = store.validate().where("status != 'ok'").collect()
    assert [(r["shard_y"], r["shard_x"], r["status"]) for r in bad] == [(*held[1][:2], "missing")]


def test_an_interrupted_release_changes_nothing(spark, store):
    edges = A.shard_edges(spark, DATA)
    before = rows(store.read())
    prepared = store.prepare(edges.limit(5))  # artifacts, and even a manifest, but no commit
    prepared.write.parquet(f"{store.folder}/manifests/interrupted")
    assert store.releases() == [1] and rows(store.read()) == before and store.sound()
    assert store.publish(prepared, edges.schema) == 2 and store.read().count() == 5
    assert rows(store.read(1)) == before


def test_a_number_is_taken_once(spark, store):
    with pytest.raises(Exception, match="exist"):
        store._rename("{}", "commits/00000001")
    assert store.commit()["release"] == 1


def test_replacing_shards(spark, store):
    edges = A.shard_edges(spark, DATA)
    shards = [tuple(r) for r in edges.select(*A.SHARD).distinct().orderBy(*A.SHARD).collect()]
    region = spark.createDataFrame(shards[:2] + [(1, 1)], "shard_y long, shard_x long")
    first = edges.where(F.struct(*A.SHARD) == F.struct(*[F.lit(x).cast("long") for x in shards[0]])).withColumn("surface", F.lit("new"))
    folder = store.manifest().first()["folder"]
    assert store.replace(first, region) == 2
    now = rows(store.read())
    assert now == rows(first.unionByName(edges.join(region, [*A.SHARD], "left_anti").select(*edges.columns)))
    assert rows(store.read(1)) == rows(edges)
    kept = store.manifest().where(F.col("folder") == folder).select(*A.SHARD).distinct().count()
    assert kept == len(shards) - 2  # other shards were not written again
    with pytest.raises(ValueError, match="outside"):
        store.replace(edges, region)
    with pytest.raises(ValueError, match="columns"):
        store.replace(first.drop("surface"), region)
    assert store.releases() == [1, 2]
    store.replace(edges.limit(0), spark.createDataFrame(shards, "shard_y long, shard_x long"))
    assert store.read().count() == 0 and store.sound()


def test_no_release(spark):
    s = A.GraphStore(spark, new_folder(spark, "graph"))
    with pytest.raises(A.NoRelease):
        s.read()
    s.release(A.shard_edges(spark, DATA))
    with pytest.raises(A.NoRelease):
        s.read(7)
