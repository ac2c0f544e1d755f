"""Fingerprints, sources, sinks, streams and the driver's contract."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from pixelweft.functions import formatting
from pixelweft.operators import fingerprint as fp
from pixelweft.operators import kernels, search
from pixelweft.operators.exact import blake3
from pixelweft.schema import HashAlgorithm, MultiHashConfig, PreprocessConfig
from pixelweft.sources import files, store
from pixelweft.streaming import ingest

from .pictures import bmp, gif, gradient, png


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (80, 90), dtype=np.uint8)
    big = np.kron(rng.integers(0, 256, (10, 10), dtype=np.uint8), np.ones((40, 40), np.uint8))
    return {1: png(gradient(300, 300)), 2: png(grey), 3: bmp(gradient(100, 70, 128)), 4: gif(grey % 16, rng.integers(0, 256, (16, 3), dtype=np.uint8)), 5: b"", 6: b"not an image", 7: None, 8: png(np.zeros((31, 100), np.uint8)), 9: png(gradient(300, 300)), 10: png(big), 11: png(np.asarray(big, np.uint8)[::2, ::2])}


@pytest.fixture(scope="module")
def prints(spark, pictures):
    df = spark.createDataFrame([(k, v, "extra") for k, v in pictures.items()], "id int, content binary, error_note string")
    return fp.fingerprint(df).cache()


def test_fingerprints(spark, pictures, prints):
    rows = {r["id"]: r for r in prints.collect()}
    assert {k: r["error"]["kind"] for k, r in rows.items() if r["error"]} == {5: "InvalidImage", 6: "UnsupportedFormat", 8: "ImageTooSmall"}
    assert rows[5]["error"]["message"] == "invalid image: empty input"
    for k, r in rows.items():
        assert (r["phash"] is None) == (r["error"] is not None or k == 7)
        assert r["format_version"] == 1 and r["error_note"] == "extra"
        if r["phash"]:
            assert len(r["exact"]) == 32 and all(len(r[a.field]["block_hashes"]) == 16 for a in HashAlgorithm)
    assert rows[7]["exact"] is None and rows[7]["error"] is None
    assert rows[1]["exact"] == rows[9]["exact"] and rows[1]["phash"] == rows[9]["phash"]
    want = kernels.fingerprint(kernels.normalise(gradient(300, 300))[None])
    assert all(rows[1][a.field]["global_hash"] == int(want[a.field][0][0]) for a in HashAlgorithm)
    alike = prints.where("id in (10, 11)").select(search.multi().alias("f"))
    assert search.similarity_search(prints.where("id = 10"), prints.where("id = 11"), "id", 0.6).count() == 1 and alike.count() == 2


def test_fingerprints_do_not_depend_on_partitions(spark, pictures, prints):
    df = spark.createDataFrame([(k, v) for k, v in pictures.items()], "id int, content binary").repartition(7)
    cols = ["id", "exact", "ahash", "phash", "dhash", "error"]
    assert sorted(map(str, fp.fingerprint(df).select(*cols).collect())) == sorted(map(str, prints.select(*cols).collect()))


def test_options(spark, pictures):
    df = spark.createDataFrame([(k, v) for k, v in pictures.items()], "id int, content binary")
    only = fp.fingerprint(df, algorithms=(HashAlgorithm.DHASH,), exact="blake3", config=PreprocessConfig(min_dimension=16))
    assert "ahash" not in only.columns
    rows = {r["id"]: r for r in only.collect()}
    assert bytes(rows[2]["exact"]) == blake3(pictures[2]) and rows[8]["error"] is None
    with pytest.raises(ValueError):
        fp.fingerprint(df, exact="md5")
    single = fp.single(fp.fingerprint(df), HashAlgorithm.PHASH)
    assert {"algorithm", "global_hash", "block_hashes"} <= set(single.columns)
    assert fp.fingerprint(spark.createDataFrame([], "id int, content binary")).collect() == []


def test_files(spark, pictures, tmp_path):
    for k, name in ((1, "a.PNG"), (3, "b.bmp"), (6, "c.jpg"), (2, "d.txt"), (10, "noending")):
        (tmp_path / name).write_bytes(pictures[k])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.png").write_bytes(pictures[2])
    folder = f"file://{tmp_path}"
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.fingerprint_files(spark, folder).collect()}
    assert set(rows) == {"a.PNG", "b.bmp", "c.jpg"} and rows["c.jpg"]["error"]["kind"] == "UnsupportedFormat"
    capped = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.fingerprint_files(spark, folder, PreprocessConfig(max_input_bytes=20_000)).collect()}
    assert capped["a.PNG"]["kind"] == "IoError" and capped["b.bmp"]["kind"] == "IoError" or len(pictures[1]) <= 20_000
    assert files.picture_files(spark, folder, recursive=True).count() == 4
    decoded = fp.fingerprint_decoded(files.decoded_images(spark, folder).where(files.has_picture_ending(F.col("path"))), keep=("path",))
    got = {r["path"].rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert got["c.jpg"]["error"]["kind"] == "DecodeError"
    assert got["a.PNG"]["phash"] == rows["a.PNG"]["phash"] and got["a.PNG"]["exact"] != rows["a.PNG"]["exact"]
    kinds = spark.createDataFrame([(v,) for v in pictures.values()], "c binary").select(files.format_of(F.col("c"))).collect()
    assert [k[0] for k in kinds][:7] == ["PNG", "PNG", "BMP", "GIF", None, None, None]


def test_store(spark, prints, tmp_path):
    good = prints.where("error is null and exact is not null")
    store.save(prints, f"{tmp_path}/p")
    assert store.load(spark, f"{tmp_path}/p").count() == prints.count()
    other = prints.withColumn("format_version", F.when(F.col("id") == 1, 2).otherwise(1))
    assert store.gated(other, strict=False).count() == prints.count() - 1
    with pytest.raises(Exception, match="format version"):
        store.gated(other).select("format_version").collect()
    records = store.to_records(good)
    assert {len(r["record"]) for r in records.collect()} == {536}
    back = store.from_records(records)
    cols = ["exact", "ahash", "phash", "dhash"]
    assert sorted(map(str, back.collect())) == sorted(map(str, good.select(*cols).collect()))
    (tmp_path / "r.bin").write_bytes(b"".join(bytes(r["record"]) for r in records.collect()))
    again = store.from_records(store.read_record_file(spark, f"file://{tmp_path}/r.bin"))
    assert sorted(map(str, again.collect())) == sorted(map(str, back.collect()))
    assert store.from_records(spark.createDataFrame([(b"short",), (None,)], "record binary")).where("exact is not null").count() == 0
    store.export_json(prints.withColumn("path", F.col("id").cast("string")), f"{tmp_path}/j")
    exported = [json.loads(line) for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines()]
    assert len(exported) == good.count() and set(exported[0]) == {"filename", "exact_hash", "global_hash", "global_dhash"}
    seen = []
    store.each(good.select("id"), lambda r: seen.append(r["id"]))
    assert sorted(seen) == sorted(r["id"] for r in good.select("id").collect())
    watched, counts = store.counted(prints)
    watched.write.format("noop").mode("overwrite").save()
    assert counts.get == {"rows": 11, "ok": 8, "failed": 3}


def test_json_refuses_unknown_and_missing_fields(spark):
    blocks = [0, -1, 2**63 - 1, -(2**63), *range(12)]
    df = spark.createDataFrame([((bytes(range(32)), -5, blocks),)], "f struct<exact:binary,global_hash:bigint,block_hashes:array<bigint>>")
    text = df.select(formatting.json_single(F.col("f"))).first()[0]
    told = json.loads(text)
    assert told["exact"] == list(range(32)) and told["global_hash"] == 2**64 - 5 and told["block_hashes"][1] == 2**64 - 1
    bad = [text, text[:-1] + ',"more":1}', "{}", "no json", None, json.dumps({**told, "exact": told["exact"][:31]})]
    got = spark.createDataFrame([(b,) for b in bad], "j string").select(formatting.parse_json_single(F.col("j")).alias("f")).collect()
    assert got[0]["f"]["block_hashes"] == blocks and got[0]["f"]["global_hash"] == -5 and all(g["f"] is None for g in got[1:])
    shown = df.select(formatting.format_single(F.col("f"))).first()[0].split(":")
    assert shown[1] == "fffffffffffffffb" and shown[2].count(",") == 15


def test_duplicates(spark, prints):
    rows = prints.where("exact is not null")
    assert [tuple(r)[1:] for r in search.exact_duplicates(rows, "id").collect()] == [(2, 1)]
    assert sorted(tuple(r) for r in search.duplicate_members(rows, "id").collect()) == [(1, 1), (9, 1)]
    good = prints.where("phash is not null")
    assert 9 not in {r["id"] for r in search.representatives(good, "id").collect()}
    assert not {1, 9} & {r["id"] for r in search.singletons(good).collect()}
    assert {(r["id_a"], r["id_b"]) for r in search.near_duplicates_in_buckets(good, "id").collect()} == {(1, 9)}
    assert search.bucket_index(good, "id", HashAlgorithm.PHASH, 0).first()["members"] == good.count()
    pairs = good.select(search.multi().alias("fa")).join(good.select(search.multi().alias("fb")))
    plain = pairs.withColumn("similarity", search.compare_multi(F.col("fa"), F.col("fb"))).where("similarity.score >= 0.75").count()
    assert search.scored(pairs, 0.75).count() == plain
    assert search.scored(pairs, 0.75, MultiHashConfig(global_weight=0.9, block_weight=0.9)).count() >= plain


def prints_of(rng, n):
    """Rows (id text, exact, three algorithms): families of alike pictures, some with a null block or without a hash."""
    rows = []
    for k in range(n):
        base = rng.integers(-(2**63), 2**63, (3, 17))
        for m in range(3):
            h = base.copy()
            for x in h.reshape(-1)[:, None]:
                for b in rng.integers(0, 64, rng.integers(0, 7)):
                    x[0] ^= np.int64(np.uint64(1) << np.uint64(b))
            if m == 1:
                h[:, 0] ^= np.int64(-(2**63))  # unlike in the top bit
            parts = [(int(a[0]), [int(v) for v in a[1:]]) for a in h]
            if k % 9 == 0:
                parts[0][1][3] = None
            if k % 11 == 0 and m == 2:
                parts[1] = (None, parts[1][1])
            rows.append((f"p{3 * k + m:04d}", bytes([k % 250, m if k % 5 else 0]), *parts))
    hashes = "struct<global_hash:bigint,block_hashes:array<bigint>>"
    return rows, f"id string, exact binary, ahash {hashes}, phash {hashes}, dhash {hashes}"


def test_near_duplicates_of_all_pairs(spark):
    df = spark.createDataFrame(*prints_of(np.random.default_rng(3), 40)).repartition(3).cache()
    side = lambda s: df.select(F.col("id").alias(f"id_{s}"), search.multi().alias(f"f{s}"))
    every = side("a").join(side("b")).where("id_a < id_b").withColumn("s", search.compare_multi(F.col("fa"), F.col("fb"))).cache()
    for config, score, block in ((None, 0.9, 16), (None, 0.8, 4096), (None, 0.53, 16), (MultiHashConfig(0.1, 0.6, 0.3, 0.9, 0.9), 0.9, 16)):
        plain = every if config is None else every.withColumn("s", search.compare_multi(F.col("fa"), F.col("fb"), config))
        want = {tuple(r) for r in plain.where(F.col("s.score") >= F.lit(score).cast("float")).select("id_a", "id_b").collect()}
        got = [(r["id_a"], r["id_b"]) for r in search.near_duplicates(df, "id", score, config, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    lossy = search.near_duplicates_in_buckets(df, "id", 0.9).count()
    assert lossy < search.near_duplicates(df, "id", 0.9).count()
    assert search.near_duplicates(df.limit(0), "id").collect() == []


def test_similarity_search_of_many_queries(spark):
    df = spark.createDataFrame(*prints_of(np.random.default_rng(4), 30)).cache()
    plain = {(r["query_id"], r["id"], r["score"]) for r in search.similarity_search(df, df, "id", 0.54).collect()}
    blocks = [(r["query_id"], r["id"], r["score"]) for r in search.similarity_blocks(df, df, "id", 0.54, block=32).collect()]
    assert len(blocks) == len(set(blocks)) and set(blocks) == plain and len(plain) > 90
    many = df.crossJoin(spark.range(12).toDF("copy")).withColumn("id", F.concat("id", F.lit("-"), F.col("copy").cast("string"))).drop("copy")
    assert many.count() > 1000 and search.similarity_search(df.where("id = 'p0003'"), many, "id", 0.99).count() >= 12


def test_blocks_of_queries_are_scored_where_they_meet(spark):
    """Candidates that are joined with both fingerprints again are most of the work: a third of all pairs may be found."""
    rows, shape = prints_of(np.random.default_rng(5), 12)
    rows += [("bare", rows[4][1], None, None, None), ("unlike", None, *rows[7][2:]), ("short", b"s", (rows[7][2][0], rows[7][2][1][:9]), *rows[7][3:])]
    df = spark.createDataFrame(rows, shape).repartition(3).cache()
    every = df.select(F.col("id"), search.multi().alias("fa")).join(df.select(F.col("id").alias("query_id"), search.multi().alias("fb")))
    odd = (MultiHashConfig(0.2, 0.5, 0.3, 0.9, 0.9, 64), MultiHashConfig(-0.5, 1.0, 0.9, 0.5, 0.5, 0), MultiHashConfig(0.0, 0.0, 0.0, block_distance_threshold=-1))
    for config, score, block in ((MultiHashConfig(), 0.53, 10), (MultiHashConfig(), 0.0, 16384), *((c, 0.0, 7) for c in odd)):
        plain = every.withColumn("s", search.compare_multi(F.col("fa"), F.col("fb"), config)).where(F.col("s.score") >= F.lit(score).cast("float"))
        found = search.similarity_blocks(df, df, "id", score, config, block)
        want, got = (sorted(map(tuple, x.collect())) for x in (plain.select("query_id", "id", "s.*"), found))
        assert want == got and ("bare", rows[4][0], 1.0, True, 0) in got
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, pictures, tmp_path):
    inbox, out, marks = (tmp_path / x for x in ("in", "out", "marks"))
    inbox.mkdir()
    (inbox / "a.png").write_bytes(pictures[1])
    (inbox / "same.png").write_bytes(pictures[9])
    stream = lambda: ingest.first_of_exact(ingest.fingerprint_stream(ingest.picture_stream(spark, f"file://{inbox}")))
    for n in (1, 2):
        ingest.write_stream(stream(), str(out), str(marks)).awaitTermination()
        assert spark.read.parquet(str(out)).count() == n
        (inbox / "b.png").write_bytes(pictures[2])
    got = []
    ingest.write_stream(ingest.fingerprint_stream(ingest.picture_stream(spark, f"file://{inbox}")), "", str(tmp_path / "m2"), lambda df, _: got.append(df.count())).awaitTermination()
    assert sum(got) == 3


class Mean:
    """A provider: mean colours."""

    model_id = "mean"

    def embed(self, content):
        from pixelweft.operators import decode
        from pixelweft.schema import PreprocessConfig as Config

        return kernels.to_rgb(decode.decode_pixels(content, Config())).reshape(-1, 3).mean(axis=0)


def test_embedding_provider(spark, pictures):
    df = spark.createDataFrame([(k, pictures[k]) for k in (1, 5, 6, 7, 8)], "id int, content binary")
    rows = {r["id"]: r for r in fp.embed(df, Mean(), keep=("id",)).collect()}
    assert rows[1]["embedding"]["model_id"] == "mean" and len(rows[1]["embedding"]["vector"]) == 3
    assert rows[6]["error"]["kind"] == "UnsupportedFormat" and rows[7]["embedding"] is None and rows[7]["error"] is None
    assert rows[8]["error"]["kind"] == "InvalidEmbedding"  # black: all zero
    x = fp.model_input(pictures[1], fp.ModelInputConfig.large_336())
    assert x.shape == (3, 336, 336)
    bad = fp.embed(df.where("id = 1"), fp.OnnxProvider(b"no model")).first()
    assert bad["error"]["kind"] == "ProviderError"


def test_driver_contract(spark):
    rows = driver.entry(spark).collect()
    assert rows and rows[0]["id"] == 0
    names = set(driver.queries())
    assert set(driver.oracle_sql()) <= names and len(names) > 50


def test_json_of_small_types(spark):
    from pixelweft.schema import ModelInputConfig

    s = spark.createDataFrame([(0.5, True, 3), (None, None, None)], "score float, exact_match boolean, perceptual_distance int").select(F.struct("*").alias("s"))
    texts = [r[0] for r in s.select(formatting.json_similarity(F.col("s"))).collect()]
    assert texts == ['{"score":0.5,"exact_match":true,"perceptual_distance":3}', '{"score":null,"exact_match":null,"perceptual_distance":null}']
    back = s.select(formatting.parse_json_similarity(formatting.json_similarity(F.col("s"))).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in back] == [(0.5, True, 3), (None, None, None)]
    e = spark.createDataFrame([([1.5, -2.0], "m"), ([0.25], None)], "vector array<float>, model_id string").select(formatting.json_embedding(F.struct("*")).alias("j"))
    assert e.first()["j"] == '{"vector":[1.5,-2.0],"model_id":"m"}'
    extra = spark.createDataFrame([('{"vector":[1.0],"model_id":null,"x":1}',)], "j string")
    assert extra.select(formatting.parse_json_embedding(F.col("j")).alias("e")).first()["e"] is None
    err = spark.createDataFrame([("IoError", "io error: x")], "kind string, message string").select(formatting.json_error(F.struct("*")).alias("j"))
    assert err.first()["j"] == '{"IoError":"io error: x"}'
    for config in (MultiHashConfig(block_distance_threshold=7), ModelInputConfig.large_336()):
        assert formatting.parse_json_config(formatting.json_config(config), type(config)) == config
    with pytest.raises(ValueError, match="unknown"):
        formatting.parse_json_config('{"x":1}', MultiHashConfig)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from pixelweft import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)


def test_any_exception_of_a_picture_is_its_error(monkeypatch):
    def broken(content, config):
        raise RuntimeError("odd")

    assert fp.read_grey(None, PreprocessConfig()) == (None, None)
    monkeypatch.setattr(fp.decode, "decode", broken)
    grey, error = fp.read_grey(b"x", PreprocessConfig())
    assert grey is None and error.kind == "ProcessingError" and str(error) == "processing error: RuntimeError: odd"


def test_cosine_blocks_leave_out_the_query(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(8)], "id bigint, vector array<float>")
    got = search.cosine_blocks(rows, rows.where("id = 7"), k=5, others=True).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4]


def test_missing_and_oversized_files_are_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(gradient(50, 40)))
    (tmp_path / "big.png").write_bytes(b"x" * 5000)
    listed = [(f"file://{tmp_path}/a.png",), (str(tmp_path / "a.png"),), (f"file://{tmp_path}/none.png",), (str(tmp_path / "big.png"),), (str(tmp_path),), (None,)]
    rows = files.fingerprint_paths(spark, spark.createDataFrame(listed, "path string"), PreprocessConfig(max_input_bytes=4999)).collect()
    kinds = [r["error"]["kind"] if r["error"] else None for r in rows]
    assert kinds == [None, None, "IoError", "IoError", "IoError", None]
    assert rows[0]["phash"] == rows[1]["phash"] and rows[0]["phash"] is not None and rows[3]["length"] == 5000 and rows[5]["phash"] is None


def pooling_model(batch):
    """A model file in the public exchange format: the mean of each channel. Written field by field, as there is no library."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, body: number(k << 3 | 2) + number(len(body)) + body
    value = lambda k, n: number(k << 3) + number(n)
    dim = lambda d: field(1, field(2, d.encode()) if isinstance(d, str) else value(1, d))
    tensor = lambda name, dims: field(1, name.encode()) + field(2, field(1, value(1, 1) + field(2, b"".join(map(dim, dims)))))
    node = lambda kind, a, b: field(1, a.encode()) + field(2, b.encode()) + field(4, kind.encode())
    graph = field(1, node("GlobalAveragePool", "x", "m")) + field(1, node("Flatten", "m", "y")) + field(2, b"g") + field(11, tensor("x", [batch, 3, 224, 224])) + field(12, tensor("y", [batch, 3]))
    return value(1, 8) + field(7, graph) + field(8, field(1, b"") + value(2, 13))


@pytest.mark.parametrize("batch", ["n", 1])
def test_embeddings_by_a_real_model(spark, batch):
    from pixelweft.schema import ModelInputConfig

    pictures = [png(np.full((60, 50, 3), v, np.uint8)) for v in (0, 100, 255)] + [b"broken", None, png(gradient(64, 64))]
    rows = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in enumerate(pictures)], "id int, content binary").coalesce(1)
    config = ModelInputConfig(normalize_output=False)
    got = {r["id"]: r for r in fp.embed(rows, fp.OnnxProvider(pooling_model(batch), config), keep=("id",)).collect()}
    for i, v in enumerate((0, 100, 255)):
        want = (v / 255 - np.array(config.mean)) / np.array(config.std)
        assert np.allclose(got[i]["embedding"]["vector"], want, atol=1e-3) and got[i]["error"] is None
    assert got[3]["error"]["kind"] == "UnsupportedFormat" and got[3]["embedding"] is None
    assert got[4]["error"] is None and got[4]["embedding"] is None
    unit = fp.OnnxProvider(pooling_model(batch)).embed(pictures[5])
    assert np.isclose(np.linalg.norm(unit), 1, atol=1e-5)


def test_decoded_pictures_with_the_other_exact_hash(spark):
    rgb = gradient(40, 33)
    row = ("a", 33, 40, 3, 16, bytearray(rgb[..., ::-1].tobytes()))
    images = spark.createDataFrame([(row,)], "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    got = fp.fingerprint_decoded(images, exact="blake3").first()
    assert bytes(got["exact"]) == blake3(rgb.tobytes()) and got["phash"] is not None


def test_scratch_is_released(spark):
    import os

    from pixelweft import session

    scratch = session.Scratch(spark, "released")
    table, n = scratch.counted(spark.range(10), F.col("id") > 6)
    kept = scratch.bucketed(spark.range(20), "b", 3, "id")
    assert n == 3 and table.count() == 10 and kept.count() == 20 and "Exchange" not in kept.groupBy("id").count()._jdf.queryExecution().toString().split("== Physical")[1]
    local = scratch.root.removeprefix("file://")
    assert os.path.isdir(local)
    session.release()
    assert not os.path.isdir(local)


def test_stages_are_timed(spark):
    rows = spark.createDataFrame([(1, bytearray(png(gradient(64, 64)))), (2, bytearray(b"bad")), (3, None)], "id int, content binary")
    timed, seen = store.counted(fp.fingerprint(rows, timed=True), "timed")
    got = {r["id"]: r for r in timed.collect()}
    assert got[1]["timing"]["decode"] > 0 and got[1]["timing"]["normalise"] > 0 and got[1]["timing"]["hash"] > 0
    assert got[2]["timing"]["normalise"] == 0 and got[2]["error"] is not None and got[3]["timing"] is None
    assert seen.get["rows"] == 3 and seen.get["failed"] == 1 and seen.get["hash_us"] == got[1]["timing"]["hash"]
    assert "timing" not in fp.fingerprint(rows).columns


def test_empty_files_are_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(gradient(50, 40)))
    (tmp_path / "none.png").write_bytes(b"")
    (tmp_path / "none.txt").write_bytes(b"")
    for folder in (f"file://{tmp_path}", str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}/*.png"):
        rows = {r["path"]: r for r in files.fingerprint_files(spark, folder).collect()}
        assert {p.rpartition("/")[2] for p in rows} == {"a.png", "none.png"} and len({p.rpartition("/")[0] for p in rows}) == 1
        empty = next(r for p, r in rows.items() if p.endswith("none.png"))
        assert empty["length"] == 0 and empty["error"]["kind"] == "InvalidImage"


def test_blocks_are_halved_by_the_kernel(spark, tmp_path):
    """Pixel by pixel in column expressions a picture took 46 ms of a core."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, None), (1, 0), (250, 240), (251, 241), (2**40 + 7, 2**31 - 1), (77, 12), (77, 12), (None, 5)]
    spark.createDataFrame(rows, "doc_id bigint, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    found = driver.queries()["box_downsample"](spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sql.execute(driver.oracle_sql()["box_downsample"]).fetchall()
    assert len(want) == 16 * len(rows) and sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())
