"""Texts of fingerprints, and the binary record of a multi fingerprint."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import N_BLOCKS, HashAlgorithm
from .u64 import from_hex, hex64, unsigned_text


def exact_hex(exact: Column) -> Column:
    return F.lower(F.hex(exact))


def format_single(fp: Column) -> Column:
    """exact:global:block,block,… in hex."""
    return F.concat_ws(":", exact_hex(fp["exact"]), hex64(fp["global_hash"]), F.array_join(F.transform(fp["block_hashes"], hex64), ","))


def format_multi(fp: Column) -> Column:
    """exact|ahash|phash|dhash, the global hashes in hex."""
    return F.concat_ws("|", exact_hex(fp["exact"]), *(hex64(fp[a.field]["global_hash"]) for a in HashAlgorithm))


def export_row(filename: Column, fp: Column) -> Column:
    """What the JSON export says of a picture."""
    return F.struct(filename.alias("filename"), exact_hex(fp["exact"]).alias("exact_hash"), hex64(fp["phash"]["global_hash"]).alias("global_hash"), hex64(fp["dhash"]["global_hash"]).alias("global_dhash"))


def _byte_numbers(b: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))


def _numbers(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))


def _json(exact: Column, hashes: Column) -> Column:
    return F.concat(
        F.lit('{"exact":'), _numbers(_byte_numbers(exact).cast("array<string>")),
        F.lit(',"global_hash":'), unsigned_text(hashes["global_hash"]),
        F.lit(',"block_hashes":'), _numbers(F.transform(hashes["block_hashes"], unsigned_text)), F.lit("}"),
    )


def json_single(fp: Column) -> Column:
    """JSON with the exact hash as an array of byte values and hashes as unsigned numbers, which may exceed 2^53."""
    return _json(fp["exact"], fp)


def json_multi(fp: Column) -> Column:
    """JSON of a multi fingerprint; each algorithm repeats the exact hash."""
    parts = [F.concat(F.lit(f',"{a.field}":'), _json(fp["exact"], fp[a.field])) for a in HashAlgorithm]
    return F.concat(F.lit('{"exact":'), _numbers(_byte_numbers(fp["exact"]).cast("array<string>")), *parts, F.lit("}"))


_SINGLE_JSON = "exact array<int>, global_hash decimal(20,0), block_hashes array<decimal(20,0)>"


def _bytes_of(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))


def _signed(d: Column) -> Column:
    return F.conv(F.conv(d.cast("string"), 10, 16), 16, -10).cast("bigint")


def _fields_are(text: Column, names: tuple[str, ...]) -> Column:
    return F.array_sort(F.json_object_keys(text)) == F.array(*(F.lit(n) for n in sorted(names)))


def _sizes_fit(x: Column) -> Column:
    return (F.size(x["exact"]) == 32) & (F.size(x["block_hashes"]) == N_BLOCKS)


def parse_json_single(text: Column) -> Column:
    """The fingerprint of ``json_single``. Null where fields are missing or unknown or sizes are wrong."""
    x = F.from_json(text, _SINGLE_JSON)
    fp = F.struct(_bytes_of(x["exact"]).alias("exact"), _signed(x["global_hash"]).alias("global_hash"), F.transform(x["block_hashes"], _signed).alias("block_hashes"))
    return F.when(_fields_are(text, ("exact", "global_hash", "block_hashes")) & _sizes_fit(x), fp)


def parse_json_multi(text: Column) -> Column:
    """The multi fingerprint of ``json_multi``. Null where fields are missing or unknown or sizes are wrong."""
    names = [a.field for a in HashAlgorithm]
    x = F.from_json(text, "exact array<int>, " + ", ".join(f"{n} struct<{_SINGLE_JSON.replace(' array', ':array').replace(' decimal', ':decimal')}>" for n in names))
    ok = _fields_are(text, ("exact", *names)) & (F.size(x["exact"]) == 32)
    for n in names:
        ok = ok & _sizes_fit(x[n]) & _fields_are(F.get_json_object(text, f"$.{n}"), ("exact", "global_hash", "block_hashes"))
    hashes = [F.struct(_signed(x[n]["global_hash"]).alias("global_hash"), F.transform(x[n]["block_hashes"], _signed).alias("block_hashes")).alias(n) for n in names]
    return F.when(ok, F.struct(_bytes_of(x["exact"]).alias("exact"), *hashes))


def _turned(text: Column) -> Column:
    """16 hex digits with their bytes in reverse order."""
    return F.concat(*(F.substring(text, 15 - 2 * i, 2) for i in range(8)))


def _little_hex(h: Column) -> Column:
    """Hex text of 8 bytes, the least significant first."""
    return _turned(F.lpad(F.hex(h), 16, "0"))


def _word_at(record: Column, offset: int | Column) -> Column:
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return from_hex(_turned(F.hex(F.substring(record, at + 1, F.lit(8)))))


#: Bytes of a single record: exact hash, global hash, block hashes.
SINGLE_BYTES = 32 + 8 * (1 + N_BLOCKS)
MULTI_BYTES = 32 + 3 * SINGLE_BYTES


def pack_single(exact: Column, hashes: Column) -> Column:
    """168-byte record, little-endian. Null unless there are 32 exact bytes and 16 blocks, none of them null."""
    ok = (F.octet_length(exact) == 32) & (F.size(hashes["block_hashes"]) == N_BLOCKS) & F.forall(hashes["block_hashes"], lambda b: b.isNotNull())
    blocks = F.array_join(F.transform(hashes["block_hashes"], _little_hex), "")
    return F.when(ok, F.unhex(F.concat(F.hex(exact), _little_hex(hashes["global_hash"]), blocks)))


def pack_multi(fp: Column) -> Column:
    """536-byte record: the exact hash, then a single record of each algorithm."""
    return F.concat(fp["exact"], *(pack_single(fp["exact"], fp[a.field]) for a in HashAlgorithm))


def unpack_single(record: Column, offset: int = 0) -> Column:
    """The fingerprint in a record; null for a record that is too short."""
    blocks = F.transform(F.sequence(F.lit(1), F.lit(N_BLOCKS)), lambda i: _word_at(record, i * 8 + offset + 32))
    fp = F.struct(F.substring(record, offset + 1, 32).alias("exact"), _word_at(record, offset + 32).alias("global_hash"), blocks.alias("block_hashes"))
    return F.when(F.octet_length(record) >= offset + SINGLE_BYTES, fp)


def unpack_multi(record: Column) -> Column:
    """The multi fingerprint in a 536-byte record; null for any other length."""
    parts = [unpack_single(record, 32 + i * SINGLE_BYTES) for i in range(3)]
    hashes = [F.struct(p["global_hash"].alias("global_hash"), p["block_hashes"].alias("block_hashes")).alias(a.field) for p, a in zip(parts, HashAlgorithm, strict=True)]
    return F.when(F.octet_length(record) == MULTI_BYTES, F.struct(F.substring(record, 1, 32).alias("exact"), *hashes))


def bincode_single(exact: Column, hashes: Column) -> Column:
    """The compact binary coding of a single fingerprint: fixed arrays without lengths, fixed little-endian numbers. For
    fingerprints these are the bytes of the plain record."""
    return pack_single(exact, hashes)


def bincode_multi(fp: Column) -> Column:
    return pack_multi(fp)


def from_bincode_single(record: Column) -> Column:
    """The fingerprint in ``bincode_single``; null for any other length."""
    return F.when(F.octet_length(record) == SINGLE_BYTES, unpack_single(record))


def from_bincode_multi(record: Column) -> Column:
    return unpack_multi(record)


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def json_similarity(similarity: Column) -> Column:
    """JSON of a similarity; missing parts are null."""
    return F.concat(F.lit('{"score":'), _text(similarity["score"]), F.lit(',"exact_match":'), _text(similarity["exact_match"]), F.lit(',"perceptual_distance":'), _text(similarity["perceptual_distance"]), F.lit("}"))


def parse_json_similarity(text: Column) -> Column:
    """The similarity of ``json_similarity``. Unknown fields are allowed here."""
    return F.from_json(text, "score float, exact_match boolean, perceptual_distance int")


def json_embedding(embedding: Column) -> Column:
    """JSON of an embedding; a missing model_id is null."""
    return F.to_json(F.struct(embedding["vector"].alias("vector"), embedding["model_id"].alias("model_id")), {"ignoreNullFields": "false"})


def parse_json_embedding(text: Column) -> Column:
    """The embedding of ``json_embedding``. Null where the vector is missing or there are unknown fields."""
    x = F.from_json(text, "vector array<float>, model_id string")
    known = F.forall(F.json_object_keys(text), lambda k: k.isin("vector", "model_id"))
    return F.when(known & x["vector"].isNotNull(), x)


def json_error(error: Column) -> Column:
    """JSON of an error: its kind as the only field, with the message."""
    return F.when(error.isNotNull(), F.to_json(F.create_map(error["kind"], error["message"])))


def json_config(config: object) -> str:
    """JSON of a configuration (a dataclass of numbers), in the order of its fields."""
    return json.dumps(dataclasses.asdict(config), separators=(",", ":"))


def parse_json_config(text: str, kind: type) -> object:
    """The configuration of ``json_config``; unknown fields raise."""
    found = json.loads(text)
    if unknown := set(found) - {f.name for f in dataclasses.fields(kind)}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
