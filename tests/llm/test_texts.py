"""Personal data against plain patterns, tokens against the tiktoken library, mixing against SQL."""

import base64
import hashlib
import re
import struct

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest

from funnelscope.llm import bpe, queries


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits_of(text):
    return re.sub("[^0-9]", "", text)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits_of(m)) <= 19 and luhn(digits_of(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits_of(m)) <= 15),
}


def test_personal_data(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = []
        for rank, (kind, (pattern, fits)) in enumerate(BASE.items()):
            found = [m for m in re.finditer(pattern, texts[r["doc_id"]] or "") if fits(m[0])]
            assert r[f"n_{kind}"] == len(found)
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
        listed = [s for _, _, s in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))


def test_tokens(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path(queries.RANK_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_mixing(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    result = c.sql(queries.ORACLE["op8_mixing"])
    columns = result.columns
    df = queries.op8_mixing(spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(map(str, result.fetchall()))


def test_bpe_gives_its_results_in_parts(spark, monkeypatch):
    """Of a batch of Spark's, however many rows it has, ids and bytes leave in small parts; decoding needs no pairs."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [f"text {i} of\nmany" if i % 5 else None for i in range(bpe.ROWS_AT_ONCE * 2 + 9)]
    encoded = list(bpe.encoder(spark, path, public_tokenizers.PATTERN).func(iter([pa.array(texts, pa.string())])))
    monkeypatch.setattr(bpe, "Vocabulary", None)
    decoded = list(bpe.decoder(spark, path).func(iter([pa.concat_arrays(encoded)])))
    assert [len(x) for x in encoded] == [len(x) for x in decoded] == [bpe.ROWS_AT_ONCE, bpe.ROWS_AT_ONCE, 9]
    assert pa.concat_arrays(decoded).to_pylist() == [(t or "").encode() for t in texts]
