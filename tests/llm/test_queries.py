"""The registered queries of the training-data operators on the smallest tables, against brute force or SQL."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from rankweave.llm import queries
from tests.llm.test_operators import brute_links, brute_repeats, reference_encoder, vocabulary

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def got(spark, name):
    return queries.queries()[name](spark, SF).toPandas()


def test_op1(spark):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    out = got(spark, "op1_chat_format")
    assert sorted(out.conv_id) == sorted(turns)
    for r in out.itertuples():
        own = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode())) and r.formatted_chars >= sum(len(t) for *_, t in own)


def test_op2(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    out = got(spark, "op2_ann")
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (v * v[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -9
        want, mine = ids[np.lexsort((ids, -s))[:5]], out[out.query_id == ids[q]].sort_values("rank")
        hit, total = hit + len(set(want) & set(mine.vec_id)), total + 5
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
    assert hit / total >= 0.9


def test_op3(spark, docs):
    ids = sorted(docs)
    want = {i: x for i, x in zip(ids, brute_repeats([docs[i] for i in ids], 400))}
    out = got(spark, "op3_suffix_dedup")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples()} == want


def test_op4(spark, docs):
    out = got(spark, "op4_jaccard_join")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == brute_links(list(docs.items()), 3, 90, 100)


def test_op5(spark, docs):
    out = got(spark, "op5_quality")
    assert {r.doc_id: r.held_out for r in out.itertuples()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    # held-out accuracy needs more labels than the smallest tables have
    more = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{more}/labels.parquet").collect()}
    out = queries.queries()["op5_quality"](spark, more).toPandas()
    held = out[out.held_out & out.doc_id.isin(labels)]
    assert len(held) > 50 and (held.predicted == held.doc_id.map(labels)).mean() >= 0.9


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    out = got(spark, "op6_vector_packing").sort_values(["doc_id", "start"])
    assert set(out.doc_id) == set(docs)
    for i, pieces in out.groupby("doc_id"):
        ids = np.array([*tok.encode(docs[i].decode(), add_special_tokens=False).ids, 0], dtype="<u4")
        assert pieces.start.tolist() == (pieces.length.cumsum() - pieces.length).tolist() and pieces.length.sum() == len(ids) and set(pieces.doc_tokens) == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces.itertuples())
    s = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert s.length.sum().max() <= 1024 and all((g.length.cumsum() - g.length).tolist() == g.offset.tolist() for _, g in s)


def test_op8(spark, docs):
    words = {i: [*b.lower().split(), None] for i, b in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    count = collections.Counter(w for i in docs if not held[i] for w in words[i])
    n, v = sum(count.values()), len(count)
    for r in got(spark, "op8_lm_score").itertuples():
        t = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(count[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 and r.score < 0


def test_op10(spark, docs):
    enc = reference_encoder("byte_bpe_multi_50k.tiktoken")
    want = {}
    for i, b in docs.items():
        ids = np.array(enc.encode_ordinary(b.decode()), dtype="<u4")
        want[i] = (len(ids), sha(ids.tobytes()), sha(b))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got(spark, "op10_byte_bpe").itertuples()} == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    mine = got(spark, name)[list(want.columns)]
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    assert rows(mine) == rows(want)
