"""The contract queries over the driver's smallest tables: with their SQL where there is one, else by what the contract says."""

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from ferrule.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and {"pipeline", *QUERIES} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, db, name):
    got = QUERIES[name](spark, DATA).toArrow()
    want = db.execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted((tuple(v for _, v in sorted(r.items())) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)


COLUMNS = {
    "op1_mih_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op3_language_mixture": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op4_piece_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op6_simhash_near_dedup": "doc_id:bigint fingerprint:string component_id:bigint",
    "op7_subword_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op8_kk_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op9_nearest_url_text": "page_id:bigint url:string text:string n_chars:bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, db, name):
    df = QUERIES[name](spark, DATA)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    table, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
    ids = {x[0] for x in db.execute(f"SELECT {key} FROM {table}").fetchall()}
    if name.startswith("op1_"):
        n = db.execute("SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0").fetchone()[0]
        assert len(rows) == 20 * n and {x.rank for x in rows} == set(range(1, 21)) and all(x.query_id != x.vec_id for x in rows)
    else:
        assert {x[key] for x in rows} == ids and (name.startswith("op8") or len(rows) == len(ids))
    if "held_out" in COLUMNS[name]:
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in rows)
