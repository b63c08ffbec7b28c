import duckdb
import pytest
from pyspark.sql import functions as F

from attesta.llm import shards
from tests.llm.cases import ODD, documents


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, "tail"], [*range(len(ODD)), None])
    got = shards.assign_shards(docs, limit=100).collect()
    assert len(got) == len(ODD) + 1
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    texts = dict(zip([*range(len(ODD)), None], [*ODD, "tail"], strict=True))
    for rows in by.values():
        sizes = [len((texts[r.doc_id] or "").encode()) for r in rows]
        assert rows[0].shard_bytes == sum(sizes) and rows[0].shard_rows == len(rows)
        assert rows[0].fits == (sum(sizes) <= 100)
        assert rows[0].fits or len(sizes) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert shards.assign_shards(docs.limit(0)).count() == 0


def test_one_key_is_parted_by_rows(spark):
    docs = documents(spark, ["x" * 10] * 300, [7] * 300)
    got = shards.assign_shards(docs, limit=100).collect()
    assert len(got) == 300 and all(r.fits and r.shard_bytes <= 100 for r in got)


@pytest.mark.parametrize("limit,least", [(shards.LIMIT, shards.SHARDS), (20000, 1), (300, 1)])
def test_shards_match_sql(spark, sf_dir, limit, least):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(shards.op1_sql(limit, least)).fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [tuple(r) for r in shards.assign_shards(docs, limit=limit, shards=least).collect()]
    assert sorted(got) == sorted(want) and len({r[1] for r in got}) > 10 and len({r[2] for r in got}) > 3
    assert {r[5] for r in got} == ({True} if limit > 300 and least == 1 else {True, False})


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = shards.write_shards(docs, f"file://{tmp_path}/out", limit=50000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == of.select("shard").distinct().count()


def test_null_and_hot_keys_are_written_once(spark, tmp_path):
    texts = [f"text {i:05d}" for i in range(90)]
    docs = documents(spark, texts, [7] * 30 + [None] * 30 + list(range(100, 130)))
    of = shards.write_shards(docs, f"file://{tmp_path}/out", limit=100)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r.text for r in back) == texts and of.count() == 90
    sizes = {}
    for r in back:
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text)
    assert max(sizes.values()) <= 100
    assert sizes == {f"b{r.shard}": r.shard_bytes for r in of.collect()}


def test_taken_names(spark, tmp_path):
    docs = documents(spark, ["a", "b"]).withColumns({n: F.lit("mine") for n in ("shard", "size", "cell", "prefix", "depth", "rows", "place", "row", "doc")})
    assert shards.assign_shards(docs, limit=1).count() == 2
    shards.write_shards(docs, f"file://{tmp_path}/out", limit=1)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(back.columns) == sorted(docs.columns) and {r.cell for r in back.collect()} == {"mine"} and back.count() == 2
