"""Findings of the fourth round: objects of any size, bounded disk of index generations."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lorebase.operators import index, search
from lorebase.plans import streams
from lorebase.session import shared_dir
from lorebase.sources import derived, files, sinks
from lorebase.sources.tables import table
from lorebase.streaming import indexing


def _written(folder):
    texts = {
        "a.parquet": bytes(range(256)) * 40, "b.csv": b"x\n" * 3000, "c.gz": b"no gzip\r\n\n" * 900 + b"end", "d 1%+.GZ": b"\n" * 5000,
        "none": b"\xff\x00\n\x80" * 2000, "mark.txt": files.MARK + b"text\n" * 2000, "marked.txt": files.MARK + b"text\n" * 2000 + b"end",
        "small.txt": b"small", "part.parquet/p=1/e.parquet": b"0123456789" * 900,
    }
    for name, text in texts.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(text)
    return sorted((f"file:{folder}/{name}", len(text), hashlib.sha256(text).hexdigest()) for name, text in texts.items())


def test_large_objects_are_read_in_pieces_as_they_stand(spark, tmp_path):
    want = _written(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert rows(files.objects(spark, str(tmp_path)), "path") == want
        assert rows(files.objects(spark, str(tmp_path), whole=1000), "path") == want
        assert rows(files.objects(spark, str(tmp_path), "*.gz", whole=1000), "path") == [r for r in want if r[0].endswith(".gz")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_object_over_two_gibibytes_has_a_checksum(spark, tmp_path):
    step, n, want = 1 << 21, 1100, hashlib.sha256()
    with (tmp_path / "large.parquet").open("wb") as out:  # a sparse file
        for i in range(n):
            out.seek(step * (i + 1) - 1)
            out.write(b"\n")
    for _ in range(n):
        want.update(bytes(step - 1) + b"\n")
    found = files.objects(spark, str(tmp_path), "*.parquet").collect()
    assert [(r.size_bytes, r.sha256) for r in found] == [(step * n, want.hexdigest())]


def _tables(spark, root):
    """Folders of tables below ``root``, without their batches and generations."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/segments")
    return sorted(e.getPath().getName() for e in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def test_a_segment_holds_its_records_once_and_only_repeated_versions_are_joined(spark, sf, monkeypatch):
    written = {}
    keep = lambda frame, name: written.setdefault(name, materialized(frame, name))
    materialized = index.materialized
    monkeypatch.setattr(index, "materialized", keep)
    root = shared_dir(spark, "segment-test")
    documents = table(spark, sf, "documents").withColumn("document_id", F.concat(F.lit("d"), "doc_id")).limit(60)
    to_chunks = lambda batch: derived.chunk_rows(derived.document_rows(batch))
    for number, batch in enumerate((documents, documents.filter("doc_id < 5"))):
        indexing.write_segment(batch, number, to_chunks, root=root, dims=16, tenant=F.col("tenant_id"))
    assert _tables(spark, root) == ["records", "stages"]
    indexing.compact(spark, root)
    assert written["repeated-versions"].count() == documents.filter("doc_id < 5").count() > 0
    got, want = indexing.read(spark, root), index.embed(to_chunks(documents), dims=16)
    assert rows(got["records"].select("chunk_id"), "chunk_id") == rows(want.select("chunk_id"), "chunk_id")
    assert got["postings"].count() == index.postings(want).count()


def test_streamed_search_forms_no_pairs_and_equals_scoring_all(spark, sf, monkeypatch):
    root = streams.streamed_index(spark, sf)
    tables = indexing.read(spark, root)
    stats = index.corpus_statistics(tables["records"]).first()
    scored = search.bm25(
        search.query_terms(derived.queries(spark, sf)), tables["postings"], index.document_frequencies(tables["postings"]), F.lit(stats.n_chunks), F.lit(stats.avg_length))
    want = rows(search.top_k(scored, 10).select("query_id", "chunk_id", "document_id", "score", "rank"), "query_id", "rank")
    monkeypatch.setattr(streams, "streamed_index", lambda *_: root)
    monkeypatch.setattr(search, "bm25", lambda *_, **__: 1 / 0)
    assert rows(streams.stream_index_search(spark, sf), "query_id", "rank") == want


def test_upsert_within_merges_only_touched_groups(spark):
    held = spark.range(400).select(
        F.concat(F.lit("v"), F.floor(F.col("id") / 10)).alias("version"), F.concat(F.lit("c"), "id").alias("chunk"), F.lit("old").alias("text"), F.lit(1).alias("no"))
    incoming = held.filter("chunk IN ('c5', 'c6', 'c70')").withColumn("text", F.lit("new")).withColumn("no", F.when(F.col("chunk") == "c6", 0).otherwise(1))
    incoming = incoming.unionByName(held.limit(1).select(F.lit("v90").alias("version"), F.lit("c900").alias("chunk"), F.lit("new").alias("text"), F.lit(1).alias("no")))
    merged = index.upsert_within(held, incoming, "version", ["chunk"], "no")
    assert rows(merged.select(*held.columns), "chunk") == rows(index.upsert(held, incoming, ["chunk"], "no").select(*held.columns), "chunk")
    assert {r.chunk for r in merged.filter("text = 'new'").collect()} == {"c5", "c70", "c900"}  # an incoming row wins a tie, an older one does not


def test_a_bad_first_table_is_rejected_before_the_others_are_built(spark):
    root, built = shared_dir(spark, "early-test"), []
    tables = {"records": lambda _: spark.range(3), "postings": lambda done: built.append(1) or done["records"]}
    with pytest.raises(ValueError, match="validation"):
        sinks.publish_tables(tables, spark, root, "index", first=lambda records: records.count() > 3)
    assert not built and sinks.current(spark, root, "index") is None
    assert sinks.publish_tables(tables, spark, root, "index", first=lambda records: records.count() == 3) == 1 and built
