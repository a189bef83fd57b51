"""Storage, joins, compaction and streams; and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import compaction
from corpusloom.plans.joins import sized_join
from corpusloom.plans.storage import materialize, shared_dir, stored_bytes
from corpusloom.streaming import streams

DATA = "/root/testdata/sf0.001"


def test_materialize(spark):
    df = materialize(spark.range(5).toDF("x"))
    assert df.count() == 5 and stored_bytes(df) > 0 and df.inputFiles()[0].split("/")[-3:-2] == ["corpusloom"]
    assert materialize(spark.range(0).toDF("x")).count() == 0 and shared_dir(spark)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_sized_join(spark, how):
    left = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(300)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "k int, w string")
    want = sorted(map(str, left.join(right, "k", how).collect()))
    for limit in (100, 1):
        assert sorted(map(str, sized_join(left, right, ["k"], how, limit=limit).select(left.join(right, "k", how).columns).collect())) == want


def test_compaction(spark):
    rows = [("page", 1, "u", "a\nb"), ("page", 2, "u", "a\nb"), ("page", 3, "u", ""), ("text", 1, "u", None), ("text", 2, None, "x" * 5000), ("page", 4, "v", "a\nb")]
    df = spark.createDataFrame(rows, "kind string, id long, url string, body string")
    for target in (10, 1 << 20):
        m, folder = compaction.compact(df, "body", target=target, total_bytes=1)
        back = {(r["kind"], r["id"]): r["content"] for r in compaction.read_members(spark, m, folder).collect()}
        assert back == {(k, i): b for k, i, _, b in rows if b is not None}
        assert all(r["ok"] for r in compaction.verify(m, folder).collect())
        files = spark.createDataFrame([(10, "page", 1), (11, "page", 2), (11, "page", 2), (12, "page", 3), (13, "text", 1), (14, "page", 4), (15, "text", 2), (16, "text", 2)], "file_id long, file_kind string, id long")
        pairs = compaction.same_records(files, m.withColumnRenamed("kind", "file_kind"), ["file_kind", "id"])
        assert [tuple(r) for r in pairs.collect()] == [(10, 11)]
    assert compaction.compact(df.limit(0), "body")[0].count() == 0


def test_compaction_of_frames_and_lines(spark):
    assert compaction.line_member(b"\xef\xbb\xbfh\na", True, True) == b"h\na\n" and compaction.line_member(b"h\na\n", False, True) == b"a\n" and compaction.line_member(b"", False) == b""
    frame = compaction.as_frame(b"abc")
    assert compaction.frames_complete(frame + frame) and not compaction.frames_complete(frame[:-1]) and not compaction.frames_complete(b"abc")
    df = spark.createDataFrame([(1, bytearray(frame)), (2, bytearray(frame))], "id long, body binary")
    m, folder = compaction.compact(df, "body", kind="zstd", total_bytes=1)
    assert compaction.verify(m, folder, kind="zstd").first()["ok"] and m.agg(F.max("stored")).first()[0] == len(frame)
    lines = spark.createDataFrame([(1, "a"), (2, "b\n")], "id long, body string")
    m, folder = compaction.compact(lines, "body", kind="lines", total_bytes=1)
    assert sum(r["stored"] for r in m.collect()) == 4 and compaction.verify(m, folder, kind="lines").first()["ok"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("https://a/x?utm_source=q\n# no\nhttps://a/x\n\nhttps://b/\n")
    seen = []
    streams.run_available(streams.distinct_urls(streams.seed_stream(spark, str(tmp_path / "in"))), lambda df, _: seen.extend(r["url"] for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == ["https://a/x", "https://b/"]
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = {tuple(r) for r in streams.progress_windows(events, "ts", F.col("event_type") == "error").collect()}
    (tmp_path / "ev").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "ev" / "a"))
    counted = []
    stream = streams.progress_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev" / "a")), "ts", F.col("event_type") == "error", delay="10 minutes")
    streams.run_available(stream, lambda df, _: counted.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck2"), "complete")
    assert set(counted) == batch


def test_queries_of_the_core_against_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages text_out stored_files visited website_scraper mix_targets size_limits".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    from corpusloom.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    for name in ("normalize_url", "strip_tracking", "same_domain_links", "sitemap_seed", "collision_suffix", "extract_text", "bfs_depth", "crawl_stats", "crawl_summary", "multi_domain_crawl", "p5_found", "p5_manifest", "retry_outcome"):
        cols = sorted(QUERIES[name](spark, DATA).columns)
        plain = lambda v: "" if v is None else str(round(v, 6) if isinstance(v, float) else v)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in QUERIES[name](spark, DATA).collect())
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
        assert got == sorted(tuple(map(plain, r)) for r in want), name


def test_bfs_depth_against_brute_force(spark, tmp_path):
    """A graph deeper than the recursion of the SQL goes."""
    hops = 5
    orders = [(k, k) for k in range(1, hops + 1)] + [(90, 1), (91, 77)]
    items = [(k, 1, k, k + 1) for k in range(1, hops + 1)] + [(90, 1, 1, 3), (91, 1, 5, 5), (1, 2, 9, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in range(1, hops + 2)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    edges = {(f"/c/{c}", f"/o/{o}") for o, c in orders} | {(f"/s/{k}", f"/c/{k}") for k in range(1, hops + 2)}
    edges |= {e for o, n, p, s in items if n == 1 for e in ((f"/o/{o}", f"/p/{p}"), (f"/p/{p}", f"/s/{s}"))}
    want, todo = {"/c/1": 0}, ["/c/1"]
    for u in todo:
        for v in sorted(b for a, b in edges if a == u and b not in want):
            want[v] = want[u] + 1
            todo.append(v)
    assert max(want.values()) > 12
    got = __spark_entry__.queries()["bfs_depth"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["url"]: r["depth"] for r in got} == want


def test_container_folder_in_the_default_file_system(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y\nz")], "k int, body string")
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    before = hconf.get("fs.defaultFS")
    hconf.set("fs.defaultFS", "file:///")
    try:
        manifest, uri = compaction.compact(rows, "body", str(tmp_path / "c"), "lines")
    finally:
        hconf.set("fs.defaultFS", before)
    assert uri == f"file://{tmp_path}/c" and all(r["ok"] for r in compaction.verify(manifest, uri, "lines").collect())
    # a byte that changes within a line is noticed
    f = next(p for p in (tmp_path / "c").iterdir() if not p.name.startswith("."))
    f.write_bytes(f.read_bytes().replace(b"x", b"q"))
    (tmp_path / "c" / f".{f.name}.crc").unlink(missing_ok=True)
    assert not all(r["ok"] for r in compaction.verify(manifest, uri, "lines").collect())


def test_tables_on_the_way_can_be_deleted(spark):
    from pathlib import Path

    from corpusloom.plans.storage import materialize, release, shared_dir

    materialize(spark.range(3), "gone")
    assert list(Path(shared_dir(spark)).glob("corpusloom/gone-*"))
    assert release(spark) > 0 and not list(Path(shared_dir(spark)).glob("corpusloom/gone-*"))
