"""Life of an index on storage."""

import json

import pytest
from pyspark.sql import functions as F

from sparsemill import api
from sparsemill.config import IndexSettings, SettingsError
from sparsemill.operators import search as S
from sparsemill.operators.merge import LevelMerge, MergeAll, NoMerge
from sparsemill.sources.reader import IndexReader
from sparsemill.sources.index import AlreadyExists, Locked, NotFound, SparseIndex
from sparsemill.streaming.ingest import commit_batch, ingest_stream

VECTORS = "row_id bigint, indices array<bigint>, vals array<float>"
ROWS = [(i, [i % 5, 5 + i % 3], [float(1 + i % 7), 2.0]) for i in range(60)] + [(99, [], [])]
QUERY = {2: 1.0, 6: 2.0}


def result(df):
    return [(r["row_id"], r["score"]) for r in df.collect()]


def filled(spark, path, settings=None, policy=None):
    index = SparseIndex.create(spark, str(path), settings)
    with index.writer(policy or NoMerge()) as w:
        for part in range(3):
            w.append(spark.createDataFrame(ROWS, VECTORS).where(F.col("row_id") % 3 == part))
        w.commit("hello")
    return index


@pytest.mark.parametrize("settings", [IndexSettings(), IndexSettings("compressed", "f16"), IndexSettings(element="extended"), IndexSettings(weight="u8"), IndexSettings(quantized=True)])
def test_search_is_the_same_for_all_settings(spark, tmp_path, settings):
    index = filled(spark, tmp_path / "i", settings)
    assert SparseIndex.open(spark, index.path).settings == settings
    searcher = index.reader().searcher()
    assert searcher.num_rows() == 61 and index.snapshot().payload == "hello"
    plain = filled(spark, tmp_path / "plain").reader().searcher()
    got, want = searcher.search(QUERY, 8), result(plain.search(QUERY, 8))
    if settings.quantized:
        assert [s for _, s in result(got)] == pytest.approx([s for _, s in want], abs=0.05)
    else:
        assert result(got) == want == result(searcher.search(QUERY, 8, prune=True))
    before = result(searcher.brute_force(QUERY, 100, include_zero=True))
    assert len(before) == 61
    with index.writer(NoMerge()) as w:
        w.compact([s.segment_id for s in index.snapshot().segments])
        assert len(w.vacuum()) == 3
    after = index.reader().searcher()
    assert after.num_rows() == 61 and len(index.snapshot().segments) == 1
    assert [s for _, s in result(after.brute_force(QUERY, 100, include_zero=True))] == pytest.approx([s for _, s in before], abs=0.05 if settings.quantized else 1e-9)
    assert index.validate_checksums() == []


def test_create_open_lock(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(NotFound):
        SparseIndex.open(spark, path)
    index = SparseIndex.create(spark, path)
    assert index.snapshot().segments == () and index.snapshot().opstamp == 0
    with pytest.raises(AlreadyExists):
        SparseIndex.create(spark, path)
    w = index.writer()
    with pytest.raises(Locked):
        index.writer()
    w.close()
    index.writer().close()
    with pytest.raises(Locked):
        w.insert(1, {1: 1.0})
    assert result(index.reader().searcher().search({1: 1.0}, 3)) == []


def test_stamps_upserts_and_rollback(spark, tmp_path):
    index = SparseIndex.create(spark, str(tmp_path / "i"))
    with index.writer(NoMerge()) as w:
        assert [w.insert(1, {1: 1.0}), w.insert(1, {1: 5.0, 2: 1.0})] == [1, 2]
        assert w.run([(2, {1: 3.0}), (3, {1: 4.0})]) == 5
        assert w.run([]) == 6
        for bad in ({2**32: 1.0}, [(1, 1.0), (1, 2.0)], {1: float("nan")}):
            with pytest.raises(ValueError):
                w.insert(4, bad)
        prepared = w.prepare_commit()
        assert result(index.reader().searcher().search({1: 1.0}, 9)) == []
        prepared.set_payload("p")
        assert prepared.commit() == prepared.opstamp == 7
        w.insert(1, {1: 100.0})
        assert w.rollback() == 7
        w.insert(2, {1: 9.0})
        w.commit()
    assert result(index.reader().searcher().search({1: 1.0}, 9)) == [(2, 9.0), (1, 5.0), (3, 4.0)]
    assert not index.snapshot().unique_rows
    assert [(r["indices"], r["vals"]) for r in index.reader().searcher().row_content(1).collect()] == [([1, 2], [5.0, 1.0])]


def test_delete_all_and_snapshots(spark, tmp_path):
    index = filled(spark, tmp_path / "i")
    manual, live = index.reader(), index.reader()
    live.reload_on_commit = True
    old = manual.searcher()
    with index.writer(NoMerge()) as w:
        w.delete_all()
        w.insert(5, {2: 1.0})
        w.commit()
    assert old.num_rows() == 61 and result(live.searcher().search(QUERY, 9)) == [(5, 1.0)]
    assert manual.searcher().generation == old.generation and manual.reload().generation == old.generation + 1


def test_a_warmed_reader(spark, tmp_path):
    index, seen = filled(spark, tmp_path / "i"), []
    reader = IndexReader(index, reload_on_commit=True, warmer=lambda searcher: seen.append(searcher.warm().generation))
    first = reader.searcher()
    with index.writer(NoMerge()) as w:
        w.insert(5, {2: 90.0})
        w.commit()
    assert result(reader.searcher().search(QUERY, 1)) == [(5, 90.0)] and len(seen) == 2 and seen[1] == seen[0] + 1
    assert first._cached is None


def test_suffix_maxima_end_with_the_lowest_weight(spark, tmp_path):
    for weight, lowest in (("f32", float("-inf")), ("u8", 0.0)):
        index = filled(spark, tmp_path / weight, IndexSettings(weight=weight, element="extended"))
        paths = [index.segment_path(s.segment_id) for s in index.snapshot().segments]
        assert spark.read.parquet(*paths).agg(F.min("max_next_weight")).first()[0] == lowest


def test_merge_after_commit(spark, tmp_path):
    index = filled(spark, tmp_path / "i", policy=MergeAll())
    assert len(index.snapshot().segments) == 1
    small = filled(spark, tmp_path / "j", policy=LevelMerge(min_segments=3))
    assert len(small.snapshot().segments) == 1


def test_invalid_rows_are_refused_and_damage_is_seen(spark, tmp_path):
    index = filled(spark, tmp_path / "i")
    with index.writer() as w:
        with pytest.raises(Exception, match="invalid sparse vector"):
            w.append(spark.createDataFrame([(1, [1, 1], [1.0, 2.0])], VECTORS))
    segment = index.snapshot().segments[0].segment_id
    for f in (tmp_path / "i" / "segments" / segment / "postings").glob("*.parquet"):
        f.unlink()
    assert index.validate_checksums() == [segment]


def test_streaming(spark, tmp_path):
    index = SparseIndex.create(spark, str(tmp_path / "i"))
    batch = spark.createDataFrame(ROWS, VECTORS)
    assert commit_batch(index, batch, 0) and not commit_batch(index, batch, 0)
    source = tmp_path / "source"
    batch.write.parquet(str(source))
    other = SparseIndex.create(spark, str(tmp_path / "j"))
    stream = spark.readStream.schema(VECTORS).parquet(str(source))
    query = ingest_stream(stream, other.path, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert result(other.reader().searcher().search(QUERY, 9)) == result(index.reader().searcher().search(QUERY, 9))


def test_facade(spark, tmp_path):
    path = str(tmp_path / "i") + "/"
    assert api.create_index(spark, path, {"weight": "f32"})
    with pytest.raises(NotFound):
        api.search(path, {1: 1.0}, 1)
    assert api.insert(spark, path, 7, {1: 2.0}) == 1
    api.insert_df(spark, path, spark.createDataFrame([(8, [1], [3.0])], VECTORS))
    api.load_reader(spark, path)
    api.commit(spark, path)
    assert result(api.search(path, {1: 1.0}, 5)) == [(8, 3.0), (7, 2.0)]
    api.delete(spark, path, [8])
    api.insert(spark, path, 7, {2: 1.0}, replace_row=True)
    api.commit(spark, path)
    assert result(api.search(path, {1: 1.0, 2: 1.0}, 5)) == [(7, 1.0)]
    assert api.close_writer(path) and not api.close_writer(path) and api.close_reader(path) and not api.close_reader(path)


def test_deletes_and_replaced_rows(spark, tmp_path):
    index = filled(spark, tmp_path / "i")
    before = dict(result(index.reader().searcher().search(QUERY, 100)))
    with index.writer(NoMerge()) as w:
        w.delete_rows([2, 7, 99, 12345])
        assert dict(result(index.reader().searcher().search(QUERY, 100))) == before
        w.rollback()
        w.delete_rows(spark.createDataFrame([(2,), (7,), (99,), (None,)], "row_id bigint"))
        w.insert(7, {2: 3.0})
        w.commit()
        searcher = index.reader().searcher()
        want = {r: s for r, s in before.items() if r not in (2, 7)} | {7: 3.0}
        assert dict(result(searcher.search(QUERY, 100))) == want and searcher.num_rows() == 59
        w.insert(7, {6: 1.0})
        w.insert(8, {6: 1.0}, replace_row=True)
        w.append(spark.createDataFrame([(9, [2], [1.5])], VECTORS), replace_row=True)
        w.commit()
        searcher = index.reader().searcher()
        want |= {7: 3.0 + 2.0, 8: 2.0, 9: 1.5}
        assert dict(result(searcher.search(QUERY, 100))) == want
        assert searcher.row_content(9).first()["indices"] == [2] and searcher.row_content(8).first()["indices"] == [6]
        w.compact([s.segment_id for s in index.snapshot().segments])
        w.vacuum()
    assert index.snapshot().tombstones == () and index.folder.list("deletes") == [] and index.snapshot().unique_rows
    searcher = index.reader().searcher()
    assert dict(result(searcher.search(QUERY, 100))) == want and searcher.num_rows() == 59


def test_a_list_without_random_half_equals_its_rebuild(spark, tmp_path):
    rows = [(r, [5], [float(r % 11)]) for r in range(0, 600, 2)]
    gone = [r for r, _, _ in rows if hash((r, 3)) % 2]
    index = SparseIndex.create(spark, str(tmp_path / "i"), IndexSettings(element="extended"))
    with index.writer(NoMerge()) as w:
        w.append(spark.createDataFrame(rows, VECTORS))
        w.delete_rows(gone)
        w.commit()
        w.compact([s.segment_id for s in index.snapshot().segments])
    left = [(r, v[0]) for r, _, v in rows if r not in set(gone)]
    stored = spark.read.parquet(index.segment_path(index.snapshot().segments[0].segment_id)).orderBy("row_id").collect()
    assert [(r["row_id"], r["weight"]) for r in stored] == left
    assert [r["max_next_weight"] for r in stored] == [max((w for _, w in left[i + 1 :]), default=float("-inf")) for i in range(len(left))]


def test_a_commit_reads_no_segment_of_other_rows(spark, tmp_path, monkeypatch):
    index = SparseIndex.create(spark, str(tmp_path / "i"))
    with index.writer(NoMerge()) as w:
        w.append(spark.createDataFrame([(i, [1], [1.0]) for i in range(100)], VECTORS))
        w.commit()
        read = []
        old = index.snapshot().segments[0].segment_id
        path = SparseIndex.segment_path
        monkeypatch.setattr(SparseIndex, "segment_path", lambda self, s, part="postings": read.append(s) or path(self, s, part))
        w.append(spark.createDataFrame([(i, [1], [1.0]) for i in range(100, 120)], VECTORS))
        w.commit()
        assert old not in read and index.snapshot().unique_rows
        w.append(spark.createDataFrame([(i, [1], [1.0]) for i in range(50, 70) if i % 2 > 5], VECTORS))
        w.append(spark.createDataFrame([(60, [1], [4.0])], VECTORS))
        w.commit()
        assert old in read and not index.snapshot().unique_rows


def test_locks_of_lost_writers_are_taken_over(spark, tmp_path):
    index = filled(spark, tmp_path / "i")
    lost = index.writer(NoMerge())
    with pytest.raises(Locked):
        index.writer()
    lock = tmp_path / "i" / ".writer.lock"
    held = json.loads(index.folder.read(".writer.lock"))
    index.folder.replace(".writer.lock", json.dumps(held | {"host": "elsewhere", "until": 0}))
    with index.writer(NoMerge()) as w:
        w.insert(500, {2: 9.0})
        with pytest.raises(Locked):
            lost.commit()
        w.commit()
    # A stream that is started again has the same name; a process that is gone holds nothing.
    index.writer(owner="stream")
    index.writer(owner="stream").close()
    index.folder.replace(".writer.lock", json.dumps(held | {"pid": 2**22 + 1}))
    index.writer().close()
    assert not lock.exists() and 500 in dict(result(index.reader().searcher().search(QUERY, 1)))


def test_damage_in_any_part_is_seen(spark, tmp_path):
    for settings, part in ((IndexSettings(quantized=True), "params"), (IndexSettings(), "rows"), (IndexSettings(element="extended"), "stats")):
        index = filled(spark, tmp_path / part, settings)
        segment = index.snapshot().segments[0].segment_id
        assert index.validate_checksums() == []
        changed = spark.read.parquet(index.segment_path(segment, part)).limit(1).collect()
        schema = spark.read.parquet(index.segment_path(segment, part)).schema
        spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(index.segment_path(segment, part))
        assert index.validate_checksums() == [segment]


def test_segments_of_other_settings_are_refused(spark, tmp_path):
    index, other = filled(spark, tmp_path / "i"), filled(spark, tmp_path / "j", IndexSettings(weight="u8"))
    with index.writer(NoMerge()) as w:
        with pytest.raises(SettingsError):
            w.add_segment(other.snapshot().segments[0])
        made = index.write_segment(w.new_segment(), spark.createDataFrame([(2, 700, 5.0, 1)], "dim_id bigint, row_id bigint, weight float, opstamp bigint"), spark.createDataFrame([(700, 1)], "row_id bigint, opstamp bigint"))
        w.add_segment(made)
        w.commit()
    assert (700, 5.0) in result(index.reader().searcher().search({2: 1.0}, 100))


def test_temporary_index_and_byte_budget(spark):
    index = SparseIndex.create_temporary(spark)
    with index.writer(NoMerge(), buffer_bytes=200) as w:
        for i in range(9):
            w.insert(i, {1: 1.0, 2: 2.0})
        w.commit()
    assert len(index.snapshot().segments) == 3 and index.reader().searcher().num_rows() == 9
    index.drop()
    assert not SparseIndex.exists(spark, index.path)


def test_pruning_by_stored_maxima(spark, tmp_path):
    index = SparseIndex.create(spark, str(tmp_path / "i"), IndexSettings(element="extended"))
    with index.writer(NoMerge()) as w:
        w.append(spark.createDataFrame([(i, [1, 2, 3], [float(i % 50), 0.5, float(i % 3)]) for i in range(300)] + [(i, [2], [0.75]) for i in range(300, 900)], VECTORS))
        w.commit()
    snapshot, query = index.snapshot(), {1: 2.0, 2: 1.0, 3: 0.5}
    stats = index.list_stats(snapshot, [1, 2, 3])
    assert {r["dim_id"]: (r["n"], r["max_w"]) for r in stats.collect()} == {1: (300, 49.0), 2: (900, 0.75), 3: (300, 2.0)}
    postings = index.reader().searcher().postings([1, 2, 3])
    pruned = S.search_pruned(postings, query, 6, None, stats, least_saved=1)
    assert "LeftSemi" in pruned._jdf.queryExecution().executedPlan().toString()
    assert result(pruned) == result(S.search(postings, query, 6)) == result(index.reader().searcher().search(query, 6, prune=True))
