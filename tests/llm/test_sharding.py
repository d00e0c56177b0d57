import pytest

from tracetide.llm.sharding import Overtaken, Run, ShardStore, shard


def frame(spark, a, b, parts=3):
    rows = [(i if i % 7 else None, f"text {i} " * (i % 40), "x") for i in range(a, b)]
    return spark.createDataFrame(rows, "doc_id long, text string, run string").repartition(parts)


def rows(df):
    return sorted(map(str, df.collect()))


def test_append_merge_and_versions(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target=1 << 20, fan=3, smallest=1 << 10)
    frames = [frame(spark, 100 * i, 100 * i + 100) for i in range(3)]
    for i, f in enumerate(frames):
        assert store.append(f) == i + 1
    assert [r.files for r in store.runs()] == [3, 3, 3] and store.manifest().count() == 9
    old = rows(store.read())
    assert old == sorted(sum((rows(f) for f in frames), []))
    assert store.compact() == 4 and store.compact() is None
    (merged,) = store.runs()
    assert (merged.files, merged.rows) == (1, 300)
    assert rows(store.read()) == old == rows(store.read(3))
    store.vacuum(keep=1)
    assert rows(store.read()) == old and store._names("runs") == [merged.name] and store.version() == 4


def test_commit_is_exclusive_and_failures_leave_no_trace(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    store.append(frame(spark, 0, 10))
    with pytest.raises(Overtaken):
        store.commit([Run("other", 1, 1, 1)], 0)
    store._write(frame(spark, 10, 20))  # a writer that dies before its commit
    assert store.read().count() == 10
    store.vacuum()
    assert len(store._names("runs")) == 1
    with pytest.raises(ValueError):
        ShardStore(spark, str(tmp_path / "none")).read()


def test_torn_manifests_and_unfinished_commits_are_no_versions(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    store.append(frame(spark, 0, 10))
    (tmp_path / "s/manifest/v0000000002.json").write_bytes(b"")
    (tmp_path / "s/manifest/v0000000003.json").write_bytes(b'{"version": 3, "runs": [{"na')
    (tmp_path / "s/manifest/_half").write_bytes(b'{"ver')
    assert store.version() == 1 and store.read().count() == 10
    with pytest.raises(ValueError):
        store.read(3)
    assert store.append(frame(spark, 10, 30)) == 4 and store.read().count() == 30
    store.vacuum()
    assert [n for n in store._names("manifest") if not n.startswith(".")] == ["v0000000001.json", "v0000000004.json"] and store.read(1).count() == 10


def test_of_two_writers_one_commits(spark, tmp_path):
    a, b = (ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(frame(spark, 0, 5))
    run = a._write(frame(spark, 5, 9))
    old = b._numbers

    def late():  # another commit between the look at the numbers and the rename
        found = old()
        b._numbers = old
        a.commit([*a.runs(), run], 1)
        return found

    b.version = lambda: 1
    b._numbers = late
    with pytest.raises(Overtaken):
        b.commit([], 1)
    assert a.version() == 2 and a.read().count() == 9


def test_versions_kept_for_readers(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), fan=2, smallest=1 << 20)
    for i in range(2):
        store.append(frame(spark, 10 * i, 10 * i + 10))
    reader = store.read()
    store.compact()
    store.vacuum(keep=2)
    assert reader.count() == 20 and len(store.runs(2)) == 2 and len(store.runs()) == 1


def test_many_arrivals_keep_few_runs_of_target_size(spark, tmp_path):
    arrivals = [frame(spark, 50 * i, 50 * i + 50) for i in range(9)]
    store = shard(spark, arrivals, str(tmp_path / "s"), target=4000, fan=3, smallest=1 << 10)
    assert rows(store.read()) == sorted(sum((rows(f) for f in arrivals), []))
    assert len(store.runs()) <= 3
    empty = shard(spark, [frame(spark, 0, 5).limit(0)], str(tmp_path / "e"))
    assert empty.read().count() == 0 and empty.read().columns == ["doc_id", "text", "run"]


@pytest.mark.parametrize("hook", ["before the listing", "after the listing", "before the rename"])
def test_no_commit_is_lost_whenever_another_comes_between(spark, tmp_path, hook):
    a, b = (ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(frame(spark, 0, 5))
    for i in range(7):
        mine, other = a._write(frame(spark, 100 * i, 100 * i + 3)), b._write(frame(spark, 100 * i + 50, 100 * i + 54))
        numbers, rename, base = a._numbers, a._rename, a.version()

        def between():
            b.commit([*b.runs(), other], b.version())  # noqa: B023

        def listed():
            if hook == "before the listing":
                between()
            found = numbers()  # noqa: B023
            if hook == "after the listing":
                between()
            return found

        def renamed(made, final):
            if hook == "before the rename":
                between()
            return rename(made, final)  # noqa: B023

        runs = [*a.runs(base), mine]
        a._numbers, a._rename = listed, renamed
        with pytest.raises(Overtaken):
            a.commit(runs, base)
        a._numbers, a._rename = numbers, rename
        a.commit([*a.runs(), mine], a.version())
    assert a.read().count() == 5 + 7 * (3 + 4) and a.version() == 15


def test_vacuum_leaves_young_runs_of_other_writers(spark, tmp_path):
    store, other = (ShardStore(spark, str(tmp_path / "s"), fan=2, smallest=1 << 20) for _ in range(2))
    run = other._write(frame(spark, 50, 60))
    for i in range(2):
        store.append(frame(spark, 10 * i, 10 * i + 10))
    store.compact()
    store.vacuum(keep=1, grace=3600)
    assert len(store._names("runs")) == 2  # the merged one and the other writer's
    other.commit([*other.runs(), run], other.version())
    assert store.read().count() == 30
