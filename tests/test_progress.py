import threading
import time

import pytest

from tracetide.sources import vcd_source as vs
from tracetide.sources.progress import Progress, ReadProgress, StreamProgress

HEAD = "$scope module top $end\n$var wire 1 ! a $end\n$upscope $end\n$enddefinitions $end\n"


def steps(a, b):
    return "".join(f"#{t}\n{t & 1}!\n" for t in range(a, b))


@pytest.fixture(scope="module")
def session(spark):
    vs.register(spark)
    return spark


def run(progress, session, folder, **options):
    rows = session.readStream.format("vcd").options(**options).load(str(folder / "in"))
    query = progress.counted(rows).writeStream.format("noop").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return progress.wait(query.runId)


def test_a_growing_file(session, tmp_path):
    """Figures never fall, over restarts too; the last record of a file is not read before the dump has ended."""
    (tmp_path / "in").mkdir()
    file, progress = tmp_path / "in" / "x.vcd", StreamProgress()
    session.streams.addListener(progress)
    try:
        file.write_text(HEAD + steps(0, 10))
        assert run(progress, session, tmp_path) == Progress(1, file.stat().st_size - len("#9\n1!\n"), 9, 9)
        with open(file, "a") as f:
            f.write(steps(10, 30) + "#30\n")
        assert run(progress, session, tmp_path) == Progress(1, file.stat().st_size - len("#30\n"), 30, 30)
        before = len(progress.history)
        run(progress, session, tmp_path)
        assert len(progress.history) == before
        assert run(progress, session, tmp_path, complete="true") == Progress(1, file.stat().st_size, 31, 30)
    finally:
        session.streams.removeListener(progress)
    assert progress.history == sorted(progress.history) and all(a.bytes <= b.bytes for a, b in zip(progress.history, progress.history[1:]))


def test_other_streams_are_not_counted(session, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.vcd").write_text(HEAD + steps(0, 3))
    mine, other = StreamProgress(), StreamProgress()
    session.streams.addListener(mine)
    try:
        rows = session.readStream.format("vcd").load(str(tmp_path / "in"))
        query = other.counted(rows).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert mine.wait(query.runId) == Progress(0, 0, 0, 0)
        with pytest.raises(TimeoutError):
            mine.wait("another", timeout=0.1)
    finally:
        session.streams.removeListener(mine)


def test_a_batch_read(session, tmp_path):
    """Bytes rise while the ranges are read, to the files' size; job groups around are restored."""
    for k in range(2):
        (tmp_path / f"{k}.vcd").write_text(HEAD + steps(0, 3000 + k))
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    session.sparkContext.setJobGroup("outer", "around")
    seen, stop = [], threading.Event()
    with ReadProgress(session, str(tmp_path), split=2000) as p:
        assert p.total == size and p.bytes() == 0 and len(p.sizes) > 8

        def watch():
            while not stop.is_set():
                seen.append(p.bytes())
                time.sleep(0.02)

        watcher = threading.Thread(target=watch)
        watcher.start()
        rows = session.read.format("vcd").option("splitBytes", "2000").load(str(tmp_path))
        p.counted(rows).groupBy("code").count().collect()
        stop.set()
        watcher.join()
        for _ in range(100):  # the status follows the job by a moment
            if p.bytes() == size:
                break
            time.sleep(0.1)
        assert p.bytes() == size and p.ended() == Progress(2, size, 6001, 6001)
    assert seen == sorted(seen) and 0 <= seen[0] and seen[-1] <= size
    assert session.sparkContext.getLocalProperty("spark.jobGroup.id") == "outer"
    session.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_nothing_to_read(session, tmp_path):
    p = ReadProgress(session, str(tmp_path))
    assert (p.total, p.files, p.bytes()) == (0, 0, 0)
