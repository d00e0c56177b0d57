from tests.test_fst import fst
from tests.test_ghw import ghw
from tests.test_vcd import write
from tracetide.api import Waveform, open_waves
from tracetide.sources.saved import save


def test_save_and_reread(spark, tmp_path):
    source = open_waves(spark, write(tmp_path, "#0\n0!\n#5\n1!\n#7\n"))
    save(source, str(tmp_path / "kept"))
    again = open_waves(spark, str(tmp_path / "kept"))
    cols = ["signal_id", "time", "bits"]
    assert sorted(map(str, again.changes().select(cols).collect())) == sorted(map(str, source.changes().select(cols).collect()))
    assert again.steps().count() == 3 and again.changes(start=1, end=6).count() == 1
    assert Waveform(spark, str(tmp_path / "kept"))["top.a"].signal.value_at(6) == 1


def test_every_format_opens(spark, tmp_path):
    (tmp_path / "x.ghw").write_bytes(ghw())
    w = Waveform(spark, str(tmp_path / "x.ghw"))
    assert w.file_format == "ghw" and list(w["top.q"].signal) == [(0, "000u"), (5, "100u"), (15, "100z"), (15, 8)] and w["top.s"].enum_type == {"00": "idle", "01": "run", "10": "stop"}
    (tmp_path / "x.fst").write_bytes(fst()[0])
    w = Waveform(spark, str(tmp_path / "x.fst"))
    assert w.file_format == "fst" and w["top.q"][12] == 5 and w["top.r"].signal[-1] == (20, 2.5)
    steps = []
    w.stream_time_steps(lambda t, values, changed: steps.append((t, len(changed))), ["top.clk", "top.q"])
    assert steps == [(0, 2), (10, 2), (20, 2), (30, 1)]
