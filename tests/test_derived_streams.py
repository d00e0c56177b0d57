from tracetide.api import Waveform

TEXT = """$scope module top $end
$var wire 1 ! q [1] $end
$var wire 1 " q [0] $end
$var wire 1 # clk $end
$upscope $end
$enddefinitions $end
#0
0!
0"
1#
#5
1!
#7
1"
0!
#9
0#
"""


def test_derived_signals_stream_as_they_evaluate(spark, tmp_path):
    path = tmp_path / "d.vcd"
    path.write_text(TEXT)
    for stream_only in (False, True):
        w = Waveform(spark, str(path), stream_only=stream_only)
        q = w["top.q"].signal_id
        assert w.is_derived(q) and not w.is_derived(w["top.clk"].signal_id) and [p.width for p in w.derived_signals()[q]] == [1, 1]
        assert w.first_scope().name == "top"
        want = [(0, 0), (5, 2), (7, 1)]
        got = []
        w.stream_changes(lambda *x: got.append(x), ["top.q"])
        assert got == [(t, q, v) for t, v in want]
        got = []
        w.stream_changes(lambda *x: got.append(x))
        assert [x[1] for x in got][3] == q and len(got) == 4 + 3 + 3
        steps = []
        w.stream_time_steps(lambda t, values, changed: steps.append((t, values.get(q), q in changed)))
        assert steps == [(0, 0, True), (5, 2, True), (7, 1, True), (9, 1, False)]
    assert list(Waveform(spark, str(path))["top.q"].signal) == want
