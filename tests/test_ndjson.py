"""Lines of growing files: cut at any byte, over batches and restarts."""

import io
import json
import random

from sedimark.streaming import ndjson, state

LINES = [json.dumps({"n": n, "t": t}, ensure_ascii=False) for n, t in enumerate(["a", "ä€\U0001f600", "", "x" * 300, "line two", "ß"])]


def test_ranges_cut_anywhere_have_each_line_once():
    data = ("\n".join(LINES) + "\n\n" + LINES[0] + "\nrest").encode()
    want = [x.decode() for x in data.split(b"\n")]
    for chunk in (1, 2, 3, 7, 50, 1000):
        got = [line.decode() for at in range(0, len(data), chunk) for _, line in ndjson.lines_of_range(io.BytesIO(data), at, min(at + chunk, len(data)), len(data))]
        assert got == want
    assert ndjson.whole_lines(io.BytesIO(data), 0, len(data)) == len(data) - 4 and ndjson.whole_lines(io.BytesIO(b"abc"), 1, 3) == 1


def test_a_growing_file_is_read_line_by_line_over_restarts(spark, tmp_path):
    rng, data = random.Random(1), ("\n".join(LINES * 3) + "\nthe end").encode()
    cuts = sorted(rng.sample(range(1, len(data)), 4))
    (tmp_path / "in").mkdir()
    out, seen = str(tmp_path / "out"), 0
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
        with (tmp_path / "in" / "log.ndjson").open("ab") as f:
            f.write(data[a:b])
        state.run_to_end(ndjson.ndjson_lines(spark, str(tmp_path / "in"), 64), out, str(tmp_path / "checkpoint"))
        got = state.batches(spark, out, "file string, place long, line string").orderBy("place").collect()
        assert [r.line for r in got] == [x.decode() for x in data[:b].split(b"\n")[:-1]] and len(got) >= seen
        seen = len(got)
    state.run_to_end(ndjson.ndjson_lines(spark, str(tmp_path / "in"), 64, final=True), out, str(tmp_path / "checkpoint"))
    last = state.batches(spark, out, "file string, place long, line string").orderBy("place").collect()
    assert [r.line for r in last] == data.decode().split("\n")
