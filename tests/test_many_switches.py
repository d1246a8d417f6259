"""Logs that switch the base of their ids very often."""

from tracelake.sources import logs


def test_switches_hold_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(logs, "BASE_BLOCK", 4)
    lines, want = [], {}
    for source, every in (("a", 3), ("b", 37), ("c", 10**6)):
        base = "hex"
        for line in range(1, 121):
            if line % every == 0:
                base = "dec" if base == "hex" else "hex"
                lines.append((source, line, f"base {base}"))
            else:
                lines.append((source, line, f"{line}.0 1 100 Rx d 0"))
                want[source, line] = 256 if base == "hex" else 100
    frames, bad, _ = logs.parse_asc(spark.createDataFrame(lines, "source_id string, line long, value string"))
    assert {(r["source_id"], r["ordinal"]): r["can_id"] for r in frames.collect()} == want
    assert bad.count() == 0
