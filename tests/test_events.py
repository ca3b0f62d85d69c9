"""Event files: frames, messages, whole runs written and read back."""

import struct

import pytest

from chronoloom.sources import event_files as V

COLS = "model string, run_id long, flag string, wall_time double, step long, tag string, value double, limits array<double>, counts array<double>"


def test_checksum_of_known_bytes():
    # the standard check value of CRC-32C, masked
    crc = 0xE3069283
    assert V.masked_crc(b"123456789") == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 1 << 40, -1])
def test_steps_of_any_size(n):
    (got,) = V.values_of(V.message_of(1.5, n, "a/b", 0.25))
    assert got == (1.5, n, "a/b", 0.25, None, None)


def test_a_message_with_two_values_and_unknown_fields():
    one = V._field(1, 2, V._field(1, 2, b"x") + V._field(2, 5, struct.pack("<f", 2.0)))
    two = V._field(1, 2, V._field(1, 2, "ü".encode()) + V._field(9, 0, b"\x07") + V._field(5, 2, V._double(6, 0.5) + V._double(6, 1.0) + V._field(7, 2, struct.pack("<2d", 3, 4))))
    message = V._double(1, 9.0) + V._field(2, 0, V._varint(7)) + V._field(5, 2, one + two) + V._field(14, 2, b"??")
    assert list(V.values_of(message)) == [(9.0, 7, "x", 2.0, None, None), (9.0, 7, "ü", None, [0.5, 1.0], [3.0, 4.0])]


def test_cut_and_damaged_files():
    whole = V.frame(b"first") + V.frame(b"") + V.frame(b"third")
    assert list(V.frames(whole)) == [b"first", b"", b"third"]
    assert list(V.frames(whole[:-1])) == [b"first", b""] and list(V.frames(b"")) == []
    for at in (0, 9, 13):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            list(V.frames(bytes(bad)))


def test_runs_are_written_and_read_back(spark, tmp_path):
    rows = [("m 1/x", 1, "fff", 10.0 + i, i, "Test/AUC", i / 4, None, None) for i in range(50)]
    rows += [("m 1/x", 1, "fff", 5.0, 3, "Hist", None, [0.5, 1.0], [1.0, 2.0]), ("m2", 2, "tff", 0.0, 0, "Hist", None, [], []), ("m2", 3, "tff", 0.0, -5, "ü", 1.5, None, None)]
    folder = f"file://{tmp_path}/e"
    done = V.write_events(spark.createDataFrame(rows, COLS), folder).collect()
    assert sorted((r["path"], r["n"]) for r in done) == [("m+1%2Fx/1/fff/events.out", 51), ("m2/2/tff/events.out", 1), ("m2/3/tff/events.out", 1)]
    got = V.read_events(spark, folder, "events.out")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((m, str(r), *rest) for m, r, *rest in rows), key=str)
    assert V.scalars(got).count() == 51 and V.histograms(got, ["Hist"]).count() == 2
    assert V.histograms(got, ["none"]).count() == 0
