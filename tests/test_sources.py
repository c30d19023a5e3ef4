"""Formats read and written, rules that green queries once had wrong, and resamplers against plain loops."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import text as X
from pixelloom.operators import resample as R
from pixelloom.queries import neighbourhoods as N
from pixelloom.sources import codecs as C
from pixelloom.sources import records as S


def test_png_round_trip_and_filters():
    draw = np.random.default_rng(1)
    for shape in ((3, 5), (4, 2, 2), (5, 7, 3), (1, 1, 4)):
        image = draw.integers(0, 256, shape, dtype=np.uint8)
        assert (C.png_pixels(C.png(image)).reshape(shape) == image).all()
        assert C.png_size(C.png(image)) == (shape[1], shape[0])
    image = draw.integers(0, 256, (5, 6, 3), dtype=np.uint8).astype(int)
    rows = []
    for y in range(5):  # each row by another filter, as the format defines them
        line = []
        for x in range(6):
            for c in range(3):
                a, b, d = (image[y, x - 1, c] if x else 0), (image[y - 1, x, c] if y else 0), (image[y - 1, x - 1, c] if x and y else 0)
                p = a + b - d
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                line.append((image[y, x, c] - (0, a, b, (a + b) // 2, paeth)[y]) % 256)
        rows.append(bytes([y, *line]))
    raw = C.PNG + C._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + C._chunk(b"IDAT", zlib.compress(b"".join(rows))) + C._chunk(b"IEND", b"")
    assert (C.png_pixels(raw) == image).all()
    with pytest.raises(ValueError):
        C.canonical(raw, 29)
    with pytest.raises(ValueError):
        C.png_metadata(raw[:50])
    assert C.png_metadata(raw) == (8, 2, C.UNPROFILED)


def test_codes_and_tensors():
    assert C.codes(np.array([0.0, 0.5 / 255, 1.0, 2.0, -1.0, np.nan, np.inf])).tolist() == [0, 1, 255, 255, 0, 0, 0]
    assert C.floats(struct.pack("<2f", 1.5, -2), 2).tolist() == [1.5, -2]
    with pytest.raises(ValueError):
        C.floats(b"\0" * 7, 2)
    assert C.read_record(b"x") is None


def test_opset_of_a_graph_file():
    def field(n, value):
        if isinstance(value, int):
            return bytes([n << 3]) + (bytes([value]) if value < 128 else bytes([value & 127 | 128, value >> 7]))
        return bytes([n << 3 | 2, len(value)]) + value

    graph = field(1, 300) + field(7, b"graph") + field(8, field(1, b"other") + field(2, 3)) + field(8, field(2, 17))
    assert C.declared_opset(graph) == 17
    assert C.declared_opset(field(8, field(1, b"ai.onnx") + field(2, 200))) == 200
    assert C.declared_opset(field(8, field(1, b"x"))) is None and C.declared_opset(graph[:-1]) is None and C.declared_opset(b"") is None
    assert C.varint(b"\xac\x02", 0) == (300, 2) and C.varint(b"\x80", 0) is None


def test_image_files_are_scanned(spark, tmp_path):
    draw = np.random.default_rng(2)
    images = {k: draw.integers(0, 256, (3 + k, 4, 4), dtype=np.uint8) for k in range(3)}
    for k, v in images.items():
        (tmp_path / f"{k}.png").write_bytes(C.png(v))
    folder = f"file://{tmp_path}"
    assert sorted((r["width"], r["height"]) for r in S.image_sizes(spark, folder).collect()) == [(4, 3), (4, 4), (4, 5)]
    for r in S.images(spark, folder, 20).collect():
        want = images[int(r["path"][-5])]
        assert np.allclose(np.array(r["rgb"]).reshape(r["height"], 4, 3), want[..., :3] / 255) and np.allclose(np.array(r["alpha"]).reshape(-1, 4), want[..., 3] / 255)
    with pytest.raises(Exception, match="over the limit"):
        S.images(spark, folder, 19).collect()
    assert {r["length"] for r in S.file_hashes(spark, folder).collect()} == {len(C.png(v)) for v in images.values()}


def test_record_lines_are_strict(spark, tmp_path):
    good = '{"id":"a","input":"i","target":"t","challenge":"c","split":"tune","duplicate_group":"g","fractional_alpha_reported":0.5}'
    (tmp_path / "a.jsonl").write_text(good + "\n\n" + good.replace('"a"', '"b"') + "\n")
    assert [r["id"] for r in S.read_lines(spark, f"file://{tmp_path}/a.jsonl", S.ARENA).collect()] == ["a", "b"]
    for bad in (good[:-1] + ',"more":1}', good.replace('"split":"tune",', ""), good + "}{", good + "," + good, "[]", "null", "{"):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception, match="not a record"):
            S.read_lines(spark, f"file://{tmp_path}/b.jsonl", S.ARENA).collect()


@pytest.mark.parametrize(("v", "date", "sha"), [("2024-02-31", True, False), ("2024-13-01", False, False), ("2024-01-01T", False, False), ("2024-01-01Tx\ny", True, False), ("2024-01-01\n", False, False), ("a" * 64, False, True), ("a" * 64 + "\n", False, False), ("A" * 64, False, False), (None, False, False)])
def test_shapes_of_dates_and_hashes(spark, v, date, sha):
    got = spark.range(1).select(X.is_iso_date_shape(F.lit(v).cast("string")).alias("d"), X.is_sha256_hex(F.lit(v).cast("string")).alias("s")).first()
    assert (got["d"], got["s"]) == (date, sha)


def test_tiles_overlap_to_the_left():
    u = np.zeros((9, 30))
    u[0, 3] = u[8, 25] = 0.28
    # The padded box is x 1..28, y 0..9: rows of 8 and 1; the first tile ends at 11, later ones start 2 earlier.
    assert N.tiles_of(u) == [(1, 0, 10, 8), (9, 0, 12, 8), (19, 0, 9, 8), (1, 8, 10, 1), (9, 8, 12, 1), (19, 8, 9, 1)]
    assert N.tiles_of(u - 1) == [] and N.topology_risk(u) == 0


def plain_fixed(row, name, target):
    weight = {"bilinear": lambda d: max(0, 1 - abs(d)), "lanczos": lambda d: 0 if abs(d) >= 3 else 1 if d == 0 else math.sin(math.pi * d) / (math.pi * d) * math.sin(math.pi * d / 3) / (math.pi * d / 3)}[name]
    reach, scale = {"bilinear": 1, "lanczos": 3}[name], len(row) / target
    wide, out = max(1, scale), []
    for i in range(target):
        c = (i + 0.5) * scale
        places = range(max(0, int(c - reach * wide + 0.5)), min(len(row), int(c + reach * wide + 0.5)))
        w = [weight((s - c + 0.5) / wide) for s in places]
        fixed = [math.floor(x / sum(w) * 2**22 + 0.5) if x >= 0 else math.ceil(x / sum(w) * 2**22 - 0.5) for x in w]
        out.append(min(255, max(0, (2**21 + sum(k * row[s] for k, s in zip(fixed, places, strict=True))) >> 22)))
    return out


@pytest.mark.parametrize("name", ["bilinear", "lanczos"])
def test_fixed_point_passes(name):
    image = np.random.default_rng(3).integers(0, 256, (6, 9), dtype=np.uint8)
    for h, w in ((4, 13), (11, 5), (6, 9)):
        across = [plain_fixed(list(map(int, r)), name, w) for r in image]
        down = np.array([plain_fixed([r[x] for r in across], name, h) for x in range(w)]).T
        assert (R.resized_u8(image, name, h, w) == down).all()


def test_real_resamplers_keep_constants_and_zero_beyond():
    flat = np.full((5, 7), 0.25)
    for taps in (R.lanczos4_taps, R.linear_taps, lambda s, t: R.area_taps("bicubic", s, t)):
        assert np.allclose(R.resized(flat, taps, 9, 3), 0.25)
    assert R.bilinear_zero(flat, np.array([-1.0, 0.0, 4.5]), np.array([0.0, 6.5, 0.0])).tolist() == [0.0, 0.125, 0.125]
    assert R.resized_nearest(np.arange(8)[None], 1, 3, True).tolist() == [[1, 4, 6]]
