import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumisync.functions.geometry import crop_box, resized
from lumisync.operators.embed import embed
from lumisync.operators.encoders import Encoder, GridImageEncoder, OnnxEncoder
from lumisync.operators.tensor import IMAGE_MEAN, IMAGE_STD, TensorSpec, image_tensor, tensors
from lumisync.plans.fixtures import encode_png
from lumisync.sources import images as I
from lumisync.sources.images import read_images, rgb_of


def noise(height, width, channels=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, channels), dtype=np.uint8)


def filtered_png(pixels, color, modes):
    """A PNG whose lines use the given filters, written the long way."""
    height, width, bpp = pixels.shape
    flat = pixels.reshape(height, -1).astype(int)
    body = b""
    for y in range(height):
        mode, line = modes[y % len(modes)], []
        for x in range(flat.shape[1]):
            left = flat[y, x - bpp] if x >= bpp else 0
            up = flat[y - 1, x] if y else 0
            corner = flat[y - 1, x - bpp] if y and x >= bpp else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= min(abs(p - up), abs(p - corner)) else up if abs(p - up) <= abs(p - corner) else corner
            guess = (0, left, up, (left + up) // 2, paeth)[mode]
            line.append((flat[y, x] - guess) % 256)
        body += bytes([mode, *line])

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def decoded(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_images(spark, str(folder)).collect()}
    return {n: None if r.error else np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for n, r in rows.items()}


def write_image(spark, path, pixels, kind, image_type=5):
    """A file of another format by the codecs of the JVM; 5 is 8-bit BGR, 13 a palette."""
    height, width = pixels.shape[:2]
    image = spark._jvm.java.awt.image.BufferedImage(width, height, image_type)
    for y in range(height):
        for x in range(width):
            r, g, b = map(int, pixels[y, x])
            image.setRGB(x, y, (r << 16) + (g << 8) + b - (1 << 24))
    assert spark._jvm.javax.imageio.ImageIO.write(image, kind, spark._jvm.java.io.File(str(path)))


def deep_png(pixels):
    """16 bits for each of three channels; the low bytes are noise."""
    height, width, _ = pixels.shape
    body = b"".join(b"\0" + bytes(v for p in line.reshape(-1).tolist() for v in (p, p ^ 85)) for line in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 16, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_filters(spark, tmp_path):
    want = {}
    for color, channels in [(0, 1), (2, 3), (4, 2), (6, 4)]:
        for i, modes in enumerate([[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]]):
            pixels, name = noise(7, 5, channels, i), f"{color}-{i}.png"
            (tmp_path / name).write_bytes(filtered_png(pixels, color, modes))
            want[name] = np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]
    got = decoded(spark, tmp_path)
    assert got.keys() == want.keys() and all((got[n] == want[n]).all() for n in want)


def test_other_formats(spark, tmp_path):
    y, x = np.mgrid[:24, :32]
    smooth = np.stack([y * 9, x * 7, 255 - y * 5], axis=2).astype(np.uint8)
    few = np.where((y + x)[:, :, None] % 2, np.array([255, 0, 0]), np.array([0, 0, 255])).astype(np.uint8)
    write_image(spark, tmp_path / "a.bmp", smooth, "bmp")
    write_image(spark, tmp_path / "a.jpg", smooth, "jpg")
    write_image(spark, tmp_path / "a.gif", few, "gif", 13)
    write_image(spark, tmp_path / "a.tif", smooth, "tiff")
    (tmp_path / "deep.png").write_bytes(deep_png(smooth))
    (tmp_path / "bad.png").write_bytes(b"nope")
    got = decoded(spark, tmp_path)
    assert got.pop("bad.png") is None
    assert (got["a.bmp"] == smooth).all() and (got["a.tif"] == smooth).all() and (got["a.gif"] == few).all()
    assert np.abs(got["deep.png"].astype(int) - smooth).max() <= 1
    assert np.abs(got["a.jpg"].astype(int) - smooth).mean() < 4


@pytest.mark.parametrize("wave_files", [100, 3])
def test_only_the_files_of_the_rows_are_read(spark, tmp_path, monkeypatch, wave_files):
    monkeypatch.setattr(I, "WAVE_FILES", wave_files)
    names = ["plain.png", "sp ace.png", "100%25+1.png", "a[b]{c}.png", "st*r.png", "b\\s.png", "\u00fc.png", "k=v.png", "#?.png"]
    (tmp_path / "sub").mkdir()
    pixels = {n: noise(4, 5, 3, i) for i, n in enumerate(names)}
    for n, p in pixels.items():
        (tmp_path / n).write_bytes(encode_png(p))
        (tmp_path / "sub" / n).write_bytes(b"not one of the rows, and no image")
    (tmp_path / "bad.png").write_bytes(b"nope")
    rows = [(str(tmp_path / n), i) for i, n in enumerate([*names, "bad.png", "gone.png", "plain.png"])] + [(None, 99)]
    frame = spark.createDataFrame(rows, "path string, n long")
    spec = TensorSpec(resize=False, crop=4, normalize=False)
    got = embed(frame, "path", GridImageEncoder(4, spec, unit=False)).collect()
    assert sorted((r.path or "", r.n) for r in got) == sorted((p or "", n) for p, n in rows)
    for r in got:
        name = r.path and r.path.rsplit("/", 1)[1]
        if name in pixels:
            want = image_tensor(pixels[name], spec).astype(float).reshape(-1)
            assert r.error is None and r.vector == pytest.approx(want.tolist(), abs=1e-6)
        else:
            assert not any(r.vector) and {"bad.png": "not a readable", "gone.png": "no such file", None: "no path"}[name] in r.error
    assert embed(frame.limit(0), "path", GridImageEncoder(4, spec)).collect() == []


def test_rows_of_the_image_source_are_encoded_directly(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(encode_png(noise(8, 8)))
    spec = TensorSpec(size=8, crop=8)
    images = spark.read.format("image").load(f"file://{tmp_path}")
    direct = embed(images, "image", GridImageEncoder(2, spec)).first().vector
    by_path = embed(spark.createDataFrame([(str(tmp_path / "a.png"),)], "path string"), "path", GridImageEncoder(2, spec))
    assert direct == by_path.first().vector and len(direct) == 12


def slow_resize(pixels, size):
    height, width = pixels.shape[:2]
    short, long = min(height, width), max(height, width)
    new = int(size * long / short)
    out_h, out_w = (new, size) if width <= height else (size, new)

    def kernel(x):
        x = abs(x)
        if x < 1:
            return 1.5 * x**3 - 2.5 * x**2 + 1
        return -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def along(line, n_out):
        n_in = len(line)
        scale = n_in / n_out
        out = []
        for o in range(n_out):
            center, stretch = (o + 0.5) * scale, max(scale, 1.0)
            w = [kernel((i + 0.5 - center) / stretch) for i in range(n_in)]
            out.append(min(255, max(0, int(np.floor(sum(a * b for a, b in zip(w, line)) / sum(w) + 0.5)))))
        return out
    across = np.array([[along(pixels[y, :, c], out_w) for c in range(3)] for y in range(height)]).transpose(0, 2, 1)
    down = np.array([[along(across[:, x, c], out_h) for c in range(3)] for x in range(out_w)])
    return down.transpose(2, 0, 1)


@pytest.mark.parametrize("shape", [(13, 17), (17, 13), (5, 9), (8, 20), (8, 8)])
def test_tensor_equals_the_long_way(shape):
    pixels = noise(*shape)
    spec = TensorSpec(size=8, crop=6)
    resampled = pixels if min(shape) == 8 else slow_resize(pixels, 8)
    top, left = (resampled.shape[0] - 6) // 2, (resampled.shape[1] - 6) // 2
    want = (resampled[top:top + 6, left:left + 6] / 255 - np.array(IMAGE_MEAN)) / np.array(IMAGE_STD)
    got = image_tensor(pixels, spec)
    assert got.dtype == np.float32 and np.abs(got - want).max() < 0.02
    assert np.mean(np.abs(got - want) > 1e-5) < 0.02  # a rounding tie at most


def test_each_step_can_be_left_out():
    pixels = noise(10, 12)
    raw = image_tensor(pixels, TensorSpec(resize=False, center_crop=False, normalize=False))
    assert raw.shape == (10, 12, 3) and np.allclose(raw, pixels / 255)
    padded = image_tensor(pixels, TensorSpec(resize=False, crop=14, normalize=False))
    assert padded.shape == (14, 14, 3) and not padded[:2].any() and np.allclose(padded[2:12, 1:13], pixels / 255)
    with pytest.raises(ValueError):
        TensorSpec(crop=7)
    with pytest.raises(ValueError):
        crop_box(F.lit(1), F.lit(1), 7, 8)


def test_default_size(spark):
    rgb = noise(300, 400)
    rows = spark.createDataFrame([("a", 300, 400, bytearray(rgb.tobytes()), None), ("b", None, None, None, "bad")],
                                 "path string, height int, width int, rgb binary, error string")
    got = {r.path: r for r in tensors(rows).collect()}
    assert len(got["a"].tensor) == 224 * 224 * 3 and got["a"].error is None
    assert got["b"].tensor is None and got["b"].error == "bad"


@pytest.mark.parametrize("w,h,want", [(224, 500, (224, 500)), (100, 200, (224, 448)), (300, 200, (336, 224)),
                                      (3, 1000, (224, 74666)), (333, 500, (224, 336))])
def test_geometry(spark, w, h, want):
    row = spark.range(1).select(*resized(F.lit(w), F.lit(h))).first()
    assert tuple(row) == want


def test_crop_box_of_a_small_image(spark):
    box = crop_box(F.lit(225), F.lit(101))
    row = spark.range(1).select(*[c.alias(n) for n, c in box.items()]).first().asDict()
    assert row == {"left": 0, "top": -62, "right": 224, "bottom": 162}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


class Flaky(Encoder):
    dim, batch_rows = 2, 3

    def open(self):
        self.opened = True

    def load(self, value):
        if value % 4 == 1:
            raise RuntimeError(f"no {value}")
        return value

    def encode(self, items):
        assert self.opened
        return np.array([[i, 1] for i in items])


def test_failures_stay_with_their_row(spark):
    rows = {r.id: r for r in embed(spark.range(20).repartition(3), "id", Flaky()).collect()}
    assert len(rows) == 20
    for i, row in rows.items():
        if i % 4 == 1:
            assert row.vector == [0, 0] and row.error == f"RuntimeError: no {i}"
        else:
            assert row.vector == [i, 1] and row.error is None


def test_grid_encoder(spark, tmp_path):
    pixels = noise(8, 8)
    (tmp_path / "a.png").write_bytes(encode_png(pixels))
    spec = TensorSpec(size=8, crop=8)
    tensor = image_tensor(pixels, spec).astype(float)
    want = tensor.reshape(2, 4, 2, 4, 3).mean(axis=(1, 3)).reshape(-1)
    rows = spark.createDataFrame([(str(tmp_path / "a.png"),)], "path string")
    plain = embed(rows, "path", GridImageEncoder(2, spec, unit=False)).first().vector
    assert plain == pytest.approx(want.tolist(), abs=1e-5)
    unit = embed(rows, "path", GridImageEncoder(2, spec)).first().vector
    assert unit == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-5)


def field(number, payload):
    """One protobuf field: an int or bytes."""
    if isinstance(payload, int):
        return bytes([number << 3, payload])
    return bytes([number << 3 | 2, len(payload)]) + payload


def identity_model(dim):
    def value(name):
        shape = field(1, field(2, b"n")) + field(1, field(1, dim))
        tensor = field(1, field(1, 1) + field(2, shape))
        return field(1, name) + field(2, tensor)
    node = field(1, b"x") + field(2, b"y") + field(4, b"Identity")
    graph = field(1, node) + field(2, b"g") + field(11, value(b"x")) + field(12, value(b"y"))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_model_file_encoder(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    model = tmp_path / "identity.onnx"
    model.write_bytes(identity_model(3))
    encoder = OnnxEncoder(str(model), 3, lambda v: np.array([v, 0, 4], np.float32))
    rows = spark.range(3, 5).withColumn("id", F.col("id").cast("double"))
    got = {r.id: r.vector for r in embed(rows, "id", encoder).collect()}
    assert got[3.0] == pytest.approx([0.6, 0, 0.8])


def test_pixels_become_rgb_a_few_pictures_at_a_time(monkeypatch):
    monkeypatch.setattr(I, "STEP_BYTES", 100)
    sizes = [1, 3, 2, 9, None, 1, 1, 1]  # lines of 4 pixels, three bytes each
    rows = [{"path": f"/{i}", "height": n or -1, "width": 4, "nChannels": 3, "data": n and bytes(range(12 * n))}
            for i, n in enumerate(sizes)]
    types = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()),
                       ("data", pa.binary())])
    parts = list(I._to_rgb([pa.RecordBatch.from_pylist(rows, schema=types), pa.RecordBatch.from_pylist([], schema=types)]))
    for part in parts:
        assert part.num_rows <= 1 or sum(len(x) for x in part.column("rgb").to_pylist() if x) <= 100
    got = [row for part in parts for row in part.to_pylist()]
    assert [r["path"] for r in got] == [r["path"] for r in rows]
    assert [r["rgb"] and len(r["rgb"]) for r in got] == [n and 12 * n for n in sizes]
    assert len(parts) > 2


def test_a_task_draws_and_writes_a_few_files_at_a_time(spark, monkeypatch, tmp_path):
    from lumisync.plans import fixtures
    seen = []
    monkeypatch.setattr(fixtures, "FILES_PER_STEP", 3)
    monkeypatch.setattr(fixtures, "map_arrow", lambda rows, task, schema: seen.append(task) or rows)
    monkeypatch.setattr(fixtures, "write_files", lambda rows: "")
    spark.range(10).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    fixtures.wide_image_files(spark, str(tmp_path))
    keys = pa.RecordBatch.from_pylist([{"s_suppkey": k, "bad": False} for k in range(10)])
    parts = list(seen[0]([keys]))
    assert [p.num_rows for p in parts] == [3, 3, 3, 1]
    assert [r["rel"] for p in parts for r in p.to_pylist()] == [f"{k}.png" for k in range(10)]
