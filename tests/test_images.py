import gzip

import numpy as np
import pytest

from ozalid.functions import enhance, features, pixels, planes
from ozalid.sources import formats, images

RNG = np.random.default_rng(5)


def test_gray_and_hsv():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128], [255, 255, 255]]], np.uint8)
    assert pixels.gray(rgb).tolist() == [[76, 150, 29, 128, 255]]
    assert pixels.hsv(rgb)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 128], [0, 0, 255]]


def test_convolution_by_hand():
    plane = RNG.integers(0, 255, (5, 6)).astype(float)
    wide = np.pad(plane, 1, mode="reflect")
    kernel = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])
    want = [[(wide[y : y + 3, x : x + 3] * kernel).sum() for x in range(6)] for y in range(5)]
    assert np.allclose(pixels.laplacian(plane), want)


def test_resize():
    plane = np.arange(16, dtype=np.uint8).reshape(4, 4) * 10
    assert pixels.resize(plane, 2, 2).tolist() == [[25, 45], [105, 125]]
    for how in ("area", "lanczos"):
        assert (pixels.resize(np.full((7, 5, 3), 90, np.uint8), 12, 31, how) == 90).all()


@pytest.mark.parametrize(("size", "want"), [((1, 1), (256, 256)), ((256, 256), (256, 256)), ((2048, 2048), (1024, 1024)), ((0, 5), (0, 5)), ((100, 4000), (100, 4000))])
def test_bounded_size(size, want):
    assert pixels.bounded_size(*size) == want


def test_padding_and_morphology():
    p = pixels.padded(np.full((10, 20), 9, np.uint8), 40)
    assert p.shape == (40, 40) and p[:10].max() == 0 and p[20, 20] == 9
    dot = np.zeros((9, 9), np.uint8)
    dot[4, 4] = 200
    assert (pixels.dilate(dot, pixels.disc(3)) > 0).sum() == pixels.disc(3).sum()
    line = np.full((20, 20), 200, np.uint8)
    line[:, 10] = 10
    assert (pixels.black_hat(line, 9)[:, 10] == 190).all()


def test_filling_takes_from_around():
    rgb = np.full((12, 12, 3), 60, np.uint8)
    mask = np.zeros((12, 12), bool)
    mask[4:8, 4:8] = True
    rgb[mask] = 255
    assert (pixels.fill_in(rgb, mask) == 60).all()


def test_to_rgb_modes():
    alpha = np.zeros((2, 2, 4), np.uint8)
    assert (enhance.to_rgb(alpha) == 255).all()
    ramp = np.arange(400, dtype=np.uint16).reshape(20, 20) * 100
    out = enhance.to_rgb(ramp)
    assert out.min() == 0 and out.max() == 255 and out.shape == (20, 20, 3)
    assert (enhance.to_rgb(np.full((3, 3), 7, np.uint16)) == 0).all()
    same = RNG.integers(0, 255, (4, 4, 3)).astype(np.uint8)
    assert enhance.to_rgb(same) is same or (enhance.to_rgb(same) == same).all()


def test_features_of_plain_images():
    black = np.zeros((60, 60, 3), np.uint8)
    f = features.measure(black)
    assert f["border_darkness"] == 1.0 and f["hue_entropy"] == 0.0 and f["saturation_mean"] == 0.0 and not f["has_vignette"]
    fundus = black.copy()
    y, x = np.mgrid[:60, :60]
    fundus[(y - 30) ** 2 + (x - 30) ** 2 < 25**2] = (200, 60, 30)
    g = features.measure(fundus)
    assert g["has_vignette"] and g["skin_red_fraction"] == 1.0
    assert features.subtype("macroscopic", fundus, "gross_pathology") == "fundus"
    assert features.subtype("microscopy", fundus, "histopathology") == "histopathology"


@pytest.mark.parametrize("stream", ["radiology", "macroscopic", "microscopy", "ultrasound", None])
def test_preprocess_gives_rgb(stream):
    rgb = RNG.integers(0, 255, (70, 90, 3)).astype(np.uint8)
    out = enhance.preprocess(rgb, stream, None, {"fill_hair": True, "diffuse": True})
    assert out.dtype == np.uint8 and out.ndim == 3 and out.shape[2] == 3
    if stream == "radiology":
        assert out.shape == (896, 896, 3)


def test_constant_image_everywhere():
    flat = np.full((300, 300, 3), 128, np.uint8)
    for s in enhance.STREAM_KERNELS:
        enhance.preprocess(flat, s, "oct" if s == "ultrasound" else None)
    assert (enhance.stain_normalised(np.full((20, 20, 3), 250, np.uint8)) == 250).all()


def test_equalisation_of_a_ramp_keeps_order():
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[None, :], 64, 0)
    out = enhance.equalised(ramp, 40.0, 1)
    assert (np.diff(out[0].astype(int)) >= 0).all() and out.max() > 200


def test_stain_normalisation_reaches_the_reference():
    stains = enhance.STAINS @ (RNG.random((2, 4096)) * np.array([[1.2], [0.7]]))
    rgb = np.clip(255 * 10**-stains, 0, 255).T.reshape(64, 64, 3).astype(np.uint8)
    out = enhance.stain_normalised(rgb)
    assert out.shape == rgb.shape and out.std() > 5


def test_tile_and_region():
    white = np.full((1024, 1024, 3), 255, np.uint8)
    white[600:900, 600:900] = 100
    assert (enhance.fullest_tile(white) < 200).any()
    dark = np.zeros((100, 100, 3), np.uint8)
    dark[20:80, 30:90] = 90
    assert enhance.region(dark).shape == (60, 60, 3)
    dark[:] = 0
    dark[50, 50] = 90
    assert enhance.region(dark).shape == (100, 100, 3)


def test_slices():
    assert planes.best_slices(np.zeros((4, 4, 2))) == [0, 1]
    v = np.zeros((16, 16, 40))
    for i in (10, 11, 30):
        v[..., i] = RNG.random((16, 16)) * 100
    assert {10, 30} < set(planes.best_slices(v)) | {11} and min(np.diff(planes.best_slices(v))) >= 4
    assert planes.spread_out([5, 6, 7, 0], 40, 3) == [0, 5, 6]
    assert planes.representative(v).shape == (16, 48, 3)
    with pytest.raises(ValueError):
        planes.representative(np.zeros((4, 4, 0)))


def test_channel_grid():
    g = planes.channel_grid({"red": np.full((8, 8), 200, np.uint8)})
    assert g.shape == (908, 908, 3) and (g[4:452, 4:452] == 40).all() and (g[456:904, 4:452] == 200).all()


@pytest.mark.parametrize("image", [RNG.integers(0, 255, (7, 5)).astype(np.uint8), RNG.integers(0, 255, (6, 9, 3)).astype(np.uint8), RNG.integers(0, 255, (6, 9, 4)).astype(np.uint8), RNG.integers(0, 65535, (6, 3)).astype(np.uint16)])
def test_png_round_trip(image):
    assert (formats.read_png(formats.write_png(image)) == image).all()


def test_png_filters_and_junk():
    import struct
    import zlib

    image = RNG.integers(0, 255, (5, 4, 3)).astype(np.uint8)
    flat, rows, prior = image.reshape(5, -1).astype(int), b"", np.zeros(12, int)
    for kind, line in enumerate(flat):
        left = np.concatenate([[0] * 3, line[:-3]])
        corner = np.concatenate([[0] * 3, prior[:-3]])
        p = left + prior - corner
        da, db, dc = abs(p - left), abs(p - prior), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, prior, corner))
        guess = [0 * line, left, prior, (left + prior) // 2, paeth][kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        prior = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    data = formats._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (formats.read_png(data) == image).all()
    for junk in (b"", b"junk", formats._PNG + b"\0" * 20):
        with pytest.raises(formats.DecodeError):
            formats.read_png(junk)


def test_nifti():
    v = RNG.random((3, 4, 5)).astype(np.float32)
    assert (formats.read_nifti(formats.write_nifti(v)) == v).all()
    assert (formats.read_nifti(gzip.compress(formats.write_nifti(v))) == v).all()
    flipped = np.array([[0, 1.0, 0], [-1.0, 0, 0], [0, 0, 1]])
    want = np.transpose(v, (1, 0, 2))[:, ::-1]
    assert (formats.read_nifti(formats.write_nifti(v, flipped)) == want).all()
    assert formats.read_nifti(formats.write_nifti(v[:, :, 0])).shape == (3, 4, 1)
    four = np.stack([v, v + 1], axis=-1)
    assert (formats.read_nifti(formats.write_nifti(four)) == v).all()
    for bad in (formats.write_nifti(np.zeros((2, 2, 0), np.float32)), formats.write_nifti(np.zeros((1, 2, 2, 2, 2), np.float32)), b"\0" * 400):
        with pytest.raises(formats.DecodeError):
            formats.read_nifti(bad)


def test_dicom():
    p = RNG.integers(0, 4000, (6, 5)).astype(np.uint16)
    d = formats.read_dicom(formats.write_dicom(p, number=4, z=1.5, slope=0, intercept=-3))
    assert (d["pixels"] == p).all() and (d["number"], d["z"], d["slope"], d["intercept"], d["inverse"]) == (4.0, 1.5, 0.0, -3.0, False)
    assert (images.corrected(d) == p.astype(np.float32) - 3).all()
    inverse = images.corrected(formats.read_dicom(formats.write_dicom(p, "MONOCHROME1")))
    assert (inverse == p.max() + p.min() - p.astype(np.float32)).all()
    colour = RNG.integers(0, 255, (3, 4, 5, 3)).astype(np.uint8)
    assert (images.dicom_picture(formats.write_dicom(colour, "RGB")) == colour[1]).all()
    with pytest.raises(formats.DecodeError):
        formats.read_dicom(b"\0" * 128 + b"DICM" + b"\0" * 40)


def test_series():
    slices = [np.full((4, 4), 100 * n, np.uint16) + np.arange(4, dtype=np.uint16) for n in range(5)]
    parts = [(f"f{n}", formats.write_dicom(s, number=9 - n)) for n, s in enumerate(slices)] + [("junk", b"x"), ("scout", formats.write_dicom(np.zeros((2, 2), np.uint16), number=1))]
    assert images.series_picture(parts).shape == (4, 12, 3)
    with pytest.raises(formats.DecodeError):
        images.series_picture([("a", b"x")])


def test_stain_file(tmp_path):
    assert (enhance.load_stains(str(tmp_path / "none.npy")) == enhance.STAINS).all()
    np.save(tmp_path / "bad.npy", np.ones((2, 2)))
    assert (enhance.load_stains(str(tmp_path / "bad.npy")) == enhance.STAINS).all()
    np.save(tmp_path / "own.npy", np.ones((3, 2)))
    assert (enhance.load_stains(str(tmp_path / "own.npy")) == 1).all()
