import pytest

from gradus.sources import files

from .conftest import plan


def write(spark, path, kind, width, height, grey=False):
    """An image made by the JVM's own writer."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if grey else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(spark, tmp_path / "rgb.jpg", "jpg", 448, 300)
    write(spark, tmp_path / "sub" / "grey.jpg", "jpg", 31, 7, True)
    write(spark, tmp_path / "rgb.png", "png", 20, 300)
    write(spark, tmp_path / "grey.png", "png", 9, 10, True)
    raw = (tmp_path / "rgb.jpg").read_bytes()
    (tmp_path / "cut.jpg").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "cut.png").write_bytes((tmp_path / "rgb.png").read_bytes()[:60])
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "text.jpg").write_bytes(b"no image at all")
    (tmp_path / "start.jpg").write_bytes(b"\xff\xd8\xff")
    # comments, fill bytes and a marker without a length before the rest; many segments
    (tmp_path / "long.jpg").write_bytes(raw[:2] + b"\xff\xfe\x00\x06abcd" + b"\xff\xff\xff\xfe\x00\x02" + b"\xff\x01" + raw[2:])
    (tmp_path / "many.jpg").write_bytes(raw[:2] + b"\xff\xfe\x00\x03x" * 500 + raw[2:])
    (tmp_path / "beyond.jpg").write_bytes(raw[:2] + b"\xff\xfe\xff\xffx" + raw[2:])
    return tmp_path


def test_headers(spark, folder):
    df = files.read_images(spark, str(folder))
    assert plan(df).count("FileScan") == 1 and "Join" not in plan(df)
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["channels"], r["is_jpeg"]) for r in df.collect()}
    assert got == {
        "rgb.jpg": (448, 300, 3, True), "grey.jpg": (31, 7, 1, True), "rgb.png": (20, 300, 3, False), "grey.png": (9, 10, 1, False),
        "cut.jpg": (-1, -1, -1, True), "cut.png": (-1, -1, -1, False), "text.jpg": (-1, -1, -1, False), "start.jpg": (-1, -1, -1, True),
        "long.jpg": (448, 300, 3, True), "many.jpg": (448, 300, 3, True), "beyond.jpg": (-1, -1, -1, True),
    }


def test_as_the_decoder_sees_them(spark, folder):
    seen = spark.read.format("image").option("recursiveFileLookup", "true").load(str(folder)).select("image.origin", "image.width", "image.height", "image.nChannels").where("width > 0").collect()
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["channels"]) for r in files.read_images(spark, str(folder)).collect()}
    whole = {r[0].rsplit("/", 1)[1]: tuple(r)[1:] for r in seen}
    for name in ("rgb.jpg", "grey.jpg", "rgb.png", "grey.png", "long.jpg", "many.jpg"):
        assert got[name] == whole[name]
