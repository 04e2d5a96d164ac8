import io
import random
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.sources import pieces, sinks


def test_archives_are_whole_and_begin_with_the_stored_mimetype(spark, tmp_path):
    rng = random.Random(1)
    rows = [(b, f"é{i:03}.xhtml", bytes(rng.choices(b"abc <p>", k=rng.randint(0, 3000)))) for b in ("x", "y") for i in range(40)] + [("x", "empty", None)]
    files = spark.createDataFrame(rows, "book_id string, name string, content binary").repartition(5)
    done = pieces.save(pieces.epub_pieces(files), f"file://{tmp_path}/books", F.concat("book_id", F.lit(".epub")), "book_id").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in done) == ["x.epub", "y.epub"]
    values = {r.book_id: bytes(r.epub) for r in sinks.archives(files).collect()}
    for r in done:
        book = r.path[-6]
        data = open(r.path, "rb").read()
        assert data == values[book] and len(data) == r.bytes and r.pieces > 80
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            assert archive.testzip() is None
            names = archive.namelist()
            assert names[:2] == ["mimetype", "META-INF/container.xml"] and names[2:] == sorted(f"OEBPS/{n}" for b, n, _ in rows if b == book)
            assert archive.infolist()[0].compress_type == zipfile.ZIP_STORED and archive.read("mimetype") == b"application/epub+zip" and data[30:58] == b"mimetypeapplication/epub+zip"
            assert {n: archive.read(f"OEBPS/{n}") for b, n, _ in rows if b == book} == {n: c or b"" for b, n, c in rows if b == book}


def test_a_wave_file_is_joined_from_clips(spark, tmp_path):
    rng = np.random.default_rng(2)
    clips = [("c", p, rng.uniform(-1.2, 1.2, int(rng.integers(0, 500))).tolist(), 8000) for p in range(30)]
    df = spark.createDataFrame(clips, "ch string, pos int, samples array<double>, rate int").repartition(4)
    pieces.save(pieces.wav_pieces(df, "ch"), str(tmp_path / "audio"), F.concat("ch", F.lit(".wav")), "ch").collect()
    with wave.open(str(tmp_path / "audio" / "c.wav")) as file:
        assert (file.getframerate(), file.getnchannels(), file.getsampwidth()) == (8000, 1, 2)
        got = np.frombuffer(file.readframes(file.getnframes()), "<i2")
    assert got.tolist() == (np.clip(np.concatenate([c[2] for c in clips]), -1, 1) * 32767).round().astype(int).tolist()
    with pytest.raises(Exception, match="sample rates differ"):
        pieces.wav_pieces(df.withColumn("rate", F.col("pos")), "ch").collect()


def test_a_missing_piece_is_told(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, b"xy"), ("a", 3, b"z")], "k string, begin long, bytes binary")
    with pytest.raises(Exception, match="missing before byte 3"):
        pieces.save(df, str(tmp_path / "f"), F.col("k"), "k").collect()
