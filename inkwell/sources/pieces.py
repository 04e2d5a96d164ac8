"""Large files as tables of pieces: each piece has its place in the file, so no task and no row holds a whole one.

Places come from sums over pieces in two levels. ZIP archives are packed entry by entry; the directory at the end is
made of pieces too, from a slim table. Files are written by one task each, which holds one piece at a time.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import ranks
from inkwell.sources import scratch

# Fixed values of the ZIP format: 1980-01-01, and what its 32-bit and 16-bit fields can hold.
_DATE, _MOST_BYTES, _MOST_ENTRIES = 0x21, 0xFFFFFFFF, 0xFFFF
MIMETYPE = "application/epub+zip"
CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def _packed(stored: Column, name: Column, content: Column) -> Column:
    """struct(crc, size, record, entry): an entry's local record, and its part of the directory but for its place."""
    import pandas as pd

    @F.pandas_udf("struct<crc:long,size:long,record:binary,entry:binary>")
    def pack(stored: pd.Series, name: pd.Series, content: pd.Series) -> pd.DataFrame:
        import struct
        import zlib

        rows = []
        for keep, title, data in zip(stored, name, content):
            title, data = title.encode(), bytes(data or b"")
            body = data
            if not keep:
                deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
                body = deflate.compress(data) + deflate.flush()
            head = struct.pack("<5H3I2H", 20, 0x800, 0 if keep else 8, 0, _DATE, zlib.crc32(data), len(body), len(data), len(title), 0)
            rows.append((zlib.crc32(data), len(data), b"PK\3\4" + head + title + body, b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<3H2I", 0, 0, 0, 0, 0)))
        return pd.DataFrame(rows, columns=["crc", "size", "record", "entry"])

    return pack(stored, name, content)


def _little(value: Column, width: int) -> Column:
    """A number as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.lpad(F.hex(F.expr("0L") + F.floor(value / F.pow(F.lit(256.0), i)).cast("long") % 256), 2, "0")), ""))


def epub_pieces(files: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, begin, bytes) of each book's archive from files (book, name, content).

    The uncompressed mimetype is the first entry, then the container, then OEBPS/name by name. Books beyond 4 GB or
    65,535 entries raise.
    """
    own = files.select(F.col(book).alias("book"), F.concat(F.lit("OEBPS/"), "name").alias("name"), F.col("content").cast("binary").alias("content"), F.lit(2).alias("kind"))
    fixed = files.select(F.col(book).alias("book")).distinct().select("book", F.explode(F.array(
        F.struct(F.lit("mimetype").alias("name"), F.lit(MIMETYPE).cast("binary").alias("content"), F.lit(0).alias("kind")),
        F.struct(F.lit("META-INF/container.xml").alias("name"), F.lit(CONTAINER).cast("binary").alias("content"), F.lit(1).alias("kind")),
    )).alias("e")).select("book", "e.name", "e.content", "e.kind")
    packed = own.unionByName(fixed).select("book", "kind", "name", _packed(F.col("kind") == 0, F.col("name"), F.col("content")).alias("p")).select("book", "kind", "name", "p.record", "p.entry")
    made = scratch.write(packed.withColumn("id", F.monotonically_increasing_id()))
    spark = files.sparkSession
    # The slim table has no contents; it alone is sorted and summed up.
    slim = spark.read.parquet(made).select("id", "book", "kind", "name", F.octet_length("record").cast("long").alias("size"), "entry")
    slim = ranks.numbered(slim, "kind", "name", keys=("book",), name="place", start=0)
    slim = ranks.running(slim, "book", value="size", order="place", name="begin")
    slim = slim.withColumn("line", F.octet_length("entry") + F.octet_length("name").cast("long"))
    table = scratch.write(ranks.running(slim, "book", value="line", order="place", name="at"))
    slim = spark.read.parquet(table)
    whole = slim.groupBy("book").agg(F.count("*").alias("entries"), F.sum("size").alias("start"), F.sum("line").alias("length"))
    fits = (F.col("entries") <= _MOST_ENTRIES) & (F.col("start") + F.col("length") <= _MOST_BYTES)
    whole = whole.withColumn("start", F.when(fits, F.col("start")).otherwise(F.raise_error(F.lit("a book is too large for an archive without 64-bit fields")).cast("long")))
    records = spark.read.parquet(made).select("id", "record").join(slim.select("id", "book", "begin"), "id").select("book", "begin", F.col("record").alias("bytes"))
    # The last four bytes of an entry of the directory are its record's place.
    line = F.concat(F.expr("substring(entry, 1, octet_length(entry) - 4)"), _little(F.col("begin"), 4), F.encode("name", "UTF-8"))
    lines = slim.withColumn("bytes", line).join(whole.select(F.col("book").alias("b"), "start"), F.col("book").eqNullSafe(F.col("b"))).select("book", (F.col("start") + F.col("at")).alias("begin"), "bytes")
    end = F.concat(F.unhex(F.lit("504B050600000000")), _little(F.col("entries"), 2), _little(F.col("entries"), 2), _little(F.col("length"), 4), _little(F.col("start"), 4), F.unhex(F.lit("0000")))
    ends = whole.select("book", (F.col("start") + F.col("length")).alias("begin"), end.alias("bytes"))
    return records.unionByName(lines).unionByName(ends).withColumnRenamed("book", book)


def wav_pieces(clips: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """(keys, begin, bytes) of a 16-bit mono WAV file from each key's clips (samples -1 to 1, rate) in order; rates that differ raise."""
    import pandas as pd

    @F.pandas_udf("binary")
    def pcm(samples: pd.Series) -> pd.Series:
        import numpy as np

        return samples.map(lambda x: (np.clip(np.asarray([] if x is None else x, float), -1, 1) * 32767).round().astype("<i2").tobytes())

    made = scratch.write(clips.select(*keys, order, "rate", pcm("samples").alias("bytes")))
    parts = clips.sparkSession.read.parquet(made)
    placed = ranks.running(parts.withColumn("__size", F.octet_length("bytes").cast("long")), *keys, value="__size", order=order, name="begin")
    data = placed.select(*keys, (F.col("begin") + 44).alias("begin"), "bytes")
    whole = parts.groupBy(*keys).agg(F.sum(F.octet_length("bytes").cast("long")).alias("n"), F.min("rate").alias("rate"), F.max("rate").alias("most"))
    rate = F.when(F.col("rate") == F.col("most"), F.col("rate")).otherwise(F.raise_error(F.lit("sample rates differ")).cast("int"))
    text = lambda t: F.lit(t).cast("binary")
    head = F.concat(text("RIFF"), _little(F.col("n") + 36, 4), text("WAVEfmt "), F.unhex(F.lit("1000000001000100")), _little(rate, 4), _little(rate * 2, 4), F.unhex(F.lit("02001000")), text("data"), _little(F.col("n"), 4))
    return data.unionByName(whole.select(*keys, F.lit(0).cast("long").alias("begin"), head.alias("bytes")))


def joined(pieces: DataFrame, *keys: str, out: str = "content") -> DataFrame:
    """(keys, out): small files as values."""
    names = ", ".join(f"`{k}`" for k in keys)
    pieces.createOrReplaceTempView("inkwell_pieces")
    try:
        return pieces.sparkSession.sql(f"SELECT {names}, listagg(bytes) WITHIN GROUP (ORDER BY begin) AS `{out}` FROM inkwell_pieces GROUP BY {names}")
    finally:
        pieces.sparkSession.catalog.dropTempView("inkwell_pieces")


def save(pieces: DataFrame, folder: str, name: Column, *keys: str) -> DataFrame:
    """Writes each key's file to folder/name, a folder or store that executors share; (path, bytes, pieces) of each.

    Pieces are dealt by key and sorted by place, and a task writes one after another: it holds one at a time. A file
    gets its name when it is whole, so a repeated task starts again.
    """
    rows = pieces.select(name.alias("__name"), "begin", "bytes").repartition("__name").sortWithinPartitions("__name", "begin")

    def run(batches: Iterator):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        now, file, part, size, n = None, None, "", 0, 0

        def finish():
            file.close()
            store.move(part, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{now}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "pieces"])

        for batch in batches:
            for i in range(batch.num_rows):
                title = batch.column("__name")[i].as_py()
                if title != now:
                    if file is not None:
                        yield finish()
                    now, part, size, n = title, f"{root}/.{uuid.uuid4().hex}", 0, 0
                    file = store.open_output_stream(part)
                if batch.column("begin")[i].as_py() != size:
                    raise ValueError(f"{title}: a piece is missing before byte {batch.column('begin')[i]}")
                data = batch.column("bytes")[i].as_buffer()
                file.write(data)
                size, n = size + len(data), n + 1
        if file is not None:
            yield finish()

    return rows.mapInArrow(run, "path string, bytes long, pieces long")
