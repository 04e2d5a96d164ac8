"""Audio clips in tables: reading, joining, trimming silence, peaks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP = "path string, samples array<float>, rate int, duration_ms bigint"


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, rate, duration_ms) of 16-bit WAV files, channels averaged."""

    def read(batches):
        import io
        import wave

        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as clip:
                    data = np.frombuffer(clip.readframes(clip.getnframes()), "<i2").reshape(-1, clip.getnchannels()).mean(1) / 32768
                    rows.append((name, data.astype(np.float32), clip.getframerate(), int(len(data) / max(clip.getframerate(), 1) * 1000)))
            yield pd.DataFrame(rows, columns=["path", "samples", "rate", "duration_ms"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CLIP)


def wav_bytes(samples, rate: int) -> bytes:
    """A mono 16-bit WAV file."""
    import io
    import wave

    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as clip:
        clip.setnchannels(1)
        clip.setsampwidth(2)
        clip.setframerate(rate)
        clip.writeframes((np.clip(np.asarray(samples), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


class Speech(Protocol):
    """A speech engine: samples and rate (or samples alone, at the default rate) of a text."""

    def __call__(self, text: str, voice: str, speed: float): ...


#: Samples a second where an engine gives none.
RATE = 24000


def as_clip(result, rate: int = RATE):
    """(samples as one row of float32, rate) of what an engine gave: samples, (samples, rate), or an object with both."""
    import numpy as np

    if isinstance(result, tuple) and len(result) == 2:
        samples, given = result
    else:
        samples, given = getattr(result, "audio", result), getattr(result, "sample_rate", rate)
    samples = np.squeeze(np.asarray(samples, np.float32))
    if samples.ndim > 1:
        raise ValueError(f"samples of shape {samples.shape} are not one channel")
    if not samples.size:
        raise ValueError("no samples")
    return np.atleast_1d(samples), int(given or rate)


def spoken(segments: DataFrame, engine: Speech, *keys: str, text: str = "text", voice: str = "voice", speed: str = "speed") -> DataFrame:
    """(keys, samples, rate, duration_ms, error) of each segment's text; blank texts and failures have no samples but an error."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType([segments.schema[k] for k in keys])
    for name, kind in (("samples", ArrayType(FloatType())), ("rate", "integer"), ("duration_ms", "long"), ("error", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for t, v, s in zip(batch["__t"], batch["__v"], batch["__s"]):
                try:
                    if not (t or "").strip():
                        raise ValueError("blank text")
                    samples, rate = as_clip(engine(t, v, min(4.0, max(0.1, s))))
                    rows.append((samples.tolist(), rate, int(len(samples) / max(rate, 1) * 1000), None))
                except Exception as fault:  # noqa: BLE001  one segment must not end the batch
                    rows.append((None, None, None, str(fault)))
            out = pd.DataFrame(rows, columns=["samples", "rate", "duration_ms", "error"], dtype=object)
            yield pd.concat([batch[list(keys)].reset_index(drop=True), out], axis=1)

    return segments.select(*keys, F.col(text).alias("__t"), F.col(voice).alias("__v"), F.coalesce(F.col(speed).cast("double"), F.lit(1.0)).alias("__s")).mapInPandas(run, schema)


def concatenated(clips: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """(keys, samples, rate) of a chapter's clips in order; rates that differ within a chapter raise."""
    rows = clips.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "samples"))).alias("c"), F.min("rate").alias("rate"), F.max("rate").alias("most"))
    same = F.when(F.col("rate") == F.col("most"), F.col("rate")).otherwise(F.raise_error(F.lit("sample rates differ")).cast("int"))
    return rows.select(*keys, F.flatten(F.transform("c", lambda x: x["samples"])).alias("samples"), same.alias("rate"))


def trimmed(samples: Column, rate: Column, threshold_db: float = -50.0, padding_ms: int = 100) -> Column:
    """Samples from the first to the last above the threshold, with padding; all silent clips stay whole."""
    limit = 10 ** (threshold_db / 20)
    loud = F.transform(samples, lambda x: F.abs(x) > limit)
    pad = F.floor(rate * padding_ms / 1000).cast("int")
    first = F.array_position(loud, True).cast("int")
    last = (F.size(samples) - F.array_position(F.reverse(loud), True) + 1).cast("int")
    begin, end = F.greatest(first - pad, F.lit(1)), F.least(last + pad, F.size(samples))
    return F.when(first > 0, F.slice(samples, begin, end - begin + 1)).otherwise(samples)


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def normalized(samples: Column) -> Column:
    """Scaled to a peak of 1; silence stays."""
    top = peak(samples)
    return F.when(top > 0, F.transform(samples, lambda x: x / top)).otherwise(samples)


def viewed(samples: Column, zoom: Column, offset: Column) -> Column:
    """The part of a waveform that a zoom (1 to 20) and an offset (0 to 1) show."""
    size = F.size(samples)
    width = F.greatest(F.floor(size / F.greatest(F.lit(1.0), F.least(F.lit(20.0), zoom))).cast("int"), F.lit(1))
    begin = F.floor((size - width) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), offset))).cast("int")
    return F.slice(samples, begin + 1, width)
