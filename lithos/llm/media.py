"""Media columns: whole texts stored as progressive JPEG, and features of the decoded pictures.

A text's UTF-8 bytes, filled with zeros to a positive multiple of 64, are stored
losslessly in the coefficients of a progressive JPEG file (lithos.llm.jpeg). The
stored bytes are read back scan by scan into coefficient arrays; the picture is
inverse-transformed, its chroma upsampled, and its full-resolution RGB tensor gives
the feature.

Scale: one pass without a shuffle; a worker holds one picture at a time beside its
Arrow batch. All arithmetic is exact, so equal texts give equal values anywhere.

Defined results: null text counts as empty and gives one block of zeros; a null
doc_id is carried; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithos.llm import jpeg
from lithos.llm.common import bounded, project, spread


def payload(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and the bytes filled up with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % jpeg.BLOCK if data else jpeg.BLOCK)


def feature(tensor: np.ndarray) -> str:
    """Size, the sum of each colour, and the sum of squares of green of an RGB tensor."""
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    green = tensor[:, :, 1].astype(np.int64)
    return f"{tensor.shape[1]}x{tensor.shape[0]} {sums[0]} {sums[1]} {sums[2]} {int((green * green).sum())}"


_COLUMNS = (
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary()), ("rgb", pa.binary()),
)


def store(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Per document: doc_id, sizes and digests of payload and file, the feature, and media and rgb.

    media is the file, rgb the tensor's bytes (its size is in the feature). Without with_media both are null.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for at in range(0, len(texts), 128):  # bounds what a batch of files holds
                out: tuple[list, ...] = tuple([] for _ in _COLUMNS)
                for text in texts.slice(at, 128).to_pylist():
                    n, data = payload(text)
                    media = jpeg.encode(data)
                    image = jpeg.decode(media)
                    back = jpeg.payload_of(image)
                    tensor = image.rgb()
                    row = (
                        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                        feature(tensor), media if with_media else None, tensor.tobytes() if with_media else None,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 128), *(pa.array(c, t) for c, (_, t) in zip(out, _COLUMNS, strict=True))],
                    names=["doc_id", *(name for name, _ in _COLUMNS)],
                )

    return spread(project(docs, doc_id="long", text="string")).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string, media binary, rgb binary",
    )
