"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="sparkpact-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text as ``id`` and ``text``: further columns, whatever their names, are not read."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of ``most`` bytes or less, or of one longer text."""
    sizes, a, held = pc.binary_length(texts).fill_null(0).to_pylist(), 0, 0
    for k, n in enumerate(sizes):
        if k > a and held + n > most:
            yield a, k
            a, held = k, 0
        held += n
    if sizes:
        yield a, len(sizes)


#: A letter or digit before ASCII punctuation (but the apostrophe): two pre-tokens in any case, so a blank may part them.
#: Letters whose lower case or normal form ends in a combining mark are not among these.
_EDGE = r"([0-9a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~])"


def coded_chunks(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts' chunks between white space for a lower-case vocabulary: the distinct ones, every place's number in these,
    and where each text begins and ends. Punctuation behind a word is a chunk of its own."""
    texts = texts.fill_null("")
    # the vocabulary is lower case; only special tokens' strings depend on the case and on what stands beside them
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.replace_substring_regex(pc.ascii_lower(texts), _EDGE, r"\1 \2"))
    split = pc.ascii_split_whitespace(texts)
    ends = split.offsets.to_numpy()
    coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    words = coded.dictionary
    places = np.frombuffer(words.buffers()[1], "<i4", len(words) + 1, 4 * words.offset).tolist()
    buffer = words.buffers()[2]
    data = b"" if buffer is None else buffer.to_pybytes()
    return [data[a:b] for a, b in zip(places, places[1:], strict=False)], coded.indices.to_numpy(), ends - ends[0]


def map_texts(df: DataFrame, schema: str | T.StructType, each: Callable[[pa.Array, list[bytes]], dict | None]) -> DataFrame:
    """Run ``each(ids, texts)`` over Arrow batches of an (id, text) frame; it returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch.column("id"), utf8(batch.column("text")))) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)
