"""Fill-in-the-middle: each text is cut into prefix, middle and suffix at two drawn places, and put together anew.

A text is held as fixed blocks of bytes. Two Fenwick trees over the blocks count the units (what is cut between: code points,
words with the white space behind them, or lines) and the code points that begin in them. Descending by powers of two finds the
block in which a unit begins; the place within it is found in that block alone.

Null texts count as empty. Empty texts, texts that hold a marker, and a drawn share of the others stay as they are (``plain``).
A null id draws like an id without digits. Rows are treated on their own, so rows alike give rows alike; empty tables give no
rows, and columns that aren't named are not read. Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of

MARKERS = ("<P>", "<S>", "<M>")
#: Bytes in a block.
BLOCK = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes of a UTF-8 text begin a unit. Units cover the text without gaps."""
    if unit == "code point":
        return (data & 0xC0) != 0x80
    starts = np.zeros(len(data), bool)
    if unit == "word":
        space = _SPACE[data]
        starts[1:] = space[:-1] & ~space[1:]
    elif unit == "line":
        starts[1:] = data[:-1] == 10
    else:
        raise ValueError(f"unknown unit {unit!r}")
    starts[:1] = True
    return starts


class Fenwick:
    """Sums over blocks; place i holds the blocks (i - lowest bit of i, i]."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        i = np.arange(self.size + 1)
        self.sums = (total - total[i - (i & -i)]).tolist()

    def descend(self, target: int, other: "Fenwick") -> tuple[int, int, int]:
        """The block in which item ``target`` is (the number of blocks if there is none), how many of its items come before, and
        the other tree's count of what lies before the block."""
        at, passed, step = 0, 0, 1 << self.size.bit_length()
        while step:
            to = at + step
            if to <= self.size and self.sums[to] <= target:
                at, target, passed = to, target - self.sums[to], passed + other.sums[to]
            step >>= 1
        return at, target, passed


class Blocks:
    """A text with its two trees."""

    def __init__(self, text: bytes, unit: str, block: int = BLOCK):
        data = np.frombuffer(text, np.uint8)
        self.block, self.starts, self.points = block, unit_starts(data, unit), unit_starts(data, "code point")
        edges = np.arange(0, len(data), block)
        counts = [np.add.reduceat(x, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64) for x in (self.starts, self.points)]
        self.n, self.chars, self.size = int(counts[0].sum()), int(counts[1].sum()), len(data)
        self.units, self.code_points = map(Fenwick, counts)

    def cut(self, units: int) -> tuple[int, int]:
        """Where the text's first ``units`` units end: bytes and code points."""
        if units >= self.n:
            return self.size, self.chars
        at, rest, passed = self.units.descend(units, self.code_points)
        low = at * self.block
        inside = int(np.flatnonzero(self.starts[low : low + self.block])[rest])
        return low + inside, passed + int(self.points[low : low + inside].sum())


def _draws(seed: int, key: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "code point", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, markers: Sequence[str] = MARKERS, block: int = BLOCK,
) -> DataFrame:
    """One row per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and ``output``."""
    p, s, m = (x.encode() for x in markers)

    def one(key: object, text: bytes) -> tuple:
        h1, h2, h3, h4 = _draws(seed, key)
        held = Blocks(text, unit, block)
        if not text or p in text or s in text or m in text or h3 % 100 >= 100 - plain_percent:
            return held.n, "plain", None, None, text
        first, second = sorted((h1 % (held.n + 1), h2 % (held.n + 1)))
        (a, before), (b, upto) = held.cut(first), held.cut(second)
        spm = h4 % 100 < spm_percent
        parts = (s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])
        return held.n, "spm" if spm else "psm", before, upto - before, b"".join(parts)

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        n, form, prefix, middle, output = zip(*map(one, ids.to_pylist(), texts), strict=True)
        return {"doc_id": ids, "n": pa.array(n, pa.int64()), "form": pa.array(form), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string())}

    return map_texts(texts_of(df, id_col, text_col), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", each)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text of which an output was made. No part holds a marker, so each marker's only place tells where a part ends."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(output.substr(F.lit(len(first) + 1), F.length(output)), m, 1)
        return F.substring_index(head, second, 1), F.substring_index(head, second, -1)

    middle = F.substring_index(output, m, -1)
    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], middle, psm[1])).otherwise(F.concat(spm[1], middle, spm[0]))


def digest(found: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM w
"""
