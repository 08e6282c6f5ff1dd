"""Fill-in-middle rows: token boundaries as packed bits with a directory of counts, cut by rank and select."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of text whose boundaries are found at a time, and packed bytes to a block of the directory.
SLICE, BLOCK = 1 << 20, 64

_SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


class Boundaries:
    """Where the tokens of a UTF-8 text end: one bit for each byte, set at the last byte of a token.

    A token is white space and the other characters after it, as much of both as there is; white space at the end of the text is
    a token as well. Counts of set bits before each block let ``select`` look at one block alone. Takes an eighth of the text.
    """

    def __init__(self, data: np.ndarray):
        size = len(data)
        self.bits = np.zeros(-(-size // (8 * BLOCK)) * BLOCK, np.uint8)
        for at in range(0, size, SLICE):
            space = _SPACE[data[at : at + SLICE + 1]]  # with the first byte of the next slice
            ends = ~space[: SLICE]
            ends[: len(space) - 1] &= space[1:]
            if at + SLICE >= size:
                ends[-1] = True
            packed = np.packbits(ends, bitorder="little")
            self.bits[at // 8 : at // 8 + len(packed)] = packed
        counts = np.bitwise_count(self.bits).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def __len__(self) -> int:
        """How many tokens there are: all set bits."""
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """Place of the ``k``-th set bit, from 1."""
        block = int(np.searchsorted(self.before, k, "left")) - 1
        part = np.unpackbits(self.bits[block * BLOCK : (block + 1) * BLOCK], bitorder="little")
        return block * BLOCK * 8 + int(np.flatnonzero(part)[k - self.before[block] - 1])

    def cut(self, k: int) -> int:
        """Bytes of the first ``k`` tokens."""
        return self.select(k) + 1 if k else 0


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Tokens of each text, and the byte cuts after one % (n + 1) and two % (n + 1) of them, the smaller first."""
    out = []
    for body, a, b in zip(text, one.to_pylist(), two.to_pylist()):
        ends = Boundaries(np.frombuffer(body.as_buffer(), np.uint8))
        n = len(ends)
        a, b = sorted((a % (n + 1), b % (n + 1)))
        out.append((n, ends.cut(a), ends.cut(b)))
    return pa.StructArray.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32())], names=["n", "first", "second"])


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows for training a model to fill in the middle of whole texts.

    Four numbers of a row come from the SHA-256 of ``seed``:id. Two cut its tokens into prefix, middle and suffix, the third makes
    ``rate`` of a hundred rows no plain ones, the fourth ``spm`` of a hundred of these suffix first. Empty texts and those that hold one of
    the marks stay plain. Cuts are found in bytes, and texts are cut there by Spark.

    Returns doc_id, n (tokens), form ('plain', 'psm', 'spm'), prefix_chars, middle_chars (null for plain), output; one row for each input
    row. Null texts count as empty, a null id as one without digits, rows that repeat an id have the same numbers. Other columns are not
    carried; an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.select("doc_id", "body", *[number(i).alias(f"h{i + 1}") for i in range(4)])
    cuts = F.arrow_udf(_cuts, "struct<n: long, first: int, second: int>")
    found = rows.withColumn("c", cuts(F.col("body").cast("binary"), "h1", "h2"))
    body = F.col("body").cast("binary")
    piece = lambda start, size: F.substring(body, start, size).cast("string")
    parts = found.select(
        "doc_id",
        "body",
        F.col("c.n").alias("n"),
        F.when((F.col("body") == "") | F.contains("body", F.lit(PREFIX)) | F.contains("body", F.lit(SUFFIX)) | F.contains("body", F.lit(MIDDLE)) | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"),
        piece(F.lit(1), F.col("c.first")).alias("prefix"),
        piece(F.col("c.first") + 1, F.col("c.second") - F.col("c.first")).alias("middle"),
        piece(F.col("c.second") + 1, F.octet_length("body") - F.col("c.second")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_first = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    made = F.col("form") != "plain"
    return parts.select(
        "doc_id",
        "n",
        "form",
        *[F.when(made, F.length(c).cast("long")).alias(f"{c}_chars") for c in ("prefix", "middle")],
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_first).otherwise(F.col("body")).alias("output"),
    )


def original(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. The marks are found from the left: no text that has a form but plain holds one."""
    n = len(PREFIX)
    after = lambda text, part: F.substring(text, F.char_length(part) + n + 1, F.char_length(text))
    body = F.substring(output, F.lit(n + 1), F.char_length(output))

    def three(second: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(body, second, 1)
        rest = after(body, first)
        mid = F.substring_index(rest, MIDDLE, 1)
        return first, mid, after(rest, mid)

    prefix, suffix, middle = three(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = three(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
