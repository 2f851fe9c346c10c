"""Lines of text or bytes.

Lines end at ``\\n``; one ``\\r`` in front of it goes.  The limit counts the
bytes before ``\\n``, with such a ``\\r``.  Files are read in splits; a line's
order is its file, the start of its split and its place there, so large files
stay parallel, and global line numbers are made only to name a bad line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidUtf8, LineTooLong
from ..operators.grouping import numbered
from ..policies import DEFAULT_MAX_LINE, LineOverflow


class ByteLinesSource:
    """``line``: binary, without decoding."""

    order = ("file", "split", "place")
    utf8: bool | None = None  # whether to decode, and then whether bad bytes are replaced

    def __init__(self, path: str, max_line_len: int = DEFAULT_MAX_LINE, on_overflow: LineOverflow = LineOverflow.ERROR):
        self.path, self.limit, self.overflow = path, max_line_len, on_overflow

    def _raw(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.option("lineSep", "\n").text(self.path)
        place = F.monotonically_increasing_id()
        return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), place.alias("place"), F.col("value").cast("binary").alias("line"))

    def _text(self, raw: Column) -> Column:
        long = F.octet_length(raw) > self.limit
        ends = F.substring(raw, -1, 1) == F.lit(b"\r")
        short = F.when(ends, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
        return F.when(long, F.substring(raw, 1, self.limit)).otherwise(short)

    def _bad(self, rows: DataFrame, test: Column) -> int | None:
        """The number, from 1, of the first line for which ``test`` holds."""
        if rows.filter(test).limit(1).count() == 0:
            return None
        return numbered(rows, list(self.order), "_no").filter(test).agg(F.min("_no")).first()[0] + 1

    def read(self, spark: SparkSession) -> DataFrame:
        rows = self._raw(spark)
        long = F.octet_length("line") > self.limit
        strict = self.utf8 is not None and not self.utf8
        line = self._text(F.col("line"))
        wrong = ~F.is_valid_utf8(line.cast("string"))
        too_long = self._bad(rows, long) if self.overflow is LineOverflow.ERROR else None
        invalid = self._bad(rows, wrong & ~long if self.overflow is LineOverflow.SKIP else wrong) if strict else None
        if too_long is not None and (invalid is None or too_long <= invalid):
            raise LineTooLong(too_long, self.limit)
        if invalid is not None:
            raise InvalidUtf8(invalid)
        if self.overflow is LineOverflow.SKIP:
            rows = rows.filter(~long)
        if self.utf8 is not None:
            text = line.cast("string")
            line = F.make_valid_utf8(text) if self.utf8 else text
        return rows.withColumn("line", line)


class ReaderSource(ByteLinesSource):
    """``line``: a string.  ``lossy``: bytes that are not UTF-8 become U+FFFD, else the first such line is an error."""

    def __init__(self, path: str, max_line_len: int = DEFAULT_MAX_LINE, on_overflow: LineOverflow = LineOverflow.ERROR, lossy: bool = False):
        super().__init__(path, max_line_len, on_overflow)
        self.utf8 = lossy
