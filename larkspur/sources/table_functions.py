"""Table functions for SQL over formats whose lines hang together: each partition, in its order, is read line by line.

`SELECT * FROM shift_lines(TABLE(SELECT file, n, line FROM ...) PARTITION BY file ORDER BY n)`; `text_lines` makes such a
table of files. A partition keeps one block at a time, whatever its length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Fields of a log record, and how a defect is written.
LOG_TAGS = ("op", "sgrid", "scls", "wk", "bnd", "mode", "qdate", "qtime", "txr", "rxr", "wgrid", "ent", "pwr")
DEFECT = re.compile(r"^(\w+) SEV([1-3]) AT ([0-9.]+)M(?: NOTE=(.*))?$")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files: n orders the lines of a file, and isn't their number, as parts of a file are read apart."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    # Within a part ids rise; a part has fewer than 2**33 lines.
    return lines.select("file", (F.col("at").cast("decimal(30,0)") * (1 << 33) + F.monotonically_increasing_id() % (1 << 33)).alias("n"), "line")


@udtf(returnType="file string, block int, run string, status string, type string, severity int, meters double, note string")
class ShiftLines:
    """A row for each DEFECT line of `KEY: value` blocks parted by blank lines, one without a defect for a block that has none.

    A line that begins with two blanks goes on with the line before. Of a key that a block has twice the first counts. What
    isn't written as a defect gives nulls.
    """

    def __init__(self):
        self.file, self.block, self.lines = None, 0, []

    def _close(self):
        rows, lines, self.lines = [], self.lines, []
        if not lines:
            return rows
        pairs = [(k.strip(), v.strip()) for k, sep, v in (line.partition(":") for line in lines) if sep]
        first = lambda key: next((v for k, v in pairs if k == key), None) or None
        for defect in [v for k, v in pairs if k == "DEFECT"] or [None]:
            m = DEFECT.match(defect or "")
            try:
                meters = float(m[3]) if m else None
            except ValueError:
                meters = None
            rows.append((self.file, self.block, first("RUN"), first("STATUS"), m[1] if m else None, int(m[2]) if m else None, meters, m[4] if m else None))
        self.block += 1
        return rows

    def eval(self, row: Row):
        self.file = row["file"]
        line = row["line"] or ""
        if not line.strip():
            yield from self._close()
        elif line.startswith("  ") and self.lines:
            self.lines[-1] += " " + line.strip()
        else:
            self.lines.append(line)

    def terminate(self):
        yield from self._close()


@udtf(returnType="file string, station string, grid string, class string, " + ", ".join(f"{t} string" for t in ("worked", "band", "mode", "date", "time")))
class LogLines:
    """A row for each contact of a log of `<tag:length>value...<fin>` lines, with what its station has declared so far.

    A line may declare its station's grid and class, which hold from then on. A line without a partner, band, mode, date
    or time is no contact. A bad tag is passed over; lengths end with the line at the latest.
    """

    def __init__(self):
        self.declared: dict[str, list[str | None]] = {}

    @staticmethod
    def fields(line: str) -> dict[str, str]:
        out, at = {}, 0
        while at < len(line):
            if line[at] != "<":
                at += 1
                continue
            z = line.find(">", at)
            if z < 0 or line[at + 1 : z] == "fin":
                break
            name, sep, n = line[at + 1 : z].partition(":")
            at = z + 1
            if sep and n.isascii() and n.isdigit():
                if name in LOG_TAGS:
                    out[name] = line[at : at + int(n)]
                at += int(n)
        return out

    def eval(self, row: Row):
        f = self.fields((row["line"] or "").strip())
        station = f.get("op", "")
        own = self.declared.setdefault(station, [None, None])
        for i, tag in enumerate(("sgrid", "scls")):
            own[i] = f.get(tag) or own[i]
        contact = [f.get(t) for t in ("wk", "bnd", "mode", "qdate", "qtime")]
        if station and all(contact):
            d = contact[3]
            contact[3] = f"{d[:4]}-{d[4:6]}-{d[6:]}" if len(d) == 8 else d
            yield (row["file"], station, *own, *contact)


def register(spark: SparkSession) -> None:
    """Names for SQL: shift_lines and log_lines."""
    spark.udtf.register("shift_lines", ShiftLines)
    spark.udtf.register("log_lines", LogLines)
