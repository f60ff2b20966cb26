"""Delimited text files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..contracts import Check, Param, SinkContract
from ..errors import raise_if
from ..functions.formats import date_formatter
from ..operators.rendering import QUOTING, format_cells, render_line
from ..operators.sequence import number_rows
from ..staging import temporary_folders
from .base import Sink
from .publish import Pending, PendingFolder, join_files

#: monotonically_increasing_id keeps the row position within the partition in its low 33 bits.
_POSITION_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class RowSequence:
    """Row numbers for an output: where they start, in which order, under which column name.

    ``staged`` writes the rows to the shared folder first; see :func:`tabpact.with_sequence`.
    """

    order_by: Sequence[str]
    start: int = 1
    name: str = "#"
    rows_per_range: int = 100_000
    staged: bool = False

    def add(self, df: DataFrame, start: int | None = None) -> tuple[DataFrame, int]:
        """The frame with the number as its first column, and how many rows it has."""
        first = self.start if start is None else start
        numbered, total = number_rows(
            df, self.order_by, first, self.name, rows_per_range=self.rows_per_range, staged=self.staged
        )
        return numbered.select(self.name, *df.columns), total


DELIMITED = SinkContract(
    "Delimited",
    params=[
        Param("path", "string", explain="folder to write to"),
        Param("date_fmt", None, default="%Y-%m-%d", explain="strftime pattern or Column function for dates"),
        Param("none_fmt", None, default="", explain="text or Column function for NULL"),
        Param("row_sequence", None, default=None, optional=True, explain="numbering of the rows"),
        Param(
            "header",
            None,
            default=None,
            optional=True,
            explain="names for the header row",
            checks=Check(lambda h: len(h) > 0, "the header must not be empty when it is given", when_present=True),
        ),
        Param("delimiter", "string", default=",", checks=Check(lambda d: len(d) >= 1, "the delimiter must not be empty")),
        Param("eol", "string", default="\n", checks=Check(lambda e: len(e) >= 1, "the line end must not be empty")),
        Param("quoting", "string", default="rfc4180", checks=Check(lambda q: q in QUOTING, f"one of {QUOTING}")),
        Param(
            "mode",
            "string",
            default="errorifexists",
            checks=Check(lambda m: m in ("errorifexists", "overwrite", "append"), "an existing write mode"),
        ),
        Param("single_file", "boolean", default=False, explain="one file instead of a folder"),
    ],
    explain="delimited text files, one line per record",
)


@dataclass(frozen=True)
class DelimitedSink(Sink):
    """Writes a folder of part files, in number order when rows are numbered.

    A cell that holds the delimiter, a quote or a line end is quoted as in RFC 4180; ``raw`` quoting
    writes cells as they are. NULL is written as ``none_fmt``; with the default empty text it cannot
    be told from an empty text afterwards. The header, if any, starts every part file. ``mode`` is
    ``errorifexists`` by default: a finished output is sealed and writing to it again is an error.

    ``single_file`` makes ``path`` one file with one header, its rows in number order. It is still written by all tasks: as parts, which the
    file system joins, or which tasks copy side by side to the places that the sizes before them give.
    """

    path: str
    date_fmt: str | Callable[[Column], Column] = "%Y-%m-%d"
    none_fmt: str | Callable[[Column], Column] = ""
    row_sequence: RowSequence | None = None
    header: Sequence[str] | None = None
    delimiter: str = ","
    eol: str = "\n"
    quoting: str = "rfc4180"
    mode: str = "errorifexists"
    single_file: bool = False

    def __post_init__(self):
        DELIMITED.bind(**{p.name: getattr(self, p.name) for p in DELIMITED.params})
        try:
            date_formatter(self.date_fmt)
        except ValueError as exc:
            raise_if("sink 'Delimited'", [f"'date_fmt': {exc}"])
        raise_if("sink 'Delimited'", ["a single file cannot be appended to"] if self.single_file and self.mode == "append" else [])

    def batch_writer(self, batch_id: int) -> DelimitedSink:
        return replace(self, path=f"{self.path}/batch_id={batch_id}", mode="overwrite")

    def cells(self, df: DataFrame) -> DataFrame:
        """The rows as texts, ready to be joined."""
        as_date = date_formatter(self.date_fmt)
        return format_cells(df, {"date": as_date}, self.none_fmt)

    def check(self, df: DataFrame) -> None:
        """The header must name every cell; the row number is one more."""
        width = len(df.columns) + (self.row_sequence is not None)
        if self.header is not None and len(self.header) != width:
            problem = f"the header has {len(self.header)} names but {width} cells are written"
            raise_if("sink 'Delimited'", [problem])

    def numbered(self, df: DataFrame, start: int | None = None) -> tuple[DataFrame, int | None]:
        if self.row_sequence is None:
            return df, None
        return self.row_sequence.add(df, start)

    def write(self, df: DataFrame, start: int | None = None) -> int | None:
        """Write all rows in one job. Returns their number if rows are numbered."""
        self.check(df)
        if self.single_file:
            return self._write_single(df, start)
        with temporary_folders(df.sparkSession):
            rows, total = self.numbered(df, start)
            seen = Observation()
            cells = self.cells(rows if total is None else rows.observe(seen, F.count(F.lit(1)).alias("rows")))
            if self.quoting == "rfc4180" and len(self.eol) == 1:
                self._write_csv(cells)
            else:
                self._write_text(cells)
        if total is not None and seen.get["rows"] < total:
            raise RuntimeError(f"{total} rows were counted, but {seen.get['rows']} were there to be written; stage the input")
        return total

    def _write_single(self, df: DataFrame, start: int | None) -> int | None:
        spark = df.sparkSession
        folder = PendingFolder(spark, self.path, self.mode)
        parts = replace(self, path=f"{folder.path}/rows", header=None, mode="errorifexists", single_file=False)
        try:
            # The header was checked for the row number as well, so the parts need none.
            total = parts.write(df, start)
            if self.header:
                names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(self.header))])
                top = replace(parts, path=f"{folder.path}/header", row_sequence=None)
                top.write(spark.createDataFrame([tuple(self.header)], names).coalesce(1))
            join_files(spark, [f"{folder.path}/header", f"{folder.path}/rows"] if self.header else [f"{folder.path}/rows"], f"{folder.path}/joined")
            PendingFolder(spark, self.path, self.mode).publish_file(f"{folder.path}/joined")
        finally:
            folder.cancel()
        return total

    def prepare(self, df: DataFrame, start: int | None = None) -> Pending:
        folder = PendingFolder(df.sparkSession, self.path, self.mode)
        try:
            total = replace(self, path=folder.path, mode="errorifexists").write(df, start)
        except BaseException:
            folder.cancel()
            raise

        def publish() -> int | None:
            folder.publish()
            return total

        return Pending(publish, folder.cancel)

    def _write_csv(self, cells: DataFrame) -> None:
        named = cells.toDF(*self.header) if self.header else cells
        named.write.mode(self.mode).csv(
            self.path,
            sep=self.delimiter,
            lineSep=self.eol,
            quote='"',
            escape='"',
            header=bool(self.header),
            # A blank line would be read as no record, so a lone empty cell is quoted.
            emptyValue='""' if len(cells.columns) == 1 else "",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )

    def _write_text(self, cells: DataFrame) -> None:
        """For line ends of several characters and for raw cells, which the CSV writer cannot do."""
        line = render_line(cells, self.delimiter, "", self.quoting, self.eol)
        if not self.header:
            cells.select(line.alias("line")).write.mode(self.mode).text(self.path, lineSep=self.eol)
            return
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(self.header))])
        names = cells.sparkSession.createDataFrame([tuple(self.header)], schema)
        top = names.select(render_line(names, self.delimiter, "", self.quoting, self.eol).alias("line"))
        first = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)) == 0
        headed = F.when(first, F.concat(F.lit(top.first()["line"] + self.eol), "line")).otherwise(F.col("line"))
        lines = cells.select(line.alias("line")).select(headed.alias("line"))
        lines.write.mode(self.mode).text(self.path, lineSep=self.eol)
        if cells.sparkSession.read.text(self.path).isEmpty():
            top.coalesce(1).write.mode("append").text(self.path, lineSep=self.eol)
