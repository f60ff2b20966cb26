"""Pipelines: source bindings, sink bindings, and the pipes that join them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from ..contracts import SourceContract, flatten_params, identifier_problem
from ..errors import DefinitionError, raise_if
from ..operators.checks import POLICIES, enforce
from ..operators.filters import apply_filters, unanswered
from ..operators.mapping import Field
from ..operators.plan_lineage import column_lineage
from ..sinks.base import AdaptedSink, Sink
from ..sinks.publish import Pending, PendingFolder, publish_all
from ..sources.custom import CustomSource, split_tagged
from ..sources.reader import conform, load, select_columns
from ..sources.rejects import read_with_rejects, split_records
from ..staging import stage, temporary_folders
from ..streaming.scan import stream_source, stream_unsplit

#: Rows in a file of a source that is written for several uses.
ROWS_PER_FILE = 50_000


@dataclass(frozen=True)
class SourceBinding:
    """One configured use of a source. Several bindings of one contract do not share values."""

    name: str
    contract: SourceContract
    path: str | None
    fmt: str
    options: Mapping[str, str]
    custom: CustomSource | None
    policy: str
    bad_path: str | None
    rejects_path: str | None
    key: Sequence[str]
    values: dict[str, Any]

    def rows(self, spark: SparkSession) -> DataFrame:
        """Filtered rows with the declared columns, not yet checked."""
        return self.read(spark)[0]

    def _filtered(self, rows: DataFrame) -> DataFrame:
        """The rows of a custom source that the filters let through, under the contract."""
        resolved = self.contract.bind_filters(self.values)
        for param in self.contract.filters:
            condition = param.condition(resolved[param.name])
            rows = rows if condition is None else rows.where(condition)
        return conform(rows, self.contract)

    def _split_custom(self, tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows, rejects = split_tagged(tagged)
        return self._filtered(rows), rejects

    def stream_parts(self, spark: SparkSession) -> tuple[DataFrame, Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]]:
        """The source as one stream, and what parts a batch of it into rows and, with a ``rejects_path``, rejects."""
        whole = lambda rows: (rows, None)
        if self.custom is not None:
            resolved = self.contract.bind_filters(self.values)
            if self.rejects_path is not None:
                return self.custom.load_tagged(spark, True, **resolved), self._split_custom
            return self._filtered(self.custom.load_stream(spark, **resolved)), whole
        if self.rejects_path is None:
            return stream_source(spark, self.contract, self.path, self.fmt, self.values, self.options), whole
        table, tolerant = stream_unsplit(spark, self.contract, self.path, self.fmt, self.options)

        def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
            good, rejects = split_records(batch, self.contract, tolerant)
            return select_columns(apply_filters(good, self.contract, self.values), self.contract), rejects

        return table, split

    def read(self, spark: SparkSession, staged: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """The rows, and with a ``rejects_path`` the records that do not parse.

        A custom source gets the values of all filters; those with a predicate are applied to its rows as well. Where it
        gives rejects, ``staged`` has it read once for both.
        """
        if self.custom is not None:
            resolved = self.contract.bind_filters(self.values)
            if self.rejects_path is None:
                return self._filtered(self.custom.load(spark, **resolved)), None
            tagged = self.custom.load_tagged(spark, **resolved)
            return self._split_custom(stage(tagged, "tagged") if staged else tagged)
        if self.rejects_path is not None:
            return read_with_rejects(spark, self.contract, self.path, self.fmt, self.options, self.values)
        table = load(spark, self.contract, self.path, self.fmt, self.options)
        return select_columns(apply_filters(table, self.contract, self.values), self.contract), None


@dataclass
class Pipeline:
    """A named set of bindings and pipes.

    >>> (Pipeline("Report")
    ...     .source("er", EMPLOYMENT, "/data/orders.parquet", date_from="2019-01-01")
    ...     .sink("csv", DelimitedSink("/data/out"))
    ...     .adapter("feed", onto="csv", mapping=FIELDS)
    ...     .pipe("er -> feed")
    ...     .run(spark))

    Declaring never raises; ``validate`` and every run raise once with all problems.
    """

    name: str
    explain: str = ""
    sources: dict[str, SourceBinding] = field(default_factory=dict)
    sinks: dict[str, Sink] = field(default_factory=dict)
    onto: dict[str, str] = field(default_factory=dict)
    pipes: list[tuple[str, str]] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    def _claim(self, name: str) -> bool:
        self.problems += identifier_problem("binding", name)
        if name in self.sources or name in self.sinks:
            self.problems.append(f"binding {name!r} already exists")
            return False
        return True

    def source(
        self,
        name: str,
        contract: SourceContract,
        path: str | None = None,
        fmt: str = "parquet",
        options: Mapping[str, str] | None = None,
        custom: CustomSource | None = None,
        policy: str = "fail",
        bad_path: str | None = None,
        rejects_path: str | None = None,
        key: Sequence[str] = (),
        filters: Mapping[str, Any] | None = None,
        **more_filters: Any,
    ) -> Pipeline:
        """Bind a source. ``policy`` says what happens to rows that break a rule; ``quarantine`` and
        ``report`` write them, or their violations, to ``bad_path``. Records that do not parse stop the run, or
        go to ``rejects_path`` if there is one."""
        if not self._claim(name):
            return self
        values: dict[str, Any] = {}
        try:
            values = flatten_params(filters or {})
            for twice in values.keys() & more_filters.keys():
                self.problems.append(f"source {name!r}: filter {twice!r} is set twice")
            values.update(flatten_params(more_filters))
        except DefinitionError as exc:
            self.problems += [f"source {name!r}: {p}" for p in exc.problems]
        if policy not in POLICIES:
            self.problems.append(f"source {name!r}: unknown policy {policy!r}")
        if policy in ("quarantine", "report") and bad_path is None:
            self.problems.append(f"source {name!r}: policy {policy!r} needs a bad_path")
        if (path is None) == (custom is None):
            self.problems.append(f"source {name!r} needs either a path or a custom source")
        if custom is not None and rejects_path is not None and not custom.rejects:
            self.problems.append(f"source {name!r}: the custom source has no rejects")
        self.sources[name] = SourceBinding(
            name, contract, path, fmt, dict(options or {}), custom, policy, bad_path, rejects_path, tuple(key), values
        )
        return self

    def sink(self, name: str, sink: Sink | Callable[..., Sink], **params: Any) -> Pipeline:
        """Bind a sink object, or a sink type with its parameters."""
        if not self._claim(name):
            return self
        if isinstance(sink, Sink):
            if params:
                self.problems.append(f"sink {name!r} is already configured, it takes no parameters")
            self.sinks[name] = sink
            return self
        try:
            self.sinks[name] = sink(**flatten_params(params))
        except DefinitionError as exc:
            self.problems += [f"sink {name!r}: {p}" for p in exc.problems]
        except TypeError as exc:
            self.problems.append(f"sink {name!r}: {exc}")
        return self

    def adapter(
        self, name: str, onto: str, mapping: Callable[[DataFrame], DataFrame] | Sequence[Field | tuple]
    ) -> Pipeline:
        """Bind a record mapping in front of a sink bound before."""
        if not self._claim(name):
            return self
        if onto not in self.sinks:
            self.problems.append(f"adapter {name!r}: sink {onto!r} not found")
            return self
        self.sinks[name] = self.sinks[onto].adapt(mapping)
        self.onto[name] = onto
        return self

    def pipe(self, source: str, sink: str | None = None) -> Pipeline:
        """Join two bindings, given as two names or as one text ``"a -> b"``."""
        if sink is None:
            parts = [p.strip() for p in source.split("->")]
            if len(parts) != 2:
                self.problems.append(f"pipe {source!r} is not of the form 'input -> output'")
                return self
            source, sink = parts
        self.pipes.append((source, sink))
        return self

    def validate(self) -> None:
        """Check names, pipes and filter values without touching data."""
        problems = identifier_problem("pipeline", self.name) + self.problems
        for a, b in self.pipes:
            if a not in self.sources:
                problems.append(f"pipe '{a} -> {b}': source {a!r} not found")
            if b not in self.sinks:
                problems.append(f"pipe '{a} -> {b}': sink {b!r} not found")
        for binding in self.sources.values():
            try:
                resolved = binding.contract.bind_filters(binding.values)
            except DefinitionError as exc:
                problems += [f"source binding {binding.name!r}: {p}" for p in exc.problems]
                continue
            if binding.custom is None:
                problems += [f"source binding {binding.name!r}: {p}" for p in unanswered(binding.contract, resolved)]
        raise_if(f"pipeline {self.name!r}", problems)

    def _targets(self) -> dict[str, list[str]]:
        """Source bindings by sink binding, in pipe order."""
        targets: dict[str, list[str]] = {}
        for a, b in self.pipes:
            targets.setdefault(b, []).append(a)
        return targets

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """What each sink binding would be given: checked rows, the sources of a fan-in appended."""
        self.validate()
        good = {a: self._enforced(a, self.sources[a].rows(spark))[0] for a in dict.fromkeys(a for a, _ in self.pipes)}
        return {b: reduce(DataFrame.unionByName, [good[a] for a in names]) for b, names in self._targets().items()}

    def _enforced(self, name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        binding = self.sources[name]
        return enforce(rows, binding.contract, binding.policy, binding.key)

    def run(self, spark: SparkSession) -> dict[str, Any]:
        """Run every pipe, one write per sink binding, and return what each write returned.

        What a sink says of the rows it would get is asked of all sinks before the first write. A source that
        feeds several writes is written to the shared folder first, so that it is read once and all of them
        see the same rows; nothing of it is left afterwards. Outputs, rejects and bad rows included, are shown when
        all of them are written: if one fails, none is there.
        """
        frames = self.frames(spark)
        problems: list[str] = []
        for name, rows in frames.items():
            try:
                self.sinks[name].check(rows)
            except DefinitionError as exc:
                problems += [f"sink {name!r}: {p}" for p in exc.problems]
        raise_if(f"pipeline {self.name!r}", problems)
        targets = self._targets()
        uses = {a: sum(a in names for names in targets.values()) for a in self.sources}
        good: dict[str, DataFrame] = {}
        pending: dict[str, Pending] = {}
        with temporary_folders(spark):
            try:
                for name, binding in self.sources.items():
                    if not uses[name]:
                        continue
                    rows, rejects = binding.read(spark, staged=True)
                    if rejects is not None:
                        pending[f"rejects of {name}"] = _pending_table(rejects, binding.rejects_path)
                    if uses[name] + (binding.bad_path is not None) > 1:
                        rows = stage(rows, "source", ROWS_PER_FILE)
                    good[name], bad = self._enforced(name, rows)
                    if bad is not None and binding.bad_path is not None:
                        pending[f"bad of {name}"] = _pending_table(bad, binding.bad_path)
                for sink_name, names in targets.items():
                    rows = reduce(DataFrame.unionByName, [good[a] for a in names])
                    pending[sink_name] = self.sinks[sink_name].prepare(rows)
            except BaseException:
                for output in pending.values():
                    output.cancel()
                raise
            outcome = publish_all(pending)
        return {name: outcome[name] for name in targets}

    def run_stream(self, spark: SparkSession, checkpoint: str, **trigger: Any) -> list[Any]:
        """Run the same definition on streams; see :func:`tabpact.streaming.run_pipeline`."""
        from ..streaming.pipes import run_pipeline

        return run_pipeline(self, spark, checkpoint, **trigger)

    def edges(self, spark: SparkSession, stored: bool = False) -> DataFrame:
        """The lineage of this definition as an edge table (src, dst).

        Nodes are ``source:<binding>.<column>``, ``fn:<function>`` and ``sink:<binding>.<field>``. Which columns a field is made of is read
        off the resolved expressions, so nothing need be declared; what a field names in ``uses`` is added. User functions are nodes, and so is what a
        field names in ``via``.

        With ``stored`` also where the source columns come from, ``table:<binding>.<column>``, and what decides on a source's rows: the columns that
        its filters, checks and computed columns ask lead to ``rows:<binding>``, and that leads to all fields it feeds. Stored tables must be there for that; no data is read.
        """
        self.validate()
        found: dict[tuple[str, str], None] = {}
        for a, b in self.pipes:
            binding, name = self.sources[a], b
            frame, origin = _empty(spark, binding.contract.schema()), f"source:{a}"
            if stored:
                self._stored_edges(spark, binding, found)
            sink = self.sinks[b]
            while True:
                rows, target = frame, f"sink:{name}"
                if isinstance(sink, AdaptedSink):
                    rows = sink.transform(frame)
                    _mapping_edges(rows, sink.fields, origin, target, found)
                else:
                    found |= {(f"{origin}.{c}", f"{target}.{c}"): None for c in frame.columns}
                if stored and origin.startswith("source:"):
                    found |= {(f"rows:{a}", f"{target}.{c}"): None for c in rows.columns}
                if name not in self.onto:
                    break
                frame, origin, name, sink = _empty(spark, rows.schema), target, self.onto[name], sink.inner
        return spark.createDataFrame(list(found), "src string, dst string")

    def _stored_edges(self, spark: SparkSession, binding: SourceBinding, found: dict[tuple[str, str], None]) -> None:
        """From the stored columns to the source's columns, and from those that decide on its rows."""
        to_rows = f"rows:{binding.name}"
        if binding.custom is None:
            table = load(spark, binding.contract, binding.path, binding.fmt, binding.options).alias("table")
            rows = select_columns(apply_filters(table, binding.contract, binding.values), binding.contract)
            lineage = column_lineage(rows)
            for column, origins in lineage.columns.items():
                found |= {(f"table:{binding.name}.{c}", f"source:{binding.name}.{column}"): None for _, c in sorted(origins)}
            found |= {(f"table:{binding.name}.{c}", to_rows): None for _, c in sorted(lineage.rows)}
        checked = self._enforced(binding.name, _empty(spark, binding.contract.schema()))[0]
        found |= {(f"source:{binding.name}.{c}", to_rows): None for _, c in sorted(column_lineage(checked).rows)}


def _pending_table(df: DataFrame, path: str) -> Pending:
    folder = PendingFolder(df.sparkSession, path, "errorifexists")
    df.write.parquet(folder.path)
    return Pending(folder.publish, folder.cancel)


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _mapping_edges(rows: DataFrame, fields: Sequence[Field], origin: str, target: str, found: dict[tuple[str, str], None]) -> None:
    """From the columns in front of a mapping to those behind it."""
    lineage = column_lineage(rows)
    declared = {f.name: f for f in fields}
    for name in rows.columns:
        given = declared.get(name, Field(name, name, uses=()))
        columns = sorted({c for _, c in lineage.columns[name]} | set(given.inputs()))
        functions = sorted(lineage.functions[name]) if given.via is None else [given.via]
        for column in columns:
            for function in functions:
                found[f"{origin}.{column}", f"fn:{function}"] = None
            if not functions:
                found[f"{origin}.{column}", f"{target}.{name}"] = None
        found |= {(f"fn:{function}", f"{target}.{name}"): None for function in functions}
