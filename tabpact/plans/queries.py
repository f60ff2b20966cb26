"""The registered queries: every operator over the given tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..contracts import Check, ColumnSpec, FilterParam, SourceContract
from ..errors import RefusedError
from ..functions import (
    any_get,
    any_of,
    date_range,
    fmt_date,
    fmt_none,
    json_get,
    json_map,
    map_get,
    min_len,
    money,
    money_cent,
    money_cents,
    money_dollar,
    money_double,
    money_from_double,
    python_formatter,
)
from ..operators import (
    check_summary,
    cycles,
    enforce,
    first_violation,
    format_cells,
    map_record,
    render_rows,
    trace,
    violations,
    with_sequence,
)
from ..sinks import DelimitedSink, RowSequence, custom_sink
from ..sources import Reject, conform, custom_source, read_source, read_with_rejects, record_source, split_rejects
from ..staging import new_folder, qualified
from ..streaming import check_counts, stream_sink, stream_source
from .employment import EMPLOYMENT, FIELDS, HEADER, MONTH, feed
from .pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}

#: Small enough that the test tables are cut into several ranges.
ROWS_PER_RANGE = 5_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def employees(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return read_source(spark, EMPLOYMENT, f"{sf_dir}/orders.parquet", filters=filters)


# The employment record in SQL, with money in cents.
EMP = """
WITH emp AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'SID' || o_orderkey ELSE printf('SID%06d', o_orderkey) END AS employee_id,
         CAST(o_orderdate AS DATE) AS hire_date,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) END AS termination_date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         o_orderpriority AS department,
         CASE WHEN o_orderstatus = 'O' THEN 'clerk' END AS job_title
  FROM orders
), cells AS (
  SELECT employee_id, strftime(hire_date, '%Y-%m-%d') AS hire, strftime(termination_date, '%Y-%m-%d') AS term,
         printf('%d.%02d', cents // 100, cents % 100) AS salary, department, job_title, hire_date, termination_date, cents
  FROM emp
)
"""
GOOD_ID = r"regexp_full_match(employee_id, 'SID[0-9]{6}')"

# ---------------------------------------------------------------- scans and sources

ORDER_FACTS = SourceContract(
    "OrderFacts",
    columns=[
        ColumnSpec("o_orderkey", "bigint", explain="order number"),
        ColumnSpec("o_orderdate", "date", source="CAST(o_orderdate AS date)"),
        ColumnSpec("status", "string", source="o_orderstatus"),
        ColumnSpec("price_cents", "bigint", source="CAST(round(o_totalprice * 100) AS bigint)"),
    ],
)


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus AS status,
              CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents FROM orders"""
)
def contract_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, ORDER_FACTS, f"{sf_dir}/orders.parquet")


CATALOG = SourceContract(
    "Catalog",
    columns=[ColumnSpec("kind", "string"), ColumnSpec("id", "bigint"), ColumnSpec("name", "string")],
)


@query(
    """SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part WHERE p_size >= 10
       UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier"""
)
def custom_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(spark: SparkSession, min_size: int) -> DataFrame:
        parts = table(spark, sf_dir, "part").where(F.col("p_size") >= min_size)
        return parts.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).union(
            table(spark, sf_dir, "supplier").select(F.lit("supplier"), "s_suppkey", "s_name")
        )

    return conform(custom_source("catalog", rows).load(spark, min_size=10), CATALOG)


_STATEMENTS = """SELECT o_custkey AS cust_id, 'order ' || o_orderkey AS entry, 'D' AS kind, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders WHERE o_custkey {where} UNION ALL
  SELECT c_custkey, 'opening', CASE WHEN c_acctbal < 0 THEN 'D' ELSE 'C' END, abs(CAST(round(c_acctbal * 100) AS BIGINT)) FROM customer WHERE c_custkey {where}"""

STATEMENTS = SourceContract(
    "Statements",
    columns=[ColumnSpec("cust_id", "bigint"), ColumnSpec("entry", "string"), ColumnSpec("kind", "string"), ColumnSpec("cents", "bigint")],
    filters=[FilterParam("min_cust", "bigint", default=None, optional=True)],
)


#: Entries that one opening of an account is meant to have.
ENTRIES_PER_OPENING = 4_000


def _statement_files(spark: SparkSession, sf_dir: str, broken: bool = False, by_range: bool = False) -> str:
    """Accounts as a format of their own: a line `*customer` opens an account, the lines after it are its entries.

    An account is opened as many times as the table has parts of ``ENTRIES_PER_OPENING`` orders, each time with the orders that a hash deals to it, so that
    the orders of one customer are written, and read, by many tasks. With ``broken`` every 97th order has no amount; with ``by_range`` a file holds neighbouring accounts.
    """
    openings = table(spark, sf_dir, "orders").count() // ENTRIES_PER_OPENING + 1
    amount = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    amount = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(amount) if broken else amount
    entries = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cust"),
        F.pmod(F.xxhash64("o_orderkey"), F.lit(openings)).alias("part"),
        F.lit(1).alias("at"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(";D;"), amount).alias("line"),
    )
    balance = F.format_string("opening;%s;%d", F.when(F.col("c_acctbal") < 0, "D").otherwise("C"), F.abs(F.round(F.col("c_acctbal") * 100)).cast("bigint"))
    start = F.concat(F.lit("*"), F.col("c_custkey").cast("string"), F.lit("\n"), balance)
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("at"), start.alias("line"))
    again = entries.where("part > 0").select("cust", "part", F.lit(0).alias("at"), F.concat(F.lit("*"), F.col("cust").cast("string")).alias("line")).distinct()
    path = new_folder(spark, "statements")
    every = first.unionByName(again).unionByName(entries)
    lines = (every.repartitionByRange("cust", "part") if by_range else every.repartition("cust", "part")).sortWithinPartitions("cust", "part", "at")
    lines.select(F.col("line").alias("value")).write.text(path)
    return path


#: Bytes of a slice of a statement file at least, and slices at most, which the driver lists: larger inputs have larger slices.
SLICE = 256 * 1024
MAX_SLICES = 50_000


def statement_source(spark: SparkSession, path: str, bounded: bool = False, keep=None, name: str = "tabpact_statements", **how):
    """The entries of statement files, read by user code in slices of a file.

    An account belongs to the slice in which its first line begins; a slice goes on beyond its end until the next
    account. Accounts below the filter are skipped while reading. ``bounded`` has the accounts of each file looked up, which bound its slices; ``keep`` chooses
    among the slices. An entry whose amount is no number is a reject.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    files = [(f.getPath().toString(), f.getLen()) for f in found if f.getPath().getName().startswith("part-")]
    size_of = max(SLICE, sum(size for _, size in files) // MAX_SLICES)
    slices = [(uri, start, min(size, start + size_of)) for uri, size in files for start in range(0, size, size_of)]

    slices = slices if keep is None else [s for i, s in enumerate(slices) if keep(i)]
    if bounded:
        opened = spark.read.text(path).where(F.col("value").startswith("*")).select(F.col("_metadata.file_path").alias("file"), F.substring("value", 2, 20).cast("bigint").alias("cust"))
        accounts = {r["file"].removeprefix("file://"): (r["lo"], r["hi"]) for r in opened.groupBy("file").agg(F.min("cust").alias("lo"), F.max("cust").alias("hi")).collect()}
        how["bounds"] = lambda part: {"cust_id": accounts[part[0].removeprefix("file://").removeprefix("file:")]} if part[0].removeprefix("file://").removeprefix("file:") in accounts else {}

    def read(part: tuple[str, int, int], min_cust: int | None = None, **filters) -> Iterator:
        import io

        from pyarrow import fs

        uri, start, end = part
        files, name = fs.FileSystem.from_uri(uri)
        with io.BufferedReader(files.open_input_file(name)) as raw:
            raw.seek(max(0, start - 1))
            at = start if start == 0 else start - 1 + len(raw.readline())
            account = None
            while line := raw.readline():
                if line.startswith(b"*"):
                    if at >= end:
                        return
                    account = int(line[1:])
                elif account is not None and (min_cust is None or account >= min_cust):
                    entry, kind, cents = line.decode().rstrip("\n").split(";")
                    yield (account, entry, kind, int(cents)) if cents.isdigit() else Reject(f"{account};{entry};{kind};{cents}", "the amount is no number")
                at += len(line)

    return record_source(name, "cust_id bigint, entry string, kind string, cents bigint", slices, read, **how)


def _statement_plan(spark: SparkSession, sf_dir: str, name: str, **filters) -> DataFrame:
    folder = new_folder(spark, name)
    plan = Pipeline("Statements").source("entries", STATEMENTS, custom=statement_source(spark, _statement_files(spark, sf_dir)), **filters)
    plan.sink("out", DelimitedSink(folder)).pipe("entries -> out").run(spark)
    return spark.read.schema(STATEMENTS.schema()).csv(folder)


@query(_STATEMENTS.format(where="IS NOT NULL"))
def custom_source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file format that only user code can read, sliced below the size of a file."""
    return _statement_plan(spark, sf_dir, "statement-rows")


@query(_STATEMENTS.format(where=">= 700"))
def record_source_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a filter that the user's code gets and applies while reading."""
    return _statement_plan(spark, sf_dir, "statement-rows", min_cust=700)


SOME_STATEMENTS = SourceContract(
    "SomeStatements", columns=STATEMENTS.columns, filters=[FilterParam("from_cust", "bigint", predicate=lambda v: F.col("cust_id") >= v)]
)


@query(_STATEMENTS.format(where=">= 1200"))
def record_source_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the rows of user code: it reaches the reader, and slices with smaller accounts are never opened."""
    folder = new_folder(spark, "statements-pruned")
    source = statement_source(spark, _statement_files(spark, sf_dir, by_range=True), bounded=True, name="tabpact_bounded_statements")
    plan = Pipeline("Statements").source("entries", SOME_STATEMENTS, custom=source, from_cust=1200)
    plan.sink("out", DelimitedSink(folder)).pipe("entries -> out").run(spark)
    return spark.read.schema(STATEMENTS.schema()).csv(folder)


_BROKEN = "SELECT cust_id, entry, kind, cents FROM (" + _STATEMENTS.format(where=">= 700") + ") WHERE NOT (entry LIKE 'order %' AND coalesce(TRY_CAST(substr(entry, 7) AS BIGINT) % 97, 1) = 0)"
_BROKEN_REJECTS = """SELECT o_custkey || ';order ' || o_orderkey || ';D;n/a' AS record, 'the amount is no number' AS reason
                     FROM orders WHERE o_orderkey % 97 = 0 AND o_custkey >= 700"""


def _broken_statements(spark: SparkSession, sf_dir: str, stream: bool = False) -> str:
    """Statements with entries that user code cannot read, through a pipe that puts those aside; returns its folder."""
    folder = new_folder(spark, "broken-statements")
    source = statement_source(spark, _statement_files(spark, sf_dir, broken=True))
    plan = Pipeline("Statements").source("entries", STATEMENTS, custom=source, rejects_path=f"{folder}/rejects", min_cust=700)
    plan.sink("out", DelimitedSink(f"{folder}/out")).pipe("entries -> out")
    if not stream:
        plan.run(spark)
        return folder
    for q in plan.run_stream(spark, f"{folder}/checkpoint"):
        q.awaitTermination()
    return folder


@query(_BROKEN)
def record_source_rejects_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that user code rejects does not end its slice."""
    return spark.read.schema(STATEMENTS.schema()).csv(f"{_broken_statements(spark, sf_dir)}/out")


@query(_BROKEN_REJECTS)
def record_source_rejects_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected records as read, with the reason."""
    return spark.read.parquet(f"{_broken_statements(spark, sf_dir)}/rejects")


@query(_BROKEN_REJECTS)
def stream_record_source_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream of slices."""
    return spark.read.parquet(f"{_broken_statements(spark, sf_dir, stream=True)}/rejects").select("record", "reason")


def _priced_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with the price as text; every 97th key holds a text that is no number."""
    price = F.when(F.col("o_orderkey") % 97 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))


_PRICED = """WITH priced AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders) """


@query(_PRICED + "SELECT o_orderkey, TRY_CAST(price AS DOUBLE) AS price FROM priced WHERE TRY_CAST(price AS DOUBLE) IS NOT NULL")
def reject_split_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rejects(_priced_as_text(spark, sf_dir), {"price": "double"})[0]


@query(
    _PRICED
    + "SELECT o_orderkey, price, 'price' AS failed FROM priced WHERE price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL"
)
def reject_split_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = split_rejects(_priced_as_text(spark, sf_dir), {"price": "double"})[1]
    return rejects.select("o_orderkey", "price", F.array_join("reject_columns", ",").alias("failed"))


PRICE_FILE = SourceContract("PriceFile", columns=[ColumnSpec("o_orderkey", "bigint"), ColumnSpec("price", "double")])


def _price_file(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "prices")
    _priced_as_text(spark, sf_dir).write.csv(path)
    return path


@query(_PRICED + "SELECT o_orderkey, TRY_CAST(price AS DOUBLE) AS price FROM priced WHERE TRY_CAST(price AS DOUBLE) IS NOT NULL")
def reject_file_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_with_rejects(spark, PRICE_FILE, _price_file(spark, sf_dir), "csv")[0]


@query(_PRICED + "SELECT o_orderkey || ',' || price AS record FROM priced WHERE TRY_CAST(price AS DOUBLE) IS NULL")
def reject_file_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = read_with_rejects(spark, PRICE_FILE, _price_file(spark, sf_dir), "csv")[1]
    return rejects.select(F.coalesce("_corrupt_record", F.col("price").cast("string")).alias("record"))


@query(_PRICED + """SELECT count(*) AS good, (SELECT count(*) FROM priced WHERE price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL) AS bad,
                 true AS failed FROM priced WHERE price IS NULL OR TRY_CAST(price AS DOUBLE) IS NOT NULL""")
def scan_rejects_unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a bad value in a column that nobody asks for: they are counted as rejects, and fail a scan without rejects."""
    path = _price_file(spark, sf_dir)
    good, bad = read_with_rejects(spark, PRICE_FILE, path, "csv")
    counts = good.select("o_orderkey").agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.select(F.lit(1)).agg(F.count(F.lit(1)).alias("bad")))
    try:
        read_source(spark, PRICE_FILE, path, "csv").select("o_orderkey").agg(F.max("o_orderkey")).collect()
        failed = False
    except Exception as exc:
        failed = "MALFORMED" in str(exc)
    return counts.withColumn("failed", F.lit(failed))


LOOSE_PRICES = SourceContract(
    "LoosePrices",
    columns=[ColumnSpec("o_orderkey", "bigint"), ColumnSpec("price", "double", nullable=True, checks=Check("price >= 1000", when_present=True, name="low_price"))],
    filters=[FilterParam("from_key", "bigint", default=None, optional=True, predicate=lambda v: F.col("o_orderkey") >= v)],
)


def _price_pipe(spark: SparkSession, sf_dir: str) -> str:
    """Prices, some of which are no numbers, from a CSV file through a pipe; returns its folder."""
    folder = new_folder(spark, "price-pipe")
    plan = Pipeline("Prices").source(
        "prices", LOOSE_PRICES, _price_file(spark, sf_dir), "csv", policy="drop", rejects_path=f"{folder}/rejects", from_key=500
    )
    plan.sink("out", DelimitedSink(f"{folder}/out")).pipe("prices -> out").run(spark)
    return folder


@query(
    _PRICED + """SELECT o_orderkey, TRY_CAST(price AS DOUBLE) AS price FROM priced
                 WHERE TRY_CAST(price AS DOUBLE) >= 1000 AND o_orderkey >= 500"""
)
def pipe_rejects_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("o_orderkey bigint, price double").csv(f"{_price_pipe(spark, sf_dir)}/out")


@query(_PRICED + "SELECT o_orderkey || ',' || price AS record FROM priced WHERE TRY_CAST(price AS DOUBLE) IS NULL")
def pipe_rejects_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bad value in a nullable column is no NULL."""
    return spark.read.parquet(f"{_price_pipe(spark, sf_dir)}/rejects").select(F.col("_corrupt_record").alias("record"))


# ---------------------------------------------------------------- filters

ORDERS = SourceContract(
    "Orders",
    columns=[
        ColumnSpec("o_orderkey", "bigint"),
        ColumnSpec("o_custkey", "bigint"),
        ColumnSpec("o_orderdate", "timestamp_ntz"),
        ColumnSpec("o_totalprice", "double"),
    ],
    filters=[
        FilterParam(
            "min_price",
            "double",
            default=100_000.0,
            checks=Check(lambda v: v >= 0, "a price is not negative"),
            predicate=lambda v: F.col("o_totalprice") >= v,
        ),
        FilterParam("date_from", "timestamp_ntz", default=None, optional=True, predicate=lambda v: date_range("o_orderdate", lo=v)),
        FilterParam("date_to", "timestamp_ntz", default=None, optional=True, predicate=lambda v: date_range("o_orderdate", hi=v)),
    ],
)
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders "


def _orders(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    return read_source(spark, ORDERS, f"{sf_dir}/orders.parquet", filters=filters)


@query(_ORDERS_SQL + "WHERE o_totalprice >= 250000")
def filter_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, min_price=250000)


@query(_ORDERS_SQL + "WHERE o_totalprice >= 100000")
def filter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)


@query(_ORDERS_SQL + "WHERE o_totalprice >= 0")
def filter_optional_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, min_price=0, date_from=None, date_to=None)


@query(_ORDERS_SQL + "WHERE o_totalprice >= 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, min_price=0, date_from="1996-01-01", date_to="1996-02-01")


@query(EMP + "SELECT employee_id, hire_date, cents FROM emp WHERE termination_date IS NULL")
def filter_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees(spark, sf_dir, exclude_terminations=True).select(
        "employee_id", "hire_date", money_cents("salary").alias("cents")
    )


# ---------------------------------------------------------------- checks

CUSTOMERS = SourceContract(
    "Customers",
    columns=[
        ColumnSpec("c_custkey", "bigint"),
        ColumnSpec("c_name", "string"),
        ColumnSpec(
            "c_acctbal", "double", checks=Check("c_acctbal >= 0", "no customer is in debt", name="balance")
        ),
    ],
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, CUSTOMERS, f"{sf_dir}/customer.parquet")


@query(
    """SELECT c_custkey, 'column' AS scope, 'c_acctbal' AS "column", 'balance' AS check_id,
              'no customer is in debt' AS explain, CAST(c_acctbal AS VARCHAR) AS value
       FROM customer WHERE NOT c_acctbal >= 0"""
)
def check_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_customers(spark, sf_dir), CUSTOMERS, key=["c_custkey"])


LINES = SourceContract(
    "Lines",
    columns=[
        ColumnSpec("l_orderkey", "bigint"),
        ColumnSpec("l_linenumber", "int"),
        ColumnSpec(
            "l_discount",
            "double",
            checks=[
                Check(lambda c: c <= 0.08, "discount is at most 8 percent", name="discount_cap"),
                Check(lambda c: c >= 0, "discount is not negative", name="discount_sign"),
            ],
        ),
        ColumnSpec(
            "l_quantity", "double", checks=Check(lambda c: c <= 45, "at most 45 pieces", name="quantity_cap")
        ),
    ],
)
_LINE_CHECKS = (
    ("l_discount", "discount_cap", "discount is at most 8 percent", "l_discount <= 0.08"),
    ("l_discount", "discount_sign", "discount is not negative", "l_discount >= 0"),
    ("l_quantity", "quantity_cap", "at most 45 pieces", "l_quantity <= 45"),
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, LINES, f"{sf_dir}/lineitem.parquet")


def _line_violations(where: str = "NOT {rule}") -> str:
    return " UNION ALL ".join(
        f"""SELECT l_orderkey, l_linenumber, 'column' AS scope, '{column}' AS "column", '{name}' AS check_id,
            '{explain}' AS explain, CAST({column} AS VARCHAR) AS value FROM lineitem WHERE {where.format(rule=rule)}"""
        for column, name, explain, rule in _LINE_CHECKS
    )


@query(_line_violations())
def check_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_lines(spark, sf_dir), LINES, key=["l_orderkey", "l_linenumber"])


@query(
    """SELECT l_orderkey, l_linenumber, 'column' AS scope,
       CASE WHEN l_discount > 0.08 OR l_discount < 0 THEN 'l_discount' ELSE 'l_quantity' END AS "column",
       CASE WHEN l_discount > 0.08 THEN 'discount_cap' WHEN l_discount < 0 THEN 'discount_sign'
            ELSE 'quantity_cap' END AS check_id,
       CASE WHEN l_discount > 0.08 THEN 'discount is at most 8 percent' WHEN l_discount < 0 THEN 'discount is not negative'
            ELSE 'at most 45 pieces' END AS explain,
       CAST(CASE WHEN l_discount > 0.08 OR l_discount < 0 THEN l_discount ELSE l_quantity END AS VARCHAR) AS value
       FROM lineitem WHERE l_discount > 0.08 OR l_discount < 0 OR l_quantity > 45"""
)
def check_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_violation(_lines(spark, sf_dir), LINES, key=["l_orderkey", "l_linenumber"])


def _summary_sql(source: str, checks: list[tuple[str, str | None, str, str, str, str]]) -> str:
    """checks: scope, column, check id, explain, failed condition, skipped condition."""
    quote = lambda text: "NULL" if text is None else f"'{text}'"
    return " UNION ALL ".join(
        f"""SELECT {quote(scope)} AS scope, CAST({quote(column)} AS VARCHAR) AS "column", {quote(name)} AS check_id,
            {quote(explain)} AS explain, count(*) FILTER (WHERE ({skipped}) IS NOT TRUE) AS tested,
            count(*) FILTER (WHERE {failed}) AS failed, count(*) FILTER (WHERE {skipped}) AS skipped FROM {source}"""
        for scope, column, name, explain, failed, skipped in checks
    )


@query(
    _summary_sql(
        "lineitem",
        [
            ("required", c, f"{c}.required", "a value is required", f"{c} IS NULL", "FALSE")
            for c in ("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
        ]
        + [("column", column, name, explain, f"NOT {rule}", f"{column} IS NULL") for column, name, explain, rule in _LINE_CHECKS],
    )
)
def check_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_summary(_lines(spark, sf_dir), LINES)


RETURNS = SourceContract(
    "Returns",
    columns=[
        ColumnSpec("l_orderkey", "bigint"),
        ColumnSpec("l_linenumber", "int"),
        ColumnSpec("l_returnflag", "string"),
        ColumnSpec("l_linestatus", "string"),
    ],
    column_checks=Check(
        "NOT (l_returnflag = 'R' AND l_linestatus = 'O')", "an open line is not returned", name="open_return"
    ),
)


@query(
    """SELECT l_orderkey, l_linenumber, 'row' AS scope, CAST(NULL AS VARCHAR) AS "column", 'open_return' AS check_id,
              'an open line is not returned' AS explain, CAST(NULL AS VARCHAR) AS value
       FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'"""
)
def check_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_source(spark, RETURNS, f"{sf_dir}/lineitem.parquet")
    return violations(rows, RETURNS, key=["l_orderkey", "l_linenumber"])


TENURE = SourceContract(
    "Tenure",
    columns=[
        ColumnSpec("employee_id", "string"),
        ColumnSpec("hire_date", "date"),
        ColumnSpec(
            "termination_date",
            "date",
            nullable=True,
            checks=Check(
                "termination_date > date_add(hire_date, 60)", "kept for 60 days", when_present=True, name="tenure"
            ),
        ),
    ],
)


@query(
    EMP
    + """SELECT employee_id, 'column' AS scope, 'termination_date' AS "column", 'tenure' AS check_id,
         'kept for 60 days' AS explain, term AS value FROM cells WHERE NOT termination_date > hire_date + 60"""
)
def check_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(employees(spark, sf_dir), TENURE, key=["employee_id"])


@query(
    EMP
    + f"""SELECT employee_id, 'column' AS scope, 'employee_id' AS "column", 'employee_id.form' AS check_id,
          'SID and six digits' AS explain, employee_id AS value FROM emp WHERE NOT {GOOD_ID}"""
)
def check_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(employees(spark, sf_dir), EMPLOYMENT, key=["employee_id"])


DOCUMENTS = SourceContract(
    "Documents",
    columns=[
        ColumnSpec("doc_id", "bigint"),
        ColumnSpec(
            "text",
            "string",
            checks=[
                Check(lambda c: min_len(c, 200, "chars"), "at least 200 characters", name="chars"),
                Check(lambda c: min_len(c, 210), "at least 210 bytes", name="bytes"),
            ],
        ),
    ],
)


@query(
    """SELECT doc_id, 'chars' AS check_id, 'at least 200 characters' AS explain FROM documents WHERE length(text) < 200
       UNION ALL SELECT doc_id, 'bytes', 'at least 210 bytes' FROM documents WHERE strlen(text) < 210"""
)
def check_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_source(spark, DOCUMENTS, f"{sf_dir}/documents.parquet")
    return violations(documents, DOCUMENTS, key=["doc_id"]).select("doc_id", "check_id", "explain")


TITLED = SourceContract(
    "Titled",
    columns=[
        ColumnSpec("employee_id", "string"),
        ColumnSpec("job_title", "string", checks=Check(lambda c: c == "clerk", "all are clerks", name="clerk")),
    ],
)


@query(
    EMP
    + """SELECT employee_id, 'required' AS scope, 'job_title' AS "column", 'job_title.required' AS check_id,
         'a value is required' AS explain, CAST(NULL AS VARCHAR) AS value FROM emp WHERE job_title IS NULL"""
)
def check_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = employees(spark, sf_dir).withColumn("job_title", map_get("meta", "job_title"))
    return violations(titled, TITLED, key=["employee_id"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def enforce_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce(_customers(spark, sf_dir), CUSTOMERS, "quarantine")[0]


@query("SELECT c_custkey, c_name, c_acctbal, 'balance' AS broken FROM customer WHERE (c_acctbal >= 0) IS NOT TRUE")
def enforce_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = enforce(_customers(spark, sf_dir), CUSTOMERS, "quarantine")[1]
    ids = F.array_join(F.transform("violations", lambda v: v["check_id"]), ",")
    return bad.withColumn("broken", ids).drop("violations")


@query(
    """SELECT c_custkey, 'column' AS scope, 'c_acctbal' AS "column", 'balance' AS check_id, 'no customer is in debt' AS explain
       FROM customer WHERE (c_acctbal >= 0) IS NOT TRUE"""
)
def policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows go through a pipe, their violations to a table of their own."""
    folder = new_folder(spark, "report")
    plan = Pipeline("Report").source(
        "customers", CUSTOMERS, f"{sf_dir}/customer.parquet", policy="report", bad_path=f"{folder}/report", key=["c_custkey"]
    )
    plan.sink("out", DelimitedSink(f"{folder}/out")).pipe("customers -> out").run(spark)
    return spark.read.parquet(f"{folder}/report").drop("value")


BARE = SourceContract("Bare", [ColumnSpec("c_custkey", "bigint", nullable=True), ColumnSpec("c_name", "string", nullable=True)])


@query("SELECT c_custkey, c_name FROM customer")
def policy_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default policy lets everything through where there is no rule to break."""
    path = new_folder(spark, "bare")
    Pipeline("Bare").source("all", BARE, f"{sf_dir}/customer.parquet").sink("out", DelimitedSink(path)).pipe("all -> out").run(spark)
    return spark.read.schema(BARE.schema()).csv(path)


# ---------------------------------------------------------------- mapping, money, formats

@query(
    EMP
    + """SELECT employee_id AS "Employee ID", hire_date AS "Hire Date", termination_date AS "Termination Date",
         salary AS "Salary", department AS "Department", job_title AS "Job Title" FROM cells"""
)
def record_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_record(employees(spark, sf_dir), FIELDS)
    return mapped.withColumn("Salary", F.col("Salary").cast("string"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent,
              json_extract_string(props, '$.k') AS k_of_map, CAST(NULL AS VARCHAR) AS absent_of_map FROM events"""
)
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props", json_map("props").alias("meta"))
    return events.select(
        "event_id",
        json_get("props", "k").alias("k"),
        json_get("props", "absent").alias("absent"),
        map_get("meta", "k").alias("k_of_map"),
        map_get("meta", "absent").alias("absent_of_map"),
    )


MIXED = SourceContract(
    "Mixed",
    columns=[
        ColumnSpec("event_id", "bigint"),
        ColumnSpec("props", "variant", nullable=True, source="try_parse_json(props)", checks=Check(lambda c: any_get(c, "k", "bigint") < 95, when_present=True, name="k_cap")),
        ColumnSpec(
            "meta",
            "variant",
            source=lambda: any_of(
                F.struct(
                    F.col("event_type").alias("kind"),
                    F.when(F.col("value") >= 10, F.col("value")).alias("value"),
                    (F.col("user_id") % 2 == 0).alias("even"),
                    F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("it's"),
                )
            ),
        ),
    ],
)


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, CASE WHEN value >= 10 THEN value END AS value,
              user_id % 2 = 0 AS even, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS quoted,
              CAST(NULL AS BIGINT) AS absent, CAST(NULL AS BIGINT) AS kind_as_number
       FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 95 OR json_extract(props, '$.k') IS NULL"""
)
def map_of_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in maps whose values have types of their own: typed values, absent keys, a value of another type, a check on one of them."""
    checked, _ = enforce(read_source(spark, MIXED, f"{sf_dir}/events.parquet"), MIXED, "drop")
    return map_record(
        checked,
        [
            ("event_id", "event_id"),
            ("k", lambda: any_get("props", "k", "bigint")),
            ("kind", lambda: any_get("meta", "kind", "string")),
            ("value", lambda: any_get("meta", "value", "double")),
            ("even", lambda: any_get("meta", "even", "boolean")),
            ("quoted", lambda: any_get("meta", "it's", "string")),
            ("absent", lambda: any_get("props", "absent", "bigint")),
            ("kind_as_number", lambda: any_get("meta", "kind", "bigint")),
        ],
    )


@query(
    """WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
       SELECT o_orderkey, cents // 100 AS dollar, cents % 100 AS cent, cents, cents AS rebuilt,
              CAST(cents // 100 AS DOUBLE) + CAST(cents % 100 AS DOUBLE) / 100 AS amount FROM c"""
)
def money_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = table(spark, sf_dir, "orders").select("o_orderkey", money_from_double("o_totalprice").alias("m"))
    return priced.select(
        "o_orderkey",
        money_dollar("m").alias("dollar"),
        money_cent("m").cast("bigint").alias("cent"),
        money_cents("m").alias("cents"),
        money_cents(money(money_dollar("m"), money_cent("m"))).alias("rebuilt"),
        money_double("m").alias("amount"),
    )


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer WHERE round(c_acctbal * 100) < 0")
def money_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    invalid = customers.where(F.col("c_acctbal").isNotNull() & money_from_double("c_acctbal").isNull())
    return invalid.select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))


@query(EMP + "SELECT employee_id, strftime(hire_date, '%d.%m.%Y') AS hired, strftime(termination_date, '%Y/%j') AS left_on FROM emp")
def date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees(spark, sf_dir).select(
        "employee_id",
        fmt_date("hire_date", "%d.%m.%Y").alias("hired"),
        fmt_date("termination_date", "%Y/%j").alias("left_on"),
    )


@query(EMP + "SELECT employee_id, coalesce(term, 'still here') AS term, coalesce(job_title, '') AS job_title FROM cells")
def null_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employees(spark, sf_dir).select(
        "employee_id",
        fmt_none("termination_date", "still here").alias("term"),
        fmt_none(map_get("meta", "job_title")).alias("job_title"),
    )


@query(
    EMP
    + """SELECT employee_id, strftime(hire_date, '%d %b %Y') AS hire_date,
         coalesce(strftime(termination_date, '%d %b %Y'), '-') AS termination_date, salary || ' USD' AS salary,
         '{"department":"' || department || '"' || CASE WHEN job_title IS NULL THEN '' ELSE ',"job_title":"clerk"' END
         || '}' AS meta FROM cells"""
)
def format_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatters = {
        "date": lambda c: fmt_date(c, "%d %b %Y"),
        "decimal": lambda c: F.concat(c.cast("string"), F.lit(" USD")),
    }
    return format_cells(employees(spark, sf_dir), formatters, none_text="-")


@query(
    EMP
    + """SELECT concat_ws(';', employee_id, hire, coalesce(term, 'none'), salary, department, coalesce(job_title, 'none'))
         AS line FROM cells"""
)
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_rows(map_record(employees(spark, sf_dir), FIELDS), delimiter=";", none_text="none")


def _quoted_sql(column: str, delimiter: str) -> str:
    special = " OR ".join(f"contains({column}, {s})" for s in ("'\"'", f"'{delimiter}'", "chr(10)", "chr(13)"))
    return f"""CASE WHEN {special} THEN '"' || replace({column}, '"', '""') || '"' ELSE {column} END"""


@query(
    f"""SELECT concat_ws(',', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), {_quoted_sql("coalesce(role, '')", ",")},
        {_quoted_sql("coalesce(text, '')", ",")}) AS line FROM conversations"""
)
def render_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with delimiters, quotes and line ends in it."""
    return render_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query(
    """SELECT vec_id, len(embedding) || ' numbers, ' || len(list_filter(embedding, lambda x: x > 0)) || ' above zero' AS cell,
              CASE WHEN vec_id % 7 <> 0 THEN CAST(9007199254740993 + vec_id AS VARCHAR) END AS number FROM embeddings"""
)
def python_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made by plain Python functions: of an array, and of a nullable number that no double holds."""
    rows = table(spark, sf_dir, "embeddings")
    number = F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") + F.lit(9007199254740993))
    as_cell = python_formatter(lambda v: f"{len(v)} numbers, {sum(x > 0 for x in v)} above zero")
    return rows.select("vec_id", as_cell(F.col("embedding")).alias("cell"), python_formatter(str)(number).alias("number"))


# ---------------------------------------------------------------- row numbers

@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rec_num FROM orders")
def row_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return with_sequence(orders, ["o_orderdate", "o_orderkey"], rows_per_range=ROWS_PER_RANGE).select("o_orderkey", "rec_num")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 999 AS n FROM orders")
def row_sequence_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    numbered = with_sequence(
        orders, ["o_totalprice", "o_orderkey"], start=1000, name="n", ascending=[False, True], rows_per_range=ROWS_PER_RANGE
    )
    return numbered.select("o_orderkey", "n")


@query(
    """SELECT l_returnflag, min(n) AS first_number, max(n) AS last_number, count(DISTINCT n) AS numbers FROM
       (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag"""
)
def row_sequence_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers over a key with three values, each of which holds a third of all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag")
    numbered = with_sequence(lines, "l_returnflag", name="n", rows_per_range=ROWS_PER_RANGE)
    return numbered.groupBy("l_returnflag").agg(
        F.min("n").alias("first_number"), F.max("n").alias("last_number"), F.countDistinct("n").alias("numbers")
    )


# ---------------------------------------------------------------- sinks and pipelines

_HEADER_SQL = ", ".join(f'{expr} AS "{name}"' for expr, name in zip(
    ("CAST(n AS VARCHAR)", "employee_id", "hire", "term", "salary", "department", "job_title"), HEADER
))


@query(
    EMP
    + f"""SELECT {_HEADER_SQL} FROM (SELECT *, row_number() OVER (ORDER BY hire_date, employee_id) AS n FROM cells)"""
)
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All employment records written as delimited text and read back; an empty cell is NULL again."""
    path = new_folder(spark, "roundtrip")
    sink = DelimitedSink(
        path, header=HEADER, row_sequence=RowSequence(("Hire Date", "Employee ID"), rows_per_range=ROWS_PER_RANGE)
    )
    sink.adapt(FIELDS).write(employees(spark, sf_dir))
    schema = T.StructType([T.StructField(name, T.StringType()) for name in HEADER])
    return spark.read.schema(schema).csv(path, header=True, escape='"')


@query(
    EMP.rstrip()
    + f""", numbered AS (SELECT *, row_number() OVER (ORDER BY hire_date, employee_id) AS n FROM cells)
          SELECT {_HEADER_SQL}, p.partitions, (SELECT sum(length(concat_ws(',', n, employee_id, hire, coalesce(term, ''), salary, department, coalesce(job_title, ''))) + 1)
                 + {len(','.join(HEADER)) + 3} FROM numbered) AS bytes
          FROM numbered, (VALUES (1), (8), (64)) AS p(partitions)"""
)
def delimited_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All employment records in one file, written by many tasks, for inputs of 1, 8 and 64 partitions; with the size of the file."""
    folder, schema = new_folder(spark, "single"), T.StructType([T.StructField(name, T.StringType()) for name in HEADER])
    read = []
    for partitions in (1, 8, 64):
        path = f"{folder}/{partitions}.csv"
        sequence = RowSequence(("Hire Date", "Employee ID"), rows_per_range=ROWS_PER_RANGE)
        plan = Pipeline("Single").source("er", EMPLOYMENT, custom=custom_source("repartitioned", lambda spark, **_: employees(spark, sf_dir).repartition(partitions, "employee_id")), policy="report", bad_path=f"{folder}/bad{partitions}")
        plan.sink("csv", DelimitedSink(path, header=HEADER, row_sequence=sequence, single_file=True)).adapter("feed", onto="csv", mapping=FIELDS).pipe("er -> feed").run(spark)
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()
        rows = spark.read.schema(schema).csv(path, header=True, escape='"')
        read.append(rows.withColumns({"partitions": F.lit(partitions), "bytes": F.lit(size).cast("bigint")}))
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, line ends and quotes included, through a delimited file and back."""
    path = new_folder(spark, "texts")
    DelimitedSink(path, delimiter="\t").write(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return spark.read.schema("doc_id string, text string, lang string").csv(path, sep="\t", escape='"', multiLine=True)


@query(
    EMP
    + f"""SELECT {_HEADER_SQL} FROM (SELECT *, row_number() OVER (ORDER BY hire_date, employee_id) AS n FROM cells
          WHERE termination_date IS NULL AND {GOOD_ID}
          AND hire_date >= DATE '1996-01-01' AND hire_date < DATE '1996-02-01')"""
)
def adapter_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample plan end to end: scan, filter, check, map, number, format, write; read back."""
    path = new_folder(spark, "feed")
    feed(f"{sf_dir}/orders.parquet", path, exclude_terminations=True, **MONTH).run(spark)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in HEADER])
    return spark.read.schema(schema).csv(path, header=True, escape='"')


@query(
    EMP
    + f"""SELECT concat_ws(',', CAST(n AS VARCHAR), employee_id, hire, coalesce(term, ''), salary, department,
          coalesce(job_title, '')) AS line
          FROM (SELECT *, row_number() OVER (ORDER BY hire_date, employee_id) AS n FROM cells WHERE {GOOD_ID})"""
)
def adapter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample plan over all records, up to the lines of the file."""
    path = new_folder(spark, "lines")
    feed(f"{sf_dir}/orders.parquet", path).run(spark)
    written = spark.read.text(path)
    # Each file starts with the header; all other lines start with a number.
    return written.where(F.col("value").rlike("^[0-9]")).select(F.col("value").alias("line"))


class _ParquetRecords:
    """Takes records one by one and writes them in batches to a file of its own attempt."""

    def __init__(self, folder: str, schema: str, partition: int, attempt: int):
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root)
        self.name = f"{partition}-{attempt}.parquet"
        self.path, self.schema = f"{root}/{self.name}", schema
        self.rows: list[dict] = []
        self.writer = None

    def put(self, row) -> None:
        self.rows.append(row.asDict())
        if len(self.rows) == 10_000:
            self._flush()

    def _flush(self) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in self.schema.split(", "))])
        if self.writer is None:
            self.writer = pq.ParquetWriter(self.path, schema, filesystem=self.files)
        self.writer.write_table(pa.Table.from_pylist(self.rows, schema))
        self.rows = []

    def done(self) -> str:
        self._flush()
        self.writer.close()
        return self.name


def _record_sink(spark: SparkSession, folder: str, schema: str, name: str):
    """A user-defined sink that publishes the files of one attempt per partition by a manifest.

    Writing the manifest again, after a failure in between, gives the same one.
    """
    uri = qualified(spark, folder)

    def commit(results: list[str], batch_id: int = 0) -> None:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(f"{root}/manifests")
        with files.open_output_stream(f"{root}/manifests/{batch_id}") as out:
            out.write("\n".join(sorted(results)).encode())

    return custom_sink(name, lambda part, attempt: _ParquetRecords(f"{uri}/files", schema, part, attempt), commit)


def _published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records of the files that the manifests name."""
    named = spark.read.text(f"{folder}/manifests/*").where("value <> ''").select(F.col("value").alias("_name")).distinct()
    records = spark.read.schema(schema).parquet(f"{folder}/files").withColumn("_name", F.col("_metadata.file_name"))
    return records.join(F.broadcast(named) if named.count() <= 100_000 else named, "_name", "left_semi").drop("_name")


_ACCOUNTS = "c_custkey bigint, c_name string, c_acctbal double"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def custom_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good customers through a user-defined sink that publishes its files on commit; read back."""
    folder = new_folder(spark, "custom-sink")
    sink = _record_sink(spark, folder, _ACCOUNTS, "tabpact_parquet_records")
    plan = Pipeline("CustomSink").source("customers", CUSTOMERS, f"{sf_dir}/customer.parquet", policy="drop")
    plan.sink("records", sink).pipe("customers -> records").run(spark)
    return _published(spark, folder, _ACCOUNTS)


class _Limited:
    """Takes accounts down to a debt, refuses others one by one."""

    def __init__(self, inner: _ParquetRecords):
        self.inner = inner

    def put(self, row) -> None:
        if row.c_acctbal < -500:
            raise RefusedError("too much debt")
        self.inner.put(row)

    def done(self) -> str:
        return self.inner.done()


def _refusing_sink(spark: SparkSession, sf_dir: str):
    """All customers through a user-defined sink that refuses some; returns its folder and the sink."""
    folder = new_folder(spark, "refusing-sink")
    plain = _record_sink(spark, folder, _ACCOUNTS, "tabpact_refusing_records")
    sink = custom_sink(plain.name, lambda part, attempt: _Limited(plain.open_writer(part, attempt)), plain.on_commit, rejects_path=f"{folder}/refused")
    plan = Pipeline("Refusing").source("customers", CUSTOMERS, f"{sf_dir}/customer.parquet", policy="report", bad_path=f"{folder}/bad", key=["c_custkey"])
    plan.sink("records", sink).pipe("customers -> records").run(spark)
    return folder, sink


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= -500")
def custom_sink_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that the sink refuses does not stop the others."""
    return _published(spark, _refusing_sink(spark, sf_dir)[0], _ACCOUNTS)


@query("SELECT c_custkey, c_name, c_acctbal, 'too much debt' AS reason FROM customer WHERE c_acctbal < -500")
def custom_sink_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refused records with the reason."""
    refused = _refusing_sink(spark, sf_dir)[1].refused(spark)
    return refused.select(F.from_json("record", _ACCOUNTS).alias("r"), "reason").select("r.*", "reason")


@query(
    """SELECT c_custkey, 0 AS outputs_of_failed_run FROM customer WHERE c_acctbal >= 0"""
)
def sinks_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks of which the second fails in the middle of its rows: nothing is there. Then the same run with a sink that holds: all is there."""
    folder = new_folder(spark, "all-or-nothing")

    class Failing:
        def put(self, row):
            if row.c_custkey % 50 == 0:
                raise RuntimeError("the sink broke")

        def done(self):
            return None

    def plan(second) -> Pipeline:
        made = Pipeline("Both").source("customers", CUSTOMERS, f"{sf_dir}/customer.parquet", policy="quarantine", bad_path=f"{folder}/bad")
        return made.sink("lines", DelimitedSink(f"{folder}/lines")).sink("records", second).pipe("customers -> lines").pipe("customers -> records")

    try:
        plan(custom_sink("tabpact_failing_records", lambda part, attempt: Failing())).run(spark)
        raise AssertionError("the run was to fail")
    except AssertionError:
        raise
    except Exception:
        files = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = files.getFileSystem(spark._jsc.hadoopConfiguration())
        left = len(list(system.listStatus(files))) if system.exists(files) else 0
    plan(_record_sink(spark, folder, _ACCOUNTS, "tabpact_holding_records")).run(spark)
    keys = spark.read.schema(_ACCOUNTS).csv(f"{folder}/lines").select("c_custkey")
    records = _published(spark, folder, _ACCOUNTS).select("c_custkey")
    return keys.intersect(records).withColumn("outputs_of_failed_run", F.lit(left))


_WINDOWS = (("jan", "1996-01-01", "1996-02-01"), ("q1", "1996-01-01", "1996-04-01"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS binding, o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
            WHERE o_totalprice >= 0 AND o_orderdate >= TIMESTAMP '{lo}' AND o_orderdate < TIMESTAMP '{hi}'"""
        for name, lo, hi in _WINDOWS
    )
)
def two_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source bound twice with different values, each to its own sink."""
    folder = new_folder(spark, "two-bindings")
    plan = Pipeline("TwoBindings")
    for name, lo, hi in _WINDOWS:
        plan.source(name, ORDERS, f"{sf_dir}/orders.parquet", min_price=0, date_from=lo, date_to=hi)
        plan.sink(f"{name}_out", DelimitedSink, path=f"{folder}/{name}").pipe(name, f"{name}_out")
    plan.run(spark)
    tagged = [spark.read.schema(ORDERS.schema()).csv(f"{folder}/{name}").select(F.lit(name).alias("binding"), "*") for name, _, _ in _WINDOWS]
    return tagged[0].unionByName(tagged[1])


@query(
    " UNION ALL ".join(
        f"""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
            WHERE o_totalprice >= 0 AND o_orderdate >= TIMESTAMP '{lo}' AND o_orderdate < TIMESTAMP '{hi}'"""
        for _, lo, hi in _WINDOWS
    )
)
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources appended into one sink."""
    folder = new_folder(spark, "fan-in")
    plan = Pipeline("FanIn").sink("out", DelimitedSink, path=folder)
    for name, lo, hi in _WINDOWS:
        plan.source(name, ORDERS, f"{sf_dir}/orders.parquet", min_price=0, date_from=lo, date_to=hi).pipe(name, "out")
    plan.run(spark)
    return spark.read.schema(ORDERS.schema()).csv(folder)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'a' AS sink FROM customer WHERE c_acctbal >= 0
       UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'b' FROM customer WHERE c_acctbal >= 0"""
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source into two sinks with different formats, read back."""
    folder = new_folder(spark, "fan-out")
    plan = Pipeline("FanOut").source("customers", CUSTOMERS, f"{sf_dir}/customer.parquet", policy="drop")
    plan.sink("a", DelimitedSink(f"{folder}/a")).sink("b", DelimitedSink, path=f"{folder}/b", delimiter="|", eol="\r\n")
    plan.pipe("customers -> a").pipe("customers", "b").run(spark)
    read = spark.read.schema("id string, name string, balance string")
    return (
        read.csv(f"{folder}/a")
        .select("id", "name", F.lit("a").alias("sink"))
        .union(read.csv(f"{folder}/b", sep="|", lineSep="\r\n").select("id", "name", F.lit("b")))
    )


# ---------------------------------------------------------------- lineage over edge tables

def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From nation to nation, if over all line items it sells more to the other one than it buys from there."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sold = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    one, other = F.least("s_nationkey", "c_nationkey"), F.greatest("s_nationkey", "c_nationkey")
    signed = F.when(F.col("s_nationkey") < F.col("c_nationkey"), F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    net = sold.where("s_nationkey <> c_nationkey").groupBy(one.alias("one"), other.alias("other")).agg(F.sum(signed).alias("net"))
    gives = F.col("net") > 0
    return net.where("net <> 0").select(F.when(gives, F.col("one")).otherwise(F.col("other")).alias("src"), F.when(gives, F.col("other")).otherwise(F.col("one")).alias("dst"))


_TRADE = """WITH RECURSIVE net AS (
  SELECT least(s_nationkey, c_nationkey) AS one, greatest(s_nationkey, c_nationkey) AS other,
         sum(CASE WHEN s_nationkey < c_nationkey THEN l_quantity ELSE -l_quantity END) AS net
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2
), edges AS (
  SELECT CASE WHEN net > 0 THEN one ELSE other END AS src, CASE WHEN net > 0 THEN other ELSE one END AS dst FROM net WHERE net <> 0
)"""
_CLOSURE = """, reach AS (
  SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src
)
SELECT e.src, e.dst FROM edges e WHERE (e.src = e.dst OR EXISTS (SELECT 1 FROM reach r WHERE r.src = e.dst AND r.dst = e.src))"""


@query(_TRADE + _CLOSURE)
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(trade_edges(spark, sf_dir))


@query(
    _TRADE
    + _CLOSURE
    + """ AND e.src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
          AND e.dst NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"""
)
def cycle_edges_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return cycles(
        trade_edges(spark, sf_dir),
        exempt_src=nations.where("n_regionkey = 1").select("n_nationkey"),
        exempt_dst=nations.where("n_regionkey = 2").select("n_nationkey"),
    )


def goods_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a movement of goods: from the supplier to the customer, or back if returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    moved = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    supplier, customer = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("c"), "o_custkey")
    back = F.col("l_returnflag") == "R"
    return moved.select(
        F.when(back, customer).otherwise(supplier).alias("src"), F.when(back, supplier).otherwise(customer).alias("dst")
    )


_GOODS = """WITH RECURSIVE edges AS (
  SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS src,
                  CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey ELSE 'c' || o_custkey END AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


#: A supplier and a customer whose movements are followed.
STARTS = ("s7", "c10")
_FORWARD = """, fwd AS (
  SELECT src AS start, dst AS node, 1 AS depth FROM edges WHERE src IN ('s7', 'c10')
  UNION SELECT f.start, e.dst, f.depth + 1 FROM fwd f JOIN edges e ON f.node = e.src WHERE f.depth < 25
)"""
_BACKWARD = """, bwd AS (
  SELECT dst AS start, src AS node, 1 AS depth FROM edges WHERE dst IN ('s7', 'c10')
  UNION SELECT b.start, e.src, b.depth + 1 FROM bwd b JOIN edges e ON b.node = e.dst WHERE b.depth < 25
)"""


def _least(cte: str, way: str) -> str:
    return f"SELECT start, node, '{way}' AS direction, min(depth) AS depth FROM {cte} GROUP BY start, node"


@query(_GOODS + _FORWARD + _least("fwd", "forward"))
def trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(goods_edges(spark, sf_dir), STARTS, "forward")


@query(_GOODS + _BACKWARD + _least("bwd", "backward"))
def trace_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(goods_edges(spark, sf_dir), STARTS, "backward")


@query(_GOODS + _FORWARD + _BACKWARD + _least("fwd", "forward") + " UNION ALL " + _least("bwd", "backward"))
def trace_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(goods_edges(spark, sf_dir), STARTS, "both")


@query(
    _GOODS
    + """, debtors AS (SELECT 's' || s_suppkey AS start FROM supplier WHERE s_acctbal < 0
), fwd AS (
  SELECT start AS node, 0 AS depth FROM debtors
  UNION SELECT e.dst, f.depth + 1 FROM fwd f JOIN edges e ON f.node = e.src WHERE f.depth < 25
) SELECT node, min(depth) AS depth FROM fwd GROUP BY node"""
)
def trace_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many movements lie between the suppliers in debt and each party that they reach: one row per node."""
    debtors = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    # A node of its own stands for all debtors, one step before them.
    debt = debtors.select(F.lit("debt").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    reached = trace(goods_edges(spark, sf_dir).union(debt), ["debt"], "forward")
    return reached.select("node", (F.col("depth") - 1).alias("depth"))


@query(
    _GOODS
    + """, fwd AS (
  SELECT src AS start, dst AS node, 1 AS depth FROM edges WHERE src LIKE 's%'
  UNION SELECT f.start, e.dst, f.depth + 1 FROM fwd f JOIN edges e ON f.node = e.src WHERE f.depth < 3
), least AS (SELECT start, node, min(depth) AS depth FROM fwd GROUP BY start, node)
SELECT start, depth, count(*) AS nodes, count(*) FILTER (node = start) AS back FROM least GROUP BY start, depth"""
)
def trace_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier at once: how many parties its goods reach in one, two and three movements, and whether they come back."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    reached = trace(goods_edges(spark, sf_dir), suppliers, "forward", max_depth=3)
    return reached.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node") == F.col("start")).alias("back"))


@query(_GOODS + _CLOSURE)
def cycle_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(goods_edges(spark, sf_dir))


SALES = SourceContract(
    "Sales",
    columns=[
        ColumnSpec("line", "string", source="concat(l_orderkey, '-', l_linenumber)"),
        ColumnSpec("net", "double", source="l_extendedprice * (1 - l_discount)", checks=Check(lambda c: c > 0, "a price is positive")),
        ColumnSpec("tax", "double", source="l_tax"),
        ColumnSpec("shipped", "date", source="CAST(l_shipdate AS date)"),
        ColumnSpec("flag", "string", source="l_returnflag"),
    ],
    column_checks=Check("shipped IS NOT NULL OR flag = 'R'", "what is not shipped was returned"),
    filters=[FilterParam("min_quantity", "double", default=None, optional=True, predicate=lambda v: F.col("l_quantity") >= v)],
)
_SALES_LINEAGE = {
    "Line": "l_orderkey l_linenumber",
    "Gross": "l_extendedprice l_discount l_tax",
    "Month": "l_shipdate",
    "Late tax": "l_shipdate l_tax",
    # The filter, the checks, and that all columns are required.
    "rows": "l_quantity l_orderkey l_linenumber l_extendedprice l_discount l_tax l_shipdate l_returnflag",
}


@query(
    "WITH made(field, name) AS (VALUES "
    + ", ".join(f"('{field}', '{name}')" for field, names in _SALES_LINEAGE.items() for name in names.split())
    + "), kept AS (SELECT * FROM lineitem WHERE l_quantity >= 20), counted AS (UNPIVOT (SELECT "
    + ", ".join(f"count({c}) AS {c}" for c in "l_orderkey l_linenumber l_extendedprice l_discount l_tax l_shipdate l_returnflag l_quantity".split())
    + ' FROM kept) ON * INTO NAME name VALUE n) SELECT field, name AS "column", n AS "values" FROM made JOIN counted USING (name)'
)
def lineage_of_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every field of a report, and for its rows, the stored columns that it is made of, and how many values these have in what the report reads.

    Nothing is declared: the expressions of the source, the filter, the checks and the mapping say it.
    """
    plan = Pipeline("Sales").source("lines", SALES, f"{sf_dir}/lineitem.parquet", policy="drop", min_quantity=20)
    plan.sink("out", DelimitedSink("unused")).adapter(
        "report",
        onto="out",
        mapping=[
            ("Line", "line"),
            ("Gross", "round(net * (1 + tax), 2)"),
            ("Month", lambda: F.date_format("shipped", "yyyy-MM")),
            ("Late tax", lambda: F.when(F.col("shipped") >= F.lit("1998-01-01").cast("date"), F.col("tax"))),
        ],
    ).pipe("lines -> report")
    edges = plan.edges(spark, stored=True)
    fields = ["Line", "Gross", "Month", "Late tax"]
    # What decides on the rows is asked once; it goes into every field.
    values = trace(edges.where(~F.col("src").startswith("rows:")), [f"sink:out.{f}" for f in fields], "backward")
    rows = trace(edges, ["rows:lines"], "backward")
    made = values.unionByName(rows).where(F.col("node").startswith("table:")).select(
        F.when(F.col("start") == "rows:lines", "rows").otherwise(F.substring_index("start", ".", -1)).alias("field"),
        F.substring_index("node", ".", -1).alias("column"),
    )
    stored = table(spark, sf_dir, "lineitem").where("l_quantity >= 20")
    names = sorted({r["column"] for r in made.collect()})
    counts = stored.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column", "values")
    return made.join(F.broadcast(counts), "column").select("field", "column", "values")


# ---------------------------------------------------------------- streams

EVENTS = SourceContract(
    "Events",
    columns=[
        ColumnSpec("event_id", "bigint"),
        ColumnSpec("ts", "timestamp_ntz"),
        ColumnSpec("user_id", "bigint"),
        ColumnSpec("event_type", "string", checks=Check("event_type <> 'error'", "no error event", name="not_error")),
        ColumnSpec("value", "double", checks=Check(lambda c: c < 200, "below 200", name="value_cap")),
    ],
    filters=[FilterParam("min_value", "double", default=None, optional=True, predicate=lambda v: F.col("value") >= v)],
)
_EVENT_FILES = {"pathGlobFilter": "events.parquet"}


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE value >= 10")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, filtered, written by a streaming query that ends when all is read."""
    folder = new_folder(spark, "stream-scan")
    events = stream_source(spark, EVENTS, sf_dir, filters={"min_value": 10}, options=_EVENT_FILES)
    started = (
        events.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    started.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out")


@query(
    """SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS VARCHAR) AS n, CAST(event_id AS VARCHAR) AS event_id,
              event_type FROM events"""
)
def stream_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a delimited sink that numbers them."""
    folder = new_folder(spark, "stream-numbered")
    sink = DelimitedSink(
        f"{folder}/out", row_sequence=RowSequence(("ts", "event_id"), name="n", rows_per_range=ROWS_PER_RANGE)
    )
    events = stream_source(spark, EVENTS, sf_dir, options=_EVENT_FILES)
    stream_sink(events, sink, f"{folder}/checkpoint").awaitTermination()
    written = spark.read.schema("n string, event_id string, ts string, user_id string, event_type string, value string")
    return written.csv(f"{folder}/out/batch_id=*").select("n", "event_id", "event_type")


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """The events in several files, for streams of several batches."""
    path = new_folder(spark, "event-files")
    table(spark, sf_dir, "events").repartitionByRange(6, "event_id").write.parquet(path)
    return path


@query(
    """SELECT CAST(count(*) AS BIGINT) AS "rows", count(*) FILTER (WHERE event_type = 'error') AS not_error,
              count(*) FILTER (WHERE value >= 200) AS value_cap,
              count(*) FILTER (WHERE event_type <> 'error' AND value < 200) AS written,
              count(*) FILTER (WHERE event_type <> 'error' AND value < 200) AS last_number FROM events"""
)
def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline run on a stream of several batches into a numbered sink: the failures counted while it runs, and the rows that came through."""
    folder = new_folder(spark, "stream-checks")
    sequence = RowSequence(("ts", "event_id"), name="n", rows_per_range=ROWS_PER_RANGE)
    plan = (
        Pipeline("StreamChecks")
        .source("events", EVENTS, _event_files(spark, sf_dir), options={"maxFilesPerTrigger": "1"}, policy="drop")
        .sink("out", DelimitedSink(f"{folder}/out", row_sequence=sequence))
        .pipe("events -> out")
    )
    for q in plan.run_stream(spark, f"{folder}/checkpoint"):
        q.awaitTermination()
    counts = check_counts(spark, f"{folder}/checkpoint", "events")
    of = lambda check, what: F.sum(F.when(F.col("check_id") == check, F.col(what)))
    totals = counts.agg(of("rows", "tested").alias("rows"), *[of(c, "failed").alias(c) for c in ("not_error", "value_cap")])
    lines = spark.read.schema("n bigint, event_id bigint").csv(f"{folder}/out/batch_id=*")
    written = lines.agg(F.count(F.lit(1)).alias("written"), F.max("n").alias("last_number"))
    return totals.crossJoin(written)


@query(_STATEMENTS.format(where=">= 700"))
def stream_record_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement files as a stream of slices through a pipe."""
    folder = new_folder(spark, "stream-statements")
    source = statement_source(spark, _statement_files(spark, sf_dir))
    plan = Pipeline("Statements").source("entries", STATEMENTS, custom=source, min_cust=700)
    plan.sink("out", DelimitedSink(f"{folder}/out")).pipe("entries -> out")
    for q in plan.run_stream(spark, f"{folder}/checkpoint"):
        q.awaitTermination()
    return spark.read.schema(STATEMENTS.schema()).csv(f"{folder}/out/batch_id=*")


@query(
    """SELECT 'a' AS sink, event_id, value FROM events WHERE event_type <> 'error' AND value < 200
       UNION ALL SELECT 'b', event_id, value FROM events WHERE event_type <> 'error' AND value < 200
       UNION ALL SELECT 'bad', event_id, value FROM events WHERE NOT (event_type <> 'error' AND value < 200)
       UNION ALL SELECT 'batches', 6, NULL"""
)
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream into two sinks, bad rows aside, from one reading: all outputs have the same batches."""
    folder = new_folder(spark, "stream-fan-out")
    plan = Pipeline("FanOut").source(
        "events", EVENTS, _event_files(spark, sf_dir), options={"maxFilesPerTrigger": "1"}, policy="quarantine", bad_path=f"{folder}/bad"
    )
    for name in ("a", "b"):
        plan.sink(name, DelimitedSink(f"{folder}/{name}")).pipe("events", name)
    (started,) = plan.run_stream(spark, f"{folder}/checkpoint")
    started.awaitTermination()
    rows = [spark.read.schema(EVENTS.schema()).csv(f"{folder}/{n}/batch_id=*").select(F.lit(n).alias("sink"), "event_id", "value") for n in ("a", "b")]
    bad = spark.read.parquet(f"{folder}/bad")
    counted = check_counts(spark, f"{folder}/checkpoint", "events").select("batch_id").distinct()
    both = counted.join(bad.select(F.col("batch_id").cast("bigint").alias("batch_id")).distinct(), "batch_id")
    batches = both.agg(F.lit("batches").alias("sink"), F.count(F.lit(1)).alias("event_id"), F.lit(None).cast("double").alias("value"))
    return rows[0].unionByName(rows[1]).unionByName(bad.select(F.lit("bad").alias("sink"), "event_id", "value")).unionByName(batches)


@query(_STATEMENTS.format(where="IS NOT NULL"))
def stream_record_source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of slices that is stopped and started again, when new slices stand among the old ones: each is read once."""
    folder, path = new_folder(spark, "stream-log"), _statement_files(spark, sf_dir)
    for keep in (lambda i: i % 2 == 1, None):
        source = statement_source(spark, path, keep=keep, name="tabpact_logged_statements", log=f"{folder}/log")
        plan = Pipeline("Statements").source("entries", STATEMENTS, custom=source)
        plan.sink("out", DelimitedSink(f"{folder}/out")).pipe("entries -> out")
        for q in plan.run_stream(spark, f"{folder}/checkpoint"):
            q.awaitTermination()
    return spark.read.schema(STATEMENTS.schema()).csv(f"{folder}/out/batch_id=*")


@query("SELECT event_id AS id, event_type AS kind, value FROM events WHERE value >= 10")
def stream_custom_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream through an adapter into a user-defined sink; read back by its manifests, one per batch."""
    folder = new_folder(spark, "stream-custom")
    schema = "id bigint, kind string, value double"
    sink = _record_sink(spark, folder, schema, "tabpact_stream_records").adapt([("id", "event_id"), ("kind", "event_type"), ("value", "value")])
    events = stream_source(spark, EVENTS, _event_files(spark, sf_dir), filters={"min_value": 10}, options={"maxFilesPerTrigger": "2"})
    stream_sink(events, sink, f"{folder}/checkpoint").awaitTermination()
    return _published(spark, folder, schema)
