import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tabpact import DefinitionError, DelimitedSink, RowSequence, SealedError, custom_sink
from tabpact.sinks.custom import SealedAfterDone

AWKWARD = [(1, 'quote " here'), (2, "comma, here"), (3, " blanks "), (4, "two\nlines"), (5, ""), (6, None), (7, "cr\rhere"), (8, "ö€")]


def lines_of(path):
    return "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "id int, t string").coalesce(1)


def read_back(spark, path, **kw):
    return {int(r.id): r.t for r in spark.read.schema("id string, t string").csv(path, escape='"', multiLine=True, **kw).collect()}


def test_round_trip(spark, awkward, folder):
    DelimitedSink(f"{folder}/o").write(awkward)
    expected = {k: v or None for k, v in AWKWARD}
    got = read_back(spark, f"{folder}/o", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # The reader, not the writer, turns a lone carriage return into a newline.
    assert {k: v for k, v in got.items() if k != 7} == {k: v for k, v in expected.items() if k != 7}
    assert b'"cr\rhere"'.decode() in lines_of(f"{folder}/o")


def test_both_writers_agree(spark, awkward, folder):
    DelimitedSink(f"{folder}/one", header=["a", "b"]).write(awkward)
    DelimitedSink(f"{folder}/three", header=["a", "b"], eol="\r\n;").write(awkward)
    assert lines_of(f"{folder}/one") == lines_of(f"{folder}/three").replace("\r\n;", "\n")


def test_raw_quoting_and_long_delimiter(awkward, folder):
    DelimitedSink(f"{folder}/o", quoting="raw", delimiter="|||", none_fmt="NULL").write(awkward.where("id in (1, 2, 6)"))
    assert lines_of(f"{folder}/o") == '1|||quote " here\n2|||comma, here\n6|||NULL\n'


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_header_is_in_every_file_and_in_an_empty_output(spark, folder, eol):
    df = spark.range(10).select(F.col("id").cast("int"), F.lit("x").alias("t"))
    DelimitedSink(f"{folder}/o", header=["H1", "H2"], eol=eol).write(df.repartition(3))
    files = glob.glob(f"{folder}/o/part-*")
    assert len(files) == 3 and all(open(f, newline="").read().startswith("H1,H2" + eol) for f in files)
    DelimitedSink(f"{folder}/e", header=["H1", "H2"], eol=eol).write(df.limit(0))
    assert lines_of(f"{folder}/e") == "H1,H2" + eol


def test_one_empty_cell_is_not_a_blank_line(spark, folder):
    df = spark.createDataFrame([("",), (None,), ("x",)], "t string").coalesce(1)
    for name, eol in (("a", "\n"), ("b", "\r\n")):
        DelimitedSink(f"{folder}/{name}", eol=eol).write(df)
        assert lines_of(f"{folder}/{name}") == f'""{eol}""{eol}x{eol}'


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_files_are_in_sequence_order(spark, folder, partitions):
    df = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k")).repartition(partitions)
    sink = DelimitedSink(f"{folder}/o", row_sequence=RowSequence(["k"], start=5, rows_per_range=400))
    assert sink.write(df) == 3000
    rows = [tuple(map(int, x.split(","))) for x in lines_of(f"{folder}/o").splitlines()]
    assert [n for n, _ in rows] == list(range(5, 3005))
    assert [k for _, k in rows] == sorted(k for _, k in rows)


def test_parameters_are_checked_at_once():
    with pytest.raises(DefinitionError) as e:
        DelimitedSink("p", delimiter="", eol="", header=[], quoting="odd", mode="maybe")
    assert len(e.value.problems) == 5
    with pytest.raises(DefinitionError, match="unknown date code"):
        DelimitedSink("p", date_fmt="%Q")


def test_header_must_name_every_cell(spark, folder):
    with pytest.raises(DefinitionError, match="2 names but 1 cells"):
        DelimitedSink(folder, header=["a", "b"]).write(spark.range(1))
    with pytest.raises(DefinitionError, match="1 names but 2 cells"):
        DelimitedSink(folder, header=["a"], row_sequence=RowSequence(["id"])).write(spark.range(1))


def test_a_finished_output_is_sealed(spark, folder):
    sink = DelimitedSink(f"{folder}/o")
    sink.write(spark.range(2))
    assert os.path.exists(f"{folder}/o/_SUCCESS")
    with pytest.raises(Exception, match="already exists"):
        sink.write(spark.range(2))


def test_formatters(spark, folder):
    df = spark.sql("SELECT date'2020-03-04' AS d, CAST(NULL AS date) AS e, 1.50BD AS m")
    DelimitedSink(f"{folder}/o", date_fmt=lambda c: F.concat(F.lit("on "), c.cast("string")), none_fmt=lambda c: F.lit("?")).write(df)
    assert lines_of(f"{folder}/o") == "on 2020-03-04,?,1.50\n"


class FolderWriter:
    """Writes to a hidden file and publishes nothing itself."""

    def __init__(self, folder, partition, attempt):
        self.path = f"{folder}/.part-{partition}-{attempt}"
        self.rows = []

    def put(self, row):
        if row.id == 13:
            raise ValueError("unlucky record")
        self.rows.append(row.id)

    def done(self):
        with open(self.path, "w") as f:
            json.dump(self.rows, f)
        return self.path


def folder_sink(folder, name):
    def commit(paths, *batch):
        for path in paths:
            os.replace(path, os.path.join(folder, os.path.basename(path)[1:]))

    def abort(paths, *batch):
        open(f"{folder}/aborted", "w").close()

    return custom_sink(name, lambda part, attempt: FolderWriter(folder, part, attempt), commit, abort)


def test_custom_sink(spark, folder):
    folder_sink(folder, "tabpact_folder").write(spark.range(10).repartition(3))
    parts = glob.glob(f"{folder}/part-*")
    assert len(parts) == 3
    assert sorted(i for p in parts for i in json.load(open(p))) == list(range(10))


def test_a_failed_put_publishes_nothing(spark, folder):
    with pytest.raises(Exception, match="unlucky record"):
        folder_sink(folder, "tabpact_failing").write(spark.range(20).repartition(4))
    assert not glob.glob(f"{folder}/part-*") and os.path.exists(f"{folder}/aborted")


def test_put_after_done():
    class Once:
        def put(self, row):
            pass

        def done(self):
            return 1

    writer = SealedAfterDone(Once())
    writer.put(1)
    assert writer.done() == 1
    with pytest.raises(SealedError):
        writer.put(2)
    with pytest.raises(SealedError):
        writer.done()


def test_adapters_compose(spark, folder):
    sink = DelimitedSink(f"{folder}/o").adapt([("n", "id + 1")]).adapt(lambda df: df.where("id < 3"))
    sink.write(spark.range(10).coalesce(1))
    assert lines_of(f"{folder}/o") == "1\n2\n3\n"


def test_a_written_custom_sink_is_sealed(spark, folder):
    sink = folder_sink(folder, "tabpact_sealed_folder")
    sink.write(spark.range(3))
    with pytest.raises(SealedError):
        sink.write(spark.range(3))


class _Refusing(FolderWriter):
    def put(self, row):
        if row.id % 3 == 0:
            from tabpact import RefusedError

            raise RefusedError(f"a multiple of {3}")
        super().put(row)


def test_refused_records(spark, folder):
    """Only the refused records of committed writes count."""
    import json
    import os

    out, rejects = f"{folder}/out", f"{folder}/refused"
    os.mkdir(out)
    done = []
    sink = custom_sink("tabpact_refusing", lambda part, attempt: _Refusing(out, part, attempt), rejects_path=rejects)
    assert sink.refused(spark).count() == 0
    sink.write(spark.range(12).repartition(3))
    got = sink.refused(spark).collect()
    assert sorted(json.loads(r.record)["id"] for r in got) == list(range(0, 12, 3)) and {r.reason for r in got} == {"a multiple of 3"}
    strict = custom_sink("tabpact_refusing_strictly", lambda part, attempt: _Refusing(out, part, attempt))
    with pytest.raises(Exception, match="a multiple of 3"):
        strict.write(spark.range(12))

    def broken(results):
        raise RuntimeError("no commit")

    failing = custom_sink("tabpact_refusing_failing", lambda part, attempt: _Refusing(out, part, attempt), broken, rejects_path=rejects)
    with pytest.raises(Exception, match="no commit|ommit"):
        failing.write(spark.range(12))
    assert sink.refused(spark).count() == len(got)


def test_publish_modes(spark, folder):
    """A prepared output is not there until it is published; the mode counts then."""
    import os

    rows = spark.range(3)
    for mode, expected in (("overwrite", 3), ("append", 6)):
        sink = DelimitedSink(f"{folder}/o", mode=mode)
        pending = sink.prepare(rows)
        before = spark.read.text(f"{folder}/o").count() if os.path.exists(f"{folder}/o") else 0
        assert before == (0 if mode == "overwrite" else 3)
        pending.publish()
        assert spark.read.text(f"{folder}/o").count() == expected
    with pytest.raises(SealedError, match="exists"):
        DelimitedSink(f"{folder}/o").prepare(rows)
    one, two = (DelimitedSink(f"{folder}/same").prepare(rows) for _ in range(2))
    one.publish()
    with pytest.raises(SealedError, match="exists"):
        two.publish()
    two.cancel()
    assert sorted(os.listdir(folder)) == ["o", "same"]


@pytest.mark.parametrize("header", [None, ("#", "id", "the, text")])
def test_one_file_for_any_partitioning(spark, folder, header):
    """The same bytes, parts without rows included; nothing else is left beside the file."""
    import os

    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", F.concat(F.lit("a, \""), F.col("id").cast("string")).alias("t"))
    written = set()
    for partitions in (1, 8, 64):
        path = f"{folder}/{partitions}.csv"
        DelimitedSink(path, header=header, row_sequence=RowSequence(["id"], name="#", rows_per_range=40), single_file=True).write(rows.repartition(partitions))
        written.add(open(path, "rb").read())
    expected = ("" if header is None else '"#",id,"the, text"\n') + "".join(f'{i + 1},{i},"a, ""{i}"\n' for i in range(500))
    assert written == {expected.encode()}
    assert sorted(os.listdir(folder)) == ["1.csv", "64.csv", "8.csv"]
    assert spark.read.text(f"{folder}/8.csv").count() == 500 + bool(header)
    with pytest.raises(SealedError, match="exists"):
        DelimitedSink(f"{folder}/8.csv", single_file=True).write(rows)
    empty = DelimitedSink(f"{folder}/none.csv", header=header and header[1:], single_file=True)
    empty.prepare(rows.where("id < 0")).publish()
    assert open(f"{folder}/none.csv").read() == ("" if header is None else 'id,"the, text"\n')
    with pytest.raises(DefinitionError, match="appended"):
        DelimitedSink(f"{folder}/x.csv", single_file=True, mode="append")
