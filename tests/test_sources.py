from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseflow import session, sources as src
from caseflow.functions import parse_date
from caseflow.schema import CANON, CANON_NAMES, enforce

from conftest import day, ordered, plan, rows


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(
        [("x", "A", 1.0, 2.0, "3", "5.0"), (None, "B", 1.0, 2.0, None, "n/a")],
        "`Province/State` string, `Country/Region` string, Lat double, Long double, `1/22/20` string, `12/1/20` string",
    )


@pytest.fixture(scope="module")
def sample(make):
    return make(
        (1, "A", None, 1, None, "L"), (2, "A", "x, \"y\"", None, 2, "W"), (2, "B", "z", 4, 0, "W"),
        (1, "A", None, 1, None, "L"),
    )


# -- reshape -------------------------------------------------------------------

def test_value_columns_are_all_but_the_ids(wide):
    assert src.value_columns(wide) == ["1/22/20", "12/1/20"]


def test_wide_to_long_keeps_null_cells_and_reads_numbers(wide):
    out = src.std_wide(wide, source="W")
    assert out.schema == enforce(out).schema and out.columns == CANON_NAMES
    assert ordered(rows(out, "date", "country", "state", "confirmed", "source")) == ordered([
        (dt.date(2020, 1, 22), "A", "x", 3, "W"), (dt.date(2020, 12, 1), "A", "x", 5, "W"),
        (dt.date(2020, 1, 22), "B", None, None, "W"), (dt.date(2020, 12, 1), "B", None, None, "W")])


def test_wide_to_long_needs_no_shuffle(wide):
    assert "Exchange" not in plan(src.wide_to_long(wide))


def test_wide_columns_may_hold_quotes(spark):
    df = spark.createDataFrame([("A", 1, 2)], "id string, `a'b` int, `c``d` bigint")
    assert ordered(rows(src.wide_to_long(df, ids=["id"]))) == [("A", "a'b", 1), ("A", "c`d", 2)]


def test_unreadable_dates_become_null_and_short_years_are_this_century(spark):
    df = spark.createDataFrame([("bad",), ("1/22/20",), ("1/1/95",)], "t string")
    out = rows(df.select(parse_date(F.col("t"), "M/d/yy")))
    assert out == [(None,), (dt.date(2020, 1, 22),), (dt.date(2095, 1, 1),)]


def test_long_feed(spark):
    df = spark.createDataFrame([("2021-01-01", "A", "7.0", "1.0", "9"), ("x", "B", None, None, None)],
                               "date string, location string, total_cases string, total_deaths string, more string")
    assert ordered(rows(src.std_long(df, source="O"))) == ordered([
        (day(1), "A", None, 7, 1.0, None, "O"), (None, "B", None, None, None, None, "O")])


def test_single_feed_accepts_dates_and_timestamps(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1, 5), 3, 1)], "date timestamp_ntz, cases int, deaths int")
    assert rows(src.std_single(df, country="C", source="S")) == [(day(1), "C", None, 3, 1.0, None, "S")]


def test_combine_goes_by_name_and_keeps_duplicates(make, sample):
    other = make((5, "Z", None, 9, 9, "S")).select("source", "confirmed", "country", "date")
    out = src.combine(sample, other)
    assert out.count() == 5
    assert rows(out.where("country = 'Z'"), *CANON_NAMES) == [(day(5), "Z", None, 9, None, None, "S")]


def test_sort_places_nulls_as_asked(sample):
    states = lambda n: [s for (s,) in rows(src.sort_cases(sample.where("country = 'A'"), nulls=n), "state")]
    assert states("first") == [None, None, 'x, "y"'] and states("last") == ['x, "y"', None, None]


def test_copies_of_one_row_are_sorted_by_several_tasks(spark, make):
    df = make((1, "B", None, 1, None, "L")).join(spark.range(0, 200_000, 1, 8).select(F.lit("B").alias("country")), "country")
    df = src.combine(df, make((1, "A", None, 1, None, "L"), (2, "C", None, 1, None, "L")))
    with session.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        tasks = {r.t: (r.n, r.lo, r.hi) for r in src.sort_cases(df).groupBy(F.spark_partition_id().alias("t"))
                 .agg(F.count("*").alias("n"), F.min("country").alias("lo"), F.max("country").alias("hi")).collect()}
    assert sum(n for n, _, _ in tasks.values()) == 200_002 and max(n for n, _, _ in tasks.values()) < 120_000
    spans = [tasks[t][1:] for t in sorted(tasks)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def wide_of(spark, *cells, dates=("1/22/20", "1/23/20")):
    columns = ", ".join(f"`{d}` string" for d in dates)
    return spark.createDataFrame([(s, c, 0.0, 0.0, *v) for s, c, *v in cells], f"`Province/State` string, `Country/Region` string, Lat double, Long double, {columns}")


def test_three_wide_files_lose_no_row(spark):
    out = src.std_wide_measures(
        confirmed=wide_of(spark, ("x", "A", "5", "7"), ("x", "A", "1", None), (None, "B", "2", "3")),
        deaths=wide_of(spark, ("x", "A", "2", "4"), dates=("01/22/20", "1/24/20")),
        recovered=wide_of(spark, (None, "B", "9", None), ("y", "C", None, "8")),
        source="W",
    )
    d = lambda n: dt.date(2020, 1, n)
    assert out.columns == CANON_NAMES
    assert ordered(rows(out)) == ordered([
        (d(22), "A", "x", 1, 2.0, None, "W"), (d(22), "A", "x", 5, None, None, "W"), (d(23), "A", "x", 7, None, None, "W"),
        (d(23), "A", "x", None, None, None, "W"), (d(24), "A", "x", None, 4.0, None, "W"), (d(22), "B", None, 2, None, 9.0, "W"),
        (d(23), "B", None, 3, None, None, "W"), (d(22), "C", "y", None, None, None, "W"), (d(23), "C", "y", None, None, 8.0, "W")])
    assert plan(out).count("Exchange hashpartitioning") == 1


def test_preview_is_a_top_k(sample):
    head = src.preview(sample, 2)
    assert "TakeOrderedAndProject" in plan(head)
    assert rows(head, "country", "state", "date") == [("A", None, day(1)), ("A", None, day(1))]


# -- files -----------------------------------------------------------------------

def test_csv(spark, sample, tmp_path):
    path = str(tmp_path / "csv")
    src.write_csv(sample, path, files=1)
    assert len(list(Path(path).glob("part-*"))) == 1
    expected = ordered(rows(sample))
    assert ordered(rows(src.read_csv(spark, path))) == expected
    texts = src.read_csv_strings(spark, path)
    assert {t for _, t in texts.dtypes} == {"string"}
    assert ordered(rows(enforce(texts))) == expected
    assert dict(src.read_csv(spark, path, None).dtypes)["confirmed"] == "int"


def test_csv_by_country(spark, sample, tmp_path):
    path = str(tmp_path / "by_country")
    src.write_csv(sample.select("country", "confirmed"), path, partition_by=["country"])
    assert {p.name for p in Path(path).glob("country=*")} == {"country=A", "country=B"}
    back = src.read_csv(spark, path, sample.select("country", "confirmed").schema)
    assert ordered(rows(back, "country", "confirmed")) == ordered(rows(sample, "country", "confirmed"))


def test_csv_of_one_column_keeps_its_null(spark, sample, tmp_path):
    path = str(tmp_path / "states")
    src.write_csv(sample.select("state"), path)
    assert ordered(rows(src.read_csv(spark, path, sample.select("state").schema))) == ordered(rows(sample, "state"))


def test_csv_keeps_text_and_finds_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "texts")
    texts = [("a", " lead "), ("b", ""), ("c", None), ("d", 'say "x", \\ y'), ("e", "\t"), ("f", "two\nlines")]
    df = spark.createDataFrame(texts, "k string, t string")
    src.write_csv(df, path)
    swapped = spark.createDataFrame([], "t string, k string").schema
    assert ordered(rows(src.read_csv(spark, path, swapped, multi_line=True), "k", "t")) == ordered(texts)
    assert ordered(rows(src.read_csv_strings(spark, path, swapped, multi_line=True), "k", "t")) == ordered(texts)
    one = df.where("k < 'f'").select("t")
    src.write_csv(one, path)
    assert ordered(rows(src.read_csv_strings(spark, path, multi_line=True))) == ordered(rows(one))


def test_csv_files_with_different_headers_go_by_name(spark, tmp_path):
    folder = tmp_path / "mixed [1] {x}"
    folder.mkdir()
    (folder / "a.csv").write_text("date,country,state,confirmed,deaths\n2021-01-01,A,x,5,1\n")
    (folder / "b é%20.csv").write_text("country,date,state,deaths,confirmed,more\nB,2021-01-02,y,7,9,m\n")
    (folder / "c.csv").write_text("date,country,state,confirmed,deaths\n2021-01-03,C,z,6,2\n")
    (folder / "d.csv").write_text("")
    (folder / "e.csv").write_text("country,country,\nE,F,G\n")
    path = re.sub(r"([\[\]{}])", r"\\\1", str(folder))  # a path is a pattern
    assert ordered(rows(src.read_csv(spark, path), "date", "country", "confirmed", "deaths")) == ordered(
        [(day(1), "A", 5, 1.0), (day(2), "B", 9, 7.0), (day(3), "C", 6, 2.0), (None, None, None, None)])
    texts = src.read_csv_strings(spark, path)
    assert set(texts.columns) == {"date", "country", "state", "confirmed", "deaths", "more", "country0", "country1", "_c2"}
    assert rows(texts.where("country0 = 'E'"), "country1", "_c2", "date") == [("F", "G", None)]
    inferred = dict(src.read_csv(spark, path, None).dtypes)
    assert (inferred["confirmed"], inferred["date"], inferred["more"]) == ("int", "date", "string")
    headers = src.csv_headers(spark, path)
    assert sorted(map(len, headers.values())) == [1, 1, 2]


def test_csv_folders_with_partitions_and_different_headers(spark, tmp_path):
    for k, header, line in (("A", "x,y", "1,2"), ("B", "y,x", "4,3")):
        (tmp_path / "p" / f"k={k}").mkdir(parents=True)
        (tmp_path / "p" / f"k={k}" / "f.csv").write_text(f"{header}\n{line}\n")
    assert ordered(rows(src.read_csv_strings(spark, str(tmp_path / "p")), "k", "x", "y")) == [("A", "1", "2"), ("B", "3", "4")]


def test_csv_without_files_or_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("country,confirmed\n")
    assert src.read_csv(spark, str(tmp_path / "none.csv")).columns == CANON_NAMES
    assert src.read_csv(spark, str(tmp_path / "none.csv")).count() == src.read_csv(spark, str(tmp_path / "head.csv")).count() == 0


def test_header_job_reads_one_row_of_each_file(spark, tmp_path):
    spark.range(200_000).select(F.col("id").cast("string").alias("a"), F.lit("x" * 50).alias("b")).repartition(3).write.option("header", True).csv(str(tmp_path / "big"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert {h: len(f) for h, f in src.csv_headers(spark, str(tmp_path / "big")).items()} == {"a,b": 3}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_csv_keeps_text_that_looks_like_the_null_marker(spark, tmp_path):
    texts = [(k, t) for k, t in enumerate(["\\N", "\\\\N", "\\\\\\N", "N", "\\", "\\n", "a\\N", "\\N b", "", None])]
    df = spark.createDataFrame(texts, "k int, t string")
    src.write_csv(df, str(tmp_path / "t"))
    assert ordered(rows(src.read_csv(spark, str(tmp_path / "t"), df.schema))) == ordered(texts)
    src.write_csv(df.where("k = 1"), str(tmp_path / "plain"), escaped=False)
    assert rows(src.read_csv(spark, str(tmp_path / "plain"), df.schema, escaped=False)) == [(1, "\\\\N")]


def test_partition_values_come_back_as_written(spark, tmp_path):
    values = ["007", "1.0", "", None, "\\", "\\\\x", "__HIVE_DEFAULT_PARTITION__", "a/b=c%20", " x ", "true", "2021-01-01", "é", "\\N", "[z]{y}*"]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v string, k int")
    src.write_csv(df, str(tmp_path / "v"), partition_by=["v"])
    assert ordered(rows(src.read_csv(spark, str(tmp_path / "v"), df.schema))) == ordered(rows(df))
    assert {f.name: f.dataType.simpleString() for f in src.read_csv_strings(spark, str(tmp_path / "v")).schema} == {"v": "string", "k": "string"}
    dated = spark.createDataFrame([(day(1), 1.5), (None, 2.0)], "date date, x double")
    src.write_csv(dated, str(tmp_path / "d"), partition_by=["date"])
    assert ordered(rows(src.read_csv(spark, str(tmp_path / "d"), dated.schema))) == ordered(rows(dated))


def test_a_capped_csv_is_computed_by_all_tasks(spark, tmp_path):
    df = spark.range(0, 1000, 1, 6).select("id", (F.spark_partition_id()).alias("task"))
    src.write_csv(df, str(tmp_path / "one"), files=1, order_by=["id"])
    lines = next((tmp_path / "one").glob("part-*")).read_text().split()[1:]
    assert [int(x.split(",")[0]) for x in lines] == list(range(1000)) and len({x.split(",")[1] for x in lines}) == 6


def test_wide_feed_without_dates(spark):
    df = spark.createDataFrame([("x", "A", 1.0, 2.0)], "`Province/State` string, `Country/Region` string, Lat double, Long double")
    assert src.std_wide(df, source="W").columns == CANON_NAMES and src.std_wide(df, source="W").count() == 0


def test_numbers_are_never_cut(spark, tmp_path):
    (tmp_path / "n.csv").write_text("country,date,confirmed,more\nA,2021-01-01,5.0,x\nB,x,5.7,x\nC,,9007199254740993.0,x\nD,,1e30,x\nE,,,x\n")
    out = rows(src.read_csv(spark, str(tmp_path / "n.csv")), "country", "confirmed")
    assert ordered(out) == ordered([("A", 5), ("B", None), ("C", 9007199254740993), ("D", None), ("E", None)])
    odd = spark.createDataFrame([(5.0,), (5.7,), (float("nan"),), (float("inf"),), (1e30,), (None,)], "confirmed double")
    assert rows(enforce(odd), "confirmed") == [(5,), (None,), (None,), (None,), (None,), (None,)]


def test_json_accepts_whole_numbers_and_reports_broken_lines(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"country":"A","confirmed":5.0}\n{"country":"B","confirmed":7}\n')
    assert ordered(rows(src.read_jsonl(spark, str(tmp_path / "j")), "country", "confirmed")) == [("A", 5), ("B", 7)]
    src.compact_jsonl(spark, str(tmp_path / "j"), str(tmp_path / "all"))
    assert src.read_jsonl(spark, str(tmp_path / "all")).count() == 2
    (tmp_path / "j" / "y.json").write_text('{"country":"C"\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        rows(src.read_jsonl(spark, str(tmp_path / "j")))
    assert len(rows(src.read_jsonl(spark, str(tmp_path / "j"), mode="DROPMALFORMED"))) == 2


def test_parquet_takes_columns_of_all_files(spark, tmp_path):
    path = str(tmp_path / "grown")
    spark.sql("SELECT 'A' country, 1L confirmed").write.parquet(path)
    spark.sql("SELECT 'B' country, 2L confirmed, 9D deaths").write.mode("append").parquet(path)
    assert ordered(rows(src.read_parquet(spark, path), "country", "deaths")) == ordered([("A", None), ("B", 9.0)])


def test_parquet(spark, sample, tmp_path):
    path = str(tmp_path / "parquet")
    src.write_parquet(sample.withColumn("date", F.col("date").cast("timestamp_ntz")), path)
    assert ordered(rows(src.read_parquet(spark, path))) == ordered(rows(sample))
    text = plan(src.read_parquet(spark, path).where("country = 'A'").select("confirmed"))
    assert "ReadSchema: struct<country:string,confirmed:bigint>" in text and "EqualTo(country,A)" in text


def test_jsonl_brings_back_columns_that_are_null_everywhere(spark, sample, tmp_path):
    path = str(tmp_path / "json")
    src.write_jsonl(sample.repartition(4), path, max_files=2)
    assert len(list(Path(path).glob("part-*"))) == 2
    assert "recovered" not in "".join(p.read_text() for p in Path(path).glob("part-*"))
    assert ordered(rows(src.read_jsonl(spark, path))) == ordered(rows(sample))


def test_compact_keeps_every_line(spark, sample, tmp_path):
    parts, one, some = (str(tmp_path / n) for n in ("parts", "one", "some"))
    src.write_jsonl(sample.repartition(4), parts)
    src.compact_jsonl(spark, parts, one, max_files=1)
    src.compact_jsonl(spark, parts, some)
    assert len(list(Path(one).glob("part-*"))) == 1
    lines = lambda p: sorted(line for f in Path(p).glob("part-*") for line in f.read_text().splitlines())
    assert lines(one) == lines(some) == lines(parts)


def test_documents_drop_the_stores_id_unless_asked(spark, sample, tmp_path):
    options = {"path": str(tmp_path / "docs")}
    src.write_documents(sample.withColumn("_id", F.lit("abc")), "json", options)
    assert ordered(rows(src.read_documents(spark, "json", options))) == ordered(rows(sample))
    with_id = src.read_documents(spark, "json", options, id_column="_id")
    assert with_id.columns == ["_id", *CANON_NAMES] and with_id.where("_id = 'abc'").count() == 4


# -- scratch ---------------------------------------------------------------------

def test_scratch_folders_are_fresh_and_below_the_checkpoint_folder(spark):
    a, b = src.scratch_dir(spark), src.scratch_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert a != b and a.startswith(root) and b.startswith(root)


def test_stage_cuts_the_lineage(spark, sample):
    staged = src.stage(sample.groupBy("country").count())
    assert "Exchange" not in plan(staged) and staged.count() == 2


def test_staged_folders_can_be_removed(spark, sample):
    staged, other = src.stage(sample), src.stage(sample)
    assert Path(staged.staged_at.removeprefix("file:")).is_dir()
    src.discard(staged)
    assert not Path(staged.staged_at.removeprefix("file:")).exists() and other.count() == 4


def test_staging_leaves_no_shuffle_files(spark, sample):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    known = tracker.shuffleStatuses().size()
    assert src.stage(sample.groupBy("country").count()).count() == 2
    assert tracker.shuffleStatuses().size() <= known + 1  # that of the count itself
    assert spark.conf.get(name) == before


class Master:
    """A session whose master is another."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf, self.master = {}, master

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:1", "k8s://x"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="shared by the cluster"):
        src.scratch_dir(Master(master))


def test_enforce_orders_casts_and_fills(spark):
    df = spark.createDataFrame([("1", "A", 7)], "confirmed string, country string, extra int")
    assert enforce(df).schema.simpleString() == CANON.simpleString()
    assert rows(enforce(df)) == [(None, "A", None, 1, None, None, None)]
