"""Row numbers, stored responses and the inventory: literal cases, files in many blocks, and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortscore.plans.ingest import ORACLE, QUERIES
from cohortscore.sources import readers as R
from cohortscore.sources import responses as S
from cohortscore.sources.rows import numbered
from compare import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(db.execute(ORACLE[name]).df())


def test_numbers_over_many_blocks_and_files(spark, tmp_path):
    """Files are cut into blocks of 4 KB that tasks share in any order; an empty file and blank lines."""
    want = []
    for f, n in (("a", 3000), ("b", 0), ("c", 1), ("d", 900)):
        lines = [f"{f}{i}" if i % 7 else "" for i in range(n)]
        (tmp_path / f"{f}.txt").write_text("".join(x + "\n" for x in lines))
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = spark.read.text(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 3
        got = {r["row"]: r["value"] for r in numbered(raw).collect()}
        assert [got[i + 1] for i in range(len(got))] == want
        each = numbered(raw.withColumn("row", F.lit("old")).select("value", "row", "_metadata"), first=0, per_file=True).collect()
        assert all(r["value"] in ("", f"{r['value'][:1]}{r['row']}") for r in each) and len(each) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_row_numbers_of_parquet(spark, tmp_path):
    spark.range(1000).repartition(1).sortWithinPartitions(F.desc("id")).write.parquet(str(tmp_path / "p"))
    assert numbered(spark.read.parquet(str(tmp_path / "p")), first=2).filter("row <> 1001 - id").count() == 0


PAYLOADS = [
    ('{"Count": 1, "results": [{"NHTSACampaignNumber": "19V859000", "ReportReceivedDate": "04/12/2019", "Component": "ENGINE ", "SUMMARY": " stalls", "Remedy": null, "Consequence": "\\t"}]}', None),
    ('{"count": "1", "Results": [{"CAMPAIGNNUMBER": "x", "reportdate": "20180131"}]}', None),
    ('{"results": []}', None),
    ('{"Count": 2.5, "results": [{}, {}]}', None),
    ('{"error": "unavailable"}', "no_results"),
    ('{"Count": 1, "results": []}', "wrong_count"),
    ('{"Count": 0, "results": null}', "no_results"),
    ('{"results": null, "Results": []}', "no_results"),
    ('{"Count": "many", "results": []}', "wrong_count"),
    ('{"results": [1]}', "bad_result"),
    ('{"results": {}}', "no_results"),
    ("[]", "not_an_object"),
    ("", "not_an_object"),
    ("{", "not_an_object"),
    (None, "not_an_object"),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, p, " Ford ", "F 150", 2015, None) for i, (p, _) in enumerate(PAYLOADS)], "i int, payload string, make string, model string, year int, id string")
    checked = {r["i"]: r["problem"] for r in S.checked_responses(df, "payload").collect()}
    assert checked == {i: p for i, (_, p) in enumerate(PAYLOADS)}
    rows, bad = S.campaign_rows(df, "payload", "make", "model", "year", "id")
    got = sorted(((r["campaign"], str(r["report_date"]), r["description"], r["vehicle_id"], r["make"]) for r in rows.collect()), key=str)
    assert got == [("19V859000", "2019-12-04", "ENGINE stalls", "FORD_F_150_2015", "Ford"), ("x", "2018-01-31", "", "FORD_F_150_2015", "Ford"), (None, "None", "", "FORD_F_150_2015", "Ford"), (None, "None", "", "FORD_F_150_2015", "Ford")]
    assert bad.count() == sum(p is not None for _, p in PAYLOADS)
    assert S.campaign_rows(df.limit(0), "payload", "make", "model", "year")[0].count() == 0


def test_response_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"Count": 1,\n "results": [{"component": "brake"}]}')
    (tmp_path / "2.json").write_text("{")
    checked = S.checked_responses(S.read_responses(spark, str(tmp_path)), "payload")
    assert {r["file"][-6:]: r["problem"] for r in checked.collect()} == {"1.json": None, "2.json": "not_an_object"}


VEHICLE = "<vehicle><id>{}</id><make>{}</make><model>M</model><year>{}</year><cylinders>{}</cylinders></vehicle>"
NAMES = ["id", "make", "model", "year", "cylinders"]


def test_inventory(spark, tmp_path):
    def read(*elements, head=""):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.xml"
        path.write_text(head + "<vehicles>" + "".join(elements) + "</vehicles>")
        return R.read_inventory(spark, str(path), "vehicle", NAMES)

    good = read(*[VEHICLE.format(i, "Ford", 2000, c) for i, c in enumerate(["", "bad", "-1", "0", "33", "2.5", "4"])], VEHICLE.format(9, "Ford", 1990, 4))
    assert R.inventory_problems(good).count() == 0
    got = {r["id"]: (r["cylinders"], r["cylinders_status"]) for r in R.inventory_rows(good).collect()}
    assert got == {"0": (None, "missing"), "1": (None, "invalid"), "2": (None, "invalid"), "3": (0, "observed"), "4": (None, "invalid"), "5": (None, "invalid"), "6": (4, "observed")}
    bad = read(VEHICLE.format("", "Ford", 2000, 4), VEHICLE.format(1, " ", "2000.5", 4), VEHICLE.format(2, "Kia", "", 4), VEHICLE.format(3, "Kia", 2200, 4), VEHICLE.format(3, "Kia", 2000, 4))
    assert sorted(tuple(r) for r in R.inventory_problems(bad).collect()) == [("bad_year", "1", "2000.5"), ("bad_year", "3", "2200"), ("blank_identity", "", "id"), ("blank_identity", "1", "make"), ("blank_identity", "2", "year"), ("duplicate_id", "3", "2")]
    assert [r["rule"] for r in R.inventory_problems(good.limit(0)).collect()] == ["empty"]
    with pytest.raises(ValueError):
        read(head='<!DOCTYPE vehicles [<!ENTITY x "unsafe">]>')
    with pytest.raises(Exception, match="no XML"):
        read("<vehicle><id>1</id><make>a</vehicle>", VEHICLE.format(1, "a", 2000, 4)).collect()
