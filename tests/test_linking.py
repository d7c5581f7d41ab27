"""Linkage, evidence, audits and readers: SQL on the smallest tables, brute force and literal cases."""

import itertools

import pytest
from pyspark.sql import functions as F
from test_queries import SF, db  # noqa: F401

from cohortscore.functions.similarity import token_set_ratio
from cohortscore.operators import audits as A
from cohortscore.operators import matching as M
from cohortscore.plans import linking
from cohortscore.sources import readers as R
from compare import canon

MORE = "/root/testdata/sf0.01"
TRIMS = ("lx", "awd")


@pytest.mark.parametrize("name", sorted(linking.ORACLE))
def test_against_sql(spark, db, name):  # noqa: F811
    assert canon(linking.QUERIES[name](spark, SF).toPandas()) == canon(db.execute(linking.ORACLE[name]).df())


def brute_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if ch == d else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    s, x, y = (sorted(z) for z in (set(a.split()) & set(b.split()), set(a.split()) - set(b.split()), set(b.split()) - set(a.split())))
    if s and not (x and y) or not x and not y:
        return 100
    if not a or not b:
        return 0
    j, p, q = " ".join(s), " ".join(s + x), " ".join(s + y)
    r = lambda u, v: 2 * lcs(u, v) / (len(u) + len(v))
    return round(100 * max([r(p, q)] + ([r(j, p), r(j, q)] if j else [])))


def test_ratio_equals_brute_force(spark):
    long = ["abcdefghij klmno " * 4 + "x", "bdfhj klmnop " * 5, "q w e r t y " * 12, "a" * 62, "a" * 63 + " b", "ab" * 31 + " b"]
    names = [*long, "", "f150", "f250", "explorer", "explorer sport", "civic lx", "civic", "red hot anvil", "hot blue anvil", "anvil", "a b c", "c b d"]
    pairs = list(itertools.product(names, names))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r[0], r[1]): r[2] for r in df.select("a", "b", token_set_ratio(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b): brute_ratio(a, b) for a, b in pairs}


def brute_match(left, right):
    ratio = {}
    for i, (make, model, year) in left.items():
        pool = [(m != model, -ratio.setdefault((model, m), brute_ratio(model, m)), m, c) for c, (k, m, y) in right.items() if (k, y) == (make, year)]
        if not pool:
            yield i, None, None, "no_candidate"
            continue
        other, score, name, cand = min(pool)
        exact = sum(not p[0] for p in pool)
        unsure = exact > 1 or other and sum(p[1] == score for p in pool) > 1
        root = lambda n: [w for w in n.split() if w not in linking.Q.TRIMS]
        sure = -score >= 90 and (root(model) and root(model) == root(name) or exact == 1) and not unsure
        yield i, cand, -score, "auto_accepted" if sure else "manual_review" if -score >= 75 else "rejected"


def test_match_equals_brute_force(spark):
    rows, catalog = linking._sides(spark, MORE)
    left = {r["id"]: (r["make"], r["model"], r["year"]) for r in rows.collect()}
    right = {r["cand_id"]: (r["make"], r["model"], r["year"]) for r in catalog.collect()}
    got = {tuple(r) for r in linking.entity_match(spark, MORE).select("id", "cand_id", "score", "status").collect()}
    assert got == set(brute_match(left, right)) and len({g[3] for g in got}) > 2
    one = linking.match_summary(spark, MORE).first()
    assert one["n"] == len(left) and one["accepted"] == sum(g[3] == "auto_accepted" for g in got)


@pytest.mark.parametrize("model,names,status", [("F-150", ["F-250"], "rejected"), ("F-150", ["F150"], "auto_accepted"), ("Explorer", ["Explorer Sport"], "manual_review"), ("Civic", ["Civic LX"], "auto_accepted"), ("gt", ["GT"], "auto_accepted"), ("gt", ["GT", "GT"], "manual_review"), ("x", [], "no_candidate")])
def test_match_cases(spark, model, names, status):
    rows = spark.createDataFrame([(1, "Ford", model, 2015)], "id int, make string, model string, year int")
    catalog = spark.createDataFrame([(i, "FORD", n, 2015, True) for i, n in enumerate(names)], "cand_id int, make string, model string, year int, verified boolean")
    assert M.match_entities(rows, catalog, TRIMS).first()["status"] == status


def test_decisions(spark):
    matches = spark.createDataFrame([(1, 7, "manual_review", True), (2, 7, "manual_review", False), (3, 7, "rejected", True), (4, 7, "manual_review", True)], "id int, cand_id int, status string, root_equal boolean")
    decisions = spark.createDataFrame([(1, "sí"), (2, "accept"), (3, "yes"), (4, "No")], "id int, decision string")
    got = {r["id"]: r["status"] for r in M.apply_decisions(matches, decisions).collect()}
    assert got == {1: "manual_accepted", 2: "manual_review", 3: "rejected", 4: "manual_rejected"}
    with pytest.raises(ValueError):
        M.apply_decisions(matches, decisions.union(decisions))


def test_equivalences(spark):
    rows = spark.createDataFrame([("a", "Ford", "F-150", 2015)], "id string, make string, model string, year int")
    catalog = spark.createDataFrame([("c", "ford", "F150 XL", 2015, True), ("d", "ford", "F250", 2015, False)], "cand_id string, make string, model string, year int, verified boolean")
    matches = spark.createDataFrame([("a", None, "manual_review")], "id string, cand_id string, status string")
    schema = "id string, cand_id string, reviewer string, reviewed_at string, evidence_url string, evidence_sha256 string, justification string"
    good = ("a", "c", "r", "2020-01-02", "https://x", "0" * 64, "same")
    out = M.apply_equivalences(matches, spark.createDataFrame([good], schema), rows, catalog, "2021-01-01").first()
    assert (out["cand_id"], out["status"], out["reviewer"]) == ("c", "manual_accepted", "r")
    bad = spark.createDataFrame([("a", "d", "", "2022-01-01", "http://x", "z", None)], schema)
    rules = {r["rule"] for r in M.equivalence_violations(bad, rows, catalog, "2021-01-01").collect()}
    assert rules == {"blank_field", "bad_sha256", "not_https", "bad_date", "unverified_candidate", "other_digits"}


def test_inventory_states(spark):
    schema = "make string, model string, year int"
    catalog = spark.createDataFrame([(1, "FORD", "FOCUS", 2025), (2, "FORD", "F150", 2025), (3, "KIA", "F-150", 2025), (4, "KIA", "F150", 2025)], "cand_id int, " + schema)
    names = [("Ford", "Focus", 2025), ("Ford", "F-150", 2025), ("Ford", "Focus AWD", 2025), ("Kia", "F 150", 2025), ("Ford", "zzz", 2025), ("Seat", "Leon", 2025)]
    got = {(r["make"], r["model"]): (r["status"], r["cand_id"], r["n_candidates"]) for r in M.resolve_inventory(spark.createDataFrame(names, schema), catalog).collect()}
    assert got == {("Ford", "Focus"): ("exact_name", 1, 1), ("Ford", "F-150"): ("normalized_name", 2, 1), ("Ford", "Focus AWD"): ("manual_review", None, 1), ("Kia", "F 150"): ("ambiguous_name", None, 2), ("Ford", "zzz"): ("no_model_match", None, 0), ("Seat", "Leon"): ("no_same_make_year", None, 0)}


def test_evidence_has_no_contradiction(spark):
    assert M.evidence_contradictions(linking.evidence_states(spark, SF)).isEmpty()


def test_scope_sample_spreads(spark):
    rows = spark.createDataFrame([(y, m, k) for y in range(1995, 2018) for m in ("a", "b") for k in (1, 2)], "y int, m string, k int")
    assert {r["m"]: r["count"] for r in A.scope_sample(rows, "y", "m", ["k"], 46).groupBy("m").count().collect()} == {"a": 23, "b": 23}
    assert sorted(r["y"] for r in A.scope_sample(rows, "y", "m", ["k"], 3).collect()) == [1995, 2006, 2017]


def test_fingerprint_is_of_a_multiset(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    same = df.repartition(3).orderBy(F.desc("x")).withColumn("x", F.col("x").cast("long"))
    assert A.fingerprint(df, ["x", "y"]).first() == A.fingerprint(same, ["x", "y"]).first()
    assert A.fingerprint(df, ["x", "y"]).first() != A.fingerprint(df.distinct(), ["x", "y"]).first()
    assert A.fingerprint(df.limit(0), ["x", "y"]).first()["n"] == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\t é \t\nbad\n1\t2\n".encode("latin-1"))
    good, bad = R.read_fields(spark, str(tmp_path / "a.txt"), ["p", "q"])
    assert {(r["p"], r["q"]) for r in good.collect()} == {("x", "é"), ("1", "2")} and [(r["line"], r["text"]) for r in bad.collect()] == [(2, "bad")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text('{"Count": 1, "results": [{"Component": "brake"}]}')
    (tmp_path / "j/2.json").write_text('{"Count": 2, "results": [{"Component": "brake"}]}')
    (tmp_path / "j/3.json").write_text("[")
    good, bad = R.read_payloads(spark, str(tmp_path / "j"), ["Component"])
    assert [r["Component"] for r in good.collect()] == ["brake"] and sorted(r["file"][-6:] for r in bad.collect()) == ["2.json", "3.json"]
    (tmp_path / "i.xml").write_text("<v><vehicle><id>1</id><cylinders>4</cylinders></vehicle><vehicle><id>2</id><cylinders>bad</cylinders></vehicle></v>")
    value, state = R.checked_number(F.col("cylinders"), 0, 32, whole=True)
    assert {tuple(r) for r in R.read_inventory(spark, str(tmp_path / "i.xml"), "vehicle", ["id", "cylinders"]).select("id", value, state).collect()} == {("1", 4.0, "observed"), ("2", None, "invalid")}
    (tmp_path / "c.csv").write_text('Make,Engine HP,CV\n"Fo  rd",100,\n ,,100\n')
    rows = R.read_csv(spark, str(tmp_path / "c.csv"), {"Make": "make", "Engine HP": "hp", "CV": "cv"})
    power = R.first_known([(F.col("cv"), "CV", "cv", 1.0), (F.col("hp"), "Engine HP", "hp", R.HP_IN_CV)])
    assert [(r[0], round(r[1]["value"], 5), r[1]["unit"]) for r in rows.select("make", power).collect()] == [("Fo rd", 101.38696, "hp"), (None, 100.0, "cv")]
    dates = spark.createDataFrame([("04/12/2019",), ("20180131",), ("2019-02-03",), ("x",)], "d string").select(R.report_date(F.col("d")).cast("string"))
    assert [r[0] for r in dates.collect()] == ["2019-12-04", "2018-01-31", "2019-02-03", None]
