"""Small adversarial cases of the engine's operators, plans, sources and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import numbers, text
from quern.operators import evidence, mart, order, panel, quality, tools
from quern.operators import relational as r
from quern.plans.model import Measure, Pack, Request, answer
from quern.sources import raw, versions
from quern.streaming import windows

D = [datetime.date(2024, 1, d) for d in range(1, 10)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_last_known_and_latest_differ_on_nulls(spark):
    df = frame(spark, [("a", D[0], 1, None), ("a", D[1], None, 5), ("b", D[0], None, None)], "k string, d date, x int, y int")
    assert sorted(map(tuple, r.last_known(df, ["k"], "d", ["x", "y"]).collect())) == [("a", 1, 5), ("b", None, None)]
    assert sorted(map(tuple, r.latest(df, ["k"], "d", ["x"]).select("k", "x").collect()), key=repr) == [("a", None), ("b", None)]


def test_fan_out_is_refused_and_dates_align(spark):
    left = frame(spark, [(1, D[0]), (1, D[1]), (None, D[0])], "k int, d date")
    right = frame(spark, [(1, D[0], "x"), (1, D[2], "y")], "k int, d date, v string")
    assert sorted(map(tuple, r.relation_join(left, right, {"k": "k"}, {"v": "v"}, ("d", "d")).collect()), key=repr) == [(1, D[0], "x"), (1, D[1], None), (None, D[0], None)]
    with pytest.raises(r.ContractError, match="JOIN_FANOUT"):
        r.assert_unique(right, ["k"])
    with pytest.raises(Exception, match="JOIN_FANOUT"):
        r.relation_join(left, right, {"k": "k"}, {"v": "v"}).collect()
    assert r.relation_join(left, right, {"k": "k"}, {"v": "v"}, many=True).count() == 5


@pytest.mark.parametrize(("limit", "offset", "want"), [(1, 0, [(1, True)]), (3, 0, [(1, False), (2, False), (3, False)]), (2, 1, [(2, True), (3, False)]), (2, 9, [])])
def test_rank_marks_ties_at_its_cuts(spark, limit, offset, want):
    df = frame(spark, [(1, 9), (2, 9), (3, 7), (4, 5), (5, None)], "k int, v int")
    got = r.ranked(df, "v", limit, ["k"], offset).orderBy("position").select("k", "tie_at_cut").collect()
    assert [tuple(x) for x in got] == want


def test_share_of_nothing_is_null(spark):
    df = frame(spark, [("a", 1, True), ("a", 2, False), ("a", 3, None), ("b", None, True)], "g string, k int, f boolean")
    got = {x["g"]: (x["numerator"], x["denominator"], x["rate"]) for x in r.declared_share(df, ["g"], F.col("f"), "k").collect()}
    assert got == {"a": (1, 3, round(1 / 3, 6)), "b": (0, 0, None)}


def test_union_and_sum_refuse_what_does_not_fit(spark):
    a, b = frame(spark, [(1, D[0])], "v int, d date"), frame(spark, [("x", D[1])], "v string, d date")
    with pytest.raises(r.ContractError, match="UNION_SHAPE"):
        r.union_scope([a, b])
    assert r.union_scope([a, a]).count() == 2
    with pytest.raises(r.ContractError, match="SUM_OVER_DATES"):
        r.combine_sum(a.union(frame(spark, [(2, D[1])], "v int, d date")), "v", "d")
    with pytest.raises(r.ContractError, match="NAME_COLLISION"):
        r.join_results(a, a, ["d"])


def test_percentiles_of_ties_one_and_null(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 7.0)], "g string, v double")
    got = sorted(((x[0], x[1], x[2]) for x in order.rank_percentiles(df, ["g"], "v", "p").select("g", "v", "p").collect()), key=repr)
    assert got == [("a", 1.0, 0.25), ("a", 1.0, 0.25), ("a", 3.0, 1.0), ("a", None, None), ("b", 7.0, 0.5)]


def test_transitions_gaps_balance_and_legs(spark):
    rows = [("a", D[0], 10.0, 5), ("a", D[1], 5.0, 9), ("a", D[3], 5.0, 8), ("a", D[4], 999999999.0, 3), *(("b", d, 1.0, k) for k, d in enumerate(D[:5]))]
    one = F.lit(1.0)
    df = frame(spark, rows, "k string, date date, price_num double, history_sold_value_num long").withColumns({"discount_percent_analysis": one, "monthly_sold_value_num": one, "rating_num": one, "rating_count_num": one, "liked_count_num": one, "is_sold_out_bool": F.when(F.col("date") == F.lit(D[1]), True), "has_structured_voucher": F.lit(False)})
    got = {x["date"]: x for x in panel.transition_metrics(df, ["k"]).where("k = 'a'").collect()}
    assert (got[D[1]]["price_change_percent"], got[D[1]]["snapshot_sales_delta_clean"], got[D[1]]["stock_status"]) == (-50.0, 4, "newly_sold_out")
    assert (got[D[3]]["transition_metric_eligible"], got[D[3]]["price_change"], got[D[3]]["stock_status"]) == (False, None, "not_comparable_snapshot_gap")
    assert (got[D[4]]["history_sold_delta_raw"], got[D[4]]["snapshot_sales_delta_clean"], got[D[4]]["history_sold_decrease_flag"], got[D[4]]["price_change"]) == (-5, None, True, None)
    assert [tuple(x) for x in panel.gaps(df, ["k"]).collect()] == [("a", D[2], "internal")]
    assert {x["k"] for x in panel.balanced(df, ["k"]).collect()} == {"b"}
    legs = frame(spark, [("x", D[0], D[1], 113), ("x", D[1], D[2], -102), ("y", D[0], D[1], None), ("y", D[1], D[2], None), ("z", D[0], D[1], 4)], "k string, previous_date date, date date, delta int").withColumn("eligible", F.lit(True))
    assert sorted(map(tuple, panel.window_delta(legs, ["k"], D[0], D[2]).collect()), key=repr) == [("x", 11, 2), ("y", None, 0)]


def test_snapshot_flags_keep_their_nulls(spark):
    df = frame(spark, [(999999999.0, 5.0, 5.0, 10.0, 2.0, None, 0), (4.0, 5.0, 4.5, None, 2.0, 1.0, 7), (5.0, 5.0, None, None, None, 0.0, None), (None, None, None, None, None, None, None)], "price_num double, price_original_num double, price_before_promo_num double, discount_percent_num double, monthly_sold_value_num double, voucher_discount_num double, promotion_id_num int")
    got = [(x["price_sentinel_flag"], x["estimated_recent_revenue"], x["discount_amount"], x["discount_percent_analysis"], x["pre_final_reduction_proxy"], x["has_displayed_discount"], x["has_structured_voucher"], x["promotion_id_clean"]) for x in panel.snapshot_metrics(df).collect()]
    assert got == [(True, None, None, 10.0, 0.0, True, False, None), (False, 8.0, 1.0, None, 10.0, None, True, 7), (False, None, 0.0, 0.0, None, False, False, None), (False, None, None, None, None, None, False, None)]


def test_dirty_values_become_issues(spark):
    df = frame(spark, [("1", "2.5", "yes", "[1,2]", "2024-01-02"), ("2", "x", "maybe", "[1", "2024-13-02"), (None, "", None, "", "")], "k string, n string, f string, a string, d string")
    out, issues = quality.typed(df, "t", "k", ["n"], ["f"], ["a"], ["d"])
    assert [tuple(x) for x in out.select("n_num", "f_bool", "a_count", "d_date").limit(1).collect()] == [(2.5, True, 2, D[1])]
    assert sorted(x["code"] for x in issues.collect()) == ["INVALID_BOOLEAN", "INVALID_DATE", "INVALID_JSON_ARRAY", "INVALID_NUMBER"]
    keys = quality.key_issues(df.union(df.limit(1)), "t", ["k"])
    assert sorted(x["code"] for x in keys.collect()) == ["DUPLICATE_KEY", "MISSING_KEY"]
    assert [quality.verdict(i).first()["status"] for i in (keys, issues, issues.limit(0))] == ["failed", "passed_with_warnings", "passed"]
    first, rest = quality.without_repeats(df.union(df.limit(1)), df.columns, "k")
    assert (first.count(), rest.count()) == (3, 1)


def test_raw_tree_has_provenance_and_mismatches(spark, tmp_path):
    folder = tmp_path / "country_code=id" / "dataset=products" / "shop_id=7"
    folder.mkdir(parents=True)
    (folder / "products.csv").write_text('shop_id,name\n7,"two\nlines"\n,x\n8,y\n')
    other = tmp_path / "country_code=vn" / "dataset=products" / "shop_id=9"
    other.mkdir(parents=True)
    (other / "products.csv").write_text('\ufeffname,extra,shop_id\nz,e,9\n')
    df = raw.read_raw(spark, str(tmp_path), ["shop_id", "name", "lost"])
    assert [(x["shop_id"], x["name"], x["source_row"], x["path_country_code"], x["path_shop_id"], x["lost"]) for x in df.orderBy("path_country_code", "source_row").collect()] == [
        ("7", "two\nlines", 1, "id", "7", None), (None, "x", 2, "id", "7", None), ("8", "y", 3, "id", "7", None), ("9", "z", 1, "vn", "9", None),
    ]
    filled, issues = quality.path_mismatches(df, {"shop_id": "path_shop_id"}, "products", "name")
    assert [x["raw_value"] for x in issues.collect()] == ["8"] and {x["shop_id"] for x in filled.collect()} == {"7", "8", "9"}
    assert raw.header_drift(["a", "b"], ["b", "c"]) == {"missing": ["c"], "unknown": ["a"]}
    assert sorted(map(tuple, raw.drift(spark, str(tmp_path), {"products": ["shop_id", "name", "price"]}).collect())) == [("products", "extra", "unknown"), ("products", "price", "missing")]
    stray = tmp_path / "country_code=vn" / "dataset=strange"
    stray.mkdir()
    (stray / "x.csv").write_text("a\n1\n")
    assert [x["dataset"] for x in raw.unknown_datasets(spark, str(tmp_path)).collect()] == ["strange"]


def test_versions_are_written_once_and_tampering_is_seen(spark, tmp_path):
    df, root = frame(spark, [(1, "a"), (2, None)], "k int, v string"), str(tmp_path)
    path, new = versions.publish(df, root, "t")
    assert new and versions.publish(df.orderBy(F.col("k").desc()), root, "t") == (path, False)
    version = path.rpartition("version=")[2]
    assert versions.versions(spark, root, "t") == [version] and versions.current(spark, root, "t") is None
    versions.switch(spark, root, "t", version)
    assert versions.published(spark, root, "t").count() == 2
    with pytest.raises(r.ContractError, match="UNKNOWN_VERSION"):
        versions.switch(spark, root, "t", "none")
    df.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(r.ContractError, match="changed"):
        versions.published(spark, root, "t")


def test_digests_tell_tables_apart(spark):
    a, b = frame(spark, [(1, None)], "x int, y int"), frame(spark, [(None, 1)], "x int, y int")
    tables = [a, b, a.toDF("x", "z"), a.union(a), a.limit(0), a.withColumn("x", F.col("x").cast("long")), b.union(b).union(a)]
    assert len({versions.content_digest(t) for t in tables}) == len(tables)
    assert versions.content_digest(a.union(b)) == versions.content_digest(b.union(a))


def test_cohorts_fall_back_and_segments_keep_their_order(spark):
    rows = [(k, "m", "big" if k < 25 else "small" if k < 30 else None, k % 9, float(k), float(k % 5) if k % 3 else None, float(100 - k)) for k in range(32)]
    assert mart.cohorts(frame(spark, rows, "k int, market string, category string, d int, a double, b double, c double"), "market", "category").where("fallback and cohort_size <> 32").isEmpty()
    df = frame(spark, rows, "k int, market string, category string, days_since_activity int, monthly_sold double, sold_delta double, revenue double")
    out = mart.scores(df, "k", "market", "category")
    assert {x["k"] for x in out.where("fallback").collect()} == set(range(25, 32))
    assert out.withColumn("s", mart.segment()).where("s is null").isEmpty()
    assert out.where("score is null").isEmpty() and out.where("score < 0 or score > 100").isEmpty()
    cases = {  # activity, momentum, value (percentiles), monthly_sold, sold_delta, score
        "InsufficientData": [(0.9, 0.9, None, 1.0, 1.0, 1.0), (0.9, 0.9, 0.9, 1.0, 1.0, None)], "Dormant": [(0.39, 0.9, 0.9, 0.0, -1.0, 1.0), (0.1, 0.9, 0.9, None, None, 1.0)],
        "Cooling": [(0.9, 0.9, 0.9, 1.0, -1.0, 1.0), (0.39, 0.39, 0.9, 1.0, None, 1.0)], "Star": [(0.6, 0.6, 1.0, 1.0, 0.0, 1.0)], "Rising": [(0.1, 0.6, 0.59, 1.0, None, 1.0)], "Steady": [(0.9, 0.5, 0.9, 1.0, 1.0, 1.0), (0.5, 0.7, 0.7, 1.0, 1.0, 1.0)],
    }
    flat = [(want, *row) for want, rows in cases.items() for row in rows]
    judged = frame(spark, flat, "want string, activity double, momentum double, value double, monthly_sold double, sold_delta double, score double").withColumn("got", mart.segment())
    assert judged.where("want <> got").isEmpty()


def test_plans_refuse_what_the_pack_does_not_declare(spark):
    pack = Pack("t", {"t": lambda: frame(spark, [("a", D[0], 5.0, 1)], "m string, d date, p double, k int")}, dimensions={"market": "m", "date": "d"}, entities={"item": "k"}, measures={"price": Measure("p", "snapshot_stock", True), "rating": Measure("p", "ordinal")}, snapshot="d", currency="market")
    for request, code in (
        (Request("price", "sum", ("market",)), "ILLEGAL_AGGREGATION"), (Request("rating", "mean", ("market",)), "ILLEGAL_AGGREGATION"), (Request("price", "median", snapshot=D[0]), "CURRENCY_MIX"), (Request("price", "median", ("market",)), "SNAPSHOT_SCOPE"),
        (Request("price", "median", ("colour",)), "UNKNOWN_DIMENSION"), (Request("nothing", "count"), "NOT_COUNTABLE"), (Request("price", "max", ("market",), (("market", "between", 1),)), "UNKNOWN_OPERATOR"), (Request("item", "count", limit=0), "RANK_LIMIT"),
    ):
        with pytest.raises(r.ContractError, match=code):
            answer(pack, request)
    assert answer(pack, Request("price", "median", ("market",), snapshot="latest")).first()["value"] == 5.0


def test_evidence_checks_find_the_rows_that_break_a_rule(spark):
    df = frame(spark, [("a", 1.0, 2.0, 3.0), ("b", -1.0, 5.0, 3.0)], "k string, low double, mid double, high double")
    assert [x["k"] for x in evidence.negative(df, ["low"]).collect()] == ["b"] and [x["k"] for x in evidence.disordered(df, "low", "mid", "high").collect()] == ["b"]
    totals = frame(spark, [("a", 2.0), ("b", 9.0)], "k string, mid double")
    assert [x["k"] for x in evidence.parts_off_total(df, totals, ["k"], "mid").collect()] == ["b"]
    with pytest.raises(r.ContractError, match="CARDINALITY"):
        evidence.check_rows(df, exact=1)


def test_text_folds_and_finds_literally(spark):
    df = frame(spark, [("Trang  điểm MẮT [Sale]", "50%_off")], "a string, b string")
    row = df.select(text.fold(F.col("a")).alias("f"), text.without_decoration(F.col("a")).alias("w"), text.contains(F.col("b"), "%_o").alias("c"), text.contains(F.col("b"), "%off").alias("n"), text.similarity(F.lit("abcd"), F.lit("abed")).alias("s"), numbers.shared_depth(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(4))).alias("d")).first()
    assert tuple(row) == ("trang diem mat sale", "Trang điểm MẮT", True, False, 0.75, 2)


def test_ambiguous_folds_are_marked(spark):
    df = frame(spark, [("vn", "Trang điểm mắt"), ("vn", "Trang điểm mặt"), ("id", "Bibica"), ("id", None)], "m string, v string")
    got = {x["folded"]: x["ambiguous"] for x in tools.value_index(df, "r", "m", "v", text.fold(F.col("v"))).collect()}
    assert got == {"trang diem mat": True, "bibica": False}


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1, k % 24, k % 60), "a" if k % 2 else "b", float(k)) for k in range(200)]
    events = frame(spark, rows, "event_id long, ts timestamp, kind string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    measures = {"n": F.count(F.lit(1))}
    q = windows.windowed(stream, "6 hours", None, "1 hour", ["kind"], measures).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windows.windowed(events, "6 hours", None, "1 hour", ["kind"], measures).collect()))
    q = windows.distinct_events(stream.union(stream), ["event_id"], "1 day").writeStream.format("memory").queryName("u").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("u").count() == 200


def test_streamed_transitions_follow_the_batch_definition(spark, tmp_path):
    rows = [("a", D[0], 10.0), ("a", D[1], 12.0), ("a", D[3], 20.0), ("b", D[0], 1.0)]
    df = frame(spark, rows, "listing string, date date, value double")
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = windows.transitions(stream, "listing").writeStream.format("memory").queryName("t").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("t").collect()), key=repr) == [("a", D[0], D[1], 1, True, 2.0), ("a", D[1], D[3], 2, False, None)]
