"""The plan layer, dates, order statistics, sources and gates on small cases."""

import datetime
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.functions import numbers, text
from quern.operators import evidence, mart, order, panel, tools
from quern.operators import relational as r
from quern.operators import vectors as vectors_of
from quern.plans import dates, metrics, model
from quern.plans.market import MEASURES, market_pack
from quern.plans.model import Request
from quern.sources import adapter, files, raw, tables, versions

D = [datetime.date(2024, 1, d) for d in range(1, 31)]


@pytest.fixture(scope="module")
def pack(spark):
    def products():
        rows = [("vn", 1, 10, D[0], 5.0, 3.0, 1, "a"), ("vn", 1, 11, D[1], 999999999.0, 4.0, 2, "b"), ("id", 2, 12, D[1], 9999999.0, 5.0, 3, None)]
        return spark.createDataFrame(rows, "country_code string, shop_id int, item_id int, date date, price_num double, rating_num double, vouchers_count_num int, brand string").withColumn("product_listing_key", F.col("item_id"))

    def shops():
        return spark.createDataFrame([("vn", 1, "One"), ("id", 2, "Two")], "country_code string, shop_id int, shop_name string").select("*", *(F.lit(None).cast("double").alias(c) for c in ("is_official_shop", "vacation", "rating_star", "follower_count", "item_count", "response_rate", "response_time", "cancellation_rate", "rating_good", "rating_normal", "rating_bad")))

    return market_pack({"products": products, "shop_info": shops})


def test_requests_are_refused_by_rule(pack):
    vn = (("country", "eq", "vn"),)
    for request, code in (
        (Request("rating", "mean", where=vn, snapshot=D[0]), "ILLEGAL_AGGREGATION"), (Request("price", "median", snapshot=D[0]), "CURRENCY_MIX"), (Request("price", "median", where=vn), "SNAPSHOT_SCOPE"),
        (Request("product_listing", "count", where=(*vn, ("country", "eq", "id"))), "CLASHING_FILTERS"), (Request("product_listing", "count", where=(("country", "contains", "v"),)), "FILTER_NOT_ALLOWED"),
        (Request("product_listing", "count", by=("item_id",)), "NOT_GROUPABLE"), (Request("product_listing", "count", having=(("nice", True),)), "UNKNOWN_QUALIFIER"),
        (Request("product_listing", "count", above=(("price", "gte", 5, "percent"),)), "UNIT_MISMATCH"), (Request("product_listing", "count", by=("platform_category_name",)), "UNKNOWN_DIMENSION"),
    ):
        assert model.plan_breaks(pack, request) == [code], request
    assert "ordinal" in model.REFUSALS["ordinal", "mean"]
    with pytest.raises(r.ContractError, match="DATASET_NOT_AVAILABLE"):
        model.checked(model.replace(pack, tables={}), Request("product_listing", "count"))
    both = model.replace(pack, dimensions=pack.dimensions | {"a": model.Dimension("x", family="platform"), "b": model.Dimension("y", family="shelf")})
    assert model.plan_breaks(both, Request("product_listing", "count", by=("a", "b"))) == ["TWO_TAXONOMIES"]


def test_defaults_fill_only_what_was_left_open(pack):
    made = model.completed(pack, Request("price", where=(("date", "between", (D[0], D[1])), ("country", "eq", "vn"))))
    assert made.aggregation == "median" and made.snapshot is None and made.where[:2] == (("date", "gte", D[0]), ("date", "lte", D[1]))
    assert model.completed(pack, Request("product_listing")).snapshot == "latest" and model.completed(pack, Request("product_listing")).aggregation == "count"
    assert [model.completed(pack, Request("price", rank=k, limit=n)).limit for k, n in (("one", None), ("some", None), ("some", 40))] == [1, 5, 10]
    assert model.comparison("x", "le", 3) == [("x", "lte", 3)]
    with pytest.raises(r.ContractError, match="UNKNOWN_OPERATOR"):
        model.comparison("x", "isnull", None)


def test_excluded_values_are_in_no_aggregate(pack):
    request = Request("price", "max", by=("country",), dates=(D[0], D[1]))
    assert sorted(map(tuple, model.answer(pack, request).collect())) == [("id", 9999999.0), ("vn", 5.0)]
    assert [tuple(x) for x in model.excluded_rows(pack, request).collect()] == [("price-sentinel", 1)]
    rows = pack.tables["products"]().select("item_id", "price_num")
    assert sorted((x["item_id"], x["decision"]) for x in model.boundary_report(pack, request, rows).collect()) == [(11, "price-nines"), (12, "price-nines")]
    assert model.caveats(pack, request) == ["EXCLUDED_BY:price-sentinel"] and "PROXY" in model.caveats(pack, Request("monthly_sold"))[0]
    companion = model.Exclusion("c", companion="x")
    df = pack.tables["products"]().withColumn("x", F.col("item_id") - 10)
    assert [x["item_id"] for x in df.where(companion.hits("price_num")).collect()] == [10]
    assert {m.kind for m in MEASURES.values()} <= set(model.ALLOWED)


def test_dates_fall_into_one_cell_each():
    calendar = [d for d in D if d.day not in (4, 5)]
    found = dates.resolved(["2024-01-02", D[3], "2024-03-01", "soon", "first_week"], calendar)
    assert (found.observed, found.gap, found.outside, found.unparsed, found.window) == ((D[1],), (D[3],), (datetime.date(2024, 3, 1),), ("soon",), None)
    assert dates.resolved([], calendar).empty and dates.asked([], calendar) == (D[29],)
    week = dates.resolved(["first_week"], calendar)
    assert week.observed == tuple(d for d in D[:7] if d in calendar) and week.clamped
    assert dates.window("last_week", calendar) == tuple(D[23:]) and dates.window("latest", []) == () and dates.window("mid_month", D[:2]) == tuple(D[:2]) and dates.window("mid_month", D[:9]) == tuple(D[3:6])
    for named, code in ((["2024-01-04"], "SNAPSHOT_SCOPE"), (["2023-01-01"], "SNAPSHOT_SCOPE"), (["x"], "DATE_UNPARSED")):
        with pytest.raises(r.ContractError, match=code):
            dates.asked(named, calendar)


def test_quantiles_and_ranks_of_hot_groups_and_ties(spark):
    rng = random.Random(4)
    rows = [("hot", float(rng.randrange(500))) for _ in range(3000)] + [("tie", 7.0)] * 50 + [("one", 1.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in order.quantiles(df, ["g"], "v", {"median": 0.5, "p9": 0.9}).collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, values in by.items():
        assert got[g]["median"] == statistics.median(values)
        if len(values) > 1:
            assert abs(got[g]["p9"] - statistics.quantiles(values, n=10, method="inclusive")[8]) < 1e-9
    nearest = {x["g"]: x["p"] for x in order.quantiles(df, ["g"], "v", {"p": 0.95}, nearest=True).collect()}
    assert nearest["hot"] == sorted(by["hot"])[-(-95 * 3000 // 100) - 1] and nearest[None] == 4.0
    ranks = order.rank_percentiles(df.where("g = 'hot'"), ["g"], "v", "p").collect()
    s = sorted(by["hot"])
    for x in ranks[:50]:
        mean_rank = s.index(x["v"]) + (s.count(x["v"]) - 1) / 2
        assert abs(x["p"] - mean_rank / (len(s) - 1)) < 1e-12
    assert len(ranks) == 3000


def test_steps_are_combined_by_their_rules(spark):
    steps = spark.createDataFrame([("a", 3.0, "n", None), ("b", 3.0, "n", None)], "step string, value double, unit string, rule string")
    assert r.best_step(steps).first()["step"] == "a" and r.compare_steps(steps).first()["relation"] == "equal"
    lost = steps.union(spark.createDataFrame([("c", None, "n", "R1")], steps.schema))
    assert [x["rule"] for x in r.list_steps(lost).collect()] == [None, None, "R1"]
    with pytest.raises(r.ContractError, match="STEP_UNANSWERED"):
        r.best_step(lost)
    with pytest.raises(r.ContractError, match="NOT_COMPARABLE"):
        r.compare_steps(steps.withColumn("unit", F.col("step")))
    with pytest.raises(r.ContractError, match="SECTION_ARITY"):
        r.side_by_side({"a": steps})
    shown, more = r.head(steps, 1)
    assert shown.count() == 1 and more and r.canonical(steps.orderBy(F.col("step").desc())).first()["step"] == "a"
    with pytest.raises(r.ContractError, match="TIE_AT_TOP"):
        r.tie_policy(r.ranked(steps, "value", 1, ["step"]), 1)
    with pytest.raises(r.ContractError, match="RANK_LIMIT"):
        r.ranked(steps, "value", 1, ["step"], 99)
    with pytest.raises(r.ContractError, match="PAGE_SIZE"):
        mart.page(steps, {"step": False}, 51)


def test_evidence_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, d string")
    named = evidence.bounds(df, "k", "d")
    assert named == {"snapshot_rows": 2, "listings": 2, "snapshots": 1}
    evidence.check_cardinality(df, "<= listings", named)
    evidence.check_columns(df, ["k", "d"])
    evidence.check_fanout(df, [df], 1)
    for bad in (lambda: evidence.check_cardinality(df, "snapshots", named), lambda: evidence.check_cardinality(df, "<=1", named), lambda: evidence.check_cardinality(df, "rows", named), lambda: evidence.check_fanout(df.union(df), [df], 1), lambda: evidence.check_columns(df, ["d", "k"]), lambda: evidence.broken(df, ["even:k"])):
        with pytest.raises(r.ContractError):
            bad()


def test_cards_keep_their_order_and_filters(spark):
    rows = [("low", "k", "vn", None, "1"), ("high", "z", "vn", "c", "2"), ("high", "a", "id", "c", "3"), ("medium", "a", "vn", "c", "4")]
    found = spark.createDataFrame(rows, "priority string, kind string, market string, category string, insight_id string")
    assert [x["insight_id"] for x in mart.cards(found).collect()] == ["3", "2", "4", "1"]
    assert [x["insight_id"] for x in mart.cards(found, market="vn", category="c", kind=None, priority="high").collect()] == ["2"]
    named = found.withColumn("evidence_ids", F.array(F.concat(F.lit("e"), "insight_id"), F.lit("lost")))
    assert [x["evidence_id"] for x in mart.evidence_of(named, spark.createDataFrame([("e1", 1), ("e2", 2)], "evidence_id string, v int"), "2").collect()] == ["e2"]
    score = spark.createDataFrame([("a", "m")], "listing string, market string")
    assert [x["code"] for x in mart.invalid_scorecard(score, ["listing"]).collect()] == ["SCHEMA_INVALID"]
    assert mart.price_move_points(spark.createDataFrame([("a", -20.0, 3)], "k string, price_change_percent double, sold_delta int"), "k").columns == ["listing_key", "x", "y"]


def test_titles_phrases_and_stamps(spark):
    df = spark.createDataFrame([("[hot deal] banh quy (200g) freeship", "2024-01-01 07:00:00"), ("", None)], "t string, s string")
    row = df.select(text.without_phrases(F.col("t")).alias("a"), text.removed_phrases(F.col("t")).alias("b"), text.epoch(F.col("s"), "Asia/Bangkok").alias("c"), text.leaf_of(F.lit("a.b.c")).alias("d")).collect()
    assert tuple(row[0]) == ("banh quy (200g)", ["hot deal", "freeship"], 1704067200, "c") and tuple(row[1]) == ("", [], None, "c")
    pairs = spark.createDataFrame([("kinh do banh", "banh kinh do"), ("banh", "banh quy bo"), ("a", "b"), ("", "")], "a string, b string")
    got = [x["s"] for x in pairs.select(F.round(text.token_set_ratio(F.col("a"), F.col("b")), 3).alias("s")).collect()]
    assert got == [0.95, 0.95, 0.0, 1.0]


def test_sinks_reports_and_views(spark, tmp_path):
    df = spark.createDataFrame([("vn", 1, "x,\"y\"\nz", None), ("id", 2, "é", 2.5), ("id", 2, None, 2.5)], "country_code string, shop_id int, name string, v double")
    root = str(tmp_path / "d")
    tables.write_csv(df, f"{root}/products_clean.csv")
    df.write.parquet(f"{root}/shop_info_clean.parquet")
    schema = "country_code string, shop_id int, name string, v double"
    assert sorted(map(tuple, tables.read_artifact(spark, root, "products_clean", schema).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert tables.register_views(spark, root, {"products_clean": schema}) == ["products_clean", "shop_info_clean"] and spark.table("products_clean").count() == 3
    for name, code in (("nothing", "UNKNOWN_DATASET"), ("shop_stats_clean", "DATASET_NOT_AVAILABLE")):
        with pytest.raises(r.ContractError, match=code):
            tables.read_artifact(spark, root, name)
    tables.write_partitioned(df, f"{root}/parts")
    assert sorted(map(tuple, tables.read_partitioned(spark, f"{root}/parts", "name string, v double, country_code string, shop_id int").select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    tables.write_jsonl(df, f"{root}/l", ["country_code", "name"])
    (tmp_path / "d" / "l" / "part-late.json").write_text('{"country_code": "cut')
    assert len(tables.read_jsonl(spark, f"{root}/l", schema).collect()) == 3
    issues = spark.createDataFrame([("warning", "A")] * 2, "severity string, code string")
    status = spark.createDataFrame([("passed",)], "status string")
    made = json.loads(tables.report({"t": df}, {"t": ["country_code", "shop_id"]}, issues, status).first()["report"])
    assert made == {"tables": {"t": {"rows": 3, "missing_key_rows": 0, "duplicate_key_rows": 2}}, "issues": {"warning:A": 2}, "status": "passed"}


def test_ingest_is_whole_and_drift_is_seen(spark, tmp_path):
    source = tmp_path / "s"
    (source / "a").mkdir(parents=True)
    (source / "a" / "x.csv").write_text("k\n1\n")
    (source / "y.csv").write_text("k\n2\n")
    target = str(tmp_path / "t")
    assert {x["name"] for x in raw.ingest(spark, str(source), target).collect()} == {"a/x.csv", "y.csv"}
    assert raw.drifted(spark, target).isEmpty()
    (tmp_path / "t" / "files" / "y.csv").unlink()
    (tmp_path / "t" / "files" / ".y.csv.crc").unlink(missing_ok=True)
    (tmp_path / "t" / "files" / "y.csv").write_text("k\n3\n")
    (tmp_path / "t" / "files" / "z.csv").write_text("new")
    assert sorted(map(tuple, raw.drifted(spark, target).collect())) == [("y.csv", "changed"), ("z.csv", "added")]
    with pytest.raises(r.ContractError, match="INGEST_EXISTS"):
        raw.ingest(spark, str(source), target)
    (source / "t_202401.csv").write_text("k\n2\n")
    assert raw.read_export(spark, str(source), "t").first()["k"] == "2"
    (source / "t_202402.csv").write_text("k\n2\n")
    with pytest.raises(r.ContractError, match="EXPORT_FILES"):
        raw.read_export(spark, str(source), "t")
    assert raw.read_promotions(spark, f"{source}/t_*.csv").select("source_file").distinct().count() == 2


def test_bundles_and_the_gate(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    target = str(tmp_path / "bundle")
    assert versions.publish_bundle(spark, {"cards": (df, ["k"])}, target) and not versions.publish_bundle(spark, {"cards": (df, ["k"])}, target)
    with pytest.raises(r.ContractError, match="IMMUTABLE_INSIGHT_COLLISION"):
        versions.publish_bundle(spark, {"cards": (df.limit(1), ["k"])}, target)
    drop = tmp_path / "drop"
    drop.mkdir()
    assert versions.gate(spark, str(drop))[0] == "refused"
    content = "item_id,date,v\n1,2024-01-01,x\n2,2024-01-02,y\n3,2024-01-04,z\n"
    (drop / "products.csv").write_text(content)

    def manifest(sha, rows=3):
        (drop / "manifest.json").write_text(json.dumps({"source": "s", "exported_at": "now", "files": {"products.csv": {"sha256": sha, "rows": rows}}}))

    manifest("0" * 64)
    assert versions.gate(spark, str(drop)) == ("refused", [("file_hash_mismatch", "products.csv", "")])
    manifest(hashlib.sha256(content.encode()).hexdigest(), 4)
    verdict, issues = versions.gate(spark, str(drop), quarantine=str(tmp_path / "q"))
    assert verdict == "quarantined" and [i[0] for i in issues] == ["contract_violation", "missing_date_in_range"] and files.exists(spark, str(tmp_path / "q" / "QUARANTINE.json"))
    manifest(hashlib.sha256(content.encode()).hexdigest())
    assert versions.gate(spark, str(drop), [("products", "date")]) == ("passed", [])


def test_exports_of_another_shape_are_refused(spark):
    keys = "country_code string, shop_id int, item_id int, date string"
    promotions = spark.createDataFrame([("vn", 1, 1, "2024-01-02", 5.0), ("vn", 1, 1, "2024-01-03", 6.0)], keys + ", price double")
    stale = spark.createDataFrame([("vn", 1, 1, "2024-01-02")], keys)
    empty = spark.createDataFrame([], "country_code string, shop_id int")
    with pytest.raises(r.ContractError, match="EXPORT_STALE"):
        adapter.adapted(adapter.Export(stale, promotions, empty, empty, empty, empty, empty, empty))
    brands = spark.createDataFrame([("vn", 7, "A"), ("vn", 7, "B")], "country_code string, brand_id int, brand string")
    with pytest.raises(Exception, match="JOIN_FANOUT"):
        adapter.brand_names(brands).collect()


def test_small_groups_are_sorted_once_and_large_ones_by_ranges(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, rng.random(), 0.5, -0.0])) for g in [*range(40), None] for _ in range(rng.randrange(1, 60))] + [(99, rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, v double")
    calls, plain = [], order.running_counts
    monkeypatch.setattr(order, "running_counts", lambda *a, **k: calls.append(a) or plain(*a, **k))

    def found(nearest):
        return sorted(map(repr, order.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.37, "c": 1.0}, nearest).collect()))

    sorted_once = [found(nearest) for nearest in (False, True)]
    assert not calls
    for most in (0, 100):
        monkeypatch.setattr(order, "GATHER", most)
        assert [[x.replace("-0.0", "0.0") for x in found(nearest)] for nearest in (False, True)] == [[x.replace("-0.0", "0.0") for x in y] for y in sorted_once]
    assert len(calls) == 4


def test_profiles_of_small_shops_are_not_counted_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "running_counts", None)
    rows = [(shop, k, k % 2 == 0, float(k % 3), 2.0 + k, (shop + 1.0) * (k % 2) + k) for shop in range(4) for k in range(10)]
    df = spark.createDataFrame(rows, "shop int, item int, voucher boolean, discount double, price double, value double")
    best = tools.best_profile(tools.voucher_profile(df, "shop", "item", "voucher", "discount", "price", "value"), "shop").collect()
    assert [(x["shop"], x["listings"], x["gap"], x["profile_score"]) for x in best] == [(0, 10, -2.0, 1.0)]


def test_profiles_take_their_rows_once_and_large_shops_by_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, rng.choice([None, *range(9)]), rng.choice([None, True, False]), rng.choice([None, 0.0, 0.05, rng.random()]), rng.choice([0.0, 2.0, 7.0]), rng.choice([None, rng.random() * 9, 4.0])) for s in [*range(30), None] for _ in range(rng.randrange(1, 80))]
    df = spark.createDataFrame(rows, "shop int, item int, voucher boolean, discount double, price double, value double")

    def profiles():
        return tools.voucher_profile(df, "shop", "item", "voucher", "discount", "price", "value")

    def middle(values):
        return statistics.median(v) if (v := [x for x in values if x is not None]) else None

    want = {}
    for s in range(30):
        of = [x for x in rows if x[0] == s]
        listings, rated = len({x[1] for x in of if x[1] is not None}), [x[2] for x in of if x[2] is not None]
        with_, without = (middle([x[5] for x in of if (x[2] is True) == side]) for side in (True, False))
        depth = middle([x[3] / x[4] for x in of if x[3] is not None and x[4]])
        if listings >= 5 and with_ is not None and without is not None:
            want[s] = (listings, sum(rated) / len(rated), depth, with_ - without)
    once = profiles()
    assert "Generate" not in once._jdf.queryExecution().toString()
    found = {x["shop"]: x for x in once.collect()}
    assert set(found) == set(want) and len(want) > 10
    for s, (listings, rate, depth, gap) in want.items():
        assert found[s]["listings"] == listings and abs(found[s]["rate"] - rate) < 1e-6 and abs(found[s]["depth"] - depth) < 1e-6 and abs(found[s]["gap"] - gap) < 1e-4
    for most in (0, 40):
        monkeypatch.setattr(order, "GATHER", most)
        assert {x["shop"]: x for x in profiles().collect()} == found


def test_nearest_in_several_blocks(spark):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(k, [rng.random() - 0.5 for _ in range(4)]) for k in range(60)], "k int, v array<double>")
    one, many = (sorted(map(tuple, tools.nearest(vectors, vectors.where("k % 3 = 0"), "k", "v", 3, block).collect())) for block in (1000, 4))
    assert one == many and len(one) == 60


def test_nearest_is_the_expression_without_all_its_pairs(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for k in range(250)] + [(k, [rng.random() for _ in range(3)]) for k in range(250, 400)] + [(k, [1.0, 2.0, 3.0]) for k in range(400, 700)]
    rows += [(700, None), (701, [0.0, 0.0, 0.0]), (702, [1.0, None, 1.0]), (703, [1.0]), (704, []), (705, [1e200, 1.0, 1.0]), (706, [float("nan"), 1.0, 1.0]), (400, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "k long, v array<double>")
    queries = vectors.where("k % 20 = 0 or k > 698")
    pairs = queries.select(F.col("k").alias("query"), F.col("v").alias("q")).crossJoin(vectors).where("query <> k")
    scored = pairs.select("query", "k", F.round(numbers.cosine(F.col("v"), F.col("q")), 6).alias("similarity"))
    wanted = r.best_of(scored, ["query"], "k", [F.col("similarity").desc_nulls_last(), F.col("k").asc()], 4)
    found = tools.nearest(vectors, queries, "k", "v", 4)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    kept = vectors_of.cosine_candidates(vectors, queries.selectExpr("k as query", "v as q", "0 as block"), "k", "v", 4, 1)
    assert kept.count() < pairs.count() / 4


def test_scorecards_are_built_whole(spark):
    rows = [(f"l{k}", "vn", k % 3, D[d], float(k + d), float(k * d), k == 1) for k in range(30) for d in range(3)]
    snapshots = spark.createDataFrame(rows, "product_listing_key string, country_code string, catid_num int, date date, monthly_sold_value_num double, estimated_recent_revenue double, price_sentinel_flag boolean")
    moves = spark.createDataFrame([(f"l{k}", D[d], True, float(k - 5), 1.0) for k in range(29) for d in range(3)], "product_listing_key string, date date, transition_metric_eligible boolean, snapshot_sales_delta_clean double, price_change_percent double")
    out = {x["product_listing_key"]: x for x in mart.build_scorecard(snapshots, moves, D[2]).collect()}
    assert len(out) == 30 and out["l1"]["segment"] == "InsufficientData" and out["l1"]["revenue"] is None
    assert (out["l29"]["transition_missing"], out["l29"]["days_since_activity"], out["l9"]["days_since_activity"]) == (True, 31, 0)
    assert out["l2"]["segment"] in ("Cooling", "Dormant") and all(x["fallback"] and x["cohort_size"] == 30 for x in out.values())


def test_entities_and_scopes(spark):
    names = spark.createDataFrame([(1, "red apple cake"), (2, "red apple pie"), (3, "blue cup"), (12, "twelve")], "k int, name string")
    asked = spark.createDataFrame([(0, "blue cup"), (1, "red apple"), (2, "12"), (3, "99"), (4, " "), (5, "nothing here")], "mention int, text string")
    got = {x["mention"]: (x["k"], x["outcome"]) for x in tools.resolve_entities(asked, names, "k").collect()}
    assert got == {0: (3, "resolved"), 1: (1, "ambiguous_broad"), 2: (12, "resolved"), 3: (None, "invalid_extraction"), 4: (None, "not_found"), 5: (None, "invalid_extraction")}
    with pytest.raises(r.ContractError, match="NOT_MATERIALISED"):
        panel.passed_through(names, ["k"], ["delta"])


def test_the_metric_registry(spark):
    assert len(metrics.METRICS) == 36 and not any(n in metrics.ancestors(n) for n in metrics.METRICS)
    assert metrics.ancestors("voucher_profile_score") == ["descriptive_gap_median_sold", "has_structured_voucher", "median_discount_ratio", "voucher_rate"]
    assert metrics.descendants("has_promo") == ["discounted_listing_count", "discounted_listing_rate"] and metrics.caveats_of("similarity_score")
    df = spark.createDataFrame([(1,)], "x int")
    for call, code in ((lambda: metrics.derived(df, ["voucher_rate"]), "NOT_A_ROW_METRIC"), (lambda: metrics.derived(df, ["rating_change"]), "NOT_MATERIALISED"), (lambda: metrics.grouped(df, ["x"], ["rating_change"]), "NOT_A_GROUP_METRIC")):
        with pytest.raises(r.ContractError, match=code):
            call()
