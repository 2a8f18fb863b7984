"""Version keys against the packaging library and a plain RPM comparison; the interval join against all pairs."""

from __future__ import annotations

import random
import re

import pytest
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from palisark.functions import versions
from palisark.operators import intervals


def some_version(rng):
    n = lambda: rng.choice(["0", "1", "2", "10", "007", "20240101", "99999999999999999999999999"])
    sep = lambda: rng.choice(["", ".", "-", "_"])
    out = rng.choice(["", "", "v", " ", "V"]) + rng.choice(["", "", "", n() + "!"]) + ".".join(n() for _ in range(rng.randrange(1, 5)))
    if rng.random() < 0.4:
        out += sep() + rng.choice(["a", "b", "rc", "c", "alpha", "beta", "pre", "preview", "RC"]) + sep() + rng.choice(["", n()])
    if rng.random() < 0.3:
        out += rng.choice(["-" + n(), sep() + rng.choice(["post", "rev", "r"]) + sep() + rng.choice(["", n()])])
    if rng.random() < 0.3:
        out += sep() + "dev" + sep() + rng.choice(["", n()])
    if rng.random() < 0.3:
        out += "+" + rng.choice([".", "-", "_"]).join(rng.choice(["1", "02", "10", "a", "ab", "abc", "1a", "ubuntu"]) for _ in range(rng.randrange(1, 4)))
    return out + rng.choice(["", "", "", " ", "x", "..1", "|"])


def test_pep440_keys_order_as_packaging_does(spark):
    rng = random.Random(1)
    pairs = [(some_version(rng), some_version(rng)) for _ in range(6000)]
    pairs += [(a, rng.choice([a.upper(), a + ".0", a.replace("-", "."), re.sub(r"\d+$", "3", a)])) for a, _ in pairs[:4000]]

    def parsed(v):
        try:
            return Version(v)
        except InvalidVersion:
            return None

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    plan = df.withColumn("cmp", versions.compare_pep440("a", "b"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    found = {r.i: r.cmp for r in df.withColumn("cmp", versions.compare_pep440(F.col("a"), F.col("b"))).collect()}
    unlike = []
    for i, (a, b) in enumerate(pairs):
        x, y = parsed(a), parsed(b)
        want = None if x is None or y is None else (x > y) - (x < y)
        if found[i] != want:
            unlike.append((a, b, want, found[i]))
    assert not unlike, unlike[:5]
    assert sum(v is not None for v in found.values()) > 4000


def rpm_parts(v):
    epoch, rest = v.split(":", 1) if ":" in v else ("0", v)
    version, release = rest.split("-", 1) if "-" in rest else (rest, "")
    return int(epoch) if re.fullmatch(r"[+-]?\d{1,18}", epoch) else 0, version, release


def rpm_segments(a, b):
    x, y = (re.findall(r"\d+|[a-zA-Z]+", t) for t in (a, b))
    for i in range(max(len(x), len(y))):
        p, q = x[i] if i < len(x) else "0", y[i] if i < len(y) else "0"
        p, q = (int(p), int(q)) if p.isdigit() and q.isdigit() else (p, q)
        if p != q:
            return -1 if p < q else 1
    return 0


def rpm_cmp(a, b):
    (e, v, r), (f, w, s) = rpm_parts(a), rpm_parts(b)
    return (e > f) - (e < f) or rpm_segments(v, w) or rpm_segments(r, s)


def test_rpm_keys_order_as_segments_do(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice(["0", "00", "1", "9", "10", "a", "el", "Z", ".", ".", "_", "~", "9" * 40]) for _ in range(rng.randrange(7)))
    one = lambda: rng.choice(["", "", "1:", "0:", "x:", "-1:"]) + part() + rng.choice(["", "-" + part()])
    pairs = [(one(), one()) for _ in range(4000)] + [(a, a + s) for a in [one() for _ in range(1000)] for s in (".0", "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    found = {r.i: r.cmp for r in df.withColumn("cmp", versions.compare_rpm(F.col("a"), F.col("b"))).collect()}
    unlike = [(a, b, rpm_cmp(a, b), found[i]) for i, (a, b) in enumerate(pairs) if found[i] != rpm_cmp(a, b)]
    assert not unlike, unlike[:5]


@pytest.mark.parametrize("seed", [0, 1])
def test_interval_join_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    bound = lambda: rng.choice([None, *range(-2, 40)])
    points = [(i, rng.choice("aabc"), rng.choice([None, *range(-5, 45)])) for i in range(200)] + [(900, None, 3), (901, "only points", 3)]
    ranges = [(j, rng.choice("aaab"), bound(), bound()) for j in range(120)] + [(900, "only ranges", 1, 2), (901, "c", None, None), (902, None, 1, 9)]
    p = spark.createDataFrame(points, "i int, g string, k int").repartition(5)
    r = spark.createDataFrame(ranges, "j int, g string, lo int, hi int").repartition(3)
    want = sorted((i, j) for i, g, k in points for j, h, lo, hi in ranges if g == h and g is not None and k is not None and (lo is None or lo <= k) and (hi is None or k < hi) and not (lo is None and hi is None))
    got = sorted((x.i, x.j) for x in intervals.interval_join(p, r.where("lo is not null or hi is not null"), ["g"], "k", "lo", "hi").collect())
    assert got == want


def test_rows_of_the_join_grow_with_its_result(spark):
    n = 20_000
    p = spark.range(n).selectExpr("id as i", "'hot' as g", "id * 2 as k")
    nested = spark.range(n).selectExpr("id as j", "'hot' as g", "id * 2 as lo", "id * 2 + 3 as hi")  # each holds two points
    out = intervals.interval_join(p, nested, ["g"], "k", "lo", "hi")
    assert out.count() == 2 * n - 1
    assert "g" in out.columns and set(out.columns) == {"g", "i", "j"}
    wide = spark.range(50).selectExpr("id as j", "'hot' as g", "id as lo", "100000 - id as hi")  # nested, all hold all but a few
    assert intervals.interval_join(p, wide, ["g"], "k", "lo", "hi").count() == sum(max(0, n - -(-j // 2)) for j in range(50))


def test_empty_sides(spark):
    p, r = spark.createDataFrame([], "i int, g string, k int"), spark.createDataFrame([], "j int, g string, lo int, hi int")
    assert intervals.interval_join(p, r, ["g"], "k", "lo", "hi").collect() == []
    one = spark.createDataFrame([(1, "a", 1)], "i int, g string, k int")
    assert intervals.interval_join(one, r, ["g"], "k", "lo", "hi").collect() == []


def test_ranges_are_found_alike_by_either_join(spark):
    from palisark.operators import vulnerabilities

    rng = random.Random(9)
    some = lambda: rng.choice(["", *(f"{rng.randrange(4)}.{rng.randrange(4)}{rng.choice(['', '.1', '.1.2', '-rc1', 'b2', '.dev1', '.x', '+l'])}" for _ in range(6))])
    deps = spark.createDataFrame([(i, rng.choice(["npm", "pypi"]), rng.choice("ab"), some()) for i in range(150)], "i int, ecosystem string, name string, version string")
    known = spark.createDataFrame([(j, rng.choice(["npm", "pypi"]), rng.choice("ab"), some(), some()) for j in range(150)], "j int, ecosystem string, name string, version_introduced string, version_fixed string")
    found = [sorted((r.i, r.j) for r in vulnerabilities.versions_in_ranges(deps, known, few).collect()) for few in (1000, 1)]
    assert found[0] == found[1] and len(found[0]) > 500
    both = deps.join(known, ["ecosystem", "name"]).where(versions.is_vulnerable(F.col("version"), F.col("version_introduced"), F.col("version_fixed"), F.col("ecosystem")))
    assert found[0] == sorted((r.i, r.j) for r in both.collect())


def test_points_and_intervals_are_shuffled_a_few_times_only(spark):
    """What is shuffled is points, intervals and blocks, not either side once for each level of a tree."""
    n, size = 20_000, "spark.sql.autoBroadcastJoinThreshold"
    p = spark.range(n).selectExpr("id as i", "'hot' as g", "id * 2 as k")
    wide = spark.range(n).selectExpr("id as j", "'hot' as g", "id * 2 + 1 as lo", "id * 2 + 601 as hi")  # each holds 300 points
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    old, earlier = spark.conf.get(size), set(shuffled())
    try:
        spark.conf.set(size, "-1")
        assert intervals.interval_join(p, wide, ["g"], "k", "lo", "hi").count() == sum(min(300, n - 1 - j) for j in range(n))
    finally:
        spark.conf.set(size, old)
    assert sum(v for k, v in shuffled().items() if k not in earlier) < 14 * n


def test_the_result_takes_a_fraction_of_a_byte_a_row(spark, tmp_path):
    """Rows are listed so that points repeat and intervals stay, which is what makes a large result small on disk."""
    p = spark.range(20_000).selectExpr("xxhash64(id) as i", "'hot' as g", "id as k")
    wide = spark.range(1000).selectExpr("xxhash64(-id) as j", "'hot' as g", "id * 15 as lo", "id * 15 + 5000 as hi")  # each holds 5,000 points
    intervals.interval_join(p, wide, ["g"], "k", "lo", "hi").select("i", "j").write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5_000_000
    assert sum(x.stat().st_size for x in tmp_path.rglob("*.parquet")) < 2_000_000


def test_blocks_with_many_intervals_are_dealt_to_lots(spark):
    """Whole chunks, cut ones, the last one, which isn't full, and intervals of one run; before and after every edge of a chunk."""
    n = 9000
    p = spark.range(n).selectExpr("id as i", "if(id < 10, 'few', 'many') as g", "(id * 7919) % 9000 as k")
    alike = spark.range(15_000).selectExpr("id as j", "'few' as g", "cast(null as long) as lo", "9000L as hi")
    edges = spark.range(1500).selectExpr("100000 + id as j", "'many' as g", "if(id % 50 = 0, null, (id * 37) % 9100 - 50) as lo", "if(id % 70 = 3, null, (id * 37) % 9100 + (id * 13) % 700) as hi")
    r = alike.unionByName(edges).where("lo is not null or hi is not null")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("i", "j").cast("decimal(38,0)")), F.count_distinct("g")).first()
    got = total(intervals.interval_join(p, r, ["g"], "k", "lo", "hi"))
    assert got == total(p.join(r, "g").where("(lo is null or lo <= k) and (hi is null or k < hi)"))
    assert got[0] > 600_000 and got[2] == 2
