import random

from sparkloom.operators import graph, search


def test_strong_components_of_long_rings_take_few_jobs(spark):
    n, r = 3000, random.Random(5)
    names = [f"x{k}" for k in range(n)]
    r.shuffle(names)
    edges = [(names[k], names[(k + 1) % n]) for k in range(n)] + [("a", names[0]), (names[7], "b"), ("b", "c"), ("c", "b")]
    spark.sparkContext.setJobGroup("long-rings", "")
    got = {x["id"]: x["component"] for x in graph.strong_components(spark.createDataFrame(edges, "source string, target string")).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-rings"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(names, min(names)) | {"b": "b", "c": "b"}
    assert jobs < 400


def test_a_cycle_is_turned_to_its_least_joined_names_and_ways_out_of_it_stay_short():
    r = random.Random(6)
    for _ in range(200):
        ring = r.sample(["".join(r.choices("ab", k=r.randint(1, 6))) for _ in range(30)], r.randint(1, 12))
        want = min((ring[i:] + ring[:i] for i in range(len(ring))), key="".join)
        assert graph.turned(ring, ring) == want
    targets = {f"n{k:05}": [(f"e{k:05}", f"n{(k + 1) % 5000:05}"), (f"f{k:05}", "out")] for k in range(5000)}
    rings, depth, left = search._walk(["n00000"], targets, {}, {f"f{k:05}" for k in range(5000)})
    assert len(rings) == 1 and len(depth) == 5000 and [e for e, _ in left] == [f"f{k:05}" for k in reversed(range(5000))]
