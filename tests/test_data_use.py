import random

from polyloci.operators import policy as P

REQUEST = "request_id long, disease string, geography string, requester string, project string, institution string, ethics_approval string, purposes array<string>, acknowledged array<string>, " + ", ".join(f"{f} boolean" for f in sorted({f for v in P.ATTESTED.values() for f in v}))


def test_rules_judged_once_are_rules_judged_by_pair(spark):
    rng = random.Random(6)
    codes = [*P.ATTESTED, *P.COMPARED, P.NO_METHODS, P.GENETIC_ONLY, P.NO_ANCESTRY, P.ETHICS, P.TIME_LIMIT, P.CLINICAL_CARE, "DUO:9999999", " DUO:0000046 ", None]
    values = [None, [], [""], ["alpha"], ["2030-01-01"], ["2000-01-01", None], [" Beta "]]
    permissions = [P.UNRESTRICTED, P.GENERAL, P.HEALTH, P.DISEASE, P.POPULATION, None, "other"]
    profiles = []
    for d in range(120):
        own = [(rng.choice(codes), rng.choice(values)) for _ in range(rng.randint(0, 4))]
        profiles.append((d % 100, rng.choice(permissions), rng.choice([None, ["Asthma"], [None, "gout "]]), None if d % 11 == 0 else own + own[:1]))
    some = [None, "", "asthma", "alpha", "beta", "2026"]
    requests = [(r, *[rng.choice(some) for _ in range(6)], rng.choice([None, [], [P.METHODS], [P.GENETIC], [P.ANCESTRY[0], P.GENETIC]]), rng.choice([None, [P.TIME_LIMIT, "DUO:9999999"]]), *[rng.choice([None, True, False]) for _ in range(len(REQUEST.split(",")) - 9)]) for r in range(17)]
    d = spark.createDataFrame(profiles, "dataset_id long, permission string, permission_value array<string>, modifiers array<struct<id: string, value: array<string>>>")
    q = spark.createDataFrame(requests, REQUEST)
    once = sorted(map(str, P.evaluate_data_use(d, q, "2025-06-01").collect()))
    assert len(once) == 120 * 17 and once == sorted(map(str, P.evaluate_data_use(d, q, "2025-06-01", cells=0).collect()))
    assert {x.split("decision='")[1].split("'")[0] for x in once} == {"permitted", "denied", "undetermined"}


def test_no_datasets_and_no_requests(spark):
    d = spark.createDataFrame([(1, P.GENERAL, None, None)], "dataset_id long, permission string, permission_value array<string>, modifiers array<struct<id: string, value: array<string>>>")
    q = spark.createDataFrame([], REQUEST)
    assert P.evaluate_data_use(d, q, "2025-06-01").count() == 0 and P.evaluate_data_use(d.limit(0), q, "2025-06-01").count() == 0
