"""Joins by likeness against all pairs."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from docketlens.operators import people
from docketlens.plans import similarity


def odd_names(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeintß") for _ in range(r.randint(1, 7)))
    base = [" ".join(["state", *[word() for _ in range(r.randint(0, 3))]][r.randint(0, 1) :]) for _ in range(n)]
    out = {"a", "ab", "ba", "state", *base}
    for b in base:
        letters = list(b)
        for _ in range(r.randint(1, 4)):
            i = r.randrange(len(letters) + 1)
            if r.random() < 0.5 and len(letters) > 1:
                letters.pop(min(i, len(letters) - 1))
            else:
                letters.insert(i, r.choice("abcdeint "))
        words = "".join(letters).split()
        r.shuffle(words)
        out |= {" ".join(words), "".join(letters).strip()}
    return sorted(out - {""})


def frame(spark, names):
    return spark.createDataFrame([(n, 1) for n in [*names, "", None]], "name string, token int").repartition(3)


@pytest.mark.parametrize("percent", [70, 75, 85, 100])
def test_alike_loses_nothing(spark, percent):
    names = odd_names(percent, 120)
    got = {(r["a"], r["b"]): r["ratio"] for r in similarity.alike(frame(spark, names), percent).collect()}
    assert got == {(a, b): x for a, b in itertools.combinations(names, 2) if (x := similarity.ratio(a, b)) >= percent / 100}


@pytest.mark.parametrize("percent", [75, 85])
def test_word_sets_lose_nothing(spark, percent):
    names = odd_names(percent, 120)
    right = names[::3]
    got = {(r["a"], r["b"]): r["score"] for r in similarity.alike_word_sets(frame(spark, names), frame(spark, right), percent).collect()}
    expected = {(a, b): x for a in names for b in right if (x := similarity.token_set_ratio(a, b)) >= percent}
    assert got == pytest.approx(expected) and any(not set(a.split()) & set(b.split()) for a, b in expected)


def all_cosines(queries, fitted, k):
    def terms(name):
        ws = [w for w in name.split(" ") if len(w) > 1]
        return collections.Counter(" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1))

    df = collections.Counter(t for f in fitted for t in terms(f))
    idf = {t: math.log((1 + len(fitted)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(name):
        v = {t: n * idf[t] for t, n in terms(name).items() if t in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    vectors, out = {f: vector(f) for f in fitted}, {}
    for q in queries:
        v = vector(q)
        scores = sorted((-round(sum(x * w.get(t, 0) for t, x in v.items()), 9), f) for f, w in vectors.items() if v.keys() & w.keys())
        out |= {(q, i + 1): (f, -s) for i, (s, f) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_is_exact(spark, k):
    r = random.Random(k)
    vocabulary = ["court", "of", "the", "judge", "x", *[f"w{i}" for i in range(30)]]
    made = lambda n: sorted({" ".join(r.choices(vocabulary, [40, 30, 30, 20, 9, *[1] * 30], k=r.randint(1, 6))) for _ in range(n)})
    fitted, queries = made(80), [*made(40), "unknown words"]
    got = {(x["a"], x["place"]): (x["b"], x["cosine"]) for x in similarity.nearest(frame(spark, queries), frame(spark, fitted).where("name <> ''"), k).collect()}
    expected = all_cosines(queries, fitted, k)
    assert {key: v[1] for key, v in got.items()} == pytest.approx({key: v[1] for key, v in expected.items()}, abs=1e-8)
    assert sum(got[key][0] == expected[key][0] for key in got) > 0.95 * len(got)  # equal cosines may differ in their last digit


def pool_by_all_pairs(names, known):
    grams = lambda s: {p[i : i + 3] for w in s.split() for p in [f"  {w} "] for i in range(len(p) - 2)}
    out = set()
    for name, court in names:
        near = []
        for other, c, judge in known:
            a, b = grams(name), grams(other)
            if a and b and (court is None or c is None or c == court) and len(a & b) / len(a | b) > 0.30:
                near.append((-len(a & b) / len(a | b), judge))
        out |= {(name, court, j) for _, j in sorted(near)[:30]}
    return out


def test_pools_shut_other_courts_out(spark):
    r = random.Random(9)
    texts = odd_names(9, 60)
    names = sorted({(r.choice(texts), r.choice([1, 2, None])) for _ in range(60)}, key=str)
    known = [(n, r.choice([1, 2, 3, None]), i) for i, n in enumerate(texts)] + [("state abc", 1, 1000 + i) for i in range(40)]
    df = spark.createDataFrame(known, "known string, court int, judge_id long").withColumn("sound", F.lit(""))
    got = people.pool(spark.createDataFrame(names, "name string, court_id int"), df)
    assert {(x["name"], x["court_id"], x["judge_id"]) for x in got.collect()} == pool_by_all_pairs(names, known)


def test_merges_over_all_entries(spark):
    r = random.Random(3)
    rows = [(i, r.choice([1, 2, None]), r.choice(odd_names(4, 12)[:30])) for i in range(90)] + [(900, 1, ""), (901, 1, None)]
    df = spark.createDataFrame(rows, "id long, court int, name string")
    sound = {x["name"]: x["k"] for x in df.select("name", people.phonetic_key(F.col("name")).alias("k")).distinct().collect()}
    newest, head, expected = {}, {}, set()
    for i, c, n in rows:
        if n:
            newest[n, c] = max(newest.get((n, c), -1), i)
            head[n] = max(head.get(n, -1), i)
    expected |= {(newest[n, c], i, 0.99) for i, c, n in rows if n and newest[n, c] != i} | {(head[n], i, 0.99) for (n, _), i in newest.items() if head[n] != i}
    for ((a, ca), i), ((b, cb), j) in itertools.combinations(newest.items(), 2):
        score = round(similarity.ratio(a, b) + 0.05 * (ca == cb and ca is not None) + 0.05 * (sound[a] == sound[b]), 6)
        if a != b and score >= 0.85:
            expected.add((max(i, j), min(i, j), min(0.99, score)))
    assert {tuple(x) for x in people.merge_pairs(df).collect()} == expected


def test_officials_are_the_best_of_all(spark):
    parties, known = odd_names(6, 50), odd_names(7, 20)[:25] + odd_names(6, 50)[::7]
    left = spark.createDataFrame([*enumerate(parties), (999, None), (998, "")], "party long, name string")
    got = {x["party"]: (x["official"], x["confidence"]) for x in people.official_links(left, spark.createDataFrame(list(enumerate(known)), "official long, name string")).collect()}
    norm = lambda names: [x[0] for x in spark.createDataFrame([(n,) for n in names], "n string").select(people.normalised_name(F.col("n"))).collect()]
    expected = {}
    others = norm(known)
    for i, p in enumerate(norm(parties)):
        score, j = max((similarity.token_set_ratio(p, o), -j) for j, o in enumerate(others))
        if score >= 85:
            expected[i] = (others.index(others[-j]), round(score / 100, 2))
    assert got == expected and expected


def test_names_fold_width_and_case(spark):
    names = ["ＪＵＳＴＩＣＥ Straße", "Coram: Hon'ble ÉMILE", None, ""]
    got = [x[0] for x in spark.createDataFrame([(n,) for n in names], "n string").select(people.normalised_name(F.col("n"))).collect()]
    assert got == ["strasse", "émile", "", ""]


def test_nearest_of_common_words_makes_few_lookups(spark):
    fitted = [f"{('north', 'south')[i % 2]} judge {i:04d}" for i in range(400)]
    queries = [f"{('north', 'south', 'east')[i % 3]} party {i:04d}" for i in range(0, 900, 7)]
    made = frame(spark, fitted).where("name <> ''")
    got = {(x["a"], x["place"]): (x["b"], x["cosine"]) for x in similarity.nearest(frame(spark, queries), made, 5).collect()}
    expected = all_cosines(queries, fitted, 5)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in expected.items()}, abs=1e-8)
    # Four frequent terms lead to five names of either make, however many names there are.
    found = similarity.lookups_in(similarity.tf_idf(made, made), 5).where("t IN ('north', 'south', 'judge', 'north judge', 'south judge')")
    assert 0 < found.count() <= 2 * 5 * 3


@pytest.mark.parametrize("most", [1, 7, 40, 500])
def test_best_merges_are_the_first_of_all(spark, most, monkeypatch):
    r = random.Random(5)
    pool = [n for n in odd_names(5, 12) if len(n) > 6][:12]
    long = ["justice abcdefghijklmnopqrst", "justice abcdefghijklmnopqrstu", "justice abcdefghijklmnopqrstuv"]
    rows = [(i, r.choice([1, 2, None]), r.choice(pool)) for i in range(90)] + [(200 + i, 1, n) for i, n in enumerate(long)] + [(900, 1, ""), (901, 1, None)]
    df = spark.createDataFrame(rows, "id long, court int, name string")
    expected = sorted((x["score"], x["id"], x["other"]) for x in people.merge_pairs(df).collect())[::-1][:most]
    if most <= 40:
        monkeypatch.setattr(people, "alike", None)  # all pairs of names are not needed
    assert [(x["score"], x["id"], x["other"]) for x in people.best_merges(df, most).collect()] == expected
    assert (0.99, 202, 201) in expected


@pytest.mark.parametrize(("least", "pool"), [(0.3, 4), (0.6, 30), (0.0, 3)])
def test_alike_sets_lose_nothing(spark, least, pool):
    r = random.Random(pool)
    grams = lambda text: sorted({text[i : i + 3] for i in range(len(text) - 2)})
    name = lambda head: f"  {head}#{r.choice((3, 40, 500, 60_000)) + r.randrange(200):09d} "
    left = [(i, grams(name("supplier"))) for i in range(60)] + [(90, grams("ab#0")), (91, []), (92, grams("  supplier#000000123 ")), (93, grams("  supplier#000000123 "))]
    right = [(i, grams(name(r.choice(("customer", "supplier", "suplier"))))) for i in range(150)] + [(i, grams("  customer#000000123 ")) for i in range(200, 240)] + [(300, grams("#000")), (301, []), (302, grams("other words of some length, none of which is shared"))]
    frame = lambda rows: spark.createDataFrame(rows, "id long, grams array<string>")
    expected = set()
    for s, g in left:
        found = [(-round(len(set(g) & set(h)) / len(set(g) | set(h)), 6), k) for k, h in right if set(g) & set(h) and len(set(g) & set(h)) / len(set(g) | set(h)) > least]
        expected |= {(s, k, -sim) for sim, k in sorted(found)[:pool]}
    assert {tuple(x) for x in similarity.alike_sets(frame(left), frame(right), least, pool).collect()} == expected
    assert len(expected) > 30


def test_sets_meet_on_several_grams_at_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(similarity, "checkpoint", lambda df: met.append(df) or df)
    frame = lambda head, n: spark.createDataFrame([(i, sorted({text[j : j + 3] for j in range(len(text) - 2)})) for i in range(n) for text in [f"  {head}#{7 * i:09d} "]], "id long, grams array<string>")
    similarity.alike_sets(frame("supplier", 500), frame("customer", 500), 0.3, 30)
    plan = met[-1].toPandas()
    assert (plan["j"] == similarity.TOGETHER).any() and (plan["a"] >= plan["j"]).all()


def test_alike_sets_broadcast_no_sets(spark, tmp_path):
    """Names from small files, by whose size Spark would broadcast the sets and keys made of them."""
    from docketlens.operators.feeds import trigrams

    def frame(kind):
        names = spark.range(300).select("id", F.concat(F.lit(kind), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"))
        names.write.parquet(str(tmp_path / kind))
        return spark.read.parquet(str(tmp_path / kind)).select("id", F.array_sort(trigrams(F.col("name"))).alias("grams"))

    plan = similarity.alike_sets(frame("supplier"), frame("customer"), 0.3, 30)._jdf.queryExecution().executedPlan().toString()
    # Only the few pairs of sizes are broadcast, once for either side.
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 7
