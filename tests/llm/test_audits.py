"""Filter audit, toxicity and conversation repair against plain versions of themselves."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from docketlens.llm import conversation_repair as cr
from docketlens.llm import filter_audit as fa
from docketlens.llm import queries, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Filter interaction audit


def plain_measures(text: str) -> list[int]:
    words = WORDS.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))]


def odd_texts() -> list[str]:
    r = random.Random(5)
    alphabet = ["a", "B", "ß", "€", "𝔸", " ", "\n", "\t", "#", "|", " ", "\u0085"]
    some = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    return ["", " ", "a", "a a", " a ", "é", " ", "x" * 5000, "word " * 3000, "Ab Ab ab\x0bAb", *some]


@pytest.mark.parametrize("block", [8, 100, fa.BLOCK])
def test_transducer(block):
    texts = odd_texts()
    got = fa.measure([t.encode() for t in texts], block)
    assert got.tolist() == [plain_measures(t) for t in texts]


def test_hash_table_compares_bytes(monkeypatch):
    """With a rolling hash that says nothing, words of equal length are still told apart."""
    monkeypatch.setattr(fa, "powers", lambda base, n: fa.np.zeros(n, fa.np.uint64))
    texts = odd_texts()[:120]
    assert fa.measure([t.encode() for t in texts], 1000).tolist() == [plain_measures(t) for t in texts]


def plain_audit(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[k] == 1} - {None} for k in ("quality", "toxic"))
    least: dict[str, int] = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    rows = []
    for d in docs:
        t, i = d["text"] or "", d["doc_id"]
        n, distinct, capitals, points, symbols = plain_measures(t)
        failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, symbols > 0, i is not None and least[t] < i]
        rows.append((d["lang"] or "", {f for f, bad in zip("ABCDE", failed, strict=True) if bad}, i in good, i in toxic))
    out = collections.defaultdict(lambda: [0] * 6)
    removed_by = collections.Counter()
    for part, fails, is_good, is_toxic in rows:
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                o = out[part, "".join(order), step]
                removed = not gone and f in fails
                o[0] += not gone and not removed
                o[1] += removed
                o[2] += gone and f in fails
                o[3] += fails == {f}
                o[4] += removed and is_good
                o[5] += removed and is_toxic
                removed_by[part, f] += removed
                gone |= removed
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark, messy, small):
    labels = spark.createDataFrame([(0, 1, 0, 5), (1, 1, 1, 5), (1, 0, 0, 5), (3, None, 1, 5), (None, 1, 1, 5), (99, 1, 1, 5)], "doc_id long, quality int, toxic int, part int")
    for docs, marks in ((messy, labels), (spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))):
        got = fa.audit(docs, marks)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == plain_audit(docs.collect(), marks.collect())


def test_audit_of_nothing(spark, empty):
    assert fa.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_op11_sql(spark, duck, small):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.OP11_SQL})").fetchall()
    assert collections.Counter(found) == collections.Counter(map(tuple, queries.op11_filter_audit(spark, small).collect()))


# Toxicity


def plain_ratio(training: dict[int, collections.Counter], word: str) -> float:
    """The two models by recursion over the words' counts."""
    import math

    chain = lambda w: toxicity.FIRST + w + toxicity.LAST
    tops = {c: collections.Counter() for c in (0, 1)}
    for c, words in training.items():
        for w, n in words.items():
            s = chain(w)
            for i in range(1, len(s)):
                tops[c][s[max(0, i - toxicity.ORDER + 1) : i + 1]] += n
    tops["both"] = tops[0] + tops[1]
    tables: dict = {}
    for c, top in tops.items():
        top = {g: n for g, n in top.items() if n}
        level = {g: n for g, n in top.items() if len(g) == toxicity.ORDER}
        tables[c, toxicity.ORDER] = level
        for n in range(toxicity.ORDER - 1, 0, -1):
            below = collections.Counter(g[1:] for g in level)
            level = {**below, **{g: k for g, k in top.items() if len(g) == n}}
            tables[c, n] = level
    alphabet = len({x for w in {*training[0], *training[1], word} for x in chain(w)[1:]}) + 1

    def probability(c, g):
        if not g:
            return 1 / alphabet
        level = tables[c if len(g) > toxicity.SHARED else "both", len(g)]
        same = {x: n for x, n in level.items() if x[:-1] == g[:-1]}
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.75
        below, total = probability(c, g[1:]), sum(same.values())
        return (max(same.get(g, 0) - d, 0) + d * len(same) * below) / total if total else below

    s = chain(word)
    at = [s[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(s))]
    return sum(math.log(probability(1, g)) - math.log(probability(0, g)) for g in at)


def test_word_values_are_those_of_the_models(spark):
    ordinary, toxic = collections.Counter({"house": 5, "mouse": 2, "das": 9, "idea": 1, "ä": 2}), collections.Counter({"idiot": 4, "idiotic": 1, "das": 2, "house": 1})
    others = ["idiots", "unseen", "𝔸b", "e"]
    counts = spark.createDataFrame([(w, 1, ordinary[w], toxic[w]) for w in {*ordinary, *toxic, *others}], "word string, n long, ordinary long, toxic long")
    got = {r["word"]: r["value"] for r in toxicity.word_values(counts).collect()}
    # the alphabet is that of all words
    for w in others:
        ordinary[w] += 0
    expected = {w: plain_ratio({0: ordinary, 1: toxic}, w) for w in got}
    assert got == pytest.approx(expected)
    assert got["idiots"] > 3 and abs(got["unseen"]) < 2


def test_toxicity_finds_what_is_held_out(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op12_toxicity(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    scored = rows.collect()
    assert collections.Counter(r["doc_id"] for r in scored) == collections.Counter(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.9


def test_toxicity_of_odd_rows(spark, messy, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(messy, labels).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in messy.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert len({r["ratio"] for r in got if r["doc_id"] == 1}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(messy, labels.limit(0)).collect()} == {0}


# Conversation repair


def legal(roles: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """All edits of a few turns (initial, fault), with up to two insertions in a gap, in full."""
    best = None
    for edits in itertools.product("KRD", repeat=len(turns)):
        for gaps in itertools.product((0, 1, 2), repeat=len(turns) + 1):
            cost = 3 * sum(gaps) + sum({"K": 0, "R": 3, "D": 4}[e] for e in edits) + sum(3 for e, (_, f) in zip(edits, turns, strict=True) if e != "D" and f == "t")
            if (best and cost > best[0]) or any(f == "d" and e != "D" for e, (_, f) in zip(edits, turns, strict=True)):
                continue
            audit = "".join("I" * g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            free = [i for i, e in enumerate(audit) if e in "IR"]
            kept = iter([r for e, (r, _) in zip(edits, turns, strict=True) if e == "K"])
            roles = [next(kept) if e == "K" else "" for e in audit if e != "D"]
            at = [i for i, e in enumerate(e for e in audit if e != "D") if e in "IR"]
            for named in itertools.product("ua", repeat=len(free)):
                full = list(roles)
                for i, n in zip(at, named, strict=True):
                    full[i] = n
                if legal("".join(full)) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def repair_alone(seq: str, rules=()) -> tuple[int, str]:
    known = cr.matrices(list(rules))
    paths = {cr.EMPTY: cr.Path(0, ())}
    for head, c in enumerate(cr.compressed(seq, list(rules))):
        paths = cr.step(paths, head, known[c])
    best = cr.finish(paths)
    return best.cost, cr.spelled(best)


def test_programme_finds_the_cheapest_edits():
    r = random.Random(1)
    for _ in range(120):
        seq = "".join(r.choice(list(cr.SYMBOLS)) for _ in range(r.randint(1, 4)))
        assert repair_alone(seq) == cheapest([cr.SYMBOLS[c] for c in seq])


def test_rules_and_chunks_change_nothing():
    r = random.Random(2)
    for _ in range(200):
        seq = "".join(r.choice(list(cr.SYMBOLS)) for _ in range(r.randint(1, 40)))
        rules = []
        for k in range(r.randint(0, 12)):
            short = cr.compressed(seq, rules)
            if len(short) > 1:
                i = r.randrange(len(short) - 1)
                rules.append((chr(cr.FIRST_RULE + k), short[i : i + 2]))
        whole = repair_alone(seq)
        assert repair_alone(seq, rules) == whole
        known, paths, done = cr.matrices(rules), {cr.EMPTY: cr.Path(0, ())}, []
        for at in range(0, len(seq), 3):
            m = None
            for c in cr.compressed(seq[at : at + 3], rules):
                m = known[c] if m is None else cr.product(m, known[c])
            paths, more = cr.settle(cr.step(paths, at, m))
            done += more
        best = cr.finish(paths)
        assert (best.cost, "".join(p[2] for p in [*done, *best.open])) == whole
        states = [p[1] for p in [*done, *best.open]]
        assert states[0] == cr.EMPTY and len(states) == -(-len(seq) // 3)


def plain_repair(rows):
    """conv_id -> all columns, a conversation at a time."""
    space = lambda v: " " if v is None else str(v)
    convs = collections.defaultdict(list)
    for r in rows:
        turns = convs[r["conv_id"]]
        code = zlib.crc32(f"{space(r['conv_id'])}:{space(r['turn'])}".encode()) % 20
        role, text = space(r["role"]), space(r["text"])
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            turns += [(r["turn"], "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        h = lambda t: (t[0] is not None, t[0] or 0, t[1])
        turns.sort(key=h)
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        seq = "".join(next(c for c, s in cr.SYMBOLS.items() if s == (i if i in ("s", "u", "a") else "?", {"none": "k", "truncated": "t"}.get(f, "d"))) for i, f in zip(initials, faults, strict=True))
        cost, audit = repair_alone(seq) if seq else (0, "")
        lines, rest, last = [], iter(turns), ""
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(rest)
            if e != "D":
                role = role if e == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{text}")
        assert legal("".join(x[0] for x in lines))
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *counts, illegal, cost, audit, sha("\n".join(lines)))
    return out


def check_repair(df):
    got = cr.repaired(df, cr.damaged(df)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain_repair(df.collect())


def test_repair_of_the_table(spark, small):
    df = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    check_repair(df)
    assert queries.op13_conversation_repair(spark, small).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_of_odd_rows(spark):
    r = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Ünit"], ["Hi.", "so", " ", "", None, "What?\n", "no end \t", "x" * 3000 + "."]
    rows = [(c, t, r.choice(roles), r.choice(texts), 1, "x", 2) for c in range(60) for t in r.sample(range(-3, 40), r.randint(1, 9))]
    rows += [(None, t, "user", "A.", 1, "x", 2) for t in range(5)] + [(70, None, "system", "S.", 1, "x", 2), (70, 4, "user", "U.", 1, "x", 2), (71, None, None, None, 1, "x", 2)]
    rows += [(80, t, r.choice(roles[:3]), f"{t}." if t % 7 else f"{t}", 1, "x", 2) for t in range(1500)]  # a long one, many chunks
    rows += [(90, 5, "user", "same.", 1, "x", 2)] * 400  # repeated rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head int, state string, cost int").repartition(5)
    check_repair(df)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repaired(df, cr.damaged(df)).count() == 0


def test_conversations_that_lose_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in cr.repaired(df, cr.damaged(df)).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_rules_come_from_all_sequences(spark):
    rules = cr.re_pair(spark.createDataFrame([("DGDGDG", 5), ("DGA", 1), ("GGGG", 2)], "seq string, n long"))
    assert rules[0][1] == "DG" and len(dict(rules)) == len(rules)
    assert cr.compressed("DGDGDGDG", rules) != "DGDGDGDG"
