"""The registered queries on whole small tables: against DuckDB where there is SQL, else against plain Python; and the pipeline's stages."""

import collections
import hashlib
import re
import zlib

import pytest

from docketlens.llm import mixing, ngram_join, quality_rules, queries, secrets, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, duck, small):
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = collections.Counter(repr([r[c] for c in columns]) for r in df.collect())
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == collections.Counter(repr([r[i] for i in at]) for r in cursor.fetchall())


def test_op1_places_rows_by_formula(spark, small, texts):
    rows = queries.op1_sharding(spark, small).collect()
    order = sorted((k, zlib.crc32(t.encode()), len(t.encode()) + 1) for k, t in texts.items())
    expected = {k: (size, crc, "rows", *sharding.locate(i, len(order), 16, 20_240_117), None) for i, (k, crc, size) in enumerate(order)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in rows} == expected


def test_op3_columns(spark, small):
    df = queries.op3_html_extraction(spark, small)
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_op8_digests(spark, small, texts):
    keys = sorted(texts)
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, small).collect()}
    assert rows.keys() == texts.keys()
    for i, k in enumerate(keys):
        text, after = texts[k], texts[keys[(i + 1) % len(keys)]]
        half = len(text) // 2
        assert (rows[k]["n_chars"], rows[k]["edited_sha256"]) == (len(text), sha(text[: len(text) - half] + after[:half]))
        assert rows[k]["near_next"] == float(rows[k]["fingerprint"] == rows[keys[(i + 1) % len(keys)]]["fingerprint"])


def test_op9_digests(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_bpe(spark, small).collect()}
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert rows[k] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op10_digests(spark, messy, tmp_path):
    """The corpus of this size has no secrets, so the odd rows take its place."""
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    listed = lambda xs: ",".join(f"{a}:{b}:{c}" for a, b, c in xs)
    expected = collections.Counter()
    for d in messy.select("doc_id", "text").collect():
        spans = secrets.scan(d["text"] or "")
        base = [s for s in spans if s[0] in secrets.BASE_KINDS]
        expected[(d["doc_id"], *[sum(s[0] == kind for s in spans) for kind in secrets.BASE_KINDS], sha(listed(base)), listed(spans))] += 1
    df = queries.op10_secrets(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert rows_of(df) == expected and any(k[1] and k[3] for k in expected)


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_ngram_join", "op7_mixing"])
def test_columns_and_rows(name, spark, small, texts):
    df = queries.queries()[name](spark, small)
    columns = {"op6_ngram_join": ["doc_id", "n_shingles", "component_id"], "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"]}
    if name in columns:
        assert df.columns == columns[name] and {r["doc_id"] for r in df.collect()} == texts.keys()
    else:
        source = spark.read.parquet(f"{small}/conversations.parquet").distinct()
        assert df.select("conv_id", "turn").distinct().count() == source.select("conv_id", "turn").distinct().count()


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stage_keep_good_leaves_what_is_not_removed(messy):
    kept = quality_rules.keep_good(messy)
    before = {(r["doc_id"], r["source"], r["text"]) for r in messy.collect()}
    assert kept.columns == messy.columns and kept.count()
    for r in kept.collect():  # no line is frequent here, so that texts stay as they are
        assert (r["doc_id"], r["source"], r["text"]) in before and r["n_chars"] == len(r["text"])
        assert len(WORDS.findall(r["text"])) >= 20


def test_stage_keep_one_keeps_the_smallest(messy):
    kept = ngram_join.keep_one(messy)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(messy).where("doc_id IS NOT NULL AND n_shingles > 0").collect()}
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert {i for i in ids if i in found} == {k for k, root in found.items() if k == root}
    assert not rows_of(kept) - rows_of(messy.distinct()) - rows_of(messy)
    assert {3, 4, 5} <= set(ids)  # documents without words are no copies of each other


def test_stage_redact_changes_secrets_alone(messy):
    before = {(r["doc_id"], len(r["text"] or "")): r["text"] for r in messy.collect()}
    after = secrets.redact(messy).collect()
    changed = 0
    for r in after:
        if r["text"] is None:
            continue
        if "[SECRET]" in r["text"]:
            changed += 1
            old = next(t for (k, _), t in before.items() if k == r["doc_id"] and "token" in t)
            assert old.startswith("token") and r["text"] == "[SECRET]" + old[old.index('" ') :]
            assert not [s for s in secrets.scan(r["text"])] and r["n_chars"] == len(r["text"])
        else:
            assert (r["doc_id"], len(r["text"])) in before and before[(r["doc_id"], len(r["text"]))] == r["text"]
    assert changed == 1


def test_stage_take_takes_the_copies_of_the_mix(messy):
    taken = rows_of(mixing.take(messy).select("doc_id", "source", "text"))
    copies = collections.Counter()
    texts = {}
    for r in messy.select("doc_id", "source", "text", mixing.F.xxhash64("text").alias("k")).collect():
        texts[(r["doc_id"], r["source"], r["k"])] = r["text"]
    for r in mixing.mix(messy).collect():
        copies[(r["doc_id"], r["source"], r["text_key"])] += r["copies"]
    assert taken == collections.Counter({(d, s, texts[(d, s, k)]): n for (d, s, k), n in copies.items() if n})


def test_pipeline_runs_over_whole_tables(spark, small, texts):
    """Every row is the encoding of a document that the stages keep: redacted, without near copies, in whole copies."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "ids"]
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= texts.keys()
    good = {r["doc_id"] for r in quality_rules.keep_good(spark.read.parquet(f"{small}/documents.parquet")).select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= good
    each = collections.defaultdict(set)
    for r in rows:
        each[r["doc_id"]].add(tuple(r["ids"]))
    assert all(len(v) == 1 for v in each.values())
