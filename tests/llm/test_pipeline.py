"""The pipeline's stages on odd rows, its run against the stages composed by hand, and base spans against plain patterns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import arrowtext as at
from pathloom.llm import langid, pii, quality, registry, secrets

SF = "/root/testdata/sf0.001"
CLASHES = ("domain", "rest", "full", "taken_tokens", "n_tokens", "__c", "a.b", "score", "kept", "same_text", "lang_pred", "SPANS")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and repeated texts, one id for two texts, and columns named like results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    text = " ".join(f"word{i}" for i in range(60))
    made = [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, " \n", None, "s", 2), (9004, text, "en", "s", 9), (9004, text + " more", "en", "s", 9), (9004, "only this one is another text", "en", "s", 9), (9005, text, "en", "s", 9), (None, "no id at all here", "en", "s", 3)]
    out = docs.union(spark.createDataFrame(made, docs.schema))
    for name in CLASHES:
        out = out.withColumn(name, F.lit("kept"))
    return out.persist()


def test_stages_keep_odd_rows_and_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        if name != "source_mixing":
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r["a.b"] == "kept" and r["domain"] == "kept" for r in rows), name
        if name == "language_id":
            assert {r["doc_id"] for r in rows} & {9001, 9002, 9003} == set()
        if name == "near_dedup":
            own = [(r["doc_id"], r["text"]) for r in rows]
            assert 9005 not in dict(own) and sum(i == 9004 for i, _ in own) == 3 and any(i is None for i, _ in own)
        docs = spark.createDataFrame(out.collect(), out.schema)
    made = {"domain", "n_tokens", "full_epochs", "prefix_tokens", "taken_tokens"}
    assert len(docs.columns) == len(set(docs.columns)) and made <= set(docs.columns)
    rows = docs.collect()
    assert rows and all(r["rest"] == r["full"] == r["a.b"] == "kept" and r["domain"] in ("web", "books") for r in rows)


def test_run_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert rows(docs) == rows(corpus_pipeline.run(spark, SF))


# Base spans, by plain patterns ----------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def leftmost(pattern, text, good, flags=0):
    return [m.span() for m in re.finditer(pattern, text, flags) if good(m)]


def digest(kinds):
    every = sorted((s, k, e) for k, spans in enumerate(kinds.values()) for s, e in spans)
    names = list(kinds)
    return hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in every).encode()).hexdigest()


def personal(text):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True),
        "ip": leftmost(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": leftmost(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": leftmost(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 10 <= len(only(m)) <= 15),
    }


def hidden(text):
    return {
        "assign": leftmost(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m.group(2)) >= 8, re.I | re.A),
        "access": leftmost("AKIA[A-Z0-9]+", text, lambda m: len(m.group()) >= 16),
        "hex": leftmost("[0-9a-f]+", text, lambda m: len(m.group()) >= 32),
    }


def noise(made_of, parts, n):
    return "".join(made_of.choice(parts) for _ in range(n))


@pytest.mark.parametrize(("found", "plain"), [(pii.found, personal), (secrets.found, hidden)])
def test_base_spans_equal_plain_patterns(spark, found, plain):
    made_of = random.Random(8)
    numbers = ["4111 1111 1111 1111", "+49 171 2345678", "10.0.0.255", "256.1.1.1", "a.b@c-d.example", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "Password", "api_key", "token", '"', "=", ": ", "é", "🙂"]
    parts = [*numbers, *"0123456789.-+@ ()\n", " ", "ab", "x"]
    texts = [noise(made_of, parts, made_of.randint(0, 40)) for _ in range(1500)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 10_000, "text"))
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in found(rows, carry=["doc_id"]).collect():
        kinds = plain(text[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in kinds] == [len(v) for v in kinds.values()], text[r["doc_id"]]
        assert r["base_sha256"] == digest(kinds)
        spans = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{s}:{e}" for k, v in kinds.items() for s, e in v} <= spans


# Languages and quality ------------------------------------------------------------------------------------------------


def greedy(text, learned):
    """Phrases of the longest matches, one after another, by plain search; an unseen letter is one phrase."""
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in learned:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


def test_phrases_go_on_across_blocks():
    made_of = random.Random(4)
    learned = [noise(made_of, "abc ", 400), noise(made_of, "abd ", 300)]
    models = langid.Models([(str(i), x) for i, x in enumerate(learned)])
    plain = [bytes(langid.cleaned(at.Texts(pa.array([x])))[0]) for x in learned]
    texts = [noise(made_of, "abcde ", n) for n in (1, 5, 16, 17, 300, 2000)] + [learned[0] * 3]
    data, offsets = langid.cleaned(at.Texts(pa.array(texts)))
    want = [[greedy(bytes(data[lo:hi]), p) for p in plain] for lo, hi in zip(offsets[:-1], offsets[1:])]
    for block in (1, 3, 16, 100, 10**6):
        assert models.phrases(data, offsets, block).tolist() == want


def test_languages_equal_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    learned = langid.samples(docs, "doc_id", "text", "lang")
    plain = [(name, bytes(langid.cleaned(at.Texts(pa.array([x])))[0])) for name, x in learned]
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in docs.limit(40).collect():
        text = bytes(langid.cleaned(at.Texts(pa.array([r["text"]])))[0])
        bits = sorted((greedy(text, p) * np.log2(max(2, len(p))) / max(1, len(text)), name) for name, p in plain)
        got = rows[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert got["lang_pred"] == bits[0][1] and got["score"] == pytest.approx(1 - bits[0][0] / bits[1][0])


def test_a_language_of_long_rows_is_learned_whole(spark):
    long = "zeta theta " * 400
    rows = spark.createDataFrame([(1, long, "x"), (2, long + "iota", "x"), (4, "alpha beta gamma", "y")], "doc_id long, text string, lang string")
    assert dict(langid.samples(rows.where("doc_id <> 0"), "doc_id", "text", "lang")) == {"x": long, "y": "alpha beta gamma"}


def test_quality_query_holds_its_contract(spark):
    df = registry.QUERIES["op5_quality_classifier"](spark, SF)
    rows, labels = df.collect(), {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    # The fit in a task is the fit of the same rows in plain sight.
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = sorted(i for i, y in labels.items() if i in docs and y is not None and zlib.crc32(str(i).encode()) % 5)
    found = quality.features(at.Texts(pa.array([docs[i] for i in known])))
    order = np.random.default_rng(quality.SEED).permutation(len(known))
    ones = [labels[i] for i, y in labels.items() if y is not None and zlib.crc32(str(i).encode()) % 5]
    model = quality.Model([found[k] for k in order], np.array([labels[known[k]] for k in order]), sum(ones) / len(ones))
    score = dict(zip(docs, model.score(quality.features(at.Texts(pa.array(list(docs.values())))))))
    assert all(r["score"] == pytest.approx(score[r["doc_id"]]) for r in rows)
